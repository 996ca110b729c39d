"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (white space to
its meta symbol, the dummy prefix), the pieces (a trie whose final states emit a
piece's id at its weight) and the byte fallback (a character without a piece
emits its UTF-8 bytes' ids). Each is composed with the input on the fly, so a
state of the composed machine is a place in the input, and relaxing its arcs in
order of place gives the tropical-semiring shortest path.

Weights follow the model's kind. A unigram model's arc weighs minus the piece's
score. A BPE model's arcs weigh nothing, but an arc may follow another only if
the merges would leave that pair of pieces apart (its weight is infinite
otherwise). Merges inside a piece never look past its neighbours, so the one path
of finite weight is the segmentation that the merges make.

Where no piece has two characters side by side a path always passes between
them, as between a word and the next space. The input is cut there, and the paths
of short stretches are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm import textvec
from treequill.llm.common import table

#: The registered query's model.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Paths remembered in each Python worker, and the longest stretch that is remembered. Beyond them paths are found anew.
REMEMBERED, LONGEST = 200_000, 40
#: What a character costs a unigram path if it has no piece, over the worst piece.
UNKNOWN_PENALTY = 10.0
INFINITE = float("inf")
#: Rows that are encoded at a time.
ROWS = 500


@dataclass(frozen=True)
class Model:
    """What is read from a model file: (piece, score, type) by id, and the switches."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    dummy_prefix: bool
    strip: bool
    escape: bool


def read_model(path: str) -> Model:
    """The model in the file at ``path`` on the driver. Models with a character map aren't handled."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    normal, trainer = proto.normalizer_spec, proto.trainer_spec
    if normal.precompiled_charsmap:
        raise ValueError(f"the normaliser {normal.name!r} has a character map; only identity is handled")
    if trainer.model_type not in (UNIGRAM, BPE) or trainer.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with white space in front are handled")
    pieces = tuple((p.piece, p.score, p.type) for p in proto.pieces)
    return Model(pieces, trainer.model_type, trainer.byte_fallback, normal.add_dummy_prefix, normal.remove_extra_whitespaces, normal.escape_whitespaces)


class Encoder(dict):
    """Ids of stretches of normalised text, as bytes of int32; a stretch is solved when it is first met."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.older: dict[str, bytes] = {}
        self.ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
        self.cost = {i: -model.pieces[i][1] for i in self.ids.values()}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        self.bytes_of = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.unknown_cost = max(self.cost.values(), default=0.0) + UNKNOWN_PENALTY
        #: The piece transducer by the text read since the start of an arc: the id where a piece ends, -1 on the way to one.
        self.states: dict[str, int] = {}
        for piece in self.ids:
            for j in range(1, len(piece)):
                self.states.setdefault(piece[:j], -1)
        self.states.update(self.ids)
        self.cut = self._stretches()
        self.apart: dict[int, bool] = {}

    def _stretches(self) -> re.Pattern:
        """Cuts a text where no piece can reach across, so that few stretches differ.

        Spaces start a stretch, and so does punctuation after a letter, if no piece
        has any letter before it. Control characters that no longer piece holds are
        stretches of their own.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile("(?s).+")
        marks = set("!\"#$%&'()*+,-./:;<=>?@[]^`{|}~")
        marks -= {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        long = {c for p in self.ids if len(p) > 1 for c in p}
        alone = [c for c in "\n\t\r" if c not in long]
        of = lambda cs: "".join(map(re.escape, sorted(cs)))
        letter, rest = r"[^\W\d_]", rf"(?:[\W\d_](?<![{SPACE}{of(alone)}]))"
        before = f"{rest}*{letter}++(?=[{of(marks)}])|" if marks else ""
        return re.compile(f"{SPACE}*(?:{before}[^{of(alone)}{SPACE}]+)|{SPACE}+" + (f"|[{of(alone)}]" if alone else ""))

    # The normaliser.

    def normal(self, text: str) -> str:
        if self.model.strip:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.model.escape else text

    # The byte fallback.

    def fallback(self, c: str) -> list[int]:
        if self.model.byte_fallback and self.bytes_of:
            return [self.bytes_of[b] for b in c.encode("utf-8", "replace")]
        return [self.unknown]

    # The weights of BPE.

    def merged(self, text: str) -> list[str]:
        """The pieces that the merges make of a short text: the best-scored neighbours first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = INFINITE, -1
            for i in range(len(parts) - 1):
                cost = self.cost.get(self.ids.get(parts[i] + parts[i + 1], -1), INFINITE)
                if cost < best:
                    best, at = cost, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """May the arc of ``right`` come after that of ``left``? An empty left is the start."""
        return self.merged(left + right) == ([left, right] if left else [right])

    # Composition and the shortest path.

    def path(self, text: str) -> list[tuple[int, int]]:
        """(arc's id, end) of the arcs of the shortest path through ``text``; an arc without a piece has -2 - its character."""
        return self._only_path(text) if self.model.kind == BPE else self._least_path(text)

    def arcs(self, text: str, i: int) -> list[tuple[int, int]]:
        """The arcs from place ``i``, by rising length; the byte fallback stands in where the character has no piece."""
        states, out = self.states, []
        for j in range(i + 1, len(text) + 1):
            found = states.get(text[i:j])
            if found is None:
                break
            if found >= 0:
                out.append((found, j))
        if not out or out[0][1] != i + 1:
            out.insert(0, (-2 - ord(text[i]), i + 1))
        return out

    def _only_path(self, text: str) -> list[tuple[int, int]]:
        """With weights 0 and infinity any finite path is shortest, and there is one: found depth first, longest arcs first.

        What leads to a place is unique, so a place that leads nowhere never needs a second visit.
        """
        n, apart = len(text), self.apart
        path: list[tuple[int, int]] = []
        open_: list[list[tuple[int, int]]] = []
        dead: set[int] = set()
        i, left, start = 0, -1, 0
        while i < n:
            rest = self.arcs(text, i)
            while True:
                step = None
                while rest:
                    found, j = rest.pop()
                    if j in dead:
                        continue
                    if found >= 0 and left >= -1:
                        key = ((left + 1) << 24) + found
                        fits = apart.get(key)
                        if fits is None:
                            fits = self._judge(key, text[start:i], text[i:j])
                    else:
                        fits = self.follows(text[start:i], text[i:j])
                    if fits:
                        step = (found, j)
                        break
                if step is not None:
                    break
                # Back to the place before, for its next shorter arc.
                dead.add(i)
                path.pop()
                rest = open_.pop()
                i = path[-1][1] if path else 0
                left = path[-1][0] if path else -1
                start = path[-2][1] if len(path) > 1 else 0
            open_.append(rest)
            path.append(step)
            start, i, left = i, step[1], step[0]
        return path

    def _least_path(self, text: str) -> list[tuple[int, int]]:
        """The least sum of weights to each place, in order of place."""
        n = len(text)
        best = [INFINITE] * (n + 1)
        back = [0] * (n + 1)
        arc = [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            for found, j in self.arcs(text, i):
                weight = best[i] + (self.cost[found] if found >= 0 else self.unknown_cost)
                if weight < best[j]:
                    best[j], back[j], arc[j] = weight, i, found
        out, j = [], n
        while j > 0:
            out.append((arc[j], j))
            j = back[j]
        return out[::-1]

    def _judge(self, key: int, left: str, right: str) -> bool:
        if len(self.apart) > REMEMBERED:
            self.apart.clear()
        got = self.apart[key] = self.follows(left, right)
        return got

    def solve(self, text: str) -> bytes:
        out: list[int] = []
        for found, end in self.path(text):
            if found >= 0:
                out.append(found)
            else:
                out += self.fallback(text[end - 1])
        return np.array(out, dtype=np.int32).tobytes()

    def __missing__(self, stretch: str) -> bytes:
        out = self.older.get(stretch)
        if out is None:
            out = self.solve(stretch)
        if len(stretch) <= LONGEST:
            if 2 * len(self) >= REMEMBERED:  # what was met lately stays for another round
                self.older = dict(self)
                self.clear()
            self[stretch] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut.findall(self.normal(text))))


class Decoder:
    """The inverted transducers: ids to text."""

    def __init__(self, model: Model) -> None:
        self.model = model
        plain = {NORMAL, USER, UNUSED}
        self.text = [p.replace(SPACE, " ").encode() if t in plain else bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " \u2047 ".encode() for p, _, t in model.pieces]

    def decode(self, ids: list[int]) -> str:
        """Byte pieces join to characters; bytes that make none become U+FFFD. The dummy prefix goes."""
        raw = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.model.dummy_prefix and raw.startswith(" ") else raw


_MACHINES: dict[bytes, tuple[Encoder, Decoder]] = {}


def machines(model: Model) -> tuple[Encoder, Decoder]:
    """The compiled machines, once for each Python worker and model."""
    key = hashlib.blake2b(repr(model).encode(), digest_size=16).digest()
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = (Encoder(model), Decoder(model))
    return _MACHINES[key]


def _encode_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = machines(model)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                texts = textvec.column(batch, "text").to_pylist()
                codes = [b"" if t is None else encoder.encode(t) for t in texts]
                offsets = np.cumsum([0] + [len(c) // 4 for c in codes]).astype(np.int32)
                ids = np.frombuffer(b"".join(codes), dtype=np.int32)
                backs = [decoder.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
                same = pa.array([t is not None and t == d for t, d in zip(texts, backs, strict=True)], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([textvec.column(batch, "doc_id"), lists, pa.array(np.diff(offsets).astype(np.int64)), same], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return textvec.lean(run)


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each row of ``docs`` (doc_id, text; others are ignored).

    ``round_trip``: do the ids decode to the text? Only a text with the space
    symbol itself, or one whose white space the model's normaliser changes,
    doesn't. Null and empty texts have no ids; a null is no round trip. Rows are
    encoded on their own, so repeats give equal ids. Empty tables give no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode_rows(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, round_trip boolean")


def _decode_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = machines(model)
        for batch in batches:
            ids = textvec.column(batch, "ids").to_pylist()
            texts = pa.array([None if x is None else decoder.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([textvec.column(batch, "doc_id"), texts], names=["doc_id", "text"])

    return textvec.lean(run)


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) of each row of ``rows`` (doc_id, ids); null ids give a null text."""
    return rows.select("doc_id", "ids").mapInArrow(_decode_rows(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op7_wfst_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), read_model(MODEL_PATH))
