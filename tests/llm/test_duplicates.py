"""The n-gram join, components and substring dedup against brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from treequill.llm import graph, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, rep long, node long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n, seed):
    """Prose with exact copies, edited copies, shared passages, repeats inside a text, and edge rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "naïve", "日本", "a"]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = fresh(30)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            copy = list(rng.choice(texts))
            for _ in range(rng.randrange(1, 4)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
        elif kind < 0.6:
            texts.append(fresh(rng.randrange(40)) + passage[: rng.randrange(15, 31)] + fresh(rng.randrange(40)))
        elif kind < 0.65:
            part = fresh(25)
            texts.append(part + part + fresh(3) + part)
        elif kind < 0.68:
            texts.append(["a"] * rng.randrange(60))
        else:
            texts.append(fresh(rng.choice([0, 1, 3, 5, 19, 20, 21, 80, 200])))
    rows = [(i, rng.choice([" ", "\n", "\t ", "  "]).join(t), None, i) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (n, None, 1, 1), (n + 1, "", 1, 1), (n + 2, " \n\x0b", 1, 1)]


def brute_dedup(rows):
    seen, out = set(), {}
    for i, text in sorted((r[:2] for r in rows), key=lambda r: r[0]):
        ws, gone = words_of(text), set()
        for p in range(len(ws) - 19):
            gram = tuple(ws[p : p + 20])
            if gram in seen:
                gone.update(range(p, p + 20))
            seen.add(gram)
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_against_brute_force(spark, seed):
    rows = corpus(150, seed)
    got = substring_dedup.parse(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute_dedup(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, " ".join(words_of(r.kept_text))) for r in got} == want
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r.kept_text == texts[r.doc_id] for r in got if r.n_removed == 0)
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed
        assert all(s.length >= 20 for s in r.spans)
        assert [s for s in r.factors if s.length < 1] == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_factors_rebuild_the_texts(spark, seed):
    """Each factor's words stand at its source, which is earlier; matches have a window or more; no factor overlaps the next."""
    rows = corpus(150, seed)
    words = {r[0]: words_of(r[1]) for r in rows}
    got = substring_dedup.parse(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sum(len(r.factors) for r in got) > 20
    for r in got:
        at, left = 0, " ".join(words_of(r.kept_text)).split()
        built = []
        for f in r.factors:
            assert f.start >= at and (f.source_doc, f.source_start) < (r.doc_id, f.start)
            built += left[: f.start - at]
            del left[: f.start - at]
            for k in range(f.length):
                source = built if f.source_doc == r.doc_id else words[f.source_doc]
                built.append(source[f.source_start + k])
            at = f.start + f.length
        assert built + left == words[r.doc_id]
        assert sum(f.length for f in r.factors) == r.n_removed


def test_probes_of_common_windows_meet_the_broadcast(spark, monkeypatch):
    """Windows over the limit and under it, answered either way, give the same factors."""
    rows = corpus(150, 4)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(repr, substring_dedup.parse(frame).collect()))
    for least, share in ((1, 1000), (2, 3)):
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", least)
        monkeypatch.setattr(substring_dedup, "HOT_SHARE", share)
        assert sorted(map(repr, substring_dedup.parse(frame).collect())) == want


def test_factors_follow_their_sources():
    """A factor goes on along one source, ends where the source changes, and begins behind the one before."""
    places, docs, sources = (np.array(c) for c in ([3, 10, 18, 60], [1, 1, 2, 2], [5, 12, 40, 82]))
    got = [c.tolist() for c in substring_dedup._factors(places, docs, sources, 20)]
    assert got == [[3, 30, 60], [27, 8, 20], [1, 2, 2], [5, 52, 82]]


def test_substring_dedup_edges(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(1, long), (2, "q " + long), (3, None), (5, "only " * 20), (5, "only " * 20), (None, long), (None, None)]
    got = substring_dedup.parse(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == Counter({(1, 200_000, 0): 1, (2, 200_001, 200_000): 1, (3, 0, 0): 1, (5, 20, 0): 2, (None, 200_000, 200_000): 1, (None, 0, 0): 1})
    assert substring_dedup.parse(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substring_dedup_of_repeated_ids_with_other_texts(spark):
    """Of a passage at two places of rows that share a doc_id the one at the least place stays, in any order of the rows."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(5, passage + " tail"), (5, " ".join(f"h{i}" for i in range(10)) + " " + passage), (7, passage)]
    for order in (rows, rows[::-1]):
        got = substring_dedup.parse(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(5, 21, 0), (5, 30, 20), (7, 20, 20)]


def test_least_is_leftmost():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 5, 8, 13):
        values = rng.integers(0, 4, 200).astype(np.uint64)
        want = [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]
        assert substring_dedup._least(values, width).tolist() == want


def brute_join(rows, threshold=0.8):
    sets = {}
    for i, text in (r[:2] for r in rows):
        ws = words_of(text)
        sets[i] = frozenset(tuple(ws[p : p + 5]) for p in range(max(1, len(ws) - 4))) if ws else frozenset()
    links, root = Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i], min(j for j in ids if sets[j] == sets[i])) for i in ids}


@pytest.mark.parametrize("seed", [4, 5])
def test_join_against_brute_force(spark, seed):
    rows = corpus(160, seed)
    got = ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.rep) for r in got} == brute_join(rows)


def test_join_of_a_large_group_is_whole(spark, monkeypatch):
    """Buckets far over their limit and groups of many tiles lose no link."""
    monkeypatch.setattr(ngram_join, "BUCKET", 8)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(text), None, None))
    got = ngram_join.join(spark.createDataFrame(rows, SCHEMA), tile=16).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.rep) for r in got} == brute_join(rows)


def test_join_edges(spark):
    long = " ".join(f"x{i}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, "a"), (4, "a"), (5, "a b"), (6, long), (7, long + " y"), (8, "p q r s t"), (8, "p q r s t"), (None, "a"), (None, "a")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(1, 1, 1): 1, (2, 1, 1): 1, (3, 3, 1): 1, (4, 3, 1): 1, (5, 5, 0): 1, (6, 6, 1): 1, (7, 6, 1): 1, (8, 8, 1): 2, (None, None, 0): 2}
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter(want)
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_of_repeated_ids_with_other_texts(spark):
    """Rows that share a doc_id are rows of their own, in any order."""
    long = lambda tag, n=30: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(5, long("a")), (5, long("b")), (6, long("a") + " more"), (7, long("b") + " more"), (5, long("a")), (8, long("c")), (None, long("a"))]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame([(*r, i) for i, r in enumerate(order)], "doc_id long, text string, cls long")
        got = ngram_join.join(frame).collect()
        want = {(5, 5, 5, 2, 2): 2, (5, 5, 5, 1, 1): 1, (6, 6, 5, 1, 2): 1, (7, 7, 5, 1, 1): 1, (8, 8, 8, 1, 0): 1, (None, None, None, 1, 0): 1}
        assert Counter((r.doc_id, r.rep, r.class_id, r.n_copies, r.n_links) for r in got) == Counter(want)
        left = ngram_join.representatives(frame).collect()
        assert Counter((r.doc_id, r.text) for r in left) == Counter([(5, long("a")), (5, long("b")), (8, long("c")), (None, long("a"))])


def test_hot_keys_meet_as_others_do(spark):
    from treequill.llm.common import join_counted

    rows = spark.createDataFrame([(7, i) for i in range(3000)] + [(i, i) for i in range(100, 400)] + [(None, 1)], "k long, x long")
    counted = rows.where("k is not null").groupBy("k").count().where("k <> 333")
    for most in (3000, 10**6):
        got = Counter((r.k, r["count"]) for r in join_counted(rows, "k", counted, "count", 3300, most).collect())
        assert got == Counter({(7, 3000): 3000, **{(i, 1): 1 for i in range(100, 400) if i != 333}})


def test_runs_follow_the_recall():
    assert ngram_join.runs_for(0.9) < ngram_join.runs_for(0.99) < ngram_join.runs_for(0.9999)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100} | {200 + i: 200 for i in range(30)}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
