"""Quality rules as a short-circuit cascade.

Base statistics are facts of every row. The rules behind them only decide
whether a row is kept, so they run as one CASE expression, which Spark evaluates
branch by branch: a row that a rule rejects pays for none of the later ones.
Each rule's cost and verdicts are measured on a bounded sample. The rule with the
most rejections per cost comes first; the next is the one with the most among the
rows that are left, and so on. The order changes time, not verdicts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm.common import SPACE, cut, table

#: Rows of the sample that costs and selectivities are measured on, how often a timed run goes over them, and the timed runs (the fastest counts).
SAMPLE_ROWS, PASSES, TRIES = 1000, 4, 2
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
WORD = rf"[^{SPACE}]"
GAP = rf"[{SPACE}]"


@dataclass(frozen=True)
class Rule:
    """``fails`` gives a boolean column over ``text`` and the base statistics: true if the row breaks the rule."""

    name: str
    fails: Callable[[], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"{GAP}+"), "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more.

    Windows become hashes. Only a text with fewer distinct ones than windows goes on:
    sorting (hash, place) brings repeats side by side, and what their places cover is
    added up. So the work is that of a sort, however long a text and many its repeats.
    """

    def of(ws: Column) -> Column:
        n = F.size(ws)
        grams = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(ws, i + (k - 1)) for k in range(WINDOW)]))
        return F.when(n <= WINDOW, F.lit(0)).otherwise(_let(grams, covered))

    def covered(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), cover))

    def cover(pairs: Column) -> Column:
        like = lambda x, k: F.coalesce(F.get(pairs, k)["g"] == x["g"], F.lit(False))
        marked = F.transform(pairs, lambda x, k: F.when(like(x, k - 1) | like(x, k + 1), x["i"]))
        places = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"), i.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["total"])

    return of(words)


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def base(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and the base statistics of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = _words(F.col("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        _let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeat_words(ws).cast("long").alias("n_repeat_words"))).alias("_w"),
        (F.char_length("text") - _count(F.col("text"), GAP)).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    )
    return found.select("doc_id", "text", "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")


def _adjacent(words: Column) -> Column:
    """Words equal to the one before."""
    same = lambda ws: F.zip_with(F.slice(ws, 2, F.size(ws)), F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: a == b)
    return _let(words, lambda ws: F.size(F.filter(same(ws), lambda x: x)))


#: The production rules. Their thresholds leave plain prose, of one line or of thousands of words, far inside.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 4 * (_count(F.col("text"), "\n") + 1)),
    Rule("exclamations", lambda: 10 * _count(F.col("text"), "!") > 3 * F.col("n_words")),
    Rule("capitals", lambda: 2 * _count(F.col("text"), r"\p{Lu}") > F.col("word_chars")),
    Rule("letters", lambda: 10 * _count(F.col("text"), r"\p{L}") < 4 * F.col("word_chars")),
    Rule("stutter", lambda: 10 * _adjacent(_words(F.col("text"))) > 3 * F.col("n_words")),
)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, twice that at most: those whose hash lies lowest. Without rows, none."""
    share = min(1.0, rows / max(1, docs.count()))
    lowest = F.xxhash64("doc_id").cast("double") / float(2**63)
    return docs.where(lowest <= 2 * share - 1).limit(2 * rows)


@dataclass(frozen=True)
class Measured:
    """A rule's seconds a row, and its verdict on each row of the sample."""

    rule: Rule
    seconds: float
    fails: tuple[bool, ...]


def measure(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and verdicts of each rule on the rows of a bounded sample that reach the rules: those that the base rule passes.

    A rule's time is that of a warm job that goes over the rows ``PASSES`` times,
    less the time of the same job without a rule.
    """
    reach = base(sample_of(docs.select("doc_id", "text"), rows)).where(~_base_failed())
    sample = cut(reach.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(PASSES)))))
    names = [f"rule_{i}" for i in range(len(rules))]
    verdicts = sample.where("_pass = 1").select(*[F.coalesce(r.fails(), F.lit(False)).alias(n) for r, n in zip(rules, names, strict=True)]).collect()

    def seconds(fails: Column) -> float:
        job = sample.agg(F.count_if(fails), F.sum("_pass"))
        took = []
        for _ in range(TRIES + 1):
            began = time.perf_counter()
            job.first()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    without = seconds(F.col("n_words") < 0)
    each = max(1, PASSES * len(verdicts))
    return [Measured(r, max(0.0, seconds(r.fails()) - without) / each, tuple(v[n] for v in verdicts)) for r, n in zip(rules, names, strict=True)]


def ordered(measured: Sequence[Measured]) -> list[Rule]:
    """Rules by rejection per cost, each among the rows that those before it leave; a cost of a nanosecond a row at least."""
    left, rest, out = None, sorted(measured, key=lambda m: m.rule.name), []
    while rest:
        left = range(len(rest[0].fails)) if left is None else left
        best = max(rest, key=lambda m: sum(m.fails[i] for i in left) / max(m.seconds, 1e-9))
        if not any(best.fails[i] for i in left):  # what rejects nothing any more goes by cost
            return out + [m.rule for m in sorted(rest, key=lambda m: m.seconds)]
        out.append(best.rule)
        rest.remove(best)
        left = [i for i in left if not best.fails[i]]
    return out


def cascade(rules: Sequence[Rule]) -> Column:
    """The first rule in order that a row breaks, else null; later rules aren't evaluated for it."""
    out = None
    for rule in rules:
        fails = F.coalesce(rule.fails(), F.lit(False))
        out = F.when(fails, F.lit(rule.name)) if out is None else out.when(fails, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, order: Sequence[Rule] | None = None) -> DataFrame:
    """Base statistics, ``base_failed`` and ``kept`` of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null texts count as empty: no words, so base_failed. Texts of any length are
    judged whole. Repeated rows are judged alike. Empty tables give no rows.
    ``order`` skips the measuring.
    """
    order = ordered(measure(docs, rules, sample_rows)) if order is None else order
    stats = base(docs)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order).isNull())
    return stats.withColumn("base_failed", _base_failed()).withColumn("kept", kept).drop("text")


def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


WORDS_SQL = f"regexp_extract_all(coalesce(text, ''), '{WORD}+')"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
grams AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs)),
twice AS (SELECT r, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (r, g), range(5) t(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{WORD}') GROUP BY r),
facts AS (SELECT doc_id, text, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(w) FOR w IN ws]), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len([i FOR i IN range(2, len(ws) + 1) IF ws[i] = ws[i - 1]]) AS stutter, length(text) - length(replace(text, chr(10), '')) AS breaks, length(text) - length(replace(text, '!', '')) AS shouts,
    length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS capitals, length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')) AS letters
    FROM docs LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 4 * (breaks + 1) OR 10 * shouts > 3 * n_words
    OR 2 * capitals > word_chars OR 10 * letters < 4 * word_chars OR 10 * stutter > 3 * n_words) AS kept
FROM judged
"""
