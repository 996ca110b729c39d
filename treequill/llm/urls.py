"""URL filters: rules, and a blocked Bloom filter in front of an exact list.

A URL is judged by the longest rule that fits it. Where none fits, the verdict
is the list's: a listed canonical URL is blocked. The list's Bloom filter is cut
into blocks of eight 64-bit words; a URL's hash names one block and one bit in
each word. Blocks are rows, so building is one aggregation with ``bit_or`` and
probing one hash join on the block number, with the blocks broadcast while they
are few. Only rows that pass go to an exact join with the list, which removes the
false positives; their URLs are counted first, so popular ones stay spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm.common import cut, join_counted, table

#: (host, path, verdict). A rule fits its host and all subdomains, for paths that start with its path.
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Bits that a listed URL gets, and the most blocks (64 bytes each) that are broadcast: 4 MB. A larger filter meets rows by block.
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 16
WORDS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    authority = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and path without closing slashes: scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_name(rule: Rule) -> str:
    return rule[0] + rule[1]


def matched_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The name of the longest rule (host and path together; ties in order of name) that fits, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(rule_name(r)), rule_name(r))):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out = F.when(fits, F.lit(rule_name(rule))) if out is None else out.when(fits, F.lit(rule_name(rule)))
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def _hashes(url: Column) -> tuple[Column, Column]:
    """The hash that names a URL's block, and the one that its bits come from."""
    return F.xxhash64(url), F.xxhash64(url, F.lit("bits"))


def _bits(spread: str) -> list[Column]:
    """One bit for each word of a block, from six bits each of the hash in column ``spread``."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({spread}, {6 * i}) & 63 as int))") for i in range(WORDS)]


def build_filter(listed: DataFrame, column: str = "url", blocks: int | None = None) -> tuple[DataFrame, int]:
    """(block, w0..w7) rows of the non-empty blocks of the filter of ``listed[column]``, and the number of blocks.

    The number follows the list.
    """
    if blocks is None:
        blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS)))
    where, spread = _hashes(F.col(column))
    hashed = listed.where(F.col(column).isNotNull()).select(F.pmod(where, F.lit(blocks)).alias("block"), spread.alias("_spread"))
    marked = hashed.select("block", *[b.alias(f"w{i}") for i, b in enumerate(_bits("_spread"))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def probe(rows: DataFrame, column: str, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``maybe``: false only if ``column`` is certainly not in the filter."""
    where, spread = _hashes(F.col(column))
    keyed = rows.withColumns({"_at": F.pmod(where, F.lit(blocks)), "_spread": spread})
    joined = keyed.join(F.broadcast(filter_rows) if blocks <= MAX_BLOCKS else filter_rows, F.col("_at") == F.col("block"), "left")
    hit = F.lit(True)
    for i, b in enumerate(_bits("_spread")):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("_at", "_spread", "block", *[f"w{i}" for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each row of ``pages`` (page_id, url); ``listed`` has canonical URLs in column url.

    Null URLs and those without ``://`` have an empty host and path; they fit no
    rule, and the empty canonical URL is never listed. URLs of any length are
    judged whole. Repeated rows are judged
    alike; repeats and nulls in the list don't matter. Other columns of either
    table are ignored. An empty list blocks nothing.
    """
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = parts.withColumns({"rule": matched_rule(F.col("host"), F.col("path"), rules), "_canonical": canonical(F.col("host"), F.col("path"))})
    exact = listed.select(F.col("url").alias("_listed")).where(F.col("_listed").isNotNull() & (F.col("_listed") != "")).distinct()
    bloom, blocks = build_filter(exact, "_listed")
    probed = probe(known, "_canonical", bloom, blocks)
    possible = probed.where("maybe").drop("maybe")
    asked = possible.groupBy("_canonical").agg(F.count(F.lit(1)).alias("_n"))
    answers = cut(asked.join(exact, F.col("_canonical") == F.col("_listed"), "left").select("_canonical", "_n", F.col("_listed").isNotNull().alias("listed")))
    total, largest = answers.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    met = join_counted(possible, "_canonical", answers, "_n", total, largest).drop("_n")
    met = met.union(probed.where("not maybe").drop("maybe").withColumn("listed", F.lit(False)))
    hit = F.col("listed")
    verdicts = {rule_name(r): r[2] for r in rules}
    of_rule = F.lit(None).cast("string")
    for name, verdict in verdicts.items():
        of_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(of_rule)
    return met.select("page_id", "host", "path", "rule", F.coalesce(of_rule, F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def recurring(pages: DataFrame, least: int = 2) -> DataFrame:
    """The block list of the registered query: canonical URLs that ``least`` or more pages share, as crawler traps and mirrors do."""
    url = F.col("url")
    keys = pages.select(canonical(host_of(url), path_of(url)).alias("url"))
    return keys.where(F.col("url") != "").groupBy("url").count().where(F.col("count") >= least).select("url")


def op6_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, recurring(pages))


def _oracle(rules: Sequence[Rule] = RULES) -> str:
    whens = " ".join(
        f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{rule_name(r)}'"
        for r in sorted(rules, key=lambda r: (-len(rule_name(r)), rule_name(r)))
    )
    verdicts = " ".join(f"WHEN rule = '{rule_name(r)}' THEN '{r[2]}'" for r in rules)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
keyed AS (SELECT *, CASE {whens} END AS rule, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM parts),
listed AS (SELECT canonical FROM keyed WHERE canonical <> '' GROUP BY canonical HAVING count(*) >= 2)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, l.canonical IS NOT NULL AS listed
FROM keyed k LEFT JOIN listed l ON k.canonical = l.canonical
"""


ORACLE_SQL = _oracle()
