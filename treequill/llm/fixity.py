"""WARC fixity audits by Merkle trees.

Pages become WARC records at ordered offsets of files. A replica's tree has a
leaf for each record and a node for each range of ``FANOUT`` neighbours, so a
node stands for an offset range; above the files' roots another such tree leads
to the archive's root. An audit compares two roots and goes down only where
nodes differ: each level reads the children of the nodes that differed above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treequill.llm.common import cut, table

#: Children of a node, and records of a file (on average).
FANOUT = 16
RECORDS = 256


def record(url: Column, body: Column, page_id: Column) -> Column:
    """The bytes of a WARC response record; null parts are empty."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """(page_id, warc_file, url, bytes, length) of the record of each row of ``pages`` (page_id, url, html; others are ignored).

    Files are dealt by the hash of page_id and hold ``per_file`` records on average;
    a row with a null page_id is dealt by the hash of its url and html. Pages of any
    length are one record each, whole.
    """
    files = max(1, -(-pages.count() // per_file))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.xxhash64("url", "html").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = pages.select("page_id", (number % files).alias("warc_file"), F.coalesce("url", F.lit("")).alias("url"), record(F.col("url"), F.col("html"), F.col("page_id")).alias("bytes"))
    return rows.withColumn("length", F.octet_length("bytes").cast("long"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of ``records`` with record_no and offset: a file's records stand in order of page_id, url, length and digest.

    Only the columns of ``rows`` are exchanged, so rows that carry digests (see ``digested``) move no page.
    """
    inside = Window.partitionBy("warc_file").orderBy("page_id", "url", "length", "sha256")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    places = {"record_no": (F.row_number().over(inside) - 1).cast("long"), "offset": F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")}
    return rows.withColumns(places).drop("url")


def digested(rows: DataFrame) -> DataFrame:
    """Rows with ``sha256`` in place of ``bytes``."""
    return rows.withColumn("sha256", F.sha2("bytes", 256)).drop("bytes")


def archive(pages: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """(page_id, warc_file, bytes, length, sha256, record_no, offset) of each page's record in the archive's files."""
    return placed(records(pages, per_file).withColumn("sha256", F.sha2("bytes", 256)))


def leaves(replica: DataFrame) -> DataFrame:
    """(grp, idx, hash) of a replica's records (warc_file, record_no, offset, length, sha256): the hash covers place and bytes."""
    place = F.concat_ws(":", "offset", "length", "sha256")
    return replica.select(F.col("warc_file").alias("grp"), F.col("record_no").alias("idx"), F.sha2(place.cast("binary"), 256).alias("hash"))


def above(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: a node for each ``fanout`` neighbours of a group, at most that many rows each."""
    parent = F.floor(F.col("idx") / fanout).cast("long")
    kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: F.concat_ws(":", x["idx"], x["hash"])), ",")
    return level.groupBy("grp", parent.alias("idx")).agg(F.sha2(kids.cast("binary"), 256).alias("hash"))


def tree(bottom: DataFrame, records: int, files: int, fanout: int = FANOUT) -> tuple[list[DataFrame], int]:
    """All levels (grp, idx, hash) from the records to the root, for at most ``records`` records in each of ``files`` files.

    Each level is written once; those above the records are a fanout smaller each.
    The second result is the level that holds the files' roots again, as the leaves of the archive's tree.
    """
    levels, width = [bottom], records
    while width > 1:
        levels.append(cut(above(levels[-1], fanout)))
        width = -(-width // fanout)
    joint = len(levels)
    levels.append(levels[-1].select(F.lit(-1).cast("long").alias("grp"), F.col("grp").alias("idx"), "hash"))
    width = files
    while width > 1:
        levels.append(cut(above(levels[-1], fanout)))
        width = -(-width // fanout)
    return levels, joint


def differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """(grp, idx) of nodes that differ or that only one side has."""
    other = two.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), F.col("hash").alias("_h"))
    met = one.join(other, (F.col("grp") == F.col("_g")) & (F.col("idx") == F.col("_i")), "full")
    return met.where(~F.col("hash").eqNullSafe(F.col("_h"))).select(F.coalesce("grp", "_g").alias("grp"), F.coalesce("idx", "_i").alias("idx"))


def audit(one: DataFrame, two: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(warc_file, record_no) of the records in which two replicas differ; each replica as for ``leaves``.

    Equal roots end the audit. Empty replicas are equal; a replica without any
    records differs from the other in all of them.
    """
    bottoms = [cut(leaves(x)) for x in (one, two)]
    spans = [x.agg(F.max("idx"), F.max("grp")).first() for x in bottoms]
    records, files = (1 + max((s[i] if s[i] is not None else -1) for s in spans) for i in (0, 1))
    (first, joint), (second, _) = (tree(x, max(1, records), max(1, files), fanout) for x in bottoms)
    bad = cut(differing(first[-1], second[-1]))
    for i in range(len(first) - 2, -1, -1):
        if bad.isEmpty():
            break
        if i + 1 == joint:
            # A leaf of the archive's tree is the root of a file's tree: the same node under another name.
            bad = bad.select(F.col("idx").alias("grp"), F.lit(0).cast("long").alias("idx"))
            continue
        parents = bad.select(F.col("grp").alias("_pg"), F.col("idx").alias("_pi"))
        below = [x.join(parents, (F.col("grp") == F.col("_pg")) & (F.floor(F.col("idx") / fanout) == F.col("_pi")), "left_semi") for x in (first[i], second[i])]
        bad = cut(differing(*below))
    return bad.select(F.col("grp").alias("warc_file"), F.col("idx").alias("record_no"))


def damaged(content: Column, hit: Column) -> Column:
    """``content`` with one byte changed where ``hit`` holds: what a copy reads that has rotted."""
    at = F.floor(F.octet_length(content) / 2).cast("int") + 1
    byte = F.when(F.substring(content, at, F.lit(1)) == F.lit(bytearray(b"#")), F.lit(bytearray(b"*"))).otherwise(F.lit(bytearray(b"#")))
    return F.when(hit, F.overlay(content, byte, at, F.lit(1))).otherwise(content)


def report(original: DataFrame, copy: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(page_id, warc_file, record_no, offset, length, sha256, intact) of each record of ``original``: is it the same in ``copy``?

    Both have digests and places, as ``archive`` gives them. Repeated rows are records of their own. Empty archives give no rows.
    """
    bad = audit(original, copy, fanout).select(F.col("warc_file").alias("_f"), F.col("record_no").alias("_r"))
    rows = original.select("page_id", "warc_file", "record_no", "offset", "length", "sha256")
    met = rows.join(bad, (F.col("warc_file") == F.col("_f")) & (F.col("record_no") == F.col("_r")), "left")
    return met.withColumn("intact", F.col("_f").isNull()).drop("_f", "_r")


#: The registered query's rotten records: those whose md5 of page_id starts so.
ROT = "07"


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    # Both replicas are read where the pages are; only digests and lengths are dealt to files.
    rotten = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))).startswith(ROT)
    both = rows.withColumn("copy_sha256", F.sha2(damaged(F.col("bytes"), rotten), 256))
    original = cut(placed(digested(both)))
    return report(original.drop("copy_sha256"), original.withColumn("sha256", F.col("copy_sha256")).drop("copy_sha256"))


ORACLE_SQL = f"""
WITH files AS (SELECT greatest(1, ceil(count(*) / {RECORDS}.0)::BIGINT) AS files FROM pages),
made AS (SELECT page_id, ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % files AS warc_file, coalesce(url, '') AS u,
         encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
                || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS b FROM pages, files)
SELECT page_id, warc_file, row_number() OVER w - 1 AS record_no,
       coalesce(sum(octet_length(b)) OVER (PARTITION BY warc_file ORDER BY page_id, u, octet_length(b), sha256(b) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       octet_length(b)::BIGINT AS length, sha256(b) AS sha256, NOT starts_with(md5(page_id::VARCHAR), '{ROT}') AS intact
FROM made WINDOW w AS (PARTITION BY warc_file ORDER BY page_id, u, octet_length(b), sha256(b))
"""
