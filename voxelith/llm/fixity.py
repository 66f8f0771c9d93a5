"""Merkle fixity audit: hash trees over ordered records of two replicas, compared from the root down.

A record's place in the tree is its id, so a lost record leaves a hole rather than shifting all that follow. A file
holds a fixed range of ids. Where replicas state at which offset each record lies, that range of bytes is hashed into the
record's leaf, so an index that points elsewhere is found as well. A node covers ``FANOUT`` places of the level below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch

FANOUT, FILE = 16, 4096


def digest(records: DataFrame) -> DataFrame:
    """(id, body, length, and offset if stated) of ``records`` (id, payload): payloads are hashed where they are read.

    A null payload has a hash of its own, which no bytes have. Records that are digested already stay as they are.
    """
    if "payload" not in records.columns:
        return records
    data = F.col("payload").cast("binary")
    offset = [F.col("offset").cast("bigint").alias("offset")] if "offset" in records.columns else []
    return records.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.sha2(data, 256), F.lit("null")).alias("body"), F.coalesce(F.length(data), F.lit(0)).cast("bigint").alias("length"), *offset)


def laid_out(records: DataFrame, length: str = "length") -> DataFrame:
    """Digested ``records`` with the offset at which each lies, if a file's records follow each other by id."""
    within = Window.partitionBy(F.floor(F.col("id") / FILE)).orderBy("id", "body").rowsBetween(Window.unboundedPreceding, -1)
    return records.select("*", F.when(F.col("id").isNotNull(), F.coalesce(F.sum(length).over(within), F.lit(0))).alias("offset"))


def leaves(records: DataFrame) -> DataFrame:
    """(place, hash, body, file, offset, length): one leaf for each id of digested ``records``.

    ``body`` is the hash of the payload, ``hash`` that of the payload and the range of bytes. Rows that repeat an id share
    a leaf, a hash of how many they are and of sums over their hashes, so that no task ever holds them together.
    """
    at = F.col("offset").cast("bigint") if "offset" in records.columns else F.lit(None).cast("bigint")
    one = records.where("id is not null").select(F.col("id").cast("bigint").alias("place"), F.col("body").alias("x"), F.col("length").alias("n"), at.alias("at"))
    one = one.withColumn("y", F.when(F.col("at").isNull(), F.col("x")).otherwise(F.sha2(F.concat_ws("+", F.concat_ws("@", "x", "at"), "n").cast("binary"), 256)))

    def heap(c: str) -> Column:
        parts = [F.sum(F.conv(F.substring(F.sha2(F.col(c), 256), i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in (1, 16, 31, 46)]
        return F.when(F.count("*") == 1, F.max(c)).otherwise(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts).cast("binary"), 256))

    each = one.groupBy("place").agg(heap("y").alias("hash"), heap("x").alias("body"), F.min("at").alias("offset"), F.sum("n").alias("length"))
    return each.select("place", "hash", "body", F.floor(F.col("place") / FILE).cast("bigint").alias("file"), "offset", "length")


def parents(level: DataFrame) -> DataFrame:
    """Hash of the places and hashes of up to ``FANOUT`` children, in order."""
    kids = F.sort_array(F.collect_list(F.struct("place", "hash")))
    up = level.groupBy(F.floor(F.col("place") / FANOUT).cast("bigint").alias("place")).agg(kids.alias("kids"))
    return up.select("place", F.sha2(F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["place"].cast("string"), k["hash"])), ",").cast("binary"), 256).alias("hash"))


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """Level tables, leaves first, each written once in the shared folder."""
    levels = [scratch.table(leaves(records))]
    for _ in range(height):
        levels.append(scratch.table(parents(levels[-1])))
    return levels


def height(*replicas: DataFrame) -> int:
    """Levels above the leaves until all places fall in one node (two, if there are negative ids)."""
    ends = [x for r in replicas for x in r.agg(F.min("id"), F.max("id")).first() if x is not None]
    low, high, up = min(ends, default=0), max(ends, default=0), 0
    while low // FANOUT ** up != high // FANOUT ** up and (low // FANOUT ** up, high // FANOUT ** up) != (-1, 0):
        up += 1
    return up


def _nameless(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records without an id have no place in a tree: their payloads are counted by hash, and counts compared."""
    l, r = (t.where("id is null").select(F.col("body").alias("x"), "length").groupBy("x", "length").agg(F.count("*").alias(c)) for t, c in ((left, "l"), (right, "r")))
    both = l.join(r, ["x", "length"], "full").select("x", "length", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r")).where("l <> r")
    none = F.lit(None).cast("bigint")
    lost = F.col("l") > F.col("r")
    return both.select(none.alias("record_id"), F.when(lost, "missing").otherwise("extra").alias("problem"), none.alias("file"), none.alias("offset"), "length", F.when(lost, F.col("x")).alias("left_hash"), F.when(~lost, F.col("x")).alias("right_hash"))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two replicas (id, payload, and optionally the offset that is stated for each record) differ.

    Payloads are hashed where they are read; what is shuffled, by id, are hashes and lengths.

    Returns a row for each differing record: record_id, problem (``changed``; ``moved``, if only the range of bytes
    differs; ``missing`` or ``extra`` in ``right``), file, offset and length in ``left`` (in ``right`` if extra), and the
    hashes of both payloads. Levels are compared from the top; below it only the children of differing nodes are, and
    nothing is below equal roots. A null payload differs from an empty one. Rows that repeat an id are one record, whatever
    their order. Records with a null id are compared by payload, a row for each hash whose count differs. Payloads of any
    length are hashed whole; further columns are ignored. Equal replicas, and empty ones, give an empty table.
    """
    left, right = scratch.table(digest(left)), scratch.table(digest(right))
    up = height(left, right)
    a, b = tree(left, up), tree(right, up)
    open_nodes: DataFrame | None = None
    for x, y in zip(reversed(a[1:]), reversed(b[1:]), strict=True):
        open_nodes = scratch.table(_differing(x, y, open_nodes).select("place"))
        if open_nodes.isEmpty():
            break
    found = _differing(a[0], b[0], open_nodes)
    gone, new = F.col("right_hash").isNull(), F.col("left_hash").isNull()
    problem = F.when(gone, "missing").when(new, "extra").when(F.col("left_body") != F.col("right_body"), "changed").otherwise("moved")
    placed = found.select(F.col("place").alias("record_id"), problem.alias("problem"), "file", "offset", "length", F.col("left_body").alias("left_hash"), F.col("right_body").alias("right_hash"))
    return placed.unionByName(_nameless(left, right))


def _differing(x: DataFrame, y: DataFrame, above: DataFrame | None) -> DataFrame:
    """Places whose hashes differ, among the children of ``above``."""
    def under(t: DataFrame) -> DataFrame:
        if above is None:
            return t
        return t.withColumn("up", F.floor(F.col("place") / FANOUT).cast("bigint")).join(above.select(F.col("place").alias("up")), "up", "left_semi").drop("up")

    def sided(t: DataFrame, side: str) -> DataFrame:
        return reduce(lambda d, c: d.withColumnRenamed(c, f"{side}_{c}"), (c for c in x.columns if c != "place"), under(t))

    both = sided(x, "left").join(sided(y, "right"), "place", "full").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
    shared = [c for c in x.columns if c not in ("place", "hash", "body")]
    return both.select("place", *(f"{s}_{c}" for c in ("hash", "body") if c in x.columns for s in ("left", "right")), *(F.when(F.col("left_hash").isNotNull(), F.col(f"left_{c}")).otherwise(F.col(f"right_{c}")).alias(c) for c in shared))


def _page(url: Column, html: Column) -> Column:
    """A page's record: its url, after how many bytes that is, and its html; nulls are empty."""
    return F.concat(F.octet_length(url).cast("string"), F.lit(":"), url, html)


def _fields() -> tuple[Column, Column]:
    return F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))


def replica(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html; further columns are ignored) as digested records with their offsets.

    Null urls and html are empty; pages without an id have no offset; repeated pages follow each other.
    """
    return laid_out(digest(pages.select(F.col("page_id").alias("id"), _page(*_fields()).alias("payload"))))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of ``pages``, with faults planted by id: changed first bytes of the html, changed urls, lost and
    added records, and records that the index puts one byte too far. An html whose first byte is changed where there is
    none gets that byte. Treats nulls, repeats and empty tables as ``replica``."""
    url, html = _fields()
    i = F.col("page_id")
    spoiled = _page(F.when(i % 89 == 5, F.concat(url, F.lit("#"))).otherwise(url), F.when(i % 97 == 13, F.concat(F.lit("~"), F.substring(html, 2, 2147483647))).otherwise(html))
    both = digest(pages.select(i.alias("id"), spoiled.alias("payload"), F.octet_length(_page(url, html)).alias("offset"))).withColumnRenamed("offset", "before")
    sound = laid_out(both, "before").where("id is null or id % 211 <> 7")
    kept = sound.select("id", "body", "length", F.when(F.col("id") % 101 == 11, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset"))
    new = digest(pages.where("page_id % 307 = 3").select((-1 - F.col("page_id")).alias("id"), F.concat(F.lit("added "), url).alias("payload"), F.lit(0).alias("offset")))
    return kept.unionByName(new)


#: The faults that ``damaged`` plants, compared record by record.
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, CASE WHEN page_id % 89 = 5 THEN coalesce(url, '') || '#' ELSE coalesce(url, '') END AS v,
    CASE WHEN page_id % 97 = 13 THEN '~' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS g, page_id % 211 = 7 AS lost, page_id % 101 = 11 AS moved, CAST(floor(page_id / {FILE}.0) AS BIGINT) AS file FROM pages),
b AS (SELECT *, octet_length(encode(u)) || ':' || u || h AS l, octet_length(encode(v)) || ':' || v || g AS r FROM p),
o AS (
  SELECT *, CAST(octet_length(encode(l)) AS BIGINT) AS length, CAST(coalesce(sum(octet_length(encode(l))) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM b)
SELECT page_id AS record_id, CASE WHEN lost THEN 'missing' WHEN l <> r THEN 'changed' ELSE 'moved' END AS problem, file, "offset", length, sha256(l) AS left_hash, CASE WHEN NOT lost THEN sha256(r) END AS right_hash
FROM o WHERE lost OR moved OR l <> r
UNION ALL
SELECT -1 - page_id, 'extra', CAST(floor((-1 - page_id) / {FILE}.0) AS BIGINT), 0, CAST(octet_length(encode('added ' || u)) AS BIGINT), NULL, sha256('added ' || u) FROM p WHERE page_id % 307 = 3
"""
