"""Removal of lines that spread over many sites, by HyperLogLog sketches and exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import scratch

#: Sites that a line must be on, and log2 of a sketch's registers.
MIN_SITES, LG_K = 3, 12
#: Sketches this close to the threshold, in sites or as a share of it, are not trusted.
NEAR, NEAR_SHARE = 1, 0.1
BLANK = " \t\r"


#: What stands for a line: two hashes of it, 96 bits, so that two lines hardly ever share them.
LINE = ["h", "g"]


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, site, pos, h, g) of each line with a sign in it: t tells rows of one doc_id apart, h and g stand for the
    trimmed line."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("site"), F.col("text").cast("string").alias("text"))
    each = d.select("doc_id", F.xxhash64("text").alias("t"), "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line", F.lit(BLANK))
    return each.where(F.length(line) > 0).select("doc_id", "t", "site", "pos", F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def spread(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g, first): lines on ``min_sites`` sites or more, and the lowest doc_id that has them.

    Sketches merge map-side and then by line. Lines whose estimate is clear of the threshold are settled; for the others
    the distinct sites are counted, over pairs of line and site that were made distinct before they meet a line's task.
    """
    band = max(NEAR, min_sites * NEAR_SHARE)
    sketched = found.groupBy(*LINE).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"), F.min("doc_id").alias("first"))
    guess = scratch.table(sketched.select(*LINE, "first", F.hll_sketch_estimate("s").alias("e")).where(F.col("e") >= min_sites - band))
    far = guess.where(F.col("e") > min_sites + band).select(*LINE, "first")
    near = guess.where(F.col("e") <= min_sites + band).select(*LINE, "first")
    pairs = found.where("site is not null").select(*LINE, "site").distinct()
    exact = pairs.join(near.hint("merge"), LINE).groupBy(*LINE).agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_sites).select(*LINE, "first")
    return far.union(exact)


def _marked(docs: DataFrame, min_sites: int) -> DataFrame:
    """The columns of ``docs`` but text as c0, c1 and so on, then text without spread lines, n_lines, n_removed.

    Lines meet the spread ones by a sort-merge join: what is spread grows with the data and is never broadcast, and rows
    of a line found everywhere are split over tasks by the adaptive join.
    """
    found = lines(docs)
    spread_lines = scratch.table(spread(found, min_sites)).where("first is not null")
    gone = found.select("doc_id", "t", "pos", *LINE).join(spread_lines.hint("merge"), LINE).where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first")))
    no_id = F.lit(-(1 << 63)).cast("bigint")
    per_doc = gone.groupBy(F.coalesce("doc_id", no_id).alias("_d"), F.col("t").alias("_t")).agg(F.collect_set("pos").alias("_gone"))
    own = [c for c in docs.columns if c != "text"]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), no_id).alias("_d"), F.xxhash64(F.col("text").cast("string")).alias("_t"))
    met = plain.join(per_doc, ["_d", "_t"], "left").withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda p: F.get("_lines", p)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    return met.select(*(f"c{i}" for i in range(len(own))), text.alias("text"), n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"))


def _named(docs: DataFrame, columns: list[str]) -> list:
    own = [c for c in docs.columns if c != "text"]
    return [F.col("text") if c == "text" else F.col(f"c{own.index(c)}").alias(c) for c in columns]


def dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with each widely spread line left in its lowest doc_id only.

    Lines are split at line feeds and compared without blanks at their ends; blank lines stay. A line is spread if it is
    on ``min_sites`` distinct sources or more; a null source is no site. The lowest doc_id keeps all its copies of the
    line; rows with a null doc_id keep none, unless no row with an id has the line, in which case all keep it. A null
    text stays null. Texts of any length are compared line by line, whole. Repeated rows are treated alike; an empty table
    gives an empty table. Returns the columns of ``docs`` with ``text`` replaced, ``n_lines`` and ``n_removed`` (taking
    the place of columns so named).
    """
    return _marked(docs, min_sites).select(*_named(docs, [c for c in docs.columns if c not in ("n_lines", "n_removed")]), "n_lines", "n_removed")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``dedup`` with the columns of ``docs`` alone, their own n_lines or n_removed untouched.

    n_chars follows the text, and texts that lost every line are dropped. Nulls, ties, repeated rows and empty tables: as
    in ``dedup``.
    """
    out = _marked(docs, min_sites).where("n_removed = 0 or trim(text) <> ''")
    columns = _named(docs, docs.columns)
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        own = F.col(f"c{[c for c in docs.columns if c != 'text'].index('n_chars')}")
        columns[at] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own).alias("n_chars")
    return out.select(*columns)


#: The result of ``dedup`` over documents, by exact counts throughout.
SQL = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS k, min(doc_id) AS first FROM l GROUP BY 1 HAVING k <> '' AND count(DISTINCT source) >= {MIN_SITES}),
m AS (
  SELECT l.doc_id, l.line, l.pos, s.first IS NOT NULL AND s.first <> l.doc_id AS gone FROM l LEFT JOIN s ON trim(l.line, ' ' || chr(9) || chr(13)) = s.k),
r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY 1)
SELECT d.doc_id, r.text, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed FROM documents d LEFT JOIN r USING (doc_id)
"""
