"""Document fingerprints: the k lowest distinct hashes of a text's word shingles.

Sketches are sorted arrays of signed 64-bit hashes. They merge by union, so a text's parts can be sketched apart; two of
them estimate resemblance, containment and the number of distinct shingles. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .split import about

WORDS, K = 5, 256
#: Documents in a block of neighbours, about, at least; blocks at most, so that their table is small enough to broadcast;
#: ids from a sample of which blocks are bounded, for each block.
BLOCK, BLOCKS, SAMPLE = 64, 1 << 15, 16
SPAN = 2.0 ** 64


def words(text: Column) -> Column:
    """Hashes of the lower-case (A-Z) words between blanks; none for null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(F.coalesce(low, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch(w: Column, k: int = K, n: int = WORDS) -> Column:
    """Bottom-k sketch of an array of word hashes; fewer than ``n`` words are one shingle, none give an empty sketch.

    ``w`` should be a column of a table, not an expression, which would be evaluated for every use. Shifted copies of it
    are zipped, so the work is linear in the words.
    """
    count = F.size(w) - n + 1
    parts = F.slice(w, F.lit(1), F.greatest(count, F.lit(0)))
    for j in range(1, n):
        parts = F.zip_with(parts, F.slice(w, F.lit(j + 1), F.greatest(count, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    parts = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(count < 1, F.array(F.xxhash64(w))).otherwise(parts)
    return F.slice(F.sort_array(F.array_distinct(parts)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard likeness: the share of the union's k lowest hashes that both have. Two empty sketches are alike."""
    low = merge(a, b, k)
    return F.when(F.size(low) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), low)) / F.size(low))


def distinct(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below ``k``, else (k - 1) over the share of the hash range that the sketch reaches."""
    reach = (F.get(a, F.lit(k - 1)).cast("double") + F.lit(SPAN / 2)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the shingles of ``a`` that ``b`` has; an empty ``a`` is contained."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct(a, k) + distinct(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct(a, k)))


def text_of(a: Column) -> Column:
    """The sketch as text: 16 lowercase hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _block(bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` doc_id has reached: a search by halving steps."""
    if not bounds:
        return F.lit(0)
    top = 1 << (len(bounds) - 1).bit_length()
    steps = F.array(*(F.lit(max(1, top >> i)) for i in range(top.bit_length())))
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))


def _bounds(ids: DataFrame) -> list[int]:
    """Ids that cut ``ids`` (doc_id) into blocks of about equally many documents.

    They are quantiles of a sample of at most about ``SAMPLE`` distinct ids a block, chosen by hash. Any bounds give the
    same result, so the sample only sets how even the work is.
    """
    n = ids.count()
    blocks = min(BLOCKS, n // BLOCK)
    if blocks < 2:
        return []
    sample = sorted(r["doc_id"] for r in about(ids, SAMPLE * blocks, n, F.col("doc_id")).distinct().collect())
    return sorted({sample[len(sample) * i // blocks] for i in range(1, blocks)}) if sample else []


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): next is the text of the following doc_id; after the last, of the first. Rows without a
    doc_id have none; of rows that repeat one, each is followed by the next row by text.

    Ids fall in blocks of about equally many documents, so texts move once, to their block, however the ids are spread.
    The first document of each block is also sent to the block before, over a table of at most ``BLOCKS`` rows, whose size
    is what lets it be broadcast.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block = _block(_bounds(d.select("doc_id").where("doc_id is not null"))).cast("bigint")
    heads = d.where("doc_id is not null").groupBy(block.alias("block")).agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("block")
    whole = Window.partitionBy(F.lit(0))
    before = heads.select("head", F.coalesce(F.lag("block").over(order), F.max("block").over(whole)).alias("before"))
    placed = d.where("doc_id is not null").withColumn("block", block)
    tails = placed.join(F.broadcast(before), F.col("doc_id") == F.col("head")).select("doc_id", "text", F.col("before").alias("block"), F.lit(1).alias("tail"))
    w = Window.partitionBy("block").orderBy("tail", "doc_id", "text")
    rows = placed.select("doc_id", "text", "block", F.lit(0).alias("tail")).union(tails)
    followed = rows.select("doc_id", "text", "tail", F.lead("text").over(w).alias("next")).where("tail = 0").select("doc_id", "text", "next")
    return followed.union(d.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("string").alias("next")))


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text; further columns are ignored) and of an edited text.

    The edited text has its last quarter replaced by the beginning of the next document. Null and empty texts have an
    empty fingerprint; texts of any length are sketched whole. A null doc_id has no next document: its edited text ends where the quarter is cut, and near_next
    is null. An empty table gives an empty table.
    """
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    q = F.floor(F.col("n_chars") / 4).cast("int")
    d = d.withColumn("new", F.concat(F.substring("text", F.lit(1), F.length("text") - q), F.substring(F.coalesce("next", F.lit("")), F.lit(1), q)))
    d = d.select("doc_id", "n_chars", F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"), F.col("next").isNull().alias("alone"), words(F.col("text")).alias("w"), words(F.col("new")).alias("v"), words(F.col("next")).alias("u"))
    d = d.select("doc_id", "n_chars", "edited_sha256", "alone", sketch(F.col("w"), k).alias("a"), sketch(F.col("v"), k).alias("b"), sketch(F.col("u"), k).alias("c"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("a")).alias("fingerprint"), text_of(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), F.when(~F.col("alone"), resemblance(F.col("a"), F.col("c"), k)).alias("near_next"), distinct(F.col("a"), k).alias("n_distinct"),
    )
