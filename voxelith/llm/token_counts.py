"""Token counts for every context limit, from an exact histogram of encoded lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch

#: Distinct lengths whose suffix sums are taken together.
BLOCK = 1024
# Fixed value: the pattern that splits text before the merges of the public 50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def encoding(path: str, pattern: str):
    """A byte-level BPE read from a rank file; one per worker process."""
    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return scratch.loaded(("bytes", path, pattern), make)


def lengths(docs: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every whole text, of any length; a null or empty text has no token.

    Repeated rows are counted each, a null doc_id stays null, an empty table gives an empty table, further columns are
    ignored.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary, pattern).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "n_tokens": np.array([len(encode(t)) if t else 0 for t in b["text"]], np.int64)})

    return scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scratch.tidy(count, ("bytes", vocabulary, pattern)), "doc_id bigint, n_tokens bigint")


def histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length; rows without a length don't count."""
    return counts.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length L in ``hist``, taken as a context limit.

    Returns n_tokens (L), n_docs, docs_at_least and tokens_at_least (documents of L tokens or more, and their tokens),
    truncated_total (all tokens if documents are cut at L), quantile (share of documents with at most L tokens). Sums run
    over blocks of ``BLOCK`` lengths first, so that no task holds all lengths. An empty table gives an empty table.
    """
    h = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    beyond = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("d", "t")), *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("d", "t")))
    w = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.select("*", F.sum("n_docs").over(w).alias("d"), F.sum("tokens").over(w).alias("t")).join(beyond, "block")
    docs, tokens = F.col("d") + F.col("d_after"), F.col("t") + F.col("t_after")
    return s.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("t_all") - tokens + docs * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("d_all") - docs + F.col("n_docs")) / F.col("d_all")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, n_docs, total, truncated_total, docs_cut) for any context limits, by one pass over the histogram."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    one = sums.agg(F.coalesce(F.sum(d), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(n * d), F.lit(0)).alias("total"), *(F.coalesce(F.sum(F.least(n, F.lit(c)) * d), F.lit(0)).alias(f"t{i}") for i, c in enumerate(limits)), *(F.coalesce(F.sum(F.when(n > c, d)), F.lit(0)).alias(f"d{i}") for i, c in enumerate(limits)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).cast("bigint").alias("context"), F.col(f"t{i}").alias("truncated_total"), F.col(f"d{i}").alias("docs_cut")) for i, c in enumerate(limits))))
    return one.select("n_docs", "total", rows.alias("x")).select("x.context", "n_docs", "total", "x.truncated_total", "x.docs_cut")


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share ``q`` of documents does not exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """Suffix sums over the lengths of all ``docs`` (doc_id, text; further columns are ignored).

    Null and empty texts have length 0, texts of any length count whole, repeated rows count each, an empty table gives an
    empty table.
    """
    return suffix_sums(scratch.table(histogram(lengths(docs, vocabulary, pattern))))
