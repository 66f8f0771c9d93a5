"""SimHash near-duplicates, found by decoding fingerprint segments with the perfect Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits agree
in one whole segment, and in a second one up to one bit; over the three ordered pairs (1,2), (2,3), (3,1) at least one
pair has its first segment untouched and at most one error in its second. The first segment is taken as it is; the
second is decoded to the codewords of the [23,12,7] Golay code within distance four: one, or six if the nearest codeword
is three bits away. Vectors one bit apart always share one of these codewords, so every link meets under some key.
Candidates are then verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .components import components

#: (first bit, bits) of each segment, lowest bits first.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Segments that are compared as they are, each with the one that is decoded.
PAIRS = ((0, 1), (1, 2), (2, 0))
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
#: Keys with more distinct fingerprints than this meet by midpoints, not pair by pair.
WIDE = 48
BLOCK = 1 << 16


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of up to three bits; six offsets of codeword indices, and how many of them count.
    By 12 message bits: the 11 check bits."""
    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    check = np.array([remainder(m << 11) for m in range(4096)], np.uint32)
    seven = [c for c in ((m << 11) | int(check[m]) for m in range(4096)) if c.bit_count() == 7]
    error = np.zeros(2048, np.uint32)
    offsets, count = np.zeros((2048, 6), np.uint32), np.ones(2048, np.int64)
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    for p in patterns:
        s = (p & 0x7FF) ^ int(check[p >> 11])
        error[s] = p
        if p.bit_count() == 3:
            around = [c >> 11 for c in seven if c & p == p]
            offsets[s, 1:], count[s] = around, 6
    return error, offsets, count, check


def golay_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within distance four of each 23-bit vector: (row numbers, indices)."""
    error, offsets, count, check = golay_tables()
    s = (v & 0x7FF) ^ check[v >> 11]
    index = ((v ^ error[s]) >> 11)[:, None] ^ offsets[s]
    use = np.arange(6) < count[s][:, None]
    return np.nonzero(use)[0], index[use]


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles, repeats included; null and blank texts: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    if len(words) < 3:
        shingles, n, ends = b" ".join(words), 1, None
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        n = len(words) - 2
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        if ends is None:
            hashes = [h(shingles, 42)]
        else:
            stop = min(n, at + BLOCK)
            begins = [0, *(ends[:stop - 1] + 1).tolist()][at:] if at == 0 else (ends[at - 1:stop - 1] + 1).tolist()
            hashes = [h(joined[a:b], 42) for a, b in zip(begins, ends[at + 2:stop + 2].tolist(), strict=True)]
        part = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        for i in range(0, len(part), 128):  # sums of at most 128 ones fit a byte
            ones += np.unpackbits(part[i:i + 128], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    value = int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"].array, "fp": np.array([fingerprint(t) for t in b["text"]], np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``."""
    return scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scratch.tidy(_fingerprints), "doc_id bigint, fp bigint")


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        v, head = b["fp"].to_numpy(np.int64), b["head"].to_numpy(np.int64)
        parts = [((v.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
        for k, (same, fuzzy) in enumerate(PAIRS):
            row, index = golay_keys(parts[fuzzy])
            key = (np.int64(k) << 34) | (parts[same][row].astype(np.int64) << 12) | index.astype(np.int64)
            yield pd.DataFrame({"key": key, "fp": v[row], "head": head[row]})


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the heads of fingerprints at most two bits apart; enough of them to connect all such.

    ``nodes`` (fp, head): distinct fingerprints. Under a key of up to ``WIDE`` fingerprints all pairs are compared. Wider
    keys would give pairs in the square of a group's size: there, each fingerprint visits the 65 values within one bit of
    it, and those that meet at a value, never more than 65 and all within two bits of each other, link to the lowest.
    """
    keyed = scratch.table(nodes.mapInPandas(scratch.tidy(_keys), "key bigint, fp bigint, head bigint"))
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.table(keyed.join(size.repartition(scratch.parts(keyed.sparkSession)), "key"))
    few = met.where(F.col("n") <= WIDE).select("key", "fp", "head")
    a, b = few.toDF("key", "fa", "a"), few.toDF("key", "fb", "b")
    pairs = a.join(b, "key").where("fa < fb and bit_count(fa ^ fb) <= 2").select("a", "b")
    masks = [0, *(1 << i for i in range(63)), -(1 << 63)]
    wide = met.where(F.col("n") > WIDE).select("fp", "head").distinct()
    near = wide.select("head", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m).cast("bigint")) for m in masks))).alias("w"))
    balls = near.groupBy("w").agg(F.collect_set("head").alias("heads")).where(F.size("heads") > 1)
    stars = balls.select(F.explode("heads").alias("a"), F.array_min("heads").alias("b"))
    return pairs.union(stars.where("a <> b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text; further columns are ignored).

    Links are found by Golay keys; only fingerprints under a key that more than ``WIDE`` of them share, as a great group of
    near copies has, meet at the values one bit from each instead, which finds the same links without pairing the group
    off. Texts of any length are hashed whole. Returns (doc_id, fingerprint, component_id): 16 lowercase hex digits, and the lowest doc_id reachable over links of
    two or fewer differing bits. Null, empty and blank texts have fingerprint zero and link like any other. doc_id is
    taken to be unique; rows that repeat it each get their own fingerprint and its component. A row whose doc_id is null
    has a fingerprint and the component null, and links nothing. An empty table gives an empty table.
    """
    fps = scratch.table(fingerprints(docs))
    nodes = scratch.table(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("head")))
    roots = components(links(nodes))
    named = nodes.join(roots, nodes["head"] == roots["node"], "left").select(F.col("fp").alias("f"), F.coalesce("root", "head").alias("component"))
    out = fps.join(named, F.col("fp") == F.col("f"), "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that head their component, and those without doc_id; all columns, whatever their names.

    Null and blank texts are copies of each other; repeated rows of a head all stay; an empty table stays empty.
    """
    heads = scratch.table(near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct())
    return docs.join(heads, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)
