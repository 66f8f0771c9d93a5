"""Near copies by exact resemblance: five-word shingle sets whose Jaccard likeness is at least 0.8.

Candidates come from two searches. The SimHash operator's Golay keys find the sets whose fingerprints differ in two bits
or fewer, which is most of the closest copies. A fingerprint of 64 bits cannot find the rest: sets of likeness 0.8 differ
in some ten bits, where keys tell nothing apart any more. So prefixes complete the search. Two sets that are so alike share
at least 4/5 of the larger one. Under any fixed order of all shingles, each set's first n - ceil(4n/5) + 1 shingles, its
prefix, then has one in common with the other's prefix: no pair is missed. Shingles that are frequent in a sample come
last in the order, so that common passages rarely are in a prefix; the sample changes what the search costs, never what it
finds. Filters that lose no alike pair, on sizes, on the places of what is shared and on parities, thin out the candidates;
the rest are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import scratch, simhash
from .components import components
from .split import about

WORDS = 5
#: Shared shingles of alike texts, as a share of the union: 4 of 5.
PART, WHOLE = 4, 5
#: The order is learned from about so many texts; shingles found in fewer of them than FREQUENT count as rare.
SAMPLE, FREQUENT = 8000, 4
#: All pairs of a key are compared once they are no more than so many a member on the whole; before that its members are
#: compared with one of them, at most so often.
EASY, STARS = 4, 2
#: Least bits of a set's parities, a power of 2 (larger sets have two to four a shingle): bit i tells if an odd number of
#: its shingles fall in class i.
BITS = 1024
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words are one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64).view(np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    x = w[:n].copy()
    for j in range(1, WORDS):
        x ^= x >> np.uint64(31)
        x *= MULTIPLIER
        x += w[j:j + n]
    return np.unique((x ^ (x >> np.uint64(32))).view(np.int64))


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of the sorted set ``s`` of which every set alike has one in its own prefix."""
    if not len(s):
        return s
    at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
    often = np.where(common[at] == s, counts[at], 0) if len(common) else np.zeros(len(s), np.int64)
    return s[np.lexsort((s, often))[:len(s) - -(-PART * len(s) // WHOLE) + 1]]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def parities(s: np.ndarray) -> bytes:
    bits = max(BITS, 1 << (2 * len(s)).bit_length())
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ; the longer is folded to the length of the shorter."""
    bits = 8 * min(len(x), len(y))
    v = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
    n = 8 * max(len(x), len(y))
    if n > bits:
        v, long = int.from_bytes(y if len(x) > len(y) else x, "little"), int.from_bytes(x if len(x) > len(y) else y, "little")
        while n > bits:
            n //= 2
            long = (long >> n) ^ (long & ((1 << n) - 1))
        v ^= long
    return v.bit_count()


def simprint(s: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingle hashes: bits that are set in more than half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), simhash.BLOCK):
        ones += np.unpackbits(s[at:at + simhash.BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view(np.int64)[0])


def _names(found: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return scratch.lean(docs).where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in at least ``FREQUENT`` of about ``SAMPLE`` texts, sorted, and in how many."""
    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.int64), *map(shingles, b["text"])])})

    found = about(texts, SAMPLE, texts.count(), F.col("doc_id")).select("text").mapInPandas(scratch.tidy(hashes), "h bigint").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).toPandas().sort_values("h")
    return found["h"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def sets(texts: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(doc_id, fp, sim, n, prefix, bits) for every row of ``texts``: fp is a hash of the whole set, sim its SimHash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "fp": _names(found), "sim": np.array([simprint(s) for s in found], np.int64), "n": np.array([len(s) for s in found], np.int32), "prefix": [prefix(s, common, counts) for s in found], "bits": [parities(s) for s in found]})

    return texts.mapInPandas(scratch.tidy(run), "doc_id bigint, fp bigint, sim bigint, n int, prefix array<bigint>, bits binary")


def whole(texts: DataFrame) -> DataFrame:
    """(fp, hashes): the distinct sets of ``texts``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"fp": _names(found), "hashes": [s.tobytes() for s in found]})

    return texts.select("text").mapInPandas(scratch.tidy(run), "fp bigint, hashes binary").groupBy("fp").agg(F.first("hashes").alias("hashes"))


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their parities allow: each bit that differs is a shingle that only one of them has, and alike
    sets have no more than (|a| + |b|) / 9 of those."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            differ = np.array([apart(x, y) for x, y in zip(b["x"], b["y"], strict=True)], np.int64)
            yield b.loc[(WHOLE + PART) * differ <= (WHOLE - PART) * b["n"].to_numpy(np.int64), ["a", "b"]]

    side = nodes.select("fp", "n", "bits")
    joined = pairs.join(side.toDF("a", "n", "x"), "a").join(side.toDF("b", "m", "y"), "b").select("a", "b", F.expr("cast(n as bigint) + m").alias("n"), "x", "y")
    return joined.mapInPandas(scratch.tidy(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = np.array([alike(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(b["x"], b["y"], strict=True)], bool)
            yield b.loc[good, ["a", "b"]]

    pairs = scratch.table(_possible(pairs, nodes))
    used = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    members = scratch.table(nodes.select("fp", "head").join(used, "fp", "left_semi").select(F.col("head").alias("doc_id")))
    found = scratch.table(whole(texts.join(members, "doc_id", "left_semi")))
    joined = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b")
    out = scratch.table(joined.select("a", "b", "x", "y").mapInPandas(scratch.tidy(run), "a bigint, b bigint"))
    scratch.drop(out.sparkSession, found)
    return out


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are at most two bits apart, enough to connect all such: the SimHash
    operator's links between distinct fingerprints, and those of a fingerprint's sets to the lowest of them."""
    sims = scratch.table(nodes.groupBy("sim").agg(F.min("fp").alias("head")))
    same = nodes.select("sim", "fp").join(sims, "sim").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    return same.union(simhash.links(sims.select(F.col("sim").alias("fp"), "head")))


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between alike sets; enough of them to connect all such.

    ``nodes`` (fp, head, sim, n, prefix, bits): distinct sets and a doc_id of each in ``texts``. First come the pairs of
    the SimHash search. Then the members of a prefix's key that are still apart are compared with one of them, again and
    again with another one, until few pairs are left: those are all compared. So a large group of copies is not paired off.
    """
    spread = scratch.parts(nodes.sparkSession)
    # Sizes allow a pair to be alike; and so do the places of the key, if it is the first shingle that both have: all that
    # they share then stands there or after it, in the one order of all sets. A later shared key need not find the pair.
    close = f"{WHOLE} * least(n, m) >= {PART} * greatest(n, m) and {WHOLE + PART} * least(n - pos, m - at) >= {PART} * (n + m)"

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs.select(F.least("fp", "q").alias("a"), F.greatest("fp", "q").alias("b")).distinct(), nodes, texts)

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(stars.toDF("fp", "r"), "fp", "left").withColumn("root", F.coalesce("r", "fp")).drop("r")

    def still_apart(rows: DataFrame) -> DataFrame:
        """The rows of keys whose members are not all in one group, but those whose place in their own set is too late for
        even the smallest member."""
        split = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("key", "least").repartition(spread)
        return scratch.table(rows.join(split, "key").where(f"{WHOLE + PART} * (n - pos) >= {PART} * (n + least)").drop("least"))

    # Found so far, each member with its group's root: a start from which the components are found in few rounds.
    stars = components(verified(fingerprint_pairs(nodes).toDF("fp", "q")))
    grouped = scratch.table(rooted(nodes.select("fp", "n", "prefix")))
    met = still_apart(grouped.select(F.posexplode("prefix").alias("pos", "key"), "fp", "n", "root"))
    for k in range(STARS):
        members = met.groupBy("key").agg(F.count("*").cast("decimal(20,0)").alias("c")).agg(F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()
        if not members[0] or members[1] <= EASY * members[0]:
            break
        # Rare shingles stand first, so the member that has the key earliest has the fewest of its own: of copies that were
        # each changed elsewhere it is the one that they were made from, or next to it. Then any member, by hash.
        first = F.col("pos") if k == 0 else F.lit(0)
        pick = F.min_by(F.struct("fp", "n", "root", "pos"), F.struct(first, F.xxhash64("fp", F.lit(k))))
        centre = met.groupBy("key").agg(pick.alias("p")).select("key", F.col("p.fp").alias("q"), F.col("p.n").alias("m"), F.col("p.root").alias("other"), F.col("p.pos").alias("at")).repartition(spread)
        stars = components(stars.union(verified(met.join(centre, "key").where(f"root <> other and {close}"))))
        named = scratch.table(rooted(met.drop("root")))
        met = still_apart(named)
        scratch.drop(nodes.sparkSession, named)
    each = met.join(met.select("key", F.col("fp").alias("q"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("pos").alias("at")), "key").where(f"fp < q and root <> other and {close}")
    return stars.union(verified(each))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the lowest doc_id of their group of near copies, and those without doc_id; all columns.

    Groups are connected over links of Jaccard 0.8 or more. Null and blank texts are copies of each other. Texts of any
    length are compared whole. doc_id is taken to be unique; rows that repeat the one that stays all stay. Columns may have
    any names. An empty table stays empty.
    """
    texts = _texts(docs)
    each = scratch.table(sets(texts, *frequent(texts)))
    nodes = scratch.table(each.groupBy("fp").agg(F.min("doc_id").alias("head"), F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))
    scratch.drop(nodes.sparkSession, each)
    roots = components(links(nodes, texts))
    named = nodes.select("fp", "head").join(roots, nodes["fp"] == roots["node"], "left")
    heads = scratch.table(named.groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("head").alias("doc_id")).select("doc_id").distinct())
    return docs.join(heads, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)
