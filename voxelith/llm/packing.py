"""Packing documents into sequences by minimum bin slack.

Only how many pieces there are of each length matters to the plan, and lengths are at most the capacity, so the plan is
made over a histogram whose size does not grow with the data. Each bin takes the longest piece left, and a bitset
dynamic program over the lengths left finds the fullest set of others that fits with it. That combination is taken off
the histogram as many times as it still fits: repeating it is what the search would do next, because the longest
piece and a fullest filling are still there. Pieces are then numbered within their length and look their place up.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch
from .known import Known

CAPACITY = 4096
END = 1
#: Pieces of one length that are numbered together.
SLICE = 50_000
# Fixed value: the pattern by which the public word vocabulary splits lower-cased text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of letters and signs on which Python and the tokenizer agree in letter case, composition and classes, and the
#: same pattern for them; of its matches, those that also are one pre-token when they stand between blanks.
LETTERS = "a-zß-öø-ÿ"
PLAIN = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*")
TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t-\r {LETTERS}0-9]+")
ALONE = re.compile(rf"[{LETTERS}]+|[!-/:-@[-`{{-~]+")
#: What the last piece of a pre-token ends in, pre-tokens that are encoded in one call, and texts that are looked up at once.
MARKER, TOGETHER, TEXTS = "</w>", 2000, 2000
#: Bytes of parts that a worker remembers in each of two generations.
ROOM = 24_000_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: A number that tells equal pieces apart, so that they can be dealt over slices.
SALT = ", salt int"


class WordEncoder:
    """Ids of whole texts from those of their parts, each encoded once by ``tokenizers``.

    Plain texts are lower-cased and cut into pre-tokens here. Other texts are cut at spaces and line feeds, which no
    pre-token crosses, and the rest is left to the tokenizer. The parts' ids, one after another, are the text's. Parts are
    remembered in bounded memory (``known.Known``); those of more than 64 letters are encoded for each batch anew. Texts
    with an added token's opening ``<|``, and all texts if the vocabulary splits by another pattern than ``PATTERN``, are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Known(ROOM)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(MARKER)]] = True
        with open(path, encoding="utf-8") as f:
            self.parted = json.dumps(PATTERN) in f.read()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that are one pre-token each: many are encoded as one text, and cut at the marked pieces."""
        found: dict[str, bytes] = {}
        for at in range(0, len(parts), TOGETHER):
            some = parts[at:at + TOGETHER]
            ids = self._whole([" ".join(some)])[0]
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) != len(some) or ends[-1] != 4 * len(ids):
                raise ValueError("a pre-token of this vocabulary does not end in one marked piece")
            raw = ids.tobytes()
            found.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=False))
        return found

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.parted:
            return self._whole(texts)
        cut = [[] if "<|" in t else TOKEN.findall(t.lower()) if PLAIN.fullmatch(t) else t.replace("\n", " ").split(" ") for t in texts]
        self.known.begin()
        new = self.known.missing(set().union(*cut))
        self.known.learn(self._together([p for p in new if ALONE.fullmatch(p)]))
        rest = [p for p in new if p not in self.known.young]
        self.known.learn({p: x.tobytes() for p, x in zip(rest, self._whole(rest), strict=True)})
        get = self.known.young.__getitem__
        out = [np.frombuffer(b"".join(map(get, parts)), "<u4") if "<|" not in t else self._whole([t])[0] for t, parts in zip(texts, cut, strict=True)]
        self.known.forget(new)
        return out


def encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary file."""
    return scratch.loaded(("words", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut each document's ids and the end id into pieces of up to ``capacity``; ``salt`` numbers a task's pieces.

    A document's ids are held at once, however long its text is; texts are taken ``TEXTS`` at a time.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, end, made = encoder(vocabulary), np.array([END], "<u4"), 0
        for b in batches:
            for at in range(0, len(b), TEXTS):
                part, rows = b.iloc[at:at + TEXTS], []
                for d, ids in zip(part["doc_id"], enc.ids(part["text"].fillna("").tolist()), strict=True):
                    ids = np.concatenate([ids, end])
                    rows += [(d, k, s, len(x := ids[s:s + capacity]), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["salt"] = np.arange(made, made + len(out)) % (1 << 31)
                made += len(out)
                yield out

    return scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scratch.tidy(cut, ("words", vocabulary)), PIECES + SALT)


def fullest(room: int, lengths: list[int], count: dict[int, int]) -> list[tuple[int, int]]:
    """The (length, copies) that fill ``room`` best; of equally full ones, one that uses longer pieces.

    ``lengths``: descending. The bits of an integer are the sums that can be reached. Each length adds its copies in
    powers of two; the search ends as soon as ``room`` itself can be reached.
    """
    reach, mask, steps = 1, (2 << room) - 1, []
    for n in lengths:
        left, k = min(count[n], room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] = taken.get(n, 0) + k
            at -= n * k
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for ``histogram`` (length: pieces): (times, [(length, copies), ...]) with every piece in exactly one bin."""
    count = {n: c for n, c in histogram.items() if c}
    lengths, out = sorted(count, reverse=True), []
    while lengths:
        longest = lengths[0]
        count[longest] -= 1
        room = capacity - longest
        # Lengths are few and descending: those that fit begin here.
        lo, hi = 0, len(lengths)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if lengths[mid] > room else (lo, mid)
        items = {longest: 1}
        for n, k in fullest(room, lengths[lo:], count):
            items[n] = items.get(n, 0) + k
        count[longest] += 1
        times = min(count[n] // k for n, k in items.items())
        out.append((times, sorted(items.items(), reverse=True)))
        gone = False
        for n, k in items.items():
            count[n] -= k * times
            gone |= not count[n]
        if gone:
            lengths = [n for n in lengths if count[n]]
    return out


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: where each plan's pieces begin among those of the length, the plan's first bin, copies a bin, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, items in bins:
        offset = 0
        for n, k in items:
            rows.setdefault(n, []).append((used.get(n, 0), first, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


def numbered(cut: DataFrame) -> DataFrame:
    """Number the pieces within their length, from 0. A common length is dealt over many slices, which are counted first."""
    most = cut.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    dealt = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(1 + most // SLICE)))
    sizes = dealt.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.table(sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = dealt.withColumn("r", F.row_number().over(within) - 1)
    return ranked.join(base, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("r")).drop("slice", "base", "r")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs`` (doc_id, text; further columns are ignored) into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts
    are one piece that holds the end id alone. Only documents longer than ``capacity`` are cut, whatever their length.
    Rows that repeat a doc_id are packed each; a null doc_id stays null. An empty table gives an empty table. To the driver comes one count
    for each length, at most ``capacity`` of them.
    """
    cut = scratch.table(pieces(docs, vocabulary, capacity))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    where = places(plan(histogram, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            seq, off = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for n in np.unique(length):
                starts, first, copies, offset = where[int(n)]
                here = length == n
                p = np.searchsorted(starts, rank[here], "right") - 1
                nth = rank[here] - starts[p]
                seq[here] = first[p] + nth // copies[p]
                off[here] = offset[p] + nth % copies[p] * n
            yield b.drop(columns="rank").assign(sequence_id=seq, offset=off)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered(cut).select(*columns, "rank").mapInPandas(scratch.tidy(place), PIECES + ", sequence_id bigint, offset bigint")
