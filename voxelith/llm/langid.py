"""Language of whole texts: script ranges, then Viterbi over per-word scores with a penalty for switching."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .known import MUCH, Known
from .split import SCALE, held_out

# First code points of script blocks, in order; "" is shared or unlisted.
SCRIPTS = (
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00C0, "Latin"), (0x0250, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1780, "Khmer"), (0x1800, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x30000, ""),
)
_FIRST = [a for a, _ in SCRIPTS]
_KINDS = sorted({s for _, s in SCRIPTS})
#: Letters of a run that are scored together; longer runs are cut into consecutive words.
LONG = 64
#: Words of any text, and of lower-cased texts that hold no other letters than these.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PLAIN, LATIN = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*"), re.compile(rf"[a-zß-öø-ÿ]{{1,{LONG}}}")
BUCKETS, GRAMS = 1 << 16, 4
#: About so many documents of each language are learned from; with more languages than this, ``fit`` raises.
SAMPLE, LANGUAGES = 3000, 1024
#: Log-odds that a change of language must win back.
SWITCH = 8.0
#: Log-odds of a language that does not use a word's script, where another one does.
ALIEN = -20.0
#: A script counts as a language's if so much of its words are in it.
SHARE = 0.01
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def script(letter: str) -> str:
    return SCRIPTS[bisect_right(_FIRST, ord(letter)) - 1][1]


def places(low: str) -> list[tuple[int, int]]:
    """(start, end) of the words of a lower-cased text: runs of letters with their marks, cut where the script changes and
    after every ``LONG`` signs."""
    out = []
    for m in WORD.finditer(low):
        at, end = m.span()
        if m[0].isascii():
            cuts = []
        else:
            kinds = [None if regex.match(r"\p{M}", c) else script(c) for c in m[0]]  # a mark goes with its letter
            for i in range(1, len(kinds)):
                if kinds[i] is None:
                    kinds[i] = kinds[i - 1]
            cuts = [at + i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]]
        for a, b in zip([at, *cuts], [*cuts, end], strict=True):
            out += [(i, min(b, i + LONG)) for i in range(a, b, LONG)]
    return out


def words(text: str | None) -> list[str]:
    """The words of a whole text, lower-cased."""
    low = (text or "").lower()
    return LATIN.findall(low) if PLAIN.fullmatch(low) else [low[a:b] for a, b in places(low)]


def grams(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of the 1- to 4-grams of marked words, word by word; where each word's begin; and how many it has."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, some), np.int64, len(some)) + 2
    ends = np.repeat(np.cumsum(size), size)
    left = ends - np.arange(len(codes))  # signs of the word from here on
    parts = np.zeros((len(codes), GRAMS), np.int64)
    use = np.zeros((len(codes), GRAMS), bool)
    h = np.zeros(len(codes), np.uint64)
    for n in range(GRAMS):
        moved = np.zeros(len(codes), np.uint64)
        moved[:len(codes) - n] = codes[n:]
        h = (h + moved + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        parts[:, n] = (h * _MIX) >> np.uint64(48)
        use[:, n] = left > n
    count = np.add.reduceat(use.sum(1), np.cumsum(size) - size)
    return parts[use], np.cumsum(count) - count, count


def kinds(some: list[str]) -> np.ndarray:
    """The number of each word's script."""
    return np.fromiter((_KINDS.index(script(w[0])) for w in some), np.int64, len(some))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets x languages
    scripts: list[set[str]]
    known: Known = field(default_factory=lambda: Known(MUCH))

    def __post_init__(self):
        self.users = np.array([[k in s for s in self.scripts] for k in _KINDS], bool).reshape(len(_KINDS), len(self.languages))

    def rows(self, some: list[str]) -> np.ndarray:
        """For each word: its log-odds for each language, none for a script that no language uses, and whether one does."""
        out = np.zeros((len(some), len(self.languages) + 1), np.float32)
        for at in range(0, len(some), 4096):
            part = some[at:at + 4096]
            found, starts, n = grams(part)
            scores = np.add.reduceat(self.logs[found], starts, 0)
            scores *= (np.minimum([len(w) for w in part], 8) / n)[:, None]
            own = self.users[kinds(part)]
            used = own.any(1)
            top = np.where(own, scores, -np.inf).max(1, keepdims=True)
            out[at:at + len(part), :-1] = np.where(used[:, None], np.where(own, scores - np.where(used[:, None], top, 0), ALIEN), 0)
            out[at:at + len(part), -1] = used
        return out

    def scores(self, some: list[str]) -> np.ndarray:
        """``rows`` of the words of a text, from memory or made now."""
        self.learn([some])
        return np.frombuffer(b"".join(map(self.known.young.__getitem__, some)), np.float32).reshape(len(some), -1)

    def learn(self, texts: list[list[str]]) -> list[str]:
        """Have the rows of the words of all ``texts`` at hand until the next call; returns those that were missing."""
        self.known.begin()
        new = self.known.missing(set().union(*texts))
        if new:
            raw, step = self.rows(new).tobytes(), 4 * (len(self.languages) + 1)
            self.known.learn({w: raw[i * step:(i + 1) * step] for i, w in enumerate(new)})
        return new

    def path(self, s: np.ndarray) -> np.ndarray:
        """The language of each word on the best path. One language holds throughout if no stretch of words wins back
        a switch for any other, nor a beginning and an end together: a path without that language has one switch less
        than stretches, so those two share one. Else the recursion runs."""
        n, best = len(s), int(s.sum(0).argmax())
        run = np.cumsum(np.vstack([np.zeros(s.shape[1]), s - s[:, best:best + 1]]), 0)
        if (run - np.minimum.accumulate(run, 0)).max() <= SWITCH and run.max() + (run[-1] - run).max() <= SWITCH:
            return np.full(n, best)
        value, back = s[0].tolist(), []
        for row in s[1:].tolist():
            top = max(value)
            lead, floor = value.index(top), top - SWITCH
            back.append([i if v >= floor else lead for i, v in enumerate(value)])
            value = [max(v, floor) + x for v, x in zip(value, row, strict=True)]
        at = [value.index(max(value))]
        for b in reversed(back):
            at.append(b[at[-1]])
        return np.array(at[::-1])

    def judge(self, some: list[str], s: np.ndarray) -> tuple[str, float, np.ndarray]:
        """Language of most letters; the share of all letters that it explains, in words of a script it uses; the path."""
        scores = s[:, :-1].astype(float)
        p = self.path(scores)
        size = np.fromiter(map(len, some), float, len(some))
        best = int(np.bincount(p, size, len(self.languages)).argmax())
        explained = (p == best) & (s[:, -1] > 0) & (scores[:, best] > ALIEN)
        return self.languages[best], float(size[explained].sum() / size.sum()), p

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language of most letters, the share of letters that it explains, and (start, end, language) of each span."""
        low = (text or "").lower()
        found = places(low)
        if not found or not self.languages:
            return UNKNOWN, 0.0, []
        some = [low[a:b] for a, b in found]
        lang, score, p = self.judge(some, self.scores(some))
        edges = [0, *(np.nonzero(np.diff(p))[0] + 1).tolist(), len(p)]
        return lang, score, [(found[a][0], found[b - 1][1], self.languages[p[a]]) for a, b in zip(edges, edges[1:])]

    def brief(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """As ``label`` for many texts, without spans."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        cut = [words(t) for t in texts]
        new = self.learn(cut)
        get, out = self.known.young.__getitem__, []
        for some in cut:
            if some:
                s = np.frombuffer(b"".join(map(get, some)), np.float32).reshape(len(some), -1)
                out.append(self.judge(some, s)[:2])
            else:
                out.append((UNKNOWN, 0.0))
        self.known.forget(new)
        return out


def fit(docs: DataFrame) -> Model:
    """Learn n-gram scores from about ``SAMPLE`` documents of each language that are not held out (fewer: all of them).

    The sample is the bound on what is learned from. Languages are counted in one pass over doc_id and lang; one pass over
    the texts then counts n-grams into a fixed number of buckets. With no labelled row the model knows no language and
    answers ``und``; with more than ``LANGUAGES`` languages this raises, rather than leave any out.
    """
    rows = scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the model has no room for them")
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), [])
    chosen = docs.sparkSession.createDataFrame([(n, i, float(SCALE * min(1.0, SAMPLE / counts[n]))) for i, n in enumerate(names)], "lang string, l int, below double")
    sample = rows.join(F.broadcast(chosen), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(SCALE)) < F.col("below")).where(F.col("text").isNotNull()).select("text", "l")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid, seen = np.zeros((len(names), BUCKETS)), np.zeros((len(names), len(_KINDS)))
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at:at + 512]
                for l, texts in part.groupby("l")["text"]:
                    bag = Counter(w for t in texts for w in words(t))
                    some = list(bag)
                    for i in range(0, len(some), 4096):
                        few = some[i:i + 4096]
                        times = np.array([bag[w] for w in few], float)
                        found, _, n = grams(few)
                        grid[l] += np.bincount(found, np.repeat(times, n), BUCKETS)
                        seen[l] += np.bincount(kinds(few), times, len(_KINDS))
        for what, x in ((0, grid), (1, seen)):
            l, i = np.nonzero(x)
            yield pd.DataFrame({"what": np.full(len(l), what, np.int32), "l": l.astype(np.int32), "i": i.astype(np.int32), "n": x[l, i].astype(np.int64)})

    grid, seen = np.zeros((BUCKETS, len(names))), np.zeros((len(names), len(_KINDS)))
    for r in sample.mapInPandas(scratch.tidy(count), "what int, l int, i int, n bigint").groupBy("what", "l", "i").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["what"]:
            seen[r["l"], r["i"]] = r["n"]
        else:
            grid[r["i"], r["l"]] = r["n"]
    logs = np.log(grid + 0.5) - np.log(grid.sum(0) + 0.5 * BUCKETS)
    scripts = [{_KINDS[k] for k in np.nonzero(row >= SHARE * max(1, row.sum()))[0]} for row in seen]
    return Model(names, logs, scripts)


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text; further columns are ignored).

    Returns (doc_id, lang_pred, score), and with ``spans`` an array of (start, end, lang) in code points of the
    lower-cased text. The score is the share of letters that lie in spans of the language and in a script that it uses: a
    text wholly in a script that no language uses still gets a language, with score 0. Null texts and texts without
    letters: ``und``, score 0, no span. Runs of more than 64 letters are scored in parts, none left out, and texts of any
    length as a whole. Languages that score alike go by name. Rows that repeat are each predicted, equal texts alike; an
    empty table gives an empty table.
    """
    schema = "doc_id bigint, lang_pred string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * spans

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at:at + 512]
                found = [model.label(t) for t in part["text"]] if spans else model.brief(part["text"].tolist())
                out = pd.DataFrame({"doc_id": part["doc_id"].array, "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})
                if spans:
                    out["spans"] = [[{"start": a, "end": z, "lang": l} for a, z, l in x[2]] for x in found]
                yield out

    return scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scratch.tidy(run), schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` and predict all of them: doc_id, held_out, lang_pred, score. Nulls and ties: as in ``predict``."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
