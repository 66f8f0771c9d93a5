"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its posterior."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .known import Known
from .split import held_out

WORD = re.compile(r"[^\W\d_]+")
# English words of insult, the voters known beforehand.
LEXICON = ("awful", "clown", "crap", "disgusting", "dumb", "fool", "freak", "garbage", "hate", "idiot", "imbecile", "jerk", "kill", "loser", "moron", "pathetic", "scum", "shut", "stupid", "sucks", "trash", "ugly", "vermin", "worthless")
#: Labelled texts that are learned from at most. The model's size is bounded too: candidates that are weighed, and voters kept.
SAMPLE, CANDIDATES, VOTERS = 16_000, 4000, 400
#: Lengths of word beginnings that may be patterns.
STEMS = (4, 5, 6)
#: A candidate's least number of toxic texts and share of them; voters that each toxic text should have.
SUPPORT, PRECISION, COVER = 4, 0.8, 8
#: Votes that a voter's rightness on labelled texts counts for beside the votes themselves; least correlation that counts.
TRUST, TOGETHER = 4.0, 0.2
ROUNDS = 40


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in STEMS if len(word) > n]


def features(text: str | None) -> set[str]:
    """Lower-case words, beginnings of longer words marked with a ``*``, and with two those that several words share."""
    words = set(WORD.findall(text.lower())) if text else set()
    begun = Counter(b for w in words for b in beginnings(w))
    return words | set(begun) | {f"{b}*" for b, n in begun.items() if n > 1}


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float
    known: Known = field(default_factory=Known)

    def _heard(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]] | tuple[()]:
        """The voters that speak up on ``word``, and those that do on it and another word of the same beginning."""
        get, begun = self.index.get, beginnings(word)
        one = tuple(i for f in (word, *begun) if (i := get(f)) is not None)
        two = tuple(i for f in begun if (i := get(f"{f}*")) is not None)
        return (one, two) if one or two else ()

    def votes(self, text: str | None) -> set[int]:
        """The voters that speak up on a whole text."""
        words = set(WORD.findall(text.lower())) if text else set()
        known = self.known
        known.begin()
        new = known.missing(words)
        known.learn({w: self._heard(w) for w in new})
        out: set[int] = set()
        once: set[int] = set()
        for hit in filter(None, map(known.young.__getitem__, words)):
            out.update(hit[0])
            for i in hit[1]:
                (out if i in once else once).add(i)
        known.forget(new)
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[i] for i in sorted(self.votes(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_model(votes: np.ndarray, right: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of 0/1 ``votes``, and each voter's estimated accuracy.

    A voter that is silent abstains: its silence is no evidence, so a row without votes has the ``prior``, which is held.
    Expectation maximisation: a vote adds the log-odds of its voter's accuracy over the prior's, and the accuracy is the
    mean posterior where the voter speaks up, with ``right``, its share of labelled class 1, as ``TRUST`` further votes.
    Voters that still go together within a class share their evidence: on a row, each vote is divided by one plus its
    correlations with the row's other votes.
    """
    x, base = votes.astype(float), np.log(prior / (1 - prior))
    heard, accuracy, corr = x.sum(0), right, np.zeros((votes.shape[1], votes.shape[1]))
    post = np.full(len(x), prior)
    for r in range(ROUNDS):
        z = base + (x / (1 + x @ corr)) @ (np.log(accuracy / (1 - accuracy)) - base)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        ended = r % 8 and np.abs(new - post).max() < 1e-4
        post = new
        accuracy = np.clip((post @ x + TRUST * right) / (heard + TRUST), 1e-4, 1 - 1e-4)
        if ended:
            break
        if r % 8 == 0:
            one, zero = post @ x / max(post.sum(), 1e-9), (1 - post) @ x / max((1 - post).sum(), 1e-9)
            rest = x - np.outer(post, one) - np.outer(1 - post, zero)
            cov = rest.T @ rest / len(x)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr = cov / np.outer(scale, scale)
            np.fill_diagonal(corr, 0)
            corr = np.where(corr > TOGETHER, np.minimum(corr, 1.0), 0.0)
    return post, accuracy


def linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps."""
    a = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (target - p) - keep * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def choose(hits: list[set[int]], toxic: np.ndarray, count: int) -> list[int]:
    """Candidates, most helpful first: each toxic text asks for ``COVER`` of them, each other text repels."""
    by = [[] for _ in range(count)]
    for row, h in enumerate(hits):
        for i in h:
            by[i].append(row)
    by = [np.array(b, np.int64) for b in by]
    wrong = [int((~toxic[b]).sum()) for b in by]
    need = np.where(toxic, COVER, 0)
    gains = {i: int(need[b].clip(0, 1).sum()) for i, b in enumerate(by) if len(b)}
    chosen: list[int] = []
    while gains and len(chosen) < VOTERS:
        i = max(gains, key=lambda k: (gains[k] - 8 * wrong[k], k))
        now = int((need[by[i]] > 0).sum())
        if now != gains[i]:
            gains[i] = now  # a guess that went stale: the best may be another
            continue
        if now - 8 * wrong[i] < SUPPORT - 1:
            break
        chosen.append(i)
        need[by[i]] = np.maximum(0, need[by[i]] - 1)
        del gains[i]
    return chosen


def learn(names: list[str], hits: list[set[int]], toxic: np.ndarray) -> Model:
    """Choose voters among the candidates ``names``, let the label model weigh their votes, and train on its posterior."""
    chosen = choose(hits, toxic, len(names))
    at = {c: j for j, c in enumerate(chosen)}
    x = np.zeros((len(hits), len(chosen)), bool)
    for row, h in enumerate(hits):
        x[row, [at[c] for c in h if c in at]] = True
    right = np.array([(toxic & v).sum() + 1.0 for v in x.T]) / np.array([v.sum() + 2.0 for v in x.T])
    post, _ = label_model(x, right, float(np.clip(toxic.mean(), 1e-3, 0.5)))
    weights, bias = linear(x, post)
    return Model({names[c]: j for c, j in at.items()}, weights, bias)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows of ``docs`` (doc_id, text) that are not held out; ``labels``: doc_id, toxic (0/1).

    At most ``SAMPLE`` labelled rows, the lowest by the hash of doc_id, are learned from; equal texts count once, and of
    several labels of a document or text the highest. Candidates are words and word beginnings that are mostly seen in
    toxic texts, at most ``CANDIDATES`` of them; they are counted on the executors. At most ``VOTERS`` are kept. No toxic
    label, or none on a text with a candidate: every score is low, by the words known beforehand.
    """
    y = F.col("toxic").cast("int")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), y.alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = scratch.table(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yes, no = Counter(), Counter()
        for b in batches:
            for t, y in zip(b["text"], b["toxic"], strict=True):
                (yes if y else no).update(features(t))
        found = list(yes | no)  # an empty frame would have no string column
        if found:
            yield pd.DataFrame({"f": found, "yes": [yes[f] for f in found], "no": [no[f] for f in found]})

    counts = rows.mapInPandas(scratch.tidy(count), "f string, yes bigint, no bigint").groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    found = counts.where((F.col("yes") >= SUPPORT) & (F.col("yes") >= PRECISION * (F.col("yes") + F.col("no")))).orderBy(F.desc(F.col("yes") - 4 * F.col("no")), "f").limit(CANDIDATES).collect()
    names = list(dict.fromkeys([*LEXICON, *(r["f"] for r in found)]))
    index = {f: i for i, f in enumerate(names)}

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"].array, "hits": [sorted(index[f] for f in features(t) if f in index) for t in b["text"]]})

    seen = rows.mapInPandas(scratch.tidy(vote), "toxic int, hits array<int>").toPandas()
    scratch.drop(docs.sparkSession, rows)
    seen = sorted((tuple(map(int, h)), int(y)) for h, y in zip(seen["hits"], seen["toxic"], strict=True))  # the same order in every run
    toxic, hits = np.array([y for _, y in seen], int) == 1, [set(h) for h, _ in seen]
    if not any(h and y for h, y in zip(hits, toxic, strict=True)):
        return Model({w: i for i, w in enumerate(LEXICON)}, np.full(len(LEXICON), 1.0), -4.0)
    return learn(names, hits, toxic)


def score_udf(model: Model):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scratch.forget()
        for text in texts:
            yield pd.Series([model.score(t) for t in text], dtype=float)
        scratch.release()

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text; further columns are ignored): doc_id, held_out, score, predicted.

    Null, empty and wordless texts get the score of a text on which no voter speaks. A text of any length is scored by all
    its distinct words. Equal texts have equal scores. Repeated rows are each scored; a null doc_id stays null and counts
    as held out; an empty table gives an empty table.
    """
    s = scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), score_udf(model)(F.col("text").cast("string")).alias("score"))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns and no other, whatever their names.

    Null and empty texts are kept, repeated rows are each kept or dropped alike, an empty table stays empty.
    """
    model = fit(docs, labels)
    return scratch.lean(docs).where(score_udf(model)(F.col("text").cast("string")) < 0.5)
