"""Quality rules: text statistics, and ordered rules learned by sequential covering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import scratch
from .split import about, held_out

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_letters bigint, n_digits bigint, n_shouts bigint, n_distinct bigint"
#: At most about so many labelled rows are learned from.
SAMPLE = 50_000
#: A rule stays if so much of what it rejects, among rows it was not grown on, is labelled low; and it must reject so many.
PRECISION, SUPPORT = 0.9, 5
CUTS, LITERALS, RULES = 48, 4, 24
_UPPER, _LETTER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]"), re.compile(r"\d")
_MIX = np.random.default_rng(8).integers(0, 1 << 63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more. Windows are told apart by 64-bit sums."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for i, m in enumerate(_MIX):
        sums += h[i:i + n] * m
    order = np.sort(sums)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.nonzero(np.isin(sums, twice))[0]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The columns of ``STATS`` for one whole text; a null text has none of anything."""
    if not text:
        return (0,) * 11
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    letters = len(_LETTER.findall(text))
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(_UPPER.findall(text)), letters, len(_DIGIT.findall(text)), b.count(b"!"), len(set(words)),
    )


def stats(text: Column) -> Column:
    """The columns of ``STATS`` as a struct."""
    @F.pandas_udf(STATS)
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scratch.forget()
        for text in texts:
            yield pd.DataFrame([statistics(t) for t in text], columns=[c.split()[0] for c in STATS.split(", ")])
        scratch.release()

    return measured(text)


#: What rules may test, as Spark SQL over the statistics; a rate over nothing is 0.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbol_rate": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "dup_line_rate": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "repeat_rate": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
    "upper_rate": "coalesce(try_divide(n_upper, n_letters), 0D)",
    "letter_rate": "coalesce(try_divide(n_letters, word_chars), 0D)",
    "digit_rate": "coalesce(try_divide(n_digits, word_chars), 0D)",
    "shout_rate": "coalesce(try_divide(n_shouts, n_words), 0D)",
    "distinct_rate": "coalesce(try_divide(n_distinct, n_words), 0D)",
    "line_words": "coalesce(try_divide(n_words, n_lines), 0D)",
}
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] < self.cut

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.cut!r}D"


def covered(rule: tuple[Literal, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for literal in rule:
        out &= literal.holds(x)
    return out


def grow(x: dict[str, np.ndarray], low: np.ndarray) -> tuple[Literal, ...]:
    """Add the threshold of most information gain until the rule covers no row of the other class, or nothing gains."""
    rule: tuple[Literal, ...] = ()
    inside = np.ones(len(low), bool)
    while len(rule) < LITERALS and (~low & inside).any():
        p, n = (low & inside).sum(), (~low & inside).sum()
        best, gained = None, 1e-9
        for name, v in x.items():
            own = v[inside]
            for cut in np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 2)[1:-1])) if len(own) else ():
                high_p, high_n = (low[inside] & (own >= cut)).sum(), (~low[inside] & (own >= cut)).sum()
                for above, q, m in ((True, high_p, high_n), (False, p - high_p, n - high_n)):
                    if q and (gain := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gained:
                        best, gained = Literal(name, above, float(cut)), gain
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(x)
    return rule


def prune(rule: tuple[Literal, ...], x: dict[str, np.ndarray], low: np.ndarray) -> tuple[Literal, ...]:
    """Of the rule's beginnings, the shortest that is best by (right - wrong) / covered."""
    def worth(k: int) -> float:
        c = covered(rule[:k], x, len(low))
        return ((low & c).sum() - (~low & c).sum()) / max(1, c.sum())

    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 5) -> list[tuple[Literal, ...]]:
    """Rules, in order, each for rows of low quality that no earlier rule rejects."""
    rules: list[tuple[Literal, ...]] = []
    left = np.ones(len(low), bool)
    rng = np.random.default_rng(seed)
    failures = 0
    while len(rules) < RULES and (low & left).sum() >= SUPPORT and failures < 3:
        part = rng.random(len(low)) < 2 / 3
        a, b = left & part, left & ~part
        rule = prune(grow({k: v[a] for k, v in x.items()}, low[a]), {k: v[b] for k, v in x.items()}, low[b])
        c = covered(rule, x, len(low))
        seen = c & b
        if not rule or (low & c & left).sum() < SUPPORT or (low & seen).sum() < PRECISION * max(1, seen.sum()) or not seen.any():
            failures += 1
            continue
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: list[tuple[Literal, ...]]) -> Column:
    """Ordered conditional expression over the statistics: false from the first rule that holds, else true."""
    out = F.when(F.expr(BASE_FAILED), False)
    for rule in rules:
        out = out.when(F.expr(" and ".join(literal.sql() for literal in rule)), False)
    return out.otherwise(True)


def fit(measured: DataFrame, labels: DataFrame) -> list[tuple[Literal, ...]]:
    """Learn from ``measured`` (doc_id and the statistics) and ``labels`` (doc_id, quality: 0 low, 1 good).

    Held-out and unlabelled rows, and rows that fail the base rules, teach nothing; of several labels of a document the
    lowest counts. About ``SAMPLE`` rows at most come to the driver, eleven numbers each. At most ``RULES`` rules of at most
    ``LITERALS`` thresholds are learned, each threshold one of ``CUTS`` quantiles. No label: no rule.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = about(known, SAMPLE, known.count(), F.col("doc_id")).join(measured, "doc_id").where(f"not ({BASE_FAILED})")
    # Copies would count a text's chance traits many times over: equal statistics count once.
    table = rows.select(F.col("quality"), *(F.expr(e).alias(n) for n, e in FEATURES.items())).distinct().orderBy(*FEATURES, "quality").toPandas()
    return learn({n: table[n].to_numpy(float) for n in FEATURES}, table["quality"].to_numpy() == 0)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of ``docs``: of whole texts, whatever their length; null texts count nothing.

    Repeated rows are measured each, a null doc_id stays null, an empty table gives an empty table, further columns are
    ignored.
    """
    return scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), stats(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text; further columns are ignored).

    Returns doc_id, the statistics, base_failed, kept. Null texts count nothing and fail the base rules. Texts of any
    length are counted whole. Repeated rows are each judged, alike if their texts are; a null doc_id stays null; an empty
    table gives an empty table.
    """
    measured = scratch.table(measure(docs))
    rules = fit(measured, labels)
    return measured.select("*", F.expr(BASE_FAILED).alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep, all columns, whatever their names; measured once to learn and once to
    filter.

    Null and empty texts fail the base rules and go, repeated rows go or stay alike, an empty table stays empty.
    """
    rules = fit(measure(labelled_only(docs, labels)), labels)
    free = next(n for n in ("s", *(f"s_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    own = scratch.lean(docs).withColumn(free, stats(F.col("text").cast("string")))
    names = [c.split()[0] for c in STATS.split(", ")]
    test = verdict(rules)
    if set(names) & set(docs.columns):  # the rules name plain columns: judge the struct alone, so that names cannot clash
        judged = own.select(*(F.col(c).alias(f"d{i}") for i, c in enumerate(docs.columns)), f"{free}.*").where(test)
        return judged.select(*(F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)))
    return own.select("*", f"{free}.*").where(test).select(docs.columns)


def labelled_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and text of the rows of ``docs`` that have a label, each once however many labels it has; null ids have none."""
    return docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
