"""The pipeline and its stages against plain Python, on a corpus with planted cases of each kind."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelith.llm import line_dedup, near_copies, packing, quality, toxicity
from voxelith.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
PARTS = {"en": ("the", "ing", "er", "an", "sto", "wa", "li"), "fr": ("ré", "eau", "le", "oi", "me", "que", "sa"), "de": ("sch", "ein", "ung", "ver", "zu", "ab", "no"), "es": ("co", "ción", "la", "ue", "ja", "ro", "mi")}
INSULTS = {"en": ("idiot", "scumbag", "moron"), "fr": ("réeuxaffe", "réeuxtin", "réeuxlot"), "de": ("achlichdepp", "achlichtor", "achlichsau"), "es": ("bocotonto", "bocofeo", "bocomalo")}
SHARED = ["all rights reserved by the owners of this site", "click here to read the next page of this story"]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=1400, seed=11):
    """Rows and labels, and what was planted: toxic, poor, near copies by their originals."""
    rng = random.Random(seed)
    words = {l: ["".join(rng.choices(p, k=rng.randint(1, 4))) for _ in range(900)] for l, p in PARTS.items()}
    rows, labels, planted = [], [], {"toxic": {}, "poor": set(), "near": {}}
    for i in range(n):
        lang = rng.choice(("en", "en", "fr", "de", "es"))
        text = [" ".join(rng.choices(words[lang], k=rng.randint(6, 14))) for _ in range(rng.randint(6, 12))]
        kind = rng.random()
        toxic = poor = False
        if kind < 0.15:
            at = rng.sample(range(len(text)), 3)
            for k, w in zip(at, rng.sample(INSULTS[lang], 3)):
                text[k] += f" {w}"
            planted["toxic"][i], toxic = lang, True
        elif kind < 0.3:
            text = [" ".join(w + rng.choice(("###", "$$$", "%%%")) for w in t.split()) for t in text]
            planted["poor"].add(i)
            poor = True
        elif kind < 0.4 and i > 20:
            base = rng.randrange(i)
            if base not in planted["toxic"] and base not in planted["poor"]:
                text = rows[base][1].split("\n")
                if kind < 0.36:
                    text = [t if k else t + " changed here" for k, t in enumerate(text)]
                planted["near"][i] = base
        if rng.random() < 0.2:
            text.insert(rng.randrange(len(text)), f"  {rng.choice(SHARED)} ")
        body = "\n".join(text)
        rows.append((i, body, lang, f"s{rng.randrange(8) if i % 3 else 0}", len(body)))
        if rng.random() < 0.8:
            labels.append((i, int(not poor), int(toxic)))
    return rows, labels, planted


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, labels, planted = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return at, rows, labels, planted


def plain_toxicity(rows, labels):
    """The model of plain counting over the labelled rows, none of them a repeat."""
    y = {i: t for i, _, t in labels if not held(i)}
    texts = {}
    for i, text, *_ in rows:
        if i in y:
            texts[text] = max(texts.get(text, 0), y[i])
    yes, no = Counter(), Counter()
    for t, k in texts.items():
        (yes if k else no).update(toxicity.features(t))
    found = sorted((f for f in yes if yes[f] >= toxicity.SUPPORT and yes[f] >= toxicity.PRECISION * (yes[f] + no[f])), key=lambda f: (-(yes[f] - 4 * no[f]), f))[:toxicity.CANDIDATES]
    names = list(dict.fromkeys([*toxicity.LEXICON, *found]))
    index = {f: i for i, f in enumerate(names)}
    seen = sorted((tuple(sorted(index[f] for f in toxicity.features(t) if f in index)), k) for t, k in texts.items())
    return toxicity.learn(names, [set(h) for h, _ in seen], np.array([k for _, k in seen]) == 1)


def plain_votes(model, text):
    return {model.index[f] for f in toxicity.features(text) if f in model.index}


def plain_quality(rows, labels):
    y = {i: q for i, q, _ in labels if not held(i)}
    names = [c.split()[0] for c in quality.STATS.split(", ")]

    def features(text):
        s = dict(zip(names, quality.statistics(text)))

        def rate(a, b):
            return s[a] / s[b] if s[b] else 0.0

        return s, {"words": float(s["n_words"]), "word_length": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"), "upper_rate": rate("n_upper", "n_letters"), "letter_rate": rate("n_letters", "word_chars"), "digit_rate": rate("n_digits", "word_chars"), "shout_rate": rate("n_shouts", "n_words"), "distinct_rate": rate("n_distinct", "n_words"), "line_words": rate("n_words", "n_lines")}

    def failed(s):
        return s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]

    table = sorted({(*f.values(), y[i]) for i, text, *_ in rows if i in y for s, f in [features(text)] if not failed(s)})
    x = {n: np.array([t[k] for t in table]) for k, n in enumerate(quality.FEATURES)}
    rules = quality.learn(x, np.array([t[-1] for t in table]) == 0)

    def keep(text):
        s, f = features(text)
        return not failed(s) and not any(all((f[l.feature] >= l.cut) == l.above for l in r) for r in rules)

    return keep


def plain_lines(rows):
    sites, first = {}, {}
    for i, text, _, source, _ in rows:
        for line in text.split("\n"):
            k = line.strip(" \t\r")
            if k:
                sites.setdefault(k, set()).add(source)
                first[k] = min(first.get(k, i), i)
    gone = {k for k, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    out = []
    for i, text, lang, source, n in rows:
        lines = text.split("\n")
        left = [t for t in lines if t.strip(" \t\r") not in gone or first[t.strip(" \t\r")] == i]
        new = "\n".join(left)
        if len(left) == len(lines):
            out.append((i, text, lang, source, n))
        elif new.strip(" "):
            out.append((i, new, lang, source, len(new)))
    return out


def plain_near(rows):
    def shingles(t):
        w = t.lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    done = set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                        lo, hi = sorted((find(a), find(b)))
                        root[hi] = lo
    return [r for r in rows if find(r[0]) == r[0]]


def as_rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_stages_equal_plain_python(spark, made):
    at, rows, labels, planted = made
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{at}/documents.parquet")

    model = plain_toxicity(rows, labels)
    kept = [r for r in rows if 1 / (1 + np.exp(-(model.bias + sum(model.weights[i] for i in plain_votes(model, r[1]))))) < 0.5]
    got = stages["toxicity"](spark, docs, at)
    assert as_rows(got) == sorted(kept)
    caught = {l: [i not in {r[0] for r in kept} for i, k in planted["toxic"].items() if k == l and held(i)] for l in INSULTS}
    assert all(np.mean(c) >= 0.85 for c in caught.values()), {l: np.mean(c) for l, c in caught.items()}
    assert sum(r[0] not in planted["toxic"] for r in rows) - sum(r[0] not in planted["toxic"] for r in kept) <= 0.01 * len(rows)

    docs = spark.createDataFrame(kept, SCHEMA)
    keep = plain_quality(kept, labels)
    good = [r for r in kept if keep(r[1])]
    assert as_rows(stages["quality"](spark, docs, at)) == sorted(good)
    poor = {r[0] for r in kept} & planted["poor"]
    assert len(poor - {r[0] for r in good}) >= 0.9 * len(poor) and len([r for r in kept if r[0] not in planted["poor"]]) - len([r for r in good if r[0] not in planted["poor"]]) <= 0.05 * len(kept)

    docs = spark.createDataFrame(good, SCHEMA)
    cleaned = plain_lines(good)
    assert as_rows(stages["line_dedup"](spark, docs, at)) == sorted(cleaned) and sum(SHARED[0] in map(str.strip, r[1].split("\n")) for r in cleaned) == 1

    docs = spark.createDataFrame(cleaned, SCHEMA)
    one = plain_near(cleaned)
    assert as_rows(stages["near_duplicates"](spark, docs, at)) == sorted(one) and len(one) < len(cleaned)

    docs = spark.createDataFrame(one, SCHEMA)
    packed = stages["packing"](spark, docs, at).toPandas()
    check_packed(packed, {r[0]: r[1] for r in one}, 4096)


def check_packed(packed, texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert set(packed["doc_id"]) == set(texts)
    for d, g in packed.groupby("doc_id"):
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        g = g.sort_values("piece")
        assert g["length"].sum() == len(ids) and g["ids_crc32"].tolist() == [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(g["start"], g["length"])]
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= capacity


def test_run_equals_its_stages(spark, made):
    at, rows, labels, _ = made
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_packed(corpus_pipeline.run(spark, at).toPandas(), texts, packing.CAPACITY)


def test_stages_on_empty_tables_and_clashing_columns(spark, made, tmp_path):
    at, rows, labels, _ = made
    names = ("n_removed", "n_lines", "h", "g", "t", "pos", "s", "fp", "sim", "head", "n_words", "kept", "score", "_gone", "c0", "l")
    clash = spark.createDataFrame(rows[:200], SCHEMA).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, at)
        if name != "packing":
            assert out.columns == clash.columns and out.where(" or ".join(f"{n} <> 'own {n}'" for n in names)).count() == 0 and out.count() > 0, name
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_nulls_in_stages(spark, made):
    at, rows, _, _ = made
    some = [*rows[:150], *rows[:150], (None, "a row without an id " * 12, None, None, None), (9000, None, None, None, None), (9001, "", None, None, 0)]
    docs = spark.createDataFrame(some, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name == "packing":
            assert out.count() >= len(some)
        else:
            counts = Counter(r["doc_id"] for r in out.collect())
            assert all(counts[i] in (0, 2) for i in range(150)), name


def test_line_dedup_keeps_own_columns(spark):
    d = spark.createDataFrame([(i, f"own {i}\nlegal text", None, f"s{i}", 4, "mine", 77) for i in range(4)], SCHEMA + ", n_lines string, n_removed int")
    got = {r["doc_id"]: r for r in line_dedup.cleaned(d).collect()}
    assert all(r["n_lines"] == "mine" and r["n_removed"] == 77 for r in got.values()) and got[1]["text"] == "own 1" and got[1]["n_chars"] == 5


def test_no_copies_stay(spark):
    base = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(5, base, None, "a", None), (6, base + " more", None, "b", None), (7, "quite another text of a few words", None, "c", None)], SCHEMA)
    assert [r["doc_id"] for r in near_copies.one_of_each(d).orderBy("doc_id").collect()] == [5, 7]
