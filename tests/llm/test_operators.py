"""Training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from voxelith.llm import components, fingerprint, fixity, langid, line_dedup, packing, pieces, quality, simhash, token_counts, toxicity
from voxelith.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ban", "del", "fir", "gum", "hat", "jop", "")]


def texts(n=120, seed=3):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 300))) for _ in range(n)]
    for i in range(0, n, 5):
        out[i] = out[(i * 7 + 1) % n]
    for i in range(4, n, 7):
        out[i] += "\n  a line on many sites \nand its own end"
    out[3:3] = [None, "", " \n\t ", "One", "two Words", "x" * 30_000, "Ünïcödé ▁ mark 漢字 🙂 \x85 　 end", "same\nsame\nsame"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 6}", len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "a row without an id", None, None, None)], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def labels(spark, docs):
    rows = [(r["doc_id"], int(r["doc_id"] % 4 > 0), int(r["doc_id"] % 9 == 0)) for r in docs.where("doc_id is not null").collect()]
    return spark.createDataFrame([*rows, (None, None, None)], LABELS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)


def clash(df):
    """Columns with names that operators use inside."""
    names = ("key", "fp", "h", "t", "pos", "n", "s", "n_words", "kept", "length", "rank", "site", "node", "_gone", "c0")
    return df.select("*", *(F.lit("x").alias(n) for n in names))


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_fingerprint(t):
    low = bytes((t or ""), "utf-8").lower().split()
    if not low:
        return 0
    sh = [b" ".join(low[i:i + 3]) for i in range(len(low) - 2)] or [b" ".join(low)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_fixity_finds_exactly_the_faults(spark):
    left = [(i, f"record {i}" * (i % 4)) for i in range(-40, 900)] + [(7, "again"), (8, None), (None, "no place")]
    right = [(i, "bad" if i in (0, 255, 256, -40) else p) for i, p in left if i not in (5, 899)] + [(5000, "new")]
    got = {r["record_id"]: r["problem"] for r in fixity.audit(*(spark.createDataFrame(x, "id bigint, payload string").repartition(3) for x in (left, right))).collect()}
    assert got == {0: "changed", 255: "changed", 256: "changed", -40: "changed", 5: "missing", 899: "missing", 5000: "extra"}


def test_fixity_equal_and_empty(spark):
    a = spark.createDataFrame([(1, "x"), (2, "")], "id bigint, payload string")
    assert fixity.audit(a, a).count() == 0 and fixity.audit(a.limit(0), a.limit(0)).count() == 0 and fixity.audit(a, a.limit(0)).count() == 2


def test_golay_keys_meet_within_one_bit():
    rng = np.random.default_rng(1)
    for v in rng.integers(0, 1 << 21, 200, dtype=np.uint32):
        mine = set(simhash.golay_keys(np.array([v], np.uint32))[1].tolist())
        for b in range(21):
            assert mine & set(simhash.golay_keys(np.array([v ^ np.uint32(1 << b)], np.uint32))[1].tolist())


def test_simhash_components(docs):
    got = rows(simhash.near_duplicates(clash(docs)))
    known = {d: r for d, r in got.items() if d is not None}
    for r in docs.where("doc_id is not null").collect():
        assert int(known[r["doc_id"]]["fingerprint"], 16) == brute_fingerprint(r["text"])
    ids = sorted(known)
    links = [(a, b) for a in ids for b in ids if a < b and (int(known[a]["fingerprint"], 16) ^ int(known[b]["fingerprint"], 16)).bit_count() <= 2]
    assert {d: r["component_id"] for d, r in known.items()} == brute_components(ids, links) and got[None]["component_id"] is None


def test_simhash_wide_keys(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(62) for _ in range(5)]
    fps = sorted({b ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for b in base for _ in range(60)} | set(base))
    monkeypatch.setattr(simhash, "WIDE", 6)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp bigint, head bigint")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(nodes)).collect()}
    want = brute_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_line_dedup_equals_sql(docs):
    con = duckdb.connect()
    frame = docs.where("doc_id is not null").toPandas()
    con.register("documents", frame)
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({line_dedup.SQL})").fetchall()}
    got = line_dedup.dedup(clash(docs.where("doc_id is not null"))).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert {r[0]: tuple(r) for r in got} == want and any(r[3] for r in got)


def test_line_dedup_keeps_the_lowest(spark):
    d = spark.createDataFrame([(i, f"own {i}\n  legal text \n", None, f"s{i}", None) for i in range(4)] + [(None, "legal text", None, None, None), (9, None, None, "s9", None)], SCHEMA)
    got = rows(line_dedup.dedup(d))
    assert got[0]["text"] == "own 0\n  legal text \n" and got[1]["text"] == "own 1\n" and got[None]["text"] == "" and got[9]["text"] is None


def test_fingerprints_and_edits(docs):
    own = docs.where("doc_id is not null")
    got, source = rows(fingerprint.edited(clash(own))), {r["doc_id"]: r["text"] or "" for r in own.collect()}

    def shingles(t):
        w = bytes(t, "utf-8").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids = sorted(source)
    for k, i in enumerate(ids):
        t, nxt = source[i], source[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        new = t[:len(t) - q] + nxt[:q]
        a, b, c = shingles(t), shingles(new), shingles(nxt)
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and r["n_chars"] == len(t)
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.13 and abs(r["near_next"] - (len(a & c) / len(a | c) if a | c else 1)) < 0.13
        assert abs(r["n_distinct"] - len(a)) <= 0.25 * len(a)
        assert r["n_distinct"] == len(a) or len(a) >= fingerprint.K


def test_fingerprints_of_one_and_of_no_id(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h", None, None, None), (None, "x", None, None, None)], SCHEMA)
    got = rows(fingerprint.edited(one))
    assert got[5]["near_next"] == 1.0 and got[None]["near_next"] is None


def test_sketches_merge(spark):
    r = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.xxhash64(i)).alias("w")).select("w", F.slice("w", 1, 2004).alias("x"), F.slice("w", 2001, 1000).alias("y"))
    parts = r.select(fingerprint.sketch(F.col("w")).alias("a"), fingerprint.sketch(F.col("x")).alias("b"), fingerprint.sketch(F.col("y")).alias("c"))
    m = parts.select("a", fingerprint.merge(F.col("b"), F.col("c")).alias("m"), fingerprint.containment(F.col("b"), F.col("a")).alias("in"), fingerprint.distinct(F.col("a")).alias("n")).first()
    assert m["a"] == m["m"] and m["in"] > 0.85 and abs(m["n"] - 2996) < 600


def test_token_counts(docs):
    path = vocabulary("byte_bpe_50k.tiktoken")
    n = [r["n_tokens"] for r in token_counts.lengths(docs, path).collect()]
    sums = token_counts.token_counts(clash(docs), path)
    for r in sums.collect():
        at = r["n_tokens"]
        assert (r["docs_at_least"], r["tokens_at_least"], r["truncated_total"]) == (sum(x >= at for x in n), sum(x for x in n if x >= at), sum(min(x, at) for x in n))
        assert r["quantile"] == pytest.approx(sum(x <= at for x in n) / len(n))
    got = {r["context"]: tuple(r)[1:] for r in token_counts.at_limits(sums, [1, 100, 10 ** 6]).collect()}
    assert got == {c: (len(n), sum(n), sum(min(x, c) for x in n), sum(x > c for x in n)) for c in (1, 100, 10 ** 6)}


def test_packing(docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t, got = Tokenizer.from_file(path), packing.pack(clash(docs), path, 256).toPandas()
    source = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for d, g in got.dropna(subset="doc_id").groupby("doc_id"):
        ids, g = np.array([*t.encode(source[d], add_special_tokens=False).ids, 1], "<u4"), g.sort_values("piece")
        assert list(g["length"].cumsum()) == [*(g["start"].tolist()[1:]), len(ids)] and (g["length"].iloc[:-1] == 256).all()
        assert list(g["ids_crc32"]) == [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(g["start"], g["length"])]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= 1 + 1.02 * got["length"].sum() / 256


def test_packing_fills_best():
    assert sum(n * k for n, k in packing.fullest(10, [7, 6, 4, 3], {7: 1, 6: 1, 4: 1, 3: 1})) == 10 and packing.fullest(9, [8, 5, 2], {8: 1, 5: 1, 2: 3}) == [(5, 1), (2, 2)]
    assert sum(times for times, _ in packing.plan({60: 3, 40: 3, 50: 2, 100: 1}, 100)) == 5


def test_language(spark):
    words = {"aa": "alpha anna banana cabana", "bb": "zyzzy xylk wyxyz vukz", "cc": "привет мир слово дом"}
    data = [(i, " ".join(random.Random(i).choices(words[n].split(), k=12)), n, None, None) for i, n in enumerate(sorted(words) * 40)]
    d = spark.createDataFrame([*data, (900, None, None, None, None), (901, "12 ?!", "aa", None, None)], SCHEMA)
    got = rows(langid.language_id(clash(d)))
    assert all(got[i]["lang_pred"] == n for i, _, n, _, _ in data) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    model = langid.fit(d)
    assert [s[2] for s in model.label("alpha banana anna cabana alpha anna zyzzy xylk wyxyz vukz zyzzy xylk")[2]] == ["aa", "bb"]


def test_quality_statistics(docs, labels):
    got = rows(quality.judge(clash(docs), labels))
    for r in docs.where("doc_id is not null").collect():
        t = r["text"] or ""
        w = t.encode().split()
        windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        cover = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)} if len(windows) < 400 else None
        lines = [x for x in t.split("\n") if x.encode().strip()]
        g = got[r["doc_id"]]
        assert g["n_words"] == len(w) and g["n_symbols"] == sum(map(t.count, "#*$%&|<>")) and g["n_dup_lines"] == len(lines) - len(set(lines))
        assert g["word_chars"] == sum(len(x.decode()) for x in w) and (cover is None or g["n_repeat_words"] == len(cover))
        assert g["base_failed"] == (len(w) < 20 or 100 * g["n_repeat_words"] > 30 * len(w)) and not (g["base_failed"] and g["kept"])


def test_quality_learns_a_threshold():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(2000), "b": rng.random(2000)}
    low = x["a"] > 0.7
    rules = quality.learn(x, low)
    hit = np.any([quality.covered(r, x, 2000) for r in rules], 0)
    assert (hit == low).mean() > 0.97


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode(clash(docs), path, ids=True)
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, r in rows(got).items():
        assert r["ids"] == sp.encode(source[d] or "") and r["round_trip"] == ("▁" not in (source[d] or ""))
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got, path).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in source.items())


def test_toxicity(spark):
    def text(i):
        w = random.Random(i).choices(WORDS, k=30)
        return " ".join([*w, *(random.Random(-i).sample(["idiot", "vile", "scumbag", "moron"], 2) if i % 4 == 0 else [])])

    d = spark.createDataFrame([(i, text(i), None, None, None) for i in range(400)] + [(1000, None, None, None, None)], SCHEMA)
    l = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], LABELS)
    got = rows(toxicity.scores(clash(d), toxicity.fit(d, l)))
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(400)) and got[1000]["predicted"] == 0
    assert toxicity.keep_clean(clash(d), l).columns == clash(d).columns


def test_empty_tables(spark, empty):
    d, l = empty
    word, piece, byte = (vocabulary(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    for df in (simhash.near_duplicates(d), line_dedup.dedup(d), fingerprint.edited(d), token_counts.token_counts(d, byte), packing.pack(d, word), langid.language_id(d), quality.judge(d, l), pieces.encode(d, piece), toxicity.scores(d, toxicity.fit(d, l))):
        assert df.count() == 0


def test_repeated_rows(docs, labels):
    two, n = docs.union(docs), docs.count()
    for df in (simhash.near_duplicates(two), line_dedup.dedup(two), fingerprint.edited(two), langid.language_id(two), quality.judge(two, labels)):
        assert df.count() == 2 * n


def test_pipeline_stages(spark, docs, labels, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns and out.count() <= at.count(), name
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0
