"""Brute-force versions of operators 1, 7 and 9 and of the pipeline, and awkward rows for every operator."""

import math
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteweave.llm import backoff, decontamination, html_template, importance, lsh_forest, packing, set_join, sharding, token_counts, toxicity
from siteweave.llm.queries import tokenizer_path

#: Names that operators give to what they add.
CLASHES = ("shard", "slot", "score", "predicted", "kept", "log_weight", "gumbel_key", "n_grams", "n_words", "spans", "items", "start", "offset", "length", "n_tokens", "n_bytes", "over_limit", "component_id", "n_shingles", "k", "c", "h", "t", "g", "row", "rank", "text_crc32", "tokens", "host")
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


def awkward(spark, rows):
    """The rows (doc_id, text) with a column of every clashing name."""
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    return df.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in CLASHES})


ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (None, "no id at all here"), (None, None), (6, "Ünï \u0000 code"), (7, "one two three four five six")]


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark, ROWS).cache()


def labels(spark, rows=()):
    return spark.createDataFrame([*rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("empty", [False, True])
def test_every_operator_takes_awkward_rows(spark, docs, empty):
    df = docs.limit(0) if empty else docs
    n = 0 if empty else len(ROWS)
    some = labels(spark) if empty else labels(spark, [(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None), (1, 1, 0), (6, 0, 1)])
    placed = sharding.interleave(df, 3)
    assert placed.count() == n and placed.columns == [*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot"]
    assert packing.pack(df, tokenizer_path()).select("doc_id", "doc_tokens", "start").where("start = 0").count() == n
    bench = spark.createDataFrame([(1, "three four five"), (2, None), (None, "one two"), (3, "")], "item_id long, text string")
    found = decontamination.find_windows(df, bench.limit(0) if empty else bench)
    assert found.where("size(spans) > 0").count() == (0 if empty else 3) and found.count() == n
    assert "kept" in found.columns and dict(found.dtypes)["n_words"] == "bigint"
    counted = token_counts.count_tokens(df, tokenizer_path())
    assert counted.count() == n and counted.where("text is null and n_tokens <> 0").count() == 0
    kept = importance.resample(df, importance.fit(df, some))
    assert kept.count() == n and dict(kept.dtypes)["kept"] == "boolean"
    assert importance.resample(df, importance.fit(df, some), keep=["doc_id"]).columns == ["doc_id", "n_grams", "log_weight", "gumbel_key", "kept"]
    scored = toxicity.score(df, toxicity.fit(df, some))
    assert scored.count() == n and scored.where("score is null or predicted is null").count() == 0
    keys = 0 if empty else len({r[0] for r in ROWS})
    assert backoff.score(df).count() == keys and backoff.score(df, least=2).count() == keys
    linked = {r["doc_id"]: r["component_id"] for r in set_join.jaccard_components(df).collect()}
    assert len(linked) == keys and (empty or linked[7] == 1 and linked[5] == 5 and linked[None] is None)


def test_repeated_null_and_clashing_rows_of_the_other_tables(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<p>a</p>", "x", "y"), (1, "http://h/1", "<p>a</p>", "x", "y"), (None, None, None, None, None), (2, "http://h/2", "", "x", "y")], "page_id long, url string, html string, tokens string, host string")
    got = html_template.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r["text"] for r in got.collect()) == ["", "", "a", "a"]
    v = spark.createDataFrame([(0, [1.0, 0.0], 1, "f"), (0, [1.0, 0.0], 1, "f"), (1, [2.0, 0.0], 1, "f"), (2, [1.0], 1, "f")], "vec_id long, embedding array<double>, rank int, f string")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in lsh_forest.neighbours(v, "vec_id = 0").collect()] == [(0, 1, 2.0)]


def test_interleaving_equals_brute_force(spark):
    rng = np.random.default_rng(20)
    rows = [(i, str(rng.choice(["hot", "hot", "hot", "mid", f"s{i % 9}"])), f"t{i % 50}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    hashed = df.select("doc_id", "source", F.xxhash64(F.lit(7), "doc_id", "doc_id", "source", "text").alias("h")).collect()
    phase = {r["source"]: r["u"] for r in df.select("source", (F.pmod(F.xxhash64(F.lit(7), "source"), F.lit(sharding.PHASES - 1)) + 1).alias("u")).distinct().collect()}
    by = defaultdict(list)
    for r in hashed:
        by[r["source"]].append(((r["h"] % (1 << 64)) >> 33, r["h"], r["doc_id"]))
    order = []
    for s, own in by.items():
        # Buckets follow the top bits as an unsigned number, rows in a bucket the signed hash.
        own.sort(key=lambda x: (x[0] * 9 >> 31, x[1]))
        order += [(Fraction(sharding.PHASES * (k + 1) - phase[s], sharding.PHASES * len(own)), s, k, i) for k, (_, _, i) in enumerate(own)]
    order.sort()
    want = {}
    for place, (_, _, _, i) in enumerate(order):
        shard = place * 4 // 900
        want[i] = (shard, place - -(-shard * 900 // 4))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(df, 4, bucket_rows=100).collect()}
    assert got == want
    other = {r["doc_id"]: r["shard"] for r in sharding.interleave(df, 4, seed=8).collect()}
    assert 0.15 < sum(other[i] == s for i, (s, _) in want.items()) / 900 < 0.35


def test_importance_weights_equal_brute_force(spark):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[:40] if i % 3 else words[20:], int(rng.integers(5, 60))))) for i in range(300)] + [(900, None), (901, "")]
    marks = [(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)
    model = importance.fit(df, lab)
    part = {r["doc_id"]: r["p"] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(5)).alias("p")).collect()}
    grams = {i: importance.ngram_buckets((t or "").encode(), {}).tolist() for i, t in rows}
    raw, target = Counter(), Counter()
    for i, _ in rows:
        raw.update(grams[i])
    for i, q, _ in marks:
        if q and part[i] > 0:
            target.update(grams[i])
    n, m, b = sum(raw.values()), sum(target.values()), importance.BUCKETS
    shape = lambda g: (raw[g] + 1) / (n + b)
    ratio = {g: math.log((target[g] + b * shape(g)) / (m + b) / shape(g)) for g in raw}
    means = lambda value: [sum(ratio[g] for g in grams[i]) / len(grams[i]) for i, q, _ in marks if q == value and (not q or part[i] == 0)]
    cut = importance.best_cut(np.array(means(1)), np.array(means(0)))
    got = {r["doc_id"]: r for r in importance.resample(df, model).collect()}
    for i, _ in rows:
        assert abs(got[i]["log_weight"] - sum(ratio[g] - cut for g in grams[i])) < 1e-3
    k = sum(r["log_weight"] >= 0 for r in got.values())
    assert {i for i, r in got.items() if r["kept"]} == set(sorted(got, key=lambda i: -got[i]["gumbel_key"])[:k])


def test_gumbel_top_k_samples_by_weight(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("text"))
    ratios = np.zeros(importance.BUCKETS, np.float32)
    ratios[importance.ngram_buckets(b"a", {})] = math.log(3)
    got = {r["text"]: r["n"] for r in importance.resample(df, importance.Model(ratios), share=0.1).where("kept").groupBy("text").agg(F.count("*").alias("n")).collect()}
    assert got["a"] + got["b"] == 400 and 2.2 < got["a"] / got["b"] < 4.2


def test_terms_are_the_longest_forms_that_the_evidence_bears_out():
    p, q = 400, 4000
    toxic = {f" {w[:k]}": n for w, n in (("trash", 60), ("idiot", 90)) for k in range(3, 6)} | {" trash ": 60, " idiot ": 50, " idiots ": 40, " the ": 390, " rare ": 3}
    clean = {" tra": 20, " the ": 3900}
    assert set(toxicity.chosen(toxic, clean, p, q)) == {" trash ", " idiot"}
    lexicon = toxicity.Lexicon(toxicity.chosen(toxic, clean, p, q))
    found = lambda x: toxicity.features(lexicon.matcher(), x)[0] > 0
    assert found("You TR4SH") and found("ıdіotic") and not found("traffic, translate, tradition, idiom")
    assert not found("put it into the trash can") and found("the trash can of a trash man")


def test_features_equal_brute_force_and_are_linear():
    rng = np.random.default_rng(22)
    lexicon = toxicity.Lexicon({" bad ": 2.0, " ba": 1.0, " can": 0.5}, ("bad luck", "luck can bad"))
    automaton = lexicon.matcher()
    for _ in range(300):
        t = " ".join(rng.choice(["bad", "luck", "can", "bald", "x"], int(rng.integers(0, 15))))
        f = toxicity.folded(t)
        covers = [(a, a + len(p) + 2) for p in lexicon.exceptions for a in range(len(f)) if f.startswith(f" {p} ", a)]
        best = {}
        for term, w in lexicon.weights.items():
            for a in range(len(f)):
                if f.startswith(term, a) and not any(x <= a and a + len(term) <= y for x, y in covers):
                    best[a] = max(w, best.get(a, 0))
        assert abs(toxicity.features(automaton, t)[0] - math.log1p(sum(best.values()))) < 1e-12
    began = time.time()
    toxicity.features(automaton, "bad luck " * 200_000)
    assert time.time() - began < 20


def test_prose_that_shares_starts_with_insults_is_left_alone(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(d, l)
    prose = ["A quiet morning in the garden with tea.", "Traffic was closed in the morning; distances more than expected.", "the cat sat " * 200 + "translate", "The pathologist has lost the path."]
    got = toxicity.score(spark.createDataFrame([(x,) for x in prose], "text string"), lexicon).collect()
    assert [r["predicted"] for r in got] == [0] * len(prose)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(23)
    vocab = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    bench = [(i, " ".join(rng.choice(vocab, 30))) for i in range(5)]
    texts, marks = {}, []
    for i in range(400):
        kind = i % 8
        words = list(rng.choice(vocab, int(rng.integers(20, 120))))
        if kind == 1:
            words[4] = words[9] = "moron"
        if kind == 2:
            words = [f"{w}@@{x}##" for w, x in zip(words, rng.integers(0, 9999, len(words)), strict=True)]
        if kind == 3:
            words = texts[i - 3].split()
            words[5] = "changed"
        if kind == 4:
            words[3:3] = bench[i % 5][1].split()[5:20]
        texts[i] = " ".join(words)
        marks.append((i, int(kind != 2), int(kind == 1)))
    rows = [*texts.items(), (500, None), (501, ""), (None, "no id"), (0, texts[0])]
    awkward(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, marks).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sf, now = str(tmp_path), docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != "packing":
            assert now.schema == docs.schema or now.dtypes == docs.dtypes
        now = now.cache()
        out[name] = Counter((r["doc_id"], r["text"]) for r in now.collect()) if name != "packing" else now.collect()
        assert name == "packing" or all(r["score"] == f"score {r['doc_id']}" for r in now.collect() if r["doc_id"] is not None)
    given = Counter(rows)
    kinds = lambda c: Counter(i % 8 if i is not None and i < 400 else i for i, _ in c.elements())
    assert out["toxicity"] == Counter({k: n for k, n in given.items() if "moron" not in (k[1] or "")})
    left = kinds(out["quality"])
    assert left[2] <= 2 and left[0] + left[4] + left[5] >= 145 and left[500] == left[501] == 1
    sets = {i: set(set_join.shingles((t or "").encode(), 5, {}).tolist()) for i, t in out["quality"] if i is not None}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert out["near_copies"] == Counter({k: n for k, n in out["quality"].items() if k[0] is None or root[k[0]] == k[0]})
    windows = {tuple(t.split()[i : i + 10]) for _, t in bench for i in range(21)}
    hit = lambda t: any(tuple((t or "").lower().split()[i : i + 10]) in windows for i in range(len((t or "").split())))
    assert out["decontamination"] == Counter({k: n for k, n in out["near_copies"].items() if not hit(k[1])})
    assert sum(r["length"] for r in out["packing"]) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] * (out["decontamination"][(r["doc_id"], texts.get(r["doc_id"]))] or 1) for r in out["packing"]}.values())
    assert {r["doc_id"] for r in out["packing"]} == {i for i, _ in out["decontamination"]}
