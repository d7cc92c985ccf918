"""The training-data operators against brute force on small inputs with awkward rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siteweave.llm import backoff, decontamination, html_blocks, html_template, importance, lsh_forest, packing, set_join, sharding, token_counts, toxicity
from siteweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, shard string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    long = "alpha beta gamma delta " * 3000
    rows = [(1, "the quick brown fox jumps over the lazy dog today", "en", "a", None, None), (2, "the quick brown fox jumps over the lazy dog today", "en", "a", "x", "y"), (3, None, None, None, None, None), (4, "", "en", "b", None, None), (5, long, "en", "a", None, None), (6, " \n\t ", "en", "b", None, None), (None, "no id here", "en", "a", None, None), (7, "one", "en", "a", None, None), (7, "one", "en", "a", None, None), (8, "Ünïcode «quotes» <|endoftext|>  double  spaces\n\n x", "fr", "a", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_shards_are_even_and_gapless(docs):
    got = sharding.interleave(docs, shards=3, bucket_rows=2).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == docs.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.interleave(docs.limit(0), 3).count() == 0


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string"), 8, bucket_rows=100).collect()
    total = Counter(s for _, s in rows)
    for k in range(8):
        own = Counter(r["source"] for r in got if r["shard"] == k)
        assert all(abs(own[s] - n / 8) <= 3 for s, n in total.items())


def test_small_sources_are_spread(spark):
    rows = [(i, "hot" if i < 4000 else f"s{i}") for i in range(4400)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string"), 8, bucket_rows=100).collect()
    lone = Counter(r["shard"] for r in got if r["source"] != "hot")
    assert len(got) == 4400 and min(lone[k] for k in range(8)) >= 25
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(550)) for k in range(8))


def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for r in token_counts.count_tokens(docs, tokenizer_path()).collect():
        x = r["text"] or ""
        assert r["n_tokens"] == len(t.encode(x, add_special_tokens=False).ids) and r["n_bytes"] == len(x.encode())
    assert token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).count() == docs.count()


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), room=64, keep_ids=True).collect()
    per, seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        per[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    for r in docs.distinct().collect():
        want = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        whole = sorted({(p["start"], bytes(p["ids"])) for p in per[r["doc_id"]]})
        assert np.frombuffer(b"".join(x for _, x in whole), np.uint32).tolist() == want


def test_first_fit_decreasing_takes_the_first_bin():
    sizes = np.random.default_rng(1).integers(1, 100, 300).tolist()
    bins, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, room in enumerate(bins) if room >= sizes[i]), len(bins))
        if k == len(bins):
            bins.append(100)
        bins[k] -= sizes[i]
        want[i] = k
    assert [k for k, _ in packing.first_fit_decreasing(sizes, 100)] == [want[i] for i in range(300)]


def test_wu_manber_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(0, 14)))) for i in range(20)] + [(99, None), (None, "w1 w2")]
    texts = [(i, " ".join(rng.choice(vocab, 60))) for i in range(40)] + [(100, None), (101, "")]
    for x in (3, 7):
        texts.append((200 + x, "W0, " + (items[x][1] or "") + "! end"))
    got = decontamination.find_windows(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    two = decontamination.find_windows(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, block_windows=60).collect()
    assert sorted(map(str, got)) == sorted(map(str, two))
    for r in got:
        words = decontamination.words_of((r["text"] or "").encode())
        hit, seen = set(), set()
        for i, t in items:
            w = decontamination.words_of((t or "").encode())
            if i is None or not w:
                continue
            for k in range(max(1, len(w) - 3)):
                win = w[k : k + 4]
                for a in range(len(words) - len(win) + 1):
                    if words[a : a + len(win)] == win:
                        hit.update(range(a, a + len(win)))
                        seen.add(i)
        assert {p for s in r["spans"] for p in range(s["first"], s["after"])} == hit and set(r["items"]) == seen and r["n_words"] == len(words)


def brute_components(texts, percent=85):
    sets = {i: set(set_join.shingles((t or "").encode(), 4, {}).tolist()) for i, t in texts}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("block", "weight"), [(4000, 2_000_000), (7, 2_000_000), (3, 2_000_000), (4000, 300)])
def test_jaccard_components_equal_brute_force(spark, block, weight):
    rng = np.random.default_rng(3)
    texts = [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "a b c d e")]
    for g in range(12):
        n = int(rng.choice([8, 30, 120, 400]))
        base = [f"w{x}" for x in rng.integers(0, 4000, n)]
        for k in range(6):
            t = list(base)
            for p in rng.integers(0, n, int(rng.integers(0, max(2, n // 20)))):
                t[p] = f"z{rng.integers(0, 9999)}"
            texts.append((g * 10 + k, " ".join(t)))
    # A passage that many otherwise different texts share leads keys from one to the next.
    shared = " ".join(f"p{x}" for x in range(40))
    texts += [(600 + i, shared + " " + " ".join(f"q{x}" for x in rng.integers(0, 9999, 20))) for i in range(40)]
    got = set_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), block_sets=block, block_shingles=weight)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_components(texts)


def test_rows_that_share_a_key_share_their_links(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (5, b), (9, b), (9, None), (7, "c d e f g"), (None, a), (8, a + " x")]
    got = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in set_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 27), (5, 1, 27), (9, 1, 27), (9, 1, 0), (7, 7, 2), (None, None, 27), (8, 1, 28)}


def test_forest_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (None, x[1].tolist())]
    got = lsh_forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", forest_rows=300).collect()
    ids, v = np.array([r[0] for r in rows[:640]]), np.array([r[1] for r in rows[:640]])
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[list(ids).index(q)]
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hit += len(set(want) & set(found[q]))
        assert len(found[q]) == 20 and max(found[q]) < 2000
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.9
    assert found[0] == list(range(1000, 1020))


def test_forest_recall_on_a_whole_forest(spark):
    x = np.random.default_rng(12).standard_normal((16_384, 64)) / 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in lsh_forest.neighbours(df, "vec_id % 160 = 0").collect():
        found[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, len(x), 160):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (20 * len(range(0, len(x), 160))) >= 0.9


def test_html_keeps_the_article():
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>two<br>three<p>Four</p><div class="comments"><p>Nice</p></div><form><input>Go</form></article><footer>&copy; x</footer>'
    assert [b.text for b in html_blocks.blocks(page) if not b.outside and b.main] == ["Head & line", "One two three", "Four"]


def test_html_rows_and_nulls(spark):
    rows = [(i, f"http://h/{i}", f"<body><div>Same banner text</div><p>Own text {i} of this page</p></body>") for i in range(6)] + [(10, None, None), (11, "x", "plain &lt; text")]
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3 of this page" and got[10] == "" and got[11] == "plain < text"


def test_toxicity_learns_and_folds(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(300):
        words = [f"word{chr(97 + x)}" for x in rng.integers(0, 20, 40)]
        if i % 5 == 0:
            words[3] = words[9] = "idiotic"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (900, "what an 1dіotic thing"), (901, None), (902, "")], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(300))
    assert got[900]["predicted"] == 1 and got[901]["predicted"] == 0 and got[902]["score"] == got[901]["score"]
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0


def test_importance_parts_the_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = importance.resample(d, importance.fit(d, l)).join(l, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.03 * n[1, True] and n.get((0, True), 0) <= 0.2 * n[0, False]


def test_kth_largest(spark):
    v = np.random.default_rng(6).standard_normal(999).round(2)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    for k in (1, 10, 500, 999):
        assert importance.kth_largest(df, "x", k, bins=7) == sorted(v, reverse=True)[k - 1]


def test_backoff_on_awkward_rows(docs):
    got = {r["doc_id"]: r for r in backoff.score(docs).collect()}
    assert got[3]["n_words"] == 0 and got[3]["log_score"] == 0 and got[3]["mean_log_score"] is None
    assert got[7]["n_words"] == 2 and None in got
    assert backoff.score(docs.limit(0)).count() == 0


def test_all_take_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_windows(docs, bench).where("size(spans) > 0").count() == 0
    assert set_join.jaccard_components(none).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert lsh_forest.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>"), "true").count() == 0
    assert html_template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
