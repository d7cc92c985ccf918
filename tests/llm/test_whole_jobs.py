"""Cases in which an operator once did less than its whole job."""

import math
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from siteweave.llm import backoff, html_blocks, html_template, set_join


def test_pipeline_drops_near_copies_at_08_of_5_words(spark):
    words = [f"w{i}" for i in range(49)]
    other = [*words[:20], "other", *words[21:]]  # 40 of 50 shingles of 5 words, 42 of 50 of 4
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "w1 w2 w3")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3}


@pytest.mark.parametrize(("percent", "sizes"), [(85, range(1, 60)), (85, (130, 200, 431, 1000)), (80, (7, 45, 300)), (50, (10, 90)), (100, (5, 50))])
def test_linked_sets_share_a_key_at_the_threshold(percent, sizes):
    rng = np.random.default_rng(10)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    for n in sizes:
        for _ in range(40):
            a = draw(n)
            extra = int(rng.integers(0, n * (100 - percent) // percent + 1))  # as many as still link, lost from a or added to it
            lost = max(0, next(k for k in range(len(a), -1, -1) if 100 * (n - k) >= percent * (n + extra)))
            b = np.sort(np.concatenate([a[rng.permutation(n)[lost:]], draw(extra)]))
            if len(b) and set_join.linked(n - lost, len(a), len(b), percent) and (lost or extra):
                assert np.intersect1d(set_join.meeting_keys(a, percent), set_join.meeting_keys(b, percent)).size


@pytest.mark.parametrize("percent", [20, 50, 80])
def test_lower_thresholds_lose_no_links_of_large_sets(spark, percent):
    rng = np.random.default_rng(8)
    texts, want = [], {}
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(400)]
        near = list(base)
        while True:
            a, b = (set(set_join.shingles(" ".join(x).encode(), 4, {}).tolist()) for x in (base, near))
            trial = list(near)
            trial[int(rng.integers(400))] = f"g{g}z{len(a & b)}"
            c = set(set_join.shingles(" ".join(trial).encode(), 4, {}).tolist())
            if 100 * len(a & c) < percent * len(a | c):
                break
            near = trial
        texts += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g}
    got = set_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), percent=percent)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def brute_scores(texts, corpus, order, least, alpha=0.4):
    lists = {i: (t or "").lower().split() for i, t in texts}
    counts = Counter()
    for _, t in corpus:
        w = (t or "").lower().split()
        counts.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1)

    def one(g):
        if len(g) == 1:
            return math.log(max(1, counts[g]) / total)
        return math.log(counts[g] / counts[g[:-1]]) if counts[g] >= least else math.log(alpha) + one(g[1:])

    return {i: (len(w), sum(one(tuple(w[max(0, j - order + 1) : j + 1])) for j in range(len(w)))) for i, w in lists.items()}


@pytest.mark.parametrize(("order", "least", "other"), [(2, 2, False), (2, 1, False), (3, 1, False), (3, 2, False), (3, 1, True), (4, 2, True), (1, 1, True)])
def test_backoff_equals_brute_force(spark, order, least, other):
    rng = np.random.default_rng(9)
    draw = lambda i, n: (i, " ".join(f"W{x}" for x in rng.integers(0, 12, n)))
    texts = [draw(i, int(rng.integers(1, 30))) for i in range(40)] + [(100, None), (101, " "), (102, "W3"), (103, "never seen w1 w2")]
    corpus = [draw(i, 20) for i in range(30)] if other else texts
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    got = backoff.score(frame(texts), frame(corpus) if other else None, order=order, least=least).collect()
    want = brute_scores(texts, corpus, order, least)
    assert len(got) == len(want)
    assert all(r["n_words"] == want[r["doc_id"]][0] and abs(r["log_score"] - want[r["doc_id"]][1]) < 1e-6 for r in got)


def test_rare_words_keep_their_own_counts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 1000, i * 1000 + 1000))) for i in range(70)] + [(100, "w69999 w0"), (101, "w69998")]
    got = {r["doc_id"]: r["log_score"] for r in backoff.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[101] - math.log(2 / 70003)) < 1e-9


def test_backoff_uses_every_count_above_0_up_to_trigrams(spark):
    corpus = [(1, "a b c"), (2, "a b d"), (3, "x b d")]
    texts = [(1, "a b c"), (2, "x b c")]  # one trigram that occurs once, one that backs off to such a bigram
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    got = {r["doc_id"]: r["log_score"] for r in backoff.score(frame(texts), frame(corpus)).collect()}
    assert abs(got[1] - math.log(2 / 9 * 2 / 2 * 1 / 2)) < 1e-9
    assert abs(got[2] - math.log(1 / 9 * 1 / 1 * 0.4 * 1 / 3)) < 1e-9


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar"><nav>Menu</nav><p>Own text</p></body>',
        '<body class="page no-sidebar"><article class="post has-share"><p>Own text</p><div class="share">Tweet</div></article></body>',
        '<body><div class="wrap header-large"><main><p>Own text</p></main><div class="comments">Many more words than the text itself has</div></div></body>',
        '<body><div class="wrap header-large"><div class="menu">Menu</div><h1>Own text</h1></div></body>',
        "<body><script>for(i=0;i<n;i++){x()}</script><p>Own text</p></body>",
        "<body><script>s = '<!--'; a<b</script><p>Own text</p><script>y()</script></body>",
        '<body><main><article class="post has-share"><p>Own text</p></article><article class="comment">Nice</article></main></body>',
        "<body><form><article><p>Own text</p></article></form></body>",
        "<body><noscript><p>Own text</p></body>",
        "<script>if(a<b){x=1}</script><p>Own text</p>",
        '<body class="comments-open"><article class="post header-image"><p>Own <span class="ad">Buy now</span> text</p></article></body>',
        '<article class="legal"><p title=\'it\'s\'>Own text</p></article><!-- open',
        '<div><p class="has-notice">Own text</p><div class="site-header">Name</div><ul id="main-menu2"><li>Menu</li></ul><div class="cookieNotice">We</div></div>',
        '<body><p title="no end>Own <b>text</b>',
    ],
)
def test_html_keeps_the_text_of_named_wrappers_and_after_scripts(page):
    assert [b.text for b in html_blocks.blocks(page) if not b.outside] == ["Own text"]


def test_html_time_is_linear():
    for piece in ('<p title="x>', "<p title='it's'>", "<canvas>", "<!--", "<div class='ad'>a", "<b>", "</p>", "<article><p>", "<a href=", "<"):
        began = time.time()
        html_blocks.blocks(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 30, piece


def brute_constants(pages):
    """Texts of a host's pages that occur alike with others, in one order everywhere: the constants, from whole pages and all pairs."""
    vectors, size = {}, {}
    lists = [html_template.token_sequence(x) for x in pages]
    for i, sequence in enumerate(lists):
        for t, n in Counter(t for t, _ in sequence).items():
            vectors.setdefault(t, {})[i] = n
            size[t] = dict(sequence)[t]
    out, classes = set(), {}
    for t, v in vectors.items():
        classes.setdefault(tuple(sorted(v.items())), []).append(t)
    often = {k: c for k, c in classes.items() if len(k) >= max(3, len(pages) / 2) and sum(size[t] for t in c) >= 3}
    of = {t: i for i, (k, c) in enumerate(often.items()) for t in c}
    held = {}
    for sequence in lists:
        for c, order, ok in html_template.checked_classes([t for t, _ in sequence], of):
            held.setdefault(c, set()).add((order, ok))
    for i, c in enumerate(often.values()):
        if len(held[i]) == 1 and next(iter(held[i]))[1]:
            out.update(c)
    return frozenset(out)


def test_template_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    rows, by = [], {}
    for i in range(200):
        host = f"h{int(rng.choice(5, p=[0.5, 0.2, 0.2, 0.08, 0.02]))}"
        parts = [f"<div>{host} {name} of the site</div>" for name in ("top", "middle", "end")]
        parts.insert(int(rng.integers(1, 3)), f"<article><h1>Title {i}</h1><p>{' '.join(rng.choice(['a', 'b', 'c'], 6))}</p><p>By a writer of ours</p></article>")
        x = f"<body>{''.join(parts)}{'<p>Sometimes this line</p>' * int(rng.integers(0, 3))}</body>"
        rows.append((i, f"http://{host}/{i}", x))
        by.setdefault(host, []).append(x)
    rows += [(1000 + i, f"http://h0/{i}", by["h0"][0]) for i in range(50)]  # copies
    known = {h: brute_constants(list(dict.fromkeys(xs))) if len(set(xs)) >= 4 else frozenset() for h, xs in by.items()}
    for limit in (html_template.BROADCAST_TOKENS, 0):
        html_template.BROADCAST_TOKENS, before = limit, html_template.BROADCAST_TOKENS
        try:
            got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        finally:
            html_template.BROADCAST_TOKENS = before
        assert len(got) == len(rows)
        assert all(got[i] == "\n\n".join(html_template.slots(x, known[u.split("/")[2]])) for i, u, x in rows)


def test_html_classes_decide_what_is_template(spark):
    long = "We value your privacy and so on. " * 20  # more than 400 characters, in a neutral element
    rows = [(i, f"http://h/{i}", f"<body><div>{long}</div><p>Own text {i}</p></body>") for i in range(6)]
    # On two of four pages: chance, not template.
    rows += [(10 + i, f"http://two/{i}", f"<article><p>Text {i} of this page</p>{'<p>A line of two pages</p>' * (i < 2)}</article>") for i in range(4)]
    # On all pages, but in changing order.
    pair = ["<p>One sentence of prose</p>", "<p>Another sentence of prose</p>"]
    rows += [(20 + i, f"http://order/{i}", f"<article><p>Page {i}</p>{''.join(pair[:: 1 if i % 2 else -1])}</article>") for i in range(6)]
    # Twice on every page.
    rows += [(30 + i, f"http://twice/{i}", f"<article><p>First {i}</p><p>Share this post now</p><p>Second {i}</p><p>Share this post now</p></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3" and got[10] == "Text 0 of this page\n\nA line of two pages"
    assert got[21] == "Page 1\n\nOne sentence of prose\n\nAnother sentence of prose"
    assert got[31] == "First 1\n\nSecond 1"


def test_html_classes_nest():
    a, b = [1, 2, 3], [7, 8]
    classes = dict.fromkeys(a, 100) | dict.fromkeys(b, 200)
    hold = lambda x: {c: ok for c, _, ok in html_template.checked_classes(x, classes)}
    assert hold([1, 7, 8, 2, 3]) == hold([1, 2, 3, 7, 8]) == hold([7, 1, 2, 3, 8]) == {100: True, 200: True}
    assert hold([1, 7, 2, 8, 3]) == {100: True, 200: False} and hold([1, 2, 3, 1, 3, 2]) == {100: False}


def test_sieve_keeps_every_row_that_the_join_finds(spark):
    """Texts without a group were all dealt out to meet the groups' ids; few of them are now, and none of a group is lost, even where the bits are too few."""
    rows = spark.createDataFrame([(i, "x") for i in [*range(-500, 2500), None]], "doc_id long, t string")
    ids = rows.where("doc_id % 10 = 3").select("doc_id")
    wanted = {r["doc_id"] for r in ids.collect()}
    for bits, most in ((1 << 14, 600), (100, 3001)):
        got = [r["doc_id"] for r in set_join.sieved(rows, ids, "doc_id", bits).collect()]
        assert wanted <= set(got) and len(got) == len(set(got)) <= most
    assert set_join.sieved(rows, ids.limit(0), "doc_id").count() == 0


def test_own_scores_deal_each_order_once(spark, monkeypatch):
    """Each order was dealt out for its counts and again for its documents; one exchange serves both now, with texts too short for it scored all the same."""
    texts = [(1, "a b c d a b c"), (2, " a  b "), (3, "a"), (4, ""), (5, None), (6, "b b b b"), (None, "a b c"), (1, "\tc\n"), (7, "c a")]
    plans = []
    kept = backoff.stored

    def told(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(backoff, "stored", told)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for order in (1, 2, 3, 4):
        own = {r["doc_id"]: r for r in backoff.score(df, order=order).collect()}
        other = {r["doc_id"]: r for r in backoff.score(df, df.select("*"), order=order).collect()}
        assert own.keys() == other.keys()
        for i, r in own.items():
            assert r["n_words"] == other[i]["n_words"] and abs(r["log_score"] - other[i]["log_score"]) < 1e-9
        # No n-gram of 4 words occurs twice here, so nothing is joined.
        assert order == 4 or "ReusedExchange" in plans[-1].split("Initial Plan")[0]


def test_keys_left_out_lose_no_link():
    """Sets now leave out their most frequent keys; two that link must keep one in common, whatever the frequencies, even the worst ones."""
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        for n in [*range(4, 40), 60, 100, 300, 800]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                change = rng.integers(0, n * (100 - percent) // 100 + 1)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[change:]], rng.integers(0, 2**64, rng.integers(0, change + 1), dtype=np.uint64)]))
                if not set_join.linked(np.intersect1d(a, b).size, len(a), len(b), percent) or np.array_equal(a, b):
                    continue
                marked = [set_join.marked_keys(x, percent) for x in (a, b)]
                both = set(np.intersect1d(*[k for k, _ in marked]).tolist())
                kept = []
                for keys, marks in marked:
                    rows = {}
                    for k, mark in zip(keys.tolist(), marks.tolist(), strict=True):
                        rows.setdefault(mark, []).append(k)
                    # The common keys count as the most frequent ones.
                    kept.append({k for mark, ks in rows.items() for k in sorted(ks, key=lambda k: (k not in both, k))[mark % set_join.MARK_SPARE :]})
                assert kept[0] & kept[1]


def test_a_common_phrase_chains_no_texts(spark, monkeypatch):
    """Texts of all sizes that held one phrase were one group of candidates, whose texts were sent once for each other part of it."""
    rng, phrase = np.random.default_rng(6), [f"p{i}" for i in range(12)]
    texts = [(i, " ".join([*(f"w{x}" for x in rng.integers(0, 10**9, 20 + i % 60)), *phrase])) for i in range(400)]
    texts += [(1000 + i, f"{t} more") for i, t in texts[:40]]
    kept, most, plans = set_join.stored, [], []

    def told(df):
        if "k" in df.columns:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = kept(df)
        if {"c", "g"} <= set(out.columns):
            most.append(max(r["count"] for r in out.groupBy("g").count().collect()))
        return out

    monkeypatch.setattr(set_join, "stored", told)
    got = {r["doc_id"]: r["component_id"] for r in set_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), shingle=5, percent=80).collect()}
    assert {i: g for i, g in got.items() if i != g} == {1000 + i: i for i in range(40)}
    assert most and most[0] <= 30
    assert len(plans) == 1 and "ReusedExchange" in plans[0]  # the keys are dealt out once
