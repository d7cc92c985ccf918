"""Operators 11 to 13: against SQL, against brute force, and with awkward rows."""

import hashlib
import heapq
import itertools
import random
import re
from collections import Counter

import duckdb
import pytest

from siteweave.llm import line_rules, queries, spelling, turns

DIR = "/root/testdata/sf0.001"
CLASHES = ("word", "n", "at", "other", "line", "kept", "n_words", "base_failed", "__row", "__host", "hash", "words", "place", "edit", "audit", "cost")


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize("name", ["op11_line_frequency", "op12_turn_repair", "op13_spelling_variants"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    found = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols and len(got) >= 10
    assert got == sorted((tuple(r[names.index(k)] for k in cols) for r in found.fetchall()), key=repr)


# lines


def brute_lines(rows, docs_limit, percent):
    """(n_words, n_dup_lines, n_repeat_words, n_common_words) of each row (host, text)."""
    normal = lambda x: " ".join(re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in x)).split(" "))
    have, hosts = Counter(), Counter(h for h, _ in rows)
    for h, t in rows:
        have.update({(h, normal(x)) for x in (t or "").split("\n") if x.split()})
    out = []
    for h, t in rows:
        words, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.split()]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
        common = sum(len(x.split()) for x in lines if have[h, normal(x)] > docs_limit and 100 * have[h, normal(x)] > percent * hosts[h])
        out.append((len(words), len(lines) - len(set(lines)), len(inside), common))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["a", "B", "c7", "d", "é"]) for _ in range(rng.randint(1, 12)))
    shared = [line() for _ in range(12)]
    rows = [(rng.choice(["hot", "hot", "x", None, ""]), "\n".join(rng.choice(shared) if rng.random() < 0.5 else line() for _ in range(rng.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["n_common_words"]) for r in line_rules.judge(df, docs_limit=6, percent=10).collect()}
    want = brute_lines(rows, 6, 10)
    assert got == dict(enumerate(want)) and sum(w[3] for w in want) > 100


def test_depleted_documents_go_and_clean_ones_stay(spark):
    menu = "Home | News | Contact us now 2019"
    fill = lambda i: " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(30))
    rows = [(i, "h", f"{menu}\n{fill(i)}") for i in range(40)] + [(100 + i, "h", "\n".join([menu] * 9) + "\nfive words of its own") for i in range(3)] + [(200, "elsewhere", "\n".join([menu] * 4))]
    got = {r["doc_id"]: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string"), clean=True).collect()}
    assert all(got[i]["kept"] and got[i]["clean_text"] == fill(i) and got[i]["n_common_words"] == 8 for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(3)) and got[100]["n_dup_lines"] == 8
    assert got[200]["n_common_words"] == 0 and got[200]["clean_text"] == rows[-1][2]


def test_lines_take_awkward_rows(spark):
    long = "lorem ipsum dolor sit amet\n" * 100_000
    rows = [(1, "s", "one two"), (1, "s", "one two"), (2, None, None), (3, "", ""), (None, None, " \n\t"), (4, "s", long), (5, "s", "a\r\nb\x0bc")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = line_rules.judge(df, clean=True)
    assert got.count() == len(rows) and "word" in got.columns and "text" not in got.columns
    by = {(r["doc_id"], r["source"]): r for r in got.collect()}
    assert by[4, "s"]["base_failed"] and by[4, "s"]["n_words"] == 500_000 and by[4, "s"]["n_dup_lines"] == 99_999
    assert by[2, None]["clean_text"] is None and by[None, None]["n_words"] == 0 and by[5, "s"]["n_words"] == 3 and by[1, "s"]["at"] == "own at"
    assert line_rules.judge(df.limit(0)).count() == 0


# turns


def brute_repair(rows):
    """(cost, audit, digest) by shortest paths over whole audits."""
    seen, kinds = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        bound = not said or (role, text) in seen
        kinds.append((bound, not bound and said[-1] not in ".!?"))
        seen.add((role, text))
    begun, whole = re.compile(r"s?(ua)*u?$"), re.compile(r"(s?(ua)+)?$")
    heap, best, done = [(0, "", 0, "", ())], None, set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if (audit, i) in done or len(audit) > 2 * len(rows) + 4:
            continue
        done.add((audit, i))
        if i == len(rows) and whole.match(roles):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
            continue
        steps = [("I", 2, r, "", i) for r in ("user", "assistant")]
        if i < len(rows):
            (role, text), (bound, cut) = rows[i], kinds[i]
            steps += [("D", 3, None, "", i + 1)] + ([] if bound else [("K", cut, role, text, i + 1)] + [("R", 2 + cut, r, text, i + 1) for r in ("user", "assistant")])
        for edit, price, role, text, after in steps:
            if role is None or role[:1] in tuple("sua") and begun.match(roles + role[:1]):
                heapq.heappush(heap, (cost + price, audit + edit, after, roles + (role or "")[:1], out + (() if role is None else (f"{role}:{text}",))))
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def test_repairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(turns, "BLOCK", 3)
    monkeypatch.setattr(turns, "SPILL", 16)
    monkeypatch.setattr(turns, "SEEN", 2)
    for _ in range(600):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b!", "c", " ", "d?", "e", "f. "])) for _ in range(rng.randint(0, 6))]
        now = turns.Conversation(1)
        for i, (role, text) in enumerate(rows):
            now.add(i, role, text)
        edits = list(now.edits())
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for e, r, t in edits if e != "D").encode()).hexdigest()
        assert (now.cost, "".join(e for e, _, _ in edits), digest) == brute_repair(rows)
        now.close()


def test_a_giant_conversation_spills(spark):
    from pyspark.sql import functions as F

    n = 60_000
    hot = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.repeat(F.lit("word "), 40), "id", F.lit(".")).alias("text"))
    others = spark.range(300).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text")).where("conv_id <> 7")
    got = {r["conv_id"]: r for r in turns.repair_report(hot.where("turn <> 31000").union(others)).collect()}
    assert len(got) == 300 and got[7]["gaps"] == 1 and got[7]["illegal"] == 1 and got[7]["cost"] == 2 and got[7]["audit"] == "K" * 31000 + "I" + "K" * (n - 31001)
    assert got[8]["audit"] == "KI" and got[8]["cost"] == 2
    kept = turns.repaired_turns(hot.where("turn <> 31000"))
    assert kept.count() == n and kept.where("edit = 'I'").select("place", "role").first() == (31000, "user")


def test_turns_take_awkward_rows(spark):
    rows = [(1, None, "user", None), (1, 0, None, "Hi."), (1, 0, None, "Hi."), (1, 5, "assistant", "Yes."), (None, None, None, None), (2, 3, "", "x" * 300_000 + "."), (3, 0, "system", "Be brief."), (3, 1, "user", "Go\u0000"), (3, 2, "assistant", "No.")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in turns.repair_report(df).collect()}
    assert (got[1]["gaps"], got[1]["blank"], got[1]["duplicate"]) == (4, 1, 1) and got[1]["audit"] == "DRDK"
    assert got[None]["audit"] == "D" and got[None]["gaps"] == 0 and got[2]["audit"] == "D" and got[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["audit"] == "KKK" and got[3]["cost"] == 1 and got[3]["truncated"] == 1
    assert turns.repair_report(df.limit(0)).count() == 0 and turns.repaired_turns(df).where("conv_id = 3").count() == 3


# words


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_pivots_equal_brute_force():
    rng = random.Random(2)
    for _ in range(500):
        places = sorted(rng.sample(range(15), rng.randint(3, 8)))
        weights = [rng.randint(1, 9) for _ in places]
        able = [weights[i] + weights[j] for i, j in itertools.combinations(range(len(places)), 2) if places[j] - places[i] > 1]
        a, b = spelling.pivots(places, weights, 2)
        assert b - a > 1 and weights[places.index(a)] + weights[places.index(b)] == min(able)


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_near_pairs_equal_brute_force(spark, letters):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(500)} | {"aaaa", "aaaaa", "aaaaaa"})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = sorted((r["word"], r["other"], r["n"]) for r in spelling.near_pairs(df).collect())
    assert got == sorted((a, b, words.index(b) + 1) for a in words for b in words if one_edit(a, b)) and len(got) > 500


def test_keys_of_words_are_not_broadcast_however_small_the_file_of_words_is(spark, tmp_path):
    spark.createDataFrame([("example", 9), ("exampel", 5), ("sample", 5)], "word string, n long").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    plan = spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_forms_and_roots(spark):
    rows = [("abcdefg", 10_000), ("abcdefgh", 900), ("abcdefghi", 100), ("abcdefghij", 11), ("zbcdefg", 10_000), ("other", 5), ("abcdefx", 9000)]
    got = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.variant_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["abcdefghij"] == ("abcdefghi", "abcdefg", 1, 100) and got["abcdefgh"] == ("abcdefg", "abcdefg", 2, 10_000)
    assert got["other"] == (None, "other", 0, None) and got["abcdefg"] == (None, "abcdefg", 3, None) and got["abcdefx"][2] == 1


def test_words_take_awkward_rows(spark):
    long = "Wörter straße ÷×÷×÷×÷ " * 50_000
    rows = [(1, "letters letters"), (1, "letters letters"), (2, None), (3, ""), (None, "LETTERS, letter5s Łetters"), (4, long)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["word"]: r["n"] for r in spelling.count_words(df, least=2).collect()}
    assert got == {"letters": 5, "wörter": 50_000, "straße": 50_000, "÷×÷×÷×÷": 50_000}
    assert spelling.variant_groups(spelling.count_words(df.limit(0))).count() == 0
    lost = {r["word"]: r["n"] for r in spelling.count_words(df, least=1, lose=1).collect()}
    assert sum(lost.values()) == 50_005 and all(len(w) >= 6 for w in lost)  # every run lost a letter; those of six are too short
