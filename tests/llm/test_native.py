"""Rule ledger, url filter, chat pairs and sharding against plain Python."""
import re

import pytest
from pyspark.sql import functions as F

from churnlens.llm import chat_format as chat
from churnlens.llm import quality_rules as rules
from churnlens.llm import sharding
from churnlens.llm import url_filter as urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a b c d a b c", "x x x x", "l one\nl one\n\n l one\nother", "é ü z | | #!",
         " ".join(["same"] * 60), " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}!!" for i in range(60)), LONG]


def measured(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_ledger_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.ledger(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(t), t and t[:40]
        assert bool(r.fail_bits & 1) == (r.n_words < 50)
        assert bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 50 * r.n_words)


def test_ledger_of_no_rows_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert rules.ledger(spark.createDataFrame([], schema)).count() == 0
    twice = rules.ledger(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], schema)).select("n_words", "fail_bits").distinct()
    assert twice.count() == 1


def test_policies_and_ablations(spark):
    book = spark.createDataFrame([(0,), (0,), (1,), (4,), (5,), (2,)], "fail_bits long")
    assert book.where(rules.kept_by("base")).count() == 3
    got = {(r.policy, r.rule): (r.kept, r.failed, r.sole) for r in rules.ablations(book).collect()}
    assert got["base", "few_words"] == (3, 2, 2)
    assert got["v1", "many_symbols"] == (2, 2, 1)
    assert got["v1", "few_words"] == (2, 2, 1)
    assert len(got) == sum(bin(m).count("1") for m in rules.POLICIES.values())


PAGES = [
    (1, "https://a.ORG/x", None), (2, "http://www.example.org/es/1", ""), (3, "http://example.org/en/12", ""), (4, None, "x"),
    (5, "no scheme", None), (6, "http://notexample.org/es/", None), (7, "http://q.com/fr/?u=http://z.org/", None),
    (8, "http://bad.com/de/1", None), (9, "http://linker.net/1", '<a class=x href="http://bad.com/de/2">b</a>'),
    (10, "http://linker.net/2#f", None), (11, "http://friend.net/", None), (12, "http://a.org/y", "<a href='//friend.net/k'>f</a>"),
    (13, "http://friend.net/z?q", None), (14, "http://a.org", None), (15, "http://org/", None), (12, "http://a.org/y", None),
]


def test_url_rules_hosts_paths_and_propagation(spark):
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    rule = {k: r.rule for k, r in got.items()}
    assert rule == {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: None, 5: None, 6: "org/", 7: "com/fr/", 8: "com/de/",
                    9: None, 10: None, 11: None, 12: "org/", 13: None, 14: None, 15: "org/"}
    assert (got[1].host, got[1].path, got[4].host, got[5].path) == ("a.org", "/x", "", "")
    assert (got[10].path, got[13].path, got[14].path) == ("/2", "/z", "")
    verdict = {k: r.verdict for k, r in got.items()}
    assert verdict[2] == verdict[3] == verdict[8] == "block"
    assert verdict[9] == verdict[10] == "block"  # links to a blocked host
    assert verdict[11] == verdict[13] == verdict[4] == verdict[5] == verdict[1] == "allow"
    assert got[11].trust > 0 and got[9].distrust > 0 and got[11].distrust == 0


def test_propagation_equals_plain_iteration(spark):
    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 2), ("d", "c", 1)]
    seeds = [("a", "trust", 2.0), ("c", "distrust", 1.0)]
    got = {(r.host, r.kind): r.score for r in urls.propagate(
        spark.createDataFrame(seeds, "host string, kind string, seed double"),
        spark.createDataFrame(edges, "src string, dst string, n long"), rounds=5).collect()}
    state = {(h, k): s for h, k, s in seeds}
    for _ in range(5):
        new = {(h, k): 0.15 * s for h, k, s in seeds}
        for kind in ("trust", "distrust"):
            ways = [(s, d, n) if kind == "trust" else (d, s, n) for s, d, n in edges]
            for s, d, n in ways:
                total = sum(m for x, _, m in ways if x == s)
                if (s, kind) in state:
                    new[d, kind] = new.get((d, kind), 0) + 0.85 * n / total * state[s, kind]
        state = new
    assert got.keys() == state.keys() and all(abs(got[k] - state[k]) < 1e-9 for k in state)


def test_propagation_goes_on_until_scores_stand_still(spark):
    edges = [(f"c{i}", f"c{i + 1}", 1) for i in range(25)] + [("x", "y", 1), ("y", "x", 1), ("y", "z", 3), ("z", "x", 1)]
    seeds = [("c0", "trust", 1.0), ("x", "trust", 2.0), ("c25", "distrust", 1.0), ("y", "distrust", 1.0)]
    got = {(r.host, r.kind): r.score for r in urls.propagate(
        spark.createDataFrame(seeds, "host string, kind string, seed double"),
        spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    for kind in ("trust", "distrust"):
        ways = [(s, d, n) if kind == "trust" else (d, s, n) for s, d, n in edges]
        state = {h: 0.15 * s for h, k, s in seeds if k == kind}
        for _ in range(300):
            new = {h: 0.15 * s for h, k, s in seeds if k == kind}
            for s, d, n in ways:
                if s in state:
                    new[d] = new.get(d, 0) + 0.85 * n / sum(m for x, _, m in ways if x == s) * state[s]
            state = new
        assert {h for h, k in got if k == kind} == state.keys()
        assert all(abs(got[h, kind] - v) < 1e-6 * v for h, v in state.items())


def test_host_verdicts_do_not_shrink_with_degree(spark):
    # Two links from a blocked host with many links to it: distrust 0.15 * 0.85^2 / 1000^2, no trust.
    edges = spark.createDataFrame([("near", "bad.com", 1), ("rest", "bad.com", 999), ("far", "near", 1), ("rest", "near", 999),
                                   ("far", "good.org", 1)], "src string, dst string, n long")
    judged = spark.createDataFrame([("bad.com", "com/de/", "block"), ("good.org", "org/", "allow")],
                                   "host string, rule string, rule_verdict string")
    got = {r.host: r.host_verdict for r in urls.host_verdicts(judged, edges).collect()}
    assert got == {"bad.com": "block", "near": "block", "rest": "block", "far": "block", "good.org": "allow"}
    tied = spark.createDataFrame([("a.org", "org/", "allow"), ("a.org", "com/de/", "block")], "host string, rule string, rule_verdict string")
    assert [r.host_verdict for r in urls.host_verdicts(tied, edges).where("host = 'a.org'").collect()] == ["allow"]


def test_url_filter_of_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _pair(spark, chosen, rejected):
    kind = "pair_id long, chosen_turns array<struct<role:string,text:string>>, rejected_turns array<struct<role:string,text:string>>"
    return chat.format_pairs(spark.createDataFrame([(1, chosen, rejected)], kind)).first()


def test_chat_prefix_and_loss_spans(spark):
    a = [("system", "s"), ("user", "hi"), ("assistant", "good"), ("user", "more"), ("assistant", "yes é")]
    b = [("system", "s"), ("user", "hi"), ("assistant", "bad")]
    r = _pair(spark, a, b)
    assert r.n_prompt_turns == 2 and r.prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    cut = lambda text, spans: [text[int(x):int(y)] for x, y in (s.split("-") for s in spans.split(",") if s)]
    assert cut(r.chosen, r.chosen_loss) == ["good<|im_end|>", "yes é<|im_end|>"]
    assert cut(r.rejected, r.rejected_loss) == ["bad<|im_end|>"] and not r.identical
    same = _pair(spark, a, a)
    assert same.identical and same.n_prompt_turns == 5 and same.chosen == same.rejected == ""
    none = _pair(spark, None, b)
    assert none.n_prompt_turns == 0 and none.chosen == "" and none.chosen_loss == ""


def test_conversations_from_odd_rows(spark):
    turns = spark.createDataFrame([(0, 1, "assistant", "A"), (0, 0, "user", None), (1, 0, None, "x"), (1, None, "user", "first"),
                                   (None, 0, "user", "lost"), (2, 0, "user", "alone"), (0, 1, "assistant", "A")],
                                  "conv_id long, turn long, role string, text string")
    convs = chat.conversations(turns)
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in convs.collect()} == {
        0: [("user", ""), ("assistant", "A"), ("assistant", "A")], 1: [("user", "first"), ("", "x")], 2: [("user", "alone")]}
    pairs = {r.pair_id: r for r in chat.swapped_answers(convs).collect()}
    assert [t.text for t in pairs[1].rejected_turns] == ["first", "x", "A"]
    assert [t.text for t in pairs[2].rejected_turns] == ["alone"]
    assert chat.format_pairs(chat.swapped_answers(chat.conversations(turns.limit(0)))).count() == 0


def test_lookup_table_is_balanced_and_stable():
    owners = sharding.fill()
    counts = [owners.count(s) for s in sharding.SHARDS]
    assert max(counts) - min(counts) <= 1 and sum(counts) == sharding.TABLE_SIZE
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(owners, fewer) if a != sharding.SHARDS[-1])
    assert moved < 0.1 * len(owners)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 10)


def test_assignment_of_odd_keys(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, shard string")
    got = sharding.assign(rows, "k").collect()
    assert len(got) == 3 and len({r.shard for r in got if r.k == 1}) == 1
    assert sharding.assign(rows.limit(0), "k").count() == 0
    assert all(r.shard == sharding.fill()[r.slot] for r in got)


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.range(500).withColumn("key", F.lit("hot"))
    sharding.write_shards(docs, "key", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.select("shard").distinct().count() == 1


def test_scores_that_underflow_do_not_crash(spark):
    hops = [(f"h{i}", f"h{i + 1}", 1) for i in range(32)] + [(f"h{i}", "sink", 10 ** 12) for i in range(32)]
    got = {(r.host, r.kind): r.score for r in urls.propagate(
        spark.createDataFrame([("h0", "trust", 1.0)], "host string, kind string, seed double"),
        spark.createDataFrame(hops, "src string, dst string, n long")).collect()}
    assert got["h0", "trust"] > 0 and got["sink", "trust"] > 0 and got["h1", "trust"] < 1e-12
