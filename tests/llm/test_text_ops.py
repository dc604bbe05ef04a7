"""Fingerprints, Jaccard join, BPE and WARC against brute force and the published library."""
import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import bpe, graph, simhash, warc
from churnlens.llm import jaccard_join as jac
from churnlens.llm.queries import tokenizer_path
from churnlens.llm.text import word_hashes

WORDS = [f"w{i}" for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_word_hashes_do_not_depend_on_neighbours():
    long = " ".join(WORDS * 400)
    texts = ["Ab  cd\n", None, "", "ab\x0bCD", " \t", "É é", long, "ab cd"]
    alone = [word_hashes([t])[0].tolist() for t in texts]
    assert [h.tolist() for h in word_hashes(texts)] == alone
    assert alone[0] == alone[3] == alone[7] and len(alone[0]) == 2 and alone[1] == alone[2] == alone[4] == []
    assert alone[5][0] != alone[5][1] and alone[6][:400] == alone[6][400:800]


DOCS = [(5, "a b c d"), (None, "n"), (3, None), (9, ""), (7, "é" * 50), (7, "b"), (11, " ".join(WORDS * 100)), (12, "a b c d"), (12, "a b c d")]


def test_fingerprints_equal_brute_force(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, fingerprint string").repartition(4)
    got = sorted((repr(tuple(r)) for r in simhash.with_next(docs).collect()))
    rows = sorted(((-1 if i is None else i, t or "") for i, t in DOCS))
    want = []
    for k, (i, t) in enumerate(rows):
        following, third = rows[k - 1][1], len(t) // 3
        new = t[:len(t) - third] + following[:third]
        f, g, h = simhash.fingerprints([t, new, following])
        want.append(repr((None if i < 0 else i, len(t), hashlib.sha256(new.encode()).hexdigest(), simhash._hex(f), simhash._hex(g),
                          simhash.likeness(f, g), simhash.likeness(f, h))))
    assert got == sorted(want)
    assert simhash.with_next(docs.limit(0)).count() == 0
    assert simhash.with_next(docs.limit(1)).first().near_next == 1.0


@pytest.mark.parametrize("radius, blocks", [(0, 1), (2, 3), (3, 6)])
def test_find_within_is_exact(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(20)]
    fps = {b for b in base} | {b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(1, 5))) for b in base for _ in range(8)}
    df = spark.createDataFrame([(f"{f:032x}",) for f in fps], "fingerprint string")
    got = {(r.query_fp, r.fp, r.distance) for r in simhash.find_within(df, df.unionByName(df), radius, blocks).collect()}
    assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in fps for b in fps if (a ^ b).bit_count() <= radius}


def test_search_broadcasts_no_keys(spark):
    # Few queries are many keys: 496 a query at the default radius.
    df = spark.createDataFrame([(f"{k << 64 | k:032x}",) for k in range(40)], "fingerprint string")
    found = simhash.find_within(df.where("fingerprint < '00000000000000050'"), df)
    assert found.count() > 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_search_at_its_own_radius_is_exact_and_finds_near_copies(spark):
    rng = random.Random(5)
    texts = []
    for n in (60, 150, 400):
        for _ in range(4):
            base = _text(rng, n).split()
            copy = list(base)
            copy[rng.randrange(n)] = "other"
            texts += [" ".join(base), " ".join(copy), " ".join(base)]
    fps = [simhash._hex(f) for f in simhash.fingerprints(texts)]
    far = [f"{int(fps[0], 16) ^ sum(1 << k for k in rng.sample(range(128), d)):032x}" for d in range(14, 23) for _ in range(6)]
    rows = [(k, f) for k, f in enumerate(fps + far)] + [(None, fps[0])]
    docs = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = [(r.doc_id, r.n_near, r.near_class) for r in simhash.near_classes(docs, F.col("doc_id") % 3 == 0).collect()]
    assert len(got) == len(rows)
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    asked = [k for k, _ in rows if k is not None and k % 3 == 0]
    root = {k: k for k, _ in rows[:-1]}
    near = {q: [k for k, f in rows if apart(f, rows[q][1]) <= simhash.RADIUS] for q in asked}
    for _ in range(len(rows)):
        for q in asked:
            ks = [k for k in near[q] if k is not None]
            low = min(root[k] for k in ks)
            root.update({k: low for k in ks})
    reached = {k for ks in near.values() for k in ks}
    assert sorted(got, key=repr) == sorted(((k, len(near[k]) if k in near else None, (root[k] if k is not None else root[0]) if k in reached else None)
                                            for k, _ in rows), key=repr)
    classes = {k: c for k, _, c in got}
    assert all(classes[k] == classes[k + 1] == classes[k + 2] == k for k in range(3, 36, 3))


def _components(texts, n, percent):
    """Brute force over word tuples."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = [None, "", "  ", "one", "one", "one two", "ONE two", "two one"]
    for _ in range(12):
        base = _text(rng, rng.choice([8, 60, 300])).split()
        for _ in range(rng.choice([2, 6, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [" ".join(WORDS * 30), " ".join(WORDS * 30) + " end"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jac.link_components(docs, n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == _components(texts, n, percent)
    kept = {r.doc_id for r in jac.one_per_component(docs.unionByName(docs), n, percent).select("doc_id").collect()}
    assert kept == {c for i, (k, c) in enumerate(_components(texts, n, percent))}


def test_join_of_odd_rows(spark):
    schema = "doc_id long, text string"
    assert jac.link_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "z z"), (2, None)]
    got = sorted((repr(tuple(r)) for r in jac.link_components(spark.createDataFrame(rows, schema)).collect()))
    assert got == sorted(["(4, 2, 4)", "(4, 2, 4)", "(None, 2, 4)", "(None, 1, None)", "(2, 0, 2)"])
    assert jac.one_per_component(spark.createDataFrame(rows, schema)).count() == 4


def test_region_splits_and_prunes_exactly():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
        for _ in range(12):
            own = base.copy()
            own[rng.integers(0, 80, rng.integers(0, 9))] = rng.integers(0, 1 << 60, 1, dtype=np.uint64)
            sets.append(np.unique(own))
    sets.sort(key=len)
    forest = jac.join_region(sets, 80, leaf=16, pivots=4)
    got = [forest.find(i) for i in range(len(sets))]
    as_sets = [set(s.tolist()) for s in sets]
    linked = [[100 * len(a & b) >= 80 * len(a | b) for b in as_sets] for a in as_sets]
    for i in range(len(sets)):
        for j in range(i):
            assert not linked[i][j] or got[i] == got[j]
    assert len(set(got)) >= 30
    group = jac.may_link(np.array([len(s) for s in sets]), [np.frombuffer(jac.sketch(s), np.uint32) for s in sets], 80)
    assert all(group[i] == group[j] for i in range(len(sets)) for j in range(i) if linked[i][j])
    assert len(set(group)) > 15


def test_repeated_ids_keep_the_links_of_all_their_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(200)), " ".join(f"b{k}" for k in range(200))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (4, "other words stand here"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jac.link_components(docs, n=3, percent=90).collect()))
    assert got == [(0, 198, 1), (1, 198, 1), (1, 198, 1), (2, 199, 1), (3, 199, 1), (3, 199, 1), (4, 2, 4)]


def test_voronoi_cells_deal_a_region_and_lose_no_link():
    rng = random.Random(11)
    sets = []
    for g in range(12):
        base = [rng.getrandbits(62) for _ in range(60)]
        for k in range(10):
            sets.append(np.unique(np.array(base[k:] + [rng.getrandbits(62) for _ in range(k)], np.uint64)))
    forest = jac.join_region(sets, 80)
    assert forest.cells >= 4
    as_sets = [set(s.tolist()) for s in sets]
    root = [forest.find(i) for i in range(len(sets))]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(as_sets[i] & as_sets[j]) >= 80 * len(as_sets[i] | as_sets[j]):
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    assert root == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["", " ", "a", "  \n\n x \x1c\x1f y\x85z ᠎​ q ", "<|endoftext|>", "hi<|endoftext|> there", "don't I'll we've 'S ''s",
       "x" * 20_000, "ab" * 3_000, "12½²Ⅻ", "é́ \U0001f469‍\U0001f469 日本語", "　 \xa0 \xad﻿", "a\t\tb  c   "]


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(4)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x2fff), 32, 10])) for _ in range(120)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, ids int")
    vocabulary = bpe.shared(spark, tokenizer_path())
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).withColumn("sha", bpe.ids_digest()).collect()}
    for i, t in enumerate([*texts, ""]):
        want = library.encode(t, add_special_tokens=False).ids
        assert rows[i].ids == want, t[:40]
        assert rows[i].decoded == library.decode(want, skip_special_tokens=False)
        assert rows[i].sha == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_bpe_merge_is_the_greedy_merge():
    rng = random.Random(5)
    merges = {}
    for rank in range(60):
        merges.setdefault(rng.randrange(8) << 20 | rng.randrange(8), rank << 20 | rng.randrange(8, 30))
    for _ in range(300):
        ids = [rng.randrange(8) for _ in range(rng.randint(0, 40))]
        plain = list(ids)
        while pairs := [(merges[a << 20 | b], k) for k, (a, b) in enumerate(zip(plain, plain[1:])) if a << 20 | b in merges]:
            value, k = min(pairs)
            plain[k:k + 2] = [value & 0xFFFFF]
        assert bpe.merge(ids, merges) == plain
    rows, want = [], []
    for n in [0, 1, 2, 3, 8, 8, *(rng.randint(0, 8) for _ in range(400))]:
        ids = [rng.randrange(8) for _ in range(n)]
        rows.append(ids + [-1] * (8 - n))
        want.append(bpe.merge(ids, merges))
    got = bpe.merge_many(np.array(rows), np.array([sum(i >= 0 for i in r) for r in rows]), bpe._Pairs(merges))
    assert [r[r >= 0].tolist() for r in got] == want
    assert bpe.merge_many(np.array([[3], [-1]]), np.array([1, 0]), bpe._Pairs(merges)).tolist() == [[3], [-1]]


def test_every_code_point_equals_the_library(library):
    encoder = bpe.Encoder(bpe.load(tokenizer_path()), keep=50_000)
    texts = [f"a{chr(i)} {chr(i)}1{chr(i)}{chr(i)}!{chr(i)} x" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(texts), 20_000):
        some = texts[k:k + 20_000]
        flat, counts = encoder.encode_many(some)
        for text, ids, want in zip(some, np.split(flat, np.cumsum(counts)[:-1]), library.encode_batch(some, add_special_tokens=False)):
            assert ids.tolist() == want.ids, text


def test_decoding_broken_bytes(spark, library):
    rng = random.Random(6)
    ids = [[rng.randrange(50_257) for _ in range(30)] for _ in range(100)]
    vocabulary = bpe.load(tokenizer_path())
    assert all(bpe.decode_ids(x, vocabulary.bytes_of) == library.decode(x, skip_special_tokens=False) for x in ids)


PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\nWARC-Type: x\r\n\r\n"),
         (6, "u", "é" * 300_000), (7, "u", "same"), (None, "u", "same"), (8, "u", "tail\r\n"), (8, "u", "tail\r\n")]


def _write(spark, tmp_path, rows=PAGES, **options):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string"), path, **options)
    return path


def test_warc_round_trip(spark, tmp_path):
    got = warc.read_archive(spark, _write(spark, tmp_path, records_per_file=3)).collect()
    assert len(got) == len(PAGES)
    by_id = {r.record_id: r for r in got}
    assert by_id["<urn:page:1>"].warc_type == "revisit" and by_id["<urn:page:1>"].refers_to == "<urn:page:7>"
    assert by_id["<urn:page:7>"].warc_type == "response" and by_id["<urn:page:3>"].refers_to == "<urn:page:4>"
    assert by_id["<urn:page:2>"].target_uri == "http://b/%0D%0AX: y" and by_id["<urn:page:>"].warc_type == "revisit"
    for i, _, html in PAGES:
        r = by_id[f"<urn:page:{'' if i is None else i}>"]
        raw = (html or "").encode()
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.payload_length == len(raw)
        assert bytes(r.payload) == (raw if r.warc_type == "response" else b"")
    assert sum(r.record_id == "<urn:page:8>" and r.warc_type == "response" for r in got) == 2


def test_warc_small_payloads_and_pushdown(spark, tmp_path):
    path = _write(spark, tmp_path, min_revisit_bytes=5)
    records = warc.read_archive(spark, path)
    assert records.where("warc_type = 'revisit'").count() == 0
    only = records.where("record_id = '<urn:page:6>'")
    assert only.count() == 1 and "Filter (" not in only._jdf.queryExecution().executedPlan().toString()
    assert only.first().payload_length == 600_000
    assert warc.read_archive(spark, path, payload=False).where(F.col("payload").isNotNull()).count() == 0


def test_warc_reader_skips_what_filters_reject(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    (tmp_path / "a.warc").write_bytes(b"".join(
        b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" % t for t in (b"request", b"response", b"metadata")))
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), GreaterThan(("content_length",), 1), In(("warc_type",), ("response", "x"))]))
    assert len(left) == 1
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["warc_type"] for r in rows] == ["response"] and rows[0]["payload"] == b"abcd"


def test_warc_of_no_pages(spark, tmp_path):
    assert warc.read_archive(spark, _write(spark, tmp_path, rows=[])).count() == 0


def test_warc_archives_are_gzipped_and_skip_without_seeking(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * 200_000) for k in range(3)]
    path = _write(spark, tmp_path, rows=rows)
    files = list(tmp_path.rglob("part-*"))
    assert files and all(p.name.endswith(".gz") for p in files)
    assert sum(p.stat().st_size for p in files) < sum(len(r[2]) for r in rows) / 10  # plain before
    got = {r.record_id: bytes(r.payload) for r in warc.read_archive(spark, path).collect()}
    assert got == {f"<urn:page:{k}>": html.encode() for k, _, html in rows}
    assert warc.read_archive(spark, path, payload=False).where("payload IS NULL AND payload_length > 0").count() == 3
    reader = warc.WarcReader({"path": str(path)})
    assert sum(1 for part in reader.partitions() for b in reader.read(part) for _ in range(b.num_rows)) == 3


def test_numbers_reach_the_driver_as_packed_runs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    size = 3 * jac.RUN + 17
    at = np.append(rng.choice(size - 1, 4_000, replace=False), size - 1)
    value = rng.integers(1, 1 << 32, len(at))
    want = np.zeros(size, np.uint32)
    want[at] = value
    rows = spark.createDataFrame([(int(a), int(v)) for a, v in zip(at, value)], "word long, bits long")
    assert (jac._packed(rows, "word", "bits", size, np.uint32) == want).all()
    assert not jac._packed(rows.limit(0), "word", "bits", size, np.uint32).any()
    # Neither the filters nor the order of shingles come as a row a number.
    seen = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: seen.append(collect(df)) or seen[-1])
    monkeypatch.setattr(type(rows), "toPandas", lambda df: pytest.fail("rows on the driver"))
    docs = spark.createDataFrame([(k, " ".join(map(str, rng.integers(0, 5_000, 300)))) for k in range(60)], "doc_id long, text string")
    jac.link_components(docs, 3, 90).count()
    assert max(map(len, seen)) <= (1 << (jac.WANTED_BITS - 5)) // jac.RUN
