"""Fill-in-the-middle, learned partitions and product codes against brute force."""
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import fill_middle as fim
from churnlens.llm import learned_index as li
from churnlens.llm import vector_codes as vc

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


# --- fill-in-the-middle -------------------------------------------------------------------

@pytest.mark.parametrize("offsets, kinds", [
    (range(1, 200_000), {"_Runs"}), (range(3, 300_000, 997), {"_Array"}), (range(1, 6 << 16, 2), {"_Bitmap"}),
    ([5, 9, *range(70_000, 140_000), *range(200_000, 260_000, 3), 1 << 40], {"_Array", "_Runs", "_Bitmap"}), ([], set())])
def test_boundary_set_selects_and_ranks(offsets, kinds):
    offsets = list(offsets)
    s = fim.BoundarySet(np.array(offsets, np.int64))
    assert len(s) == len(offsets) and {type(c).__name__ for c in s.containers} == kinds
    rng = random.Random(1)
    for k in [0, len(offsets) - 1, *(rng.randrange(len(offsets)) for _ in range(300))] if offsets else []:
        assert s.select(k) == offsets[k] and s.rank(offsets[k]) == k and s.rank(offsets[k] + 1) == k + 1
    with pytest.raises(IndexError):
        s.select(len(offsets))


TEXTS = [(1, "a\nb\n\nc"), (2, None), (3, ""), (4, "has <S> inside\nx"), (5, "\n" * 90_000), (None, "p\nq\n"),
         (6, "é ü\r\nñ😀\n" * 50), (7, "x" * 100_000), (7, "x" * 100_000), (8, "a\n" * 40_000), (9, "<P\n>"), (-3, "one line\n")]


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("char", 60, 100), ("line", 100, 0)])
def test_rewriting_equals_brute_force_and_restores(spark, unit, rate, spm):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, Form string, extra int").repartition(3)
    made = fim.transform(docs, rate=rate, spm_share=spm, unit=unit).withColumn("again", fim.restore())
    got = sorted(repr((r.doc_id, r.form, r.n_units, r.prefix_chars, r.middle_chars, r.output, r.extra)) for r in made.collect())
    assert all(r.again == (r.text or "") for r in made.collect())
    want = []
    for i, t in TEXTS:
        t = t or ""
        units = UNITS.findall(t) if unit == "line" else list(t)
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
        n = len(units)
        if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
            want.append((i, "plain", n, None, None, t, 1))
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        form = "spm" if h4 % 100 < spm else "psm"
        want.append((i, form, n, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", 1))
    assert got == sorted(map(repr, want))
    assert fim.transform(docs.limit(0)).count() == 0


# --- learned partitions ---------------------------------------------------------------------

def _clustered(n, dims=16, centres=12, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims)) * 3
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))


def _frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c") for i, v in rows],
                                 "vec_id long, embedding array<double>, part string")


def _exact(rows, k, step):
    ids = sorted({i for i, _ in rows})
    out = {}
    for q in (i for i in ids if i % step == 0):
        v = min(tuple(v) for i, v in rows if i == q)
        best = {}
        for i, w in rows:
            if i != q:
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                best[i] = max(best.get(i, -math.inf), s)
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def test_balanced_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(0)
    near = np.array([[g * 50 + j for j in rng.choice(50, 8, replace=False)] for g in range(6) for _ in range(50)])
    part = li.balanced_parts(near, 6)
    sizes = np.bincount(part, minlength=6)
    assert sizes.sum() == 300 and sizes.max() <= 55 and sizes.min() >= 1
    assert (part[near] == part[:, None]).mean() > 0.9
    assert sorted(np.bincount(li.balanced_parts(np.zeros((5, 0), int), 3), minlength=3)) == [1, 2, 2]


def test_search_finds_neighbours_with_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 100)
    monkeypatch.setattr(li, "QUERY_BLOCK", 16)
    x = _clustered(900)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900 + k, rows[20][1]) for k in range(300)]  # a hot vector
    df = _frame(spark, rows).repartition(5)
    index = li.build(df, rows_per_part=80)
    assert len(index.sizes) == 15 and index.sizes.sum() == 1200
    queries = li.usable(df.where("vec_id % 20 = 0"))
    probes, recall = li.calibrate(index, queries, 10)
    assert probes < 15 and recall[probes - 1] >= li.TARGET
    got: dict = {}
    for r in li.search(index, queries, 10, probes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = _exact(rows, 10, 20)
    assert set(got) == set(want)
    value = dict(rows)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 11)) and q not in {f[1] for f in found}
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        for _, i, s in found:
            e = 0.0
            for a, b in zip(value[q], value[i]):
                e += a * b
            assert s == e
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hits >= 0.95 * 10 * len(got)
    every = li.search(index, queries, 10, len(index.sizes)).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in every} == {
        (q, k + 1, i, -s) for q, f in want.items() for k, (s, i) in enumerate(f)}


def test_bins_hold_small_parts_together_and_split_large_ones():
    first, many = li.bins(np.array([3, 4, 25, 0, 9, 2]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and many.tolist() == [1, 1, 3, 1, 1, 1]


def test_search_edge_cases(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (20, [0.5, 0.5]), (3, [1, 0]), (2, [1, 0]), (2, [9, 9]), (40, None), (5, [0, 0]), (6, [1, None]),
            (7, [float("nan"), 1]), (8, [float("inf"), 1]), (9, [1, 2, 3]), (None, [4, 4]), (60, []), (11, [-1, -1])]
    df = _frame(spark, rows)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in li.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got) == [(0, 1, 2, 9.0), (0, 2, 3, 1.0), (0, 3, 20, 0.5), (0, 4, 11, -1.0),
                           (20, 1, 2, 9.0), (20, 2, 0, 0.5), (20, 3, 3, 0.5), (20, 4, 11, -1.0)]
    assert li.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert li.nearest(df.where("vec_id = 3"), F.col("vec_id") % 20 == 0).collect() == []
    assert li.nearest(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).collect() == []


# --- product codes --------------------------------------------------------------------------

def _brute_codes(rows, parts, entries, rounds, scale=256):
    """Plain Python: {(id, vector): (code, error)} in row order, and the codebooks."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts
    ids = sorted({i for i, _ in kept if i is not None})[:entries]
    books = [[min(v for i, v in kept if i == e)[p * width:(p + 1) * width] for e in ids] for p in range(parts)]

    def assign():
        out = []
        for _, v in kept:
            code = []
            for p in range(parts):
                x = v[p * width:(p + 1) * width]
                code.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])))
            out.append(code)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(ids)):
                mine = [v[p * width:(p + 1) * width] for (_, v), code in zip(kept, found) if code[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(bytes(k for _, k in code), sum(d for d, _ in code)) for code in assign()], books


@pytest.mark.parametrize("entries, rounds, first_b, spread", [(8, 2, 2, 1.0), (16, 4, 1, 0.02), (3, 0, 4, 1.0), (64, 3, 6, 0.1)])
def test_codes_equal_plain_lloyd(spark, entries, rounds, first_b, spread):
    rng = np.random.default_rng(entries)
    x = np.round(rng.normal(size=(260, 8)) * spread, 2).astype(np.float32)  # coarse, so that distances tie
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(260) - 5, x)]
    rows += [rows[0], (None, rows[3][1]), (rows[1][0], [9.0] * 8)] + [(1000 + k, rows[7][1]) for k in range(80)]
    df = spark.createDataFrame([(i, v, k % 3 if k % 4 else None, "x") for k, (i, v) in enumerate(rows)],
                               "vec_id long, embedding array<float>, label int, code string").repartition(4)
    codes, books, widths = vc.compress(df, parts=4, entries=entries, rounds=rounds, first_b=first_b)
    want, want_books = _brute_codes(rows, 4, entries, rounds)
    assert books.tolist() == want_books
    assert sorted(repr((r.id, bytes(r.code), r.error)) for r in codes.collect()) == sorted(
        repr((i, c, e)) for (i, _), (c, e) in zip(rows, want))
    assert len(widths) == max(1, rounds)


def test_bounds_settle_most_parts_and_never_change_a_result():
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (3000, 4))
    book = x[:64].copy()
    dist = vc.all_distances(x, book)
    near, lower, outer = vc.listed(dist, 6)
    assert (near[:, 0] == dist.argmin(axis=1)).all() and (np.diff(lower, axis=1) >= 0).all()
    for k in range(4):
        new = book + rng.integers(-3, 4, book.shape) // (k + 1)
        drift = np.sqrt(((new - book) ** 2).sum(axis=1)) * (1 + 1e-9)
        book = new
        best, near, lower, outer, need = vc.reassign(x, book, drift, near, lower, outer, 6 - k)
        dist = vc.all_distances(x, book)
        assert (best == dist.min(axis=1)).all() and (near[:, 0] == dist.argmin(axis=1)).all()
        exact = np.sqrt(np.take_along_axis(dist, near.astype(int), 1))
        assert (np.where(np.isinf(lower), 0, lower) <= exact + 1e-6).all()
        others = dist.copy().astype(float)
        np.put_along_axis(others, near.astype(int), np.inf, 1)
        assert (outer <= np.sqrt(others.min(axis=1)) + 1e-6).all()
    assert vc.next_b({1: 90, 2: 9, 3: 1}, 4, 16) == 2 and vc.next_b({5: 50, 1: 50}, 4, 16) == 8 and vc.next_b({}, 4, 16) == 4


def test_codes_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(1, [0.5] * 4, 1), (2, None, 1), (3, [0.5, None, 0.5, 0.5], 1), (4, [float("nan")] * 4, 1),
                                (5, [], 1), (6, [1.0] * 3, 1), (7, [float("inf")] * 4, 1), (8, [3e38] * 4, None)], schema)
    codes, books, _ = vc.compress(df, parts=2)
    assert [(r.id, bytes(r.code), r.error) for r in codes.orderBy("id").collect()] == [(1, b"\0\0", 0), (8, b"\1\1", 0)]
    assert books.shape == (2, 2, 2)
    assert vc.compress(df.limit(0), parts=2)[0].collect() == []
    assert vc.compress(df.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("long")), parts=2)[0].collect() == []
    assert vc.books_digest(np.arange(4).reshape(1, 2, 2)) == hashlib.sha256(b"0,1,2,3").hexdigest()


def test_registered_queries_cover_whole_tables(spark):
    from churnlens.llm import queries as q

    sf = "/root/testdata/sf0.001"
    e = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = _exact(e, 20, 20)
    got: dict = {}
    for r in q.op12_learned_index(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len({i for _, i in want[k]} & set(v)) for k, v in got.items()) >= 0.9 * 20 * len(got)
    codes, books = _brute_codes(e, 16, 64, 2)
    rows = q.op13_vector_codes(spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in rows) == sorted((i, c.hex(), err) for (i, _), (c, err) in zip(e, codes))
    flat = ",".join(str(x) for b in books for en in b for x in en)
    assert {r.codebooks_sha256 for r in rows} == {hashlib.sha256(flat.encode()).hexdigest()}
    assert sum(r.error for r in rows) == sum({r.label_error for r in rows})
