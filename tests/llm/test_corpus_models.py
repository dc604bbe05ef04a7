"""Rule ensemble, mixing and the pipeline."""
import random

import numpy as np
import pytest

from churnlens.llm import mixing
from churnlens.llm import rule_ensemble as ens
from churnlens.llm.queries import QUERIES, held_out
from conftest import SF001, SF01


def _corpus(spark, n=240):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        bad = i % 3 == 0
        text = " ".join(w + "###" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "x"))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_ensemble_separates_held_out_rows(spark):
    docs, labels = _corpus(spark)
    model = ens.fit(docs, labels.where(~held_out()))
    assert model.weighted and all(r.terms for r, _ in model.weighted)
    got = ens.score(docs, model).join(labels, "doc_id").where(held_out()).collect()
    assert got and all((r.predicted == 1) == (r.quality == 1) and 0 <= r.score <= 1 for r in got)


def test_ensemble_of_a_sample_keeps_the_class_shares(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.15
        marked = rng.random() < (0.6 if bad else 0.2)  # the classes overlap
        rows.append((i, " ".join(rng.choice(["ab", "cde", "fghi"]) + "#" * (marked and k % 2) for k in range(rng.randint(20, 60)))))
        labels.append((i, 0 if bad else 1))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    mean = lambda n: ens.score(docs, ens.fit(docs, known, per_class=n)).agg({"score": "avg"}).first()[0]
    share = sum(y for _, y in labels) / len(labels)
    assert abs(mean(5000) - share) < 0.02 and abs(mean(150) - share) < 0.06


def test_paths_are_the_trees_paths():
    text = ("DecisionTreeClassificationModel: depth=2\n  If (feature 2 <= 0.5)\n   If (feature 2 <= 0.25)\n    Predict: 1.0\n"
            "   Else (feature 2 > 0.25)\n    Predict: 0.0\n  Else (feature 2 > 0.5)\n   Predict: 0.0\n")
    terms = {r.terms for r in ens.paths(text)}
    assert terms == {(("symbols", True, 0.5),), (("symbols", True, 0.25),), (("symbols", False, 0.25), ("symbols", True, 0.5)),
                     (("symbols", False, 0.5),)}


def test_ensemble_on_odd_tables(spark):
    docs, labels = _corpus(spark, 12)
    odd = spark.createDataFrame([(None, None, "k"), (1, "", "k"), (1, "", "k"), (2, "w " * 50_000, "k")], "doc_id long, text string, predicted string")
    for own, share in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1 - 1e-6)):
        model = ens.fit(docs, own)
        rows = ens.score(odd, model).collect()
        assert len(rows) == 4 and all(abs(r.score - share) < 1e-9 for r in rows)
    assert ens.score(odd.limit(0), model).count() == 0
    assert ens.fit(docs.limit(0), labels).weighted == ()


def _plain_rates(tokens, p, goal, floor):
    """Projected gradient in numpy, run long."""
    gram = (p * tokens[:, None]).T @ p
    weight = 1 / gram.sum(axis=1)
    rate = np.maximum(floor, 1 - p @ np.linalg.lstsq(gram, gram.sum(axis=1) - goal, rcond=1e-9)[0])
    for _ in range(3_000):
        rate = np.maximum(floor, rate - p @ (weight * ((rate * tokens) @ p - goal)))
    return rate


@pytest.mark.parametrize("goal, floor", [((600.0, 300.0, 100.0), 0.0), ((10.0, 900.0, 90.0), 0.0), ((900.0, 50.0, 50.0), 0.5)])
def test_rates_equal_plain_projected_gradient(spark, goal, floor):
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 20, 120).astype(float)
    p = rng.dirichlet([0.4, 0.3, 0.3], 120)
    members = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))],
                                    "doc_id long, n_tokens long, p array<double>")
    rows = sorted(mixing.fit_rates(members, list(goal), floor, rounds=200).collect())
    got = np.array([r.rate for r in rows])
    want = _plain_rates(tokens, p, np.array(goal), floor)
    assert got.min() >= floor
    assert np.allclose((got * tokens) @ p, (want * tokens) @ p, rtol=0, atol=2e-3 * tokens.sum())
    if floor == 0.0:
        assert np.allclose((got * tokens) @ p, goal, atol=2e-3 * tokens.sum())


def test_mixing_meets_its_shares(spark):
    got = QUERIES["op2_mixing"](spark, SF01).toPandas()
    total = got["n_tokens"].sum()
    for d, share in {"clean": 0.9, "toxic": 0.05, "junk": 0.05}.items():
        assert abs((got["rate"] * got["n_tokens"] * got[f"p_{d}"]).sum() / total - share) < 1e-3
    assert np.allclose(got[["p_clean", "p_toxic", "p_junk"]].sum(axis=1), 1)


def test_mixing_on_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "x y z"), (2, "w " * 30_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = mixing.mix(docs, none, {"unlabelled": 2.0}, relative="epochs").collect()
    assert len(rows) == 4 and all(abs(r.rate - 2) < 1e-6 for r in rows if r.n_tokens)
    one = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, domain string")
    assert mixing.mix(docs, one, {"a": 1.0}).count() == 4
    assert mixing.mix(docs.limit(0), one, {"a": 1.0}).count() == 0


def test_likely_clean_documents_have_rates_of_one_or_more(spark):
    rng = random.Random(6)
    text = lambda share: " ".join(rng.choice("abcdefgh" if rng.random() < share else "stuvwxyz") * 3 for _ in range(12))
    docs = spark.createDataFrame([(i, text((i % 11) / 10)) for i in range(110)], "doc_id long, text string")
    known = spark.createDataFrame([(i, "clean" if i % 11 > 5 else "junk") for i in range(0, 110, 2)], "doc_id long, domain string")
    targets = {"clean": 1.25, "junk": 0.25}
    low = lambda rows: [r for r in rows if r.p_clean > r.p_junk and r.rate < 1]
    assert low(mixing.mix(docs, known, targets, relative="epochs").collect())
    rows = mixing.mix(docs, known, targets, relative="epochs", whole="clean").collect()
    assert len(rows) == 110 and not low(rows) and any(r.rate < 1 for r in rows)


def test_without_labels_documents_stay(spark, tmp_path):
    import corpus_pipeline as pipe

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(k, "a b c " * k, "en", "s", 0) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars int")
    for stage in (pipe.quality_classifier, pipe.source_mixing):
        assert sorted(stage(spark, docs, str(tmp_path)).collect()) == sorted(docs.collect())


def test_realise_repeats_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    rates = spark.createDataFrame([(1, 3.0), (2, 0.0), (1, 4.0)], "doc_id long, rate double")
    assert sorted(r.text for r in mixing.realise(docs, rates).collect()) == ["a", "a", "a", "c", "d"]
    many = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    n = mixing.realise(many, many.selectExpr("doc_id", "1.5D AS rate")).count()
    assert abs(n - 6000) < 200


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(*pipe.COLUMNS)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    now = docs.unionByName(odd)
    for name, stage in pipe.STAGES[:-1]:
        rows = stage(spark, now, SF001)
        assert rows.columns == pipe.COLUMNS, name
        assert all(r.text == texts[r.doc_id] for r in rows.collect() if r.doc_id in texts), name
        now = rows.checkpoint()
    last = pipe.STAGES[-1][1](spark, now, SF001).collect()
    assert last and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


CLASHES = ["_words", "_lines", "N_WORDS", "_w", "_s_words", "_rate", "_copy", "_id", "_caller", "_text", "Score"]


def test_callers_columns_never_clash(spark):
    from churnlens.llm import mixing, quality_rules, rule_ensemble

    schema = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHES)
    docs = spark.createDataFrame([(1, "a b", *range(11)), (2, None, *range(11)), (None, "x", *range(11))], schema)
    book = quality_rules.ledger(docs)
    assert book.count() == 3 and {"_words", "_lines", "_rate"} <= set(book.columns) and "N_WORDS" not in book.columns
    scored = rule_ensemble.score(docs, rule_ensemble.Ensemble(0.0, ()))
    assert [r["_s_words"] for r in scored.collect()] == [4] * 3 and {r.score for r in scored.collect()} == {0.5}
    rates = spark.createDataFrame([(1, 2.0), (2, 0.0)], "doc_id long, rate double")
    real = mixing.realise(docs, rates)
    assert real.columns == docs.columns and sorted((r.doc_id or 0, r["_copy"], r["_rate"]) for r in real.collect()) == [
        (0, 6, 5), (1, 6, 5), (1, 6, 5)]


def test_rates_come_from_gradient_rounds(spark, monkeypatch):
    from churnlens.llm import mixing

    rows = [(k, 10 + k % 7, [0.2 + 0.6 * (k % 2), 0.8 - 0.6 * (k % 2)]) for k in range(200)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").checkpoint()
    base, seen = mixing.expected_tokens(members, 2), []
    real = mixing.expected_tokens
    monkeypatch.setattr(mixing, "expected_tokens", lambda *a: seen.append(1) or real(*a))
    got = mixing.fit_rates(members, [base[0] * 1.3, base[1] * 0.6])
    assert len(seen) > 3  # the totals of rate 1, then rounds
    now = real(got, 2, mixing.F.col("rate"))
    assert abs(now - [base[0] * 1.3, base[1] * 0.6]).max() <= 1e-4 * base.sum()
    with pytest.warns(UserWarning, match="not settled"):
        mixing.fit_rates(members, [base[0] * 1.3, base[1] * 0.6], rounds=1)
