"""Quality classifier: a sparse rule ensemble.

1. Every text is measured by ``statistics`` (Spark columns, whole texts).
2. A small random forest is fitted on labelled rows; every path from a root to an
   inner or leaf node of its trees becomes a conjunctive rule over the statistics.
3. A lasso logistic regression over the rules (0/1) drops most of them.
4. The rules left are compiled into one Spark column expression, the score, so
   scoring is a projection over the statistics: no model object, no Python, no shuffle.

The fit uses at most ``MAX_PER_CLASS`` labelled rows of each class on average (a
documented bound: rows are taken by a hash of their id, with a rate from the class
counts, and weigh 1 / rate, so the classes keep their shares).  Only the texts of those rows are measured for the fit; the id list is
bounded by that parameter and is broadcast.  Everything else covers all rows.

Statistics depend on the text only: no label, language, source or id is an input.

Defined results: null text counts as empty; statistics of an empty text are zero and
it is scored like any other; labels that are null, or not 0 or 1, are left out; an id
labelled more than once counts once, with its smallest label; without labelled rows of
both classes every score is the share of label 1 (0.5 without any); equal texts have
equal scores; extra columns are kept (columns named ``score`` or ``predicted`` are
replaced).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.text import SPACES, packed, text_or_empty, words_of
from churnlens.session import ensure_checkpoint_dir

MAX_PER_CLASS = 10_000
TREES, DEPTH, SEED = 20, 3, 7
LASSO, MAX_ITER = 0.002, 40
THRESHOLD = 0.7

STATS = ("words", "word_length", "symbols", "shouts", "bars", "capitals", "digits", "distinct", "echoes",
         "lines", "dup_lines", "marks")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with one column ``_s_<name>`` for each statistic."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col and not c.startswith("_s_")]
    text = text_or_empty(text_col)
    gone = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    raw = docs.select(
        *kept, words_of(text).alias("_w"), lines.alias("_l"),
        F.length(F.translate(text, SPACES, "")).cast("double").alias("_chars"),
        gone("#*$%&<>").alias("_symbols"), gone("!").alias("_shouts"), gone("|").alias("_bars"),
        gone("0123456789").alias("_digits"), gone(".,;:?").alias("_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double").alias("_capitals"))
    counted = raw.select(
        *kept, "_chars", "_symbols", "_shouts", "_bars", "_digits", "_marks", "_capitals",
        F.size("_w").cast("double").alias("_n"), F.size(F.array_distinct("_w")).cast("double").alias("_d"),
        F.size(F.filter("_w", lambda w, i: F.coalesce(w == F.get("_w", i - 1), F.lit(False)))).cast("double").alias("_e"),
        F.size("_l").cast("double").alias("_ln"), F.size(F.array_distinct("_l")).cast("double").alias("_ld"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    values = {
        "words": F.col("_n"), "word_length": per("_chars", "_n"), "symbols": per("_symbols", "_n"),
        "shouts": per("_shouts", "_n"), "bars": per("_bars", "_n"), "capitals": per("_capitals", "_chars"),
        "digits": per("_digits", "_chars"), "distinct": per("_d", "_n"), "echoes": per("_e", "_n"),
        "lines": per("_ln", "_n"), "dup_lines": F.when(F.col("_ln") > 0, 1 - F.col("_ld") / F.col("_ln")).otherwise(F.lit(0.0)),
        "marks": per("_marks", "_n"),
    }
    return counted.select(*kept, *[values[s].alias(f"_s_{s}") for s in STATS])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_upper_bound, bound): ``<=`` or ``>``."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, upper, bound in self.terms:
            c = F.col(f"_s_{name}")
            out = out & (c <= F.lit(bound) if upper else c > F.lit(bound))
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, w in self.weighted:
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


_SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eEInfity]+)\)")


def paths(debug: str) -> set[Rule]:
    """The rules of one tree, from its printed form."""
    rules, stack = set(), []
    for line in debug.splitlines():
        m = _SPLIT.match(line)
        if not m:
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth]
        stack.append((depth, (STATS[int(m[2])], m[3] == "<=", float(m[4]))))
        rules.add(_tightened(t for _, t in stack))
    return rules


def _tightened(terms) -> Rule:
    """One bound for each statistic and side."""
    best: dict[tuple[str, bool], float] = {}
    for name, upper, bound in terms:
        old = best.get((name, upper))
        best[name, upper] = bound if old is None else (min if upper else max)(old, bound)
    return Rule(tuple(sorted((n, u, b) for (n, u), b in best.items())))


def _fit_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, per_class: int):
    """(statistics, label and weight of the sampled rows, counts of labels)."""
    own = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y"))
           .where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y")))
    counts = {r["_y"]: r["n"] for r in own.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(1.0)
    for y, n in counts.items():
        rate = F.when(F.col("_y") == y, F.lit(min(1.0, per_class / n))).otherwise(rate)
    drawn = (own.where(F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 30)) < rate * (1 << 30))
             .withColumn("_weight", 1 / rate))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    rows = statistics(texts.join(F.broadcast(drawn), "_id"), "_text")
    return rows.repartitionByRange(8, "_id").sortWithinPartitions("_id").checkpoint(), counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text",
        per_class: int = MAX_PER_CLASS) -> Ensemble:
    """Fit on the rows of ``docs`` that ``labels`` marks.  The caller leaves held-out
    rows out of ``labels``."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows, counts = _fit_rows(docs, labels, id_col, label_col, text_col, per_class)
    present = {r[0] for r in rows.select("_y").distinct().collect()}
    if len(present) < 2:
        share = sum(y * n for y, n in counts.items()) / sum(counts.values()) if counts else 0.5
        return Ensemble(_logit(share), ())
    features = array_to_vector(F.array(*[F.col(f"_s_{s}") for s in STATS]))
    forest = RandomForestClassifier(labelCol="_y", featuresCol="_x", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5, weightCol="_weight")
    trees = forest.fit(rows.select(F.col("_y").cast("double").alias("_y"), "_weight", features.alias("_x"))).trees
    rules = sorted(set().union(*(paths(t.toDebugString) for t in trees)), key=lambda r: r.terms)
    if not rules:
        return Ensemble(_logit(sum(y * n for y, n in counts.items()) / sum(counts.values())), ())
    hits = array_to_vector(F.array(*[r.column().cast("double") for r in rules]))
    table = rows.select(F.col("_y").cast("double").alias("_y"), "_weight", hits.alias("_x")).checkpoint()
    lasso = LogisticRegression(labelCol="_y", featuresCol="_x", elasticNetParam=1.0, regParam=LASSO, maxIter=MAX_ITER,
                               standardization=False, weightCol="_weight").fit(table)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return Ensemble(float(lasso.intercept), tuple(weights))


def _logit(share: float) -> float:
    import math

    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share))


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with ``score`` and ``predicted``."""
    rows = docs.select(packed(docs, text_col, "score", "predicted"), F.col(f"`{text_col}`").alias("_text"))
    scored = statistics(rows, "_text").select("_caller", model.score().alias("_score"))
    return scored.select("_caller.*", F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
