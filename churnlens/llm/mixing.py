"""Mixing sources to target weights by soft membership.

1. A multinomial logistic regression over hashed words is fitted on a labelled table
   (document id, domain) and gives every document its domain posteriors.
2. A nonnegative rate per document is fitted so that the expected tokens of each
   domain, sum_i rate_i tokens_i p_ik, match the targets: least squares, weighted by
   the domains' tokens, by projected gradient.  A document's gradient is a dot product
   of its posteriors with the domains' residuals, so a round is one aggregation of K
   sums (K domains) over the documents, and the driver holds K numbers.
3. ``realise`` turns rates into whole copies: floor(rate) copies, one more with
   probability equal to the fraction, drawn by a hash of the id.

The fit of step 1 uses at most ``MAX_PER_DOMAIN`` labelled rows of each domain on average
(weighted back to the domains' sizes); their id list is bounded by that parameter and
broadcast.  Posteriors, totals and rates cover all rows.  Tokens are counted in words.

Step size: with weights 1 / (tokens of the domain) the gradient map cannot expand, so
a step of 1 is safe.  All rates start at 1; rounds step along the gradient and project onto
the bounds until the targets are met or the totals stand still (``STILL`` of all tokens);
rates that have not settled after ``ROUNDS`` rounds are returned with a warning.  Rounds
carry momentum (accelerated projected gradient): without it the misfit falls too slowly
where many rates rest on their bound.

Defined results: null text counts as empty: no tokens, posteriors by the intercepts, and
a rate like any other; ids labelled more than once take the smallest domain; labels that
are null are left out; with one labelled domain all posteriors are 1; without labels the
single domain is ``unlabelled`` and, without a target, all rates are 1; a domain without expected tokens has no say; a row with a
null id is kept and gets a rate; equal texts have equal rates; repeated rows count as often
as they occur; extra columns are not read by the fit.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.text import packed, text_or_empty, words_of
from churnlens.session import ensure_checkpoint_dir

MAX_PER_DOMAIN = 4_000
FEATURES = 1 << 13
RIDGE, MAX_ITER, SEED = 1e-3, 25, 11
ROUNDS, FOLD, STILL = 300, 6, 1e-6


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the label table: junk (quality 0), toxic, or clean."""
    domain = (F.when(F.col("quality") == 0, F.lit("junk")).when(F.col("toxic") == 1, F.lit("toxic"))
              .when(F.col("quality") == 1, F.lit("clean")))
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def _terms(docs: DataFrame, kept: list[Column]) -> DataFrame:
    words = docs.select(*kept, words_of(F.lower(text_or_empty())).alias("_words"))
    return HashingTF(inputCol="_words", outputCol="_x", numFeatures=FEATURES, binary=True).transform(words)


def posteriors(docs: DataFrame, labelled: DataFrame, per_domain: int = MAX_PER_DOMAIN) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, p array<double>) for every row, and the domains in order."""
    ensure_checkpoint_dir(docs.sparkSession)
    own = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(counts) or ["unlabelled"]
    base = docs.select("doc_id", "text")
    n_tokens = F.size("_words").cast("long").alias("n_tokens")
    rate, y = F.lit(1.0), F.lit(0.0)
    for k, d in enumerate(domains):
        if d in counts:
            rate = F.when(F.col("domain") == d, F.lit(min(1.0, per_domain / counts[d]))).otherwise(rate)
            y = F.when(F.col("domain") == d, F.lit(float(k))).otherwise(y)
    drawn = (own.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < rate * (1 << 30))
             .select("doc_id", y.alias("_y"), (1 / rate).alias("_weight")))
    rows = (_terms(base.join(F.broadcast(drawn), "doc_id"), [F.col("doc_id"), F.col("_y"), F.col("_weight")])
            .select("doc_id", "_y", "_weight", "_x").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").checkpoint())
    present = rows.select("_y").distinct().count()
    if present < 2:
        alone = rows.agg(F.min("_y")).first()[0]
        p = F.array(*[F.lit(float(k == int(alone or 0))) for k in range(len(domains))])
        return base.select("doc_id", F.size(words_of(text_or_empty())).cast("long").alias("n_tokens"), p.alias("p")), domains
    model = LogisticRegression(labelCol="_y", featuresCol="_x", weightCol="_weight", family="multinomial", regParam=RIDGE,
                               maxIter=MAX_ITER, standardization=False, probabilityCol="_p").fit(rows)
    scored = model.transform(_terms(base, [F.col("doc_id")]))
    p = vector_to_array("_p")
    if model.numClasses < len(domains):  # the last domains have no row in these documents
        p = F.concat(p, F.array(*[F.lit(0.0)] * (len(domains) - model.numClasses)))
    return scored.select("doc_id", n_tokens, p.alias("p")), domains


def _dot(p: str, u) -> Column:
    return sum((F.get(F.col(p), F.lit(k)) * F.lit(float(x)) for k, x in enumerate(u)), F.lit(0.0))


def expected_tokens(members: DataFrame, k: int, rate: Column | None = None) -> np.ndarray:
    rate = F.lit(1.0) if rate is None else rate
    row = members.agg(*[F.sum(rate * F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(k)]).first()
    return np.array([x or 0.0 for x in row])


def fit_rates(members: DataFrame, targets: list[float], floor: float | Column = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """``members`` (n_tokens, p, ...) with ``rate`` >= ``floor``: sums of rate * n_tokens * p
    match ``targets`` in weighted least squares.  ``members`` should be checkpointed."""
    k, goal = len(targets), np.asarray(targets, float)
    tokens = expected_tokens(members, k)
    weight = np.where(tokens > 0, 1 / np.where(tokens > 0, tokens, 1), 0.0)
    scale = max(goal.sum(), tokens.sum(), 1.0)
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    lowered = lambda c, u: F.greatest(floor, c - _dot("p", u))
    kept = [F.col(f"`{c}`") for c in members.columns]
    # _rate is the point reached, _ahead the point the gradient is taken at.
    held = members.select(*kept, F.greatest(floor, F.lit(1.0)).alias("_rate")).withColumn("_ahead", F.col("_rate"))
    pace, last, still = 1.0, None, 0
    for n in range(rounds):
        now = expected_tokens(held, k, F.col("_ahead"))
        still = still + 1 if last is not None and np.abs(now - last).max() <= STILL * scale else 0
        if still == 2 or np.abs(now - goal).max() <= STILL * scale:
            break
        last = now
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        push, pace = (pace - 1) / after, after
        held = (held.withColumn("_new", lowered(F.col("_ahead"), weight * (now - goal)))
                .select(*kept, F.col("_new").alias("_rate"),
                        (F.col("_new") + F.lit(push) * (F.col("_new") - F.col("_rate"))).alias("_ahead")))
        if n % FOLD == FOLD - 1:  # keep the plan short
            held = held.checkpoint()
    else:
        warnings.warn(f"rates have not settled after {rounds} rounds: expected tokens {now.tolist()}, targets {goal.tolist()}", stacklevel=2)
    return held.select(*kept, F.greatest(floor, "_ahead").alias("rate"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], relative: str = "share", floor: float = 0.0,
        per_domain: int = MAX_PER_DOMAIN, whole: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ..., rate) per row of ``docs``.

    ``targets``: domain -> share of all tokens (``relative="share"``), times the domain's
    expected tokens (``"epochs"``) or tokens (``"tokens"``); a domain left out has 0, but a single one
    that is left out has no mixture to meet: its rows have rate 1.  Rows whose likeliest
    domain is ``whole`` have a rate of 1 or more."""
    scored, domains = posteriors(docs, labelled, per_domain)
    members = scored.checkpoint()
    base = expected_tokens(members, len(domains))
    goal = np.array([targets.get(d, 0.0) for d in domains])
    if relative == "share":
        goal = goal * base.sum()
    elif relative == "epochs":
        goal = goal * base
    elif relative != "tokens":
        raise ValueError("relative is share, epochs or tokens")
    if len(domains) == 1 and domains[0] not in targets:
        fitted = members.withColumn("rate", F.lit(1.0))
    else:
        least = F.lit(float(floor))
        if whole in domains:
            likeliest = F.get("p", F.lit(domains.index(whole))) >= F.array_max("p")
            least = F.when(likeliest, F.lit(max(1.0, float(floor)))).otherwise(least)
        fitted = fit_rates(members, list(goal), least)
    return fitted.select("doc_id", "n_tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)], "rate")


def realise(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as its rate says.  Rows meet their rates by id; an
    id with several rows uses its smallest rate; a row without a rate stays once."""
    rates = rates.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("rate").alias("_rate"))
    whole = F.floor("_rate")
    draw = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.coalesce(whole + F.when(draw < F.col("_rate") - whole, F.lit(1)).otherwise(F.lit(0)), F.lit(1)).cast("int")
    return (docs.select(packed(docs), F.col("doc_id").alias("_id")).join(rates, "_id", "left").where(copies > 0)
            .select("_caller", F.explode(F.sequence(F.lit(1), copies)).alias("_copy")).select("_caller.*"))
