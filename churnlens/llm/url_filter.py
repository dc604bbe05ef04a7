"""URL filter by rules and link-graph propagation.

Rules (host, path prefix, verdict) decide the urls they fit; the longest fitting
rule wins.  Every other url gets the verdict of its host, found by propagation over
host edges: personalised PageRank spreads trust from hosts with allowed pages along
links, and distrust from hosts with blocked pages against the links (who links to a
blocked host is suspect).  A host is blocked when its distrust exceeds its trust by
more than ``margin`` (and ``TIE``, for the fit's residual) of their sum, however small
both are; a host that neither reaches is allowed.

Host edges come from absolute links in the html (counted per host pair before they
move) and from each host to those parent domains that are hosts of pages themselves.
Rounds go on until no score grows by more than ``RESIDUAL`` of itself, so every host
that a seed reaches has its score; a round's work follows the edges.  Seeds, edges and
scores are aggregated per host first; only ids, hosts and paths meet the verdicts,
in an equi-join that Spark splits when one host is hot.

Defined results: a null url, or one without ``://``, has empty host and path, fits
no rule and is allowed (no host, no evidence); a null html has no links; a score too small
for a double is zero, and is passed on as nothing; repeated
rows are judged alike; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir

# Fixed values of the query contract: (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MAX_RULES = 1000  # rules are literals in the plan
DAMPING = 0.85
ROUNDS = 10  # of the SQL twin; the filter itself goes on until the scores stand still
MARGIN = 0.0
RESIDUAL = 1e-7  # growth of a score in the last round, relative to the score
TIE = 1e-6  # trust and distrust that differ by less of their sum count as equal
FOLD = 4  # rounds between checkpoints
LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return base.withColumns({"rule": name, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, and hosts to parent domains."""
    links = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link")
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    linked = (pages.select(host_of(F.col("url")).alias("src"), links)
              .select("src", host_of(full).alias("dst"))
              .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
              .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    hosts = pages.select(host_of(F.col("url")).alias("src")).where("src != ''").distinct()
    labels = F.split("src", r"\.")
    parents = F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
                                    lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    up = (hosts.select("src", parents.alias("dst")).where("dst != '' and dst != src")
          .join(hosts.withColumnRenamed("src", "dst"), "dst", "left_semi")
          .select("src", "dst", F.lit(1).cast("long").alias("n")))
    return linked.unionByName(up).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _ways(edges: DataFrame) -> DataFrame:
    """(at, kind, to, share): where a host's scores go, checkpointed."""
    ways = (edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit("trust").alias("kind"), "n")
            .unionByName(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit("distrust").alias("kind"), "n")))
    # Written out: a join right above its aggregate could not be split at a hot host.
    ways = ways.checkpoint()
    total = ways.groupBy("at", "kind").agg(F.sum("n").alias("all")).checkpoint()
    return ways.join(total, ["at", "kind"]).select("at", "kind", "to", (F.col("n") / F.col("all")).alias("share")).checkpoint()


def _moved(ways: DataFrame, state: DataFrame, damping: float) -> DataFrame:
    return (ways.join(state.withColumnRenamed("host", "at"), ["at", "kind"])
            .select(F.col("to").alias("host"), "kind", (F.lit(damping) * F.col("share") * F.col("score")).alias("score")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
              residual: float = RESIDUAL) -> DataFrame:
    """Scores per (host, kind) from seeds (host, kind, seed): ``trust`` follows the
    edges, ``distrust`` runs against them.  Mass at hosts without a way on is dropped.

    Without ``rounds``, scores start from the teleport vector and what arrived in a round
    is passed on in the next, until that is at most ``residual`` of every score.  The
    largest such ratio never rises, and it is 1 while new hosts are reached, so none is
    left out.  With ``rounds``, so many plain rounds from the seeds."""
    ensure_checkpoint_dir(edges.sparkSession)
    ways = _ways(edges)
    start = seeds.select("host", "kind", (F.lit(1 - damping) * F.col("seed")).alias("score"))
    if rounds is not None:
        state = seeds.select("host", "kind", F.col("seed").alias("score"))
        for _ in range(rounds):
            state = (start.unionByName(_moved(ways, state, damping)).groupBy("host", "kind")
                     .agg(F.sum("score").alias("score")))
        return state
    state = start.groupBy("host", "kind").agg(F.sum("score").alias("score")).withColumn("new", F.col("score")).checkpoint()
    # A score that has underflowed to zero grows by nothing.
    while (state.agg(F.max(F.try_divide("new", "score"))).first()[0] or 0.0) > residual:
        for _ in range(FOLD):
            fresh = state.where("new > 0").select("host", "kind", F.col("new").alias("score"))
            state = (state.select("host", "kind", "score", F.lit(0.0).alias("new"))
                     .unionByName(_moved(ways, fresh, damping).withColumn("new", F.col("score")))
                     .groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("new").alias("new")))
        state = state.checkpoint()
    return state.select("host", "kind", "score")


def host_verdicts(judged: DataFrame, edges: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(host, trust, distrust, host_verdict) of the hosts that propagation reaches."""
    seeds = (judged.where("rule is not null").groupBy("host", "rule_verdict").agg(F.count(F.lit(1)).alias("n"))
             .select("host", F.when(F.col("rule_verdict") == "allow", F.lit("trust")).otherwise(F.lit("distrust")).alias("kind"),
                     F.col("n").cast("double").alias("seed")))
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    scores = propagate(seeds, edges).groupBy("host").agg(part("trust").alias("trust"), part("distrust").alias("distrust"))
    excess = F.col("distrust") - F.col("trust") - max(margin, TIE) * (F.col("distrust") + F.col("trust"))
    return scores.withColumn("host_verdict", F.when(excess > 0, F.lit("block")).otherwise(F.lit("allow")))


def judge(pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (pages a
    rule decides have them too; rounded to 6 places)."""
    judged = parsed(pages, rules)
    hosts = host_verdicts(judged, host_edges(pages), margin).checkpoint()
    return (judged.join(hosts, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
                    F.round(F.coalesce("trust", F.lit(0.0)), 6).alias("trust"),
                    F.round(F.coalesce("distrust", F.lit(0.0)), 6).alias("distrust")))
