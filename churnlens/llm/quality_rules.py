"""Rule bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one ``fail_bits`` number (bit b set: rule b failed).  Policies are versioned
masks over those bits, so a new policy or an ablation never reads text again:
policies are bit tests, and ablations aggregate the few distinct bit patterns.

Everything is a Spark column expression.  Repeated 3-word windows are found
inside the row: windows are hashed (64 bit), and only rows with a repeated hash
sort ``(hash, position)`` pairs and compare neighbours, so a text of n words
costs n log n and no shuffle.

Defined results: null text counts as empty; an empty text has zero in every
measurement and fails ``few_words``.  Rows are independent, so ties and repeated
rows give equal results; extra columns are carried along (columns named like a
ledger column, in any case, are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.text import SPACES, let, packed, text_or_empty, words_of

# Fixed values of the query contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_shouts")


def _dropped(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice."""
    n = F.size(words)
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
                     1, F.greatest(n - 2, F.lit(0)))

    def covered(starts):
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeated(pairs):
        same = lambda x, j: F.coalesce(x["h"] == F.get(pairs, j)["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def count(hs):
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0))
                .otherwise(let(let(pairs, repeated), covered)))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, count)).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column  # over the measurement columns


def rules() -> list[Rule]:
    """The rule book; a rule's position is its bit."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < MIN_WORDS),
        Rule("repeated_words", 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")),
        Rule("many_symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("many_shouts", 5 * c("n_shouts") > c("n_words")),
        Rule("repeated_lines", (c("n_dup_lines") >= 2) & (2 * c("n_dup_lines") > c("n_lines"))),
        Rule("odd_word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 25 * c("n_words"))),
    ]


BIT = {r: i for i, r in enumerate(("few_words", "repeated_words", "many_symbols", "many_shouts",
                                   "repeated_lines", "odd_word_length"))}


def mask(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


BASE_MASK = mask("few_words", "repeated_words")
# Versioned policies: a version is never changed, a new one is added.
POLICIES = {
    "base": BASE_MASK,
    "v1": BASE_MASK | mask("many_symbols", "repeated_lines"),
    "v2": BASE_MASK | mask("many_symbols", "many_shouts", "repeated_lines", "odd_word_length"),
}
CURRENT = "v2"


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without their text, with the measurements and ``fail_bits``."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    parts = docs.select(
        packed(docs, text_col, *MEASURES, "fail_bits"), words_of(text).alias("_words"), lines.alias("_lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _dropped(text, SYMBOLS).alias("n_symbols"), _dropped(text, "!").alias("n_shouts"))
    measured = parts.select(
        "_caller", F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"), "n_shouts")
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules()):
        bits = bits + F.when(r.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return measured.select("_caller.*", *MEASURES, bits.alias("fail_bits"))


def kept_by(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(book: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: documents kept, documents the rule fails, documents only
    this rule rejects (``sole``: kept again if it were left out).

    The ledger is first counted per bit pattern (at most 2^rules rows), then every
    policy and rule is a bit test over those patterns."""
    policies = POLICIES if policies is None else policies
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    tests = F.explode(F.array(*[
        F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"),
                 F.lit(1 << b).cast("long").alias("bit"))
        for v, m in sorted(policies.items()) for r, b in BIT.items() if m >> b & 1]))
    hit = F.col("fail_bits").bitwiseAND(F.col("t.mask"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return (patterns.select("fail_bits", "n", tests.alias("t"))
            .groupBy(F.col("t.policy").alias("policy"), F.col("t.rule").alias("rule"))
            .agg(total(hit == 0).alias("kept"),
                 total(F.col("fail_bits").bitwiseAND(F.col("t.bit")) != 0).alias("failed"),
                 total(hit == F.col("t.bit")).alias("sole")))
