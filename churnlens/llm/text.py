"""Text helpers shared by the corpus operators.

A *word* is a run of characters other than space and the five ASCII white-space
controls (``[^\\x20\\x09-\\x0D]+``); case folding touches A-Z only.  Both a
Spark-column form and a Python form are kept here so that they agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


# Stands for a null id where a batch leaves the JVM: pandas would turn a column of
# ids with nulls into floats.  It sorts first, as null does.
NO_ID = -(1 << 63)


def id_in(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("long"), F.lit(NO_ID))


def id_out(col: str) -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))


def packed(df: DataFrame, *left_out: str) -> Column:
    """The columns of ``df`` but ``left_out`` (in any case) as one struct ``_caller``, so
    that no name of theirs can clash with a working column; ``_caller.*`` unpacks it."""
    gone = {c.lower() for c in left_out}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]
    return F.struct(*kept).alias("_caller")


def words_of(text: Column) -> Column:
    """array<string> of the words, in order."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row.

    Higher-order functions evaluate an outer expression again for every
    element; binding it to a lambda variable avoids that."""
    return F.transform(F.array(value), body)[0]


# Hashing of all words of many texts at once.  A word's hash is the polynomial
# sum(T[byte_k] * B^k) modulo 2^64, k from the word's start, through a finaliser; sums
# over words are differences of one running sum, so no word becomes a Python object.
_rng = np.random.Generator(np.random.PCG64(20240229))
_OF_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)
CHUNK_BYTES = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_B, _B_INVERSE)):
            table = np.full(n, b, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def _chunk_hashes(texts: list[bytes]) -> list[np.ndarray]:
    joined = b" ".join([b"", *texts, b""]).lower()  # folds A-Z only
    data = np.frombuffer(joined, np.uint8)
    power, inverse = _power_tables(len(data) + 1)
    space = _IS_SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * power[:len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(starts, first)
    return [hashes[a:b] for a, b in zip(cuts, cuts[1:])]


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order, A-Z folded to a-z."""
    out, group, size = [], [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(raw) > CHUNK_BYTES:
            out += _chunk_hashes(group)
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    return out + _chunk_hashes(group) if group else out
