"""Fill-in-the-middle rewriting of whole texts.

A text's unit ends (line ends, or every code point) are kept in a compressed boundary
set: the upper bits of an offset name a container of 65,536 offsets, and a container is
a sorted array, a bitmap or a list of runs, whichever is smallest (arrays hold at most
4,096 offsets).  Cumulative cardinalities over the containers lead a select to its
container by binary search; the container answers the rest locally: by index, by
cumulative word counts, or by cumulative run lengths.  Two selects give both cuts.

Cuts, form and order come from a hash of the seed and the id, so a rerun, a lost
executor or another partitioning gives the same rows.  No shuffle; a batch holds
``CHUNK`` texts.

Defined results: a null text is empty; an empty text, and one that holds a sentinel
already, stays ``plain``; a null id is hashed as no digits; equal ids are cut by the
same draws; extra columns are kept, those named like a result column (in any case) are
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.session import ship_package

CHUNK = 256
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
_OUT = [("form", T.StringType()), ("n_units", T.LongType()), ("prefix_chars", T.LongType()),
        ("middle_chars", T.LongType()), ("output", T.StringType())]

BITS = 16
ARRAY_MOST = 4096
_BITMAP_BYTES = (1 << BITS) // 8


class _Array:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])

    def rank(self, x: int) -> int:
        return int(np.searchsorted(self.low, x))


class _Bitmap:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def _word(self, w: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words[w:w + 1].view(np.uint8), bitorder="little"))

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, "right")) - 1
        return 64 * w + int(self._word(w)[k - self.before[w]])

    def rank(self, x: int) -> int:
        w, bit = divmod(x, 64)
        return int(self.before[w] + (self._word(w) < bit).sum())


class _Runs:
    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[r]) + int(k - self.before[r])

    def rank(self, x: int) -> int:
        r = int(np.searchsorted(self.starts, x, "right")) - 1
        if r < 0:
            return 0
        return int(min(self.before[r] + x - int(self.starts[r]), self.before[r + 1]))


def _container(low: np.ndarray):
    """The smallest container of sorted distinct offsets below 2 ** 16."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(first) < min(2 * len(low), _BITMAP_BYTES):
        return _Runs(low[first], np.diff(first, append=len(low)))
    return _Array(low) if len(low) <= ARRAY_MOST else _Bitmap(low)


class BoundarySet:
    """A set of offsets, built from sorted distinct numbers."""

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, np.int64)
        high = offsets >> BITS
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[first]
        self.containers = [_container(part & ((1 << BITS) - 1)) for part in np.split(offsets, first[1:])] if len(first) else []
        self.before = np.concatenate([first, [len(offsets)]]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from zero."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[c]) << BITS) + self.containers[c].select(int(k - self.before[c]))

    def rank(self, x: int) -> int:
        """How many offsets are smaller than ``x``."""
        c = int(np.searchsorted(self.keys, x >> BITS))
        if c == len(self.keys) or self.keys[c] != x >> BITS:
            return int(self.before[c])
        return int(self.before[c]) + self.containers[c].rank(x & ((1 << BITS) - 1))


def unit_ends(text: str, unit: str = "line") -> np.ndarray:
    """Offsets after each unit, in code points: lines keep their line feed, and a last
    line needs none."""
    n = len(text)
    if unit == "char":
        return np.arange(1, n + 1)
    if unit != "line":
        raise ValueError("a unit is a line or a char")
    points = (np.frombuffer(text.encode(), np.uint8) if text.isascii()
              else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    ends = np.flatnonzero(points == 10) + 1
    return ends if not n or len(ends) and ends[-1] == n else np.append(ends, n)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def rearrange(text: str, doc_id: int | None, seed: int = 7, rate: int = 100, spm_share: int = 50, unit: str = "line",
              sentinels=SENTINELS) -> tuple[str, int, int | None, int | None, str]:
    """(form, units, prefix length, middle length, output) of one text."""
    ends = BoundarySet(unit_ends(text, unit))
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        return "plain", n, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends.select(k - 1) if k else 0 for k in (a, b))
    p, s, m = sentinels
    if h4 % 100 < spm_share:
        return "spm", n, a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return "psm", n, a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50, unit: str = "line",
              sentinels=SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with form (plain, psm or spm), n_units, prefix_chars, middle_chars (null
    if plain) and output.  ``rate``: per cent of texts rewritten; ``spm_share``: per cent
    of these with the suffix first."""
    sentinels = tuple(sentinels)
    if len({*sentinels}) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    kept = docs.drop(*(c for c, _ in _OUT))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, t in _OUT)])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                found = [rearrange(t or "", i, seed, rate, spm_share, unit, sentinels)
                         for i, t in zip(part.column(id_col).to_pylist(), part.column(text_col).to_pylist())]
                made = [pa.array(values, kind) for values, kind in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(c for c, _ in _OUT)])

    ship_package(docs.sparkSession)
    return kept.mapInArrow(run, schema)


def restore(form: str = "form", output: str = "output", sentinels=SENTINELS) -> Column:
    """The text that an output was made from, as a Spark column."""
    p, s, m = sentinels
    parts = F.split(F.col(output), "|".join(re.escape(x) for x in (p, s, m)))
    # psm: '', prefix, suffix, middle; spm: '', suffix, prefix, middle
    return (F.when(F.col(form) == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
            .when(F.col(form) == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
            .otherwise(F.col(output)))
