"""Byte-level BPE encoding and decoding.

A text is cut at special tokens, then into pieces by the published pattern; a piece's
bytes are merged by rank.  The merge order comes from a segment tree over the adjacent
pairs: a leaf holds a pair's rank, an inner node the smaller of its children (the left
one on ties), so the root names the leftmost pair of lowest rank.  A merge changes at
most three leaves, each updated in logarithmic time, until no pair can be merged.  A
piece of n bytes costs n log n, however long it is.  The trees of the short pieces (up to
``WIDE`` bytes) that a batch meets for the first time stand side by side in arrays and
take each step together; a longer piece has a tree of its own.

Words repeat, so each worker remembers up to ``KEEP`` encoded words (a bound on
memory only).  A batch's words are looked up, the new ones merged, and the ids gathered by
position, without an object for a token.  Texts are read and returned as Arrow batches, a
few hundred texts at a time; encoding needs no shuffle.

The vocabulary file is read on the driver (its path is a parameter), cut down to ranks
and ids, and broadcast: its size is that of the vocabulary, not of the data.

Defined results: null text encodes as empty (no ids, decoded to the empty text); bytes
that are not UTF-8 after decoding become U+FFFD as in the published decoder; ids out of
the vocabulary are skipped; rows are independent, and extra columns are kept (columns
named like a result column are replaced).
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.session import ship_package

KEEP = 500_000
KEEP_IDS = 16_000_000  # ids of remembered words
CHUNK = 256  # texts per returned batch
WIDE = 64
_NONE = 1 << 60

# Fixed value: the published pattern of this tokenizer, with \s spelled out as the
# characters of the Unicode property White_Space.
_S = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^" + _S + r"{LN}]+|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + r"]+")
UNITS = r" ?[^" + _S + r"]+|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + r"]+"


# Letters and numbers that Unicode 16, the version of the published encoder,
# added to 15.1.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
              (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def pieces_pattern() -> str:
    """The pattern, with letters and numbers as Unicode 16 has them: the ``regex``
    package's own classes without what later versions added."""
    kinds = {"L": LETTERS_16, "N": NUMBERS_16}
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    first = [unicodedata.category(c)[0] for c in points]
    classes = {}
    for kind, added in kinds.items():
        known = {c for c, k in zip(points, first) if k == kind}
        known.update(chr(i) for a, b in added for i in range(a, b + 1))
        property_ = regex.compile(rf"\p{{{kind}}}").match
        classes[kind] = rf"\p{{{kind}}}", _ranges(c for c in points if property_(c) and c not in known), \
            _ranges(c for c in sorted(known) if not property_(c))
    own = {k: f"[[{p}{more}]--[{less}]]" if less else f"[{p}{more}]" for k, (p, less, more) in classes.items()}
    return PIECES.replace("[^" + _S + "{LN}]", f"[^{_S}{own['L']}{own['N']}]").replace("{L}", own["L"]).replace("{N}", own["N"])


def _ranges(chars) -> str:
    """A character class's inside."""
    spans: list[list[int]] = []
    for i in map(ord, chars):
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Ranks and ids of a byte-level BPE file.

    ``merges`` maps ``left << 20 | right`` to ``rank << 20 | merged id``, so one number
    both orders a pair and says what it becomes."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.byte_ids = [ids[c] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 20 | ids[b]] = rank << 20 | ids[a + b]
        self.bytes_of = {i: bytes(byte[c] for c in token) for token, i in ids.items()}
        self.pieces = pieces_pattern()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def merge(ids: list[int], merges: dict) -> list[int]:
    """Merge the leftmost pair of lowest rank until none can be merged."""
    n = len(ids)
    if n < 2:
        return ids
    get = merges.get
    # Leaf size + k is the pair that begins at position k; node i holds the smaller of
    # its children 2i and 2i + 1, so tree[1] is the least of all.
    size = 1 << (n - 1).bit_length()
    level = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
    if min(level) == _NONE:
        return ids
    tree = [_NONE] * size + level + [_NONE] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    least = tree[1]
    ids = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while least != _NONE:
        i = 1
        while i < size:  # down to the leftmost leaf that holds the least
            i <<= 1
            if tree[i] != least:
                i += 1
        k = i - size
        right = after[k]
        ids[k] = new = least & 0xFFFFF
        ids[right] = -1
        nxt = after[k] = after[right]
        tree[size + right] = _NONE
        if nxt < n:
            before[nxt] = k
            tree[i] = get(new << 20 | ids[nxt], _NONE)
        else:
            tree[i] = _NONE
        changed = (size + right, i)
        prev = before[k]
        if prev >= 0:
            tree[size + prev] = get(ids[prev] << 20 | new, _NONE)
            changed = (size + right, i, size + prev)
        for i in changed:  # up to the root, or to a node that stays as it was
            while i > 1:
                a, b = tree[i], tree[i ^ 1]
                i >>= 1
                if b < a:
                    a = b
                if tree[i] == a:
                    break
                tree[i] = a
        least = tree[1]
    return [i for i in ids if i >= 0]


class _Pairs:
    """Merges by pair for arrays of ids: what ``Vocabulary.merges`` says, or ``_NONE``."""

    def __init__(self, merges: dict):
        self.keys = np.array(sorted(merges), np.int64)
        self.values = np.array([merges[k] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NONE)


def merge_many(ids: np.ndarray, lengths: np.ndarray, pairs: _Pairs) -> np.ndarray:
    """``merge`` of many rows of at most ``size`` (a power of two) ids at once: row r holds
    ``lengths[r]`` ids, then -1.  Merged-away places hold -1 in the result.

    Row r's tree is row r of ``tree``: leaf size + k is the pair that begins at place k."""
    m, size = ids.shape
    depth = size.bit_length() - 1
    places = np.arange(size)
    ids = np.hstack([ids, np.full((m, 1), -1)]).astype(np.int64)  # place ``size``: no neighbour
    after = np.where(places + 1 < lengths[:, None], places + 1, size)
    before = np.broadcast_to(np.append(np.where(places, places - 1, size), size), (m, size + 1)).copy()
    tree = np.full((m, 2 * size), _NONE, np.int64)
    tree[:, size:] = pairs(ids[:, :-1], np.take_along_axis(ids, after, 1))
    for level in range(depth - 1, -1, -1):
        h = 1 << level
        tree[:, h:2 * h] = np.minimum(tree[:, 2 * h:4 * h:2], tree[:, 2 * h + 1:4 * h:2])
    t, flat, nxt, prv = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
    rows = np.flatnonzero(tree[:, min(1, 2 * size - 1)] != _NONE)
    while len(rows):
        root, at, link, back = rows * (2 * size), rows * (size + 1), rows * size, rows * (size + 1)
        least = t[root + 1]
        i = np.ones(len(rows), np.int64)
        for _ in range(depth):  # down to the leftmost leaf that holds the least
            i <<= 1
            i += t[root + i] != least
        k, new = i - size, least & 0xFFFFF
        right = nxt[link + k]
        follow = nxt[link + right]
        flat[at + k], flat[at + right] = new, -1
        nxt[link + k], prv[back + follow] = follow, k
        p = prv[back + k]
        first = p == size
        t[root + size + right] = _NONE
        t[root + i] = ahead = pairs(new, flat[at + follow])
        p = np.where(first, k, p)
        t[root + size + p] = np.where(first, ahead, pairs(np.where(first, -1, flat[at + p]), new))
        for j in (size + right, i, size + p):  # up to the root
            for _ in range(depth):
                j = j >> 1
                t[root + j] = np.minimum(t[root + 2 * j], t[root + 2 * j + 1])
        rows = rows[t[root + 1] != _NONE]
    return ids[:, :-1]


class Encoder(dict):
    """unit -> number, for up to ``KEEP`` remembered units; a number's ids stand in one
    array.

    A unit is a run without white space with the single space before it, or a run of
    white space; pieces never reach over a unit's end, so units encode on their own."""

    def __init__(self, vocabulary: Vocabulary, keep: int = KEEP):
        super().__init__()
        self.v, self.keep = vocabulary, keep
        self.units = re.compile(UNITS).findall
        self.pieces = regex.compile(vocabulary.pieces, regex.V1).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pairs, self.byte_ids = _Pairs(vocabulary.merges), np.array(vocabulary.byte_ids, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self._add(list(self.v.special), [[i] for i in self.v.special.values()])

    def _add(self, units: list[str], ids) -> None:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([np.asarray(i, np.int32) for i in ids]) if len(ids) else np.empty(0, np.int32)
        self._put(units, flat, counts)

    def _put(self, units: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        self.update(zip(units, range(len(self.counts), len(self.counts) + len(units))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, flat])

    def _learn(self, units: list[str]) -> None:
        """Merge units that are not remembered."""
        pieces, of_unit = [], []
        for u in units:
            found = [u] if u.lstrip(" ").isalpha() else self.pieces(u)
            pieces += found
            of_unit.append(len(found))
        numbers = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        flat, counts = self._merged([p.encode("utf-8", "replace") for p in numbers])
        own = np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))
        per_unit = np.add.reduceat(np.append(counts[own], 0), np.cumsum([0, *of_unit])[:-1]) if units else counts[:0]
        self._put(units, _gather(flat, np.cumsum(counts) - counts, counts, own), per_unit)

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, counts, ids
        size = 1
        while size <= WIDE:
            at = np.flatnonzero((lengths <= size) & (lengths > size // 2))
            for some in np.split(at, range(1 << 14, len(at), 1 << 14)):
                if len(some):
                    n = lengths[some]
                    held = np.arange(size) < n[:, None]
                    rows = np.full((len(some), size), -1, np.int64)
                    rows[held] = self.byte_ids[np.frombuffer(b"".join([pieces[k] for k in some]), np.uint8)]
                    rows = merge_many(rows, n, self.pairs)
                    done.append((some, (rows >= 0).sum(axis=1), rows[rows >= 0]))
            size *= 2
        for k in np.flatnonzero(lengths > WIDE).tolist():
            ids = merge(self.byte_ids[np.frombuffer(pieces[k], np.uint8)].tolist(), self.v.merges)
            done.append((np.array([k]), np.array([len(ids)]), np.array(ids)))
        counts = np.zeros(len(pieces), np.int64)
        if not done:
            return np.empty(0, np.int32), counts
        order, found, flat = (np.concatenate(x) for x in zip(*done))
        counts[order] = found
        place = np.empty(len(pieces), np.int64)
        place[order] = np.cumsum(found) - found
        return _gather(flat.astype(np.int32), place, counts, np.arange(len(pieces))), counts

    def _cut(self, text: str) -> list[str]:
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self.units(text)
        units, at = [], 0
        for m in found:
            units += self.units(text[at:m.start()])
            units.append(m[0])
            at = m.end()
        return units + self.units(text[at:])

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each has)."""
        if len(self) > self.keep or len(self.ids) > KEEP_IDS:
            self._forget()
        units, per_text = [], []
        for text in texts:
            cut = self._cut(text)
            units += cut
            per_text.append(len(cut))
        new = [u for u in dict.fromkeys(units) if u not in self]
        if new:
            self._learn(new)
        own = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        ends = np.cumsum([0, *per_text])
        totals = np.concatenate([[0], np.cumsum(self.counts[own])])
        return _gather(self.ids, self.starts, self.counts, own), np.diff(totals[ends])

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The stretches ``own`` (start and count each) of ``flat``, one after another."""
    n = counts[own]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[own] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def decode_ids(ids, bytes_of: dict) -> str:
    return b"".join(map(bytes_of.get, ids, [b""] * len(ids))).decode("utf-8", "replace")


def _token_table(bytes_of: dict) -> np.ndarray:
    """Bytes by id, with one place more for ids out of the vocabulary."""
    table = np.full(max(bytes_of) + 2, b"", dtype=object)
    for i, b in bytes_of.items():
        table[i] = b
    return table


def decode_lists(lists: pa.ListArray, table: np.ndarray) -> list[str]:
    """The texts of many lists of ids; null counts as empty."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    tokens = table[np.where((flat >= 0) & (flat < len(table)), flat, len(table) - 1).astype(np.int64)].tolist()
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [b"".join(tokens[a:b]).decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


def _per_batch(df: DataFrame, col: str, out: str, kind, make) -> DataFrame:
    """``df`` with ``out``: ``make()`` gives a function of the Arrow column ``col``, called
    for ``CHUNK`` rows at a time."""
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, kind)])

    def run(batches):
        fn = make()
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                yield pa.RecordBatch.from_arrays([*part.columns, fn(part.column(col))], names=[*part.schema.names, out])

    ship_package(df.sparkSession)
    return kept.mapInArrow(run, schema)


def shared(spark: SparkSession, path: str):
    """The vocabulary as a broadcast variable."""
    return spark.sparkContext.broadcast(load(path))


def encode(df: DataFrame, vocabulary, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out`` array<int>, the token ids of the whole text."""

    def make():
        encoder = Encoder(vocabulary.value)

        def run(texts):
            flat, counts = encoder.encode_many([t or "" for t in texts.to_pylist()])
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat))

        return run

    return _per_batch(df, text_col, out, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text of the ids (special tokens kept)."""

    def make():
        table = _token_table(vocabulary.value.bytes_of)
        return lambda lists: pa.array(decode_lists(lists, table), pa.string())

    return _per_batch(df, ids_col, out, T.StringType(), make)


def ids_digest(ids: str = "ids"):
    """SHA-256 of the decimal ids joined by commas, lowercase hex."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
