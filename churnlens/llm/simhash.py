"""Document fingerprints (SimHash) and search within a Hamming radius.

Terms are words (ASCII lower case) and runs of three words.  A term's 128-bit hash
votes on 128 signed counters with an integer weight (more for runs, damped by term
frequency); the sign of each counter is the bit.  Weights are integers, so the votes
do not depend on the order of addition and equal texts have equal fingerprints.

``find_within`` is exact: the 128 bits are cut into blocks, each with its own small
radius; the block radii plus one add up to ``radius`` + 1, so fingerprints within
``radius`` are within the block's radius in at least one block.  Each block is one table
keyed by its bits; the corpus has one row in each, a query one row for every key within
the block's radius.  Tables are rows of an equi-join, and a pair is kept in the first
table that holds it.  ``RADIUS`` is chosen from the distances of near copies at the
project's own level (5-word shingles, Jaccard 0.8 or more; README has the recall).

``with_next`` fingerprints each document's edited text, which needs the next document
in descending ``doc_id``.  Documents are range-partitioned by id and streamed in order;
only each partition's first and last text meet in a second, small join.

Defined results: null text counts as empty; a text without words has fingerprint zero;
ids sort null first, equal ids by text; repeated rows are neighbours of each other; a
single row is its own next; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import graph
from churnlens.llm.text import id_in, id_out, mix, word_hashes
from churnlens.session import ensure_checkpoint_dir, ship_package

BITS = 128
RADIUS = 18
BLOCKS = 8
_KEY_BITS = 48  # of a longer block, the first so many bits are its key
_ROWS = 256  # texts worked on at a time
_BYTE_AT = np.arange(BITS // 8) * 256
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float)


def _weights(counts: np.ndarray, scale: int) -> np.ndarray:
    return scale * (1 + np.floor(np.log2(counts)))


def fingerprint(ids: np.ndarray) -> np.ndarray:
    """Two uint64 (high, low half of the 128 bits) from the word hashes of a text."""
    if not len(ids):
        return np.zeros(2, np.uint64)
    terms, counts = np.unique(ids, return_counts=True)
    weights = _weights(counts, 1)
    if len(ids) > 2:
        runs = mix(mix(mix(ids[:-2]) + ids[1:-1]) + ids[2:])
        more, counts = np.unique(runs, return_counts=True)
        terms, weights = np.concatenate([terms, more]), np.concatenate([weights, _weights(counts, 2)])
    lanes = np.stack([mix(terms + np.uint64(0x9E3779B97F4A7C15)), mix(terms ^ np.uint64(0xD1B54A32D192ED03))], axis=1)
    # Weight of each value of each of the 16 hash bytes, then of each bit of the values.
    cells = lanes.byteswap().view(np.uint8) + _BYTE_AT
    votes = np.bincount(cells.ravel(), np.repeat(weights, BITS // 8), 32 * BITS).reshape(BITS // 8, 256) @ _BITS_OF
    return np.packbits(2 * votes.ravel() > weights.sum()).view(">u8").astype(np.uint64)


def _hex(fp: np.ndarray) -> str:
    return f"{int(fp[0]):016x}{int(fp[1]):016x}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
_STREAM = _RESULT + ", part int, edge int, text string"


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    return [fingerprint(ids) for ids in word_hashes(texts)]


def _results(rows) -> list[list]:
    """Result rows of (doc_id, text, fingerprint, next text, next fingerprint)."""
    news = [edited(text, following) for _, text, _, following, _ in rows]
    out = []
    for (doc_id, text, fp, _, next_fp), new, new_fp in zip(rows, news, fingerprints(news)):
        out.append([doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), _hex(fp),
                    _hex(new_fp), likeness(fp, new_fp), likeness(fp, next_fp)])
    return out


def _stream(batches):
    """Ascending ids of one partition: a row's next document is the row before it.
    The first row (edge 1) and the last row (edge 2) leave with their text."""
    part, last, names = TaskContext.get().partitionId(), None, [*_NAMES, "part", "edge", "text"]

    def edge(row, kind):
        doc_id, text, fp = row
        return _frame([[doc_id, len(text), None, _hex(fp), None, None, None, part, kind, text]], names)

    for pdf in batches:
        for k in range(0, len(pdf), _ROWS):
            ids, texts = list(pdf["doc_id"][k:k + _ROWS]), list(pdf["text"][k:k + _ROWS])
            rows = list(zip(ids, texts, fingerprints(texts)))
            if last is None:
                yield edge(rows[0], 1)
            pairs = [(*row, *before[1:]) for before, row in zip([*([last] if last else []), *rows], rows if last else rows[1:])]
            if pairs:
                yield _frame([[*r, part, 0, None] for r in _results(pairs)], names)
            last = rows[-1]
    if last is not None:
        yield edge(last, 2)


def _frame(rows, names) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _finish(batches):
    for pdf in batches:
        for k in range(0, len(pdf), _ROWS):
            part = pdf[k:k + _ROWS]
            texts, following = list(part["text"]), list(part["next_text"])
            rows = list(zip(part["doc_id"], texts, fingerprints(texts), following, fingerprints(following)))
            yield _frame(_results(rows), _NAMES)


def with_next(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and both likenesses."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    ordered = (docs.select(id_in("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    done = ordered.mapInPandas(_stream, _STREAM).checkpoint()
    # The numbers of the partitions that have rows (no ids, no texts).
    parts = sorted(r[0] for r in done.where("edge = 2").select("part").collect())
    before = spark.createDataFrame(list(zip(parts, [*parts[-1:], *parts[:-1]])), "part int, before int")
    tails = done.where("edge = 2").select(F.col("part").alias("before"), F.col("text").alias("next_text"))
    firsts = (done.where("edge = 1").select("doc_id", "text", "part").join(before, "part").join(tails, "before")
              .select("doc_id", "text", "next_text").mapInPandas(_finish, _RESULT))
    return done.where("edge = 0").select(*_NAMES).unionByName(firsts).withColumn("doc_id", id_out("doc_id"))


def _cuts(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """(start bit, length, radius) of the blocks that are needed."""
    ends = [BITS * (i + 1) // blocks for i in range(blocks)]
    own = [(radius + 1) // blocks + (i < (radius + 1) % blocks) - 1 for i in range(blocks)]
    return [(a, min(b - a, _KEY_BITS), r) for a, b, r in zip([0, *ends], ends, own) if r >= 0]


def _halves(fp):
    return [F.conv(F.substring(fp, k, 16), 16, -10).cast("long") for k in (1, 17)]


def _bits(high, low, start: int, length: int):
    """``length`` of the 128 bits, from bit ``start`` (0 is the highest)."""
    end, mask = start + length, F.lit((1 << length) - 1)
    if end <= 64:
        return F.shiftrightunsigned(high, 64 - end).bitwiseAND(mask)
    if start >= 64:
        return F.shiftrightunsigned(low, 128 - end).bitwiseAND(mask)
    return F.shiftleft(high, end - 64).bitwiseOR(F.shiftrightunsigned(low, 128 - end)).bitwiseAND(mask)


def _flips(length: int, radius: int) -> list[int]:
    """All words of ``length`` bits with at most ``radius`` ones."""
    return [sum(1 << k for k in c) for r in range(min(radius, length) + 1) for c in combinations(range(length), r)]


def find_within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (query_fp, fp, distance) of distinct fingerprints (column
    ``fingerprint``, 32 hex digits) at most ``radius`` bits apart, equal ones included."""
    if radius < 0 or not 1 <= blocks <= BITS:
        raise ValueError("a radius of 0 or more and 1 to 128 blocks are needed")
    cuts = _cuts(radius, blocks)

    def tabled(df, side, probe):
        high, low = F.col(f"{side}_high"), F.col(f"{side}_low")
        fp = df.select("fingerprint").where("fingerprint is not null").distinct()
        fp = fp.select(*[h.alias(c) for h, c in zip(_halves(F.col("fingerprint")), (f"{side}_high", f"{side}_low"))])
        keys = []
        for t, (start, length, near) in enumerate(cuts):
            key = _bits(high, low, start, length).bitwiseOR(F.lit(t << _KEY_BITS))
            flips = F.array(*[F.lit(x).cast("long") for x in (_flips(length, near) if probe else [0])])
            keys.append(F.transform(flips, key.bitwiseXOR))
        return fp.select(high, low, F.explode(F.flatten(F.array(*keys))).alias("key"))

    a, b = tabled(queries, "a", True), tabled(corpus, "b", False)
    apart = [F.col("a_high").bitwiseXOR(F.col("b_high")), F.col("a_low").bitwiseXOR(F.col("b_low"))]
    distance = F.bit_count(apart[0]) + F.bit_count(apart[1])
    first = F.coalesce(*[F.when(F.bit_count(_bits(*apart, start, length)) <= near, F.lit(t))
                         for t, (start, length, near) in enumerate(cuts)])
    met = (a["key"] == b["key"]) & (distance <= radius) & (F.shiftrightunsigned(a["key"], _KEY_BITS) == first)
    digits = lambda side: F.lower(F.concat(*[F.lpad(F.hex(f"{side}_{h}"), 16, "0") for h in ("high", "low")]))
    # Merged by hint: adaptive execution sizes the queries before they become a row a key and
    # would hand all their keys to the driver as a broadcast.
    return a.join(b.hint("merge"), met).select(digits("a").alias("query_fp"), digits("b").alias("fp"), distance.alias("distance"))


def near_classes(docs: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` (doc_id, fingerprint, ...) with ``n_near``, the rows within ``radius`` of an
    asked row (itself included; null for other rows), and ``near_class``: asked rows and
    the rows near them are linked, and a class is named by its smallest id.  Rows that no
    asked row is near to have no class."""
    copies = docs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).checkpoint()
    pairs = (find_within(docs.where(asked), copies, radius, blocks).join(copies.withColumnRenamed("fingerprint", "fp"), "fp")
             .join(copies.select(F.col("fingerprint").alias("query_fp"), F.col("first_id").alias("query_id")), "query_fp")
             .checkpoint())
    near = pairs.groupBy(F.col("query_fp").alias("fingerprint")).agg(F.sum("copies").alias("n_near"))
    links = pairs.where("query_id is not null and first_id is not null").select(F.col("query_id").alias("a"), F.col("first_id").alias("b"))
    roots = graph.components(links).withColumnRenamed("node", "first_id")
    # A fingerprint linked to itself alone has no root; its class is its own id.
    found = (pairs.select(F.col("fp").alias("fingerprint"), "first_id").distinct().join(roots, "first_id", "left")
             .select("fingerprint", F.coalesce("root", "first_id").alias("near_class")).join(near, "fingerprint", "left"))
    return docs.join(found, "fingerprint", "left").select(
        *[docs[c] for c in docs.columns], F.when(asked, F.col("n_near")).alias("n_near"), "near_class")
