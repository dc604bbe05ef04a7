"""N-gram Jaccard join in metric space.

Jaccard distance d = 1 - |x n y| / |x u y| is a metric, so d(x, y) <= r implies
|d(x, p) - d(y, p)| <= r for every pivot p.

1. A text becomes the set of its distinct word n-grams (64-bit hashes).  Texts with
   one set are one class with a number of its own; its smallest id stands for it, so
   groups of copies of any size leave by a partially aggregated ``groupBy``.
2. A set's shingles are ordered from rare to common.  Two sets within r share one of
   the first n - ceil(t n) + 1 shingles (t = 1 - r), so every set needs to meet only
   the sets that share a shingle of this *rim*.  The smallest number among the classes
   that share a rim shingle becomes a pivot; a set belongs to the region of every pivot it
   shares one with, which replicates the sets that lie between regions.  A pair within
   r always has a region in common.  Shingles that stand in one class's rim only leave
   before any set is joined or moved (by a filter of their hashes, then exactly).
3. A set's shingle counts over fixed parts of the universe are its distances to
   as many fixed pivots in the symmetric-difference metric; the triangle inequality over
   them splits a region, before any set is moved, into the groups that possible links
   connect, and drops the members that no other can be within r of: first with 16 counts
   (32 bytes a member), then, for the members left, with up to ``PARTS``.
4. A region is joined exactly, in one task if it is small.  Above ``LEAF`` sets it picks
   pivots, measures all sets against them, gives each set to its nearest pivot (Voronoi
   cells) and copies it to each cell q with d(x, q) <= d(x, nearest) + 2r (the triangle
   inequality puts every partner of a cell's set in that window); cells join recursively.
   Cells that do not get smaller, and leaves, are joined by exact overlap counts.
5. A region above ``BLOCK`` sets is dealt into blocks, and pairs of blocks are joined like
   regions, so no task holds more than two blocks.  A region returns a spanning forest of
   its links (at most one edge for each set), never all pairs.
6. Edges of all regions meet in ``graph.components``.

The order of shingles affects speed only; it comes from counts of all shingles of all
texts in a table of fixed size (``2 ** ORDER_BITS`` counters).  Rim shingles of several
classes, and the documents whose sets are built, are told by filters of ``2 ** WANTED_BITS``
bits, which let others through at worst.  These three are all that is broadcast.

Defined results: null and empty texts, and texts without words, have an empty set and
are linked with nothing; a text of fewer words than n is one shingle; equal sets are
linked, with distance zero; rows that repeat an id with one text are one document, with
several texts each row is linked by its own; a row
without an id is linked only as a copy (component null if no copy has an id); extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.graph import components
from churnlens.llm.text import NO_ID, id_in, id_out, mix, word_hashes
from churnlens.session import ensure_checkpoint_dir, ship_package

ORDER_BITS = 17
LEAF = 8            # sets joined by overlap counts without another split
PIVOTS = 4          # pivots of a split
BLOCK = 512         # sets of one block
PARTS = 1024        # most parts of the universe that a sketch counts
WANTED_BITS = 24    # size of the filter on the documents whose sets are built
RUN = 8192          # numbers that reach the driver as one row


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams of a text, from its word hashes; repeats included."""
    if not len(ids):
        return np.empty(0, np.uint64)
    k = min(n, len(ids))
    out = np.full(len(ids) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out + ids[j:len(ids) - k + 1 + j])
    return out


def signature(sh: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed 64-bit numbers."""
    a, b = mix(sh + np.uint64(0x9E3779B97F4A7C15)), mix(sh ^ np.uint64(0xD1B54A32D192ED03))
    return int(a.sum().astype(np.int64)), int((b.sum() ^ np.uint64(len(sh))).astype(np.int64))


def sketch(sh: np.ndarray) -> bytes:
    """Shingles per part of the universe, about 16 in a part; the number of parts is a
    power of two from 16 to ``PARTS``, so a finer sketch folds into a coarser one."""
    parts = min(PARTS, 1 << max(4, (len(sh) >> 4).bit_length()))
    return np.bincount((sh & np.uint64(parts - 1)).astype(np.int64), minlength=parts).astype(np.uint32).tobytes()


def coarse(sh: np.ndarray) -> bytes:
    """Shingles in each of 16 parts; a clipped count keeps the bound on differences."""
    return np.minimum(np.bincount((sh & np.uint64(15)).astype(np.int64), minlength=16), 0xFFFF).astype(np.uint16).tobytes()


def _buckets(sh: np.ndarray) -> np.ndarray:
    return (sh >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _slices(batches, *columns):
    """Lists of the columns, a bounded number of rows at a time."""
    for pdf in batches:
        for k in range(0, len(pdf), 256):
            yield [list(pdf[c][k:k + 256]) for c in columns]


def _occurrences(n: int):
    def run(batches):
        totals = np.zeros(1 << ORDER_BITS, np.int64)
        for (texts,) in _slices(batches, "text"):
            found = [shingles(ids, n) for ids in word_hashes(texts)]
            totals += np.bincount(_buckets(np.concatenate(found)), minlength=len(totals)) if found else 0
        used = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": used, "total": totals[used]})

    return run


_FACTS = "doc_id long, n long, s1 long, s2 long, coarse binary, sketch binary, rim array<long>"


def _facts(n: int, percent: int, order):
    def run(batches):
        totals = order.value
        for ids, texts in _slices(batches, "doc_id", "text"):
            rows = []
            for doc_id, words in zip(ids, word_hashes(texts)):
                sh = np.unique(shingles(words, n))
                rim = len(sh) - -(-percent * len(sh) // 100) + 1 if len(sh) else 0
                # sh is sorted, so a stable sort orders by (count, hash).
                rare = np.argsort(totals[_buckets(sh)], kind="stable")[:rim]
                rows.append((doc_id, len(sh), *signature(sh), coarse(sh), sketch(sh), sh[rare].view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "s1", "s2", "coarse", "sketch", "rim"])

    return run


def _sets(n: int, wanted):
    """Sets of the documents that may be wanted, by id before a text is read and then by
    signature too."""
    def run(batches):
        bits = wanted.value
        asked = (pdf[_has(bits, _name(pdf["doc_id"].to_numpy()))] for pdf in batches)
        for ids, texts in _slices(asked, "doc_id", "text"):
            rows = []
            for doc_id, words in zip(ids, word_hashes(texts)):
                sh = np.unique(shingles(words, n))
                s1, s2 = signature(sh)
                if _has(bits, _name(np.array([doc_id]), np.array([s1])))[0]:
                    rows.append((doc_id, s1, s2, sh.tobytes()))
            yield pd.DataFrame(rows, columns=["rep", "s1", "s2", "shingles"])

    return run


def _name(ids: np.ndarray, s1: np.ndarray | None = None) -> np.ndarray:
    name = mix(ids.astype(np.int64).view(np.uint64))
    return name if s1 is None else name ^ s1.astype(np.int64).view(np.uint64)


def _bit_at(names: np.ndarray) -> np.ndarray:
    return (mix(names.astype(np.uint64)) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)


def _has(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = _bit_at(names)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _packed(rows: DataFrame, at: str, value: str, size: int, kind) -> np.ndarray:
    """Array of ``size`` numbers from rows (at, value), zero where there is none.  Runs of
    ``RUN`` numbers are packed by tasks, so the driver gets size / RUN rows of bytes: as rows
    of their own, half a million numbers take it some hundred MB of Python objects."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        run = int(pdf[at].iloc[0]) // RUN
        out = np.zeros(RUN, kind)
        out[pdf[at].to_numpy(np.int64) - run * RUN] = pdf[value].to_numpy(np.int64)
        return pd.DataFrame({"run": [run], "packed": [out.tobytes()]})

    out = np.zeros(-(-size // RUN) * RUN, kind)
    for r in rows.groupBy(F.floor(F.col(at) / RUN).alias("_run")).applyInPandas(pack, "run long, packed binary").collect():
        out[r.run * RUN:(r.run + 1) * RUN] = np.frombuffer(r.packed, kind)
    return out[:size]


def _words_of(names):
    def run(batches):
        for pdf in batches:
            at = np.unique(_bit_at(names(pdf)))
            yield pd.DataFrame({"word": at >> 5, "bits": np.int64(1) << (at & 31)})

    return run


def _filter(rows: DataFrame, names):
    """A broadcast filter of ``names(rows)``: at most 2 ** (WANTED_BITS - 5) words pass the
    driver, whatever the input."""
    words = (rows.mapInPandas(_words_of(names), "word long, bits long")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")))
    bits = _packed(words, "word", "bits", 1 << (WANTED_BITS - 5), np.uint32)
    return rows.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _shared_rims(shared):
    """Rows with the shingles of their rims that may stand in several classes' rims."""
    def run(batches):
        bits = shared.value
        for pdf in batches:
            rims = [np.asarray(r, np.int64) for r in pdf["rim"]]
            flat = np.concatenate([np.empty(0, np.int64), *rims])
            hit = np.split(_has(bits, flat.view(np.uint64)), np.cumsum([len(r) for r in rims])[:-1]) if rims else []
            pdf = pdf.assign(rim=[r[h] for r, h in zip(rims, hit)])
            yield pdf[[len(r) > 0 for r in pdf["rim"]]]

    return run


def may_link(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """Sets, sorted by size, in groups that possible links connect: per set the first
    member of its group.

    Sets within r differ in at most (1 - t)(|x| + |y|) / (1 + t) shingles, hence in size
    and, summed over any parts of the universe, in counts by no more than that."""
    group = np.arange(len(sizes))
    first = np.searchsorted(sizes, -(-sizes * percent // 100))  # smaller partners begin here
    folded: dict[int, tuple[int, np.ndarray]] = {}
    for k in range(1, len(sizes)):
        a = int(first[k])
        if a >= k:
            continue
        parts = len(sketches[a])
        if parts not in folded:
            folded[parts] = a, np.array([s.reshape(-1, parts).sum(axis=0) for s in sketches[a:]], np.int64)
        start, counts = folded[parts]
        apart = np.abs(counts[a - start:k - start] - counts[k - start]).sum(axis=1)
        hit = apart * (100 + percent) <= (100 - percent) * (sizes[a:k] + sizes[k])
        met = np.unique(group[a:k][hit])
        if len(met):
            group[np.isin(group, met) | (group == k)] = met[0]
    return group


_KEYS = ["pivot", "i", "j"]


def _groups(batches, columns):
    """Groups of rows that arrive sorted by ``_KEYS``, as dicts of arrays."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        keys = pdf[_KEYS].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        arrays = {c: pdf[c].to_numpy() for c in columns}
        for a, b in zip([0, *cuts], cuts):
            yield keys[a], {c: v[a:b] for c, v in arrays.items()}
        rest = pdf[cuts[-1] if len(cuts) else 0:]
    if rest is not None and len(rest):
        yield rest[_KEYS].to_numpy()[0], {c: rest[c].to_numpy() for c in columns}


def _possible(percent: int, counts: str, kind):
    """Groups of possible links, each a region of its own under its smallest class: the same
    group met in several regions becomes one."""
    def run(batches):
        out: list[tuple] = []
        for _, group in _groups(batches, ["cid", "n", counts]):
            reps = group["cid"]
            if len(reps) > 1:
                own = may_link(group["n"], [np.frombuffer(b, kind) for b in group[counts]], percent)
                for g, size in zip(*np.unique(own, return_counts=True)):
                    if size > 1:
                        members = reps[own == g]
                        out += [(members.min(), r) for r in members]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["pivot", "cid"])
                out = []
        yield pd.DataFrame(out, columns=["pivot", "cid"])

    return run


class Forest:
    """Disjoint sets of the members of a region, and how many Voronoi cells it took."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.cells = 0

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """|x n y| for all x of ``sets`` and y of ``others``, in slices of the vocabulary."""
    flat, flat2 = np.concatenate(sets), np.concatenate(others)
    common = np.intersect1d(flat, flat2)
    out = np.zeros((len(sets), len(others)), np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row2 = np.repeat(np.arange(len(others)), [len(s) for s in others])

    def place(values, rows):
        at = np.searchsorted(common, values)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == values[ok]
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    if not len(common):
        return out
    (col, row), (col2, row2) = place(flat, row), place(flat2, row2)
    width = max(64, 8_000_000 // (len(sets) + len(others)))
    for k in range(0, len(common), width):
        m, m2 = np.zeros((len(sets), width), np.float32), np.zeros((len(others), width), np.float32)
        a, b = np.searchsorted(col, [k, k + width])
        m[row[a:b], col[a:b] - k] = 1
        a, b = np.searchsorted(col2, [k, k + width])
        m2[row2[a:b], col2[a:b] - k] = 1
        out += np.rint(m @ m2.T).astype(np.int64)
    return out


def join_region(sets: list[np.ndarray], percent: int, leaf: int = LEAF, pivots: int = PIVOTS) -> Forest:
    """Exact links (100 |x n y| >= percent |x u y|) of the sets, as a forest."""
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets])

    def linked(rows, cols, inter):
        union = sizes[rows][:, None] + sizes[cols][None, :] - inter
        return 100 * inter >= percent * union, union

    def whole(members):
        for k in range(0, len(members), leaf):
            rows = members[k:k + leaf]
            cols = members[k:]
            hit, _ = linked(rows, cols, _overlaps([sets[i] for i in rows], [sets[i] for i in cols]))
            for i, j in zip(*np.nonzero(hit)):
                forest.join(int(rows[i]), int(cols[j]))

    def split(members):
        if len(members) <= leaf:
            return whole(members)
        own = members[np.linspace(0, len(members) - 1, min(pivots, len(members) // 2)).astype(int)]
        inter = _overlaps([sets[i] for i in members], [sets[i] for i in own])
        hit, union = linked(members, own, inter)
        for i, j in zip(*np.nonzero(hit)):
            forest.join(int(members[i]), int(own[j]))
        if len({forest.find(int(i)) for i in members}) == 1:
            return None  # all linked already
        distance = 1 - inter / union
        # A hair wider than 2r, so that rounding cannot lose a pair.
        window = distance <= distance.min(axis=1)[:, None] + 2 * (1 - percent / 100) + 1e-9
        cells = [members[window[:, q]] for q in range(len(own))]
        if max(map(len, cells)) > 0.8 * len(members) or sum(map(len, cells)) > 3 * len(members):
            return whole(members)
        forest.cells += len(cells)
        for cell in cells:
            if len(cell) > 1:
                split(cell)
        return None

    if len(sets) > 1:
        split(np.arange(len(sets)))
    return forest


def _region_edges(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cid").sort_values("cid")
        reps = pdf["cid"].to_numpy()
        forest = join_region([np.frombuffer(b, np.uint64) for b in pdf["shingles"]], percent)
        root = np.array([forest.find(i) for i in range(len(reps))], dtype=np.int64)
        away = root != np.arange(len(reps))
        return pd.DataFrame({"a": reps[away], "b": reps[root[away]]})

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """Rows (pivot, i, j, cid): regions above ``BLOCK`` sets are dealt into blocks, and each
    set is in every pair of blocks that holds its own."""
    # Written out: a join right above its aggregate could not be split at a hot pivot.
    sizes = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).checkpoint()
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    return (members.join(sizes, "pivot").withColumn("mine", mine)
            .select("pivot", "cid", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("pivot", "cid", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))


def link_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: documents link when
    100 |x n y| >= percent |x u y|; a component's id is its smallest document id."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    texts = docs.select(id_in("doc_id").alias("doc_id"), "text")

    # At most 2 ** ORDER_BITS counters, whatever the input.
    counted = (texts.select("text").mapInPandas(_occurrences(n), "bucket int, total long")
               .groupBy("bucket").agg(F.sum("total").alias("total")))
    totals = _packed(counted, "bucket", "total", 1 << ORDER_BITS, np.int64)
    order = spark.sparkContext.broadcast(totals)

    facts = texts.mapInPandas(_facts(n, percent, order), _FACTS).checkpoint()
    rows = facts.select(id_out("doc_id").alias("doc_id"), "n", "s1", "s2")
    classes = (rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
               .withColumn("cid", F.monotonically_increasing_id()).checkpoint())
    # Copies have equal signatures: a shingle of one class's rim only has no partner.
    several = (facts.select(F.explode("rim").alias("shingle"), "s1").groupBy("shingle")
               .agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("shingle"))
    shared = _filter(several, lambda pdf: pdf["shingle"].to_numpy().view(np.uint64))
    reps = (facts.where("n > 0").mapInPandas(_shared_rims(shared), _FACTS).withColumnRenamed("doc_id", "rep")
            .join(classes, ["rep", "s1", "s2", "n"]).dropDuplicates(["cid"]).checkpoint())
    index = reps.select("cid", F.explode("rim").alias("shingle"))
    pivots = (index.groupBy("shingle").agg(F.min("cid").alias("pivot"), F.max("cid").alias("_last"))
              .where("pivot < _last").select("shingle", "pivot"))
    members = index.join(pivots, "shingle").select("pivot", "cid").distinct().checkpoint()

    def pruned(regions, counts, kind):
        placed = _dealt(regions).join(reps.select("cid", "n", counts), "cid")
        return (placed.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "n")
                .mapInPandas(_possible(percent, counts, kind), "pivot long, cid long").distinct().checkpoint())

    groups = pruned(pruned(members, "coarse", np.uint16), "sketch", np.uint32)
    named = groups.select("cid").distinct().join(classes, "cid").select("cid", "rep", "s1", "s2").checkpoint()
    wanted = _filter(named.select("rep", "s1"), lambda pdf: np.concatenate(
        [_name(pdf["rep"].to_numpy()), _name(pdf["rep"].to_numpy(), pdf["s1"].to_numpy())]))
    sets = texts.mapInPandas(_sets(n, wanted), "rep long, s1 long, s2 long, shingles binary")
    near = _dealt(groups).join(named, "cid")
    edges = (near.join(sets, ["rep", "s1", "s2"]).select(*_KEYS, "cid", "shingles").groupBy(*_KEYS)
             .applyInPandas(_region_edges(percent), "a long, b long"))
    roots = components(edges).join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id")).checkpoint()
    linked = roots.join(least, "root").select(F.col("node").alias("cid"), "component_id")

    found = classes.join(linked, "cid", "left").select("s1", "s2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    return (rows.join(found, ["s1", "s2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component (the smallest id), each once.
    Rows without an id stay, once for each text: nothing names the row to keep."""
    found = link_components(docs, n, percent)
    gone = found.where("doc_id is not null and component_id < doc_id").select("doc_id").distinct()
    # A repeated row stays once; rows without an id are told apart by their text.
    own = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text")
    return (docs.join(gone, "doc_id", "left_anti").withColumn("_row", F.row_number().over(own))
            .where("_row = 1").select(*docs.columns))
