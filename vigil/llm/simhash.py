"""SimHash near duplicates through a Gray-ordered index of shared bit patterns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_of

SHINGLE = 3
BITS = 3
GROUP_ROWS = 20_000
FANOUT = 8
FRONTIER = 1 << 21


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 (seed 42) of all word shingles of a text, A-Z lower-cased."""
    import xxhash
    words = text.encode().lower().split()
    line, reach = b" ".join(words), min(shingle, len(words)) - 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist() if words else []
    spans = list(zip(starts, ends[max(reach, 0):].tolist()))
    return np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in spans), np.uint64, len(spans))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of a text, A-Z lower-cased."""
    values, ones = shingle_hashes(text, shingle), np.zeros(64, np.int64)
    for i in range(0, len(values), 65536):
        ones += np.unpackbits(values[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits): the fingerprint of every document as a signed long."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {id_type}, bits bigint")


# ---------------------------------------------------------------- the index

def gray_rank(bits: Column) -> Column:
    """Place of a 64-bit word in the reflected Gray order, as a signed long that sorts alike."""
    rank = bits
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class Index:
    """Fingerprints of several groups, Gray-sorted inside each, under nodes of shared bit patterns.

    A node holds the bits on which all fingerprints below agree; a child counts only the bits that its
    parent has not counted.  A search adds up differences on the way down and leaves a whole group as
    soon as they exceed the limit.
    """

    def __init__(self, group: np.ndarray, bits: np.ndarray):
        self.levels = []                      # from the leaves up: pattern, mask, first child, first leaf
        n = len(bits)
        low, high, own, leaf = bits, bits, group, np.arange(n)
        self.levels.append((bits, np.full(n, ~np.uint64(0)), np.arange(n + 1), leaf))
        while len(own) > len(np.unique(own)) or len(self.levels) == 1:
            first_of = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(first_of, np.diff(np.r_[first_of, len(own)]))
            starts = np.flatnonzero(place % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            mask = ~(low ^ high)
            leaf = leaf[starts]
            self.levels.append((low & mask, mask, np.r_[starts, len(own)], leaf))
            own = own[starts]
        self.root = np.searchsorted(own, group)     # the root of every leaf's group
        self.bits = bits

    def links(self, limit: int, first: int, last: int):
        """Pairs (query, earlier leaf of its group) within ``limit`` bits, for queries first..last-1."""
        todo = [np.arange(first, last)]
        while todo:
            queries = todo.pop()
            query, node = queries, self.root[queries]
            pattern, mask, _, _ = self.levels[-1]
            far = np.bitwise_count((self.bits[query] ^ pattern[node]) & mask[node]).astype(np.int64)
            kept = far <= limit
            query, node, far = query[kept], node[kept], far[kept]
            split = False
            for depth in range(len(self.levels) - 1, 0, -1):
                children, above = self.levels[depth][2], self.levels[depth][1]
                counts = children[node + 1] - children[node]
                total = int(counts.sum())
                if total > FRONTIER and len(queries) > 1:
                    todo += [queries[:len(queries) // 2], queries[len(queries) // 2:]]
                    split = True
                    break
                pattern, mask, _, leaf = self.levels[depth - 1]
                child = np.repeat(children[node] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
                fresh = mask[child] & ~np.repeat(above[node], counts)
                query, far = np.repeat(query, counts), np.repeat(far, counts)
                far = far + np.bitwise_count((self.bits[query] ^ pattern[child]) & fresh)
                kept = (far <= limit) & (leaf[child] < query)
                query, node, far = query[kept], child[kept], far[kept]
            if not split:
                yield query, node


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i] in a forest whose roots are the smallest members."""
    while len(a):
        for ends in (a, b):
            while True:
                up = parent[ends]
                if (up == ends).all():
                    break
                ends[:] = up
        apart = a != b
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        a, b = low, high


def _forest(group: np.ndarray, bits: np.ndarray, limit: int) -> np.ndarray:
    index, parent = Index(group, bits), np.arange(len(bits))
    for first in range(0, len(bits), 8192):
        for a, b in index.links(limit, first, min(first + 8192, len(bits))):
            _join(parent, a.copy(), b.copy())
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _linked(limit: int):
    """Arrow function over rows (group columns..., bits), whole groups one after another."""
    def trees(keys, bits):
        group = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(1)])
        alone = np.bincount(group)[group] == 1
        group, bits = group[~alone], bits[~alone]
        if not len(bits):
            return None
        parent = _forest(group, bits.view(np.uint64), limit)
        moved = parent != np.arange(len(parent))
        return pa.RecordBatch.from_arrays([pa.array(bits[moved]), pa.array(bits[parent[moved]])], names=["a", "b"])

    def run(batches):
        keys, bits = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = np.concatenate([keys, np.stack(columns[:4], 1).astype(np.int64)])
            bits = np.concatenate([bits, columns[4]])
            if len(bits) >= 100_000:
                ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
                if len(ends):
                    cut = ends[-1] + 1                    # the last group may go on
                    out = trees(keys[:cut], bits[:cut])
                    if out is not None:
                        yield out
                    keys, bits = keys[cut:], bits[cut:]
        if len(bits):
            out = trees(keys, bits)
            if out is not None:
                yield out
    return run


def links(distinct: DataFrame, limit: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join all pairs within ``limit`` bits.

    Two fingerprints that differ in at most ``limit`` bits agree on one of ``limit`` + 1 blocks of
    bits.  Rows meet by block value, Gray-sorted, and each such group is searched through ``Index``;
    a tree per connected part is handed on instead of its pairs.  A group above ``group_rows`` is cut
    into slices, and every two slices meet in one task, so no link is lost and no task holds more than
    two slices.
    """
    blocks = limit + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    values = F.array(*[F.shiftrightunsigned(F.col("bits"), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
                       for low, high in zip(edges, edges[1:])])
    rows = distinct.select("bits", F.posexplode(values).alias("block", "value"))
    large = stored(rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
                   .select("block", "value", F.ceil(F.col("n") / group_rows).alias("slices")))
    own = F.pmod(F.xxhash64("bits"), F.col("slices"))
    met = (rows.join(large, ["block", "value"], "left")
           .withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
           .select("block", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "bits"))
    group = ["block", "value", "low", "high"]
    return (met.repartition(*group).sortWithinPartitions(*group, gray_rank(F.col("bits")))
            .mapInArrow(_linked(limit), "a bigint, b bigint"))


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) reaches; large and small stars in turn."""
    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(e, large):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        met = both.join(least, F.col("a") == F.col("k"))
        if large:
            out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    now = stored(edges.where(F.col("a") != F.col("b")).distinct())
    seen = mark(now)
    while seen[0]:
        now = stored(star(star(now, True), False))
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = BITS,
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, bits, component_id) for every document.

    component_id is the smallest doc_id among all documents that can be reached over fingerprints
    differing in at most ``limit`` bits, the document's own included.  Equal fingerprints are one node, so
    groups of copies of any size cost one row.  Null and wordless texts have fingerprint zero and are
    linked like any other; repeated rows appear as often as in the input; a null doc_id takes part and is
    never the smallest unless all are null.  Extra columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle))
    nodes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    tree = components(stored(links(nodes.select("bits"), limit, group_rows)))
    rooted = nodes.join(tree, F.col("bits") == F.col("node"), "left").select(
        "bits", "first_id", F.coalesce("root", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.join(least, "root").select(F.col("bits").alias("node"), "component_id"))
    return prints.join(named, F.col("bits") == F.col("node")).select("doc_id", "bits", "component_id")


def hex_of(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near duplicates, each id once.

    Among repeated rows of one doc_id the one whose text hashes lowest stays.
    """
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its own component_id in ``found``, each id once.

    Texts are grouped only for ids that occur more than once; the others pass by a join with the ids.
    """
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    own = stored(own.select(F.col("doc_id").alias("_kept"), "n"))

    def rows(times):
        ids = own.where(times).select("_kept")
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi")
    again = (rows("n > 1").select("doc_id", F.struct("*").alias("_row"), F.xxhash64(text_of()).alias("_order"))
             .groupBy("doc_id").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*"))
    return rows("n = 1").unionByName(again)
