"""Jaccard join of word n-gram sets: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import SPACES, Scratch, let, stored, text_of
from vigil.llm.simhash import components, keep_first

SHINGLE = 3
#: Least similarity of a pair, as numerator and denominator.
LEAST = (9, 10)
#: Frequencies are counted by this many hash buckets, which only decides what stands first in a prefix.
BUCKETS = 1 << 18
#: Ranges of the suffix filter: twice as many while one would hold more members than this.
RANGES, MOST_RANGES, RANGE_MEMBERS = 64, 4096, 16
PIECE = 1 << 22
COUNTED_AT_ONCE = 1 << 20
CHUNK = 1 << 10


# ---------------------------------------------------------------- n-gram sets

def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of at least ``PIECE`` characters that end between words."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def word_hashes(text: str) -> np.ndarray:
    """XXH3 of every word, A-Z lower-cased."""
    import xxhash
    digest, parts = xxhash.xxh3_64_intdigest, []
    for piece in pieces(text):
        words = piece.encode().lower().split()
        parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the word n-grams of a text; of all words if there are fewer."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(shingle, len(words))
    n = len(words) - size + 1
    value = np.full(n, size, np.uint64)
    for k in range(size):
        value = _mix(value + words[k:k + n])
    return np.unique(value ^ (value >> np.uint64(32)))


def sets_of(docs: DataFrame, shingle: int, out: str, make: Callable, kinds: list[pa.DataType]) -> DataFrame:
    """``make(set)`` for every document: columns ``out`` behind those of ``docs`` other than the text."""
    names = [c for c in docs.columns if c != "text"]
    fresh = [x.split()[0] for x in out.split(", ")]
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], out])

    def run(batches):
        for batch in batches:
            rows = [make(shingle_set(t.as_py(), shingle)) for t in batch.column(len(names))]
            if rows:
                columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *columns], names=[*names, *fresh])
    return docs.select(*names, text_of().alias("text")).mapInArrow(run, schema)


def bucket_counts(docs: DataFrame, shingle: int, buckets: int = BUCKETS) -> np.ndarray:
    """Number of documents per hash bucket of n-grams, over all documents.

    Tasks count into arrays of fixed size, which are added up chunk by chunk; the driver sees only the
    sums, ``buckets`` numbers at any input size.
    """
    chunk = min(CHUNK, buckets)

    def count(batches):
        total, held, n = np.zeros(buckets, np.int64), [], 0

        def add():
            nonlocal held, n
            if held:
                total[:] += np.bincount((np.concatenate(held) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
            held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                values = shingle_set(text.as_py(), shingle)
                held.append(values)
                n += len(values)
                if n > COUNTED_AT_ONCE:
                    add()
        add()
        parts = total.reshape(-1, chunk)
        used = np.flatnonzero(parts.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([p.tobytes() for p in parts[used]], pa.binary())],
                                             names=["chunk", "counts"])

    def add_up(batches):
        sums = {}
        for batch in batches:
            for place, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(counts.as_py(), np.int64)
                sums[place] = sums[place] + more if place in sums else more
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                             names=["chunk", "counts"])
    columns = "chunk bigint, counts binary"
    rows = (docs.select(text_of().alias("text")).mapInArrow(count, columns)
            .repartition("chunk").mapInArrow(add_up, columns).toArrow())
    out = np.zeros((buckets // chunk, chunk), np.int64)
    for place, counts in zip(rows["chunk"].to_pylist(), rows["counts"]):
        out[place] = np.frombuffer(counts.as_py(), np.int64)
    return out.reshape(-1)


def prefix_length(n: int, least: tuple[int, int]) -> int:
    """Sets of similarity a/b or more share a/b of either, so in any common order one of these first members."""
    a, b = least
    return n + (-n * a) // b + 1 if n else 0


def ranges_of(values: np.ndarray) -> np.ndarray:
    """How many members of a set lie in each of ``RANGES`` ranges of hashes, or 2, 4, 8, ... times as many for a larger set."""
    ranges = RANGES
    while ranges < MOST_RANGES and len(values) > RANGE_MEMBERS * ranges:
        ranges *= 2
    return np.bincount((values >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64), minlength=ranges)


#: Columns that describe a set, behind its digest, and their Arrow types.
PRINT = "digest binary, n int, prefix array<bigint>, ranges array<int>"
PRINT_TYPES = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def described(values: np.ndarray, weight: np.ndarray, least: tuple[int, int]) -> tuple:
    """Digest, size, first members by weight, and range counts of a set."""
    import xxhash
    first = values[np.argsort(weight, kind="stable")[:prefix_length(len(values), least)]]
    return xxhash.xxh3_128_digest(values.tobytes()), len(values), first.view(np.int64), ranges_of(values)


def keyed_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(digest, keys): the whole set of every text."""
    import xxhash
    return sets_of(rows.select("text"), shingle, "digest binary, keys array<bigint>",
                   lambda s: (xxhash.xxh3_128_digest(s.tobytes()), s.view(np.int64)), [pa.binary(), pa.list_(pa.int64())])


def prefixes(docs: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(doc_id, digest, n, prefix, ranges): of every n-gram set its digest, size, rarest members and range counts."""
    table = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, shingle))      # ``BUCKETS`` numbers

    def make(values):
        return described(values, table.value[(values & np.uint64(len(table.value) - 1)).astype(np.int64)], least)
    return sets_of(docs.select("doc_id", "text"), shingle, PRINT, make, PRINT_TYPES)


# ---------------------------------------------------------------- the join

def reached(shared: Column, n: Column, m: Column, least: tuple[int, int]) -> Column:
    """Whether sets of n and m members with so many shared ones have the similarity."""
    a, b = least
    return (a + b) * shared.cast("long") >= a * (n + m).cast("long")


def _possible(n: Column, place: Column, m: Column, at: Column, least: tuple[int, int]) -> Column:
    """Length and positional filter for sets that meet at these places of the order.

    At the first member that two sets share, no more than what stands from there on can be shared.
    """
    return reached(F.least(n - place, m - at), n, m, least)


def _positional(least: tuple[int, int], thinned: bool = False) -> Column:
    """Positional filter over all prefix members that a pair (prefix_a, prefix_b, n_a, n_b) shares.

    Behind the first of them no more can be shared than what stands there, and behind the last no more than the
    members counted so far and what still follows in both.  Prefixes that are ``thinned`` out, in order, hold the place
    of each member in place_a and place_b.
    """
    both = F.array_intersect("prefix_a", "prefix_b")

    def place(name, member):
        at = F.array_position(f"prefix_{name}", member)
        return F.element_at(f"place_{name}", at.cast("int")) + 1 if thinned else at

    def bounds(both):
        first, last = both[0], F.element_at(both, -1)
        ahead = F.least(*[F.col(f"n_{x}") - place(x, first) + 1 for x in "ab"])
        behind = F.size(both) + F.least(*[F.col(f"n_{x}") - place(x, last) for x in "ab"])
        return reached(F.least(ahead, behind), F.col("n_a"), F.col("n_b"), least)
    return let(both, lambda both: (F.size(both) > 0) & bounds(both))


def _most_shared() -> Column:
    """The lesser counts of all ranges of a pair (r_a, r_b) added up, the finer ranges folded into the others."""
    def folded(x, y):
        times = F.greatest(F.size(x) / F.size(y), F.lit(1)).cast("int")
        return F.when(F.size(x) <= F.size(y), F.col(x)).otherwise(F.transform(
            F.sequence(F.lit(1), F.size(x), times), lambda k: F.aggregate(F.slice(x, k, times), F.lit(0), lambda s, v: s + v)))
    return F.aggregate(F.zip_with(folded("r_a", "r_b"), folded("r_b", "r_a"), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def _similar(pairs: DataFrame, sides: DataFrame, whole: Callable[[DataFrame], DataFrame], least: tuple[int, int], stored) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose whole sets have the similarity.

    ``sides`` holds (node, n, prefix, place, ranges) of all their nodes.  Positional filter over all shared prefix
    members first, then the suffix filter: sets cannot share more than the lesser counts of all ranges added up.  Sets
    are made for the pairs that pass, once per node, and shuffled once by digest for both sides of the last join.  Each
    pair is verified once.
    """
    def side(name):
        return sides.select(F.col("node").alias(name), *[F.col(c).alias(f"{to}_{name}") for c, to in
                                                         (("n", "n"), ("prefix", "prefix"), ("place", "place"), ("ranges", "r"))])
    met = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(_positional(least, thinned=True))
    left = stored(met.where(reached(_most_shared(), F.col("n_a"), F.col("n_b"), least)).select("a", "b", "n_a", "n_b"))
    names, sets = whole(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    met = left
    for x in "ab":
        met = met.join(names.select(F.col("node").alias(x), F.col("digest").alias(f"digest_{x}")), x)
    with Scratch(pairs.sparkSession) as own:
        sets = own.stored(sets)         # so that a join meets nothing but shuffles, which Spark splits where one set has many pairs
        for x, keys in (("a", "x"), ("b", "y")):
            met = met.join(sets.select(F.col("digest").alias(f"digest_{x}"), F.col("keys").alias(keys)).hint("merge"), f"digest_{x}")
        return stored(met.where(reached(F.size(F.array_intersect("x", "y")), F.col("n_a"), F.col("n_b"), least)).select("a", "b"))


def connected(rows: DataFrame, whole: Callable[[DataFrame], DataFrame], least: tuple[int, int], stored) -> DataFrame:
    """(node, root) of all nodes with a partner: who is linked with whom over pairs that reach ``least``.

    ``rows`` holds (node, n, prefix, ranges), one row per distinct set; ``whole`` gives for a table of
    nodes a stored table (node, digest) and their sets (digest, keys).  Prefix members that one set alone has go first, found by one number a member; what follows needs no others.  Every node is then
    compared with two nodes at each member it shares: the one in whose order the member stands first, which has
    least that is rarer and so is most like the others, and the largest.  That joins most of a group of similar
    sets without its pairs; in the end all pairs of nodes that are still apart and meet are compared, so
    that no link is lost.  Tables that grow with the documents are joined by shuffle at every size, and what
    leaves does not read what ``stored`` has written.
    """
    keys = rows.select("node", F.posexplode("prefix").alias("place", "key"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    shared = stored(keys.join(met.select("key").hint("merge"), "key", "left_semi")
                    .join(rows.select("node", "n").hint("merge"), "node").select("key", "node", "n", "place"))
    members = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("m"))
    sides = stored(members.select("node", F.col("m.key").alias("prefix"), F.col("m.place").alias("place"))
                   .join(rows.select("node", "n", "ranges").hint("merge"), "node"))

    end = F.col("end")
    ends = shared.groupBy("key").agg(F.min(F.struct("place", "n", "node")).alias("first"), F.max(F.struct("node", "n", "place")).alias("last"))
    ends = ends.select("key", *[F.struct(*[f"{e}.{c}" for c in ("node", "n", "place")]).alias(e) for e in ("first", "last")])
    close = stored(shared.join(ends, "key").select("node", "n", "place", F.explode(F.array("first", "last")).alias("end"))
             .where((F.col("node") != end["node"]) & reached(F.least("n", end["n"]), F.col("n"), end["n"], least))
             .select(F.least("node", end["node"]).alias("a"), F.greatest("node", end["node"]).alias("b")).distinct())
    linked = _similar(close, sides, whole, least, stored)

    placed = shared.join(components(linked), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where(F.col("low") < F.col("high"))
    apart = stored(placed.join(mixed.select("key"), "key", "left_semi"))
    other = apart.select("key", F.col("part").alias("other"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"))
    rest = (apart.join(other, "key").where((F.col("part") < F.col("other")) & _possible(
        F.col("n"), F.col("place"), F.col("m"), F.col("at"), least)).select(F.col("node").alias("a"), "b").distinct())
    done = close.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    rest = rest.join(done, ["a", "b"], "left_anti")
    return components(linked.unionByName(_similar(rest, sides, whole, least, stored)))


def classes(docs: DataFrame, heads: DataFrame, prints: DataFrame, make: Callable[[DataFrame], DataFrame], least: tuple[int, int]) -> DataFrame:
    """(doc_id, n, component_id) from stored ``heads`` (row, doc_id, digest, n) and ``prints`` (row, n, prefix, ranges).

    ``make`` gives (digest, keys) for rows of documents; it runs only over those in pairs that pass all filters.  What
    leaves does not read ``prints`` any more.
    """
    nodes = stored(heads.groupBy("digest").agg(F.min(F.struct("row", "doc_id")).alias("r"), F.min("doc_id").alias("first_id"))
                   .select("digest", "first_id", F.col("r.row").alias("node"), F.col("r.doc_id").alias("shown_by")))

    with Scratch(docs.sparkSession) as scratch:
        def whole(asked):
            wanted = scratch.stored(nodes.join(asked, "node", "left_semi").select("node", "digest", F.col("shown_by").alias("_shown")))
            rows = docs.select("doc_id", "text").join(wanted.select("_shown").distinct(), F.col("doc_id").eqNullSafe(F.col("_shown")), "left_semi")
            sets = make(rows.select("text")).groupBy("digest").agg(F.first("keys").alias("keys"))      # rows repeated under one doc_id
            return wanted.select("node", "digest"), sets
        rows = prints.join(nodes.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi").withColumnRenamed("row", "node")
        tree = connected(rows, whole, least, scratch.stored)
    rooted = nodes.join(tree, "node", "left").select("digest", "first_id", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("digest", "component_id")
    return heads.select("doc_id", "digest", "n").join(named.hint("merge"), "digest").select("doc_id", "n", "component_id")


def join(docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs of anything but white space, A-Z lower-cased; a document's set are its distinct n-grams of
    ``shingle`` words, or all its words as one n-gram if it has fewer.  Documents link when their sets have
    the Jaccard similarity ``least`` (numerator, denominator) or more; component_id is the smallest doc_id that
    can be reached over links, the document's own included.  N-grams are represented by 64-bit hashes.

    Null, empty and wordless texts have the empty set, link with nothing and are their own component.  Texts of
    any length are hashed in pieces.  Equal sets are one node, so groups of copies cost one row;
    repeated rows appear as often as in the input.  A null doc_id takes part and is never the smallest
    unless all are null.  Extra columns are ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.stored(prefixes(docs, shingle, least).withColumn("row", F.monotonically_increasing_id()))
        heads = stored(prints.select("row", "doc_id", "digest", "n"))
        found = classes(docs, heads.where("n > 0"), prints.where("n > 0"), lambda rows: keyed_sets(rows, shingle), least)
    alone = heads.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, each id once; wordless ones stay."""
    return keep_first(docs, join(docs, **options))
