"""Spelling variants: k-d trees over letter counts, searched by boxes and verified letter by letter."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_of
from vigil.llm.jaccard import pieces

#: A run whose hash this divides loses a letter.
DELETES = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Words of a block, the unit that one tree holds in one task, and the characters it may hold.
BLOCK = 20_000
BLOCK_CHARACTERS = 1 << 25
#: About so many words, chosen by their hashes, give the cuts between the blocks of large lengths.
FIT_WORDS = 100_000
LEAF = 16
DIMENSIONS = 32
HELD_WORDS = 200_000
AT_ONCE = 1 << 22
RUN = re.compile("[a-zÀ-ÿ]+")


# ---------------------------------------------------------------- words

def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters that all texts together hold ``least_count`` times."""
    def count(batches):
        held = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter()
                for piece in pieces(text.as_py()):
                    runs.update(RUN.findall(piece.encode().lower().decode()))
                start = zlib.crc32(f"{doc}:".encode())
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DELETES == 0 and doc is not None:
                        run = run[:h % len(run)] + run[h % len(run) + 1:]
                    if len(run) >= least_length:
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield rows()
        if held:
            yield rows()
    return (docs.select("doc_id", text_of().alias("text")).mapInArrow(count, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def letters(column: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer("".join(column).encode("latin-1"), np.uint8).reshape(-1, length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts, a-z each on its own and the others in six classes; at most 255, which keeps distances from growing."""
    dimension = np.arange(256)
    dimension = np.where((dimension >= 97) & (dimension <= 122), dimension - 97, 26 + dimension % (DIMENSIONS - 26))
    rows, step = [], max(1, AT_ONCE // codes.shape[1])
    for k in range(0, len(codes), step):
        part = dimension[codes[k:k + step]] + DIMENSIONS * np.arange(len(codes[k:k + step]))[:, None]
        rows.append(np.minimum(np.bincount(part.ravel(), minlength=DIMENSIONS * len(part)), 255).reshape(-1, DIMENSIONS).astype(np.uint8))
    return np.concatenate(rows)


# ---------------------------------------------------------------- trees

class Tree:
    """A k-d tree as arrays: every node has a box of counts and two children, or is a leaf with a range of rows.

    Nodes are cut at the middle row in the order of their most varied dimension.  ``tight`` boxes are those
    of the rows below; otherwise a box is what the cuts leave, so that a tree fitted on a sample holds any row.
    """

    def __init__(self, counts: np.ndarray, leaf: int = LEAF, tight: bool = True, levels: int = 64):
        self.order = np.arange(len(counts))
        self.low, self.high, self.child, self.rows, self.cut = [], [], [], [], []
        whole = (np.zeros(DIMENSIONS, np.uint8), np.full(DIMENSIONS, 255, np.uint8))
        todo = [(self._node(), 0, len(counts), *whole, 0)]
        while todo:
            node, first, last, low, high, level = todo.pop()
            held = counts[self.order[first:last]]
            if tight and len(held):
                low, high = held.min(0), held.max(0)
            self.low[node], self.high[node], self.rows[node] = low, high, (first, last)
            if last - first <= leaf or level == levels or (held == held[0]).all():
                continue
            by = int(held.var(0, dtype=np.float32).argmax())
            order = np.argsort(held[:, by], kind="stable")
            values = held[order, by]
            middle = len(held) // 2
            if not tight or values[0] < values[-1]:            # between unequal values, next to the middle
                steps = np.flatnonzero(values[1:] != values[:-1]) + 1
                middle = int(steps[np.abs(steps - middle).argmin()])
            self.order[first:last] = self.order[first:last][order]
            self.child[node], self.cut[node] = len(self.low), (by, int(values[middle - 1]))
            left, right = self._node(), self._node()
            below, above = high.copy(), low.copy()
            below[by], above[by] = values[middle - 1], values[middle - 1] + 1
            todo += [(left, first, first + middle, low, below, level + 1), (right, first + middle, last, above, high, level + 1)]
        self.low, self.high, self.child, self.rows = np.array(self.low), np.array(self.high), np.array(self.child), np.array(self.rows)
        self.leaves = np.flatnonzero(self.child < 0)

    def _node(self) -> int:
        for column in (self.low, self.high, self.rows):
            column.append(None)
        self.child.append(-1)
        self.cut.append((0, 0))
        return len(self.low) - 1

    def within(self, counts: np.ndarray, radius: int):
        """(query, leaf node) pairs whose box lies within ``radius`` of the query; boxes that do not are left with all below."""
        query, node, found = np.arange(len(counts)), np.zeros(len(counts), np.int64), []
        while len(query):
            near = distance(counts[query], self.low[node], self.high[node]) <= radius
            query, node = query[near], node[near]
            leaf = self.child[node] < 0
            found.append((query[leaf], node[leaf]))
            query, node = query[~leaf], node[~leaf]
            query, node = np.concatenate([query, query]), np.concatenate([self.child[node], self.child[node] + 1])
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The leaf node whose cuts hold each row."""
        cut, node = np.array(self.cut), np.zeros(len(counts), np.int64)
        while True:
            down = np.flatnonzero(self.child[node] >= 0)
            if not len(down):
                return node
            at = node[down]
            node[down] = self.child[at] + (counts[down, cut[at, 0]] > cut[at, 1])


def distance(counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """L1 distance of rows to boxes."""
    return (np.maximum(low, counts) - counts + (np.maximum(counts, high) - high)).sum(1, dtype=np.int64)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of codes differ by one replaced letter (equal lengths) or one left out (short to long)."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    n = short.shape[1]
    ahead, behind = short != long[:, :n], short != long[:, 1:]
    first = np.where(ahead.any(1), ahead.argmax(1), n)
    last = np.where(behind.any(1), n - 1 - behind[:, ::-1].argmax(1), -1)
    return last < first


class Block:
    """Words of one length under a tree, and their search."""

    def __init__(self, column: list[str], counts: list[int], length: int):
        self.words, self.n, self.codes = np.array(column, object), np.array(counts, np.int64), letters(column, length)
        self.vectors = letter_counts(self.codes)
        self.tree = Tree(self.vectors)

    def near(self, column: list[str], counts: list[int], own: bool = False):
        """Record batches (a, na, b, nb) of the words in ``column`` one edit from a word here.

        Words of equal length meet from both sides, so the smaller is taken as a.
        """
        length = len(column[0])
        codes = self.codes if own else letters(column, length)
        vectors = self.vectors if own else letter_counts(codes)
        same = length == self.codes.shape[1]
        names, n = np.array(column, object), np.array(counts, np.int64)
        for first in range(0, len(column), 512):
            query, leaf = self.tree.within(vectors[first:first + 512], 2 if same else 1)
            start, end = self.tree.rows[leaf].T
            sizes = end - start
            for part in np.array_split(np.arange(len(query)), max(1, int(sizes.sum()) * DIMENSIONS // AT_ONCE + 1)):
                total = int(sizes[part].sum())
                if not total:
                    continue
                at = np.repeat(start[part] - np.r_[0, np.cumsum(sizes[part])[:-1]], sizes[part]) + np.arange(total)
                q, m = np.repeat(query[part], sizes[part]) + first, self.tree.order[at]
                v, w = vectors[q], self.vectors[m]
                close = (np.maximum(v, w) - np.minimum(v, w)).sum(1, dtype=np.int64) <= (2 if same else 1)
                q, m = q[close], m[close]
                step = max(1, AT_ONCE // length)
                held = [one_edit(codes[q[k:k + step]], self.codes[m[k:k + step]]) for k in range(0, len(q), step)]
                if held:
                    held = np.concatenate(held)
                    q, m = q[held], m[held]
                    if same:
                        once = names[q] < self.words[m]
                        q, m = q[once], m[once]
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.string()), pa.array(n[q]), pa.array(self.words[m], pa.string()),
                                                          pa.array(self.n[m])], names=["a", "na", "b", "nb"])


# ---------------------------------------------------------------- the search on Spark

def _room(length) -> int:
    """Words a block of this length may hold."""
    return max(1, min(BLOCK, BLOCK_CHARACTERS // length))


def _cuts(table: DataFrame) -> dict[int, Tree]:
    """Trees that cut large lengths into blocks, fitted on about ``FIT_WORDS`` words of these lengths."""
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_CHARACTERS) / F.col("length"))))
    sizes = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > room).collect()}
    if not sizes:
        return {}
    large = table.where(F.col("length").isin(list(sizes)))
    share = int(min(1.0, FIT_WORDS / sum(sizes.values())) * (1 << 30))
    fit = large.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share).select("length", "word").collect()
    trees = {}
    for length, n in sizes.items():
        column = [r.word for r in fit if r.length == length]
        levels = int(np.ceil(np.log2(n / _room(length))))
        if len(column) > 1:
            trees[length] = Tree(letter_counts(letters(column, length)), leaf=1, tight=False, levels=levels)
    return trees


def _placed(table: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(length, leaf, role, word, n): role 0 at the word's own place, 1 where a word one letter longer may lie, 2 where
    one of its own length may lie besides its own place."""
    table = table.select("word", "n", "length")
    if not trees:
        place = [F.struct((F.col("length") + up).alias("length"), F.lit(0).alias("leaf"), F.lit(up).alias("role")) for up in (0, 1)]
        return table.select(F.explode(F.array(*place)).alias("p"), "word", "n").select("p.*", "word", "n")
    shared = table.sparkSession.sparkContext.broadcast(trees)       # as many nodes as blocks, from a bounded sample

    def place(batches):
        trees = shared.value
        for batch in batches:
            column, n, lengths = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                own = [column[i] for i in at]
                counts = letter_counts(letters(own, int(length)))
                home = trees[length].home(counts) if length in trees else np.zeros(len(at), np.int64)
                parts = [(np.arange(len(at)), home, length, 0)]
                if length in trees:
                    query, leaf = trees[length].within(counts, 2)
                    parts.append((query[leaf != home[query]], leaf[leaf != home[query]], length, 2))
                parts.append((*trees[length + 1].within(counts, 1), length + 1, 1) if length + 1 in trees
                             else (np.arange(len(at)), np.zeros(len(at), np.int64), length + 1, 1))
                for rows, leaf, to, role in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), to), pa.int32()), pa.array(leaf, pa.int32()), pa.array(np.full(len(rows), role), pa.int32()),
                         pa.array([own[i] for i in rows], pa.string()), pa.array(n[at[rows]])], names=["length", "leaf", "role", "word", "n"])
    return table.mapInArrow(place, "length int, leaf int, role int, word string, n bigint")


def _search(batches):
    """Pairs from rows (length, leaf, slice, role, word, n), blocks one after another with their own words first."""
    place, members, block = None, ([], []), None

    def opened():
        return Block(*members, len(members[0][0]))
    for batch in batches:
        keys = np.stack([c.to_numpy() for c in batch.columns[:4]], 1)
        column, n = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for first, last in zip([0, *edges], [*edges, len(keys)]):
            if first == last:
                continue
            here, role = tuple(keys[first, :3]), keys[first, 3]
            if here != place:
                if members[0] and block is None:
                    yield from opened().near(*members, own=True)
                place, members, block = here, ([], []), None
            if role == 0:
                members[0].extend(column[first:last])
                members[1].extend(n[first:last])
            elif members[0]:
                if block is None:
                    block = opened()
                    yield from block.near(*members, own=True)
                yield from block.near(column[first:last], n[first:last])
    if members[0] and block is None:
        yield from opened().near(*members, own=True)


def near_pairs(table: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of words of ``table`` (word, n) that differ by one letter, once."""
    table = table.withColumn("length", F.length("word"))
    placed = stored(_placed(table, _cuts(table)))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_CHARACTERS) / F.col("length"))))
    slices = (placed.where("role = 0").groupBy("length", "leaf").agg(F.count(F.lit(1)).alias("held"))
              .where(F.col("held") > 2 * room).select("length", "leaf", F.ceil(F.col("held") / room).alias("slices")))
    own = F.when(F.col("role") == 0, F.pmod(F.xxhash64("word"), F.col("slices")))
    dealt = (placed.join(stored(slices), ["length", "leaf"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
             .withColumn("own", own).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
             .withColumn("role", F.when((F.col("role") == 0) & (F.col("slice") != F.col("own")), 2).otherwise(F.col("role")))
             .select("length", "leaf", F.col("slice").cast("int").alias("slice"), "role", "word", "n"))
    block = ["length", "leaf", "slice"]
    return (dealt.repartition(*block).sortWithinPartitions(*block, "role")
            .mapInArrow(_search, "a string, na bigint, b string, nb bigint"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that following forms leads to; steps double in every round."""
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        now = stored(now.join(further, F.col("root") == F.col("_at"), "left")
                     .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run of whose crc32 with its doc_id
    97 is a divisor loses one letter.  Words of at least ``least_length`` letters with ``least_count`` occurrences
    count.  Near words differ by one inserted, deleted or replaced letter.  ``form`` is the near word of largest n
    (ties: first in code-point order) if that n is twice the word's or more, ``root`` where following forms ends.

    One edit changes letter counts by an L1 distance of two at most (one between lengths), so words are searched
    in k-d trees over letter counts per pair of lengths and verified by their letters.  Lengths with many
    words are cut into blocks by a tree fitted on a sample; blocks that hold more words than planned, such as
    anagrams of each other, are cut into slices that each word visits, so nothing is left out.

    Null texts have no words; runs of a row without doc_id are taken as they are; texts and words may have any
    length; repeated rows count again; extra columns are ignored; an empty table gives no rows.
    """
    table = stored(words(docs, least_length, least_count))
    pairs = stored(near_pairs(table))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("form"), F.col("nb").alias("form_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("form"), F.col("na").alias("form_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    named = table.join(best, "word", "left")
    kept = -F.col("best.n") >= 2 * F.col("n")
    named = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(kept, F.col("best.form")).alias("form"), F.when(kept, -F.col("best.n")).alias("form_n")))
    ends = roots(named.where(F.col("form").isNotNull()))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
