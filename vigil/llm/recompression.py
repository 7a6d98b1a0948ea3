"""Removal of long repeated passages through recompression of the texts into shared symbols."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_of

WINDOW = 50
ROUNDS = 7
LEVELS = (7, 4, 2, 0)            # rounds whose symbols reveal repeats, the highest first
CHUNK_WORDS = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Maximal runs of bytes other than blanks 0x09-0x0D and 0x20."""
    return text.encode().split()


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Parse:
    """The symbols of some documents after each round, with the words that decide them.

    Round one names runs of one word; every round then splits the symbols by a bit of their hash and names
    each pair of a 0-symbol and the 1-symbol behind it.  A name is a hash of what it stands for, so it is the
    same wherever that stands, and two equal passages have the same symbols except near their ends.
    For each symbol ``low`` and ``high`` enclose all words that the choice depended on; a passage that
    holds them all has this symbol wherever it occurs.  An end of a document counts as a word outside.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS):
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(words))
        name, first, last, low, high = _mixed(words), place, place + 1, place, place + 1
        self.levels = [(name, low, high)]
        # runs of one word
        start = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])] if len(name) else np.zeros(0, bool)
        heads = np.flatnonzero(start)
        size = np.diff(np.r_[heads, len(name)]).astype(np.uint64)
        name = np.where(size > 1, _mixed(name[heads] * _MIX + size), name[heads])
        doc, first, last = doc[heads], first[heads], np.r_[first[heads][1:], len(words)].astype(np.int64)
        low, high = first - 1, last + 1
        for turn in range(1, rounds + 1):
            if not len(name):
                self.levels.append((name, low, high))
                continue
            bit = (_mixed(name + np.uint64(turn * int(_MIX2) % (1 << 64))) >> np.uint64(63)).astype(bool)
            inner = doc[1:] == doc[:-1]
            pair = np.r_[~bit[:-1] & bit[1:] & inner, False]
            second = np.r_[False, pair[:-1]]
            # left alone: a 0-symbol for what stands behind it, a 1-symbol for what stands in front
            behind_low, behind_high = np.r_[low[1:], 0], np.r_[high[1:], 0]
            front_low, front_high = np.r_[0, low[:-1]], np.r_[0, high[:-1]]
            has_next, has_front = np.r_[inner, False], np.r_[False, inner]
            alone0, alone1 = ~pair & ~bit, ~second & bit
            new_low, new_high = low.copy(), high.copy()
            new_high = np.where(alone0, np.where(has_next, np.maximum(high, behind_high), last + 1), new_high)
            new_low = np.where(alone1, np.where(has_front, np.minimum(low, front_low), first - 1), new_low)
            new_low = np.where(alone0 & has_next, np.minimum(new_low, behind_low), new_low)
            new_high = np.where(alone1 & has_front, np.maximum(new_high, front_high), new_high)
            new_low = np.where(pair, np.minimum(low, behind_low), new_low)
            new_high = np.where(pair, np.maximum(high, behind_high), new_high)
            named = np.where(pair, _mixed(name * _MIX + np.r_[name[1:], np.uint64(0)] * _MIX2 + np.uint64(turn)), name)
            new_last = np.where(pair, np.r_[last[1:], 0], last)
            kept = ~second
            name, doc, first, last = named[kept], doc[kept], first[kept], new_last[kept]
            low, high = new_low[kept], new_high[kept]
            self.levels.append((name, low, high))

    def reveal(self, lengths: np.ndarray, window: int = WINDOW, levels=LEVELS):
        """Per level: names, first window, behind last window, and the windows that this level speaks for.

        Windows are numbered by their first word over all documents.  Lower rounds speak for windows that
        hold no whole symbol of a higher one; which windows these are depends on their words alone.
        """
        n = int(lengths.sum())
        ends = np.cumsum(lengths)
        starts = ends - lengths
        open_ = np.zeros(n + 1, np.int64)
        long = lengths >= window
        np.add.at(open_, starts[long], 1)
        np.add.at(open_, ends[long] - window + 1, -1)
        left = np.cumsum(open_)[:n] > 0                 # places where a window starts
        doc_of = np.repeat(np.arange(len(lengths)), lengths)
        out = []
        for level in levels:
            if not left.any():
                break
            name, low, high = self.levels[min(level, len(self.levels) - 1)]
            fits = (high - low <= window) & (low >= 0) & (high <= n)
            name, low, high = name[fits], low[fits], high[fits]
            own = doc_of[low] if len(low) else low
            same = (low >= starts[own]) & (high <= ends[own]) if len(low) else np.zeros(0, bool)
            name, low, high, own = name[same], low[same], high[same], own[same]
            begin, end = np.maximum(high - window, starts[own]), np.minimum(low, ends[own] - window) + 1
            some = end > begin
            name, begin, end = name[some], begin[some], end[some]
            sums = np.r_[0, np.cumsum(left)]
            need = sums[end] > sums[begin]
            name, begin, end = name[need], begin[need], end[need]
            out.append((name, begin, end, left.copy()))
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, end, -1)
            left &= np.cumsum(cover)[:n] == 0
        return out


# ---------------------------------------------------------------- the jobs

def _chunks(batch):
    """(doc ids, word lists, other columns) of a batch, some hundred thousand words at a time."""
    ids, words, more, size = [], [], [], 0
    for row in zip(*(column.to_pylist() for column in batch.columns)):
        ids.append(row[0])
        words.append(words_of(row[1]))
        more.append(row[2:])
        size += len(words[-1])
        if size >= CHUNK_WORDS:
            yield ids, words, more
            ids, words, more, size = [], [], [], 0
    if ids:
        yield ids, words, more


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _parsed(words: list[list[bytes]], window: int):
    lengths = np.array([len(w) for w in words], np.int64)
    parse = Parse(hashes([w for doc in words for w in doc]), lengths)
    return lengths, parse.reveal(lengths, window)


def _owners(lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.cumsum(lengths), places, side="right")


def _marks(window: int):
    """Arrow function over (doc_id, text): words, digest and distinct revealing symbols of each document."""
    def run(batches):
        for batch in batches:
            for ids, words, _ in _chunks(batch):
                lengths, levels = _parsed(words, window)
                names = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in levels)])
                doc = _owners(lengths, np.concatenate([np.zeros(0, np.int64), *(x[1] for x in levels)]))
                order = np.lexsort((names, doc))
                names, doc = names[order], doc[order]
                new = np.r_[True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])] if len(names) else np.zeros(0, bool)
                names, doc = names[new].view(np.int64), doc[new]
                cuts = np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)
                digests = [_digest(w) for w in words]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, batch.schema.field(0).type), pa.array(lengths), pa.array(digests, pa.binary()),
                    pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(names))], names=["doc_id", "n_words", "digest", "key", "names"])
    return run


def _candidates(window: int):
    """Arrow function over (doc_id, text, key, shared): documents with windows all of whose symbols are shared."""
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for ids, words, more in _chunks(batch):
                right = [int.from_bytes(_digest(w)[:8], "little", signed=True) == m[0] for w, m in zip(words, more)]
                lengths, levels = _parsed(words, window)
                good = levels[0][3].copy() if levels else np.zeros(int(lengths.sum()), bool)
                for names, begin, end, spoken in levels:
                    doc = _owners(lengths, begin)            # symbols lie in order
                    cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
                    own = np.ones(len(names), bool)
                    for i, known in enumerate(m[1] for m in more):
                        own[cuts[i]:cuts[i + 1]] = ~np.isin(names[cuts[i]:cuts[i + 1]].view(np.int64), np.array(known, np.int64))
                    alone = np.zeros(len(good) + 1, np.int64)
                    np.add.at(alone, begin[own], 1)
                    np.add.at(alone, end[own], -1)
                    good &= ~(spoken & (np.cumsum(alone)[:-1] > 0))
                some = np.r_[False, good, False].astype(np.int8)
                starts, stops = np.flatnonzero(np.diff(some) == 1), np.flatnonzero(np.diff(some) == -1)
                first = np.cumsum(lengths) - lengths
                own = _owners(lengths, starts)
                # a range of windows stays inside a document: its last 49 words start none
                for i in np.flatnonzero(np.bincount(own, minlength=len(ids))):
                    if right[i]:
                        mine = slice(*np.searchsorted(own, [i, i + 1]))
                        out[0].append(ids[i])
                        out[1].append(b" ".join(words[i]).decode())
                        out[2].append(more[i][0])
                        out[3].append(np.stack([starts[mine] - first[i], stops[mine] - first[i]], 1).ravel().tolist())
            kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "text", "key", "ranges"])
    return run


def window_hashes(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 32 bits, of every ``window`` words in a row."""
    out = []
    for base, salt in ((_MIX, 0), (_MIX2, 1)):
        weights = np.cumprod(np.full(window, base, np.uint64))
        mixed = _mixed(values + np.uint64(salt))
        n = len(values) - window + 1
        total = np.zeros(max(n, 0), np.uint64)
        for i in range(window if n > 0 else 0):
            total += mixed[i:i + n] * weights[i]
        out.append(_mixed(total))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _windows(window: int):
    """Arrow function over (doc_id, text, key, ranges): hashes and places of the windows in the ranges."""
    def run(batches):
        for batch in batches:
            ids, keys, places, first, second, size = [], [], [], [], [], 0
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int32())

            def made():
                if not places:
                    return None
                counts = [len(p) for p in places]
                which = pa.array(np.repeat(np.arange(len(ids)), counts))
                return pa.RecordBatch.from_arrays([
                    pa.array(ids, kinds[0]).take(which), pa.array(np.repeat(np.array(keys, np.int64), counts)),
                    pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(first)),
                    pa.array(np.concatenate(second))], names=["doc_id", "key", "place", "h1", "h2"])
            for doc, text, key, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = window_hashes(hashes(words_of(text)), window)
                place = np.concatenate([np.arange(x, y) for x, y in zip(ranges[::2], ranges[1::2])])
                ids.append(doc)
                keys.append(key)
                places.append(place)
                first.append(a[place])
                second.append(b[place])
                size += len(place)
                if size > 1 << 18:
                    yield made()
                    ids, keys, places, first, second, size = [], [], [], [], [], 0
            out = made()
            if out is not None:
                yield out
    return run


def _cut(window: int):
    """Arrow function over (doc_id, text, key, places): the document without the words of its repeated windows."""
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for doc, text, key, places in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                cover = np.zeros(len(words) + 1, np.int64)
                places = np.array(places, np.int64)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + window, -1)
                kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                for column, value in zip(out, (doc, key, len(words) - len(kept), b" ".join([words[i] for i in kept]).decode())):
                    column.append(value)
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "key", "n_removed", "kept"])
    return run


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, digest): every document without its repeated windows.

    A window is ``window`` words in a row; each word of a window that also stands in a document with a
    smaller doc_id goes, judged on the input.  ``kept`` has the words that stay, joined by one blank, for
    documents that lose some but not all; it is null where all stay or go.  ``digest`` is the SHA-256 of
    all words, joined alike.

    One pass parses every text into symbols by rounds of naming runs and pairs; every window holds at least
    one symbol that its words alone decide, so symbols found in two different texts reveal where repeats
    can be.  Windows all of whose symbols are shared are then compared by 96-bit hashes, and the smallest
    document of each decides.  Texts equal as a whole are one text: copies go entirely and take no part.

    Null text has no words; documents shorter than a window lose nothing; a null doc_id is neither smaller
    nor larger than any; rows that repeat a doc_id are documents of equal rank, and those that repeat the text
    as well get the same result.  Extra columns are ignored; an empty table gives no rows.  What is sent
    between tasks are symbols, hashes and the texts of documents with shared symbols, once; a passage of
    a third of all documents is summed up before it is shuffled.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    marks = stored(texts.mapInArrow(
        _marks(window), f"doc_id {id_type}, n_words bigint, digest binary, key bigint, names array<bigint>"))
    ranked = marks.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = ranked.groupBy("digest").agg(F.min("doc_id").alias("first"))
    whole = stored(ranked.select("doc_id", "digest", "key").distinct().join(firsts, "digest")
                   .select("doc_id", "key", (F.col("doc_id") > F.col("first")).alias("copy")))
    names = ranked.select("doc_id", "key", F.explode("names").alias("name"))
    shared = stored(names.groupBy("name").agg(F.min("key").alias("a"), F.max("key").alias("b"))
                    .where(F.col("a") < F.col("b")).select("name"))
    lists = stored(names.join(shared, "name").groupBy("doc_id", "key").agg(F.collect_set("name").alias("shared"))
                   .join(whole.where(~F.col("copy")).select("doc_id", "key"), ["doc_id", "key"]))
    found = stored(texts.join(lists, "doc_id").select("doc_id", "text", "key", "shared").mapInArrow(
        _candidates(window), f"doc_id {id_type}, text string, key bigint, ranges array<int>"))
    windows = found.mapInArrow(_windows(window), f"doc_id {id_type}, key bigint, place int, h1 bigint, h2 int")
    least = stored(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                   .where(F.col("first") < F.col("last")).drop("last"))
    gone = stored(windows.join(least, ["h1", "h2"]).where(F.col("doc_id") > F.col("first"))
                  .groupBy("doc_id", "key").agg(F.collect_set("place").alias("places")))
    cut = (found.join(gone, ["doc_id", "key"]).select("doc_id", "text", "key", "places")
           .mapInArrow(_cut(window), f"doc_id {id_type}, key bigint, n_removed bigint, kept string")
           .dropDuplicates(["doc_id", "key"]))
    out = marks.select("doc_id", "n_words", "digest", "key").join(whole, ["doc_id", "key"], "left").join(cut, ["doc_id", "key"], "left")
    return out.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(
        F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(~F.col("copy") & (F.col("n_removed") < F.col("n_words")), F.col("kept")).alias("kept"), "digest")
