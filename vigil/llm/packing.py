"""Packing token sequences: minimum bin slack over the multiset of remaining lengths."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_of

CAPACITY = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CLASS_ROWS = 1_000
CACHE_WORDS = 400_000
LONG_WORD = 64
CHUNK_BYTES = 4 << 20
PLAIN_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]{1,64}").fullmatch       # letters alone
PLAIN_AT_ONCE = 100
#: What a byte is: white space, a letter or digit, a mark (ASCII), or anything else.
BLANK, WORDLIKE, MARK = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = MARK
KINDS[[*b" \t\n\v\f\r"]] = BLANK
KINDS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = WORDLIKE

_encoders: dict = {}


class Encoder:
    """Token ids of texts by a ``tokenizers`` file that drops white space and lower-cases.

    Such a tokenizer treats the stretches between blanks alone, and what stands up to a letter or digit apart
    from a mark behind it.  So texts are lower-cased and cut there as whole Arrow arrays, each distinct
    stretch is encoded once, and its ids are copied to all its places.  They are kept in a cache of bounded
    size; what a full cache knows of the texts at hand stays when the rest goes, and words above 64
    characters are not kept.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)       # ids that end a word
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.cache_words = cache_words
        self.codes: dict[str, int] = {}
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone, encoded many at a time: the last id of each tells that it ends a word."""
        lines = [" ".join(words[k:k + PLAIN_AT_ONCE]) for k in range(0, len(words), PLAIN_AT_ONCE)]
        ids, _ = self._alone(lines)
        ends = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self._alone(words)

    def _add(self, words: list[str]) -> None:
        plain = [w for w in words if PLAIN_WORD(w)]
        other = sorted((w for w in words if not PLAIN_WORD(w)), key=len)
        for part, (ids, size) in ((plain, self._joined(plain)), (other, self._alone(other))):
            start = len(self.ids)
            self.codes.update(zip(part, range(len(self.size), len(self.size) + len(part))))
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
            self.first = np.concatenate([self.first, start + np.cumsum(size) - size])

    def _keep(self, codes: np.ndarray, words: list[str]) -> None:
        """Forget all words but these."""
        self.ids, self.size = self.ids[_spread(self.first[codes], self.size[codes])], self.size[codes]
        self.first, self.codes = np.cumsum(self.size) - self.size, dict(zip(words, range(len(words))))

    def _coded(self, words: list[str]) -> np.ndarray:
        """Code of each of the distinct ``words`` in the cache, to which fresh ones are added."""
        found = np.fromiter((self.codes.get(w, -1) for w in words), np.int64, len(words))
        known, fresh = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        if len(self.codes) + len(fresh) > self.cache_words:
            self._keep(found[known], [words[i] for i in known])
            found[known] = np.arange(len(known))
        fresh_words = [words[i] for i in fresh]
        self._add(fresh_words)
        found[fresh] = np.fromiter(map(self.codes.__getitem__, fresh_words), np.int64, len(fresh))
        return found

    def _forget_long(self, words: list[str]) -> None:
        for word in words:
            if len(word) > LONG_WORD:
                del self.codes[word]
        if len(self.codes) < len(self.size):
            kept = list(self.codes)
            self._keep(np.fromiter(self.codes.values(), np.int64, len(kept)), kept)

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
        places, bounds = _stretches(*_prepared(texts, self.special))
        table = places.dictionary_encode()
        words = table.dictionary.to_pylist()
        code = self._coded(words)[table.indices.to_numpy()]
        size = self.size[code]
        ids = self.ids[_spread(self.first[code], size)].tobytes()
        cut = 4 * np.concatenate([[0], np.cumsum(size)])[bounds]
        self._forget_long(words)
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``size`` numbers each, one after the other."""
    end = np.cumsum(size)
    return np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where in them each begins; the last ends at the last of these."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    return data, at - at[0]


def _prepared(texts: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The texts, lower-cased where that may be done letter by letter, and whether it was done.

    It may below U+0240 without a dotted capital I, and for U+2000 to U+203F: none of these is composed with others.  Texts
    with a special token, which the tokenizer finds before it lower-cases, stay as they are.
    """
    data, at = _bytes(texts)
    simple = np.ones(len(texts), bool)
    behind = np.append(data[1:], 0)
    high, dotted = np.flatnonzero(data >= 0xC9), np.flatnonzero(data == 0xC4)
    high = high[(data[high] != 0xE2) | (behind[high] != 0x80)]
    dotted = dotted[behind[dotted] == 0xB0]
    simple[np.searchsorted(at, np.concatenate([high, dotted]), "right") - 1] = False
    lower = pc.utf8_lower(texts)
    for token in special:
        simple &= ~pc.match_substring(lower, token).to_numpy(zero_copy_only=False)
    return (lower if simple.all() else pc.if_else(pa.array(simple), lower, texts)), simple


def _stretches(texts: pa.Array, simple: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All stretches of the texts in order, and where in them each text begins and the last ends.

    They are cut at ASCII white space, and in ``simple`` texts between a Latin letter or a digit and an ASCII mark.
    """
    data, at = _bytes(texts)
    solid = KINDS[data] != BLANK
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inner = at[:-1][at[:-1] < at[1:]]
    start[inner] = solid[inner]
    marks = np.flatnonzero(KINDS[data] == MARK)
    marks = marks[marks > 1] if len(marks) else marks
    last, lead = data[marks - 1], data[marks - 2]
    latin = (last & 0xC0 == 0x80) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    marks = marks[(KINDS[last] == WORDLIKE) | latin]
    if not simple.all():
        marks = marks[simple[np.searchsorted(at, marks, "right") - 1]]
    start[marks] = True
    offsets = np.append(np.flatnonzero(start[solid]), np.count_nonzero(solid))
    words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[solid]))
    return words, np.searchsorted(np.flatnonzero(start), at)


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One encoder per Python worker, file and size of cache."""
    if (path, cache_words) not in _encoders:
        _encoders[path, cache_words] = Encoder(path, cache_words)
    return _encoders[path, cache_words]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           cache_words: int = CACHE_WORDS) -> DataFrame:
    """Token pieces (doc_id, start, length, doc_tokens, ids): whole windows first, then the rest.

    ``ids`` holds little-endian unsigned 32-bit ids.  A document is its text's ids (null: none) and
    ``end_id``; it is cut every ``capacity`` ids, so each has at most one piece that is not full.  Each
    Python worker keeps the ids of up to ``cache_words`` words.
    """
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(tokenizer_path, cache_words), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            kind, first = batch.schema.field(0).type, 0
            texts = batch.column(1)
            while first < len(batch):
                last, weight = first, 0
                while last < len(batch) and weight < CHUNK_BYTES:
                    weight += len(texts[last].as_buffer() or b"")
                    last += 1
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(batch.column(0)[first:last].to_pylist(), encode(texts[first:last])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        part = ids[4 * start:4 * (start + capacity)]
                        for column, value in zip(rows, (doc, start, len(part) // 4, n, part)):
                            column.append(value)
                yield _batch(kind, rows)
                first = last

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        run, f"doc_id {id_type.simpleString()}, start bigint, length bigint, doc_tokens bigint, ids binary")


def _batch(id_type, rows):
    kinds = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                      names=["doc_id", "start", "length", "doc_tokens", "ids"])


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The lengths, with how many of each, that fill one window closest to ``capacity``.

    The longest length left is always taken; a bitset of reachable sums, one integer shifted once per
    copy, finds the best completion, and walking back through its stages counts the copies.
    """
    longest = max(counts)
    space = capacity - longest
    mask = (1 << (space + 1)) - 1
    reach, stages = 1, []
    for length in sorted(counts, reverse=True):
        copies = min(counts[length] - (length == longest), space // length)
        if copies <= 0:
            continue
        stages.append((length, reach))
        for _ in range(copies):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            reach = wider
        if reach >> space & 1:
            break
    left = reach.bit_length() - 1
    used = Counter({longest: 1})
    for length, before in reversed(stages):
        while not before >> left & 1:
            used[length] += 1
            left -= length
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Rows (length, first_rank, end_rank, copies, first_sequence, first_offset).

    A window's multiset is used as often as the counts allow, so there are few of them however many
    pieces there are: the work depends on ``capacity`` alone.
    """
    counts = {length: n for length, n in histogram.items() if n > 0}
    rank: Counter = Counter()
    rows, sequence = [], 0
    while counts:
        used = fill(counts, capacity)
        times = min(counts[length] // n for length, n in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, rank[length], rank[length] + n * times, n, sequence, offset))
            rank[length] += n * times
            offset += n * length
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Add sequence_id and offset to ``parts`` (doc_id, start, length and any more columns).

    Only the count of each length (at most ``capacity`` of them) comes to the driver, and the plan made
    from it is broadcast; it has some rows per length, whatever the input.  The pieces of a length are
    ranked in chunks of about ``class_rows`` rows with sums over chunks, so a length that holds a third
    of all pieces is spread over many tasks.

    Repeated rows and null ids are pieces like any other.  An empty table gives an empty result.
    """
    spark: SparkSession = parts.sparkSession
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    if any(length < 1 or length > capacity for length in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    uses = spark.createDataFrame(
        plan(histogram, capacity),
        "_length bigint, _from bigint, _to bigint, _copies bigint, _sequence bigint, _offset bigint")
    chunks = spark.createDataFrame([(k, -(-n // class_rows)) for k, n in histogram.items()], "_l bigint, _chunks bigint")
    # a hash of all that tells pieces apart; equal rows may change places
    cut = parts.join(F.broadcast(chunks), F.col("length") == F.col("_l")).withColumn(
        "_chunk", F.pmod(F.xxhash64("doc_id", "start"), F.col("_chunks"))).drop("_l", "_chunks")
    sums = stored(cut.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_rows")))
    before = sums.select(F.col("length").alias("_l"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_rows").over(
        Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = (cut.withColumn("_place", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("doc_id", "start")))
              .join(before, (F.col("length") == F.col("_l")) & (F.col("_chunk") == F.col("_c")))
              .withColumn("_rank", F.col("_before") + F.col("_place") - 1))
    inside = F.col("_rank") - F.col("_from")
    return (ranked.join(F.broadcast(uses), (F.col("length") == F.col("_length"))
                        & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
            .withColumn("sequence_id", F.col("_sequence") + F.floor(inside / F.col("_copies")))
            .withColumn("offset", F.col("_offset") + inside % F.col("_copies") * F.col("length"))
            .select(*parts.columns, "sequence_id", "offset"))
