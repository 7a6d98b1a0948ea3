"""Marginal document probability over all segmentations of a subword lattice."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_of

VOCABULARY = "piece_bpe_32k.model"
END = ""                            # the token that ends every document; no word is empty
BLOCK_BYTES = 24 << 20
MARK = "▁"                     # stands for the start of a word in piece vocabularies
PRIOR = 0.1
CONCENTRATION = 2000.0

_pieces: dict = {}


# ---------------------------------------------------------------- words of the corpus

def _blocks(kind: str):
    """Arrow function over (doc_id, text, held): one row per document and per distinct word of a block.

    A block is a run of documents of at most about 24 MB in one task.  Document rows carry their words as
    indexes into the block's words; word rows carry how often training documents of the block use them.
    """
    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        state = {"block": 0, "weight": 0, "index": {}, "train": [], "docs": []}

        def flush():
            block, docs, words = (task << 32) | state["block"], state["docs"], list(state["index"])
            n, m = len(docs), len(words)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (n + m), pa.int64()), pa.array([d[0] for d in docs] + [None] * m, doc_type),
                pa.array([d[1] for d in docs] + [None] * m, pa.bool_()),
                pa.array([d[2] for d in docs] + [None] * m, pa.binary()),
                pa.array([None] * n + words, pa.string()), pa.array([None] * n + list(range(m)), pa.int32()),
                pa.array([None] * n + state["train"], pa.int64())], names=["block", "doc_id", "held", "codes", "word", "code", "n_train"])
            state.update(block=state["block"] + 1, weight=0, index={}, train=[], docs=[])

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, text, held in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc, raw, held = doc.as_py(), text.as_py().encode(), held.as_py()
                words = raw.lower().decode().translate(BLANKS).split(" ") if raw else []
                words = [w for w in words if w] if "" in words else words
                words.append(END)
                index, train = state["index"], state["train"]
                for w in set(words).difference(index):
                    index[w] = len(train)
                    train.append(0)
                codes = np.fromiter(map(index.__getitem__, words), "<u4", len(words))
                if not held:
                    for code, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True))):
                        train[code] += n
                state["docs"].append((doc, held, codes.tobytes()))
                state["weight"] += len(raw)
                if state["weight"] >= BLOCK_BYTES:
                    yield from flush()
        if state["docs"]:
            yield from flush()
    return run


BLANKS = {c: " " for c in (9, 10, 11, 12, 13)}


# ---------------------------------------------------------------- the lattice of a word

class Lattice:
    """Log probabilities of words over all their segmentations into vocabulary pieces.

    ``logs`` has the natural logarithm of every piece's weight; characters that no piece has are spelt by
    the vocabulary's byte pieces, so every word has a segmentation.
    """

    def __init__(self, logs: dict[str, float]):
        self.logs = logs
        self.longest = max((len(p) for p in logs), default=1)
        self.bytes = [logs[f"<0x{b:02X}>"] for b in range(256)]

    def all(self, words: list[str]) -> list[float]:
        """The words' log probabilities; words that begin alike share the recursion over that beginning."""
        out = [0.0] * len(words)
        last, reach = "", [0.0]          # reach[i]: log of the summed weight of all ways to place i
        for i in sorted(range(len(words)), key=words.__getitem__):
            text = MARK + words[i]
            alike = 0
            for a, b in zip(last, text):
                if a != b:
                    break
                alike += 1
            del reach[alike + 1:]
            self._extend(text, reach)
            last, out[i] = text, reach[-1]
        return out

    def _extend(self, text: str, reach: list[float]) -> None:
        logs, longest, exp = self.logs, self.longest, math.exp
        for end in range(len(reach), len(text) + 1):
            paths = [reach[start] + logs[text[start:end]] for start in range(max(0, end - longest), end)
                     if text[start:end] in logs]
            if text[end - 1] not in logs:
                paths.append(reach[end - 1] + sum(self.bytes[b] for b in text[end - 1].encode()))
            most = max(paths)
            reach.append(most + math.log(sum([exp(p - most) for p in paths])) if len(paths) > 1 else most)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without its control symbols."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i))]


def _segmented(path: str):
    """Arrow function over (word,): in how many words, with repeats, the vocabulary's own segmentation has each piece."""
    def run(batches):
        import sentencepiece
        if path not in _pieces:
            _pieces[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        model, total = _pieces[path], Counter()
        for batch in batches:
            for ids in model.encode(batch.column(0).to_pylist(), num_threads=1):
                total.update(ids)
        yield pa.RecordBatch.from_arrays([pa.array([model.id_to_piece(i) for i in total], pa.string()),
                                          pa.array(list(total.values()), pa.int64())], names=["piece", "n"])
    return run


def _likelihoods(logs):
    """Arrow function over (word, n_train): log10 of the lattice's marginal probability of each word."""
    def run(batches):
        marginal = Lattice(logs.value)
        for batch in batches:
            values = [v / math.log(10) for v in marginal.all(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())],
                                             names=["word", "n_train", "spelt"])
    return run


# ---------------------------------------------------------------- documents

def _adapted(codes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 of each token given those before it in its document; ``share`` has log10 of the corpus's shares."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    earlier = np.empty(len(codes))
    earlier[order] = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    share = share[codes] + math.log10(CONCENTRATION)
    again = np.log10(np.maximum(earlier, 1) + 10.0 ** np.maximum(share, -300))
    return np.where(earlier > 0, again, share) - np.log10(np.arange(len(codes)) + CONCENTRATION)


def _scored(total: int, distinct: int):
    """Grouped Arrow function over one block's rows: base and model scores of its documents.

    A word has probability c / (N + V) from its training count and V / (N + V) times the lattice's
    marginal; the end of a document, which no piece spells, the add-one share of its own count.  The
    words of a document are drawn from a Dirichlet distribution around these with concentration
    ``CONCENTRATION``, so a word's earlier uses in its document raise it.
    """
    def run(table):
        words = table.filter(pa.compute.is_valid(table["code"]))
        docs = table.filter(pa.compute.is_null(table["code"]))
        n = len(words)
        place = words["code"].to_numpy()
        counts, spelt = np.zeros(n, np.int64), np.zeros(n)
        counts[place] = words["n_train"].to_numpy()
        spelt[place] = words["spelt"].to_numpy()
        ends = np.zeros(n, bool)
        ends[place] = words["is_end"].to_numpy(zero_copy_only=False)
        whole = math.log10(total + distinct) if total else 0.0
        base = np.log10(counts + 1.0) - math.log10(total + (distinct + 1))
        with np.errstate(divide="ignore"):
            seen = np.where(counts > 0, np.log10(np.maximum(counts, 1)) - whole, -np.inf)
            new = spelt + (math.log10(distinct) - whole if distinct else 0.0)
        share = np.where(ends, base, np.maximum(seen, new) + np.log10(1 + 10 ** -np.minimum(np.abs(seen - new), 300)))
        out = ([], [], [], [])
        for codes in docs["codes"].to_pylist():
            codes = np.frombuffer(codes, "<u4")
            for column, value in zip(out, (len(codes), int((counts[codes] > 0).sum()), math.fsum(base[codes]), math.fsum(_adapted(codes, share)))):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays(
            [docs["doc_id"], docs["held"], *[pa.array(c, k) for c, k in zip(out, kinds)],
             pa.array([total] * len(docs), pa.int64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens"])
    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, vocabulary_path: str, held: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Words (A-Z lower-cased) and one end per document are counted over all documents that ``held`` does not
    keep out.  The vocabulary's pieces get weights from the segmentations of all distinct training words,
    smoothed by 0.1 each.  A forward recursion over each distinct word sums all its segmentations in log
    space, mixed with the word's training share by the Witten-Bell weight N / (N + V).  No piece crosses
    white space, so the marginal probability of a document is a product over its words; a Dirichlet prior
    around these probabilities lets it follow the document's own vocabulary.  ``score`` is its log10.
    ``base_score`` adds one to every count.

    Documents travel once, as words' indexes into the distinct words of a block of bounded size; the counts
    and likelihoods of these come back by a join on the word, so no table of all words is ever held in one
    place and a frequent word has one row per block.  Null and empty texts have the end alone; a null
    doc_id is never held out; repeated rows are scored one by one; without training rows the model is the
    lattice alone over uniform pieces.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    held = held_out(F.col("doc_id")) if held is None else held
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", text_of().alias("text"), held.alias("held")).mapInArrow(
        _blocks(id_type), f"block bigint, doc_id {id_type}, held boolean, codes binary, word string, code int, n_train bigint"))
    uses = rows.where(F.col("code").isNotNull())
    counts = stored(uses.groupBy("word").agg(F.sum("n_train").alias("n_train")))
    total, distinct = counts.agg(F.sum("n_train"), F.count(F.when(F.col("n_train") > 0, 1))).first()
    total = total or 0
    pieces = vocabulary(vocabulary_path)                 # as many as the vocabulary has, whatever the corpus
    spelt = {r[0]: r[1] for r in counts.where((F.col("n_train") > 0) & (F.col("word") != END)).select("word").mapInArrow(
        _segmented(vocabulary_path), "piece string, n bigint").groupBy("piece").agg(F.sum("n")).collect()}
    weight = math.log(sum(spelt.get(p, 0) + PRIOR for p in pieces))
    logs = spark.sparkContext.broadcast({p: math.log(spelt.get(p, 0) + PRIOR) - weight for p in pieces})
    known = stored(counts.mapInArrow(_likelihoods(logs), "word string, n_train bigint, spelt double"))
    back = uses.select("block", "word", "code").join(known, "word").select(
        "block", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("boolean").alias("held"),
        F.lit(None).cast("binary").alias("codes"), "code", "n_train", "spelt", (F.col("word") == END).alias("is_end"))
    texts = rows.where(F.col("code").isNull()).select(
        "block", "doc_id", "held", "codes", "code", F.lit(None).cast("bigint").alias("n_train"),
        F.lit(None).cast("double").alias("spelt"), F.lit(None).cast("boolean").alias("is_end"))
    return texts.unionByName(back).groupBy("block").applyInArrow(
        _scored(total, distinct), f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, "
        "base_score double, score double, train_tokens bigint")
