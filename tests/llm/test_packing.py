import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_brute import texts
from llm_fixtures import none, odd, plain  # noqa: F401
from pyspark.sql import functions as F

from vigil.llm import packing as K
from vigil.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file())


def check(docs, tokenizer, **options):
    rows = K.pack(K.stored(K.pieces(docs, tokenizer_file())), **options).withColumn("crc", F.crc32("ids")).collect()
    want = Counter()
    for doc, text in texts(docs):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for start in range(0, len(ids), K.CAPACITY):
            part = ids[start:start + K.CAPACITY]
            want[(doc, start, len(part), len(ids), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.crc) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= K.CAPACITY
        padding += K.CAPACITY - at
    return padding, len(sequences)


def test_whole_table(plain, tokenizer):
    padding, n = check(plain, tokenizer)
    assert padding < 2 * K.CAPACITY and n > 50
    check(plain, tokenizer, class_rows=1)


def test_odd_rows(odd, none, tokenizer):
    check(odd, tokenizer)
    assert K.pack(K.pieces(none, tokenizer_file())).count() == 0


def test_words_encode_like_texts(tokenizer):
    rnd = random.Random(3)
    alphabet = "abcXYZ éÉßİıΣςſ.,!?;:#*$%&'\"-_|<>0129 \t\n\r\x0b\x1c\x1f\x85\xa0 中文ﬁǺ\U0001f600"
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))) for _ in range(3000)]
    samples += ["it's we've I'LL 'S", "<|endoftext|>", "a<|endoftext|>.", "<|ENDOFTEXT|>", "Éa! É", "word" * 40 + "!!", "x" * 300 + " y"]
    encode = K.Encoder(tokenizer_file(), cache_words=500)
    for i in range(0, len(samples), 40):
        part = samples[i:i + 40]
        for text, got, want in zip(part, encode(part), tokenizer.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)


def test_every_letter_encodes_like_texts(tokenizer):
    chars = [chr(c) for c in [*range(0x2100), *range(0x2C60, 0x2C80), *range(0xAC00, 0xAC10), 0x212A, 0x212B, 0x3000, 0xFB01, 0x1F600]]
    samples = [f"A{c}b. {c},X {c}.Y e{c}' {c}{c}3{c}! É{c}\u201c s{c}'S.Q{c}" for c in chars]
    samples += ["", " ", "É.\u2019", "\u2019.a.", "A.<|endoftext|>.B", "A.<|EndOfText|>.B", "a\u2260.=\u0338."]
    encode = K.Encoder(tokenizer_file(), cache_words=5000)
    for part in (samples[i:i + 500] for i in range(0, len(samples), 500)):
        for one in (False, True):          # alone, so that its text decides, and beside others
            found = [encode([text])[0] for text in part] if one else encode(part)
            for text, got, want in zip(part, found, tokenizer.encode_batch(part, add_special_tokens=False)):
                assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)


class Counting:
    """A tokenizer that counts the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, Counter()

    def _batch(self, texts, **options):
        self.words.update(word for text in texts for word in text.split())
        return self.tokenizer.encode_batch(texts, **options)
    encode_batch = encode_batch_fast = _batch


def test_words_are_encoded_once(tokenizer):
    encode = K.Encoder(tokenizer_file(), cache_words=60)
    encode.tokenizer = counting = Counting(tokenizer)
    letters = "abcdefghijklmnopqrst"
    common = [a + b for a in letters[:8] for b in letters[:5]]
    for n in range(20):                       # a full cache keeps what it knows of the texts at hand
        text = " ".join([*common, *(f"{letters[n]}{letters[k]}zz" for k in range(5))])
        assert encode([text.title(), text.upper() + "!"]) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                                                             for t in (text, text + "!")]
    assert set(common) <= counting.words.keys() and max(counting.words.values()) == 1


def best_fill(counts, capacity):
    """Largest sum that holds the longest length, by trying all multisets."""
    reach = {max(counts)}
    left = dict(counts)
    left[max(counts)] -= 1
    for length, n in left.items():
        reach = {s + k * length for s in reach for k in range(n + 1) if s + k * length <= capacity}
    return max(reach)


def test_fill_is_closest():
    rnd = random.Random(1)
    for _ in range(400):
        capacity = rnd.randrange(4, 60)
        counts = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 7))}
        used = K.fill(counts, capacity)
        assert all(0 < n <= counts[length] for length, n in used.items())
        assert sum(length * n for length, n in used.items()) == best_fill(counts, capacity)


def test_plan_uses_each_piece_once():
    rnd = random.Random(2)
    histogram = {rnd.randrange(1, 2049): rnd.randrange(1, 1000) for _ in range(500)}
    rows = K.plan(histogram, 2048)
    for length, n in histogram.items():
        ranges = sorted((a, b) for size, a, b, *_ in rows if size == length)
        assert ranges[0][0] == 0 and ranges[-1][1] == n and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    assert len(rows) < 20_000
