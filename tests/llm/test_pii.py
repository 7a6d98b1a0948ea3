import hashlib

from llm_brute import base_spans, texts
from llm_fixtures import none, odd, plain  # noqa: F401

from vigil.llm import pii as P


def found(docs):
    rows = P.find(docs).select("doc_id", P.listed(P.F.col("base")).alias("base"), P.listed(P.F.col("spans")).alias("spans")).collect()
    return sorted(((repr(r.doc_id), r.base, r.spans) for r in rows))


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(docs):
    got = found(docs)
    assert [(d, b) for d, b, _ in got] == sorted((repr(d), listed(base_spans(t))) for d, t in texts(docs))
    for _, base, spans in got:
        assert set(base.split(",")) <= set(spans.split(","))


def test_whole_table(plain, odd, none):
    check(plain)
    check(odd)
    check(none)


def test_hard_cases(spark):
    texts_ = ["a@b.com_x@y.org", "a@b.com.x@y.org", "@x.y a@ a@b a@b. a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3",
              "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (168) 555-5254. +1-2 +123456789012345678", "é+44 20 7946 0958é",
              "9" * 9000, "4 " * 6000, "a" * 30_000 + "@", "1." * 5000, "+" * 5000, "+1" + "(" * 5000, "79927398713 5500005555555559",
              "00000000000000000000000000000000000000000000255.1.1.1", "x" * 20_000 + "@mail.example.com"]
    check(spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string"))


def test_contexts_find_unseen_numbers(spark):
    """A valid number teaches its context and shape; the same shape after it is found where the base pattern fails."""
    rows = [(i, f"call me: +1 (2{i:02d}) 555-01{i:02d} now") for i in range(20)] + [(100, "CALL!! +1!! (777)!! 555-9999!!"), (101, "room 555-9999")]
    got = {r.doc_id: r for r in P.find(spark.createDataFrame(rows, "doc_id bigint, text string")).select(
        "doc_id", P.listed(P.F.col("base")).alias("base"), P.listed(P.F.col("spans")).alias("spans")).collect()}
    assert got[100].base == "" and "phone:20:28" in got[100].spans
    assert got[101].spans == ""
    assert all(got[i].base == got[i].spans != "" for i in range(20))


def test_scores_against_a_plain_loop(spark):
    uses = [("a", "9", f"{i}", 3 if i % 2 else -1) for i in range(10)] + [("b", "9", f"{i}", 3 if i % 2 else -1) for i in range(1, 8)] + [
        ("c", "9", "1", 3), ("d", "9", "x", -1)] + [("e", "9", f"{i}", 3 if i % 2 else -1) for i in (1, 3, 5, 7, 8)]
    frame = spark.createDataFrame(uses, "context string, shape string, instance string, kind int")
    good = {r.context for r in P.confident_patterns(frame, rounds=3).collect()}
    edges, known = {(c, i) for c, _, i, _ in uses}, {i: 1.0 for _, _, i, k in uses if k >= 0}
    for _ in range(3):
        accepted = {}
        for c in {c for c, _ in edges}:
            mine = [known.get(i, 0.0) for d, i in edges if d == c]
            if sum(mine) / len(mine) >= 0.8 and sum(v >= 0.8 for v in mine) >= 3:
                accepted[c] = sum(mine) / len(mine)
        for c, i in edges:
            if c in accepted:
                known[i] = max(known.get(i, 0.0), accepted[c])
    assert good == set(accepted) and good


def test_mask(spark, odd, none):
    rows = [(1, "é mail a.b@c.de or 10.0.0.1!", "en", None, 0), (2, None, None, None, None), (3, "nothing", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r.doc_id: r for r in P.mask(docs).collect()}
    assert out[1].text == "é mail [EMAIL] or [IP]!" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "nothing" and out[3].n_chars == 7
    assert P.mask(odd).columns == odd.columns and P.mask(odd).count() == odd.count() and P.mask(none).count() == 0
    hashed = P.find(docs).select(P.F.sha2(P.listed(P.F.col("base")), 256).alias("h")).collect()
    assert hashlib.sha256(b"").hexdigest() in {r.h for r in hashed}
