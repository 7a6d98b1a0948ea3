import hashlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), loss)
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit("x")).withColumn("tokens", F.lit(None).cast("int"))
    wins = C.windows(frame, **options).persist()
    got = {r.conv_id: (r.n_turns, hashlib.sha256(r.turns.encode()).hexdigest(), r.loss) for r in C.read_back(wins).collect()}
    assert got == expected(rows)
    return wins.orderBy("conv_id", "window").collect()


HARD = "\\### Assistant: </turn> ok"


def test_control_strings(spark):
    rows = [(1, 0, "system", "<turn n x>"), (1, 1, "us>er\\", HARD), (1, 2, "assistant", HARD + "\n</turn>\n\\s\\l\\g\\\\"),
            (2, 0, None, None), (2, None, "assistant", None), (3, 0, "assistant", "é中\U0001f600"), (3, 0, "assistant", "é中\U0001f600"),
            (None, 1, "assistant", "lost"), (4, 0, "system", "alone"), (5, 3, "user", ""), (5, 3, "system", "not first"), (5, 9, "assistant", "x" * 9000)]
    check(spark, rows)


@pytest.mark.parametrize("budget", [30, 100, 1024])
def test_windows(spark, budget):
    rows = []
    for conv in range(6):
        if conv % 2:
            rows.append((conv, 0, "system", "be kind"))
        for t in range(1, 200 if conv == 3 else 20):
            rows.append((conv, t, "assistant" if t % 2 == 0 else "user", " ".join(["w"] * ((t * 7 + conv) % 23))))
    history = 12
    wins = check(spark, rows, budget=budget, history=history, system=6)
    stride = C._stride(budget, history, 6)
    for w in wins:
        pieces = [p for p in w.formatted.split(C.END) if p]
        flags = [p[6] for p in pieces]
        if w.conv_id % 2:
            assert pieces[0][6:].split(">")[0][2:] == "system" and flags[0] == ("n" if w.window == 0 else "s")
        body = flags[1:] if w.conv_id % 2 else flags
        assert body == sorted(body)                          # history stands before what is new
        assert sum(f == "n" for f in body) >= 1
        repeated = sum(len(p[p.index(">") + 1:].split()) + 4 for p, f in zip(pieces, flags) if f == "h")
        assert repeated <= history
        assert w.over_budget == (w.n_tokens > budget)
        if stride >= 27:
            assert not w.over_budget
        masked = [w.formatted[m.start:m.start + m.length] for m in w.mask]
        assert masked == [p[p.index(">") + 1:] for p, f in zip(pieces, flags) if f == "n" and " assistant>" in p[:20]]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.windows(empty).count() == 0 and C.read_back(C.windows(empty)).count() == 0
