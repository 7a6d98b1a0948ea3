import hashlib

from llm_brute import WORD
from llm_fixtures import none, odd, plain  # noqa: F401

from vigil.llm import mixing as M


def replay(docs, share=1.5, limit=2.0):
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: float(M.WEIGHTS[i % 3]) for i, s in enumerate(sources)}
    full, target = set(), {}
    while True:
        free = [s for s in sources if s not in full]
        left = share * sum(size.values()) - sum(limit * size[s] for s in full)
        target = {s: limit * size[s] if s in full else left / sum(weight[x] for x in free) * weight[s] for s in sources}
        over = {s for s in free if target[s] > limit * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in sources:
        own = sorted(((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d is not None, d or 0, n, d)
                      for d, x, n in rows if x == s))
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, before = target[s] - epochs * size[s], 0
        for *_, n, d in own:
            out.append((repr(d), n, size[s], round(target[s], 6), n * (epochs + (before + n / 2 <= rest))))
            before += n
    return sorted(out)


def plan(docs, **options):
    return sorted((repr(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.mix(docs, **options).collect())


def test_whole_table(plain, odd, none):
    for docs in (plain, odd, none):
        want = replay(docs)
        assert plan(docs) == want
        assert plan(docs, bucket_rows=2) == want


def test_one_source_holds_most(spark):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 40}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = plan(docs, bucket_rows=10)
    assert got == replay(docs)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


def test_rows_follow_the_plan(plain, odd, none):
    for docs in (plain, odd, none):
        rows = M.mixed_rows(docs)
        assert rows.columns == docs.columns
        words = sum(len(WORD.findall(r.text or "")) for r in rows.collect())
        assert words == sum(r[4] for r in plan(docs))
