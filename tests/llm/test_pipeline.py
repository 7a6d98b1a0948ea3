"""Every stage against a plain version of what its operator does, on its own input."""

import importlib.util
from collections import Counter

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline as pipeline
from llm_brute import WORD, base_counts, base_spans, texts
from llm_fixtures import none, odd, plain  # noqa: F401
from pyspark.sql import functions as F
from test_resemblance import first_ids

from vigil.llm import quality
from vigil.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark, plain):
    docs, inputs = plain, {}
    for name, stage in pipeline.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, SF))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == plain.columns
    inputs["end"] = docs

    rules = quality.fit(plain, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in quality.statistics(plain).collect()}
    kept = {d for d, t in texts(plain) if not base_counts(t)[5]
            and not any(all(c.holds(rows[d].asDict()) for c in rule) for rule in rules)}
    assert {d for d, _ in texts(inputs["near_duplicates"])} == kept

    first = {d for d, c in first_ids(texts(inputs["near_duplicates"])) if d == c}
    assert Counter(d for d, _ in texts(inputs["personal_data"])) == Counter(first)

    before, after = dict(texts(inputs["personal_data"])), dict(texts(inputs["mixture"]))
    assert before.keys() == after.keys()
    for doc, text in before.items():
        if base_spans(text):
            assert not any(text[a:b] in after[doc] for _, a, b in base_spans(text))
        elif not any(c.isdigit() for c in text):
            assert after[doc] == text

    size = {d: len(WORD.findall(t)) for d, t in after.items()}
    taken = Counter(d for d, _ in texts(inputs["sequences"]))
    assert max(taken.values()) <= 2
    share = sum(size[d] * n for d, n in taken.items()) / sum(size.values())
    assert 1.4 < share < 1.6

    packed = inputs["end"].collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == taken
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert max(fill.values()) <= 2048


def test_odd_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
        assert pipeline.sequences(spark, docs, SF).where(F.col("length") < 1).count() == 0


def test_run(spark):
    rows = pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)
