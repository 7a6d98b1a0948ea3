"""Lists in bounded documents: rules and other lists of any length, written and read in order."""

import json

from pyspark.sql import functions as F

from vigil.sources import readers, writers


def test_rules_over_many_documents(spark, tmp_path, monkeypatch):
    """The order holds over the documents, and rules without a number take the next free ones in that order."""
    monkeypatch.setattr(writers, "DOCUMENT_ROWS", 7)
    path = str(tmp_path / "rules")
    rows = [(0 if k % 10 == 3 else k, f"r{k}", (k * 7) % 5, k) for k in range(1, 101)]
    frame = spark.createDataFrame(rows, "rule_id int, name string, priority int, seq int").repartition(6)
    writers.write_rules(frame, path, 'al"low')
    files = sorted((tmp_path / "rules").glob("document=*/*.txt"), key=lambda f: int(f.parent.name.split("=")[1]))
    documents = [json.loads(f.read_text()) for f in files]
    assert len(documents) == 15 and max(len(d["rules"]) for d in documents) == 7 and {d["default_policy"] for d in documents} == {'al"low'}
    want = sorted(rows, key=lambda r: (r[2], r[3]))
    assert [r["name"] for d in documents for r in d["rules"]] == [r[1] for r in want]
    read = readers.read_firewall_rules(spark, path).orderBy("seq").collect()
    assert [r.name for r in read] == [r[1] for r in want] and [r.seq for r in read] == list(range(100))
    free = iter(range(101, 120))
    assert [r.rule_id for r in read] == [r[0] or next(free) for r in want] and {r.default_policy for r in read} == {'AL"LOW'}


def test_other_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "DOCUMENT_ROWS", 4)
    listed = spark.range(30).select(F.col("id").cast("int").alias("id"), F.lit("alert").alias("action"), F.lit("tcp").alias("protocol"),
                                    F.concat(F.lit('say "'), "id").alias("content"), F.lit(None).cast("string").alias("msg"))
    writers.write_list(listed, str(tmp_path / "content"), ["id"])
    read = readers.read_content_signatures(spark, str(tmp_path / "content"))
    assert sorted(map(tuple, read.select("id", "content").collect())) == [(k, f'say "{k}') for k in range(30)]
    writers.write_list(listed.limit(0), str(tmp_path / "none"), ["id"])
    assert readers.read_content_signatures(spark, str(tmp_path / "none")).count() == 0
