"""The pipeline against plain Python on what each stage was given."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_dedup import _cut, _groups

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        given[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        assert name == "tokens" or set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    rows = lambda name: {x.doc_id: x for x in given[name].collect()}
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = rows("near_duplicates")
    right = [(d in kept) == bool(q) for d, q in labels.items() if d in rows("quality")]
    assert sum(right) >= 0.9 * len(right)
    groups = _groups([(d, x.text) for d, x in kept.items()], 80)
    assert set(rows("repeated_passages")) == {d for d, (_, top) in groups.items() if d == top}
    cut = {d: removed for d, _, removed, _, _ in _cut([(d, x.text.encode()) for d, x in rows("repeated_passages").items()])}
    mixed = rows("mix")
    for d, x in rows("repeated_passages").items():
        if d in mixed:
            assert x.text == mixed[d].text or cut[d] > 0
            assert len(x.text.encode()) - len(mixed[d].text.encode()) <= cut[d] + 8 and mixed[d].n_chars == len(mixed[d].text)
    assert docs.where(F.size("tokens") != F.col("n_tokens")).count() == 0
    assert {x.doc_id for x in docs.collect()} == set(rows("tokens"))


def test_stages_take_odd_rows(odd, nothing, spark):
    """Nulls, empty and long texts, ties, repeated rows, other columns with clashing names, and no rows at all."""
    for given in (odd.drop("node"), nothing):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "tokens":
                assert out.columns == docs.columns
                docs = out
            rows = out.collect()
            assert given is odd or name or rows is not None
        assert given is not nothing or not rows
    kept = corpus_pipeline.first_of_group(spark, odd, DATA).collect()
    plain = odd.collect()
    assert all(x in plain for x in kept) and sum(x.doc_id is None for x in kept) == sum(x.doc_id is None for x in plain)
    assert {x.text for x in kept if x.doc_id == 9} >= {x.text for x in plain if x.doc_id == 9 and x.source is None}


def test_run_writes_its_stages(spark, tmp_path, monkeypatch):
    calls = []
    keep = lambda name: lambda s, docs, d: calls.append((name, docs.count())) or docs.where("doc_id % 2 = 0 OR doc_id > 9")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", keep("a")), ("b", keep("b")), ("c", keep("c"))])
    assert corpus_pipeline.run(spark, DATA).count() == calls[-1][1] == calls[1][1] < calls[0][1]
