from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline as p
from lociweave.llm import op3_secrets, op4_decontaminate, op6_packing, textkit

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    assert op4_decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").isEmpty()
    assert op3_secrets.scan_secrets(docs).filter("n_access > 0").isEmpty()
    want = op6_packing.pack(docs, op6_packing.default_tokenizer())
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, p.run(spark, SF).select(order).collect())) == sorted(map(tuple, want.select(order).collect()))


def test_memory_of_workers(spark, monkeypatch):
    """Whole texts come to workers in batches of bounded bytes, and at a task's end freed memory is given back."""
    texts = spark.range(64, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 100000) as text", "'en' as lang", "'web' as source", "500000 as n_chars")
    p.redact_secrets(spark, texts, SF)
    sizes = texts.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()
    assert len(sizes) > 4 and max(r.n for r in sizes) < 8_000_000
    called = []
    monkeypatch.setattr(textkit, "_trim", lambda: called.append(1))
    assert list(textkit.trimmed(lambda it: (x + 1 for x in it))([1, 2])) == [2, 3] and called == [1]
