from pyspark.sql import functions as F

from lociweave.sources import readers, sinks
from lociweave.streaming import ingest


def test_gff_and_fasta(spark, tmp_path):
    (tmp_path / "a.gff").write_text(
        "##gff-version 3\nc1\ts\tgene\t1\t90\t.\t+\t.\tID=g%3B1;Name=x\nc1\ts\tmRNA\t1\t90\t.\t+\t.\tID=t1;Parent=g%3B1,g2;ID=t2\nc1\ts\texon\t1\t9\t.\t+\t.\tID=e\nc1\ts\tCDS\t1\t9\t5.5\t+\t0\tParent=character(0)\n"
    )
    rows = sorted(readers.gff3(spark, str(tmp_path / "a.gff")).collect(), key=lambda r: r.type)
    assert [(r.type, r.ID, r.Parent) for r in rows] == [("CDS", None, None), ("gene", "g;1", None), ("mRNA", "t2", ["g;1", "g2"])]
    (tmp_path / "a.fa").write_text(">s1 A->B > about\nACGT\nAC\n\n>s2\nTT\n")
    seqs = readers.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(map(tuple, seqs.collect())) == [("s1", "ACGTAC"), ("s2", "TT")]
    sinks.write_fasta(seqs, str(tmp_path / "out"))
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "out")).collect())) == [("s1", "ACGTAC"), ("s2", "TT")]
    sinks.write_gff3(readers.gff3(spark, str(tmp_path / "a.gff")).filter("ID is not null"), str(tmp_path / "gff"))
    back = readers.gff3(spark, str(tmp_path / "gff"))
    assert {r.ID for r in back.collect()} == {"g;1", "t2"}


def test_hits_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "hits"
    folder.mkdir()
    line = "1001000001\t1002000002\t99.5\t1\t90\t5\t94\t100\t90\n"
    (folder / "a.tsv").write_text(line + "short\tline\n")
    assert readers.hits(spark, str(folder)).count() == 1
    for _ in range(2):
        ingest.ingest(spark, str(folder), str(tmp_path / "norm"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "norm")).count() == 1
    (folder / "b.tsv").write_text(line)
    ingest.ingest(spark, str(folder), str(tmp_path / "norm"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "norm")).agg(F.sum("dir")).first()[0] == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name,gff,cds\na,a.gff,NA\nb,b.gff,b.fa\n")
    assert sorted((r.name, r.cds) for r in readers.manifest(spark, str(tmp_path / "m.csv")).collect()) == [("a", None), ("b", "b.fa")]
