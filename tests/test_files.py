import pytest

from tessera.sources import files


def test_fastq(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a extra\nACGN\r\n+\n@@@@\n@b\tmore\nacg t\n+\nIIII\n@c\nAC\n")
    rows = sorted(tuple(r)[1:] for r in files.read_fastq(spark, f"file://{tmp_path}/x.fastq").collect())
    assert rows == [(0, "a", "ACG"), (1, "b", "ACGT")]


def test_fastq_across_splits(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("".join(f"@r{i} x\nACGT{'A' * (i % 7)}\n+\n@{'I' * 9}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.read_fastq(spark, f"file://{tmp_path}/x.fastq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.read_id, r.name, r.seq) for r in rows) == [(i, f"r{i}", f"ACGT{'A' * (i % 7)}") for i in range(500)]


def test_barcodes(spark, tmp_path):
    (tmp_path / "x.bc").write_text("@a q\nACGT\n@b\nTTTT\n@odd\n")
    path = f"file://{tmp_path}/x.bc"
    assert sorted(map(tuple, files.read_barcodes(spark, path).collect())) == [(0, "a", "ACGT"), (1, "b", "TTTT")]
    with pytest.raises(Exception, match="wrong length"):
        files.read_barcodes(spark, path, 5).collect()


def test_assignment_and_costs(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("read\tbarcode\tdistance\nr1\tb1\t2\nr2;b2;0\nr3\tb3\t1\t\n")
    path = f"file://{tmp_path}/t.tsv"
    assert sorted(map(tuple, files.read_assignment(spark, path).collect())) == [("r1", "b1", 2), ("r2", "b2", 0), ("r3", "b3", 1)]
    (tmp_path / "bad.tsv").write_text("r1\tb1\n")
    with pytest.raises(Exception, match="corrupted"):
        files.read_assignment(spark, f"file://{tmp_path}/bad.tsv", header=False).collect()
    (tmp_path / "c.txt").write_text("A C 2\n- T 3 G _ 4\nA A x\nA A 9\n")
    c = files.read_costs(spark, f"file://{tmp_path}/c.txt")
    assert (c[1], c[22], c[19], c[0]) == (2, 3, 4, 0)


def test_written_assignment(spark, tmp_path):
    calls = spark.createDataFrame([(0, 1, 2), (1, None, None), (2, 0, 9)], "read_id long, barcode1 long, distance1 int")
    reads = spark.createDataFrame([(i, f"r{i}") for i in range(3)], "read_id long, name string")
    barcodes = spark.createDataFrame([(0, "x"), (1, "y")], "barcode_id long, name string")
    files.write_assignment(files.assignment_lines(calls, reads, barcodes, 5).coalesce(1), f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ["read\tbarcode1\tdistance1", "r0\ty\t2\t"]


def test_long_cost_files(spark, tmp_path, monkeypatch):
    (tmp_path / "long.txt").write_text("A C 1\n" + "\n" * 1500 + "A C 7\n")
    path = f"file://{tmp_path}/long.txt"
    assert files.read_costs(spark, path)[1] == 7
    monkeypatch.setattr(files, "COST_LINES", 1000)
    with pytest.raises(ValueError):
        files.read_costs(spark, path)
