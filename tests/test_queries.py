import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def tidy(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    rows = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert tidy([tuple(r) for r in df.collect()], df.columns) == tidy(rows.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_simulated_reads_cover_all_barcodes(spark):
    for sf in (SF, SF.replace("0.001", "0.1")):
        reads = catalog.simulate_reads(spark, sf).groupBy("barcode_id").count().collect()
        assert {r["barcode_id"] for r in reads} == {r["barcode_id"] for r in catalog.barcodes(spark, sf).collect()}


def test_top_two_has_the_second_best(spark):
    df = catalog.QUERIES["top2_assignment"](spark, SF)
    assert df.columns == ["read_id", "barcode1", "distance1", "barcode2", "distance2"]
    assert df.where("barcode2 is null or barcode2 = barcode1 or distance2 < distance1").count() == 0
