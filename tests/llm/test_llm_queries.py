"""Registered training-data queries on the smallest tables, next to their check SQL, and the pipeline's stages."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from tallymill.llm.queries import ORACLES, QUERIES  # noqa: E402
from tools.verify import check  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    table = "pages" if name.startswith(("op2_", "op10_")) else "documents"
    if name.startswith("op12_"):
        assert len(got) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    elif not name.startswith(("op9_", "op11_")):
        assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for each in (table, "benchmark"):
            con.execute(f"CREATE VIEW {each} AS SELECT * FROM '{SF}/{each}.parquet'")
        cur = con.execute(ORACLES[name])
        assert check((df.columns, got), ([d[0] for d in cur.description], cur.fetchall())) is None


def test_entry_has_all_operators():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and 0 < docs.count() <= before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "source_mixing"]
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
