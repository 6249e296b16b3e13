from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def same_rows(spark, queries, oracles, name, data=DATA):
    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(oracles[name])
    columns = [d[0] for d in got.description]
    ours = queries[name](spark, str(data))
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(str([plain(r[c]) for c in columns]) for r in ours.collect()) == sorted(str([plain(x) for x in r]) for r in got.fetchall())


def catalog_names():
    from vectorloom.plans.catalog import ORACLES

    return sorted(ORACLES)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", catalog_names())
def test_against_sql(spark, name):
    from vectorloom.plans import catalog

    same_rows(spark, catalog.QUERIES, catalog.ORACLES, name)


ODD = [None, [], [None], [0.0] * 64, [3.0, None, 4.0, *[0.0] * 61], [float("nan"), 1.0], [float("-inf"), -1.0, 0.5], [1e30, -1e-20, -1e30], [0.8, -2e-7, 0.6, -0.0], [0.6, -0.8] * 32, [1e-42, -1e-42], [0.103515625, -0.166015625, 0.005859375, 3.4e38, 16777217.0]]


def odd_vectors(at):
    """Missing, empty, zero and unending vectors, and components that round to zero from below."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": pa.array(range(len(ODD)), pa.int64()), "embedding": pa.array(ODD, pa.list_(pa.float32())), "label": pa.array([0] * len(ODD), pa.int32())}), at / "embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["l2_normalize", "matryoshka", "plain_text_sink"])
def test_odd_vectors_against_sql(spark, tmp_path, name):
    from vectorloom.plans import catalog

    same_rows(spark, catalog.QUERIES, catalog.ORACLES, name, odd_vectors(tmp_path))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_folder(tmp_path):
    for p in ROOT.rglob("*.py"):
        at = p.relative_to(ROOT)
        if "llm" not in at.parts and at.name != "corpus_pipeline.py" and at.parts[0] != "tests":
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_bytes(p.read_bytes())
    (tmp_path / "vectorloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_whole_documents_are_requests(spark):
    """Requests hold whole texts, and each document with words is answered with a vector."""
    from pyspark.sql import functions as F

    from vectorloom.plans import catalog

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    sent = catalog._bodies(spark, str(DATA)).where("request_id % 8 = 0").select("request_id", F.get_json_object("body", "$.input").alias("sent"))
    assert sent.join(d, F.col("request_id") == F.col("doc_id")).where("NOT sent <=> text").count() == 0
    few = d.orderBy("doc_id").limit(16)
    few.write.parquet(at := tempfile.mkdtemp() + "/documents.parquet")
    there = {r.doc_id for r in few.where("length(text) > 0").collect()}
    served = catalog.QUERIES["serve_embeddings"](spark, os.path.dirname(at)).collect()
    assert {r.request_id for r in served if r.status == 200} == there and len(there) > 8
    assert {r.doc_id for r in catalog.QUERIES["embed_documents"](spark, os.path.dirname(at)).where("embedding IS NOT NULL").collect()} >= there
