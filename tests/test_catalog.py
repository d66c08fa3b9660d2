"""Every catalogue query with a statement gives DuckDB's rows (sf0.001)."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from colweave.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name, tmp_path):
    QUERIES[name](spark, DIR).write.parquet(str(tmp_path / "q"))
    got = duck.sql(f"SELECT * FROM '{tmp_path}/q/*.parquet'").df()
    assert _rows(got) == _rows(duck.sql(ORACLES[name]).df())


def test_changed_files_give_new_rows(spark, tmp_path):
    part = spark.read.parquet(f"{DIR}/part.parquet")
    for n in (30, 60):
        part.where(f"p_partkey < {n}").write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
        assert QUERIES["gap_rank"](spark, str(tmp_path)).count() == 8 * n
        gaps = sum((k + 5 * j) % 29 == 0 for k in range(n) for j in range(8))
        assert QUERIES["gap_select"](spark, str(tmp_path)).count() == 8 * n - gaps


def test_tables_that_are_gone_are_made_again(spark, tmp_path):
    """Somebody empties the shared folder between two queries."""
    spark.read.parquet(f"{DIR}/part.parquet").where("p_partkey < 60").write.parquet(str(tmp_path / "in" / "part.parquet"))
    first = QUERIES["gap_select"](spark, str(tmp_path / "in"))
    want = sorted(map(tuple, first.collect()))
    for folder in {os.path.dirname(f.removeprefix("file://")) for f in first.inputFiles()}:
        shutil.rmtree(folder)
    assert want and sorted(map(tuple, QUERIES["gap_select"](spark, str(tmp_path / "in")).collect())) == want


def test_from_another_folder(tmp_path):
    """Workers get the package though neither their folder nor PYTHONPATH has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from colweave.plans.catalog import QUERIES
spark.read.parquet("{DIR}/part.parquet").where("p_partkey < 40").write.parquet("{tmp_path}/in/part.parquet")
print("rows", QUERIES["block_boundaries"](spark, "{tmp_path}/in").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 40" in out.stdout, out.stderr[-2000:]
