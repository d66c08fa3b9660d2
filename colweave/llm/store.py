"""Where intermediate tables live, and how they are written.

Everything goes to the folder that the cluster names in ``spark.checkpoint.dir``; without
that setting a local folder serves a local master, and any other master raises.  A table
written there cuts lineage and survives lost executors.  Tables stay as long as results may be
read from them: who starts a query empties the folder; the local one goes with the process.
"""

from __future__ import annotations

import atexit
import gc
import itertools
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: tables between steps need a shared folder")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="colweave-"))
            atexit.register(shutil.rmtree, _LOCAL[0][7:], ignore_errors=True)
        folder = _LOCAL[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, where neither their path nor their folder is sure to have it."""
    root = Path(__file__).resolve().parent.parent.parent
    known = {os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))}
    app = spark.sparkContext.applicationId
    if str(root) in known or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='colweave-')}/colweave", "zip", root, "colweave")
    spark.sparkContext.addPyFile(archive)


#: Written tables after which the driver gives up what the steps before them left.
TABLES = 4
_written = itertools.count(1)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if next(_written) % TABLES == 0:
        collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver give up plans, compiled code and broadcasts of finished steps, and executors the shuffles that went with them."""
    gc.collect()  # Python's handles of them refer to themselves, and hold them until then
    spark.sparkContext._jvm.System.gc()


def heavy_join(rows: DataFrame, values: DataFrame, key: str, weight: str, share: float = 0.001, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``values`` (one row a key, with ``weight``, the rows that have it; dropped), keys of any size.

    A key of over ``share`` of all rows would be one task's: there are at most 1 / share such
    keys, and they are broadcast.  The rest meet by a shuffle; without such keys all do.
    ``values`` is a written table.
    """
    total = (values.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    hot = F.col(weight) > max(total * share, 1)
    if values.where(hot).isEmpty():
        return rows.join(values.drop(weight).hint("merge"), key)
    few = values.where(hot).drop(weight).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(few.select(key, "__hot")), key, "left")
    first = rows.join(F.broadcast(few.drop("__hot")), key)
    rest = marked.where("__hot IS NULL").drop("__hot").join(values.where(~hot).drop(weight).hint("merge"), key)
    return first.unionByName(rest.select(first.columns))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
