"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
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


def present(df: DataFrame) -> bool:
    """Whether the files that a written table is read from are all there."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    folders = {p.getParent().toString(): p for p in paths}
    conf = spark._jsc.hadoopConfiguration()
    # a table is emptied as a whole: one look into each folder
    return bool(paths) and all(p.getFileSystem(conf).exists(p) for p in folders.values())


_WATCHING: list[list[dict]] = []


@contextmanager
def measured() -> Iterator[list[dict]]:
    """What is written meanwhile, as it comes: name, rows, bytes, seconds of each table.

    Rows are observed while they are written, bytes are read off the folder: no further job.
    """
    written: list[dict] = []
    _WATCHING.append(written)
    try:
        yield written
    finally:
        # by identity: two that hear of the same tables are equal
        _WATCHING[:] = [w for w in _WATCHING if w is not written]


def summed(written: list[dict]) -> list[dict]:
    """A row for each name, in the order of their first tables: rounds (tables of that name), rows, bytes, seconds of all."""
    out: dict[str, dict] = {}
    for w in written:
        own = out.setdefault(w["name"], {"name": w["name"], "rounds": 0, "rows": 0, "bytes": 0, "seconds": 0.0})
        own["rounds"] += 1
        for k in ("rows", "bytes", "seconds"):
            own[k] += w[k]
    return list(out.values())


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under ``spark.checkpoint.dir`` and scan it.

    Only a local master does without that setting; its tables go with the process.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: tables between steps need a shared folder")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="colweave-"))
            atexit.register(shutil.rmtree, _LOCAL[0][7:], ignore_errors=True)
        folder = _LOCAL[0]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not _WATCHING:
        df.write.parquet(path)
    else:
        seen, start = Observation(f"written-{uuid.uuid4().hex}"), time.monotonic()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        row = {"name": name, "rows": seen.get["rows"], "bytes": size, "seconds": time.monotonic() - start}
        for written in _WATCHING:
            written.append(dict(row))
    return spark.read.schema(df.schema).parquet(path)
