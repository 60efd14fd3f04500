"""Table scans and written tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run (once for each application)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp()) / "noticeboard_ship.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(out))
        _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a local one where that is unset and all is one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/noticeboard-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and executors may be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `stored` has made and that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def snapshot(df: DataFrame, root: str, version: int) -> str:
    """A table's new version in a folder of its own; readers of older ones aren't disturbed."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def split_valid(df: DataFrame, problem) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a problem (a column that is null for good rows), from one projection."""
    d = df.withColumn("problem", problem)
    return d.filter("problem is null").drop("problem"), d.filter("problem is not null")


def point(df: DataFrame, key: int, column: str = "id") -> DataFrame:
    """S02."""
    return df.filter(F.col(column) == key).limit(1)


def default_source(sources: DataFrame) -> DataFrame:
    """The active source of least id."""
    return sources.filter("is_active").orderBy("id").limit(1)


def appended(df: DataFrame, root: str) -> None:
    """The ledger's sink: new events are appended, nothing is written again; views cut to the newest."""
    df.write.mode("append").parquet(root)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that this application has stored in the shared folder. Results that read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
