"""Session helpers: table access, and tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, which only a session of one machine may use."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="sealwork-")
    spark.conf.set("spark.checkpoint.dir", f"file://{local}")
    return f"file://{local}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is then the cluster's to clean
        pass


def _clean() -> None:
    for spark, root in _ROOTS:
        _delete(spark, root)


class Scratch:
    """Intermediate tables of one operator run, as parquet in the shared folder.

    A written table survives the loss of executors and cuts the plan, so iterative operators keep short lineage.
    drop() removes a table no later step reads; what the lazy result still reads goes when Python exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sealwork-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}
        if not _ROOTS:
            atexit.register(_clean)
        _ROOTS.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._sealwork_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_sealwork_path", None)
            if path:
                _delete(self.spark, path)


def micros(col: str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp that means UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def iso_micros(col: Column) -> Column:
    """Microseconds since 1970 UTC of ISO text; text without a zone means UTC; unreadable text gives null."""
    t = F.trim(col)
    zoned = F.when(t.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$") & t.contains(":"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))
