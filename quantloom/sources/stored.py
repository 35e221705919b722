"""Tables in the shared folder: they cut lineage, survive lost executors, and go when the process ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

from quantloom.functions.frames import sessioned
from quantloom.functions.scan import ordinals

#: Paths made in this process and not removed yet; the session that can remove each.
_MADE: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session: what the caller set with setCheckpointDir(), else spark.checkpoint.dir.

    Where the cluster names none, a local session gets a temporary one of its own;
    on a cluster that is an error, as a machine-local folder would be of no use there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    # Spark itself names a folder inside the setting, unless the caller chose another one.
    if at.isDefined() and not (named and at.get().startswith(named.rstrip("/"))):
        named = at.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quantloom-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, to be removed at the end of the process if it isn't before."""
    path = f"{shared_root(spark)}/quantloom/{uuid.uuid4().hex}/{label}"
    _MADE[path] = spark
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quantloom_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder made here."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.pop(path, None)


@atexit.register
def _sweep() -> None:
    """Remove what is left: results are lazy frames over these tables, so nobody else knows when they are done with."""
    for path, spark in list(_MADE.items()):
        with suppress(Exception):  # the JVM may be gone, and its folder with it
            remove(spark, path)


def laid_out(panel: DataFrame, buckets: int | None = None) -> DataFrame:
    """A clean panel written once: bucketed by asset, sorted by session, with the ordinal of each date in `session`.

    Operators that find the ordinal there need no list of dates, and those that go along an
    asset's sessions no shuffle. It is a table of the session's warehouse, dropped with the
    process; what is known of the panel (trusted(), crowd()) stays known.
    """
    spark = panel.sparkSession
    name = f"quantloom_panel_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt as the buckets are, so that every task writes one file.
    rows = panel.join(ordinals(panel), "date").withColumnRenamed("idx", "session").repartition(n, "asset")
    rows.write.bucketBy(n, "asset").sortBy("asset", "session").saveAsTable(name)
    _TABLES[name] = spark
    out = sessioned(spark.table(name))
    for fact in ("_quantloom_facts", "_quantloom_crowds"):
        if hasattr(panel, fact):
            setattr(out, fact, getattr(panel, fact))
    return out


#: Tables made in this process; the session that can drop each.
_TABLES: dict[str, SparkSession] = {}


@atexit.register
def _drop() -> None:
    for name, spark in list(_TABLES.items()):
        with suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


