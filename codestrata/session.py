"""Session builder with the settings the library is tested with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "codestrata", master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session; on a cluster pass an existing session to the operators instead."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the checkpoint folder and read again, its lineage cut.

    A written table outlives any executor, has statistics that joins are planned
    by, and carries no constraints of the plan that made it, which grow from one
    checkpoint of rows to the next. The folder is the one that the session names in
    ``spark.checkpoint.dir``. A local session that names none gets a temporary one;
    on a cluster, where other machines would not see it, that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codestrata-"))
        folder = context.getCheckpointDir()
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    _spared(context)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables from one collection of the driver's garbage to the next, at least, and the piece of memory that a broadcast takes first.
SPARED, PIECE = 2, "256k"
_since: dict[str, int] = {}


def _spared(context: SparkContext) -> None:
    """Keeps the driver's heap from growing over plans that are done with.

    A long run plans hundreds of tables. Every stage and scan of theirs broadcasts
    a few kB, for which Spark takes a piece of 4 MB unless the session says
    otherwise. These and the plans are garbage once a table is written, but the heap
    would rather grow than collect them; past half of what it may have, it is told to.
    """
    spark, key = context._jsc.sc(), context.applicationId
    if key not in _since:
        spark.conf().setIfMissing("spark.broadcast.blockSize", PIECE)
    _since[key] = _since.get(key, 0) + 1
    runtime = context._jvm.java.lang.Runtime.getRuntime()
    if _since[key] > SPARED and runtime.totalMemory() > runtime.maxMemory() // 2:
        _since[key] = 0
        context._jvm.System.gc()
