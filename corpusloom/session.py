"""Session settings and table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only when its measured size stays under this many bytes.
BROADCAST_LIMIT = 24 << 20


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; keyword settings win (dots written as `__`)."""
    b = SparkSession.builder
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    base.update({k.replace("__", "."): v for k, v in conf.items()})
    return b.config(map=base).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder. Timestamps without zone keep their wall clock."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by spark.checkpoint.dir.

    A cluster sets spark.checkpoint.dir to a folder that all executors share. Where that is unset, a session in one
    process, as in tests, gets a folder of its own that ends with it; any other session is an error.
    """
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir")
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not have:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        have = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, have, ignore_errors=True)
    sc.setCheckpointDir(have)
    return have


def materialize(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, so that several later stages read it and a lost executor costs no rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
