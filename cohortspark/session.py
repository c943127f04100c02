"""Session construction and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "cohortspark", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested under.

    On a cluster the caller builds the session; nothing here is required by the operators.
    """
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(os.cpu_count() or 8) if cores == "*" else str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor sees.

    Only where the master is local (tests, one machine) and none is named, a temporary folder is made; on a cluster
    without one an error is raised, as executors could not read what the others write.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cohortspark-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


class Stage:
    """A DataFrame written to the shared folder and read back, so a lost executor costs nothing upstream."""

    def __init__(self, df: DataFrame, name: str = "stage"):
        self._spark = df.sparkSession
        self.path = f"{shared_dir(self._spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.release)

    def release(self) -> None:
        """Delete the files; only once nothing that still has to run reads them."""
        atexit.unregister(self.release)
        try:
            jvm = self._spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(self.path)
            target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
            pass


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage of ``df`` by a written table in the shared folder."""
    return Stage(df, name).df
