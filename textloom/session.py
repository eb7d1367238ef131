"""Session factory and the shared-storage helpers every multi-stage operator uses."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: shuffle files go when the execution that wrote them ends, not when the driver happens to collect its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, app: str = "textloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; ``master`` None keeps the submit-time master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        CLEANUP: "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once, unless they find it by themselves.

    They do where PYTHONPATH names the package's folder, and in local mode where it is the working directory.
    The session is set to delete shuffle files with the execution that wrote them, unless it says otherwise.
    """
    sc = spark.sparkContext
    if CLEANUP not in spark.conf.getAll:
        spark.conf.set(CLEANUP, "true")
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    here = sc.master.startswith("local[") or sc.master == "local"
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or (here and os.getcwd() == root) or getattr(sc, "_textloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._textloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where that is unset, a local one if the master is local, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), "textloom-shared")
    os.makedirs(local, exist_ok=True)
    return "file://" + local


def spread(df: DataFrame) -> DataFrame:
    """``df``, redistributed only if it has fewer partitions than there are cores.

    A table in one small file would otherwise keep a costly Python stage on one
    core; a large table has more splits than cores and is left as it is.  So is
    a plan with exchanges, whose partitions are not known before it runs.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/textloom-" in path:
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Delete every table this application materialized; call it when its results have been written."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}-*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives the loss of any executor, and lets several
    consumers read one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
