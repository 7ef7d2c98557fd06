"""Session helpers: local test session, shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "citegraph") -> SparkSession:
    """Session for tests and benches. On a cluster, build the session yourself."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when nothing is configured and the master is local (tests) do we make
    our own folder; on a cluster a machine-local folder would not survive the
    loss of an executor, so we refuse.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running "
                           "iterative citegraph operators on a cluster")
    folder = tempfile.mkdtemp(prefix="citegraph-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


class RunTables:
    """Tables of one iterative run in the shared checkpoint folder.

    ``put`` writes a frame as Parquet and reads it back. That cuts its lineage, and unlike ``checkpoint()`` (which in
    Spark 4 keeps the original plan for statistics, so size estimates of a loop that joins its own output grow
    without bound) the re-read table has fresh file-based statistics. A table in the shared folder survives the loss
    of an executor. The shuffle files of a written step are released at once, as nothing reads them again: left to the
    collector of the driver, those of all rounds lie on disk together. ``drop`` deletes tables that no later round reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/citegraph-tables"
        self._paths: dict[int, str] = {}
        self._frames: dict[int, DataFrame] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("error").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)  # known, so no job looks for it
        self._paths[id(out)], self._frames[id(out)] = path, out
        return out

    def clear(self) -> None:
        """Deletes all tables that are left."""
        self.drop(*list(self._frames.values()))

    def drop(self, *frames: DataFrame | None) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = self._paths.pop(id(df), None)
            self._frames.pop(id(df), None)
            if path is not None:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """One stored table (see :class:`RunTables`) that nobody drops: for inputs that outlive a run."""
    return RunTables(df.sparkSession).put(df)
