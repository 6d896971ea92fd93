"""Session helpers: runtime settings, lineage cuts, layout."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job wants; none of them fixes a partition count,
# AQE coalesces or splits from the sizes it sees.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "sitegrid", cpus: str = "*") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master, where that
    setting is absent, gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        if named is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for loops and for tables read whole."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_path(spark: SparkSession) -> str:
    """A new folder's name in the shared folder, for tables that grow."""
    return f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Written columnar table in the shared folder, for wide tables that several
    later steps read by column."""
    path = stage_path(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


class Rounds:
    """Tables of a loop. ``cut`` writes a frame and gives it back as read from disk: the
    planner then knows its true size. (A checkpoint inherits the estimate of its plan, a
    product over all joins, whose digits double every round until planning fills the
    driver's memory.) The files of the round before last are overwritten, so a frame must
    not be used for more than one further round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.path = f"{_shared_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.n % 2}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def spread(df: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """Rows over all cores when the input has fewer splits than cores; inputs of
    cluster size have more and pass through without a shuffle. With ``rows_a_task``
    no task gets more, so that tasks do not grow with a table of few splits; pass
    the table as read, whose rows are counted from its footers."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if rows_a_task:
        n = max(n, -(-df.count() // rows_a_task))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
