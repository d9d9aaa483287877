"""Where the operators cut lineage: written tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions of one machine that name no checkpoint folder, such as those of tests.
FALLBACK_DIR = "/tmp/checkpoints/waymark"
#: What a Python step gets at a time, at most: rows, and bytes unless one row has more.
BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; set to FALLBACK_DIR where a session of one machine has none. A cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = FALLBACK_DIR
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that nobody else writes to."""
    return f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: With it a write's shuffle files go when it ends; otherwise they lie on all disks until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table on shared storage: later reads survive lost executors and never repeat the work. The shuffle files of the write are removed."""
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names with as many underscores before them as keep them apart from df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def dropped(spark: SparkSession) -> None:
    """Removes every table that this application has written; results that still read them end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Python steps get BATCH_ROWS rows and BATCH_BYTES bytes at a time at most: with whole texts in them, the usual ten thousand rows are much memory on both sides."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None) or ""
        if not (now.isdecimal() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
