"""Tables on storage that all machines share: where plans are cut, and where indexes lie unless a path is given."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions of one machine that name no checkpoint folder, such as those of tests.
FALLBACK_DIR = "/tmp/checkpoints/waymark"


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder below spark.checkpoint.dir. A cluster must name that; a session of one machine falls back to FALLBACK_DIR."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = FALLBACK_DIR
    return f"{named.rstrip('/')}/waymark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table on shared storage: later reads survive lost executors and never repeat the work."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_questions(rows: DataFrame, asks: dict[str, str], by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(members, asked): by and question of every row, and each different question once, a written table of question (a number) and the columns asks, renamed."""
    asked = written(rows.select(*(F.col(c).alias(n) for c, n in asks.items())).dropDuplicates().withColumn("question", F.monotonically_increasing_id()), "questions")
    same = functools.reduce(Column.__and__, (rows[c].eqNullSafe(asked[n]) for c, n in asks.items()))
    return rows.join(asked, same).select(*by, "question"), asked


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Moves a folder in place of another, which goes first."""
    jvm = spark.sparkContext._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"{old} could not be renamed to {new}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dropped(spark: SparkSession) -> None:
    """Removes every table that this application has written here; results that still read them end with it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
