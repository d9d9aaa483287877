"""Tables of queries: Parquet or CSV by suffix, read and written whole by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Suffixes of the two formats.
SUFFIXES = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "txt": "csv"}


def format_of(path: str) -> str:
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"neither Parquet nor CSV: {path}")
    return SUFFIXES[suffix]


def read_table(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """CSV has a header, doubled quotes, cells of many lines and texts only; a row that doesn't fit the header ends the job."""
    if format_of(path) == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="FAILFAST", inferSchema=False)


def write_table(df: DataFrame, path: str, sep: str = ";", kind: str | None = None) -> None:
    """A folder of part files: zstd Parquet, or CSV with empty cells for nulls."""
    if (kind or format_of(path)) == "parquet":
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', nullValue="", emptyValue="")
