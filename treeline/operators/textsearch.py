"""Lines of files that match a pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.patterns import basic_regex


def grep(df: DataFrame, pattern: str, content: str = "content", *, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """``name``, ``line_no`` (from 1), ``line`` of matching lines of text columns; a last empty line isn't a line."""
    c = F.col(content)
    body = F.when(F.endswith(c, F.lit("\n")), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    rows = df.filter(c.isNotNull() & (c != "")).select("name", F.posexplode(F.split(body, "\n", -1)).alias("i", "line"))
    hit = F.col("line").rlike(("(?i)" if ignore_case else "") + basic_regex(pattern))
    return rows.filter(~hit if invert else hit).select("name", (F.col("i") + 1).alias("line_no"), "line")


def grep_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``name``, ``line`` of matching lines of all files below a folder, read in splits."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("line"))
    return lines.filter(F.col("line").rlike(basic_regex(pattern)))
