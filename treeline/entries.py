"""The entry table: one row for an item of a tree, and adapters that make one from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.paths import depth

TIMES = ("atime", "mtime", "ctime")
DETAIL = ("mode", "uid", "gid", *[c for t in TIMES for c in (t, f"{t}_nsec")], "size")
SCHEMA = T.StructType(
    [T.StructField("name", T.StringType(), False), T.StructField("depth", T.IntegerType()), T.StructField("type", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in DETAIL]
)


def conform(df: DataFrame) -> DataFrame:
    """The entry columns of ``df`` in order and type; missing ones are null, a missing or null depth is counted."""
    out = []
    for f in SCHEMA:
        if f.name in df.columns:
            c: Column = F.col(f.name)
        else:
            c = F.lit(None)
        if f.name == "depth":
            c = F.coalesce(c.cast("int"), depth("name"))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def lite(df: DataFrame) -> DataFrame:
    """Names and types only; the detail columns are null."""
    return conform(df.select("name", "depth", "type"))


def has_detail(df: DataFrame) -> bool:
    """Whether any row has detail; looks at one row that has."""
    return not df.filter("mode is not null").limit(1).isEmpty()


def with_name(df: DataFrame, name: Column) -> DataFrame:
    """Entries renamed; the depth follows."""
    return df.withColumn("name", name).withColumn("depth", depth("name"))


def append(df: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all lists, repeated ones kept."""
    for other in others:
        df = df.unionByName(other)
    return df


def entry_rows(spark: SparkSession, rows: list[dict], uid: int = 0, gid: int = 0) -> DataFrame:
    """A list from literal rows; a missing owner is the given one, other missing fields are null."""
    full = [tuple({"uid": uid, "gid": gid, **r}.get(f.name) for f in SCHEMA) for r in rows]
    return conform(spark.createDataFrame(full, SCHEMA))


def orders_as_entries(orders: DataFrame) -> DataFrame:
    """Orders as files ``/data/<priority>/<status>/o_<key>``."""
    t = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    name = F.concat(F.lit("/data/"), "o_orderpriority", F.lit("/"), "o_orderstatus", F.lit("/o_"), F.col("o_orderkey").cast("string"))
    key = F.col("o_orderkey")
    kind = F.when(key % 11 == 0, F.lit("DIR")).when(key % 13 == 0, F.lit("LINK")).otherwise(F.lit("FILE"))
    bits = F.when(key % 11 == 0, F.lit(0o040000)).when(key % 13 == 0, F.lit(0o120000)).otherwise(F.lit(0o100000))
    return conform(
        orders.select(
            name.alias("name"), kind.alias("type"), (bits + key % 512).alias("mode"), F.col("o_custkey").alias("uid"), (key % 7).alias("gid"),
            *[x for i, c in enumerate(TIMES) for x in ((t + i * 3600).alias(c), (key % 1000).alias(f"{c}_nsec"))],
            F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
        )
    )


def documents_as_entries(docs: DataFrame) -> DataFrame:
    """Documents as files ``/corpus/<source>/<lang>/<id>`` with their ``content``."""
    part = lambda c: F.coalesce(F.col(c), F.lit("none"))
    name = F.concat(F.lit("/corpus/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select(name.alias("name"), F.lit("FILE").alias("type"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))
