"""Queries pN_ of the problems of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import mixing, percentiles, spans, tokens
from treeline.operators import heavy_keys

SHARES = (0.5, 0.9, 0.99)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "entries").filter("type = 'FILE' and gid is not null")
    medians = percentiles.percentile_buckets(percentiles.sketch(rows, ["gid"], "size"), ["gid"], [0.5])
    return medians.filter(percentiles.at_least(F.col("b0"), 1_048_576)).select("gid")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each gid and uid, from sketches of the days of walks added together."""
    keys = ["key_name", "key_value"]
    rows = read(spark, d, "entries").select(
        F.to_date("walked_at").alias("day"),
        F.explode(F.array(F.struct(F.lit("gid").alias("key_name"), F.col("gid").alias("key_value")), F.struct(F.lit("uid").alias("key_name"), F.col("uid").alias("key_value")))).alias("k"), "size"
    )
    daily = percentiles.sketch(rows.select("k.*", "day", "size").filter("key_value is not null"), [*keys, "day"], "size")
    counts = percentiles.merge([daily], keys)
    found = percentiles.percentiles(counts, keys, SHARES)
    return found.select(*keys, "n", *[F.round(f"p{i}").cast("long").alias(f"p{round(100 * p)}") for i, p in enumerate(SHARES)])


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of each gid, and whether those of the sketch are within the promised error of them."""
    rows = read(spark, d, "entries").filter("gid is not null and size is not null").select("gid", "size")
    ranked = heavy_keys.running_totals(rows, ["gid"], ["size"], "size").select("gid", "size", "row_no")
    found = percentiles.percentiles(percentiles.sketch(rows, ["gid"], "size"), ["gid"], SHARES)
    want = found.select("gid", F.posexplode(F.array(*[F.struct(F.lit(round(100 * p)).alias("percent"), F.expr(f"(n * {round(p * 100)} + 99) div 100").alias("row_no"), F.col(f"p{i}").alias("p")) for i, p in enumerate(SHARES)])).alias("i", "w"))
    exact = want.select("gid", "w.*").join(ranked, ["gid", "row_no"])
    near = F.abs(F.col("p") - F.col("size")) <= F.col("size") * (percentiles.relative_error() + 1e-12)
    return exact.select("gid", "percent", "size", near.alias("within"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document's length in characters after encoding and decoding, and whether it is its text again."""
    docs = read(spark, d, "documents")
    back = tokens.decode_corpus(tokens.encode_corpus(docs, "doc_id", "text"), "doc_id").withColumnRenamed("text", "decoded")
    both = docs.select("doc_id", "text").join(back, "doc_id")
    return both.select("doc_id", F.length("decoded").cast("long").alias("n_chars"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.document_sizes(read(spark, d, "documents"))
    return sizes, mixing.mix_plan(sizes, read(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixes: an id for each copy, in the order of the collection."""
    return mixing.mixed(mixing.copies(*_plan(spark, d)))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """The mixes with their texts, globally shuffled."""
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    return mixing.mixed(mixing.draw(docs, mixing.draw_rates(*_plan(spark, d))))


def p7_reached(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached shares of each source of each mix, in tokens."""
    sizes, plan = _plan(spark, d)
    return mixing.shares(mixing.copies(sizes, plan), plan)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of each source of each mix, its target share, and whether caps are kept and the tokens drawn are those wanted.

    Those wanted are the share of the mix's total, or as many as the cap allows. Documents are
    whole, so what is drawn is within 1 % of it, and three times the source's largest document.
    """
    sizes, plan = _plan(spark, d)
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    got = mixing.shares(mixing.copies(sizes, plan), plan).join(largest, "source", "left")
    near = F.abs(F.col("tokens") - F.col("want")) <= F.col("want") * 0.01 + 3 * F.coalesce("largest", F.lit(0))
    return got.select(
        "mix_name", "source", F.round("target_share", 9).alias("target_share"), "max_repeats", "source_docs",
        (F.coalesce("most_copies", F.lit(0)) <= F.coalesce("max_repeats", F.lit(2**31 - 1))).alias("cap_kept"), near.alias("as_wanted"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(read(spark, d, "documents"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_amounts(read(spark, d, "documents"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The runs of each document that stand in others, their places counted from 0."""
    return spans.shared_spans(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p5_found, p5_percentiles, p5_bounds, p6_ids, p6_round_trip, p7_mix, p7_documents, p7_reached, p7_shares, p8_found, p8_shared, p8_spans)}

_WINDOWS = """
w as (select doc_id, i, md5(substr(text, i, 400)) as h
  from (select doc_id, text, unnest(range(1, length(text) - 398)) as i from documents where length(text) >= 400)),
n as (select h from w group by h having count(distinct doc_id) > 1)"""

#: The bucket of a positive size: its exponent, and the step of its mantissa, as in percentiles.bucket_of.
_BUCKET = "case when size = 0 then 0 else (e + 1100) * 64 + cast(floor(64 * log2(size / (1::bigint << e))) as bigint) end"

SQL = {
    "p5_found": """
with r as (select gid, size, row_number() over (partition by gid order by size) as i, count(*) over (partition by gid) as n
  from entries where type = 'FILE' and size is not null and gid is not null)
select gid from r where i = (n + 1) // 2 and size >= 1048576""",
    "p5_percentiles": f"""
with k as (select 'gid' as key_name, gid as key_value, size from entries where gid is not null and size is not null
  union all select 'uid', uid, size from entries where uid is not null and size is not null),
x as (select *, case when size > 0 then length(ltrim(cast(size::bit as varchar), '0')) - 1 else 0 end as e from k),
c as (select key_name, key_value, {_BUCKET} as bucket, count(*) as n from x group by all),
r as (select *, sum(n) over (partition by key_name, key_value order by bucket) as upto, sum(n) over (partition by key_name, key_value) as total from c),
q as (select key_name, key_value, cast(any_value(total) as bigint) as n, {", ".join(f"min(bucket) filter (where upto >= (total * {round(p * 1e6)} + 999999) // 1000000) as b{i}" for i, p in enumerate(SHARES))} from r group by all)
select key_name, key_value, n, {", ".join(f"cast(round(case when b{i} = 0 then 0 else pow(2, b{i} / 64.0 - 1100) * {2 * 2 ** (1 / 64) / (1 + 2 ** (1 / 64))!r} end) as bigint) as p{round(100 * p)}" for i, p in enumerate(SHARES))} from q""",
    "p5_bounds": """
with r as (select gid, size, row_number() over (partition by gid order by size) as i, count(*) over (partition by gid) as n
  from entries where size is not null and gid is not null)
select gid, cast(p as integer) as percent, size, true as within from r, (values (50), (90), (99)) v(p) where i = (n * p + 99) // 100""",
    "p6_round_trip": "select doc_id, coalesce(length(text), 0) as n_chars, true as same from documents",
    "p7_shares": """
with t as (select mix_name, source, sum(greatest(coalesce(weight, 0), 0)) as weight, min(max_repeats) as max_repeats from mix_targets
  where mix_name is not null and source is not null group by all),
n as (select source, count(*) as source_docs from documents where source is not null group by 1)
select mix_name, source, round(coalesce(weight / nullif(sum(weight) over (partition by mix_name), 0), 0), 9) as target_share, max_repeats,
  coalesce(source_docs, 0) as source_docs, true as cap_kept, true as as_wanted from t left join n using (source)""",
    "p8_found": f"""
with {_WINDOWS},
s as (select distinct h, doc_id from w where h in (select h from n))
select distinct a.doc_id as doc_a, b.doc_id as doc_b from s a join s b on a.h = b.h and a.doc_id < b.doc_id""",
    "p8_spans": f"""
with {_WINDOWS},
s as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end as fresh from w where h in (select h from n)),
r as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from s)
select doc_id, min(i) - 1 as start, max(i) + 399 as "end" from r group by doc_id, run""",
    "p8_shared": f"""
with {_WINDOWS},
c as (select doc_id, count(*) as shared from (select distinct doc_id, unnest(range(i, i + 400)) as c from w where h in (select h from n)) group by 1)
select doc_id, length(text) as n_chars, coalesce(shared, 0) as shared_chars from documents left join c using (doc_id)""",
}
