"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.tokens import TOKENIZER, count_tokens
from treeline.plans.lineage import cut

#: Classes of the uniform numbers of a source's documents, from which its rate is fitted.
CLASSES = 1024
#: Deviations around a rate beyond which no number of copies is ever drawn: its probability is below a double's least step.
DEVIATIONS = 12
#: Rows of targets up to which the rates are sent to every task.
MOST_SENT = 2_000


def poisson_cuts(rate: float, most: int | None) -> tuple[int, np.ndarray]:
    """The Poisson distribution function from ``base`` on: a uniform number draws ``base`` copies and one for each cut below it.

    What lies below ``base`` or above the last cut has no chance in doubles, so this is the same
    law at every rate, with some 24 times the root of the rate as many cuts. ``most`` caps the copies.
    """
    if rate <= 0:
        return 0, np.zeros(0)
    base = max(0, int(rate - DEVIATIONS * rate**0.5))
    if most is not None and base >= most:
        return most, np.zeros(0)
    k = np.arange(base, int(rate + DEVIATIONS * rate**0.5 + 24))
    logs = k * math.log(rate) - rate - math.lgamma(base + 1) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    cuts = np.cumsum(np.exp(logs))
    cuts = np.minimum(cuts / cuts[-1], 1.0)
    return base, cuts if most is None else cuts[: most - base]


def fit_rate(sizes: np.ndarray, want: float, most: int | None) -> tuple[int, np.ndarray, float]:
    """Least copies, cuts and rate by which a source contributes ``want`` tokens.

    ``sizes`` holds the tokens of documents by class of their uniform number. The rate is set so
    that the documents drawn, not just their expectation, come to ``want``; capping at ``most``
    is part of the fit.
    """
    total = float(sizes.sum())
    if total <= 0 or want <= 0:
        return 0, np.zeros(0), 0.0
    if most is not None and want / total >= most * (1 - 1e-9):
        return most, np.zeros(0), float(most)
    # tokens of documents whose number is at least c/CLASSES
    above = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0.0]])
    at = np.arange(CLASSES + 1) / CLASSES

    def drawn(rate: float) -> float:
        base, cuts = poisson_cuts(rate, most)
        return base * total + float(np.interp(cuts, at, above).sum())

    low, high = 0.0, max(1.0, 2 * want / total)
    while drawn(high) < want and high < 2.0**40:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if drawn(middle) < want else (low, middle)
    return *poisson_cuts(high, most), high


def uniform(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]), 11) * F.lit(2.0**-53)


def document_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, written once, since encoding costs far more than reading it again."""
    rows = docs.filter(F.col(source_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return cut(count_tokens(rows, ["doc_id", "source"], "text", tokenizer))


def mix_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, keep_shares: bool = False) -> DataFrame:
    """For each row of targets the wanted and possible shares, and the tokens to draw.

    A source with no documents, no tokens, no positive weight or a cap of 0 can't contribute;
    the others share ``total_tokens`` by weight, which is what the usable sources hold if not
    given. A source whose cap doesn't allow its share contributes all that it may and falls
    short; the others aren't held back by it, and keep their weights among each other. With
    ``keep_shares`` the total is lowered to where no source falls short, and every share is kept.
    """
    t = (
        targets.filter("mix_name is not null and source is not null")
        .groupBy("mix_name", "source")
        .agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min("max_repeats").alias("max_repeats"))
    )
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    j = t.join(have, "source", "left").fillna(0, ["source_tokens", "source_docs"])
    mix = Window.partitionBy("mix_name")
    usable = (F.col("weight") > 0) & (F.col("source_tokens") > 0) & (F.col("max_repeats").isNull() | (F.col("max_repeats") > 0))
    all_weights, used = F.sum("weight").over(mix), F.sum(F.when(usable, F.col("weight"))).over(mix)
    j = j.withColumns({
        "target_share": F.when(all_weights > 0, F.col("weight") / all_weights).otherwise(0.0),
        "share": F.when(usable, F.col("weight") / used).otherwise(0.0),
    })
    size = F.sum(F.when(F.col("share") > 0, F.col("source_tokens"))).over(mix).cast("double")
    total = size if total_tokens is None else F.lit(float(total_tokens))
    may = F.col("max_repeats") * F.col("source_tokens").cast("double")
    if keep_shares:
        total = F.least(total, F.min(F.when(F.col("share") > 0, may / F.col("share"))).over(mix))
    want = F.coalesce(F.col("share") * total, F.lit(0.0))
    return j.withColumns({"want": F.when(usable, F.least(want, may)).otherwise(0.0), "total": F.coalesce(total, F.lit(0.0))})


def draw_rates(docs_sizes: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``mix_name``, ``source``, ``base``, ``cuts``, ``rate``: by what law each source of a mix is drawn.

    Rates are fitted to counts of tokens by class of the documents' numbers (at most 1024 rows
    for a source of a mix). Written once, a row to a source of a mix.
    """
    small = _few(plan, plan.select("mix_name", "source", "want", "max_repeats").filter("want > 0"))
    classed = docs_sizes.join(small.select("mix_name", "source"), "source").select(
        "mix_name", "source", F.floor(uniform(seed, "mix_name", "doc_id") * CLASSES).cast("int").alias("c"), "n_tokens"
    )
    counts = classed.groupBy("mix_name", "source", "c").agg(F.sum("n_tokens").alias("n")).join(small, ["mix_name", "source"])

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        sizes = np.bincount(g["c"], weights=g["n"], minlength=CLASSES)
        cap = None if pd.isna(g["max_repeats"].iloc[0]) else int(g["max_repeats"].iloc[0])
        base, cuts, rate = fit_rate(sizes, float(g["want"].iloc[0]), cap)
        return pd.DataFrame({"mix_name": [g["mix_name"].iloc[0]], "source": [g["source"].iloc[0]], "base": [base], "cuts": [cuts.tolist()], "rate": [rate]})

    return cut(counts.groupBy("mix_name", "source").applyInPandas(fit, "mix_name string, source string, base long, cuts array<double>, rate double"))


def _few(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a plan, sent to every task if there are few."""
    return F.broadcast(rows) if plan.count() <= MOST_SENT else rows


def draw(rows: DataFrame, rates: DataFrame, seed: int = 42) -> DataFrame:
    """``rows`` (with ``doc_id``, ``source``) with ``mix_name`` and ``copies`` for each mix that uses them at least once.

    Each document's number of copies inverts the Poisson distribution at a number hashed from
    seed, mix and document, so it doesn't depend on partitions or retries, and a heavy source
    is no more work for a task than any rows. Rows stay where they are.
    """
    drawn = rows.join(_few(rates, rates.select("mix_name", "source", "base", "cuts")), "source").withColumn("u", uniform(seed, "mix_name", "doc_id"))
    # the place of the number among the cuts; without a lambda, whose outer columns the optimizer overlooks when it moves filters
    k = F.col("base") + F.array_position(F.sort_array(F.concat("cuts", F.array("u"))), F.col("u")) - 1
    return drawn.withColumn("copies", k.cast("int")).filter("copies > 0").select("mix_name", *rows.columns, "copies")


def copies(docs_sizes: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``mix_name``, ``source``, ``doc_id``, ``n_tokens``, ``copies`` of the documents used at least once."""
    return draw(docs_sizes, draw_rates(docs_sizes, plan, seed), seed).select("mix_name", "source", "doc_id", "n_tokens", "copies")


def mixed(drawn: DataFrame, seed: int = 42) -> DataFrame:
    """One row for each copy in a global random order: ``place`` is the sort key of the order, rows of a partition follow it.

    Whatever columns ``drawn`` has come along: of :func:`copies` ids and sizes, of :func:`draw` on
    the documents themselves their texts, which are shuffled once, as many times as they are used.
    """
    rows = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    placed = rows.withColumn("place", F.xxhash64(F.lit(seed + 1), "mix_name", "doc_id", "copy_no"))
    return placed.repartition("place").sortWithinPartitions("place")


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """For each row of targets the target share, the share of tokens reached, and how often documents are used."""
    got = drawn.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").cast("long").alias("copies"),
        F.count(F.lit(1)).alias("docs_used"), F.max("copies").alias("most_copies"),
    )
    j = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "copies", "docs_used", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return j.select(
        "mix_name", "source", "target_share", F.col("share").alias("possible_share"), F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"),
        "want", "tokens", "copies", "docs_used", "most_copies", "max_repeats", "source_docs", "source_tokens",
    )
