"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barspark.llm.common import Scratch

WEIGHTS = (5, 2, 1)
#: Percent of all sizes that the mix holds, and the most of a source's size.
SHARE_PERCENT, MOST_REPEATS = 150, 2
#: Rates are broadcast if they are at most this many, with names of so many bytes in all.
MOST_BROADCAST_SOURCES, MOST_BROADCAST_BYTES = 50_000, 4 << 20
#: Beyond that they are joined, every source's rows in this many parts.
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key's decimal string: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _running(rows: DataFrame, order: Sequence[Column], scratch: Scratch, name: str, **sums: Column) -> DataFrame:
    """``rows`` with sums over all rows before, in an order that no single task holds.

    Rows are range-partitioned and written, so that a part's number is part of
    the data; a window over the parts (as many as shuffle partitions) gives each
    part's start, and a window within parts the rest.
    """
    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    t = scratch.table(ranged.withColumns(sums), name)
    parts = t.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in sums))
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = t.join(F.broadcast(starts), "part")
    out = out.withColumns({c: F.col(f"{c}_start") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    return out.drop("part", *(f"{c}_start" for c in sums))


def source_rates(
    sizes: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """``source, source_size, target, rate`` from rows of ``source, size``, written.

    Sizes are summed by partial aggregation, so a hot source is one row per
    task. Targets by weight stop at ``most_repeats`` times the source's size and
    the excess is reshared by weight: the level ``target / weight`` is found by
    ordering sources by where they stop. There may be as many sources as rows;
    both orders are over range partitions. The driver gets two sums and the level.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    sums = scratch.table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    by_name = [F.col("source").asc_nulls_last()]
    s = (
        _running(sums, by_name, scratch, "by-name", rank=F.lit(1).cast("long"))
        .withColumn("weight", w.cast("double"))
        .withColumn("stop", (F.col("source_size") * most_repeats).cast("double"))
        .withColumn("at", F.col("stop") / F.col("weight"))
    )
    # source i (by stop / weight) is at its stop if the level that i and all after it would share lies at or above it
    s = _running(s, [F.col("at"), F.col("rank")], scratch, "by-stop", stops_before=F.col("stop"), weights_before=F.col("weight"))
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = (whole["size"] or 0) * share_percent / 100.0
    s = s.withColumn("level", (F.lit(total) - F.col("stops_before")) / (F.lit(float(whole["weight"] or 0)) - F.col("weights_before")))
    s = scratch.table(s.withColumn("stops", F.col("level") * F.col("weight") >= F.col("stop")), "levels")
    first = s.where("not stops").agg(F.min(F.struct("at", "rank", "level"))["level"].alias("level")).first()["level"]
    level = F.lit(first).cast("double")
    target = F.when(F.col("stops") | level.isNull(), F.col("stop")).otherwise(level * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = s.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")
    rates = scratch.table(rates, "rates")
    scratch.drop("sums", "by-name", "by-stop", "levels")
    return rates


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    columns: Sequence[str] | None = None,
    seed: int = 17,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """One row per document: ``row`` (its columns), ``size, source_size, target, copies``.

    ``copies`` is floor(rate) plus one if a hash of the id and the seed falls
    below the rate's fraction, so reruns agree and rows with equal ids are
    treated alike. A null or empty text has size 0 (its copies add no words); a
    null source is a source of its own, last in order. Sources without words
    have target 0 and give no copies. Columns of any other names stay untouched
    inside ``row``, which holds those of ``columns`` (default: all). Texts of any
    length are counted whole. An empty table gives no rows.

    Texts are read once if ``row`` does not hold them (the sizes are written),
    else once for the sizes and once for the rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    kept = list(docs.columns if columns is None else columns)
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.col(id_col).alias("id")
    )
    if text_col not in kept:
        sized = scratch.table(sized, "sized")
    rates = source_rates(sized.select("source", "size"), scratch, weights, share_percent, most_repeats)
    few = rates.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("source").cast("string"))).alias("bytes")).first()
    on = F.col("d.source").eqNullSafe(F.col("r.source"))
    if few["n"] <= MOST_BROADCAST_SOURCES and (few["bytes"] or 0) <= MOST_BROADCAST_BYTES:
        rates = F.broadcast(rates)
    else:  # a hot source's rows go to many tasks
        sized = sized.withColumn("salt", F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)))
        rates = rates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = on & (F.col("d.salt") == F.col("r.salt"))
    whole = F.floor("rate")
    extra = (unit_hash(F.col("id"), seed) < F.col("rate") - whole).cast("int")
    return (
        sized.alias("d")
        .join(rates.alias("r"), on)
        .select("row", "size", "source_size", "target", (whole + extra).cast("int").alias("copies"))
    )


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as its copies say.

    A document without words, null or empty, is taken as often as its source's
    rate says, like any other; rows of equal id are taken equally often; columns
    may have any names and types; an empty table gives no rows.
    """
    names = docs.columns
    return (
        mix_sources(docs, **options)
        .where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select(*(F.col("row")[n].alias(n) for n in names))
    )
