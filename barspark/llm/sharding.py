"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

The key of a row is 120 bits in 10 digits of 12: five from a hash of the text,
five from a hash of the id. Equal texts are therefore neighbours. Bytes below
candidate boundaries are counted exactly, level by level: each level's probes
are the 4096 equal parts of the part that still holds a splitter, so a level
costs one partial aggregate of at most 7 x 4096 sums. When all splitters are
within tolerance the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barspark.llm.common import Scratch

DIGIT_BITS, DIGITS = 12, 5
#: Distance of a splitter from its ideal place, as part of a shard's bytes: where
#: probing stops; and where a group of equal texts may stay whole.
TOLERANCE, GROUP_TOLERANCE = 0.0005, 0.01
BIN_BITS = 8


def _hash60(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 4)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns), ``size``, ``crc`` and the key's halves ``k1, k2``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        _hash60(text, F.lit(1)).alias("k1"),
        _hash60(F.col(id_col), F.lit(2)).alias("k2"),
    )


def find_splitters(
    keys: DataFrame, shards: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE
) -> list[tuple[int, int]]:
    """Least keys ``(k1, k2)`` of shards 1 and up, from rows of ``k1, k2, size``.

    The driver gets at most ``(shards - 1) * 4096`` sums a level, and at most ten
    levels are needed however many rows there are.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    ideal = total / shards
    most = 1 << (DIGIT_BITS * DIGITS)
    found: dict[int, tuple[int, int]] = {}
    # splitter -> digits known so far as one number, and exact bytes below them
    probing = {j: (0, 0) for j in range(1, shards)}
    for level in range(2 * DIGITS):
        if not probing:
            break
        if level < DIGITS:
            prefix = F.shiftright("k1", DIGIT_BITS * (DIGITS - level)) if level else F.lit(0).cast("long")
            digit = F.shiftright("k1", DIGIT_BITS * (DIGITS - level - 1)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            inside, key = prefix.isin([p for p, _ in probing.values()]), [prefix.alias("p1"), F.lit(0).cast("long").alias("p2")]
        else:
            left = DIGIT_BITS * (2 * DIGITS - level)
            prefix = F.shiftright("k2", left) if level > DIGITS else F.lit(0).cast("long")
            digit = F.shiftright("k2", left - DIGIT_BITS).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            inside = F.lit(False)
            for a, b in {p for p, _ in probing.values()}:
                inside = inside | ((F.col("k1") == a) & (prefix == b))
            key = [F.col("k1").alias("p1"), prefix.alias("p2")]
        sums = keys.where(inside).groupBy(*key, digit.alias("digit")).agg(F.sum("size").alias("size")).collect()
        by_prefix: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums:
            by_prefix.setdefault((r["p1"], r["p2"]), {})[r["digit"]] = r["size"]
        for j, (p, below) in list(probing.items()):
            want = total * j / shards
            counts = by_prefix.get((p, 0) if level < DIGITS else p, {})
            at, low, high = 0, below, below
            for d in sorted(counts):
                at, low, high = d, high, high + counts[d]
                if high > want:
                    break
            first, after = _boundary(p, at, level), _boundary(p, at + 1, level)
            nearer, distance = (first, want - low) if want - low <= high - want else (after, high - want)
            allowed = (group_tolerance if level == DIGITS - 1 else tolerance) * ideal
            if distance <= allowed or level == 2 * DIGITS - 1:
                found[j] = min(nearer, (most, 0))
                del probing[j]
            elif level < DIGITS - 1:
                probing[j] = ((p << DIGIT_BITS) + at, low)
            elif level == DIGITS - 1:
                probing[j] = (((p << DIGIT_BITS) + at, 0), low)
            else:
                probing[j] = ((p[0], (p[1] << DIGIT_BITS) + at), low)
    return [found[j] for j in sorted(found)]


def _boundary(p, digit: int, level: int) -> tuple[int, int]:
    """Least key of a digit under a prefix."""
    if level < DIGITS:
        return ((p << DIGIT_BITS) + digit) << (DIGIT_BITS * (DIGITS - level - 1)), 0
    k2 = ((p[1] << DIGIT_BITS) + digit) << (DIGIT_BITS * (2 * DIGITS - level - 1))
    return (p[0], k2) if k2 < 1 << (DIGIT_BITS * DIGITS) else (p[0] + 1, 0)


def _shard(splitters: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for a, b in splitters:
        out = out + F.when((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b)), 1).otherwise(0)
    return out.cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``row`` (its columns), ``size, crc, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards hold near equal sums of ``size``, the text's
    UTF-8 bytes (null: none) plus 1. Equal texts share a shard unless a boundary
    would then lie over 1% of a shard from its place; such a group is parted by
    id. Rows equal in text and id (also those with a null id) cannot be told
    apart and stay together; texts of any length count whole; other columns are
    carried in ``row`` and never looked at. Slots
    count from 0 without gaps. Rows are exchanged once, by shard and the key's
    bin (some 65,000 in all), so a shard's sort is not one task's; the broadcast
    slot bases are one row per bin. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = keyed(docs, id_col, text_col)
    keys = scratch.table(rows.select("size", "k1", "k2"), "keys")
    shard = _shard(find_splitters(keys, shards))
    top = lambda k: F.shiftright(k, DIGIT_BITS * DIGITS - BIN_BITS)
    bin_ = (top("k1") * (1 << BIN_BITS) + top("k2")).cast("int")
    counts = scratch.table(
        keys.groupBy(shard.alias("shard"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bins"
    )
    before = W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    within = W.partitionBy("shard", "bin").orderBy("k1", "k2", "crc", "size")
    out = (
        rows.withColumns({"shard": shard, "bin": bin_})
        .withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), ["shard", "bin"])
        .select(
            "row",
            "size",
            "crc",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("place")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
    scratch.drop("keys")
    return out
