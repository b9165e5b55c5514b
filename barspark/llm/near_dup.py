"""Near-duplicate components by fast similarity sketching.

Plan, for N documents of which C lie in a bucket with another one:

1. one pass over the texts makes the shingle set, its 128-bit digest, the
   sketch, its band keys and a one-bit-per-coordinate summary;
2. equal sets collapse to classes (a partial aggregate, so a third of all rows
   being copies costs one row per task);
3. band keys are grouped (partial aggregate); members of buckets with two
   classes or more are kept, and only their texts are fetched;
4. rounds of star checks: every member of a bucket is checked against one
   centre of it, linear in the bucket's size; links contract to components;
5. what is left are buckets that still hold several components. Their pairs
   across components (never those within one) are checked when set sizes, bit
   summaries and sets of 32-bit hashes allow a link; nothing is capped;
6. every check recomputes both full shingle sets from the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.common import Scratch, slices
from barspark.llm.components import connected_components
from barspark.llm.sketch import SHINGLE, band_keys, overlap, shingle_set, sketch

BANDS, ROWS, BITS = 56, 6, 512
THRESHOLD = 75
#: Standard deviations by which the differing bits may exceed their mean; more has
#: a probability below 1e-8.
DEVIATIONS = 6
STAR_ROUNDS = 6
#: Star rounds end once the pairs across components are at most this many a row, and this many beside.
CROSS_A_ROW, CROSS_FREE = 16, 200_000

_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bits array<long>, keys array<long>"


def _sign(size: int, bands: int, rows: int):
    t = max(BITS, bands * rows)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]
        + [("bits", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: dict[str, list] = {f.name: [] for f in schema}
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                cols["n_shingles"].append(len(s))
                if not len(s):
                    for c in ("h1", "h2", "bits", "keys"):
                        cols[c].append(None)
                    continue
                h = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                c = sketch(s, t)
                cols["h1"].append(int(h[0]))
                cols["h2"].append(int(h[1]))
                cols["bits"].append(np.packbits((c[:BITS] & np.uint64(1)).astype(np.uint8)).view(np.int64))
                cols["keys"].append(band_keys(c, bands, rows))
            cols["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := cols[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema
            )

    return run


def _confirm(size: int, threshold: int):
    """Keep the pairs whose full sets are similar; ``u`` comes in runs."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in slices(batches):
            us, vs = [], []
            for u, v, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last_set is None or a != last_text:
                    last_text, last_set = a, shingle_set(a, size)
                s = shingle_set(b, size)
                both = overlap(last_set, s)
                if 100 * both >= threshold * (len(last_set) + len(s) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    return run


def _with_short_hashes(size: int):
    """Add the shingle set's upper 32 bits to each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # sorted sets stay sorted, so equal upper halves lie side by side
            short = [np.unique((shingle_set(x, size) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(short, pa.list_(pa.int32()))], names=["rep", "text", "short"])

    return run


def _short_sets_link(threshold: int):
    """The 32-bit sets of two sides (m_, c_) allow a link.

    A bound, not a guess: of the shingles in both, at most as many vanish in the
    shorter hashes as those of the m side lost by meeting each other there.
    """
    both = F.size(F.array_intersect("m_short", "c_short")) + F.col("m_n") - F.size("m_short")
    return 100 * both >= threshold * (F.col("m_n") + F.col("c_n") - both)


def most_different(threshold: int) -> int:
    """Bits of ``BITS`` that may differ in a link: a coordinate's differ with probability (1 - similarity) / 2.

    At similarity 0.75 64 +- 7.5 differ, and 108 may.
    """
    p = (100 - threshold) / 200
    return int(BITS * p + DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def _may_link(threshold: int):
    """Set sizes and bit summaries of two sides (m_, c_) allow a link."""
    different = sum((F.bit_count(F.col("m_bits")[i].bitwiseXOR(F.col("c_bits")[i])) for i in range(1, BITS // 64)),
                    F.bit_count(F.col("m_bits")[0].bitwiseXOR(F.col("c_bits")[0])))
    small, large = F.least("m_n", "c_n"), F.greatest("m_n", "c_n")
    return (100 * small >= threshold * large) & (different <= most_different(threshold))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked when ``100 * |A & B| >= threshold * |A | B|`` on
    their sets of distinct ``shingle``-word shingles (A-Z lower-cased); a
    component is what links reach, named by its smallest ``doc_id``. A link at
    the threshold t (as a share) is missed by the banding with probability
    ``(1 - t**rows)**bands`` (2e-5 by default), more similar ones with less;
    lower thresholds need more bands of fewer rows.

    Null or empty texts, or texts of white space only, have no shingles and are
    their own component. Rows with equal ``doc_id`` are one node. A row with a
    null ``doc_id`` takes no part: its ``component_id`` is null and it is kept.
    Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.table(own.mapInArrow(_sign(shingle, bands, rows), _SIGNED), "signed")

    usable = signed.where("doc_id is not null and h1 is not null")
    classes = scratch.table(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    first = (
        usable.join(classes.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("rep"), "h1", "h2", "n_shingles", "bits", "keys")
    )
    keyed = first.select(F.explode("keys").alias("key"), "rep")
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre <> last")
    members = scratch.table(keyed.join(buckets.select("key", "centre"), "key").distinct(), "members")
    nodes = scratch.table(members.select("rep").distinct(), "nodes")
    info = scratch.table(
        first.join(nodes, "rep", "left_semi").select("rep", F.col("n_shingles").alias("n"), "bits").distinct(), "info"
    )
    found = own.join(nodes.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").where("text is not null")
    texts = scratch.table(
        found.select(F.col("doc_id").alias("rep"), "text").mapInArrow(
            _with_short_hashes(shingle), "rep long, text string, short array<int>"
        ),
        "texts",
    )
    comp = _link(scratch, members, nodes, info, texts, shingle, threshold)

    # classes get their component among themselves, so that only one join has a row per document
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("comp", "rep").alias("component_id"))
    shingled = signed.where("h1 is not null").select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    empty = signed.where("h1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))  # these meet nothing
    out = (
        shingled.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
        .union(empty)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    out = scratch.table(out, "out")
    scratch.drop_all_but("out")
    return out


def _link(
    scratch: Scratch,
    members: DataFrame,
    nodes: DataFrame,
    info: DataFrame,
    texts: DataFrame,
    shingle: int,
    threshold: int,
) -> DataFrame:
    """Components of the nodes: ``(node, comp)`` for those with a link."""
    side = lambda p: info.select(F.col("rep").alias(f"{p}_rep"), F.col("n").alias(f"{p}_n"), F.col("bits").alias(f"{p}_bits"))

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """Distinct pairs ``u < v`` that full sets confirm, written."""
        pairs = scratch.table(pairs, f"{name}-pairs")
        rows = (
            pairs.join(texts.select(F.col("rep").alias("v"), F.col("text").alias("b")), "v")
            .join(texts.select(F.col("rep").alias("u"), F.col("text").alias("a")), "u")
            .select("u", "v", "a", "b")
        )
        links = scratch.table(rows.mapInArrow(_confirm(shingle, threshold), "u long, v long"), f"{name}-links")
        scratch.drop(f"{name}-pairs")
        return links

    def merge(comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
        c = lambda p: comp.select(F.col("node").alias(p), F.col("comp").alias(f"c{p}"))
        between = links.join(c("u"), "u").join(c("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        found = connected_components(between, scratch, f"{name}-cc")
        return scratch.table(
            comp.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select(
                "node", F.coalesce("to", "comp").alias("comp")
            ),
            f"{name}-comp",
        )

    comp = nodes.select(F.col("rep").alias("node"), F.col("rep").alias("comp"))
    to_star, before = members, None
    for k in range(STAR_ROUNDS):
        # one centre for each member and round: a round's checks are linear in its members
        pick = F.min("centre") if not k else F.min_by("centre", F.xxhash64("centre", F.lit(k - 1)))
        star = (
            to_star.where("rep <> centre")
            .groupBy("rep")
            .agg(pick.alias("centre"))
            .select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v"))
            .distinct()
        )
        allowed = (
            star.join(side("m").withColumnRenamed("m_rep", "u"), "u")
            .join(side("c").withColumnRenamed("c_rep", "v"), "v")
            .where(_may_link(threshold))
            .select("u", "v")
        )
        comp = merge(comp, confirm(allowed, f"star{k}"), f"star{k}")
        labelled = members.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep")
        mixed = labelled.groupBy("key").agg(
            F.min("comp").alias("lo"),
            F.max("comp").alias("hi"),
            F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias("centre"),
            F.count(F.lit(1)).alias("size"),
        ).where("lo <> hi")
        parts = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("part"))
        # all members of mixed buckets: the last join needs each of them
        open_rows = scratch.table(labelled.join(mixed.select("key", "centre"), "key"), f"open{k}")
        if k:
            scratch.drop(f"open{k - 1}")
        size = parts.join(mixed.select("key", "size"), "key").agg(
            F.sum(F.col("part") * (F.col("size") - F.col("part"))).alias("cross"), F.sum("part").alias("rows")
        ).first()
        cross, rows = size["cross"] or 0, size["rows"] or 0
        if cross <= CROSS_A_ROW * rows + CROSS_FREE or before is not None and cross > 0.8 * before:
            break
        before = cross
        centre = comp.select(F.col("node").alias("centre"), F.col("comp").alias("centre_comp"))
        to_star = open_rows.join(centre, "centre").where("comp <> centre_comp").select("key", "rep", "comp", "centre")

    rest = open_rows.select("key", "rep", "comp").join(info, "rep").join(texts.select("rep", "short"), "rep")
    half = lambda p: rest.select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("rep", "comp", "n", "bits", "short")))
    a, b = half("m"), half("c")
    apart = F.expr("m_rep < c_rep and m_comp <> c_comp")
    cross = (
        a.join(b, (a["key"] == b["key"]) & apart & _may_link(threshold) & _short_sets_link(threshold))
        .select(F.col("m_rep").alias("u"), F.col("c_rep").alias("v"))
        .distinct()
    )
    comp = merge(comp, confirm(cross, "cross"), "final")
    return comp
