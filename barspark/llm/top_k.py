"""Exact top-k inner products: ball trees per shard, branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barspark.llm.common import Scratch

SHARD_ROWS, LEAF_ROWS = 8192, 64
#: Queries of one block, and bytes of its vectors.
BLOCK_QUERIES, BLOCK_BYTES = 2048, 8 << 20
#: All blocks are broadcast up to this many bytes; beyond, they are exchanged.
MOST_BROADCAST_BYTES = 32 << 20
_NONE = np.iinfo(np.int64).min
#: Scores saturate here, so bounds must too.
_LEAST, _MOST = float(np.iinfo(np.int64).min), float(np.iinfo(np.int64).max)
_TREE = "dim int, ids binary, vectors binary, centres binary, radii binary, spans binary"


def build_tree(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and centre, radius and span of each node.

    A span is ``start, end, left, right``; children are -1 at a leaf. A node is
    parted at the median along the line between two far points of it.
    """
    order = np.arange(len(vectors))
    centres, radii, spans = [], [], []
    todo = [(0, len(vectors), -1, 0)]
    x = vectors.astype(np.float64)
    while todo:
        a, b, parent, side = todo.pop()
        own = x[order[a:b]]
        centre = own.mean(axis=0)
        far = ((own - centre) ** 2).sum(axis=1)
        number = len(spans)
        centres.append(centre)
        radii.append(float(np.sqrt(far.max())))
        spans.append([a, b, -1, -1])
        if parent >= 0:
            spans[parent][2 + side] = number
        if b - a > leaf and far.max() > 0:
            one = own[far.argmax()]
            two = own[((own - one) ** 2).sum(axis=1).argmax()]
            by = np.argsort(own @ (two - one), kind="stable")
            order[a:b] = order[a:b][by]
            middle = (a + b) // 2
            todo += [(a, middle, number, 0), (middle, b, number, 1)]
    return order, np.array(centres), np.array(radii), np.array(spans, dtype=np.int64)


class Tree:
    def __init__(self, row: dict):
        d = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, d)
        self.centres = np.frombuffer(row["centres"], np.float64).reshape(-1, d)
        self.radii = np.frombuffer(row["radii"], np.float64)
        self.spans = np.frombuffer(row["spans"], np.int64).reshape(-1, 4)

    def products(self, queries: np.ndarray, a: int, b: int) -> np.ndarray:
        """Exact integer inner products with rows a to b, saturated to 64 bits."""
        own = self.vectors[a:b]
        most = _largest(queries) * _largest(own) * own.shape[1]
        if most < 2**53:
            return (queries.astype(np.float64) @ own.T.astype(np.float64)).astype(np.int64)
        if most < 2**63:
            return queries @ own.T
        exact = queries.astype(object) @ own.T.astype(object)
        return np.clip(exact, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)

    def leaves(self, queries: np.ndarray, kth: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Leaves that some query cannot rule out, and each query's bounds of them.

        Nodes are descended level by level; a child's bound is at most its
        parent's. A node below every query's kth score is cut with its subtree.
        """
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))
        goal = kth.astype(np.float64)
        level, found, bounds = [0], [], []
        above = [np.full(len(q), np.inf)]
        while level:
            raw = q @ self.centres[level].T + norms[:, None] * self.radii[level][None, :]
            # generous against rounding, so that no score can exceed its bound
            raw += 1e-9 * (np.abs(raw) + norms[:, None] * self.radii[level][None, :]) + 1
            np.clip(raw, _LEAST, _MOST, out=raw)
            next_level, next_above = [], []
            for i, node in enumerate(level):
                bound = np.minimum(raw[:, i], above[i])
                if not (bound >= goal).any():
                    continue
                left, right = self.spans[node][2:]
                if left < 0:
                    found.append(node)
                    bounds.append(bound)
                else:
                    next_level += [int(left), int(right)]
                    next_above += [bound, bound]
            level, above = next_level, next_above
        return found, np.array(bounds).T.reshape(len(q), len(found))

    def search(self, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int, most_leaves: int | None = None):
        """Best ``k`` (score, id) of each query that reach its ``kth`` score.

        In round r every query visits its r-th best leaf; the kth score of what
        it has so far, and the one shared at the start, cut the rest.
        ``most_leaves`` ends after so many rounds.
        """
        score = np.full((len(ids), k), _NONE)
        who = np.full((len(ids), k), np.iinfo(np.int64).max)
        leaves, bounds = self.leaves(queries, kth)
        best = np.argsort(-bounds, axis=1, kind="stable")
        goal = kth.copy()
        for r in range(min(len(leaves), most_leaves or len(leaves))):
            mine = best[:, r]
            open_ = np.flatnonzero(bounds[np.arange(len(ids)), mine] >= goal)
            if not len(open_):
                break
            by_leaf = open_[np.argsort(mine[open_], kind="stable")]
            for rows in np.split(by_leaf, np.flatnonzero(np.diff(mine[by_leaf])) + 1):
                a, b = self.spans[leaves[mine[rows[0]]]][:2]
                for at in range(a, b, 4096):
                    end = min(b, at + 4096)
                    s = self.products(queries[rows], at, end)
                    names = np.broadcast_to(self.ids[at:end], s.shape)
                    s = np.where(names == ids[rows, None], _NONE, s)
                    s, names = np.hstack([score[rows], s]), np.hstack([who[rows], names])
                    names = np.where(s == _NONE, np.iinfo(np.int64).max, names)
                    top = np.lexsort((names, np.where(s == _NONE, 1.0, -s.astype(np.float64)) if np.abs(s[s != _NONE]).max(initial=0) < 2**53 else _rank(s)), axis=1)[:, :k]
                    score[rows], who[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(names, top, 1)
            goal = np.maximum(goal, score[:, -1])
        return score, who


def _largest(x: np.ndarray) -> float:
    """The largest size of an entry; the least 64-bit integer has no absolute value in 64 bits."""
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


def _rank(s: np.ndarray) -> np.ndarray:
    """Descending dense ranks, for scores that doubles cannot tell apart."""
    values, place = np.unique(s, return_inverse=True)
    return (len(values) - place).reshape(s.shape)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def grown(dim: int, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        i, v = np.concatenate(ids), np.concatenate(vectors)
        order, centres, radii, spans = build_tree(v)
        body = [x.tobytes() for x in (i[order], v[order], centres, radii, spans)]
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in body)],
            names=["dim", "ids", "vectors", "centres", "radii", "spans"],
        )

    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        sizes = np.asarray(lists.value_lengths())
        starts = np.asarray(lists.offsets)[:-1]
        flat = lists.values.to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            got = flat[starts[at][:, None] + np.arange(dim)[None, :]].reshape(len(at), dim)
            for a in range(0, len(at), SHARD_ROWS):
                part = held.setdefault(dim, ([], []))
                part[0].append(ids[at[a : a + SHARD_ROWS]])
                part[1].append(got[a : a + SHARD_ROWS])
                if sum(map(len, part[0])) >= SHARD_ROWS:
                    yield grown(dim, *held.pop(dim))
    for dim, part in held.items():
        yield grown(dim, *part)


def _search(k: int, seed: bool):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree({c: batch.column(c)[i].as_py() for c in ("dim", "ids", "vectors", "centres", "radii", "spans")})
                block = batch.column("queries")[i].values
                ids = block.field("vec_id").to_numpy()
                queries = block.field("v").flatten().to_numpy().reshape(len(ids), -1)
                kth = block.field("kth").fill_null(_NONE + 1).to_numpy()
                score, who = tree.search(ids, queries, kth, k, 1 if seed else None)
                at, place = np.nonzero((score != _NONE) & (score >= kth[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(who[at, place]), pa.array(score[at, place])], schema=schema)

    return run


def _meet(trees: DataFrame, queries: DataFrame, n: int, dim: int) -> DataFrame:
    """Every tree beside every block of the ``n`` queries of its dimension.

    Blocks of proven size are broadcast. Beyond, trees are dealt to groups and
    each group gets all blocks: trees are exchanged once, blocks once a group.
    """
    per_block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * dim)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // per_block)))
    blocks = queries.groupBy(F.size("v").alias("dim"), block.alias("block")).agg(F.collect_list(F.struct("vec_id", "v", "kth")).alias("queries"))
    if 16 * n * (dim + 4) <= MOST_BROADCAST_BYTES:
        return trees.join(F.broadcast(blocks), "dim")
    groups = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = trees.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
    return dealt.join(blocks.withColumn("group", F.explode(every)), ["dim", "group"])


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v`` with ``floor(scale * x)``; vectors that are null, or hold null or non-finite x, are left out."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return table.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )


def top_k(
    table: DataFrame,
    *,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other rows, exactly.

    Queries are rows whose id is divisible by ``every``; scores are inner
    products of the integer vectors, ties go to the smaller id. Vectors meet
    those of their own dimension; null, empty and non-finite ones take no part,
    and an id without partner has no rows. Where rows share an id, an id is one
    query (its least vector), and no row of that id answers it. Other columns are
    not looked at; an empty table gives no rows. Products beyond 64 bits saturate.

    Trees and queries are written tables. Every shard first visits each query's
    best leaf; the kth best of all these is shared, and with it bounds cut in the
    second pass. The driver gets the number of queries and no more.
    """
    scratch = Scratch(table.sparkSession, "top-k")
    vectors = integer_vectors(table, id_col, vector_col, scale).where(F.size("v") > 0)
    trees = scratch.table(vectors.mapInArrow(_plant, _TREE), "trees")
    queries = scratch.table(
        vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries"
    )
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = max(1, size["n"]), size["dim"] or 1
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kind = "query_id long, vec_id long, score long"
    ranked = lambda found: found.select("*", F.row_number().over(best).alias("rank"))
    seeds = _meet(trees, queries.withColumn("kth", F.lit(None).cast("long")), n, dim).mapInArrow(_search(k, True), kind)
    kth = scratch.table(ranked(seeds).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth")), "kth")
    found = _meet(trees, queries.join(kth, "vec_id", "left"), n, dim).mapInArrow(_search(k, False), kind)
    return (
        ranked(found)
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
