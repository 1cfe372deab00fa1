"""Near-duplicate embeddings: a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 * (1 - c). Rotated onto the corpus' principal
axes and cut into BLOCKS blocks of dimensions, such a pair is, in at least one block, within that block's
share of the squared distance; shares are in proportion to the blocks' variance, and add up to the whole.
Each block is range-joined on its own: a grid over its leading axes, with cells as wide as the block's
radius, sends a vector to one cell and meets the vectors of that cell and its neighbours. Vectors travel in
packs of up to PACK, so a cell of any size is many pairs of packs, never one task's group. Packs are stored
once and read again by each task that pairs two groups of them, so disk grows with vectors and only reading
with pairs. The blocks' candidates, screened in single precision with room for its errors, are verified in
double precision; a pair counts in the first block that finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common
from .graph import components, roots

BLOCKS = 4
GRID_AXES = 2
PACK = 4096
TILE = 512
SLACK = 1e-9
#: What single precision may miss of a squared distance between parts of unit vectors, for each term of the product.
SCREEN = 4e-7
#: Bytes of packs of one group: two groups are what a task reads. Least number of groups.
GROUP_BYTES, LEAST_GROUPS = 16 << 20, 8


class Plan:
    """Rotation, blocks, budgets and grid: everything that tasks need, of bounded size."""

    def __init__(self, axes: np.ndarray, variances: np.ndarray, cosine: float, blocks: int):
        d = len(axes)
        self.axes, self.cosine = axes, cosine
        order = np.argsort(-variances)
        self.parts = [np.sort(order[b::blocks]) for b in range(min(blocks, d))]
        share = np.array([max(variances[p].sum(), 1e-12) for p in self.parts])
        self.budgets = 2 * (1 - cosine) * share / share.sum() + SLACK
        self.grid = [p[np.argsort(-variances[p])][:GRID_AXES] for p in self.parts]

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.axes

    def cells(self, rotated: np.ndarray, block: int) -> np.ndarray:
        return np.floor(rotated[:, self.grid[block]] / np.sqrt(self.budgets[block]) + 1e-12).astype(np.int64)

    def sides(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Single-precision rows whose products, one side's with the other's, are minus half the block's squared distances."""
        part = rotated[:, self.parts[block]]
        half, one = -0.5 * (part * part).sum(1, keepdims=True), np.ones((len(part), 1))
        return tuple(np.concatenate(x, axis=1).astype(np.float32) for x in ([part, half, one], [part, one, half]))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, outer = 0, None, None
    for batch in batches:
        for d, rows in _by_width(batch.column("vector")):
            x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            if outer is None or len(outer) != d:
                if outer is not None:
                    yield pa.record_batch([pa.array([len(outer)]), pa.array([n]), pa.array([np.concatenate([total, outer.ravel()]).tolist()])], ["d", "n", "moments"])
                n, total, outer = 0, np.zeros(d), np.zeros((d, d))
            n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
    if outer is not None:
        yield pa.record_batch([pa.array([len(outer)]), pa.array([n]), pa.array([np.concatenate([total, outer.ravel()]).tolist()])], ["d", "n", "moments"])


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    offs = column.offsets.to_numpy()
    values, widths = column.values.to_numpy(zero_copy_only=False), np.diff(offs)
    for d in np.unique(widths):
        yield int(d), values[(offs[:-1][widths == d][:, None] + np.arange(d))].astype(float)


def _clean(vectors: DataFrame) -> DataFrame:
    """id, vector as doubles, of the rows whose vector can have a cosine."""
    v = F.col("vector")
    ok = F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0.0)
    return vectors.where(F.coalesce(ok, F.lit(False)))


def _links_of_width(distinct: DataFrame, plan: Plan, d: int, n: int, number: str) -> DataFrame:
    """node, n_links, root: for each of n distinct vectors that is met, weighted links and one connecting edge per pack pair.
    number: the type of the vectors' components, which packs keep."""
    shared = distinct.sparkSession.sparkContext.broadcast(plan)
    blocks, axes = len(plan.parts), [f"c{i}" for i in range(len(plan.grid[0]))]
    place = ["block", *axes]
    schema = ", ".join(f"{c} long" for c in place)
    # a vector in a pack, with its cells in all blocks: rotated among other rows, one on a border could get another cell
    form = np.dtype([("id", "<i8"), ("copies", "<i8"), ("cells", "<i4", (blocks, GRID_AXES)), ("vector", {"float": "<f4", "double": "<f8"}[number], (d,))])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = next(x for _, x in _by_width(batch.column("vector")))
            y, rows = plan.rotated(x), np.zeros(len(batch), form)
            rows["id"], rows["copies"], rows["vector"] = batch.column("id").to_numpy(), batch.column("copies").to_numpy(), x
            for block in range(blocks):
                rows["cells"][:, block, : len(axes)] = plan.cells(y, block)
            ends = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * form.itemsize)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows.tobytes())])
            for block in range(blocks):
                cells = rows["cells"][:, block, : len(axes)].astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(rows), block)), *(pa.array(c) for c in cells.T), packed], [*place, "row"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([*(pa.array([c], pa.int64()) for c in at), pa.array([b"".join(held)], pa.binary())], [*place, "pack"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in place], axis=1)
            row = batch.column("row")
            raw = memoryview(row.buffers()[2])[row.offset * form.itemsize :]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):  # rows come in the order of cells
                key = tuple(keys[begin].tolist())
                if held and key != at:
                    yield out()
                    held, size = [], 0
                at = key
                while begin < end:
                    to = min(end, begin + PACK - size)
                    held.append(bytes(raw[begin * form.itemsize : to * form.itemsize]))
                    size, begin = size + to - begin, to
                    if size == PACK:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    groups = max(LEAST_GROUPS, -(-n * blocks * form.itemsize // GROUP_BYTES))
    rows = distinct.select("id", "copies", "vector").mapInArrow(placed, f"{schema}, row binary").withColumn("spread", F.xxhash64("row"))
    # neighbours in range order: full packs but for each cell's and partition's last one, however large a cell is
    ordered = rows.repartitionByRange(groups, *place, "spread").sortWithinPartitions(*place, "spread").drop("spread")
    packs = common.written(ordered.mapInArrow(packed, f"{schema}, pack binary").withColumn("pack_id", F.xxhash64(*place, "pack")), "packs")

    def side(name: str) -> DataFrame:
        return packs.select(*(F.col(c).alias(f"{name}_{c}") for c in place), F.col("pack_id").alias(f"{name}_id"), F.col("pack").alias(name)).coalesce(groups)

    near = F.col("a_block") == F.col("b_block")
    for c in axes:
        near = near & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= 1)
    # every two groups meet in a task that reads both: nothing is shuffled, so packs are on disk once
    both = side("a").hint("shuffle_replicate_nl").join(side("b"), near & (F.col("a_id") <= F.col("b_id")))
    met = both.select(F.col("a_block").alias("block"), "a", "b", (F.col("a_id") == F.col("b_id")).alias("self"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            for block, a, b, itself in zip(*(batch.column(k).to_pylist() for k in ("block", "a", "b", "self")), strict=True):
                p, q = np.frombuffer(a, form), np.frombuffer(b, form)
                x, y = (plan.rotated(r["vector"].astype(float)) for r in (p, q))
                i, j = _found(plan, block, x, y, p["cells"], q["cells"], itself)
                if not len(i):
                    continue
                ids = np.concatenate([p["id"], q["id"]])
                counts = np.bincount(np.concatenate([i, j + len(p)]), weights=np.concatenate([q["copies"][j], p["copies"][i]]), minlength=len(ids)).astype(np.int64)
                root, hit = roots(i, j + len(p), ids), np.flatnonzero(counts)
                yield pa.record_batch([pa.array(ids[hit]), pa.array(counts[hit]), pa.array(root[hit])], ["node", "n_links", "root"])

    return common.written(met.mapInArrow(verified, "node long, n_links long, root long"), "vector-links")


def _found(plan: Plan, block: int, x: np.ndarray, y: np.ndarray, cells: np.ndarray, others: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= plan.cosine that this block is the first to find. cells, others: of x and y in all blocks."""
    left, right = plan.sides(x, block)[0], plan.sides(y, block)[1].T
    found = []
    for at in range(0, len(x), TILE):
        # of a pack with itself pairs i < j alone
        begin = at if itself else 0
        near = left[at : at + TILE] @ right[:, begin:] >= np.float32(-0.5 * (plan.budgets[block] + SCREEN * len(right)))
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        i, j = i + at, j + begin
        if itself:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            found.append(_verified(plan, block, x, y, cells, others, i[k : k + (1 << 16)], j[k : k + (1 << 16)]))
    return tuple(np.concatenate(k) for k in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _verified(plan: Plan, block: int, x: np.ndarray, y: np.ndarray, cells: np.ndarray, others: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    linked = np.einsum("ij,ij->i", x[i], y[j]) >= plan.cosine - 4e-16
    i, j = i[linked], j[linked]
    square = (x[i] - y[j]) ** 2
    first = square[:, plan.parts[block]].sum(1) <= plan.budgets[block]
    for earlier in range(block):
        close = square[:, plan.parts[earlier]].sum(1) <= plan.budgets[earlier]
        first &= ~(close & (np.abs(cells[i, earlier] - others[j, earlier]) <= 1).all(1))
    return i[first], j[first]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", embedding: str = "embedding", blocks: int = BLOCKS) -> DataFrame:
    """key, n_links, component_id, kept for every row of vectors(key, embedding: array of numbers).

    Rows link if their cosine is at least `cosine`; n_links counts the other rows linked directly, copies
    each; component_id is the smallest key reachable by links. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, as do vectors of different widths with each other; a
    null key has component_id null and kept true. Equal vectors are grouped before the join. Rows with
    the same key are one node. No rows in, no rows out; other columns are not read.
    """
    spark = vectors.sparkSession
    common.bound_batches(spark)
    number = "float" if isinstance(vectors.schema[embedding].dataType.elementType, FloatType) else "double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast(f"array<{number}>").alias("vector"))
    print_a, print_b = F.xxhash64("vector"), F.xxhash64(F.lit(17), "vector")
    usable = _clean(rows).select("id", F.transform("vector", lambda x: x + F.lit(0.0)).cast(f"array<{number}>").alias("vector"))
    marked = usable.select("id", "vector", print_a.alias("pa"), print_b.alias("pb"))
    grouped = marked.groupBy("pa", "pb").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
    distinct = common.written(grouped, "vectors")
    made = distinct.mapInArrow(_moments, "d long, n long, moments array<double>")
    totals = made.select("d", "n", F.posexplode("moments").alias("at", "x")).groupBy("d", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).groupBy("d").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m"))
    found = None
    for r in totals.select("d", "n", F.col("m.x").alias("m")).collect():  # d + d * d numbers of each width
        m, d = np.array(r["m"]), r["d"]
        mean = m[:d] / r["n"]
        variances, axes = np.linalg.eigh(m[d:].reshape(d, d) / r["n"] - np.outer(mean, mean))
        part = _links_of_width(distinct.where(F.size("vector") == d).select("id", "copies", "vector"), Plan(axes, np.maximum(variances, 0), cosine, blocks), d, r["n"], number)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    direct = found.groupBy(F.col("node").alias("id")).agg(F.sum("n_links").alias("others"))
    nodes = distinct.select("pa", "pb", F.col("id").alias("first"), "copies")
    member = marked.select("id", "pa", "pb").join(nodes, ["pa", "pb"]).select("id", "first", "copies")
    graph = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(member.select(F.col("id").alias("a"), F.col("first").alias("b"))))
    counted = member.join(direct.withColumnRenamed("id", "first"), "first", "left").groupBy("id").agg(F.max(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return (
        rows.select("id").join(counted, "id", "left").join(graph.withColumnRenamed("node", "id"), "id", "left")
        .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), r AS (
  SELECT vec_id, vec_id AS to_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.to_id = l.a
)
SELECT r.vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(to_id) AS component_id, r.vec_id = min(to_id) AS kept
FROM r LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) c ON c.vec_id = r.vec_id GROUP BY r.vec_id
"""
