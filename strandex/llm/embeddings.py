"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors are one vector with a weight. Vectors are scaled to length 1 and turned into the
principal axes, most energy first. Tiles are runs of a bounded number of vectors, by a split along
the leading axes; a pair of tiles meets in one task unless their bounding boxes are farther apart
than linked vectors can be. Inside, products are accumulated over a few leading dimensions at a
time; what the rest can still add is at most the product of the suffix norms, and a pair stops as
soon as product + bound cannot reach the threshold. Pairs that survive are decided by the cosine of
the given vectors in double precision.

A task returns, per vector, the weight of its links, and a spanning forest of the links it found,
never the links themselves: copies of a vector and dense groups cost one row each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandex.llm.jaccard import components
from strandex.llm.runtime import Tables

#: Vectors of a tile, about, and numbers in it at most: each vector is sent once to every tile that it
#: may meet, so that tiles are as large as a task can well hold. Rows of a tile taken at once;
#: dimensions added between two bounds.
TILE, NUMBERS, ROWS, STEP = 8192, 1 << 22, 256, 8
#: Vectors that the splits between tiles are taken from (only their cut points depend on it).
SAMPLE = 1 << 14
#: Axes whose ranges bound a leaf of the splits, and leaves at most: what is known of all leaves and
#: their neighbours is of a bounded size. A leaf of more vectors than a tile is cut into pieces by hash.
BOX, LEAVES = 8, 1024
_SLACK = 1e-9


def _finite(v):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(vectors: DataFrame) -> np.ndarray:
    """Principal axes of the unit vectors, from the sums of products over all of them."""

    def run(batches):
        total = None
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = vectors.select("vector").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    d = math.isqrt(len(sums))
    values, axes = np.linalg.eigh(np.array([r["x"] for r in sums]).reshape(d, d))
    return axes[:, ::-1].copy()


def _splits(sample: np.ndarray, parts: int) -> list[tuple[int, float]]:
    """A tree of 2^k leaves as (axis, cut) in heap order: the widest leading axis is cut at its median."""
    tree: list[tuple[int, float]] = []
    level = [np.arange(len(sample))]
    while len(level) < parts:
        below = []
        for rows in level:
            x = sample[rows, :BOX]
            axis = int(np.argmax(np.ptp(x, axis=0))) if len(rows) else 0
            cut = float(np.median(x[:, axis])) if len(rows) else 0.0
            tree.append((axis, cut))
            below += [rows[x[:, axis] <= cut], rows[x[:, axis] > cut]]
        level = below
    return tree


def _leaf(x: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    if tree:
        axis, cut = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        for _ in range((len(tree) + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[np.arange(len(x)), axis[at]] > cut[at])
    return at - len(tree)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its class) for the classes that the pairs a-b make."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def linked(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (unit, axes by energy) whose product may reach the threshold."""
    d = a.shape[1]
    rest = lambda x: np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]))
    ra, rb = np.hstack([rest(a), np.zeros((len(a), 1))]), np.hstack([rest(b), np.zeros((len(b), 1))])
    k = min(2 * step, d)
    got = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(got + np.outer(ra[:, k], rb[:, k]) >= threshold - _SLACK)
    value = got[i, j]
    while k < d and len(i):
        m = min(k + step, d)
        value = value + np.einsum("ij,ij->i", a[i, k:m], b[j, k:m])
        stay = value + ra[i, m] * rb[j, m] >= threshold - _SLACK
        i, j, value, k = i[stay], j[stay], value[stay], m
    return i, j


def _compare(threshold: float, axes):
    """A pair of tiles -> id, weight of its links, and least id of the links' class."""

    def run(table: pa.Table) -> pa.Table:
        ids, weights, side = (table.column(c).to_numpy() for c in ("id", "weight", "side"))
        vectors = _matrix(table.column("vector").combine_chunks())
        given = _unit(vectors)
        turned = given @ axes.value
        same = bool(table.column("own")[0].as_py())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        count = np.zeros(len(ids), np.int64)
        nodes, tops = [], []
        for k in range(0, len(left), ROWS):
            rows = left[k : k + ROWS]
            i, j = linked(turned[rows], turned[right], threshold)
            i, j = rows[i], right[j]
            if same:
                i, j = i[i != j], j[i != j]
            some = max(1, NUMBERS // given.shape[1])  # pairs at once, so that their vectors are as large as a tile
            exact = np.concatenate([np.einsum("ij,ij->i", given[i[p : p + some]], given[j[p : p + some]]) for p in range(0, len(i), some)] or [np.zeros(0)])
            i, j = i[exact >= threshold], j[exact >= threshold]
            np.add.at(count, i, weights[j])
            if not same:
                np.add.at(count, j, weights[i])
            if len(i):
                n, t = _forest(ids[i], ids[j])
                nodes.append(n)
                tops.append(t)
        at = np.flatnonzero(count)
        node, top = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, tops))
        out_id, out_n = np.concatenate([ids[at], node]), np.concatenate([count[at], np.zeros(len(node), np.int64)])
        out_top = np.concatenate([ids[at], top])
        return pa.table({"id": pa.array(out_id, pa.int64()), "n": pa.array(out_n, pa.int64()), "top": pa.array(out_top, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """Per row: the id, ``n_links``, ``component_id`` and ``kept`` (id = component_id).

    Links are pairs of vectors with a cosine of at least ``threshold`` (above 0) in double precision.
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and
    vectors of different lengths don't link. A null id links with nothing, has a null component and
    isn't kept. Rows that repeat an id are vectors of their own for n_links. Other columns are dropped.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    work = Tables(spark, "embeddings")
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))
    sound = rows.where(F.col("id").isNotNull() & _finite(F.col("vector")))
    same = work.write("same", sound.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    counts, forests = [], []
    for size in [r[0] for r in same.select(F.size("vector").alias("d")).distinct().collect()]:
        of = same.where(F.size("vector") == size)
        n, parts, most = of.count(), 1, max(1, min(tile, NUMBERS // size))
        while parts * most < n and parts < LEAVES:
            parts *= 2
        axes = spark.sparkContext.broadcast(_axes(of))
        stride = -(-n // SAMPLE)
        sample = of.where(F.pmod(F.xxhash64("id"), F.lit(stride)) == 0).select("vector").toArrow() if parts > 1 else None
        tree = _splits(_unit(_matrix(sample["vector"].combine_chunks())) @ axes.value, parts) if sample is not None else []

        def place(batches, axes=axes, tree=tree):
            for batch in batches:
                x = _unit(_matrix(batch.column(2))) @ axes.value
                lead = [pa.array(x[:, k]) for k in range(min(BOX, x.shape[1]))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_leaf(x, tree)), *lead], names=["id", "weight", "vector", "leaf", *[f"x{k}" for k in range(len(lead))]])

        lead = [f"x{k}" for k in range(min(BOX, size))]
        placed = work.write(f"placed{size}", of.select("id", "weight", "vector").mapInArrow(place, "id long, weight long, vector array<double>, leaf long, " + ", ".join(f"{c} double" for c in lead)))
        boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("m"), *[f(c).alias(f"{n_}{c}") for c in lead for n_, f in (("low_", F.min), ("high_", F.max))]).orderBy("leaf").collect()
        low = np.array([[b[f"low_{c}"] for c in lead] for b in boxes])
        high = np.array([[b[f"high_{c}"] for c in lead] for b in boxes])
        pieces = np.array([-(-b["m"] // most) for b in boxes])
        first = np.concatenate([[0], np.cumsum(pieces)])
        near = []  # per leaf: its first tile, its number of tiles, and the ranges of tiles that these meet
        for a, box in enumerate(boxes):
            gap = np.maximum(0, np.maximum(low - high[a], low[a] - high))
            close = np.flatnonzero((gap * gap).sum(axis=1) <= 2 - 2 * threshold + _SLACK)
            near.append((box["leaf"], int(first[a]), int(pieces[a]), [(int(first[b]), int(first[b + 1]) - 1) for b in close]))
        near = spark.createDataFrame(near, "leaf long, first long, pieces long, close array<struct<low:long,high:long>>")
        others = F.flatten(F.transform("close", lambda x: F.sequence(x["low"], x["high"])))
        dealt = placed.select("id", "weight", "vector", "leaf").join(F.broadcast(near), "leaf")  # LEAVES rows of LEAVES ranges at most
        dealt = dealt.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).select("id", "weight", "vector", "tile", F.explode(others).alias("other"))
        dealt = dealt.select("id", "weight", "vector", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), (F.col("tile") > F.col("other")).cast("int").alias("side"), (F.col("tile") == F.col("other")).alias("own"))
        met = work.write(f"met{size}", dealt.groupBy("t0", "t1").applyInArrow(_compare(threshold, axes), "id long, n long, top long"))
        counts.append(met.where("n > 0").select("id", "n"))
        forests.append(met.where("n = 0 AND id <> top").select(F.least("id", "top").alias("a"), F.greatest("id", "top").alias("b")))
        work.drop(f"placed{size}")
    if counts:
        n, links = counts[0], forests[0]
        for x, y in zip(counts[1:], forests[1:]):
            n, links = n.union(x), links.union(y)
        classes = components(work.write("links", links.distinct()), work, "classes")
        n = n.groupBy("id").agg(F.sum("n").alias("n"))
        found = same.join(n, "id", "left").join(classes.withColumnRenamed("v", "id"), "id", "left")
        found = found.select(F.col("vector").alias("_vector"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("c", "id").alias("c"), "weight")
        found = work.write("found", found)
        work.only("found")
    else:
        found = spark.createDataFrame([], "_vector array<double>, n_links long, c long, weight long")
    # A vector that holds this share of all rows is one of few, which hold NUMBERS numbers in all at most.
    total = found.agg(F.sum("weight")).first()[0] or 0
    common = F.col("weight") * F.lit(float(NUMBERS)) > F.size("_vector") * F.lit(float(total))
    often, seldom = F.broadcast(found.where(common)), found.where(~common)
    on = F.col("vector") == F.col("_vector")
    out = sound.join(often, on).unionByName(sound.join(often, on, "left_anti").join(seldom, on))
    alone = rows.where(~(F.col("id").isNotNull() & _finite(F.col("vector"))))
    out = out.unionByName(alone, allowMissingColumns=True)
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
