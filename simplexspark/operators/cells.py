"""Exact nearest neighbours between vectors of any length, over a tree of cells.

The right side starts in the cells its rows name (``root``). A cell that holds more than ``leaf`` points is split at medians of
a bounded sample of its points into up to 2 to the ``DEPTH`` cells, level by level, until none is crowded; a cell knows the bounding
box of its points. Left rows walk down from the roots they name: the sample of a cell gives a radius that is sure to hold k points,
and only those cells below are entered whose box is not farther. In the leaves distances are taken and the k smallest kept.

Each left row names one of a few weightings of the coordinates, so one tree serves distances over different subsets of them:
a box bounds a weighted distance whatever the weights are. Right points at one place are reduced to the k with the
smallest ids, so a crowded cell always has places to part it at; points and left rows of a cell are dealt to as many tasks
as their number asks for, and no pair is made outside a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplexspark.sources.stages import cut

LEAF, SAMPLE, DEPTH = 1024, 256, 5
#: Boxes of that many coordinates hold few rows back, whose copies grow with the number of leaves: these are larger there.
WIDE, WIDE_LEAF = 32, 1 << 14
#: Points and left rows of one cell that one task takes, and distances that it holds at once.
POINTS, ROWS, HELD = 1 << 16, 1 << 13, 1 << 20
SLACK = 1.0 + 1e-9


def loose(kind: pa.DataType) -> pa.DataType:
    """The type with nulls allowed at every depth, as a task's result declares it."""
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, loose(kind.value_type)))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, loose(f.type)) for f in kind])
    return kind


def loosened(rows: pa.Table) -> pa.Table:
    """A task's rows without "not null" in their types: Spark drops a cast that only lifts it, and Arrow would hold it against the result."""
    return rows.cast(pa.schema([pa.field(f.name, loose(f.type)) for f in rows.schema]))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distances(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted squared distances of all rows of ``a`` to all of ``b``."""
    out = np.zeros((len(a), len(b)))
    for i in np.flatnonzero(weights):
        step = a[:, i, None] - b[None, :, i]
        out += weights[i] * step * step
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, weights: np.ndarray, k: int, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` and distances of all pairs up to ``r2`` that can be among the k nearest of a row, with all ties.
    Distances by one matrix product leave out the pairs that are farther beyond its rounding; those left are taken anew."""
    used = np.flatnonzero(weights)
    with np.errstate(over="ignore", invalid="ignore"):
        middle, root = b[:, used].mean(axis=0), np.sqrt(weights[used])
        u, v = (a[:, used] - middle) * root, (b[:, used] - middle) * root
        uu, vv = np.einsum("ij,ij->i", u, u), np.einsum("ij,ij->i", v, v)
        rough = u @ (-2.0 * v.T)
        rough += uu[:, None]
        rough += vv
        # Far above the rounding of the differences, the lengths and the product.
        off = 8.0 * (len(used) + 16) * np.finfo(float).eps * (uu + vv.max()) + 1e-290
    if not np.isfinite(rough).all():  # infinite or very large coordinates
        rough, off = distances(a, b, weights), np.zeros(len(a))
    limit = r2 + off
    if b.shape[0] > k:
        limit = np.fmin(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * off)
    i, j = np.nonzero(rough <= limit[:, None])
    d2 = np.zeros(len(i))
    for c in used:
        step = a[i, c] - b[j, c]
        d2 += weights[c] * step * step
    keep = d2 <= r2[i]
    return i[keep], j[keep], d2[keep]


def box_distances(a: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted squared distances of all rows of ``a`` to all boxes."""
    out = np.zeros((len(a), len(low)))
    for i in np.flatnonzero(weights):
        step = np.maximum(np.maximum(low[None, :, i] - a[:, i, None], a[:, i, None] - high[None, :, i]), 0.0)
        out += weights[i] * step * step
    return out


def split_places(sample: np.ndarray, points: np.ndarray, most: int = DEPTH) -> np.ndarray:
    """Number of the part of its cell that each point lies in: the sample is halved along its widest coordinate, and again, ``most`` times."""
    place = np.zeros(len(points), np.int64)

    def halve(mine: np.ndarray, theirs: np.ndarray, depth: int, number: int) -> None:
        place[theirs] = number
        if depth == most or len(mine) < 2:
            return
        spread = np.ptp(sample[mine], axis=0)
        axis = int(np.argmax(spread))
        if not spread[axis] > 0:
            return
        values = sample[mine, axis]
        at = np.median(values)
        at = at if at < values.max() else values[values < values.max()].max()
        for side, keep in enumerate((lambda v: v <= at, lambda v: v > at)):
            halve(mine[keep(values)], theirs[keep(points[theirs, axis])], depth + 1, 2 * number + side + 1)

    halve(np.arange(len(sample)), np.arange(len(points)), 0, 0)
    return place


def dealt(df: DataFrame, sizes: DataFrame, size: int, key: str) -> DataFrame:
    """Rows with the number of rows of their cell, that of tasks it is dealt to, and their task."""
    tasks = sizes.select("cell", "n", F.ceil(F.col("n") / size).cast("int").alias("tasks"))
    return df.join(tasks, "cell").withColumn("task", F.pmod(F.xxhash64(key), F.col("tasks")).cast("int"))


def to_all(df: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    tasks = sizes.select("cell", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / size).cast("int") - 1)).alias("task"))
    return df.join(tasks, "cell")


def cell_knn(left: DataFrame, right: DataFrame, k: int, width: int, weights: Sequence[Sequence[float]] | None = None, leaf: int | None = None) -> DataFrame:
    """The k nearest right rows of each left row: (lid, rid, d2, rank), ties to the smaller rid.

    ``left`` has lid, root, w (number of a row of ``weights``) and x, an array of ``width`` numbers; ``right`` has rid, root and x.
    A left row may be given under several roots and then searches all of them. Vectors that are null or hold nulls or
    NaN take no part, and left rows without any right row in their roots get no row. Without ``weights`` all coordinates weigh 1.
    ``leaf`` is the most points a cell keeps, by default ``LEAF``, and ``WIDE_LEAF`` from ``WIDE`` coordinates on.
    """
    leaf = leaf or (LEAF if width < WIDE else WIDE_LEAF)
    weight = np.asarray(weights if weights is not None else [[1.0] * width], float)
    whole = F.col("x").isNotNull() & (F.size("x") == width) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    lid, rid = left.schema["lid"].dataType.simpleString(), right.schema["rid"].dataType.simpleString()
    one = Window.partitionBy("cell", "x").orderBy("rid")
    points = right.select(F.col("root").cast("string").alias("cell"), F.col("rid").cast(rid).alias("rid"), F.col("x").cast("array<double>").alias("x")).where(whole)
    points = cut(points.withColumn("r", F.row_number().over(one)).where(F.col("r") <= k).drop("r"), "cell-points")
    walk = left.select(F.col("root").cast("string").alias("cell"), F.col("lid").cast(lid).alias("lid"), F.col("w").cast("int").alias("w"), F.col("x").cast("array<double>").alias("x"), F.lit(float("inf")).alias("r2")).where(whole)
    done_points, done_rows = None, None
    point_schema = f"cell string, rid {rid}, x array<double>, high array<double>, parent string"
    row_schema = f"cell string, lid {lid}, w int, x array<double>, r2 double"

    def part(mine: pa.Table, sample: pa.Table) -> pa.Table:
        """The points with the cells below, and a row a cell for its box: no rid, x the low corner."""
        mine = loosened(mine)
        if not mine.num_rows:
            return mine.select(["cell", "rid", "x"]).append_column("high", mine["x"]).append_column("parent", mine["cell"])
        x, cell = matrix(mine["x"], width), mine["cell"][0].as_py()
        halvings = max(1, min(DEPTH, math.ceil(math.log2(1.25 * mine["n"][0].as_py() / leaf))))  # no more cells than it takes
        place = split_places(matrix(sample["x"], width), x, halvings)
        found = np.unique(place)
        names = pa.array([f"{cell}/{p}" for p in place.tolist()])
        nothing = pa.nulls(len(x), mine.schema.field("x").type)
        own = pa.table({"cell": names, "rid": mine["rid"], "x": mine["x"], "high": nothing, "parent": pa.nulls(len(x), pa.string())})
        low, high = ([corner(x[place == p], axis=0).tolist() for p in found] for corner in (np.min, np.max))
        kind = mine.schema.field("x").type
        boxes = pa.table({"cell": pa.array([f"{cell}/{p}" for p in found.tolist()]), "rid": pa.nulls(len(found), mine.schema.field("rid").type),
                          "x": pa.array(low, kind), "high": pa.array(high, kind), "parent": pa.array([cell] * len(found))})
        return pa.concat_tables([own, boxes])

    def in_groups(rows: pa.Table, across: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one weighting, a bounded number at a time: their places, vectors and weights."""
        x, w = matrix(rows["x"], width), rows["w"].to_numpy()
        step = max(1, HELD // max(1, across))
        for name in np.unique(w):
            at = np.flatnonzero(w == name)
            for i in range(0, len(at), step):
                yield at[i:i + step], x[at[i:i + step]], weight[name]

    def descend(rows: pa.Table, info: pa.Table) -> pa.Table:
        out, rows = [], loosened(rows)
        if rows.num_rows and info.num_rows:
            boxed = np.asarray(info["parent"].is_valid())
            sample, boxes = info.filter(~boxed), info.filter(boxed)
            s, low, high = matrix(sample["x"], width), matrix(boxes["x"], width), matrix(boxes["high"], width)
            names, r2 = np.array(boxes["cell"].to_pylist(), object), rows["r2"].to_numpy().copy()
            for at, x, w in in_groups(rows, len(s) + len(low)):
                if len(s) >= k:
                    r2[at] = np.minimum(r2[at], np.partition(distances(x, s, w), k - 1, axis=1)[:, k - 1] * SLACK)
                i, j = np.nonzero(box_distances(x, low, high, w) <= r2[at][:, None])
                both = np.unique(np.stack([at[i], np.unique(names, return_inverse=True)[1][j]]), axis=1)  # a cell has a box a task
                taken = rows.take(both[0])
                out.append(pa.table({"cell": pa.array(np.unique(names)[both[1]].tolist(), pa.string()), "lid": taken["lid"], "w": taken["w"], "x": taken["x"], "r2": pa.array(r2[both[0]])}))
        return pa.concat_tables(out) if out else rows.select(["cell", "lid", "w", "x", "r2"]).slice(0, 0)

    level = 0
    while True:
        sizes = cut(points.groupBy("cell").agg(F.count("*").alias("n")), "cell-sizes")
        crowded = sizes.where(F.col("n") > leaf)
        calm = points.join(crowded, "cell", "left_anti")
        done_points = calm if done_points is None else done_points.unionByName(calm)
        if crowded.isEmpty():
            done_rows = walk if done_rows is None else done_rows.unionByName(walk)
            break
        still = walk.join(crowded, "cell", "left_anti")
        done_rows = still if done_rows is None else done_rows.unionByName(still)
        busy = points.join(crowded.select("cell"), "cell", "left_semi")
        picked = busy.groupBy("cell", F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)).alias("salt")).agg(F.min_by("x", F.xxhash64("rid", F.lit(level))).alias("x"))
        sample = cut(picked.select("cell", "x"), "cell-sample")
        halves = dealt(busy, crowded, POINTS, "rid").groupBy("cell", "task").cogroup(to_all(sample, crowded, POINTS).groupBy("cell", "task"))
        parts = cut(halves.applyInArrow(part, point_schema), "cell-parts")
        info = sample.select(F.col("cell").alias("of"), "x", F.lit(None).cast("array<double>").alias("high"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("cell"))
        info = info.unionByName(parts.where("parent is not null").select(F.col("parent").alias("of"), "x", "high", "parent", "cell"))
        rows = walk.join(crowded.select("cell"), "cell", "left_semi")
        many = cut(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell-rows")
        asked = to_all(info.withColumnsRenamed({"cell": "below", "of": "cell"}), many, ROWS).withColumnsRenamed({"cell": "of", "below": "cell"})
        walk = cut(dealt(rows, many, ROWS, "lid").groupBy("cell", "task").cogroup(asked.groupBy("of", "task")).applyInArrow(descend, row_schema), "cell-walk")
        points = parts.where("parent is null").select("cell", "rid", "x")
        level += 1

    def nearest(rows: pa.Table, mine: pa.Table) -> pa.Table:
        out, rows, mine = [], loosened(rows), loosened(mine)
        if rows.num_rows and mine.num_rows:
            p, r2 = matrix(mine["x"], width), rows["r2"].to_numpy()
            for at, x, w in in_groups(rows, len(p)):
                i, j, d2 = near_pairs(x, p, w, k, r2[at])
                out.append(pa.table({"lid": rows["lid"].take(pa.array(at[i])), "rid": mine["rid"].take(pa.array(j)), "d2": pa.array(d2)}))
        return pa.concat_tables(out) if out else pa.table({"lid": rows["lid"].slice(0, 0), "rid": mine["rid"].slice(0, 0), "d2": pa.array([], pa.float64())})

    many = cut(done_rows.groupBy("cell").agg(F.count("*").alias("n")), "cell-rows")
    pairs = dealt(done_rows, many, ROWS, "lid").groupBy("cell", "task").cogroup(to_all(done_points, many, ROWS).groupBy("cell", "task"))
    best = Window.partitionBy("lid").orderBy("d2", "rid")
    found = pairs.applyInArrow(nearest, f"lid {lid}, rid {rid}, d2 double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
