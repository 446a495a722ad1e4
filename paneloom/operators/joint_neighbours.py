"""Mutual information with a numeric target from nearest neighbours.

A row's distance to its k-th neighbour, in feature and target together (the larger of both
differences, each in standard deviations), is set against how many rows are closer than that in
the feature alone and in the target alone.

Each feature's plane is cut into cells of about `rows_per_cell` different (feature, target) pairs,
at medians of a hash sample, so a crowded value in either direction is cut along the other one.
A task finds neighbours inside its cell. A row whose neighbourhood reaches over its
cell's border then visits the cells it reaches, and only those; what it found at home bounds how
far that is, so one visit is exact. A cell with many visitors is given out several times.

How many rows lie closer in one direction is counted in parts of that direction, cut at places of
the same sample: a row whose interval ends in its own part is done there. Of the others, each
end is counted in the part it lies in, and the sizes of the parts before are added. A part with a
crowded value is given out several times, with its values and how often they come.

Defined cases. A row whose value or target is null, NaN or infinite takes no part in that
feature. Equal pairs are counted once, with their number, and are neighbours at distance zero;
a row whose k-th neighbour is that near counts the rows of its value. With k rows or fewer, all
others are neighbours. A feature with fewer than two rows has no information. A constant
column is not scaled. Scores are in nats, and never below zero. Borders are sent to all tasks:
at most `MOST_CELLS` a feature, 74 KB, and as many parts a direction, for at most 200 features at
once; beyond `MOST_CELLS` x `rows_per_cell` different pairs, cells grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from paneloom.operators.neighbours import NEIGHBOURS, digamma
from paneloom.session import saved
from paneloom.spec import column_groups, union_all

ROWS_PER_CELL = 20_000
MOST_CELLS = 4_096
SAMPLED_PER_CELL = 16
VISITS_PER_TASK = 200_000
CELLS_PER_TASK = 4
CELLS_PER_PART = 10
LEAF = 8
POINT = ["cell", "y", "x"]
# One number for what is grouped by, which sorts faster than several: the cell within the feature
# or the part within the direction, and the time that it is given out.
PLACES = 13  # bits; a tree of `MOST_CELLS` has fewer nodes
TURNS = 20

# --- cells: a tree of cuts, the children of node i at 2i + 1 and 2i + 2 --------------------


def _cut(x: np.ndarray, y: np.ndarray, sx: float, sy: float) -> tuple[int, float] | None:
    """(direction, cut) that halves the points along their longer side: at or below the cut,
    and above it. None for a single place. The cut is halfway between two values, so that
    rows of few values are away from it."""
    spread = np.ptp(x) / sx, np.ptp(y) / sy
    if not max(spread) > 0:
        return None
    side = int(spread[1] > spread[0])
    v = np.sort((x, y)[side])
    cut = v[(len(v) - 1) // 2]
    if cut == v[-1]:
        cut = v[np.searchsorted(v, cut) - 1]
    return side, float(_between(cut, v[np.searchsorted(v, cut, "right")]))


def _between(low, high):
    """Halfway between two numbers, or the lower one if there is none."""
    middle = low / 2 + high / 2
    return np.where((middle > low) & (middle < high), middle, low)


def cell_tree(x, y, sx: float, sy: float, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(direction, cut) of every node; direction -1 is a cell."""
    sides = np.full(2 ** (depth + 1) - 1, -1, np.int8)
    cuts = np.zeros(len(sides))
    inside = {0: np.arange(len(x))}
    for node in range(2**depth - 1):
        rows = inside.pop(node, None)
        found = _cut(x[rows], y[rows], sx, sy) if rows is not None and len(rows) > 1 else None
        if found is None:
            continue
        sides[node], cuts[node] = found
        low = (x, y)[found[0]][rows] <= found[1]
        inside[2 * node + 1], inside[2 * node + 2] = rows[low], rows[~low]
    return sides, cuts


def cells_reached(tree, x, y, radius, scales) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every cell that may hold points within `radius` of a row."""
    sides, cuts = tree
    rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
    found = []
    while len(rows):
        side, cut = sides[nodes], cuts[nodes]
        done = side < 0
        found.append((rows[done], nodes[done]))
        rows, nodes, side, cut = rows[~done], nodes[~done], side[~done], cut[~done]
        v = np.where(side == 0, x[rows], y[rows])
        scale, near = np.where(side == 0, scales[0], scales[1]), radius[rows]
        low = (v <= cut) | ((v - cut) / scale <= near)
        high = (v > cut) | ((cut - v) / scale <= near)
        rows = np.concatenate([rows[low], rows[high]])
        nodes = np.concatenate([2 * nodes[low] + 1, 2 * nodes[high] + 2])
    return tuple(np.concatenate(part) for part in zip(*found)) if found else (rows, nodes)


def cell_of(tree, x, y) -> np.ndarray:
    """The cell of every row."""
    sides, cuts = tree
    nodes = np.zeros(len(x), np.int64)
    for _ in range(len(sides).bit_length() - 1):
        side = sides[nodes]
        below = 2 * nodes + 1 + (np.where(side == 0, x, y) > cuts[nodes])
        nodes = np.where(side < 0, nodes, below)
    return nodes


def reaching_over(tree, cell: int, x, y, radius, scales) -> np.ndarray:
    """Whether a row of a cell may have points within `radius` beyond the cell's borders."""
    sides, cuts = tree
    over = np.zeros(len(x), bool)
    while cell:
        above = (cell - 1) // 2
        side, cut = sides[above], cuts[above]
        over |= np.abs((x, y)[side] - cut) / scales[side] <= radius
        cell = above
    return over


# --- neighbours inside a cell ------------------------------------------------------------


class Leaves:
    """Points (x, y, n) in leaves of `LEAF` to twice as many, halved along their longer side.
    Node i of a level has the children 2i and 2i + 1 on the next; leaves are the last level."""

    def __init__(self, x, y, n, scales) -> None:
        m = len(x)
        self.scales = scales
        self.depth = max(0, int(math.log2(m / LEAF))) if m else 0
        ranks = np.empty((2, m), np.int64)
        for rank, v in zip(ranks, (x, y)):
            rank[np.argsort(v)] = np.arange(m)
        order, starts = np.arange(m), np.array([0, m])
        for _ in range(self.depth):
            sizes, at = np.diff(starts), starts[:-1]
            spread = [
                (np.maximum.reduceat(v[order], at) - np.minimum.reduceat(v[order], at)) / scale
                for v, scale in zip((x, y), scales)
            ]
            node = np.repeat(np.arange(len(sizes)), sizes)
            side = (spread[1] > spread[0]).astype(np.int64)[node]
            order = order[np.argsort(node * m + ranks[side, order])]
            halved = np.empty(2 * len(sizes) + 1, np.int64)
            halved[::2], halved[1::2] = starts, at + sizes // 2
            starts = halved
        sizes = np.diff(starts)
        self.leaf = np.empty(m, np.int64)  # of every point
        self.leaf[order] = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.empty(m, np.int64)  # in its leaf
        self.place[order] = np.arange(m) - np.repeat(starts[:-1], sizes)
        shape = len(sizes), max(1, sizes.max())
        self.x, self.y = np.full(shape, np.inf), np.full(shape, np.inf)
        self.n = np.zeros(shape, np.int64)
        for held, v in ((self.x, x), (self.y, y), (self.n, n)):
            held[self.leaf, self.place] = v
        taken = np.arange(shape[1]) < sizes[:, None]
        boxes = [
            np.stack([
                self.x.min(1), np.where(taken, self.x, -np.inf).max(1),
                self.y.min(1), np.where(taken, self.y, -np.inf).max(1),
            ])
        ]
        for _ in range(self.depth):
            low, high = boxes[0][:, ::2], boxes[0][:, 1::2]
            boxes.insert(0, np.where(
                [[True], [False], [True], [False]], np.minimum(low, high), np.maximum(low, high)
            ))
        self.boxes = boxes

    def gap(self, level: int, node, qx, qy) -> np.ndarray:
        """Least distance of queries to what is in a node."""
        x_low, x_high, y_low, y_high = self.boxes[level][:, node]
        x = np.maximum(np.maximum(x_low - qx, qx - x_high), 0.0) / self.scales[0]
        y = np.maximum(np.maximum(y_low - qy, qy - y_high), 0.0) / self.scales[1]
        return np.maximum(x, y)

    def distances(self, leaf, qx, qy) -> np.ndarray:
        d = np.abs(self.x[leaf] - qx[:, None])
        d /= self.scales[0]
        e = np.abs(self.y[leaf] - qy[:, None])
        e /= self.scales[1]
        return np.maximum(d, e, out=d)

    def closest_leaf(self, qx, qy) -> np.ndarray:
        node = np.zeros(len(qx), np.int64)
        for level in range(1, self.depth + 1):
            low, high = 2 * node, 2 * node + 1
            node = low + (self.gap(level, high, qx, qy) < self.gap(level, low, qx, qy))
        return node


def nearest(leaves: Leaves, qx, qy, wanted: int, bound=None):
    """(distances, rows at them, radius): points enough to hold the `wanted` nearest rows of every
    query, and the distance to the last of these; infinite if there are fewer. The queries are the
    points of the leaves, and not their own neighbours; or, with a `bound` for each, others,
    of which points at or beyond the bound are not needed. A query starts in its
    leaf and looks at the other side of every cut above it, the lowest first."""
    most = wanted + (bound is None)
    many_queries = 50_000
    if len(qx) > many_queries and bound is not None:
        parts = [
            nearest(leaves, qx[i : i + many_queries], qy[i : i + many_queries], wanted, bound[i : i + many_queries])
            for i in range(0, len(qx), many_queries)
        ]
        return tuple(np.concatenate(part) for part in zip(*parts))
    away = np.full((len(qx), most), np.inf)
    many = np.zeros((len(qx), most), np.int64)
    radius = np.full(len(qx), np.inf) if bound is None else bound.copy()
    start = leaves.leaf if bound is None else leaves.closest_leaf(qx, qy)

    def look(rows: np.ndarray, leaf: np.ndarray, own: bool = False) -> None:
        d, n = leaves.distances(leaf, qx[rows], qy[rows]), leaves.n[leaf]
        if own:
            n[np.arange(len(rows)), leaves.place[rows]] -= 1
        d = np.hstack([away[rows], d])
        n = np.hstack([many[rows], n])
        best = np.argsort(d, axis=1)[:, :most]
        away[rows] = d = np.take_along_axis(d, best, 1)
        many[rows] = n = np.take_along_axis(n, best, 1)
        enough = np.cumsum(n, axis=1) >= wanted
        last = d[np.arange(len(d)), enough.argmax(axis=1)]
        radius[rows] = np.where(enough[:, -1], np.minimum(last, radius[rows]), radius[rows])

    look(np.arange(len(qx)), start, bound is None)
    for level in range(leaves.depth, 0, -1):
        rows, node = np.arange(len(qx)), (start >> (leaves.depth - level)) ^ 1
        for below in range(level, leaves.depth + 1):
            if below > level:
                rows, node = np.repeat(rows, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            gap = leaves.gap(below, node, qx[rows], qy[rows])
            near = gap < radius[rows]
            rows, node, gap = rows[near], node[near], gap[near]
        order = np.lexsort((gap, rows))
        rows, node, gap = rows[order], node[order], gap[order]
        while len(rows):
            first = np.ones(len(rows), bool)
            first[1:] = rows[1:] != rows[:-1]
            look(rows[first], node[first])
            left = ~first & (gap < radius[rows])
            rows, node, gap = rows[left], node[left], gap[left]
    return away, many, radius


# --- borders of one direction ------------------------------------------------------------


def _as_order(v: np.ndarray) -> np.ndarray:
    """Whole numbers ordered as the doubles are; its own inverse on their bits."""
    bits = np.ascontiguousarray(v, float).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _as_double(order: np.ndarray) -> np.ndarray:
    return np.where(order < 0, np.int64(-(2**63)) - order, order).view(np.float64)


def upper_border(v: np.ndarray, radius: np.ndarray, scale: float) -> np.ndarray:
    """The least number whose rounded distance from v is `radius` or more, so that a value is
    closer than the radius exactly if it is below this border."""
    infinite = _as_order(np.array([np.inf]))[0]
    v = np.ascontiguousarray(v, float)

    def far(order, rows) -> np.ndarray:
        return (_as_double(order) - v[rows]) / scale >= radius[rows]

    # Nearly always it is within a few numbers of the sum.
    every = np.arange(len(v))
    least, guess = _as_order(v), _as_order(v + radius * scale)
    low = np.maximum(np.minimum(guess, infinite - 3) - 3, least)  # closer, if the radius is above zero
    high = np.minimum(guess, infinite - 3) + 3
    low = np.where(far(low, every), least, low)
    high = np.where(far(high, every), high, infinite)
    rows = every
    while len(rows):
        a, b = low[rows], high[rows]
        middle = (a >> 1) + (b >> 1) + (a & b & 1)
        beyond = far(middle, rows)
        high[rows], low[rows] = np.where(beyond, middle, b), np.where(beyond, a, middle)
        rows = rows[(middle != a) & (middle != b)]
    return np.where(radius > 0, _as_double(high), v)


def _digamma(n: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1, as `digamma` of columns."""
    z = n + 8.0
    s = 1 / (z * z)
    series = np.log(z) - 0.5 / z - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    for j in range(8):
        series -= 1 / (n + float(j))
    return series


# --- on Spark ------------------------------------------------------------------------------


def _points(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(f, y, x, n): the different pairs of every feature, which goes by its number."""
    entries = [
        F.struct(
            F.lit(i).alias("f"),
            (F.col(target).cast("double") + F.lit(0.0)).alias("y"),
            (F.col(c).cast("double") + F.lit(0.0)).alias("x"),
        )
        for i, c in enumerate(columns)
    ]
    largest = F.lit(math.inf)
    return (
        df.select(F.inline(F.array(*entries)))
        .where((F.abs("x") < largest) & (F.abs("y") < largest))  # neither null, nor NaN
        .groupBy("f", "y", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _features(points: DataFrame) -> dict[int, dict]:
    """Rows, different pairs and scales of every feature with two rows or more. Scales have
    ten digits, so that they don't depend on the order of addition."""
    n = F.col("n").cast("double")
    sizes = points.groupBy("f").agg(
        F.sum("n").alias("rows"), F.count("n").alias("pairs"),
        *((F.sum(n * F.col(c)) / F.sum(n)).alias(f"mean_{c}") for c in "xy"),
    )
    means = sizes.withColumnRenamed("f", "_of")
    spreads = (
        points.join(F.broadcast(means), F.col("f") == F.col("_of"))
        .groupBy("f", "rows", "pairs")
        .agg(
            *(
                F.sqrt(F.sum(n * (F.col(c) - F.col(f"mean_{c}")) ** 2) / F.sum(n)).alias(c)
                for c in "xy"
            )
        )
    )
    found = {}
    for r in spreads.where("rows > 1").collect():
        scales = tuple(
            s if 0 < s < math.inf else 1.0 for s in (float(f"{r[c]:.10g}") for c in "xy")
        )
        found[r["f"]] = {"rows": r["rows"], "pairs": r["pairs"], "scales": scales}
    return found


def parts_of(v: np.ndarray, pairs: int, rows_per_part: int) -> tuple[np.ndarray, np.ndarray]:
    """(borders, turns): parts of one direction from a sample `v` of its values, and how often
    each is given out. A part holds what is above the border before it, up to its own."""
    wanted = min(MOST_CELLS, -(-pairs // rows_per_part))
    v = np.sort(v)
    borders = np.unique(v[np.arange(1, wanted) * len(v) // wanted])
    borders = borders[borders < v[-1]]
    borders = _between(borders, v[np.searchsorted(v, borders, "right")])
    held = np.bincount(np.searchsorted(borders, v), minlength=len(borders) + 1) * pairs / len(v)
    turns = np.maximum(1, np.ceil(held / (2 * rows_per_part))).astype(np.int64)
    return borders, turns


def _trees(
    points: DataFrame, features: dict[int, dict], rows_per_cell: int
) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """The tree of cells of every feature, and its parts in either direction (2f and 2f + 1),
    each made in one task from a bounded sample."""
    depths = {}
    for name, f in features.items():
        cells = min(MOST_CELLS, -(-f["pairs"] // rows_per_cell))
        depths[name] = math.ceil(math.log2(cells)) if cells > 1 else 0
    large = {name: depth for name, depth in depths.items() if depth}
    trees = {name: (np.array([-1], np.int8), np.zeros(1)) for name in features}
    parts = {2 * f + i: (np.zeros(0), np.ones(1, np.int64)) for f in features for i in (0, 1)}
    if not large:
        return trees, parts
    buckets = 1_000_000
    chosen = [
        math.ceil(buckets * min(1.0, SAMPLED_PER_CELL * 2 ** large[f] / features[f]["pairs"]))
        if f in large
        else 0
        for f in range(max(large) + 1)
    ]
    sample = points.where(
        F.pmod(F.xxhash64("x", "y"), F.lit(buckets)) < F.get(F.lit(chosen), F.col("f"))
    )

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"])
        name = int(rows["f"].iloc[0])
        x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        found = [
            *cell_tree(x, y, *features[name]["scales"], large[name]),
            *parts_of(x, features[name]["pairs"], CELLS_PER_PART * rows_per_cell),
            *parts_of(y, features[name]["pairs"], CELLS_PER_PART * rows_per_cell),
        ]
        return pd.DataFrame({"f": [name], "found": [[v.tobytes() for v in found]]})

    grown = sample.select("f", "y", "x").groupBy("f").applyInPandas(grow, "f int, found array<binary>")
    kinds = [np.int8, np.float64, np.float64, np.int64, np.float64, np.int64]
    for r in grown.collect():
        found = [np.frombuffer(v, kind) for v, kind in zip(r["found"], kinds)]
        trees[r["f"]] = found[0], found[1]
        parts[2 * r["f"]], parts[2 * r["f"] + 1] = tuple(found[2:4]), tuple(found[4:])
    return trees, parts


def number_information(
    df: DataFrame,
    columns: list[str],
    target: str,
    neighbours: int = NEIGHBOURS,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """(feature, score) for a numeric target."""
    if neighbours < 1 or rows_per_cell < 1:
        raise ValueError("there must be at least one neighbour, and one row in a cell")
    found = [
        _of_group(df, group, target, neighbours, rows_per_cell)
        for group in column_groups(list(columns))
    ]
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "_named string")
    return names.join(union_all(found), F.col("_named") == F.col("feature"), "left").select(
        F.col("_named").alias("feature"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def _numbers(rows: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy() if isinstance(rows, pa.Table) else rows[c].to_numpy(False) for c in names]


def _by_feature(batch: pa.RecordBatch, f: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    names = np.unique(f).tolist()
    for name in names:
        yield name, batch.filter(pa.array(f == name)) if len(names) > 1 else batch


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One list a row, of so many of the values."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = pa.array(values)
    return pa.ListArray.from_arrays(
        pa.array(offsets), values, type=pa.list_(pa.field("element", values.type))
    )


def _of_group(
    df: DataFrame, columns: list[str], target: str, k: int, rows_per_cell: int
) -> DataFrame:
    points = saved(_points(df, columns, target))
    spark = points.sparkSession
    features = _features(points)
    if not features:
        return spark.createDataFrame([], "feature string, score double")
    trees, parts = _trees(points, features, rows_per_cell)
    sent = spark.sparkContext.broadcast((features, trees, parts))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, trees, _ = sent.value
        for batch in batches:
            for f, rows in _by_feature(batch, *_numbers(batch, "f")):
                if f in features:
                    cell = cell_of(trees[f], *_numbers(rows, "x", "y")) + (f << PLACES)
                    yield rows.select(["y", "x", "n"]).append_column("cell", pa.array(cell))

    def at_home(rows: pa.Table) -> pa.Table:
        features, trees, _ = sent.value
        f, cell = divmod(rows["cell"][0].as_py(), 1 << PLACES)
        x, y, n = _numbers(rows, "x", "y", "n")
        scales, wanted = features[f]["scales"], min(k, features[f]["rows"] - 1)
        away, many, radius = nearest(Leaves(x, y, n, scales), x, y, wanted)
        near_border = np.flatnonzero(reaching_over(trees[f], cell, x, y, radius, scales))
        row, other = cells_reached(
            trees[f], x[near_border], y[near_border], radius[near_border], scales
        )
        row, other = near_border[row[other != cell]], other[other != cell]
        others = np.bincount(row, minlength=len(x))
        reaching = others > 0
        kept = np.where(reaching, away.shape[1], 0)
        further = other[np.argsort(row, kind="stable")] + (f << PLACES)
        for name, column in (
            ("radius", pa.array(radius)),
            ("away", _lists(away[reaching].ravel(), kept)),
            ("many", _lists(many[reaching].ravel(), kept)),
            ("further", _lists(further, others)),
        ):
            rows = rows.append_column(name, column)
        return rows

    # Few bytes, but much work: a stated number of tasks is not merged by their size.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = sum(int((sides < 0).sum()) for sides, _ in trees.values())
    tasks = max(least, cells // CELLS_PER_TASK)
    point = "y double, x double, n long, cell long"
    home = saved(
        points.mapInArrow(placed, point).repartition(tasks, "cell").groupBy("cell").applyInArrow(
            at_home,
            f"{point}, radius double, away array<double>, many array<long>, further array<long>",
        )
    )
    reaching = home.where(F.size("further") > 0)
    candidates = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("away", "many"))))
    wanted = F.lit([min(k, features[f]["rows"] - 1) if f in features else 0 for f in range(len(columns))])
    reached = F.aggregate(
        "found",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(math.inf).alias("at")),
        lambda so_far, c: F.struct(
            (so_far["seen"] + c["many"]).alias("seen"),
            F.when(so_far["seen"] < F.col("wanted"), c["away"]).otherwise(so_far["at"]).alias("at"),
        ),
    )["at"]
    settled = (
        reaching.select(*POINT, "n", "away", "many")
        .union(_visits(home, reaching, sent, k, tasks))
        .groupBy(*POINT)
        .agg(F.sum("n").alias("n"), candidates.alias("found"))
        .withColumn("wanted", F.get(wanted, F.shiftright("cell", PLACES).cast("int")))
        .select(*POINT, "n", reached.alias("radius"))
    )
    near = home.where(F.size("further") == 0).select(*POINT, "n", "radius").union(settled)
    return _scores(points, near, columns, features, sent, wanted, least)


def _visits(home: DataFrame, reaching: DataFrame, sent, k: int, tasks: int) -> DataFrame:
    """(cell, y, x, n, away, many): what rows find in the other cells that they reach; n is 0."""
    guests = reaching.select(*POINT, "radius", F.explode("further").alias("at"))
    turns = saved(
        guests.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / VISITS_PER_TASK).alias("turns"))
    )

    def visit(turn: Column) -> Column:
        return (F.shiftleft("at", TURNS) + turn).alias("visit")

    guests = guests.join(F.broadcast(turns), "at").select(
        visit(F.pmod(F.xxhash64("x", "y"), F.col("turns"))), *POINT,
        F.lit(0).cast("long").alias("n"), "radius",
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))
    hosts = (
        home.join(F.broadcast(turns), F.col("cell") == F.col("at"))
        .select("at", *POINT, "n", every.alias("turn"))
        .select(visit(F.col("turn")), *POINT, "n", F.lit(0.0).alias("radius"))
    )

    def look_around(rows: pa.Table) -> pa.Table:
        features, _, _ = sent.value
        f = rows["visit"][0].as_py() >> (PLACES + TURNS)
        x, y, n, radius = _numbers(rows, "x", "y", "n", "radius")
        guest, here = n == 0, n > 0
        leaves = Leaves(x[here], y[here], n[here], features[f]["scales"])
        away, many, _ = nearest(
            leaves, x[guest], y[guest], min(k, features[f]["rows"] - 1), radius[guest]
        )
        some = away < math.inf
        found = rows.select([*POINT, "n"]).filter(pa.array(guest))
        return found.append_column("away", _lists(away[some], some.sum(1))).append_column(
            "many", _lists(many[some], some.sum(1))
        )

    met = guests.union(hosts).repartition(tasks, "visit")
    return met.groupBy("visit").applyInArrow(
        look_around, "cell long, y double, x double, n long, away array<double>, many array<long>"
    )


# A record of a part: a row counted and asking here; one only counted here; one end of the
# interval of a row, whose other end is elsewhere.
ASKS, COUNTS, ENDS = 0, 1, 2
RECORD = "part long, role int, v double, w double, low double, high double, n long"
# What a part yields: a sum of terms; its number of rows; how many rows are before an end.
TERMS, ROWS, BEFORE = 0, 1, 2


def _turn(w: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Which time a part is given out, by the other direction's value."""
    mixed = w.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % turns.astype(np.uint64)).astype(np.int64)


def records(line: int, v, w, radius, n, scale: float, borders, turns) -> pa.RecordBatch:
    """The records of rows in one direction."""
    low, high = -upper_border(-v, radius, scale), upper_border(v, radius, scale)
    part, first, last = (np.searchsorted(borders, at) for at in (v, low, high))
    over = np.flatnonzero((first < part) | (last > part))
    inside = np.ones(len(v), bool)
    inside[over] = False
    inside = np.flatnonzero(inside)
    alone = over[turns[part[over]] == 1]  # elsewhere, a part's values come by themselves
    rows = np.concatenate([inside, alone, over, over])
    sizes = len(inside), len(alone), len(over), len(over)
    to = np.concatenate([part[inside], part[alone], first[over], last[over]])
    low = np.concatenate([low[inside], low[alone], low[over], high[over]])
    side = np.repeat([-1.0, 1.0], len(over))
    high = np.concatenate([high[inside], high[alone], side])
    v, w, n = v[rows], w[rows], n[rows]
    to = (((line << PLACES) + to) << TURNS) + _turn(w, turns[to])
    role = np.repeat(np.array([ASKS, COUNTS, ENDS, ENDS], np.int32), sizes)
    columns = dict(part=to, role=role, v=v, w=w, low=low, high=high, n=n)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], [*columns])


def counted(rows: pa.Table, turns: dict[int, np.ndarray]) -> pa.Table:
    """What one part yields. One that is given out several times has its values as records
    that are only counted."""
    place, turn = divmod(rows["part"][0].as_py(), 1 << TURNS)
    line, part = divmod(place, 1 << PLACES)
    shared = turns[line][part] > 1
    role, v, w, low, high, n = _numbers(rows, "role", "v", "w", "low", "high", "n")
    hosts = role == COUNTS if shared else role != ENDS
    order = np.argsort(v[hosts])
    values = v[hosts][order]
    before = np.concatenate([[0], np.cumsum(n[hosts][order])])

    def rank(at: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How many are below, or up to, a number."""
        places = np.where(
            upto, np.searchsorted(values, at, "right"), np.searchsorted(values, at, "left")
        )
        return before[places]

    asks, ends = role == ASKS, role == ENDS
    apart = high[asks] > low[asks]
    inside = rank(high[asks], ~apart) - rank(low[asks], apart)
    terms = float((n[asks] * _digamma(inside)).sum())
    size = int(ends.sum())
    whole = int(before[-1]) if turn == 0 else 0
    found = {
        "kind": np.concatenate([[TERMS, ROWS], np.full(size, BEFORE)]).astype(np.int32),
        "v": np.concatenate([[0.0, 0.0], v[ends]]),
        "w": np.concatenate([[0.0, 0.0], w[ends]]),
        "n": np.concatenate([[0, 0], n[ends]]),
        "sign": np.concatenate([[0, 0], high[ends].astype(np.int64)]),
        "rows": np.concatenate([[0, whole], rank(low[ends], high[ends] < 0)]).astype(np.int64),
        "terms": np.concatenate([[terms, 0.0], np.zeros(size)]),
    }
    total = size + 2
    return pa.table({
        "line": np.full(total, line, np.int32),
        "part": np.full(total, part, np.int64),
        **found,
    })


def _scores(
    points: DataFrame, near: DataFrame, columns: list[str], features: dict, sent, wanted, least: int
) -> DataFrame:
    """(feature, score) from every row's distance to its k-th neighbour."""
    _, _, parts = sent.value

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, _, parts = sent.value
        for batch in batches:
            (cell,) = _numbers(batch, "cell")
            for f, rows in _by_feature(batch, cell >> PLACES):
                x, y, n, radius = _numbers(rows, "x", "y", "n", "radius")
                for line, v, w, scale in zip((2 * f, 2 * f + 1), (x, y), (y, x), features[f]["scales"]):
                    yield records(line, v, w, radius, n, scale, *parts[line])

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, parts = sent.value
        for batch in batches:
            for f, rows in _by_feature(batch, *_numbers(batch, "f")):
                for line, name in ((2 * f, "x"), (2 * f + 1, "y")):
                    borders, turns = parts[line]
                    v, n = _numbers(rows, name, "n")
                    part = np.searchsorted(borders, v)
                    many = turns[part] > 1
                    place = (line << PLACES) + part
                    columns = dict(place=place, turns=turns[part], v=v, n=n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[many]) for c in columns.values()], [*columns]
                    )

    def count(rows: pa.Table) -> pa.Table:
        _, _, parts = sent.value
        return counted(rows, {line: turns for line, (_, turns) in parts.items()})

    asked = near.mapInArrow(dealt, RECORD)
    shared = sorted({line >> 1 for line, (_, turns) in parts.items() if turns.max() > 1})
    if shared:
        nothing = F.lit(None).cast("double")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))
        values = (
            points.where(F.col("f").isin(shared))
            .mapInArrow(crowded, "place long, turns long, v double, n long")
            .groupBy("place", "turns", "v").agg(F.sum("n").alias("n"))
            .select("place", "v", "n", every.alias("turn"))
            .select(
                (F.shiftleft("place", TURNS) + F.col("turn")).alias("part"), F.lit(COUNTS).alias("role"),
                "v", nothing.alias("w"), nothing.alias("low"), nothing.alias("high"), "n",
            )
        )
        asked = asked.union(values)
    tasks = max(least, sum(int(turns.sum()) for _, turns in parts.values()))
    found = saved(
        asked.repartition(tasks, "part").groupBy("part").applyInArrow(
            count,
            "line int, part long, kind int, v double, w double, n long, sign long, rows long, "
            "terms double",
        )
    )
    sizes = found.where(F.col("kind") == ROWS).groupBy("line", "part").agg(F.sum("rows").alias("size"))
    earlier = Window.partitionBy("line").orderBy("part")  # one row per part
    offsets = sizes.select("line", "part", (F.sum("size").over(earlier) - F.col("size")).alias("before"))
    ends = (
        found.where(F.col("kind") == BEFORE)
        .join(F.broadcast(offsets), ["line", "part"])
        .groupBy("line", "v", "w")
        .agg(
            F.sum(F.col("sign") * (F.col("before") + F.col("rows"))).alias("inside"),
            F.max("n").cast("double").alias("n"),
        )
        .select("line", (F.col("n") * digamma(F.col("inside"))).alias("terms"))
    )
    total = F.get(
        F.lit([features[f]["rows"] if f in features else 0 for f in range(len(columns))]), F.col("f")
    )
    score = digamma(total) + digamma(F.get(wanted, F.col("f"))) - F.col("terms") / total
    return (
        found.where(F.col("kind") == TERMS).select("line", "terms").union(ends)
        .groupBy(F.shiftright("line", 1).alias("f")).agg(F.sum("terms").alias("terms"))
        .select(
            F.get(F.lit(list(columns)), F.col("f")).alias("feature"),
            F.greatest(score, F.lit(0.0)).alias("score"),
        )
    )
