"""How much each feature moves a tree model's score, row by row (Shapley values).

A row's score is shared out over the features by the tree-path rule: a feature that is not
known follows both branches in proportion to the training rows there. The sum over all sets of
known features is an integral over t from 0 to 1: on a path, every feature stands for a factor
(1 - t) * share + t * follows, and Gauss-Legendre nodes integrate the product exactly. What a
leaf adds depends only on which of its path's features follow, so where paths have few features
it is worked out once for every such pattern, and rows look it up by their pattern. Where paths
have many, a tree is walked once per block of rows, carrying that product for every row and
node; coming back up, the sum below an edge, without what hangs below a deeper edge of the same
feature, is divided by the edge's factor. That is linear in the tree's edges and in the number
of features on a path.

The trees travel to the tasks as a broadcast; every task attributes its own rows.

Defined cases. Missing values and unknown levels follow the model's branches. A tree of one
leaf moves nothing. Several classes: one attribution per class. An empty table gives no rows
per row, and no features in the summary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from paneloom.operators.boosting import Tree
from paneloom.operators.correlation import NO_SPREAD
from paneloom.operators.trees import TreeModel, _blocks, _lists, _matrix

#: Rows that are walked through a tree together.
BLOCK = 32_768
#: Features on a path up to which a leaf's attributions are looked up by pattern.
PATTERN_FEATURES = 6

_SUMS = ["n", "absolute", "known", "phi", "phi2", "x", "x2", "x_phi"]


def depth_in_features(tree: Tree) -> int:
    """The most different features on a path of the tree."""
    most, waiting = 0, [(0, frozenset())]
    while waiting:
        node, seen = waiting.pop()
        most = max(most, len(seen))
        if tree.feature[node] >= 0:
            seen = seen | {tree.feature[node]}
            waiting += [(tree.left[node], seen), (tree.right[node], seen)]
    return most


def leaf_patterns(value: float, shares: np.ndarray) -> np.ndarray:
    """What a leaf adds to each feature on its path (rows) in every pattern (columns): bit i
    says that feature i follows the path, `shares` are those of the features' edges."""
    n = len(shares)
    at, weights = np.polynomial.legendre.leggauss((n + 1) // 2)
    t = ((at + 1) / 2)[:, None, None]
    follows = (np.arange(1 << n) >> np.arange(n)[:, None]) & 1
    factors = (1 - t) * shares[:, None] + t * follows
    out = np.empty((n, 1 << n))
    for i in range(n):
        others = np.delete(factors, i, axis=1).prod(axis=1)
        out[i] = value * (follows[i] - shares[i]) * (weights[:, None] / 2 * others).sum(axis=0)
    return out


def _by_pattern(tree: Tree, columns: np.ndarray, out: np.ndarray) -> None:
    def walk(node: int, pattern: np.ndarray, path: dict) -> None:
        """`path` has the share of each feature so far, in the order of the pattern's bits."""
        feature = tree.feature[node]
        if feature < 0:
            adds = leaf_patterns(tree.value[node], np.array(list(path.values())))
            place = pattern.astype(np.intp)
            for f, of_pattern in zip(path, adds):
                out[f] += of_pattern.take(place)
            return
        left = tree.goes_left(node, columns[feature])
        known = feature in path
        bit = list(path).index(feature) if known else len(path)
        for child, taken in ((tree.left[node], left), (tree.right[node], ~left)):
            share = path.get(feature, 1.0) * tree.cover[child] / tree.cover[node]
            follows = taken.view(np.uint8) << np.uint8(bit)
            if known:
                below = pattern & (follows | np.uint8(255 ^ (1 << bit)))
            else:
                below = pattern | follows
            walk(child, below, {**path, feature: share})

    walk(0, np.zeros(columns.shape[1], np.uint8), {})


def shapley(tree: Tree, bins: np.ndarray, out: np.ndarray) -> None:
    """Adds the tree's attributions of the rows to `out`, features x rows."""
    features = depth_in_features(tree)
    if not features:
        return
    columns = np.ascontiguousarray(bins.T)
    if features <= PATTERN_FEATURES:
        _by_pattern(tree, columns, out)
    else:
        _by_walk(tree, columns, out, features)


def _by_walk(tree: Tree, columns: np.ndarray, out: np.ndarray, features: int) -> None:
    at, weights = np.polynomial.legendre.leggauss((features + 1) // 2)
    t, weights = ((at + 1) / 2)[:, None], (weights / 2)[:, None]
    ones = np.ones((len(t), columns.shape[1]))

    def walk(node: int, product: np.ndarray, on_path: dict) -> tuple[np.ndarray, dict]:
        """Sums below a node of value times product, in all and below the topmost edges of
        each feature. `on_path` has (follows, share, factor) of the features so far."""
        feature = tree.feature[node]
        if feature < 0:
            return tree.value[node] * product, {}
        goes_left = tree.goes_left(node, columns[feature])
        above = on_path.get(feature)
        whole, edges = 0.0, {}
        for child, taken in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
            share = tree.cover[child] / tree.cover[node]
            if above is None:
                follows, before = taken, ones
            else:
                follows, share, before = above[0] & taken, above[1] * share, above[2]
            factor = (1 - t) * share + t * follows
            below, deeper = walk(
                child, product * (factor / before), {**on_path, feature: (follows, share, factor)}
            )
            own = below - deeper.pop(feature) if feature in deeper else below
            out[feature] += (follows - share) * (weights * own / factor).sum(axis=0)
            whole = whole + below
            for f, total in deeper.items():
                edges[f] = edges[f] + total if f in edges else total
        edges[feature] = whole
        return whole, edges

    walk(0, ones, {})


def _attributed(trees: list[list[Tree]], bins: np.ndarray, wide: int, k: int) -> np.ndarray:
    """Rows x features attributions to class `k`."""
    out = np.zeros((wide, len(bins)))
    for at in range(0, len(bins), BLOCK):
        for of_round in trees:
            shapley(of_round[k], bins[at : at + BLOCK], out[:, at : at + BLOCK])
    return out.T


def row_attributions(rows: DataFrame, model: TreeModel, keep: list[str]) -> DataFrame:
    """`keep`, `class` (its place among the model's classes, 1 of two, 0 for a number), `rest`,
    the margin without any feature, and `phi`, the features' attributions in the model's
    order; with `rest` they add up to the margin."""
    wide = len(model.encoding.features)
    encoded = model.encoding.apply(rows, {"row": F.struct(*keep)})
    classes = len(model.trees[0]) if model.trees else 1
    expected = [
        start + sum(_expected(of_round[k]) for of_round in model.trees)
        for k, start in enumerate(model.start)
    ]
    sent = rows.sparkSession.sparkContext.broadcast(model.trees)
    first = 1 if model.task == "binary" else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in _blocks(batches, BLOCK):
            bins = _matrix(batch["bins"])
            for k in range(classes):
                n = len(bins)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row"],
                        pa.array(np.full(n, k + first, "int32")),
                        pa.array(np.full(n, expected[k])),
                        _lists(_attributed(trees, bins, wide, k)),
                    ],
                    ["row", "class", "rest", "phi"],
                )

    schema = T.StructType(
        [
            encoded.schema["row"],
            T.StructField("class", T.IntegerType()),
            T.StructField("rest", T.DoubleType()),
            T.StructField("phi", T.ArrayType(T.DoubleType())),
        ]
    )
    return encoded.mapInArrow(run, schema).select("row.*", "class", "rest", "phi")


def _expected(tree: Tree) -> float:
    """The tree's value when no feature is known."""
    share, total = {0: 1.0}, 0.0
    for node in range(len(tree.feature)):  # parents come before their children
        if tree.feature[node] < 0:
            total += share[node] * tree.value[node]
            continue
        for child in (tree.left[node], tree.right[node]):
            share[child] = share[node] * tree.cover[child] / tree.cover[node]
    return total


def attribution(rows: DataFrame, model: TreeModel, of_class: int = 1) -> DataFrame:
    """(feature, mean_abs, direction): mean absolute attribution, and its correlation with
    the feature's value (positive: high values raise the score) over rows where it is known.
    The value of a category is its level's place in sorted order. Of several classes, that of
    `of_class`."""
    spark = rows.sparkSession
    names = model.encoding.features
    wide, of_class = len(names), of_class if model.task == "multiclass" else 0
    values = [
        F.lit(0.0) if f in model.encoding.levels else F.col(f).cast("double") for f in names
    ]
    encoded = model.encoding.apply(rows, {"x": F.array(*values)})
    sent = spark.sparkContext.broadcast(model.trees)
    coded = [i for i, f in enumerate(names) if f in model.encoding.levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_SUMS), wide))
        for batch in _blocks(batches, BLOCK):
            if batch.num_rows == 0:
                continue
            bins = _matrix(batch["bins"])
            phi = _attributed(sent.value, bins, wide, of_class)
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float)
            x = x.reshape(batch.num_rows, -1).copy()
            x[:, coded] = bins[:, coded]
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            seen = np.where(known, phi, 0.0)
            total += np.stack(
                [
                    np.full(wide, float(len(x))), np.abs(phi).sum(0), known.sum(0), seen.sum(0),
                    (seen * seen).sum(0), x.sum(0), (x * x).sum(0), (x * seen).sum(0),
                ]
            )
        if total[0].any():
            ids = pa.array(np.arange(wide, dtype="int32"))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, total)], names=["id", *_SUMS])

    parts = encoded.mapInArrow(run, "id int, " + ", ".join(f"{s} double" for s in _SUMS))
    total = parts.groupBy("id").agg(*(F.sum(s).alias(s) for s in _SUMS))
    n = F.col("known")

    def spread(first: str, second: str):
        scaled = n * F.col(second)
        value = scaled - F.col(first) * F.col(first)
        return F.when(value > scaled * NO_SPREAD, value)

    cross = n * F.col("x_phi") - F.col("x") * F.col("phi")
    features = spark.createDataFrame(list(enumerate(names)), "id int, feature string")
    return features.join(total, "id").select(
        "feature",
        (F.col("absolute") / F.col("n")).alias("mean_abs"),
        (cross / F.sqrt(spread("x", "x2")) / F.sqrt(spread("phi", "phi2"))).alias("direction"),
    )
