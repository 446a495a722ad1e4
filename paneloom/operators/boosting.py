"""Growing and applying boosted trees over binned columns, as one task sees them.

A tree is grown leaf by leaf, the leaf with the largest gain first. Every task holds some
rows; what it knows of a leaf is a histogram of gradients, hessians and rows per bin, and only
the sum of all tasks' histograms decides. Every task adds up the bins of its share of the
features and searches them; the tasks tell each other the best splits they found, so all grow
the same tree. Only the smaller child of a split is counted, the other is the difference to the
parent. All leaves that may still be split, as far as is known, are counted together, those below
a split that is still to come among them, so a tree takes about as many exchanges as it is deep,
not one per leaf; which leaves are split in the end does not depend on that.

Beside its rows' bins a task holds their gradients and hessians and one list of row numbers, in
which every leaf is a stretch that is parted in place. Rows are counted and parted some at a time,
so what a tree needs on top does not grow with the rows.

Numbers are cut into bins at borders; bin 0 is for missing values, which go to the side with
the larger gain. The levels of a category are ordered by gradient over hessian in every leaf
and cut there, from either end, at most `most_levels` on the side that is named, under a
penalty of its own; a category with few levels in a leaf is cut one level against the rest.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Bytes of histograms that are counted in one pass.
PASS_BYTES = 64 << 20
#: Bytes of histograms that are searched at a time.
FIND_BYTES = 4 << 20
#: Rows that are counted or parted at a time.
SOME_ROWS = 1 << 16
TINY = 1e-300
#: Categories with up to this many levels in a leaf are cut one level against the rest.
FEW_LEVELS = 4


@dataclass(frozen=True)
class Growth:
    """What a tree may look like."""

    leaves: int = 127
    min_rows: int = 20
    min_hessian: float = 1e-3
    smooth: float = 10.0  # added to the hessian where levels are ordered
    penalty: float = 10.0  # added to the hessian in the gain of a cut of ordered levels
    most_levels: int = 32


@dataclass
class Tree:
    """Nodes in parallel lists; a leaf has no feature (-1). Numbers go left up to `border`
    (a bin), missing ones as `missing_left` says; categories go left if their code is in
    `levels`. `cover` is the number of training rows."""

    feature: list[int] = field(default_factory=list)
    border: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    levels: list[tuple[int, ...] | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, v in (("feature", -1), ("border", 0), ("missing_left", False), ("levels", None),
                        ("left", -1), ("right", -1), ("value", value), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def goes_left(self, node: int, codes: np.ndarray) -> np.ndarray:
        """Where the codes of the node's feature go."""
        if self.levels[node] is not None:
            named = np.zeros(max(self.levels[node]) + 2, bool)
            named[list(self.levels[node])] = True
            return named.take(codes, mode="clip")
        if self.missing_left[node]:
            return codes <= self.border[node]
        return (codes <= self.border[node]) & (codes > 0)

    def leaves(self, bins: np.ndarray, rows: np.ndarray):
        """(leaf, those of the rows that are in it)"""
        waiting = [(0, rows)]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if self.feature[node] < 0:
                yield node, rows
                continue
            left = self.goes_left(node, bins[:, self.feature[node]].take(rows))
            waiting.append((self.left[node], rows[left]))
            waiting.append((self.right[node], rows[~left]))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins), np.int32)
        for node, rows in self.leaves(bins, np.arange(len(bins))):
            out[rows] = node
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


def _score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.divide(g * g, h, out=np.zeros(np.broadcast(g, h).shape), where=h > 0)


@dataclass
class _Leaf:
    begin: int  # its rows' stretch
    end: int
    histogram: np.ndarray | None  # (gradient, hessian, rows) by bin of the task's features
    total: np.ndarray
    node: int
    gain: float = 0.0
    split: tuple | None = None
    children: tuple | None = None


class Alone:
    """The exchange of a single task."""

    tasks, own = 1, 0

    def summed(self, parts: list[np.ndarray]) -> np.ndarray:
        """The sum of what all tasks have for this one; a part for each task."""
        return parts[0]

    def told(self, message) -> list:
        """The messages of all tasks."""
        return [message]


def _some_of(groups: list[np.ndarray]):
    """(the first group, its rows and those of the groups after it), about `SOME_ROWS` rows at a
    time; a larger group comes in several parts."""
    first, parts, n = 0, [], 0
    for i, group in enumerate(groups):
        at = 0
        while len(group) - at > SOME_ROWS - n:
            yield first, [*parts, group[at : at + SOME_ROWS - n]]
            at += SOME_ROWS - n
            first, parts, n = i, [], 0
        parts.append(group[at:])
        n += len(group) - at
    if n:
        yield first, parts


class Grower:
    """Grows trees over one task's rows. `sizes` are the features' numbers of bins, `exchange`
    joins the tasks that hold the other rows."""

    def __init__(
        self,
        bins: np.ndarray,
        sizes: list[int],
        is_category: list[bool],
        growth: Growth,
        exchange=Alone(),
    ):
        self.bins, self.growth, self.exchange = np.asfortranarray(bins), growth, exchange
        self.sizes, self.is_category = np.array(sizes), np.array(is_category, bool)

    def grow(
        self,
        gradient: np.ndarray,
        hessian: np.ndarray,
        rows: np.ndarray,
        features: np.ndarray,
        step: float,
    ) -> tuple[Tree, list[tuple[int, np.ndarray]]]:
        """A tree over `rows` and `features`, and the rows of each leaf."""
        self._share_out(features)
        self.weights = (gradient, hessian)
        self.order = rows.astype(np.int32 if len(self.bins) < 1 << 31 else np.int64)
        tree = Tree()
        histogram = self._counted([self.order])[0]
        root = _Leaf(0, len(self.order), histogram, self._total(histogram), 0)
        self._find([root])
        tree.add(self._value(root.total, step), root.total[2])
        ended, queue, order = [], [], 0
        if root.split is None:
            ended.append(root)
        else:
            queue.append((-root.gain, order, root))
        n = 1
        while queue and n < self.growth.leaves:
            _, _, leaf = heapq.heappop(queue)
            if leaf.children is None:
                self._expand(self._ahead([leaf, *(x for _, _, x in queue)], self.growth.leaves - n))
            n += 1
            node = leaf.node
            place, code, missing_left, levels, _ = leaf.split
            tree.feature[node], tree.border[node] = int(features[place]), code
            tree.missing_left[node], tree.levels[node] = missing_left, levels
            tree.gain[node] = leaf.gain
            for child, name in zip(leaf.children, ("left", "right")):
                child.node = tree.add(self._value(child.total, step), child.total[2])
                getattr(tree, name)[node] = child.node
                if child.split is None:
                    ended.append(child)
                else:
                    order += 1
                    heapq.heappush(queue, (-child.gain, order, child))
        ended += [leaf for _, _, leaf in queue]
        return tree, [(leaf.node, self.order[leaf.begin : leaf.end]) for leaf in ended]

    def _ahead(self, leaves: list[_Leaf], splits: int) -> list[_Leaf]:
        """Those of the next `splits` leaves to be split that are not counted yet, the first one
        among them. Leaves that are still unknown can only come in between, so that others have
        no turn."""
        found, made = [], len(leaves)
        queue = [(-leaf.gain, i, leaf) for i, leaf in enumerate(leaves)]
        heapq.heapify(queue)
        for _ in range(splits):
            if not queue:
                break
            leaf = heapq.heappop(queue)[2]
            if leaf.children is None:
                found.append(leaf)
                continue
            for child in leaf.children:
                if child.split is not None:
                    heapq.heappush(queue, (-child.gain, made, child))
                    made += 1
        return found

    def _share_out(self, features: np.ndarray) -> None:
        """The features of each task, in order, with about as many bins each. The first task
        has the first feature."""
        tasks, sizes = self.exchange.tasks, self.sizes[features]
        self.all_starts = np.concatenate([[0], np.cumsum(sizes)])
        self.all_width = int(self.all_starts[-1])
        even = np.arange(tasks + 1) * self.all_width / tasks
        bounds = np.searchsorted(self.all_starts, even)
        bounds[-1] = len(features)
        self.shares = [tuple(self.all_starts[[a, b]]) for a, b in zip(bounds, bounds[1:])]
        self.first, last = int(bounds[self.exchange.own]), int(bounds[self.exchange.own + 1])
        self.features, own = features, features[self.first : last]
        self.starts = self.all_starts[self.first : last + 1] - self.all_starts[self.first]
        self.width = int(self.starts[-1])
        self.of_bin = np.repeat(np.arange(len(own)), self.sizes[own])
        self.bin_no = np.arange(self.width) - self.starts[self.of_bin]
        self.categories = self.is_category[own]
        self.numeric = ~self.categories[self.of_bin]

    def _total(self, histogram: np.ndarray) -> np.ndarray:
        return histogram[:, : self.starts[1] if len(self.starts) > 1 else 0].sum(axis=1)

    def _value(self, total: np.ndarray, step: float) -> float:
        return float(-step * total[0] / total[1]) if total[1] > 0 else 0.0

    def _counted(self, groups: list[np.ndarray]) -> np.ndarray:
        """Histograms of groups of rows, summed over all tasks, for this task's features."""
        out = np.zeros((len(groups), 3, self.all_width))
        for first, parts in _some_of(groups):
            n = len(parts)
            rows = np.concatenate(parts).astype(np.intp)
            slot = np.repeat(np.arange(n), [len(part) for part in parts])
            # Clipping looks up faster; no row is out of bounds.
            weights = [weight.take(rows, mode="clip") for weight in self.weights]
            for j, feature in enumerate(self.features):
                start, size = self.all_starts[j], self.sizes[feature]
                codes = slot * size
                codes += self.bins[:, feature].take(rows, mode="clip")
                for i, weight in enumerate((*weights, None)):
                    counts = np.bincount(codes, weight, n * size).reshape(n, size)
                    out[first : first + n, i, start : start + size] += counts
        return self.exchange.summed([out[:, :, a:b] for a, b in self.shares])

    def _parted(self, leaf: _Leaf) -> int:
        """Parts the rows of a leaf by its split, each side in the order they had; where the
        right side begins."""
        place, code, missing_left, levels, _ = leaf.split
        column = self.bins[:, self.features[place]]
        probe = Tree([0], [code], [missing_left], [levels])
        end, others = leaf.begin, []
        for at in range(leaf.begin, leaf.end, SOME_ROWS):
            rows = self.order[at : min(leaf.end, at + SOME_ROWS)]
            left = probe.goes_left(0, column.take(rows, mode="clip"))
            others.append(rows.compress(~left))
            own = rows.compress(left)
            self.order[end : end + len(own)] = own
            end += len(own)
        if others:
            np.concatenate(others, out=self.order[end : leaf.end])
        return end

    def _expand(self, leaves: list[_Leaf]) -> None:
        """Counts both sides of the leaves' splits, and finds theirs."""
        room = max(1, PASS_BYTES // (24 * max(1, self.all_width)))
        for i in range(0, len(leaves), room):
            some, smaller, parts = leaves[i : i + room], [], []
            for leaf in some:
                middle = self._parted(leaf)
                parts.append(((leaf.begin, middle), (middle, leaf.end)))
                # By the sum of all tasks, so that all count the same side.
                smaller.append(0 if 2 * leaf.split[-1] <= leaf.total[2] else 1)
            counted = self._counted([self.order[slice(*p[s])] for p, s in zip(parts, smaller)])
            made = []
            for leaf, rows, s, own in zip(some, parts, smaller, counted):
                total = self._total(own)
                pair = [None, None]
                pair[s] = _Leaf(*rows[s], own, total, -1)
                leaf.histogram -= own
                pair[1 - s] = _Leaf(*rows[1 - s], leaf.histogram, leaf.total - total, -1)
                leaf.children, leaf.histogram = tuple(pair), None
                made += pair
            self._find(made)

    def _find(self, leaves: list[_Leaf]) -> None:
        """The best split of each leaf, and its total as the first task has it."""
        told = self.exchange.told(([leaf.total for leaf in leaves], self._own_best(leaves)))
        for j, leaf in enumerate(leaves):
            leaf.total = told[0][0][j]
            found = [best[j] for _, best in told if best[j] is not None]
            # Equal gains: numbers first, missing values on the right, the first feature.
            gain, _, _, split = min(found, default=(0.0, 0, 0, None), key=lambda b: (-b[0], *b[1:3]))
            if split is not None and gain > 1e-12 * max(1.0, abs(leaf.total[0])):
                leaf.gain, leaf.split = float(gain), split
            else:
                leaf.histogram = None

    def _own_best(self, leaves: list[_Leaf]) -> list[tuple | None]:
        """(gain, kind of cut, place, split) of each leaf among the task's features."""
        out: list[tuple | None] = [None] * len(leaves)
        if not self.width:
            return out
        few = 2 * self.growth.min_rows
        large = [j for j, leaf in enumerate(leaves) if leaf.total[2] >= few]
        room = max(1, FIND_BYTES // (24 * self.width))
        for i in range(0, len(large), room):
            some = large[i : i + room]
            h = np.stack([leaves[j].histogram for j in some])
            totals = np.stack([leaves[j].total for j in some])
            best = self._numeric(h, totals)
            for place in np.flatnonzero(self.categories):
                for j, found in enumerate(self._category(int(place), h, totals)):
                    if found and found[0] > best[j][0]:
                        best[j] = (found[0], 2, found[1])
            for j, own, (gain, kind, split) in zip(some, h, best):
                if split is None:
                    continue
                place, code, missing_left, levels = split
                held = own[2, self.starts[place] : self.starts[place + 1]]
                probe = Tree([0], [code], [missing_left], [levels])
                on_left = float(held[probe.goes_left(0, np.arange(len(held)))].sum())
                place += self.first
                out[j] = (float(gain), kind, place, (place, code, missing_left, levels, on_left))
        return out

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        few, light = self.growth.min_rows, self.growth.min_hessian
        ok = (left[..., 2, :] >= few) & (right[..., 2, :] >= few)
        return ok & (left[..., 1, :] >= light) & (right[..., 1, :] >= light)

    def _numeric(self, h: np.ndarray, totals: np.ndarray) -> list[tuple]:
        if not self.numeric.any():
            return [(0.0, 0, None)] * len(h)
        sizes = np.diff(self.starts)
        base = _score(totals[:, 0], totals[:, 1])
        at_start = np.ascontiguousarray(h[..., self.starts[:-1]])  # the missing ones
        # Rows are counted exactly, so a feature without missing values here is seen by that.
        none = at_start[:, 2] < 0.5
        upto = np.cumsum(h, axis=2)
        before = upto[..., self.starts[:-1]] - at_start
        # Missing values on the right: at any border but below the first and above the last.
        usable = self.numeric.copy()
        usable[self.starts[:-1]] = usable[self.starts[1:] - 1] = False
        left = upto - np.repeat(before + at_start, sizes, axis=2)
        right_way = self._gains(left, totals, usable)
        # On the left, where there are any.
        held = np.flatnonzero(~none.all(axis=0) & ~self.categories)
        left_way = None
        if len(held):
            bins = np.flatnonzero(np.isin(self.of_bin, held))
            own = np.searchsorted(held, self.of_bin[bins])
            usable = np.ones(len(bins), bool)
            usable[np.flatnonzero(np.diff(np.append(own, -1)))] = False
            some = upto[..., bins] - before[..., held][..., own]
            left_way = self._gains(some, totals, usable)
            left_way[none[:, held][:, own]] = -1.0  # the same cut as the other
        out = []
        for j in range(len(h)):
            at, to_left = int(right_way[j].argmax()), False
            gain = right_way[j, at]
            if left_way is not None:
                other = int(left_way[j].argmax())
                if left_way[j, other] > gain:
                    at, gain, to_left = int(bins[other]), left_way[j, other], True
            gain -= base[j]
            if gain <= 0:
                out.append((0.0, 0, None))
                continue
            kind = int(to_left)
            place = int(self.of_bin[at])
            if none[j, place]:  # missing values go with the larger side
                to_left = bool(2 * left[j, 2, at] >= totals[j, 2])
            out.append((gain, kind, (place, int(self.bin_no[at]), to_left, None)))
        return out

    def _gains(self, left: np.ndarray, totals: np.ndarray, usable: np.ndarray) -> np.ndarray:
        """Scores of both sides of every cut, -1 where a side is too small."""
        few, light = self.growth.min_rows, self.growth.min_hessian
        g, h, n = left[:, 0], left[:, 1], left[:, 2]
        rest_h = totals[:, 1, None] - h
        gain = g * g
        gain /= np.maximum(h, TINY)
        rest = totals[:, 0, None] - g
        rest *= rest
        rest /= np.maximum(rest_h, TINY)
        gain += rest
        bad = n < few
        bad |= n > totals[:, 2, None] - few
        bad |= h < light
        bad |= rest_h < light
        bad |= ~usable
        gain[bad] = -1.0
        return gain

    def _category(self, place: int, h: np.ndarray, totals: np.ndarray) -> list[tuple | None]:
        growth = self.growth
        own = h[..., self.starts[place] : self.starts[place + 1]]
        there = own[:, 2] > 0.5
        base = _score(totals[:, 0], totals[:, 1])
        whole = totals[:, :, None]
        few = there.sum(axis=1) <= FEW_LEVELS
        out: list[tuple | None] = [None] * len(h)
        if few.any():  # one level against the rest
            gain = _score(own[:, 0], own[:, 1]) - base[:, None]
            rest = whole - own
            gain = gain + _score(rest[:, 0], rest[:, 1])
            gain = np.where(self._allowed(own, rest) & there, gain, -1.0)
            for j in np.flatnonzero(few):
                at = int(gain[j].argmax())
                if gain[j, at] > 0:
                    out[j] = (gain[j, at], (place, 0, False, (at,)))
        if not few.all():
            ratio = own[:, 0] / (own[:, 1] + growth.smooth)
            for way in (1, -1):
                key = np.where(there, way * ratio, np.inf)
                order = np.argsort(key, axis=1, kind="stable")[:, : growth.most_levels]
                left = np.cumsum(np.take_along_axis(own, order[:, None, :], 2), axis=2)
                right = whole - left
                gain = (
                    _score(left[:, 0], left[:, 1] + growth.penalty)
                    + _score(right[:, 0], right[:, 1] + growth.penalty)
                    - base[:, None]
                )
                gain = np.where(self._allowed(left, right), gain, -1.0)
                for j in np.flatnonzero(~few):
                    at = int(gain[j].argmax())
                    if gain[j, at] > 0 and (out[j] is None or gain[j, at] > out[j][0]):
                        levels = tuple(sorted(int(c) for c in order[j, : at + 1]))
                        out[j] = (gain[j, at], (place, 0, False, levels))
        return out


# --- losses ----------------------------------------------------------------------------


def gradients(task: str, y: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x classes gradients and hessians of the loss at the margins."""
    if task == "regression":
        return margins - y[:, None], np.ones_like(margins)
    if task == "binary":
        p = 1 / (1 + np.exp(-margins))
        return p - y[:, None], p * (1 - p)
    p = shares(margins)
    classes = margins.shape[1]
    told = y[:, None] == np.arange(classes)
    return p - told, classes / (classes - 1) * p * (1 - p)


def shares(margins: np.ndarray) -> np.ndarray:
    """Softmax of the margins."""
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def losses(task: str, y: np.ndarray, margins: np.ndarray) -> np.ndarray:
    if task == "regression":
        return (margins[:, 0] - y) ** 2
    if task == "binary":
        return np.logaddexp(0, margins[:, 0]) - y * margins[:, 0]
    p = shares(margins)[np.arange(len(y)), y.astype(int)]
    return -np.log(np.maximum(p, 1e-300))
