"""A tree grown by looking at every cut of every leaf, one after the other."""

import itertools
from math import factorial


def score(rows, g, h):
    total = sum(h[r] for r in rows)
    return sum(g[r] for r in rows) ** 2 / total if total > 0 else 0.0


def cuts(bins, rows, sizes, is_category, g, h, growth):
    """(gain, feature, left rows) of every allowed cut of a leaf."""
    def allowed(left, right):
        return all(
            len(s) >= growth.min_rows and sum(h[r] for r in s) >= growth.min_hessian
            for s in (left, right)
        )

    base = score(rows, g, h)
    for f, size in enumerate(sizes):
        codes = {r: int(bins[r][f]) for r in rows}
        if not is_category[f]:
            for border, missing in itertools.product(range(size - 1), (False, True)):
                left = [r for r in rows if codes[r] <= border and (missing or codes[r] > 0)]
                right = [r for r in rows if r not in set(left)]
                if allowed(left, right):
                    yield score(left, g, h) + score(right, g, h) - base, f, left
            continue
        levels = sorted(set(codes.values()))
        if len(levels) <= 4:
            sides, more = [{c} for c in levels], 0.0
        else:
            def ratio(c):
                own = [r for r in rows if codes[r] == c]
                return sum(g[r] for r in own) / (sum(h[r] for r in own) + growth.smooth)

            up = sorted(levels, key=ratio)
            sides = [set(o[:k]) for o in (up, up[::-1]) for k in range(1, growth.most_levels + 1)]
            more = growth.penalty
        for side in sides:
            left = [r for r in rows if codes[r] in side]
            right = [r for r in rows if codes[r] not in side]
            if not right or not allowed(left, right):
                continue
            gain = -base
            for part in (left, right):
                gain += sum(g[r] for r in part) ** 2 / (sum(h[r] for r in part) + more)
            yield gain, f, left


def gains(bins, rows, sizes, is_category, g, h, growth):
    """(feature, gain) of the splits in the order in which leaves are split, and the leaves."""
    def best(rows):
        return max(cuts(bins, rows, sizes, is_category, g, h, growth), key=lambda c: c[0], default=None)

    leaves, done = [(list(rows), best(list(rows)))], []
    while len(leaves) < growth.leaves:
        open_leaves = [x for x in leaves if x[1] is not None and x[1][0] > 1e-9]
        if not open_leaves:
            break
        leaf = max(open_leaves, key=lambda x: x[1][0])
        leaves.remove(leaf)
        gain, feature, left = leaf[1]
        done.append((feature, gain))
        right = [r for r in leaf[0] if r not in set(left)]
        leaves += [(left, best(left)), (right, best(right))]
    return done, [sorted(x[0]) for x in leaves]


def shapley(tree, row, features):
    """Attributions by the definition, over all sets of known features."""
    def value(known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return value(known, left if tree.goes_left(node, row[f : f + 1])[0] else right)
        share = tree.cover[left] / tree.cover[node]
        return share * value(known, left) + (1 - share) * value(known, right)

    out = []
    for f in range(features):
        others = [x for x in range(features) if x != f]
        out.append(sum(
            factorial(k) * factorial(features - 1 - k) / factorial(features)
            * (value({*s, f}) - value(set(s)))
            for k in range(features) for s in itertools.combinations(others, k)
        ))
    return out, value(set())
