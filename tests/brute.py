"""Plain-Python reading of the feature rules, for comparison on small tables."""

from __future__ import annotations

import math
import statistics

RATIO_OFFSET = 1e-5


def minus(a, b):
    return None if a is None or b is None else a - b


def diffs(values):
    return [None] + [minus(b, a) for a, b in zip(values, values[1:])]


def flags(values):
    return [0] + [
        int(a is not None and b is not None and a != b) for a, b in zip(values, values[1:])
    ]


def ratio(a, b):
    if a is None or b is None:
        return None
    if b == 0:
        return math.nan if a == 0 else math.copysign(math.inf, a)
    return a / b


def number(values):
    known = [v for v in values if v is not None]
    mean = statistics.fmean(known) if known else None
    delta = minus(values[-1], values[0])
    return {
        "_mean": mean,
        "_std": statistics.stdev(known) if len(known) > 1 else None,
        "_min": min(known, default=None),
        "_max": max(known, default=None),
        "_last": values[-1],
        "_total_delta": delta,
        "_trend_ratio": ratio(values[-1], None if mean is None else mean + RATIO_OFFSET),
        "_pos_ratio": sum((d or 0) > 0 for d in diffs(values)) / len(values),
        "_avg_monthly_slope": None if delta is None else delta / len(known),
    }


def category(values):
    return {
        "_first": values[0],
        "_last": values[-1],
        "_nunique": len(set(values)),
        "_count": sum(v is not None for v in values),
    }


def flag(values):
    return {
        "_total_changes": sum(values),
        "_change_frequency": sum(values) / len(values),
        "_changed_recently": values[-1],
    }


def customer(rows, numbers, categories):
    """Features of one customer's rows, given in time order as dicts."""
    out = {}
    for c in numbers:
        values = [r[c] for r in rows]
        out |= {c + s: v for s, v in number(values).items()}
        out |= {f"{c}_diff1{s}": v for s, v in number(diffs(values)).items()}
    for c in categories:
        values = [r[c] for r in rows]
        out |= {c + s: v for s, v in category(values).items()}
        out |= {f"{c}_changed{s}": v for s, v in flag(flags(values)).items()}
    return out


def same(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    return a == b
