"""Values cut into slots of the same borders for every row."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

SLOT = "_slot_"


def with_slots(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Adds ``_slot_<column>``: how many cuts are at or below the value; null stays null.
    0.0 and -0.0 are one value, as they are in groups."""
    borders = {
        c: sorted({float(v) + 0.0 for v in values if v is not None and math.isfinite(v)})
        for c, values in cuts.items()
    }
    cut = [c for c, values in borders.items() if values]
    doubles = df.select(
        "*", *((F.col(c).cast("double") + F.lit(0.0)).alias(f"_value_{c}") for c in cut)
    )
    if cut:
        doubles = Bucketizer(
            splitsArray=[[-math.inf, *borders[c], math.inf] for c in cut],
            inputCols=[f"_value_{c}" for c in cut],
            outputCols=[f"_wide_{c}" for c in cut],
            handleInvalid="keep",
        ).transform(doubles)
    return doubles.select(
        *df.columns,
        *(
            (
                F.col(f"_wide_{c}").cast("int")
                if c in cut
                else F.when(F.col(c).isNotNull(), F.lit(0))
            ).alias(SLOT + c)
            for c in borders
        ),
    )


@dataclass(frozen=True)
class RankSlots:
    """Borders of slots from estimated quantiles, and in how many stripes of equal width
    each slot is cut again, so that a stripe has about as many rows whatever the size of
    the table. Slots and stripes are ordered like the values."""

    cuts: dict[str, list[float]]
    ends: dict[str, tuple[float | None, float | None]]
    stripes: dict[str, int]

    def add_to(self, df: DataFrame) -> DataFrame:
        """Adds ``_slot_<column>``, the number of a value's stripe; null stays null."""
        slotted = with_slots(df, self.cuts)
        return slotted.withColumns(
            {SLOT + c: self._stripe(c) for c, n in self.stripes.items() if n > 1}
        )

    def _stripe(self, c: str) -> Column:
        inner = sorted({float(v) for v in self.cuts[c] if v is not None and math.isfinite(v)})
        low, high = self.ends[c]
        borders = F.lit([min(low, *inner), *inner, max(high, *inner)] if inner else [low, high])
        slot, n = F.col(SLOT + c).cast("long"), self.stripes[c]
        start, end = F.get(borders, slot.cast("int")), F.get(borders, slot.cast("int") + 1)
        place = F.try_divide(F.col(c).cast("double") - start, end - start) * n
        within = F.when(F.isnan(c), n - 1).otherwise(F.floor(F.coalesce(place, F.lit(0.0))))
        return slot * n + F.greatest(F.lit(0), F.least(within, F.lit(n - 1)))


def rank_slots(df: DataFrame, columns: list[str], most: int, rows_per_slot: int) -> RankSlots:
    """Slots of about ``rows_per_slot`` known values: up to ``most`` of them by estimated
    quantiles, beyond that by stripes. Read once to the driver (slots x columns numbers),
    because an estimate may differ each time it is computed."""
    shares = np.arange(1, most) / most

    def value(c: str) -> Column:
        return F.col(c).cast("double")

    def finite(c: str) -> Column:
        return F.when(~F.isnan(value(c)) & (F.abs(value(c)) < math.inf), value(c))

    row = df.agg(
        *(F.count(c).alias(f"n|{c}") for c in columns),
        *(F.min(finite(c)).alias(f"low|{c}") for c in columns),
        *(F.max(finite(c)).alias(f"high|{c}") for c in columns),
        *(
            F.percentile_approx(value(c), F.lit(shares), 10 * most).alias(f"q|{c}")
            for c in columns
            if most > 1
        ),
    ).first()
    cuts, ends, stripes = {}, {}, {}
    for c in columns:
        n = row[f"n|{c}"]
        slots = max(1, min(most, n // rows_per_slot))
        cuts[c] = [row[f"q|{c}"][round(i * most / slots) - 1] for i in range(1, slots)]
        ends[c] = (row[f"low|{c}"], row[f"high|{c}"])
        known = row[f"low|{c}"] is not None
        stripes[c] = max(1, -(-n // (slots * rows_per_slot))) if known and n > 0 else 1
        if slots < most:
            stripes[c] = 1
    return RankSlots(cuts, ends, stripes)
