"""Customers too large for one task, cut into time slices.

A window over one customer runs in one task. That is right for ordinary
customers and wrong for one that owns a large part of the table. Such customers
are found by counting keys; each is cut at rows of its own history into slices
of about ``max_rows`` rows. A slice also receives the last few rows before it,
so that looking one or two rows back stays exact at its border. Any choice of
cuts gives the same results; the sample behind it only steers the balance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from paneloom.functions import slot_in
from paneloom.session import shared_folder
from paneloom.spec import PanelSpec

MAX_ROWS = 200_000
# All cuts together, whatever the table size: bounds what is broadcast.
MAX_CUTS = 100_000
_SAMPLES_PER_SLICE = 64

_HOT = "_hot_key"
SLICE, LAST_SLICE, HALO = "_slice", "_last_slice", "_halo"


# Cuts a row is compared with at a time; the number of joins grows with its logarithm.
FAN = 16


@dataclass(frozen=True)
class HotCustomers:
    """``table``: key and number of cuts. ``cuts``: key, number of the cut from 1, its
    position, and where the extra rows of the slice after it begin."""

    table: DataFrame
    cuts: DataFrame
    most_cuts: int

    def _match(self, df: DataFrame, spec: PanelSpec):
        return df[spec.key].eqNullSafe(self.table[_HOT])

    def ordinary(self, df: DataFrame, spec: PanelSpec) -> DataFrame:
        keys = F.broadcast(self.table.select(_HOT))
        return df.join(keys, df[spec.key].eqNullSafe(keys[_HOT]), "left_anti")

    def rows(self, df: DataFrame, spec: PanelSpec) -> DataFrame:
        """All rows of the hot customers, without slices."""
        keys = F.broadcast(self.table.select(_HOT))
        return df.join(keys, df[spec.key].eqNullSafe(keys[_HOT]), "left_semi")

    def _cuts_of_step(self, step: int) -> DataFrame:
        """Every ``step``-th cut but for those of the next larger step, as (_key, _node,
        _cuts): the node counts the cuts of the larger step before it."""
        number, larger = F.col("_number"), step * FAN
        chosen = self.cuts.where((number % step == 0) & (number % larger != 0))
        return (
            chosen.groupBy(
                F.col("_cut_key").alias("_key"), F.floor(number / larger).cast("int").alias("_node")
            ).agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
        )

    def sliced(self, df: DataFrame, spec: PanelSpec) -> DataFrame:
        """Rows of the hot customers with their slice; border rows come twice,
        the second time marked as halo.

        A row's slice is found from coarse to fine, so that it meets at most
        ``FAN`` cuts at a time however many its customer has.
        """
        here = spec.position_tuple()
        found = df.join(F.broadcast(self.table), self._match(df, spec)).withColumn(
            "_own", F.lit(0)
        )

        def met(part: DataFrame):
            return found[_HOT].eqNullSafe(part["_key"]) & (found["_own"] == part["_node"])

        steps = 0
        while FAN**steps <= self.most_cuts:
            steps += 1
        for step in reversed(range(steps)):
            cuts = F.broadcast(self._cuts_of_step(FAN**step))
            finer = F.col("_own") * FAN + slot_in(here, F.col("_cuts"), FAN)
            found = found.join(cuts, met(cuts), "left").withColumn("_own", finer)
            found = found.drop("_key", "_node", "_cuts")
        starts = F.broadcast(
            self.cuts.select(
                F.col("_cut_key").alias("_key"),
                (F.col("_number") - 1).cast("int").alias("_node"),
                "_start",
            )
        )
        found = found.join(starts, met(starts), "left")
        border = F.coalesce(here >= F.col("_start"), F.lit(False))
        return (
            found.withColumn(
                SLICE,
                F.explode(
                    F.when(border, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
                ),
            )
            .withColumn(HALO, F.col(SLICE) != F.col("_own"))
            .withColumn(LAST_SLICE, F.col("_n_cuts"))
            .drop(_HOT, "_own", "_n_cuts", "_key", "_node", "_start")
        )


def hot_customers(
    df: DataFrame, spec: PanelSpec, max_rows: int | None = MAX_ROWS
) -> HotCustomers | None:
    """Customers with more than ``max_rows`` rows and the rows without a customer;
    None when there are neither.

    Reads the key column once. ``max_rows=None`` skips the check for callers who
    know that histories are short and every row has a key.
    """
    if max_rows is None:
        return None
    counts = df.groupBy(F.col(spec.key).alias(_HOT)).agg(F.count(F.lit(1)).alias("_n"))
    total, largest, unnamed = counts.agg(
        F.sum("_n"), F.max("_n"), F.count(F.when(F.col(_HOT).isNull(), 1))
    ).first()
    limit = max(max_rows, math.ceil((total or 0) / MAX_CUTS))
    if (largest or 0) <= limit and not unnamed:
        return None

    large = counts.where((F.col("_n") > limit) | F.col(_HOT).isNull()).select(
        _HOT,
        F.ceil(F.col("_n") / limit).cast("long").alias("_slices"),
        F.lit(max(1, limit // _SAMPLES_PER_SLICE)).alias("_every"),
    )
    here = spec.position_tuple()
    sample = (
        df.join(F.broadcast(large), df[spec.key].eqNullSafe(large[_HOT]))
        .where(F.pmod(F.xxhash64(*spec.position), F.col("_every")) == 0)
        .select(_HOT, "_slices", here.alias("_at"))
        .distinct()
    )
    history = Window.partitionBy(_HOT).orderBy("_at")
    marks = sample.select(
        _HOT,
        "_slices",
        "_at",
        F.row_number().over(history).alias("_r"),
        F.lag("_at", 2).over(history).alias("_start"),
        F.count(F.lit(1)).over(Window.partitionBy(_HOT)).alias("_m"),
    )
    step = F.greatest(F.lit(3), F.ceil(F.col("_m") / F.col("_slices")).cast("long"))
    shared_folder(df.sparkSession)
    cuts = (
        marks.where((F.col("_slices") > 1) & (F.col("_r") % step == 0))
        .select(
            F.col(_HOT).alias("_cut_key"),
            F.floor(F.col("_r") / step).alias("_number"),
            "_at",
            "_start",
        )
        .checkpoint()
    )
    counts = cuts.groupBy("_cut_key").agg(F.count(F.lit(1)).cast("int").alias("_found"))
    # Every large key stays, with no cuts where its rows share one position.
    table = (
        large.join(F.broadcast(counts), large[_HOT].eqNullSafe(counts["_cut_key"]), "left")
        .select(_HOT, F.coalesce("_found", F.lit(0)).alias("_n_cuts"))
        .checkpoint()
    )
    return HotCustomers(table, cuts, table.agg(F.max("_n_cuts")).first()[0])
