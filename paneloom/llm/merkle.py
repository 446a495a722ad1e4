"""A content-addressed manifest of a table: a hash tree over its rows, and proofs from it.

Rows are leaves. Every 16 consecutive nodes of a group (a source) become one record, the
digest of their digests, until one node remains; the groups' nodes become the root in the
same way. The store is the records, digest to children, a table per level.

A proof is found from the root: a leaf's number, written in base 16, says which child to
follow at each record. Requests of leaves descend together: a record is looked up once for
all leaves below it, and its path, what stood left and right of the child at every step
so far, is handed down. Only leaves read whole paths, in the task that joins them with their
record, so nothing larger than a sixteenth of the paths is shuffled and no record is a hot
key, though every proof starts at the root. Reversed, the path is the proof.

Leaves are numbered within their group from the sizes of range partitions, so a group that
holds a third of all rows is spread over tasks.

Defined cases. A null cell is written `-`, so it differs from the text "-". Null groups and
null ids come first; rows of one id are ordered by digest; equal rows have equal digests, and
each has a number and a proof of its own. A group of one leaf has that leaf as its node. An
empty table has no root and no rows. Further columns are carried in `row`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneloom.llm.common import in_order, shared_table

# Fixed value of the contract.
FAN = 16
BITS = 4


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def row_digest(columns: Sequence[Column]) -> Column:
    """Digest of the cells: byte count, colon, value; `-` for null."""
    cells = []
    for column in columns:
        value = column.cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        cells.append(F.coalesce(sized, F.lit("-")))
    return digest(F.concat(*cells))


@dataclass(frozen=True)
class Manifest:
    """`leaves`: (row, leaf, tree, rank), `tree` being the group's number. `levels[k]`:
    records (tree, idx, digest, children) made of nodes of level k; `top` the same over the
    groups. `tops`: (tree, subroot, depth)."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    tops: DataFrame
    root: str | None


def _numbered(ordered: DataFrame, group: str) -> DataFrame:
    """Adds `rank` within the group and `n`, its size, to a written table in order."""
    parts = ordered.groupBy(group, "part").agg(
        F.count(F.lit(1)).alias("size"), F.min("place").alias("first")
    )
    by_group = Window.partitionBy(group)
    before = by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col(group).alias("_group"),
        F.col("part").alias("_part"),
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("size").over(by_group).alias("n"),
    )
    same = (ordered.part == parts._part) & ordered[group].eqNullSafe(parts._group)
    return ordered.join(parts, same).select(
        *(c for c in ordered.columns if c not in ("part", "place")),
        (F.col("place") + F.col("_shift")).alias("rank"),
        "n",
    )


def _grown(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of every level over nodes (tree, idx, digest, n), n being the tree's nodes on
    that level, at most `most`; and (tree, digest, depth) of each tree's last node."""
    levels, ends, depth = [], nodes.filter("n = 1").select("tree", "digest", F.lit(0).alias("depth")), 0
    while most > 1:
        depth, most = depth + 1, -(-most // FAN)
        joined = (
            nodes.filter("n > 1")
            .groupBy("tree", F.shiftright("idx", BITS).alias("idx"), "n")
            .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("below"))
            .select("tree", "idx", F.col("below.digest").alias("children"), "n")
        )
        nodes = shared_table(
            joined.select(
                "tree",
                "idx",
                digest(F.concat_ws("", "children")).alias("digest"),
                "children",
                F.ceil(F.col("n") / FAN).alias("n"),
            ),
            "records",
        )
        levels.append(nodes.select("tree", "idx", "digest", "children"))
        ends = ends.union(
            nodes.filter("n = 1").select("tree", "digest", F.lit(depth).alias("depth"))
        )
    return levels, ends


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    carry: Sequence[str] = (),
) -> Manifest:
    rows = docs.select(
        F.col(group_col).alias("group"),
        F.col(id_col).alias("id"),
        row_digest([F.col(c) for c in fields]).alias("leaf"),
        F.struct(*(carry or [id_col])).alias("row"),
    )
    hashed = shared_table(rows, "leaves").withColumn("nth", F.monotonically_increasing_id())
    order = ["group", "id", "leaf", "nth"]
    leaves = _numbered(shared_table(in_order(hashed, order), "ordered"), "group")
    groups = leaves.groupBy("group").agg(F.max("n").alias("size"))
    ranged = shared_table(in_order(groups.withColumn("one", F.lit(1)), ["group"]), "groups")
    trees = _numbered(ranged, "one").select("group", "size", F.col("rank").alias("tree"))
    trees = shared_table(trees, "trees")
    known = trees.select(F.col("group").alias("_named"), "tree")
    leaves = shared_table(
        leaves.join(known, leaves.group.eqNullSafe(known._named)).select(
            "row", "leaf", "tree", "rank", "n"
        ),
        "numbered",
    )
    sizes = trees.agg(F.max("size").alias("most"), F.count("*").alias("n")).first()
    nodes = leaves.select("tree", F.col("rank").alias("idx"), F.col("leaf").alias("digest"), "n")
    levels, ends = _grown(nodes, sizes["most"] or 0)
    tops = shared_table(ends.withColumnRenamed("digest", "subroot"), "subroots")
    top_nodes = tops.select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("idx"),
        F.col("subroot").alias("digest"),
        F.lit(sizes["n"]).cast("long").alias("n"),
    )
    top, last = _grown(top_nodes, sizes["n"])
    root = last.first()  # one row, or none of an empty table
    return Manifest(leaves.drop("n"), levels, top, tops, root and root["digest"])


def _store(level: DataFrame) -> DataFrame:
    """Digest to children; equal subtrees are one record."""
    return level.groupBy("digest").agg(F.first("children").alias("children"))


def _step(children: Column, digit: Column) -> Column:
    """What stands left and right of a child."""
    return F.struct(
        F.concat_ws("", F.slice(children, F.lit(1), digit)).alias("left"),
        F.concat_ws("", F.slice(children, digit + 2, F.lit(FAN))).alias("right"),
    )


def _descended(
    levels: list[DataFrame], starts: DataFrame, wanted: DataFrame, down_to: int
) -> DataFrame:
    """(tree, idx, digest, path) of the wanted nodes' ancestors on level `down_to`, found from
    `starts` (tree, digest, depth, path); `wanted` are (tree, idx) of level 0."""
    at = starts.filter(F.col("depth") == len(levels)).select(
        "tree", F.lit(0).cast("long").alias("idx"), "digest", "path"
    )
    for level in range(len(levels) - 1, down_to - 1, -1):
        below = (
            at.join(_store(levels[level]), "digest")
            .select("tree", "idx", "path", "children", F.posexplode("children"))
            .select(
                "tree",
                (F.col("idx") * FAN + F.col("pos")).alias("idx"),
                F.col("col").alias("digest"),
                F.concat("path", F.array(_step(F.col("children"), F.col("pos")))).alias("path"),
            )
        )
        asked = wanted.select("tree", F.shiftright("idx", BITS * level).alias("idx")).distinct()
        at = below.join(asked, ["tree", "idx"], "left_semi").union(
            starts.filter(F.col("depth") == level).select(
                "tree", F.lit(0).cast("long").alias("idx"), "digest", "path"
            )
        )
    return at


NO_STEPS = "array<struct<left: string, right: string>>"


def prove(made: Manifest, which: Column | None = None) -> DataFrame:
    """(row, leaf, subroot, root, proof) of the leaves where `which` holds, of all by default;
    `proof` is an array of (left, right), from the leaf up to the root."""
    leaves = made.leaves if which is None else made.leaves.filter(which)
    asked = leaves.select("tree", F.col("rank").alias("idx"))
    trees = asked.select(F.col("tree").alias("idx")).distinct()
    root = made.tops.sparkSession.createDataFrame(
        [] if made.root is None else [(0, made.root, len(made.top), [])],
        f"tree long, digest string, depth int, path {NO_STEPS}",
    )
    heads = _descended(made.top, root, trees.select(F.lit(0).cast("long").alias("tree"), "idx"), 0)
    starts = shared_table(
        made.tops.join(heads.select(F.col("idx").alias("tree"), "path"), "tree").select(
            "tree", "subroot", F.col("subroot").alias("digest"), "depth", "path"
        ),
        "starts",
    )
    if made.levels:
        parents = _descended(made.levels, starts, asked, 1)
        records = parents.join(_store(made.levels[0]), "digest").select(
            "tree", "idx", "path", "children"
        )
    else:
        records = starts.limit(0).select(
            "tree", F.col("tree").alias("idx"), "path", F.array("subroot").alias("children")
        )
    alone = starts.filter("depth = 0").select(
        "tree", F.lit(0).cast("long"), "path", F.lit(None).cast("array<string>")
    )
    records = records.union(alone)
    requests = leaves.select(
        "row", "leaf", "tree",
        F.shiftright("rank", BITS).alias("idx"),
        F.col("rank").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("digit"),
    )
    last = F.when(
        F.col("children").isNull(), F.array().cast(NO_STEPS)
    ).otherwise(F.array(_step(F.col("children"), F.col("digit"))))
    subroots = starts.select("tree", "subroot")
    return requests.join(subroots, "tree").join(records, ["tree", "idx"]).select(
        "row", "leaf", "subroot",
        F.lit(made.root).cast("string").alias("root"),
        F.reverse(F.concat("path", last)).alias("proof"),
    )


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(
        proof, leaf, lambda at, s: digest(F.concat(s["left"], at, s["right"]))
    )
