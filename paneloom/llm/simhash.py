"""SimHash fingerprints, and the classes of documents whose fingerprints nearly agree.

Covering locality-sensitive hashing: every bit position gets a non-zero vector of
radius + 1 bits, and there is one table for every non-zero vector v, whose mask keeps the
positions with an odd product with v. Up to radius positions span fewer dimensions than
there are, so some v is orthogonal to all of them: fingerprints that differ in these
positions agree under that v's mask and share a bucket of its table, for certain.

Buckets are never paired up. A fingerprint that shares a bucket gives out itself and its
neighbours at one flipped bit, for the bits that the shared tables leave free. Two
fingerprints meet in one of these words exactly if they differ in at most two bits, and all
that meet in a word are within two bits of each other, so each is linked to the least of
them. A word is met by at most 65 fingerprints, whatever the size of a bucket; nothing needs
to be verified, capped or compared pair by pair. (This last step is for radius 1 or 2.)

Equal fingerprints are one node from the start, so a group of copies is one row.

Defined cases. A null or empty text, or one of white space, has no words and the fingerprint
zero, which is linked like any other. A null id never names a component unless all its ids
are null; then the component is null. Repeated ids and rows each keep a row. An empty table
gives no rows. Further columns are not read unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.common import shared_table
from paneloom.llm.components import components

BITS = 64
WORDS = 3
RADIUS = 2
# Fixed value of the contract.
SEED = 42
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 14
LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def masks(radius: int = RADIUS) -> list[int]:
    """One mask of 64 bits per table; position i has the vector i mod (number of vectors) + 1."""
    vectors = (1 << radius + 1) - 1
    return [
        sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """As a signed number. A bit is set if it is in over half of the shingles' hashes."""
    found = (text or "").encode().translate(LOWERED).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(found))
    first, last = starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = np.array(
            [hashed(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > len(first), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    words: int = WORDS,
) -> DataFrame:
    """(row, id, fingerprint): one row per document."""
    rows = docs.select(
        F.struct(*(carry or [id_col])).alias("row"),
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["id"], pa.array(found, pa.int64())],
                ["row", "id", "fingerprint"],
            )

    schema = T.StructType(
        [rows.schema["row"], rows.schema["id"], T.StructField("fingerprint", T.LongType())]
    )
    return rows.mapInArrow(run, schema)


def links(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all of the distinct `fingerprint`s within `radius` bits;
    every one given is a link, but not every link is given."""
    if radius not in (1, 2):
        raise ValueError("the radius is 1 or 2 bits")
    tables = masks(radius)
    buckets = found.select(
        "fingerprint",
        F.posexplode(
            F.array(*(F.col("fingerprint").bitwiseAND(F.lit(signed(m))) for m in tables))
        ).alias("table", "bucket"),
    )
    shared = shared_table(
        buckets.groupBy("table", "bucket").count().filter("count > 1").drop("count"), "buckets"
    )
    free = F.get(F.array(*(F.lit(signed(~m & (1 << BITS) - 1)) for m in tables)), F.col("table"))
    near = (
        buckets.join(shared, ["table", "bucket"], "left_semi")
        .groupBy("fingerprint")
        .agg(F.bit_or(free).alias("free"))
    )
    flips = F.array(*(F.lit(signed(1 << i)) for i in range(BITS)))
    flips = F.filter(flips, lambda one: F.col("free").bitwiseAND(one) != 0)
    met = near.select(
        "fingerprint",
        F.explode(
            F.concat(
                F.array("fingerprint"),
                F.transform(flips, lambda one: F.col("fingerprint").bitwiseXOR(one)),
            )
            if radius == 2
            else F.transform(
                F.concat(F.array(F.lit(0).cast("long")), flips),
                lambda one: F.least(
                    F.col("fingerprint"), F.col("fingerprint").bitwiseXOR(one)
                ),
            )
        ).alias("word"),
    )
    if radius == 1:  # a pair at one bit meets in the lesser of the two
        met = met.distinct()
    groups = met.groupBy("word").agg(
        F.min("fingerprint").alias("a"), F.collect_list("fingerprint").alias("all")
    )
    if radius == 1:  # others of a word may differ in two bits; its own fingerprint is the least
        groups = groups.filter(F.col("a") == F.col("word"))
    return (
        groups.filter(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    radius: int = RADIUS,
    words: int = WORDS,
) -> DataFrame:
    """(row, id, fingerprint, component): the component is the smallest id reachable by links."""
    found = shared_table(fingerprints(docs, id_col, text_col, carry, words), "fingerprints")
    distinct = shared_table(
        found.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct"
    )
    joined = components(links(distinct.select("fingerprint"), radius))
    labelled = distinct.join(joined, distinct.fingerprint == joined.node, "left").select(
        "fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")
    )
    classes = labelled.groupBy("label").agg(F.min("least").alias("component"))
    named = shared_table(
        labelled.join(classes, "label").select("fingerprint", "component"), "classes"
    )
    return found.join(named, "fingerprint").select("row", "id", "fingerprint", "component")


def hexadecimal(word: Column) -> Column:
    return F.lpad(F.lower(F.hex(word)), 16, "0")
