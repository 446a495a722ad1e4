"""Self-join of documents on the Jaccard similarity of their word n-grams.

1. Documents with equal n-gram sets are copies; one of them stands for all from here on.
2. MinHash signatures are cut into bands; numbers of bands and rows follow from the wanted
   recall at the threshold. Bands are shuffled by hash, in sorted streams that may cut a
   large bucket anywhere.
3. Buckets of at most `few` documents give their pairs, which are verified on the full
   n-gram sets. Documents of larger buckets are not paired up: such buckets are joined to
   groups (components), and every group is verified inside tasks, block by block, which
   give out numbers of links and a spanning tree only. Both ways find the same links.
4. Classes are the components of the verified links.

n-grams are compared by 64-bit hashes. Defined cases. A text of fewer words than `n` is
one n-gram; texts without words, null included, are copies of one another. Repeated rows
and rows that share an id get a row each. Smallest ids ignore null. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import id_and_text, row_keys, shared_table, shuffle_tasks, words_of
from paneloom.llm.components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.99999
MAX_HASHES = 128
#: Buckets above this are verified in groups. It bounds the pairs a document is in.
FEW = 32
#: Documents, and characters, of one block of a group.
BLOCK_DOCS, BLOCK_CHARS = 1_500, 6_000_000
CACHED_WORDS = 400_000


def choose_bands(
    threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES
) -> tuple[int, int]:
    """(bands, rows): the longest rows, so the fewest false candidates, with which pairs at
    the threshold meet in some band with probability `recall` and `most` hashes suffice."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach this recall with so few hashes")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def ngram_set(text: str | None, n: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of a text."""
    words = words_of(text)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(codes))
    if not size:
        return codes
    total = codes[: len(codes) - size + 1].copy()
    for j in range(1, size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - size + 1 + j]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(total ^ (total >> np.uint64(29)))


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, k1, k2, v, bands): v names the n-gram set."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    weave = rng.integers(1, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            names, found = [], []
            for text in batch["text"]:
                grams = ngram_set(text.as_py(), n, hashes)
                names.append(xxhash.xxh3_128_digest(grams.tobytes()))
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(grams), 4096):
                    part = grams[at : at + 4096, None] * factors + shifts
                    np.minimum(least, part.min(axis=0), out=least)
                woven = (least >> np.uint64(24)).reshape(bands, rows) * weave
                mixed = np.bitwise_xor.reduce(woven ^ (woven >> np.uint64(31)), axis=1)
                found.append((mixed * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["k1"], batch["k2"], pa.array(names, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))],
                ["id", "k1", "k2", "v", "bands"],
            )

    keyed = docs.select("id", *row_keys(F.col("id"), F.col("text")), "text")
    kind = docs.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(sign, f"id {kind}, k1 long, k2 long, v binary, bands array<long>")


PAIR, LARGE = 0, 1


def _buckets(batches: Iterator[pa.RecordBatch], few: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, hash, v) come sorted. Whole buckets of 2 to `few` give PAIR rows; larger
    buckets, and those at an edge of the partition, give LARGE rows (v, bucket)."""
    held: pa.Table | None = None
    edge, large = True, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        band, code = rows["band"].to_numpy(), rows["hash"].to_numpy()
        new = np.append(True, (band[1:] != band[:-1]) | (code[1:] != code[:-1]))
        starts = np.flatnonzero(new)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if edge or large or b - a > few:
                yield from _large(rows.slice(a, b - a))
            elif b - a > 1:
                names = sorted(rows["v"].slice(a, b - a).to_pylist())
                yield _pairs(names)
            edge = large = False
        held = rows.slice(starts[-1])
        if held.num_rows > few:  # its rows need not be kept
            yield from _large(held.slice(0, held.num_rows - 1))
            held, large = held.slice(held.num_rows - 1), True
    if held is not None:
        yield from _large(held)


NAMES = ["kind", "a", "b", "bucket"]


def _pairs(names: list[bytes]) -> pa.RecordBatch:
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    n = len(pairs)
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array([PAIR] * n, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()),
         pa.nulls(n, pa.int64())],
        NAMES,
    )


def _large(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    bands = rows["band"].to_numpy().astype(np.int64)
    bucket = (rows["hash"].to_numpy() & ~np.int64(255)) | bands  # bands are under 256
    out = pa.table(
        [pa.array([LARGE] * n, pa.int32()), rows["v"], pa.nulls(n, pa.binary()),
         pa.array(bucket)],
        names=NAMES,
    )
    yield from out.combine_chunks().to_batches()


def near_duplicates(
    docs: DataFrame,
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    few: int = FEW,
    block_docs: int = BLOCK_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per document: id, k1, k2 (`row_keys`), label (names the class), class_id (its
    smallest id), copy_of (smallest id with the same n-grams), n_copies (rows with the same
    n-grams, itself included) and n_links (different n-gram sets that are similar to it)."""
    bands, rows = choose_bands(threshold, recall)
    own = id_and_text(docs, id_col, text_col)
    signed = shared_table(_signatures(own, n, bands, rows), "signatures")
    texts = signed.groupBy("v").agg(
        F.min("id").alias("copy_of"), F.count("*").alias("n_copies"),
        F.min(F.struct("k1", "k2")).alias("key"), F.first("bands").alias("bands"),
    )
    texts = shared_table(texts, "texts")
    found = _candidates(texts, few)
    groups = _groups(found)
    pairs = _open_pairs(found, groups)
    wanted = (
        pairs.select(F.col("a").alias("v"))
        .union(pairs.select(F.col("b")))
        .union(groups.select("v"))
        .distinct()
    )
    keys = texts.join(wanted, "v").select("v", "key.k1", "key.k2")
    keyed = own.select("text", *row_keys(F.col("id"), F.col("text")))
    bodies = shared_table(
        keyed.join(keys, ["k1", "k2"]).dropDuplicates(["v"]).select("v", "text"), "bodies"
    )
    links = shared_table(
        _verified_pairs(pairs, bodies, n, threshold).union(
            _verified_groups(groups, bodies, n, threshold, block_docs)
        ),
        "links",
    )
    return _classes(signed, texts, links)


def _candidates(texts: DataFrame, few: int) -> DataFrame:
    """(kind, a, b, bucket), see `_buckets`."""
    order = ["band", "hash", "v"]
    banded = texts.select("v", F.posexplode("bands").alias("band", "hash"))
    ranged = banded.repartitionByRange(shuffle_tasks(texts.sparkSession), *order)
    return shared_table(
        ranged.sortWithinPartitions(*order)
        .select(*order)
        .mapInArrow(
            lambda batches: _buckets(batches, few), "kind int, a binary, b binary, bucket long"
        ),
        "candidates",
    )


def _groups(found: DataFrame) -> DataFrame:
    """(v, label): documents of large buckets, and the group of buckets they are in."""
    members = found.filter(F.col("kind") == LARGE).select("a", "bucket")
    firsts = members.groupBy("bucket").agg(F.min("a").alias("b"), F.count("*").alias("size"))
    edges = members.join(firsts.filter(F.col("size") > 1), "bucket").select("a", "b")
    return components(edges).select(F.col("node").alias("v"), "label")


def _open_pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct candidate pairs that no group verifies."""
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    left = groups.select(F.col("v").alias("a"), F.col("label").alias("a_label"))
    right = groups.select(F.col("v").alias("b"), F.col("label").alias("b_label"))
    return shared_table(
        pairs.join(left, "a", "left")
        .join(right, "b", "left")
        .filter(
            F.col("a_label").isNull()
            | F.col("b_label").isNull()
            | (F.col("a_label") != F.col("b_label"))
        )
        .select("a", "b"),
        "pairs",
    )


LINK = "a binary, b binary, a_links long, b_links long"


def _verified_pairs(pairs: DataFrame, bodies: DataFrame, n: int, threshold: float) -> DataFrame:
    left = bodies.select(F.col("v").alias("a"), F.col("text").alias("a_text"))
    right = bodies.select(F.col("v").alias("b"), F.col("text").alias("b_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, right_set = _WordHashes(), None, None
        for batch in batches:
            similar = []
            for i in range(batch.num_rows):
                name = batch["b"][i].as_py()
                if name != last:  # rows come sorted by b from the join
                    last, right_set = name, ngram_set(batch["b_text"][i].as_py(), n, hashes)
                left_set = ngram_set(batch["a_text"][i].as_py(), n, hashes)
                both = len(np.intersect1d(left_set, right_set, assume_unique=True))
                union = len(left_set) + len(right_set) - both
                similar.append(_alike(both, union, threshold))
            keep = pa.array(similar, pa.bool_())
            ones = pa.array([1] * sum(similar), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["a"].filter(keep), batch["b"].filter(keep), ones, ones],
                ["a", "b", "a_links", "b_links"],
            )

    return pairs.join(left, "a").join(right, "b").mapInArrow(verify, LINK)


def _alike(both, union, threshold):
    return both >= threshold * union - 1e-9


def _verified_groups(
    groups: DataFrame, bodies: DataFrame, n: int, threshold: float, block_docs: int
) -> DataFrame:
    """Links inside groups: (v, root of its tree, links of v in this pair of blocks, 0)."""
    sizes = (
        groups.join(bodies, "v")
        .groupBy("label")
        .agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
        .select(
            "label",
            F.greatest(
                F.ceil(F.col("docs") / block_docs), F.ceil(F.col("chars") / BLOCK_CHARS)
            ).cast("int").alias("blocks"),
        )
    )
    members = groups.join(sizes, "label").join(bodies, "v")
    block = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    paired = members.select(
        "label", "v", "text", block.alias("block"), F.explode(others).alias("other")
    ).select(
        "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "v", "text",
    )
    tasks = shuffle_tasks(groups.sparkSession)
    order = ["label", "i", "j"]
    return (
        paired.repartition(tasks, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(lambda batches: _blocks(batches, n, threshold), LINK)
    )


def _blocks(batches: Iterator[pa.RecordBatch], n: int, threshold: float):
    """Reads two blocks' documents at a time; keeps their n-gram sets only."""
    hashes = _WordHashes()
    current, members = None, []
    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("label", "i", "j")))
        for row, key in enumerate(keys):
            if key != current:
                yield from _linked(members, threshold)
                current, members = key, []
            members.append(
                (batch["v"][row].as_py(), batch["block"][row].as_py() == key[1],
                 key[1] == key[2], ngram_set(batch["text"][row].as_py(), n, hashes))
            )
    yield from _linked(members, threshold)


def _linked(members: list, threshold: float) -> Iterator[pa.RecordBatch]:
    if len(members) < 2:
        return
    sets = [m[3] for m in members]
    sizes = np.array([len(s) for s in sets])
    both = _intersections(sets)
    linked = _alike(both, sizes[:, None] + sizes - both, threshold)
    if members[0][2]:  # a block with itself
        np.fill_diagonal(linked, False)
    else:
        in_first = np.array([m[1] for m in members])
        linked &= in_first[:, None] != in_first
    counts = linked.sum(axis=1)
    at = np.flatnonzero(counts)
    if len(at):
        roots = _roots(linked)
        names = [m[0] for m in members]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in at], pa.binary()),
             pa.array([names[i] for i in roots[at]], pa.binary()),
             pa.array(counts[at].astype(np.int64)), pa.array(np.zeros(len(at), np.int64))],
            ["a", "b", "a_links", "b_links"],
        )


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: rare elements by pairs of their holders, common
    ones by products of incidence matrices, a few columns at a time."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    codes = np.concatenate(sets)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else codes
    count = np.diff(np.append(first, len(codes))).astype(np.int64)
    column = np.repeat(np.arange(len(first)), count)
    both = np.zeros((m, m), np.float32)
    rare = np.repeat(count <= 8, count)
    for step in range(1, 8):
        at = np.flatnonzero(rare[:-step] & (column[:-step] == column[step:]))
        np.add.at(both, (owner[at], owner[at + step]), 1)
    both += both.T
    common = ~rare
    number = np.cumsum(count > 8) - 1
    rows, columns = owner[common], number[column[common]]
    for low in range(0, int((count > 8).sum()), 1024):
        part = (columns >= low) & (columns < low + 1024)
        matrix = np.zeros((m, 1024), np.float32)
        matrix[rows[part], columns[part] - low] = 1
        both += matrix @ matrix.T
    return both


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label, len(linked)).min(axis=1)
        lower = np.minimum(label, near)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _classes(signed: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    counted = (
        links.select(F.col("a").alias("v"), F.col("a_links").alias("n"))
        .union(links.select("b", "b_links"))
        .groupBy("v")
        .agg(F.sum("n").alias("n_links"))
    )
    labels = components(links).select(F.col("node").alias("v"), "label")
    known = texts.select("v", "copy_of", "n_copies")
    linked = labels.join(known, "v")
    smallest = linked.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    described = (
        known.join(labels.join(smallest, "label"), "v", "left")
        .join(counted, "v", "left")
        .select(
            "v",
            F.coalesce("label", "v").alias("label"),
            F.coalesce("class_id", "copy_of").alias("class_id"),
            "copy_of", "n_copies",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )
    return signed.select("id", "k1", "k2", "v").join(described, "v").drop("v")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                **options) -> DataFrame:
    """The document with the smallest id of every class, with the columns of `docs`. Of rows
    equal in id and text any one stays."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    first = (
        found.groupBy("label")
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("first"))
        .select("first.k1", "first.k2")
    )
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        *row_keys(F.col(id_col), F.col(text_col).cast("string")),
    )
    return keyed.join(first, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
