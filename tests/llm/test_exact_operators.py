"""Operators against plain Python on documents with every awkward case."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from samples import BASE, PASSAGE, documents, texts, words
from tokenizers import Tokenizer

from paneloom.llm import bpe, decontamination, line_dedup, sharding, suffix_dedup
from paneloom.llm.queries import VOCABULARY

WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# sharding


@pytest.mark.parametrize("shards", [1, 3, 8, 100])
def test_shards_are_contiguous_and_even(spark, shards):
    got = sharding.assign_shards(documents(spark), shards, carry=["lang", "shard"]).collect()
    sizes = [len((t or "").encode()) + 1 for _, t in texts()]
    assert Counter(r["size"] for r in got) == Counter(sizes)
    assert Counter(r.text_crc32 for r in got) == Counter(
        zlib.crc32((t or "").encode()) for _, t in texts()
    )
    total, largest = sum(sizes), max(sizes)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    assert set(per) <= set(range(shards))
    for rows in per.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / shards) <= largest
    order = [r.doc_id if r.doc_id is not None else -1
             for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_one_hot_id_is_spread(spark):
    docs = spark.range(2000).select(F.lit(1).alias("doc_id"), F.lit("abc").alias("text"))
    got = sharding.assign_shards(docs, 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [500] * 4


def test_shards_are_written(spark, tmp_path):
    sharding.write_shards(documents(spark).select("doc_id", "text"), 3, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(texts())


def test_empty_tables(spark):
    none = documents(spark, [])
    assert sharding.assign_shards(none, 8).count() == 0
    assert line_dedup.drop_shared_lines(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert bpe.encode(none, VOCABULARY).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_passages(none, items).count() == 0
    assert decontamination.find_passages(documents(spark), items).filter("n_hit > 0").count() == 0


# lines


def kept_lines(rows, least):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[lower(line).strip(WHITE)].add(i)
    shared = {k for k, ids in holders.items() if k and len(ids) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if lower(x).strip(WHITE) not in shared]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("least", [1, 2, 10])
def test_shared_lines(spark, least):
    rows = texts() + [(300 + i, "very common\nand rare %d" % (i % 40)) for i in range(3000)]
    got = line_dedup.drop_shared_lines(documents(spark, rows), least)
    assert Counter(
        (r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()
    ) == kept_lines(rows, least)


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_lines_held_too_often_are_decided_by_their_sum(spark, held):
    """One id, null included, with thousands of rows; lines with too few and with enough."""
    rows = texts() + [(None, "same line\nnull row %d" % (i % 9)) for i in range(900)]
    rows += [(5000, "\n".join(["one document"] * 3000))]
    rows += [(6000 + i % 12, "many rows\nof twelve") for i in range(1500)]
    rows += [(7000 + i % 4, "many rows of four") for i in range(1500)]
    docs = documents(spark, rows).repartition(7)
    bitmaps = line_dedup.keep_bitmaps(docs, 10, held=held)
    got = line_dedup.cut_lines(docs, bitmaps).collect()
    assert Counter(
        (r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got
    ) == kept_lines(rows, 10)


def test_a_document_of_very_many_rows_is_not_held(spark):
    rows = 400_000
    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("n_lines", pa.int32()), ("pos", pa.int32()), ("h1", pa.int64()),
                        ("h2", pa.int64())])

    def batches():
        for at in range(0, rows, 10_000):
            n = 10_000
            same = pa.array([1] * n)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.array(range(at, at + n)), same,
                 pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int32()), same, same],
                schema=schema,
            )

    out, given, most = 0, 0, 0
    for i, batch in enumerate(line_dedup._shared_lines(batches(), 10, 0, 20_000)):
        kinds = batch["kind"].to_pylist()
        given += kinds.count(line_dedup.OPEN)
        out += kinds.count(line_dedup.BORDER)
        most = max(most, batch.num_rows)
    assert given == rows and out == 1 and most <= 40_000


def test_bitmaps_hold_a_bit_per_line(spark):
    rows = line_dedup.keep_bitmaps(documents(spark), 10).collect()
    assert len(rows) == 13
    for r in rows:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines)
        assert r.n_lines - bits.sum() == r.n_dropped > 0


# passages


def passages(rows, items, n=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


ITEMS = [(1, PASSAGE), (2, "one"), (3, None), (4, ""), (5, "A, b c"), (None, BASE), (7, BASE),
         (7, "tail"), (10, "ab " * 20)]


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_passages_by_broadcast_and_by_join(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark)
    got = decontamination.find_passages(docs, items, max_bytes=most).collect()
    assert Counter(
        (r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got
    ) == passages(texts(), ITEMS)


def test_windows_that_share_a_hash_are_told_apart_by_their_words(monkeypatch):
    monkeypatch.setattr(
        decontamination._Windows, "codes", staticmethod(lambda w: np.ones(len(w), np.uint64))
    )
    known = decontamination._Windows([("x", b"a b c"), ("y", b"b c d"), ("z", b"q")], 2)
    found = list(known.places([b"z", b"b", b"c", b"q"]))
    assert found == [(3, 1, {2}), (1, 2, {0, 1})]
    assert list(decontamination._Windows([], 13).places([b"a"])) == []


def test_removal_of_documents_and_spans(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    docs = documents(spark)
    kept = decontamination.remove_documents(docs, items)
    assert kept.columns == docs.columns
    assert {17, 18, 19}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() == len(texts()) - 3
    clean = {r.row.doc_id: r.clean_text for r in decontamination.remove_spans(docs, items).collect()}
    assert clean[17] == "start  end" and clean[18] == "Another , yes" and clean[19] == ""
    assert clean[1] is None and clean[11] == BASE


# BPE


def test_ids_and_texts_match_the_library(spark):
    rows = texts() + [
        (500, "a<|endoftext|>b <|endoftext|>"), (501, "it's we'll  two   spaces \n\n x"),
        (502, "naïve 日本語 ‍﻿ 12345 --- \r\n"), (503, "aaaa" * 500 + " " + "ha" * 900),
    ]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    out = bpe.decode(bpe.encode(documents(spark, rows), VOCABULARY), VOCABULARY)
    got = Counter(
        (r.row.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), r.decoded)
        for r in out.collect()
    )
    assert got == want


def test_both_merge_loops_agree():
    with open(VOCABULARY, encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = random.Random(3)
    for _ in range(200):
        raw = [vocabulary.byte_ids[b] for b in rng.choices(b"the ainorst", k=rng.randint(1, 80))]
        assert vocabulary._short(list(raw)) == vocabulary._long(list(raw))
    assert vocabulary.decode(np.array([255, 10**6], np.uint32)) == "�"


# repeats


def repeats(rows, window):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + window] for _, b in raw for i in range(len(b) - window + 1))
    out = []
    for doc, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        starts = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((doc, len(b), starts, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def sampled_texts():
    rng = random.Random(5)
    parts = ["".join(rng.choices("abcdefgh ", k=rng.randint(30, 400))) for _ in range(6)]
    rows = [
        (1000 + i, "".join(rng.choice(parts)[rng.randint(0, 25):] for _ in range(rng.randint(1, 5))))
        for i in range(60)
    ]
    return rows + [(2000, "ab" * 300), (2001, "z" * 999), (2002, "é" * 150), (2003, PASSAGE + BASE)]


@pytest.mark.parametrize("index_bytes", [suffix_dedup.INDEX_BYTES, 0])
def test_repeated_windows(spark, index_bytes):
    rows = [r for r in texts() if r[0] != 9] + sampled_texts()
    got = suffix_dedup.remove_repeats(documents(spark, rows), index_bytes=index_bytes)
    assert Counter(
        (r.row.doc_id, r.n_bytes, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in got.collect()
    ) == repeats(rows, 200)


@pytest.mark.parametrize("window", [33, 50, 200])
def test_the_index_finds_every_window(window):
    rng = random.Random(window)
    for _ in range(25):
        parts = [bytes(rng.choices(b"abcd", k=rng.randint(20, 250))) for _ in range(4)]
        segments = [
            b"".join(rng.choice(parts)[rng.randint(0, 19):] for _ in range(rng.randint(0, 4)))
            for _ in range(rng.randint(1, 10))
        ]
        seen = Counter(s[i : i + window] for s in segments for i in range(len(s) - window + 1))
        want = [[i for i in range(len(s) - window + 1) if seen[s[i : i + window]] > 1]
                for s in segments]
        got = suffix_dedup.repeated_starts(segments, window)
        assert [g.tolist() for g in got] == want


def sorted_segments(groups):
    """A batch of segments from (name, content, rows)."""
    rows = [(name, content) for name, content, n in groups for _ in range(n)]
    places = range(len(rows))
    types = [*[pa.int64()] * 3, *[pa.int32()] * 3, pa.bool_()]
    columns = [*zip(*rows), places, places, [0] * len(rows), [9] * len(rows), [False] * len(rows)]
    names = ["name", "content", "k1", "k2", "start", "n", "loops"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


@pytest.mark.parametrize("hot", [[(2, 1, 1), (2, 2, 30)], [(2, 1, 30), (2, 2, 1)],
                                 [(2, 1, 1), (2, 2, 30), (2, 3, 1), (2, 4, 30)]])
@pytest.mark.parametrize("held_rows", [4, 7, 1000])
@pytest.mark.parametrize("size", [1, 3, 100])
def test_contents_of_a_hot_name_stay_candidates(hot, held_rows, size):
    groups = [(1, 5, 2), *hot, (3, 7, 30), (4, 8, 2)]
    batch = sorted_segments(groups)
    batches = [batch.slice(i, size) for i in range(0, batch.num_rows, size)]
    out = [r for b in suffix_dedup._sorted_out(iter(batches), held_rows) for r in b.to_pylist()]
    content = np.repeat([c for _, c, _ in groups], [n for *_, n in groups])
    marked = Counter(r["k1"] for r in out if r["kind"] == suffix_dedup.MARK)
    assert marked == Counter(np.flatnonzero(np.isin(content, [c for _, c, n in groups if n > 1])))
    wanted = {content[r["k1"]] for r in out if r["kind"] == suffix_dedup.CANDIDATE}
    assert wanted == {5, *(c for _, c, _ in hot), 8}
