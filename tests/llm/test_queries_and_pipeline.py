"""Every named query against its SQL or a plain version, and the pipeline stage by stage."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import DATA, compare, connect
from samples import documents, texts, words
from test_exact_operators import kept_lines, passages
from test_joins_and_records import classes, spans
from test_learned_operators import base_counts
from tokenizers import Tokenizer

import corpus_pipeline
from paneloom.llm import decontamination, quality
from paneloom.llm.queries import QUERIES, VOCABULARY

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_its_sql(spark, con, name):
    assert compare(QUERIES[name].run(spark, SF), con, QUERIES[name].sql) is None


def test_op1(spark, docs):
    rows = QUERIES["op1_sharding"].run(spark, SF).collect()
    total, done, slots = sum(len(t.encode()) + 1 for _, t in docs), 0, Counter()
    want = []
    for i, t in sorted(docs):
        size = len(t.encode()) + 1
        shard = (2 * done + size) * 8 // (2 * total)
        want.append((i, size, zlib.crc32(t.encode()), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        done += size
    assert sorted(tuple(r) for r in rows) == want


def test_op2(spark, docs):
    rows = QUERIES["op2_toxicity"].run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op5(spark, docs):
    rows = QUERIES["op5_quality"].run(spark, SF).collect()
    own = {i: base_counts(t) for i, t in docs}
    for r in rows:
        assert own[r.doc_id] == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                                 r.n_repeat_words)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.rule is None)


def test_op6(spark, docs):
    rows = QUERIES["op6_jaccard"].run(spark, SF).collect()
    assert Counter(
        (r.doc_id, r.class_id, r.copy_of, r.n_copies, r.n_links) for r in rows
    ) == classes(docs)


def test_op7(spark, docs):
    library = Tokenizer.from_file(VOCABULARY)
    want = {}
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = (len(ids), hashlib.sha256(raw).hexdigest(),
                   hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    rows = QUERIES["op7_bpe"].run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_op9(spark, con):
    rows = QUERIES["op9_warc"].run(spark, SF).collect()
    pages = [p for (p,) in con.execute("SELECT page_id FROM pages").fetchall()]
    assert Counter((r.page_id, r.type) for r in rows) == Counter(
        (p, kind) for p in pages for kind in ("metadata", "conversion")
    )
    assert len({r.record_id for r in rows}) == len(rows)
    assert len({r.refers_to for r in rows}) == len(pages)


def test_op10(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache",
               "cc by": "cc-by", "mit license": "mit"}
    for r in QUERIES["op10_licenses"].run(spark, SF).collect():
        text = dict(docs)[r.doc_id]
        w = words(text)
        at = [(i, label) for phrase, label in phrases.items() for i in range(len(w))
              if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert r.labels == ",".join(sorted({label for label, *_ in spans(text)}))


# the pipeline


def plain_pipeline(rows, items, rules_reject):
    """(doc_id, text) of what is left before encoding, without Spark."""
    good = [(i, t) for i, t in rows if not rules_reject(t)]
    cut = []
    for (i, text, _, _), times in kept_lines(good, 10).items():
        cut += [(i, text)] * times
    holders = defaultdict(list)
    own_class = {}
    for i, class_id, *_ in classes(cut):
        own_class[i] = class_id
    for i, text in cut:
        holders[own_class[i]].append((i, text))
    first = [min(members) for members in holders.values()]
    kept = []
    for i, text in first:
        ((_, n_words, n_hit, _),) = passages([(i, text)], items)
        if not (n_hit and 20 * n_hit >= n_words):
            kept.append((i, text))
    return kept


def test_pipeline_against_a_plain_one(spark, con, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
        "BPE encoding and decoding"]
    judged = QUERIES["op5_quality"].run(spark, SF).collect()
    rejected = {i for i in (r.doc_id for r in judged if not r.kept)}
    texts_rejected = {t for i, t in docs if i in rejected}
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = plain_pipeline(docs, items, lambda t: t in texts_rejected)
    rows = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(VOCABULARY)
    assert all(r.decodes for r in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter(
        (i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in want
    )
    assert 0 < len(rows) < len(docs)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_documents(spark, stage):
    run = corpus_pipeline.STAGES[stage][1]
    sample = documents(spark)
    out = run(spark, sample, SF)
    rows = out.collect()
    if stage < 4:
        assert out.columns == sample.columns and dict(out.dtypes) == dict(sample.dtypes)
        assert rows
    else:
        assert len(rows) == len(texts()) and all(r.decodes for r in rows)
    assert run(spark, documents(spark, []), SF).count() == 0


def test_clean_documents_pass_the_filters(spark):
    clean = [(i, " ".join(f"term{i}x{k} of text" for k in range(60))) for i in range(30)]
    sample = documents(spark, clean)
    for stage in (0, 2, 3):
        kept = corpus_pipeline.STAGES[stage][1](spark, sample, SF)
        assert kept.count() == 30
    assert decontamination.WINDOW == 13 and quality.SAMPLE > 0
