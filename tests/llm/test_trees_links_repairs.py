"""Manifests, SimHash classes and repaired conversations against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import plain_conversations
import pytest
import xxhash
from oracle import DATA
from pyspark.sql import functions as F
from samples import documents, texts

from paneloom.llm import conversations, merkle, simhash
from paneloom.llm.components import components
from paneloom.llm.queries import LEAF, QUERIES

SF = f"{DATA}/sf0.001"
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(cells):
    return h(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def grown(digests):
    """Levels of a tree, leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def proofs(rows):
    """Counter of (doc_id, leaf, subroot, root, proof digest) of (doc_id, source, lang, n, text)."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grown([x[2] for x in sorted(by[s])]) for s in sources]
    top = grown([t[-1][0] for t in trees])
    out = Counter()
    for i, s in enumerate(sources):
        for place, (*_, leaf, doc) in enumerate(sorted(by[s])):
            path, at = [], place
            for level in trees[i][:-1]:
                run = level[at // 16 * 16 : at // 16 * 16 + 16]
                path += run[: at % 16] + run[at % 16 + 1 :]
                at //= 16
            at = i
            for level in top[:-1]:
                run = level[at // 16 * 16 : at // 16 * 16 + 16]
                path += run[: at % 16] + run[at % 16 + 1 :]
                at //= 16
            out[doc, leaf, trees[i][-1][0], top[-1][0], h(*path)] += 1
    return out


def proved(made, which=None):
    return Counter(
        (r.id, r.leaf, r.subroot, r.root, r.p)
        for r in merkle.prove(made, which).select(
            F.col("row.doc_id").alias("id"), "leaf", "subroot", "root",
            merkle.proof_digest(F.col("proof")).alias("p"),
        ).collect()
    )


def sourced(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    return spark.createDataFrame(rows, schema).withColumns(
        {c: F.lit("x") for c in ("leaf", "tree", "rank", "row", "part", "digest")}
    )


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [300, 1, 16, 15, 2] + [3] * 20])
def test_manifest(spark, sizes):
    rows = []
    for s, size in enumerate(sizes):
        source = None if s == 1 else f"é{s}" if s % 3 else f"s{s}"
        rows += [(1000 * s + i, source, None if i % 5 else "en", i, f"T{i}\né") for i in range(size)]
    rows += [rows[0], rows[0], (None, rows[0][1], None, None, None), (7, rows[0][1], "", 0, "-")]
    random.Random(1).shuffle(rows)
    made = merkle.manifest(sourced(spark, rows).repartition(5), LEAF)
    assert proved(made) == proofs(rows)


def test_some_leaves_and_folding(spark):
    rows = [(i, f"s{i % 3}", None, None, f"Text {i}") for i in range(200)]
    made = merkle.manifest(sourced(spark, rows), LEAF)
    want = Counter({k: n for k, n in proofs(rows).items() if k[0] % 7 == 0})
    assert proved(made, F.col("row.doc_id") % 7 == 0) == want
    shown = merkle.prove(made).select(
        merkle.folded(F.col("leaf"), F.col("proof")).alias("right"),
        merkle.folded(F.sha2(F.lit("x"), 256), F.col("proof")).alias("wrong"), "root",
    )
    assert shown.filter("right = root AND wrong <> root").count() == 200
    assert merkle.prove(made, F.lit(False)).count() == 0


def test_manifest_of_awkward_and_no_rows(spark):
    docs = documents(spark)
    made = merkle.manifest(docs, LEAF, carry=docs.columns)
    rows = [(i, "src0", None, None if t is None else len(t), t) for i, t in texts()]
    assert proved(made) == proofs(rows)
    empty = merkle.manifest(docs.limit(0), LEAF)
    assert empty.root is None and merkle.prove(empty).count() == 0


def test_op11_tampering(spark):
    rows = QUERIES["op11_merkle"].run(spark, SF).collect()
    for r in rows:
        chosen = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert chosen or (r.verified and r.folded_root == r.root)
    assert any(not r.verified for r in rows)


# SimHash


def fingerprint(text):
    found = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(TABLE))
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def linked(rows, radius=2):
    """Counter of (id, fingerprint, component) by comparing all pairs."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[top(a)] = top(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return Counter((i, f, least.get(top(f))) for i, f in rows)


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2):
        tables = simhash.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for i in range(64):
            for j in range(64):
                differ = 1 << i | 1 << j if radius == 2 else 1 << i
                assert any(m & differ == 0 for m in tables)
        assert all(28 <= m.bit_count() <= 44 for m in tables)


def test_fingerprints_and_classes(spark):
    rows = texts() + [(900, "a B c\td\x0be"), (901, "a b c d e"), (902, "\x1c x\x85y")]
    docs = documents(spark, rows)
    got = Counter(
        (r.doc_id, r.f % 2**64, r.c)
        for r in simhash.near_classes(docs, carry=docs.columns)
        .select("row.doc_id", F.col("fingerprint").alias("f"), F.col("component").alias("c"))
        .collect()
    )
    assert {(i, f % 2**64) for i, f, _ in got} == {(i, fingerprint(t)) for i, t in rows}
    assert got == linked([(i, fingerprint(t)) for i, t in rows])
    assert simhash.near_classes(docs.limit(0)).count() == 0


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97} {i}" for i in range(700))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 13)
    assert simhash.fingerprint(text) == whole and whole % 2**64 == fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2])
def test_links_equal_all_pairs(spark, radius):
    """Chains, dense groups and lone fingerprints; one hot bucket."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for base in list(prints)[:12]:
        at = base
        for _ in range(40):
            at ^= 1 << rng.randrange(64)
            prints |= {at, at ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    prints |= {5 << 40 | i for i in range(300)}  # one bucket of a table that leaves low bits free
    found = spark.createDataFrame([(simhash.signed(f),) for f in prints], "fingerprint long")
    edges = simhash.links(found, radius)
    assert all((a ^ b).bit_count() <= radius for a, b in ((a % 2**64, b % 2**64) for a, b in edges.collect()))
    label = {r.node: r.label for r in components(edges).collect()}
    groups = defaultdict(set)
    for f in prints:
        groups[label.get(simhash.signed(f), simhash.signed(f))].add(f)
    want = defaultdict(set)
    for _, f, c in linked([(f, f) for f in prints], radius):
        want[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_op12(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = Counter(tuple(r) for r in QUERIES["op12_simhash"].run(spark, SF).collect())
    want = linked([(r.doc_id, fingerprint(r.text)) for r in docs])
    assert got == Counter({(i, f"{f:016x}", c): n for (i, f, c), n in want.items()})


# conversations

FAULT = {"b": "blank", "d": "duplicate", "t": "truncated", ".": "fine"}
ROLES = {"s": "system", "u": "user", "a": "assistant", "x": "other"}


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_edits_whole_and_in_blocks(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.choice([0, 1, 2, 3, 5, 8, 20, 50])
        symbols = "".join(rng.choice("suaxuua") + rng.choice("....tttbd") for _ in range(n))
        rows = [(0, 0, ROLES[s], "x") for s in symbols[::2]]
        want = plain_conversations.best(rows, [FAULT[f] for f in symbols[1::2]])
        cost, edits, _ = conversations.Lattice(symbols, conversations.ACCEPTED).trace(0)
        assert (cost, edits) == want[:2]
        lines, _ = conversations.repaired([(r, t) for _, _, r, t in rows], edits)
        assert lines == list(want[2])
        if not n:
            continue
        size = rng.choice([1, 2, 3, 7])
        blocks = [symbols[i : i + 2 * size] for i in range(0, 2 * n, 2 * size)]
        table = [
            dict(conv=1, part=0, block=i, symbols=b, is_last=i == len(blocks) - 1)
            for i, b in enumerate(blocks)
        ]
        priced = conversations._exits(reversed(list(conversations._costs(table))))
        chosen = list(conversations._chosen(reversed(list(conversations._traces(priced)))))
        assert "".join(r["edits"] for r in chosen) == edits and chosen[0]["cost"] == cost


def test_prices_of_a_long_conversation_settle_in_linear_time():
    steps = []
    for n in (2000, 8000):
        lattice = conversations.Lattice("u.a." * (n // 2), conversations.ACCEPTED)
        arcs, count = lattice.arcs, [0]

        def counted(node):
            count[0] += 1
            return arcs(node)

        lattice.arcs = counted
        lattice._sweep()
        assert lattice.trace(0)[0] == 0
        steps.append(count[0])
    assert steps[1] < 5 * steps[0]


def awkward():
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 1, "user", "ok."), (1, None, "user", " "), (1, 5, "", "x"),
            (2, 0, "system", "s."), (2, 1, "user", "Q?"), (2, 2, "assistant", "A."), (2, 2, "assistant", "A."),
            (3, 0, "", "a."), (3, 1, "User", "a."), (3, 9, "user", "a."), (4, 0, "user", "\n\t ")]
    for conv in range(10, 60):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, turn if rng.random() < 0.9 else 3, rng.choice(["user", "assistant", "system", None, "tool"]),
                         rng.choice(["Yes.", "No", "why?", "", None, "é!", "long " * 50 + "."])))
    rows += [(500, i, rng.choice(["user", "assistant"]), f"t{i % 90}.") for i in range(400)]
    return rows


@pytest.mark.parametrize("held, block", [(4096, 4096), (5, 3), (1, 1)])
def test_repair(spark, held, block):
    rows = awkward()
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).withColumns(
        {c: F.lit("z") for c in ("conv", "part", "place", "cost", "audit")}
    ).repartition(4)
    made = conversations.damaged(df)
    every = df.select("conv_id").distinct()
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(made, every=every, held=held, block=block).collect()}
    want = plain_conversations.results(plain_conversations.damaged(rows), {r[0] for r in rows})
    assert got == want


def test_repair_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(df).count() == 0
    only = spark.createDataFrame([(7,)], "conv_id long")
    row = conversations.repair(df, every=only).collect()
    assert [tuple(r) for r in row] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_conversations.results(plain_conversations.damaged(rows), {r[0] for r in rows})
    result = QUERIES["op13_conversations"].run(spark, SF)
    assert {r[0]: tuple(r)[1:] for r in result.collect()} == want
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
                              "cost", "audit", "repaired_sha256"]
