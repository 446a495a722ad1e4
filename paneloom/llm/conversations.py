"""Repair of conversations: the cheapest edits that give a legal order of roles.

A conversation is a lattice: before each row the reader is in one of four states (nothing
read, after a system row, after a user row, after an assistant row), and keeping, deleting or
re-roling a row, or inserting one, is an arc with a whole-number cost. The cheapest way is
found by the auction algorithm for shortest paths: every node has a price, a path grows from
the origin along an arc on which the price falls by exactly the arc's cost, and where there is
none, the last node's price is raised to the least that its arcs allow and the path shrinks
by a node. When the path reaches the end, its prices are distances. An arc is tight if prices
differ by its cost; the first audit in ASCII order is read off by following, from the start,
the first tight arc whose head's price has been settled by the same algorithm. Prices are
settled in strides of 16 rows from the end, so that no bidding runs over a long way.

Rows are range-partitioned by conversation and turn and streamed. A conversation that lies
within one partition and has at most `HELD` rows is settled there. Others, which means those
on a border of partitions and long ones, are cut into blocks of `BLOCK` rows: a block's
costs between entry and exit states are one small matrix, the matrices are chained from the
end, every block is then traced on its own for each state it can be entered in, and the chain
from the start says which. No task holds more than a block. The digest of a conversation's
text is sequential by definition: its rows stream in order through one task, a batch at a time.

Defined cases. A null role or text is one space; a null turn comes first; null is a conversation
of its own. Rows of one turn are ordered by role and text (by their first characters, then by
hash), equal rows in any order. A role without a first character, or with one other than s, u
or a, can't be kept. Conversations of `every` without a row give zeros and an empty text. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import WHITE, in_order, shared_table, shuffle_tasks

# Fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}

#: Rows of a conversation that a task holds at most.
HELD = 4096
#: Rows of a block of a longer conversation.
BLOCK = 4096
#: Rows whose prices are settled at a time.
STRIDE = 16
#: Conversations of equal symbols share a solution; so many are remembered.
REMEMBERED = 20_000

START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = {START: 0, ASSISTANT: 0}
KEEPS = {
    "s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT}, "x": {},
}
#: The state after a row that is inserted or given its role.
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60


class Lattice:
    """Rows as symbols, two characters each: the role's initial (s, u, a or x) and the fault
    (b, d, t or `.`). `exits` has the cost from each state after the last row to the end.
    Only in the last block may rows be inserted after the last row; elsewhere that is the
    next block's choice."""

    def __init__(self, symbols: str, exits: dict[int, int], last: bool = True):
        self.rows = [(symbols[i], symbols[i + 1]) for i in range(0, len(symbols), 2)]
        self.n, self.last = len(self.rows), last
        self.exits = {s: c for s, c in exits.items() if c < FAR}
        # States from which an exit can be reached at all.
        self.open = {
            s for s in range(4)
            if any(e >= USER or e == s or (s, e) == (START, SYSTEM) for e in self.exits)
        }
        self.end = 4 * (self.n + 1)
        self.price = [0] * (self.end + 1)
        self.settled = bytearray(self.end + 1)
        self.settled[self.end] = 1
        self._sweep()

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(edit, head, cost), edits in ASCII order; the empty edit leaves the lattice."""
        row, state = divmod(node, 4)
        out = []
        if row == self.n:
            if state in self.exits:
                out.append(("", self.end, self.exits[state]))
            if self.last and NEXT[state] in self.open:
                out.append(("I", 4 * row + NEXT[state], INSERT))
            return out
        initial, fault = self.rows[row]
        out.append(("D", node + 4, DELETE))
        if NEXT[state] in self.open:
            out.append(("I", 4 * row + NEXT[state], INSERT))
        if fault in ".t":
            more = TRUNCATED if fault == "t" else 0
            kept = KEEPS[initial].get(state)
            if kept is not None and kept in self.open:
                out.append(("K", 4 * (row + 1) + kept, more))
            if NEXT[state] in self.open:
                out.append(("R", 4 * (row + 1) + NEXT[state], REROLE + more))
        return out

    def settle(self, origin: int) -> int:
        """Bids until a path from `origin` reaches a settled node; its nodes' prices are then
        distances to the end."""
        price, settled, path = self.price, self.settled, [origin]
        while not settled[path[-1]]:
            node = path[-1]
            best, head = FAR, -1
            for _, to, cost in self.arcs(node):
                if cost + price[to] < best:
                    best, head = cost + price[to], to
            if price[node] < best:  # contract
                price[node] = best
                if len(path) > 1:
                    path.pop()
                elif best >= FAR:
                    settled[origin] = 1
                    return FAR
            else:  # extend
                path.append(head)
        for node in path:
            settled[node] = 1
        return price[origin]

    def _sweep(self) -> None:
        base = min(self.exits.values(), default=FAR)
        top = self.n
        while top >= 0:
            low = max(0, top - STRIDE + 1)
            # A lower bound of all these prices that no arc between them contradicts.
            for node in range(4 * low, 4 * (top + 1)):
                self.price[node] = base if node % 4 in self.open else FAR
                self.settled[node] = node % 4 not in self.open
            if low == 0 and top < STRIDE:
                break  # a short lattice: the trace settles what it needs
            for state in self.open:
                self.settle(4 * low + state)
            base = min((self.price[4 * low + s] for s in self.open), default=FAR)
            top = low - 1

    def trace(self, entry: int) -> tuple[int, str, int]:
        """(cost, edits, exit state): the cheapest edits from an entry state, first in ASCII order."""
        node, edits = entry, []
        cost = self.settle(entry)
        if cost >= FAR:
            return FAR, "", -1
        while node != self.end:
            for edit, head, weight in self.arcs(node):
                if weight + self.price[head] == self.price[node] and (
                    weight + self.settle(head) == self.price[node]
                ):
                    edits.append(edit)
                    at, node = node, head
                    break
            else:  # can't be: a settled price is reached by some arc
                raise AssertionError("no tight arc")
        return cost, "".join(edits), at % 4


def matrix(symbols: str, last: bool) -> list[int]:
    """Costs of a block from each entry state to each exit state, 16 numbers."""
    out = [FAR] * 16
    for e in range(4):
        lattice = Lattice(symbols, {e: 0}, last)
        for a in lattice.open:
            out[4 * a + e] = min(FAR, lattice.settle(a))
    return out


def repaired(rows, edits: str, state: int = START) -> tuple[list[str], int]:
    """Lines `role:text` that the edits make of (role, text) pairs, and the last state."""
    out, rows = [], iter(rows)
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:")
            continue
        role, text = next(rows)
        if edit == "R":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{text}")
        elif edit == "K":
            state = KEEPS[initial_of(role)][state]
            out.append(f"{role}:{text}")
    return out, state


def initial_of(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "x"


def fault_of(text: str, again: bool) -> str:
    bare = text.rstrip(WHITE)
    return "b" if not bare else "d" if again else "." if bare[-1] in ENDS else "t"


def _counts(symbols: str) -> tuple[int, int, int, int]:
    """Blank, duplicate, truncated rows and illegal neighbours."""
    initials, faults = symbols[::2], symbols[1::2]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def _settled_here(rows: list[tuple], known: dict) -> tuple:
    """The result of a conversation, all of whose rows (turn, role, text) are here, in order."""
    seen, symbols = set(), []
    for _, role, text in rows:
        symbols.append(initial_of(role) + fault_of(text, (role, text) in seen))
        seen.add((role, text))
    symbols = "".join(symbols)
    if symbols not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        known[symbols] = Lattice(symbols, ACCEPTED).trace(START)[:2]
    cost, edits = known[symbols]
    turns = {turn for turn, _, _ in rows if turn is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    lines, _ = repaired([(role, text) for _, role, text in rows], edits)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *_counts(symbols), cost, edits, digest)


def _streamed(names: list[str], held: int):
    """Settles the conversations that lie within a partition; gives the rows of others back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        out: dict[str, list] = {n: [] for n in names}

        def give(conv, row=None, result=None):
            for n, v in zip(names[1:6], row or [None] * 5):
                out[n].append(v)
            out["conv"].append(conv)
            for n, v in zip(RESULT_NAMES, result or [None] * len(RESULT_NAMES)):
                out[n].append(v)

        def batch(schema) -> pa.RecordBatch:
            arrays = [pa.array(out[f.name], f.type) for f in schema]
            for values in out.values():
                values.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        current, waiting, whole, schema = None, [], False, None
        for b in batches:
            if schema is None:
                schema = _schema(b.schema)
            columns = [b[n].to_pylist() for n in names[:6]]
            for conv, *row in zip(*columns):
                if current is None or conv != current[0]:
                    if whole:
                        real = [(r[2], r[3], r[4]) for r in waiting if r[3] is not None]
                        give(current[0], None, _settled_here(real, known))
                    else:  # the first of the partition, or a long one's last rows
                        for r in waiting:
                            give(current[0], r)
                    whole, waiting = current is not None, []
                    current = (conv,)
                waiting.append(row)
                if not whole or len(waiting) > held:
                    whole = False
                    for r in waiting:
                        give(conv, r)
                    waiting = []
            if len(out["conv"]) > 1000:
                yield batch(schema)
        for r in waiting:  # the last of the partition
            give(current[0], r)
        if schema is not None:
            yield batch(schema)

    return run


def _schema(rows: pa.Schema) -> pa.Schema:
    result = [
        pa.field(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64())
        for n in RESULT_NAMES
    ]
    return pa.schema([*(pa.field(f.name, f.type) for f in rows), *result])


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    every: DataFrame | None = None,
    held: int = HELD,
    block: int = BLOCK,
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row
    for each conversation of the table and of `every`, a table of conversation ids. Equal
    ids of `every` should be given once."""
    rows = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    if every is not None:
        alone = every.select(
            F.col(every.columns[0]).alias("conv"),
            F.lit(None).cast("long").alias("turn"),
            F.lit(None).cast("string").alias("role"),
            F.lit(None).cast("string").alias("text"),
        )
        rows = rows.union(alone)
    keyed = rows.select(
        "*",
        F.substring("role", 1, 32).alias("role_start"),
        F.substring("text", 1, 64).alias("text_start"),
        F.xxhash64("role", "text").alias("hash"),
        F.monotonically_increasing_id().alias("nth"),
    )
    order = ["conv", "turn", "role_start", "text_start", "hash", "nth"]
    ordered = in_order(keyed, order).select("conv", "part", "place", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    names = [*kinds, *RESULT_NAMES]
    schema = ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", " + RESULT
    streamed = shared_table(ordered.mapInArrow(_streamed(names, held), schema), "conversations")
    done = streamed.filter("cost IS NOT NULL").select("conv", *RESULT_NAMES)
    rest = streamed.filter("cost IS NULL").select(*kinds)
    return done.union(_long(rest, block))


# --- conversations that no task settles alone ------------------------------------------


def _with_symbols(rows: DataFrame) -> DataFrame:
    """Adds `symbol` to rows with a role; the first of equal rows is no duplicate."""
    rows = rows.filter("role IS NOT NULL")
    at = F.struct("part", "place")
    firsts = (
        rows.groupBy("conv", F.xxhash64("role", "text"), F.xxhash64(F.lit(7), "text", "role"))
        .agg(F.min(at).alias("first"))
        .select("first.part", "first.place", F.lit(True).alias("is_first"))
    )
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    fault = (
        F.when(last == "", "b")
        .when(F.col("is_first").isNull(), "d")
        .when(last.isin(*ENDS), ".")
        .otherwise("t")
    )
    start = F.substring("role", 1, 1)
    initial = F.when(start.isin("s", "u", "a"), start).otherwise("x")
    return rows.join(firsts, ["part", "place"], "left").select(
        "conv", "part", "place", F.concat(initial, fault).alias("symbol")
    )


def _chained(blocks: DataFrame, order: list, schema: str, run) -> DataFrame:
    """Streams the blocks of each conversation in order through `run`."""
    tasks = shuffle_tasks(blocks.sparkSession)
    return (
        blocks.repartition(tasks, "conv").sortWithinPartitions("conv", *order).mapInArrow(run, schema)
    )


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _arrow(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow_schema(conv: pa.DataType, text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    fields = [f.rsplit(" ", 1) for f in text.split(", ")]
    return pa.schema([("conv", conv), *((n, kinds[t]) for n, t in fields)])


def _per_row(run, schema: str):
    """A function from rows to rows as one on batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        arrow = _arrow_schema(first.schema.field("conv").type, schema)

        def every():
            yield first
            yield from batches

        yield from _arrow(run(_rows_of(every())), arrow)

    return task


def _costs(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        blank, duplicate, truncated, illegal = _counts(row["symbols"])
        yield {
            **row, "costs": matrix(row["symbols"], row["is_last"]), "blank": blank,
            "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
        }


def _exits(rows: Iterator[dict]) -> Iterator[dict]:
    """From the last block to the first: the cost from each exit state to the end."""
    entry = None
    for row in rows:
        exits = [ACCEPTED.get(s, FAR) for s in range(4)] if row["is_last"] else entry
        costs = row["costs"]
        entry = [
            min(FAR, *(costs[4 * a + e] + exits[e] for e in range(4))) for a in range(4)
        ]
        yield {k: v for k, v in row.items() if k != "costs"} | {"exits": exits}


def _traces(rows: Iterator[dict]) -> Iterator[dict]:
    """Every block's cheapest edits from each state it can be entered in."""
    for row in rows:
        lattice = Lattice(row["symbols"], dict(enumerate(row["exits"])), row["is_last"])
        found = [lattice.trace(a) if a in lattice.open else (FAR, "", -1) for a in range(4)]
        yield {k: v for k, v in row.items() if k != "exits"} | {
            "ways": [c for c, _, _ in found], "leaves": [e for _, _, e in found],
            **{f"edits{a}": found[a][1] for a in range(4)},
        }


def _chosen(rows: Iterator[dict]) -> Iterator[dict]:
    """From the first block to the last: the state each is entered in, and running counts."""
    conv, total, state, initial = None, [0, 0, 0, 0], START, ""
    for row in rows:
        if conv is None or conv[0] != row["conv"]:
            conv, total, state, initial = (row["conv"],), [0, 0, 0, 0], START, ""
            cost = row["ways"][START]
        between = bool(initial) and initial + row["symbols"][0] not in LEGAL
        counts = (row["blank"], row["duplicate"], row["truncated"], row["illegal"] + between)
        total = [t + c for t, c in zip(total, counts)]
        initial = row["symbols"][-2]
        edits = row[f"edits{state}"]
        yield {
            "conv": row["conv"], "part": row["part"], "block": row["block"], "edits": edits,
            "is_last": row["is_last"], "blank": total[0], "duplicate": total[1],
            "truncated": total[2], "illegal": total[3], "cost": cost,
        }
        state = row["leaves"][state]


def _row_edits(edits: str) -> list[str]:
    """The edits of each row: insertions before it and its own; the last has those behind too."""
    out, before = [], ""
    for edit in edits:
        before += edit
        if edit != "I":
            out.append(before)
            before = ""
    out[-1] += before
    return out


def _dealt(block: int):
    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            first = row["first"]
            for place, edits in zip(first, _row_edits(row["edits"])):
                yield {"conv": row["conv"], "part": row["part"], "place": place, "edits": edits}

    return run


def _written(rows: Iterator[dict]) -> Iterator[dict]:
    """The digest and the audit of each conversation, whose rows come in order."""
    conv, state, digest, audit, first = None, START, hashlib.sha256(), [], True
    for row in rows:
        if conv is None or conv[0] != row["conv"]:
            if conv is not None:
                yield {"conv": conv[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            conv, state, digest, audit, first = (row["conv"],), START, hashlib.sha256(), [], True
        lines, state = repaired([(row["role"], row["text"])], row["edits"], state)
        audit.append(row["edits"])
        for line in lines:
            digest.update((line if first else "\n" + line).encode())
            first = False
    if conv is not None:
        yield {"conv": conv[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def _long(rows: DataFrame, block: int) -> DataFrame:
    conv_type = rows.schema["conv"].dataType.simpleString()
    place = F.struct("place", "symbol")
    blocks = (
        _with_symbols(rows)
        .groupBy("conv", "part", F.floor(F.col("place") / block).alias("block"))
        .agg(F.sort_array(F.collect_list(place)).alias("all"))  # at most `block` symbols
        .select(
            "conv", "part", "block", F.array_join("all.symbol", "").alias("symbols"),
            F.col("all.place").alias("places"),
        )
    )
    blocks = shared_table(blocks, "blocks")
    ends = blocks.groupBy("conv").agg(F.max(F.struct("part", "block")).alias("end"))
    ends = shared_table(
        ends.select(F.col("conv").alias("_conv"), "end.part", "end.block"), "ends"
    )
    ended = blocks.join(
        ends.select("part", "block", "_conv", F.lit(True).alias("_end")),
        ["part", "block"], "left",
    )
    # (part, block) may hold blocks of several conversations.
    ended = (
        ended.withColumn("_end", F.col("_end") & F.col("conv").eqNullSafe(F.col("_conv")))
        .groupBy("conv", "part", "block")
        .agg(
            F.first("symbols").alias("symbols"),
            F.coalesce(F.bool_or("_end"), F.lit(False)).alias("is_last"),
        )
    )
    base = "part int, block long, symbols string, is_last boolean"
    counts = "blank long, duplicate long, truncated long, illegal long"

    def typed(fields: str) -> str:
        return f"conv {conv_type}, {fields}"

    spread = ended.repartition(shuffle_tasks(rows.sparkSession), "part", "block", "conv")
    shape = f"{base}, costs array<long>, {counts}"
    costs = shared_table(spread.mapInArrow(_per_row(_costs, shape), typed(shape)), "costs")
    shape = f"{base}, {counts}, exits array<long>"
    exits = _chained(
        costs, [F.desc("part"), F.desc("block")], typed(shape), _per_row(_exits, shape)
    )
    spread = exits.repartition(shuffle_tasks(rows.sparkSession), "part", "block", "conv")
    shape = (
        f"{base}, {counts}, ways array<long>, leaves array<long>, "
        + ", ".join(f"edits{a} string" for a in range(4))
    )
    traced = shared_table(spread.mapInArrow(_per_row(_traces, shape), typed(shape)), "traces")
    shape = f"part int, block long, edits string, is_last boolean, {counts}, cost long"
    chosen = shared_table(
        _chained(traced, ["part", "block"], typed(shape), _per_row(_chosen, shape)), "chosen"
    )
    own = blocks.select(
        F.col("conv").alias("_conv"), F.col("part").alias("_part"), F.col("block").alias("_block"),
        F.col("places").alias("first"),
    )
    same = (
        (chosen.part == own._part) & (chosen.block == own._block)
        & chosen.conv.eqNullSafe(own._conv)
    )
    shape = "part int, place long, edits string"
    edits = chosen.join(own, same).select("conv", "part", "edits", "first").mapInArrow(
        _per_row(_dealt(block), shape), typed(shape)
    )
    real = rows.filter("role IS NOT NULL").select("conv", "part", "place", "role", "text")
    shape = "audit string, repaired_sha256 string"
    written = _chained(
        real.join(edits.drop("conv"), ["part", "place"]), ["part", "place"], typed(shape),
        _per_row(_written, shape),
    )
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count("turn"))
        .cast("long").alias("gaps")
    )
    totals = chosen.filter("is_last")

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("conv", name)

    zero = F.lit(0).cast("long")
    out = turns.join(named(totals, "_t"), F.col("conv").eqNullSafe(F.col("_t")) & F.col("cost").isNotNull(), "left")
    out = out.join(
        named(written, "_w"), F.col("conv").eqNullSafe(F.col("_w")) & F.col("audit").isNotNull(), "left"
    )
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv", F.coalesce("gaps", zero).alias("gaps"),
        *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damaged(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The table with repeatable faults, by the checksum of `conv:turn`: rows dropped, emptied,
    cut, repeated or given to the user. Nulls are one space, but for the turn itself."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    rows = conversations.select(
        F.col(conv_col), F.col(turn_col), known(role_col).alias("_role"),
        known(text_col).alias("_text"), code.alias("_code"),
    ).filter("_code <> 0")
    copies = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        conv_col, turn_col,
        F.when(F.col("_code") == 4, "user").otherwise(F.col("_role")).alias(role_col),
        F.when(F.col("_code") == 1, "")
        .when(F.col("_code") == 2, F.translate("_text", ENDS, ""))
        .otherwise(F.col("_text"))
        .alias(text_col),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")
