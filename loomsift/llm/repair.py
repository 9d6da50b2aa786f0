"""Repair of the turn structure of conversations: the cheapest edits, found by a min-plus dynamic program over runs.

A conversation is a string of symbols, one per row: must go (blank or duplicate), or a class of role (system, user, assistant,
other) that is whole or truncated. What the kept rows may spell, ``(s?(ua)+)?``, is an automaton of four states. A row is a
4 x 4 matrix of costs, a run of n equal symbols its n-th min-plus power, made of cached binary powers. The vector of
costs to go is carried over the runs from the end; then the choices are unrolled from the start, taking the least letter that keeps the cost.

Matrices are associative, so a conversation need not be in one task: rows are dealt by ranges of (conversation, turn, role,
text) and cut in blocks. One in a single block is solved there; the blocks of others go by their matrices alone.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import mapped, stored

START, SYSTEM, USER, ASSISTANT = range(4)  # what the rows so far end in
#: State after one more row of the only role that may be put there by Rerole or Insert, and the role of a state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("", "", "user", "assistant")
#: State after keeping a row of class system, user, assistant, other.
KEEP = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: Inserts that complete the rows so far.
TAIL = (0, 2, 1, 0)

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 60
GONE = 0
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

#: Characters of text and roles in a block.
BLOCK = 1 << 20
#: Rows of a run that are unrolled at once.
STRIDE = 256

Vector = tuple[int, int, int, int]
END: Vector = tuple(INSERT * n for n in TAIL)


def symbol_of(role: str, fault: int) -> int:
    """Faults: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    kind = "sua".find(role[:1]) if role else 3
    return GONE if fault in (1, 2) else 1 + 2 * (kind if kind >= 0 else 3) + (fault == 3)


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of what may be done with a row."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        kind, cut = divmod(symbol - 1, 2)
        if KEEP[state][kind] is not None:
            found.append(("K", TRUNCATED * cut, KEEP[state][kind]))
        found.append(("R", REROLE + TRUNCATED * cut, NEXT[state]))
    return found


def _product(a, b):
    return tuple(tuple(min(FAR, *(x + y for x, y in zip(row, column))) for column in zip(*b)) for row in a)


@lru_cache(maxsize=None)
def power(symbol: int, k: int):
    """Min-plus matrix of ``2**k`` rows of one symbol, each with inserts before it."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in _moves(symbol, state):
            row[state][to] = min(row[state][to], cost)
    inserts = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for state in range(4):
        inserts[state][NEXT[state]] = INSERT
        inserts[state][NEXT[NEXT[state]]] = min(inserts[state][NEXT[NEXT[state]]], 2 * INSERT)
    return _product(inserts, row)


def _plain(vector: Vector) -> tuple[int, Vector]:
    low = min(vector)
    return low, tuple(min(FAR, v - low) if v < FAR else FAR for v in vector)


@lru_cache(maxsize=1 << 16)
def _advanced(symbol: int, n: int, vector: Vector) -> Vector:
    k = 0
    while n:
        if n & 1:
            vector = tuple(min(FAR, *(x + y for x, y in zip(row, vector))) for row in power(symbol, k))
        n, k = n >> 1, k + 1
    return vector


def advance(symbol: int, n: int, after: Vector) -> Vector:
    """Costs to go before a run, from those after it."""
    low, vector = _plain(after)
    return tuple(v + low if v < FAR else FAR for v in _advanced(symbol, n, vector))


@lru_cache(maxsize=1 << 16)
def _unrolled(symbol: int, n: int, after: Vector, state: int) -> tuple[str, int]:
    """Letters of ``n`` rows of one symbol from ``state``, and the state behind them."""
    costs = [after]
    for _ in range(n):
        costs.append(advance(symbol, 1, costs[-1]))
    letters = []
    for left in range(n, 0, -1):
        while True:
            options = [(a, c + costs[left - 1][to], to) for a, c, to in _moves(symbol, state)]
            options.append(("I", INSERT + costs[left][NEXT[state]], NEXT[state]))
            letter, _, state = min(o for o in options if o[1] == costs[left][state])
            letters.append(letter)
            if letter != "I":
                break
    return "".join(letters), state


def unroll(runs: list[tuple[int, int]], after: Vector, state: int) -> tuple[str, int]:
    """The least letters among the cheapest edits of runs of symbols from ``state``, and the state behind them."""
    behind = [after]
    for symbol, n in reversed(runs):
        behind.append(advance(symbol, n, behind[-1]))
    letters = []
    for (symbol, n), last in zip(runs, reversed(behind[:-1])):
        while n:
            n -= (now := min(n, STRIDE))
            part, state = _unrolled(symbol, now, _plain(advance(symbol, n, last))[1], state)
            letters.append(part)
    return "".join(letters), state


def before(runs: list[tuple[int, int]], after: Vector) -> Vector:
    for symbol, n in reversed(runs):
        after = advance(symbol, n, after)
    return after


def matrix(runs: list[tuple[int, int]]) -> list[int]:
    """Costs from each state to each over the runs, by rows."""
    columns = [before(runs, tuple(0 if s == to else FAR for s in range(4))) for to in range(4)]
    return [columns[to][s] for s in range(4) for to in range(4)]


def solve(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and letters of a whole conversation."""
    letters, state = unroll(runs, END, START)
    return before(runs, END)[START], letters + "I" * TAIL[state]


def edited(rows: list[tuple[str, str, int]], letters: str, state: int = START) -> tuple[list[str], int]:
    """``role:text`` of what the letters leave of rows ``(role, text, copies)``, and the state behind it."""
    each, lines = ((role, text) for role, text, n in rows for _ in range(n)), []
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:")
            continue
        role, text = next(each)
        if letter == "K":
            state = KEEP[state]["sua".index(role[0])]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:{text}")
    return lines, state


# Rows to blocks ---------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` after the damage by number; equal rows are one, and dropped ones have no copies.

    Nulls in role, text and in what the number is taken of count as one blank.
    """
    plain = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    name = F.concat(*[F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    kind = F.col("_kind")
    made = plain.withColumn("_kind", F.crc32(name) % 20).select(
        "conv_id",
        F.when(kind != 0, F.col("turn")).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return made.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` of the first copy of each row: 1 blank, 2 duplicate, 3 truncated, 0 none.

    The first turn of equal rows is a minimum with map-side merging; only keys with several turns are joined, so that a
    row that a conversation repeats without end is split in the join.
    """
    ends = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumns({"_key": F.sha2("text", 256), "_ends": F.right(ends, F.lit(1))})
    keyed = rows.filter("copies > 0 AND _ends <> ''").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_key").alias("_k"))
    first = keyed.agg(F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_open"), F.count("*").alias("_n")).filter("_n > 1")
    same = rows["conv_id"].eqNullSafe(first["_c"]) & (rows["role"] == first["_r"]) & (rows["_key"] == first["_k"])
    seen = F.col("turn").isNotNull() & F.coalesce(F.col("_open") | (F.col("turn") > F.col("_first")), F.lit(False))
    fault = F.when(F.col("_ends") == "", 1).when(seen, 2).when(~F.col("_ends").isin(".", "!", "?"), 3).otherwise(0)
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


STATS = "rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, last string, low bigint, high bigint, turns bigint"
BLOCKS = f"""conv_id bigint, part int, block int, closed boolean, {STATS}, symbols array<int>, lengths array<bigint>, matrix array<bigint>,
    roles array<string>, texts array<string>, copies array<bigint>, cost bigint, audit string, repaired_sha256 string"""


def merged_stats(a: dict | None, b: dict) -> dict:
    """Counts of two neighbouring stretches of a conversation as one."""
    if a is None or not a["rows"]:
        return b
    if not b["rows"]:
        return a
    out = {k: a[k] + b[k] for k in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["head"] not in LEGAL
    if a["high"] is not None and b["low"] is not None:
        out["turns"] -= a["high"] == b["low"]
    return out | {
        "head": a["head"], "last": b["last"],
        "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
    }


class _Block:
    def __init__(self, conv_id: int | None, begins: bool):
        self.conv_id, self.begins, self.size = conv_id, begins, 0
        self.rows: list[tuple[str, str, int]] = []
        self.runs: list[list[int]] = []
        self.stats: dict | None = None

    def _run(self, symbol: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([symbol, n])

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        if not copies:
            return
        initial = role[:1]
        blank = fault == 1
        now = {
            "rows": copies, "blank": copies * blank, "duplicate": (copies - (fault != 2)) * (not blank), "truncated": int(fault == 3),
            "illegal": copies - 1, "head": initial, "last": initial, "low": turn, "high": turn, "turns": int(turn is not None),
        }
        self.stats = merged_stats(self.stats, now)
        self._run(symbol_of(role, fault), 1)
        self._run(GONE, copies - 1)
        self.rows.append((role, text, copies))
        self.size += len(role) + len(text) + 16

    def done(self, part: int, block: int, ends: bool) -> dict:
        runs, closed = [tuple(r) for r in self.runs], self.begins and ends
        out = {"conv_id": self.conv_id, "part": part, "block": block, "closed": closed} | (self.stats or _NOTHING)
        if closed:
            out["cost"], out["audit"] = solve(runs)
            lines, _ = edited(self.rows, out["audit"])
            out["repaired_sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            return out
        out["symbols"], out["lengths"], out["matrix"] = [r[0] for r in runs], [r[1] for r in runs], matrix(runs)
        out["roles"], out["texts"], out["copies"] = ([r[k] for r in self.rows] for k in range(3))
        return out


_NOTHING = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"head": "", "last": "", "low": None, "high": None}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
          "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batches(rows: Iterator[tuple[dict, int]], schema: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of up to 1,000 rows or about 4 MB, from rows with their sizes."""
    fields = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in schema.replace("\n", " ").split(",")])
    held, size = [], 0
    for row, width in rows:
        held.append(row)
        size += width
        if size >= 4 << 20 or len(held) == 1000:
            yield pa.RecordBatch.from_pylist(held, fields)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, fields)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of rows of one conversation, in order of (part, block); closed ones are a whole conversation and solved."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def made() -> Iterator[tuple[dict, int]]:
            block, count = None, 0
            for row in _rows(batches):
                other = block is not None and row["conv_id"] != block.conv_id
                if other or block is not None and block.size >= size:
                    yield block.done(part, count, ends=other), block.size
                    count += 1
                    block = _Block(row["conv_id"], begins=other)
                block = block or _Block(row["conv_id"], begins=False)
                block.add(row["turn"], row["role"], row["text"], row["copies"], row["fault"])
            if block is not None:
                yield block.done(part, count, ends=False), block.size

        yield from _batches(made(), BLOCKS)

    order = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    return mapped(dealt, cut, BLOCKS)


# Blocks of the rest to conversations ------------------------------------------------------------------------------------

_AT = "conv_id bigint, part int, block int"
_AFTER = "part int, block int, after array<bigint>, cost bigint"
_EXITS = f"{_AT}, after array<bigint>, cost bigint, exits array<int>"
_ENTER = "part int, block int, after array<bigint>, cost bigint, enter int"
_CHUNKS = f"{_AT}, {STATS}, cost bigint, audit string, lines binary, n_lines bigint, leave int"
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        conv, after = object(), END
        for row in _rows(batches):
            if row["conv_id"] != conv:
                conv, after = row["conv_id"], END
            m, behind = row["matrix"], after
            after = tuple(min(FAR, *(m[4 * s + to] + behind[to] for to in range(4))) for s in range(4))
            yield {"part": row["part"], "block": row["block"], "after": list(behind), "cost": after[START]}, 64

    yield from _batches(made(), _AFTER)


def _runs(row: dict) -> list[tuple[int, int]]:
    return list(zip(row["symbols"], row["lengths"]))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for row in _rows(batches):
            runs, after = _runs(row), tuple(row["after"])
            yield {k: row[k] for k in ("conv_id", "part", "block", "after", "cost")} | {"exits": [unroll(runs, after, s)[1] for s in range(4)]}, 64

    yield from _batches(made(), _EXITS)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        conv, state = object(), START
        for row in _rows(batches):
            if row["conv_id"] != conv:
                conv, state = row["conv_id"], START
            yield {k: row[k] for k in ("part", "block", "after", "cost")} | {"enter": state}, 64
            state = row["exits"][state]

    yield from _batches(made(), _ENTER)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = [f.split()[0] for f in f"{_AT}, {STATS}, cost bigint".split(",")]

    def made():
        for row in _rows(batches):
            audit, _ = unroll(_runs(row), tuple(row["after"]), row["enter"])
            lines, leave = edited(list(zip(row["roles"], row["texts"], row["copies"])), audit, row["enter"])
            text = "\n".join(lines).encode()
            yield {k: row[k] for k in kept} | {"audit": audit, "lines": text, "n_lines": len(lines), "leave": leave}, len(text) + len(audit)

    yield from _batches(made(), _CHUNKS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes the chunks of each conversation one after the other; nothing but the audit is kept of them."""

    def made():
        conv, stats = object(), None
        for row in _rows(batches):
            if row["conv_id"] != conv:
                if stats is not None:
                    yield finished()
                conv, stats, cost, audit, digest, any_line = row["conv_id"], None, row["cost"], [], hashlib.sha256(), False
            stats = merged_stats(stats, row)
            audit.append(row["audit"])
            if row["n_lines"]:
                digest.update(b"\n" * any_line + row["lines"])
                any_line = True
            state = row["leave"]
            finished = lambda: _finish(conv, stats, cost, audit, digest, any_line, state)
        if stats is not None:
            yield finished()

    yield from _batches(made(), RESULT)


def _finish(conv, stats, cost, audit, digest, any_line, state) -> tuple[dict, int]:
    for _ in range(TAIL[state]):
        state = NEXT[state]
        digest.update(b"\n" * any_line + f"{ROLE[state]}:".encode())
        any_line = True
        audit.append("I")
    letters = "".join(audit)
    gaps = 0 if stats["low"] is None else stats["high"] - stats["low"] + 1 - stats["turns"]
    counts = {k: stats[k] for k in ("blank", "duplicate", "truncated", "illegal")}
    return {"conv_id": conv, "gaps": gaps, **counts, "cost": cost, "audit": letters, "repaired_sha256": digest.hexdigest()}, len(letters)


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per ``conv_id`` of the rows as they are after :func:`damaged`: faults, cost, edits and hash of the cheapest repair.

    Nulls: a null ``conv_id`` is a conversation of its own, null turns come first and count in no gap, null roles and texts are one
    blank. Empty texts are blank rows, and very long ones are a block of their own. Rows with one turn stand in order of role and
    text, repeated rows beside each other. An empty table gives no rows; other columns, whatever their names, play no part.
    """
    table = stored(blocks(with_faults(damaged(conversations)), block), "blocks")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    names = [f.split()[0] for f in RESULT.split(",")]
    whole = table.filter("closed").select(*[gaps if n == "gaps" else F.col(n) for n in names])

    rest = table.filter("NOT closed")
    last_first = [F.col("conv_id"), F.desc("part"), F.desc("block")]
    links = rest.select("conv_id", "part", "block", "matrix").repartition("conv_id").sortWithinPartitions(*last_first)
    after = stored(mapped(links, _backward, _AFTER), "after")
    runs = rest.select("conv_id", "part", "block", "symbols", "lengths").join(after, ["part", "block"])
    exits = mapped(runs, _exits, _EXITS)
    enter = stored(mapped(exits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block"), _forward, _ENTER), "enter")
    chunks = mapped(rest.drop("cost", "audit").join(enter, ["part", "block"]), _chunks, _CHUNKS)
    joined = mapped(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block"), _joined, RESULT)
    return whole.unionAll(joined)
