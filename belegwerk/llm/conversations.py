"""Conversation repair: the cheapest edits that give legal role orders, by a run-length dynamic programme.

Legal are role initials that match `(s?(ua)+)?`; four states read them: nothing yet, after s, after u, after a. A row is
a symbol (its initial, whether its end is cut off, or that it must go), and a symbol is a 4 x 4 matrix of costs in the
min-plus algebra. Equal consecutive symbols are one run, and a run is a power of its matrix, put together from cached
powers of two. Matrices multiply associatively, so a long conversation is cut into chunks that are worked on apart: only
vectors of four costs go from chunk to chunk."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Distinct rows of a conversation that are one chunk.
CHUNK = 4096
BLANKS = " \t\n\x0b\x0c\r"
_ENDLESS = 1 << 50
_INITIALS = "?sua"
#: Symbol of rows that must be deleted; others are 2 * initial + whether the end is cut off.
_GONE = 8
#: Edit costs: delete, insert, give another role; and what a kept cut-off row adds.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: The state after an inserted or re-roled row, and that row's role, by state.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: What completing costs in each state by inserts alone.
_FINAL = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _kept(state: int, initial: int) -> int | None:
    """The state after a row that keeps its role; None where that is illegal."""
    return {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}.get((state, initial))


def _times(m: Matrix, v: Vector) -> Vector:
    return tuple(min(a + b for a, b in zip(row, v, strict=True)) for row in m)  # type: ignore[return-value]


def _product(m: Matrix, n: Matrix) -> Matrix:
    columns = [_times(m, column) for column in zip(*n, strict=True)]
    return tuple(tuple(min(c, _ENDLESS) for c in row) for row in zip(*columns, strict=True))  # type: ignore[return-value]


@cache
def _power(symbol: int, k: int) -> Matrix:
    """The matrix of 2^k rows with the symbol: costs from the state before the inserts ahead of them to the state after."""
    if k:
        return _product(_power(symbol, k - 1), _power(symbol, k - 1))
    one = [[_ENDLESS] * 4 for _ in range(4)]
    for before in range(4):
        state, inserts = before, 0
        for _ in range(3):
            steps = [(state, DELETE)]
            if symbol != _GONE:
                cut = CUT_OFF * (symbol & 1)
                steps.append((_NEXT[state], REROLE + cut))
                if (to := _kept(state, symbol >> 1)) is not None:
                    steps.append((to, cut))
            for to, cost in steps:
                one[before][to] = min(one[before][to], inserts + cost)
            state, inserts = _NEXT[state], inserts + INSERT
    return tuple(tuple(row) for row in one)  # type: ignore[return-value]


def _advance(symbol: int, length: int, after: Vector) -> Vector:
    """Costs to go before a run, from those after it."""
    k = 0
    while length:
        if length & 1:
            after = _times(_power(symbol, k), after)
        length, k = length >> 1, k + 1
    return after


def _matrix(runs: list[tuple[int, int]]) -> Matrix:
    unit: list[Vector] = [tuple(0 if i == j else _ENDLESS for i in range(4)) for j in range(4)]  # type: ignore[misc]
    for symbol, length in reversed(runs):
        unit = [_advance(symbol, length, v) for v in unit]
    return tuple(tuple(min(c, _ENDLESS) for c in row) for row in zip(*unit, strict=True))  # type: ignore[return-value]


def _unroll(runs: list[tuple[int, int]], after: Vector, state: int, last: bool) -> tuple[int, str]:
    """The state after a chunk and the edits in it, the ASCII-least among the cheapest.

    Each initial leads to one state only, so the least one that still reaches the cheapest cost is taken at every step.
    Rows that must go are deleted before anything is inserted, whole runs at once, since D is the least initial."""
    ahead = [after]
    for symbol, length in reversed(runs):
        ahead.append(_advance(symbol, length, ahead[-1]))
    out: list[str] = []
    for (symbol, length), end in zip(runs, reversed(ahead[:-1]), strict=True):
        if symbol == _GONE:
            out.append("D" * length)
            continue
        to_go = [end]
        for _ in range(length):
            to_go.append(_times(_power(symbol, 0), to_go[-1]))
        cut = CUT_OFF * (symbol & 1)
        for done in range(length, 0, -1):
            now, then = to_go[done], to_go[done - 1]
            while DELETE + then[state] != now[state] and INSERT + now[_NEXT[state]] == now[state]:
                out.append("I")
                state = _NEXT[state]
            to = _kept(state, symbol >> 1)
            if DELETE + then[state] == now[state]:
                out.append("D")
            elif to is not None and cut + then[to] == now[state]:
                out.append("K")
                state = to
            else:
                out.append("R")
                state = _NEXT[state]
    while last and _FINAL[state]:
        out.append("I")
        state = _NEXT[state]
    return state, "".join(out)


def _merged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, digest, blank, cut: rows that repeat all of the first four are one."""
    space = F.lit(" ")
    same = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                       F.coalesce(F.col("text").cast("string"), space).alias("text"), F.col("copies").cast("long").alias("copies"))
    same = same.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    return same.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), (end == "").alias("blank"),
                       (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))


_KEY = ["conv_id", "turn", "role", "digest"]


def _marked(merged: DataFrame) -> DataFrame:
    """`merged` without texts, with `first`: no earlier row of the conversation has the role and the text."""
    narrow = merged.select(*_KEY, "copies", "blank", "cut", F.lit(False).alias("first"))
    least = narrow.groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"))
    firsts = least.select("conv_id", F.when(~F.col("none"), F.col("least")).alias("turn"), "role", "digest", F.lit(0).cast("long").alias("copies"),
                          F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("first"))
    # Keyed by whole rows, so that neither a long conversation nor a text that fills it meets in one task.
    return narrow.unionAll(firsts).groupBy(*_KEY).agg(
        F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("first").alias("first"))


_COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")


def _chunks(marked: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the chunk's first row), its counts, what lies at its two ends, runs, matrix.

    Rows are sorted over all tasks, so a long conversation lies in several; each cuts its part into chunks."""
    kind = marked.schema["conv_id"].dataType.simpleString()
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1)) * (F.length("role") > 0).cast("int")
    ordered = marked.select(*_KEY, "copies", "blank", "cut", "first", initial.cast("int").alias("initial"))
    ordered = ordered.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    names = [*_KEY, *_COUNTS, "least_turn", "last_turn", "head_initial", "tail_initial", "symbols", "lengths", "matrix"]
    schema = (f"conv_id {kind}, turn bigint, role string, digest binary, " + ", ".join(f"{c} bigint" for c in _COUNTS)
              + ", least_turn bigint, last_turn bigint, head_initial int, tail_initial int, symbols array<int>, lengths array<bigint>, matrix array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {n: [] for n in names}
        now: dict | None = None
        rows = 0

        def close() -> None:
            if now is not None:
                runs = now.pop("runs")
                now["symbols"], now["lengths"] = [s for s, _ in runs], [n for _, n in runs]
                now["matrix"] = [c for row in _matrix(runs) for c in row]
                for n in names:
                    columns[n].append(now[n])

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(columns[n], types[n]) for n in names], names)
            for n in names:
                columns[n].clear()
            return done

        types: dict[str, pa.DataType] = {}
        for batch in slices(batches, 1024):
            if not types:
                types = {n: pa.int64() for n in names} | {n: batch.schema.field(n).type for n in _KEY} | {
                    "head_initial": pa.int32(), "tail_initial": pa.int32(), "symbols": pa.list_(pa.int32()),
                    "lengths": pa.list_(pa.int64()), "matrix": pa.list_(pa.int64())}
            for conv, turn, role, digest, copies, blank, cut, first, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now["conv_id"] or rows == CHUNK:
                    close()
                    now = {"conv_id": conv, "turn": turn, "role": role, "digest": digest, **dict.fromkeys(_COUNTS, 0), "least_turn": None,
                           "last_turn": None, "head_initial": begin, "tail_initial": None, "runs": []}
                    rows = 0
                rows += 1
                if turn is not None and turn != now["last_turn"]:
                    now["turns"] += 1
                    now["least_turn"] = turn if now["least_turn"] is None else now["least_turn"]
                    now["last_turn"] = turn
                now["illegal"] += copies - 1 + (now["tail_initial"] is not None and _illegal(now["tail_initial"], begin))
                now["tail_initial"] = begin
                stays = first and not blank
                now["blank" if blank else "duplicate"] += copies - stays
                now["truncated"] += stays and cut
                for symbol, length in ((2 * begin + cut, 1),) * stays + ((_GONE, copies - stays),) * (copies > stays):
                    if now["runs"] and now["runs"][-1][0] == symbol:
                        now["runs"][-1][1] += length
                    else:
                        now["runs"].append([symbol, length])
            if len(columns["conv_id"]) >= 1024:
                yield flush()
        close()
        if columns["conv_id"]:
            yield flush()

    return ordered.mapInArrow(run, schema)


def _illegal(a: int, b: int) -> bool:
    return (a, b) not in ((1, 2), (2, 3), (3, 2))


def _backward(chunks: DataFrame) -> DataFrame:
    """`chunks` with after (costs to go behind it) and whether it is the conversation's first and last one.

    One conversation's chunks pass in falling order, with four numbers of state."""
    falling = chunks.repartition("conv_id").sortWithinPartitions("conv_id", *(F.desc(c) for c in _KEY[1:]))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        arrow: pa.Schema | None = None
        for batch in slices(batches, 512):
            if arrow is None:
                arrow = batch.schema.append(pa.field("after", pa.list_(pa.int64()))).append(pa.field("opens", pa.bool_())).append(
                    pa.field("closes", pa.bool_()))
            out = []
            for row in batch.to_pylist():
                same = held is not None and held["conv_id"] == row["conv_id"]
                if held is not None:
                    out.append(held | {"opens": not same})
                m = held["matrix"] if same else None
                after = _times(tuple(tuple(m[4 * i:4 * i + 4]) for i in range(4)), tuple(held["after"])) if m else _FINAL  # type: ignore[arg-type]
                held = row | {"after": list(after), "closes": not same}
            yield pa.RecordBatch.from_pylist(out, arrow)
        if held is not None and arrow is not None:
            yield pa.RecordBatch.from_pylist([held | {"opens": True}], arrow)

    return falling.mapInArrow(run, f"{kinds}, after array<bigint>, opens boolean, closes boolean")


def _choices(chunks: DataFrame) -> DataFrame:
    """`chunks` with, per state before the chunk, the state after it and the edits in it; `cost` where it is the first."""
    spread = chunks.repartition(*_KEY)
    kept = [c for c in chunks.columns if c not in ("symbols", "lengths", "matrix", "after")]
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            exits, edits, costs = [], [], []
            for symbols, lengths, after, opens, closes in zip(*(batch.column(c).to_pylist() for c in ("symbols", "lengths", "after", "opens", "closes")), strict=True):
                runs, behind = list(zip(symbols, lengths, strict=True)), tuple(after)
                found = [_unroll(runs, behind, s, closes) for s in range(1 if opens else 4)]
                exits.append([f[0] for f in found])
                edits.append([f[1] for f in found])
                before = behind
                for symbol, length in reversed(runs):
                    before = _advance(symbol, length, before)
                costs.append(before[0] if opens else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(exits, pa.list_(pa.int32())), pa.array(
                edits, pa.list_(pa.string())), pa.array(costs, pa.int64())], [*kept, "exits", "edits", "cost"])

    return spread.mapInArrow(run, f"{kinds}, exits array<int>, edits array<string>, cost bigint")


class _Conversation:
    """What is known of the conversation that passes by: chunks first, then the rows they decide about."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.at, self.edits = conv_id, 0, 0, ""
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.cost, self.least, self.last, self.tail = 0, None, None, None
        self.reached = 0
        self.audit: list[str] = []

    def chunk(self, row: dict) -> None:
        picked = self.reached if len(row["edits"]) > 1 else 0
        self.edits, self.at, self.reached = row["edits"][picked], 0, row["exits"][picked]
        self.audit.append(self.edits)
        for c in _COUNTS:
            self.counts[c] += row[c]
        self.cost += row["cost"]
        if self.tail is not None:
            self.counts["illegal"] += _illegal(self.tail, row["head_initial"])
        self.tail = row["tail_initial"]
        if row["last_turn"] is not None:
            # The last turn of the chunk before may go on in this one.
            self.counts["turns"] -= self.last == row["least_turn"]
            self.least = row["least_turn"] if self.least is None else self.least
            self.last = row["last_turn"]

    def inserts(self) -> Iterator[tuple[str, str]]:
        """(edit, role) of the inserts that come next."""
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            yield "I", _ROLE[self.state]
            self.state, self.at = _NEXT[self.state], self.at + 1

    def edit(self, role: str, copies: int) -> tuple[str, str]:
        """(edit, role) of a row; its further copies are always deleted."""
        edit = self.edits[self.at]
        self.at += copies
        if edit == "K":
            self.state = _kept(self.state, _INITIALS.index(role[0])) or 0
        elif edit == "R":
            role, self.state = _ROLE[self.state], _NEXT[self.state]
        return edit, role


def _stream(merged: DataFrame, choices: DataFrame, ids: DataFrame) -> DataFrame:
    """Marker, chunks and rows of each conversation in order: one exchange of the texts, one sorted pass."""
    rows = merged.select("conv_id", F.lit(2).alias("step"), "turn", "role", "digest", "copies", F.col("text").cast("binary").alias("text"))
    pieces = choices.select("conv_id", F.lit(1).alias("step"), "turn", "role", "digest", F.struct(
        *_COUNTS, "least_turn", "last_turn", "head_initial", "tail_initial", "exits", "edits", "cost").alias("chunk"))
    marks = ids.select("conv_id", F.lit(0).alias("step"))
    both = marks.unionByName(pieces, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.expr("step > 0"), "turn", "role", "digest", "step")


def _prepared(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    merged = written(_merged(rows), "turns")
    choices = written(_choices(_backward(written(_chunks(_marked(merged)), "chunks"))), "choices")
    known = (merged if ids is None else ids).select("conv_id").distinct()
    return _stream(merged, choices, known)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text; `copies` says how often a row counts), and per
    conv_id of `ids` that has no rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows come in order of turn (nulls first), then role, then the digest of the text, so rows that repeat all lie side by
    side. Null roles and texts are one space; a null conv_id is a conversation; a role is known by its first character,
    an empty one is never legal. Blank rows, and rows whose role and text came earlier (texts are told apart by their
    SHA-256), must go; the others may be kept, given another role or deleted, rows may be inserted anywhere; the cheapest
    edits are taken, among equals the ASCII-least audit. Other columns play no part.

    A hot conversation is spread over tasks for everything but the last pass, in which its hash is taken, text by text,
    without holding texts: a hash is sequential. Only its audit, one letter an edit, is held."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        digest, out, arrow = hashlib.sha256(), [], None
        empty = True

        def add(role: str, text: bytes) -> None:
            nonlocal empty
            digest.update((b"" if empty else b"\n") + role.encode() + b":" + text)
            empty = False

        def close() -> None:
            if now is not None:
                for _, role in now.inserts():
                    add(role, b"")
                span = 0 if now.last is None else now.last - now.least + 1 - now.counts["turns"]
                out.append((now.conv_id, span, *(now.counts[c] for c in _COUNTS[1:]), now.cost, "".join(now.audit), digest.hexdigest()))

        def flush() -> pa.RecordBatch:
            kinds = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
            done = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return done

        for batch in slices(batches, 256):
            arrow = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if not row["step"]:
                    close()
                    now, digest, empty = _Conversation(row["conv_id"]), hashlib.sha256(), True
                elif row["step"] == 1:
                    now.chunk(row["chunk"])
                else:
                    for _, role in now.inserts():
                        add(role, b"")
                    edit, role = now.edit(row["role"], row["copies"])
                    if edit != "D":
                        add(role, row["text"])
            yield flush()
        close()
        if out:
            yield flush()

    return _prepared(rows, ids).mapInArrow(
        run, f"conv_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:7]) + ", audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), edit (K, R or I), turn (null: inserted), role,
    text. Conversations of which nothing is left have no rows. Order and edits as in `repair`."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "edit", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        place, out, arrow = 0, [], None

        def add(edit: str, turn: int | None, role: str, text: bytes) -> None:
            nonlocal place
            out.append((now.conv_id, place, edit, turn, role, text.decode()))
            place += 1

        def close() -> None:
            if now is not None:
                for edit, role in now.inserts():
                    add(edit, None, role, b"")

        def flush() -> pa.RecordBatch:
            kinds = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            done = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return done

        for batch in slices(batches, 256):
            arrow = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if not row["step"]:
                    close()
                    now, place = _Conversation(row["conv_id"]), 0
                elif row["step"] == 1:
                    now.chunk(row["chunk"])
                else:
                    for edit, role in now.inserts():
                        add(edit, None, role, b"")
                    edit, role = now.edit(row["role"], row["copies"])
                    if edit != "D":
                        add(edit, row["turn"], role, row["text"])
            yield flush()
        close()
        if out:
            yield flush()

    return _prepared(rows, None).mapInArrow(
        run, f"conv_id {kind}, place bigint, edit string, turn bigint, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults put in, the same ones every time, by crc32 of `conv_id:turn` modulo 20: 0 drops the
    row, 1 empties its text, 2 takes its sentence marks out, 3 counts it twice, 4 makes it a user's. Nulls are one space."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
                                changed.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("__kind")).where(
        "__kind <> 0").drop("__kind")
