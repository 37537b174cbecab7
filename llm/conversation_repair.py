"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed lazily: the input acceptor (the rows of a
conversation in order), the edit transducer (keep, rerole, delete, insert) and
the role grammar, an optional system row and then user/assistant pairs. The
repair is the shortest path over (cost, label string) weights, least string
first among equal costs.

Strings only keep their order when something is put before them, so the path
is found from the end to the start. Of what lies behind a row, only the cost
differences and the order of the strings at the grammar's states matter; few
such situations exist, and each composed step is worked out once and kept.
A conversation is then a walk over numbered situations, one look-up a row.

Conversations of up to ``long_rows`` rows and ``long_chars`` characters are
repaired in one piece where they lie. Longer ones are cut into blocks of rows:
each block's table (situation behind it → before it) is made on its own, the
small tables of a conversation are chained, and blocks are decoded apart.

Defined results: null role and text count as one space; rows are taken by
turn (nulls first), then role and text; a null id is a conversation of its
own; repeated rows are duplicates; a gap beyond 64 bits is the largest long;
other columns are ignored, whatever their names; an empty table gives an
empty result. Hashing a conversation is sequential by nature: rows of a long
one stream in order through one task that holds no texts.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, hot_join, materialize, ordered_rows, ship

#: The role grammar ``(s?(ua)+)?``: arcs of its states, and where it may end.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = 4, (0, 3)
INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
#: More rows in a row would visit a grammar state twice, at a cost.
INSERTS = 2
OK, TRUNCATED, REMOVE = 0, 1, 2
INITIALS, ROLES = "sua", {"u": "user", "a": "assistant"}
LONG_ROWS, LONG_CHARS, BLOCK = 4096, 1 << 24, 4096
BLANKS, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SPACE = r"[\x20\x09-\x0D]"


def edits(symbol: tuple[str, int]) -> list[tuple[str, str, int]]:
    """Arcs of the edit transducer that read a row: (label, role, cost)."""
    initial, fault = symbol
    if fault == REMOVE:
        return [("D", "", DELETE)]
    more = CUT_OFF if fault == TRUNCATED else 0
    keep = [("K", initial, more)] if initial in INITIALS and initial else []
    return [*keep, ("R", "u", REROLE + more), ("R", "a", REROLE + more), ("D", "", DELETE)]


class Composition:
    """Situations behind a row and composed steps between them, made on demand.

    A situation gives each grammar state its cost above the cheapest and its
    place among the four by (cost, string). A choice is (labels, roles put
    out, next grammar state): inserts, then the edit of the row.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.situations: list[tuple] = []
        self.steps: dict[tuple, tuple] = {}
        self.last = self._layers(lambda q: [(0, "", 0, q, "")] if q in FINAL else [])
        self.end = self._number(self.last)[0]

    def _layers(self, arcs) -> list[tuple]:
        """Best (cost, labels, place, next state, roles) of each grammar state
        before any insert; layers of one insert more come first."""
        best: dict[int, tuple] = {}
        for _ in range(INSERTS + 1):
            ahead = best
            best = {}
            for q in range(STATES):
                ways = arcs(q)
                for role in ROLES:
                    if (to := GRAMMAR.get((q, role))) in ahead:
                        cost, labels, place, after, out = ahead[to]
                        ways = [*ways, (INSERT + cost, "I" + labels, place, after, role + out)]
                if ways:
                    best[q] = min(ways)
        return [best[q] for q in range(STATES)]

    def _number(self, best: list[tuple]) -> tuple[int, int]:
        order = sorted({b[:3] for b in best})
        low = order[0][0]
        situation = tuple((b[0] - low, order.index(b[:3])) for b in best)
        if situation not in self.known:
            self.known[situation] = len(self.situations)
            self.situations.append(situation)
        return self.known[situation], low

    def step(self, behind: int, symbol: tuple[str, int]) -> tuple[int, int, tuple]:
        """(situation before the row, cost added to all, choice of each state)."""
        if (behind, symbol) not in self.steps:
            ahead = self.situations[behind]

            def arcs(q):
                found = []
                for label, role, cost in edits(symbol):
                    to = GRAMMAR.get((q, role)) if role else q
                    if to is not None:
                        found.append((cost + ahead[to][0], label, ahead[to][1], to, role))
                return found

            best = self._layers(arcs)
            now, low = self._number(best)
            self.steps[behind, symbol] = (now, low, tuple((b[1], b[4], b[3]) for b in best))
        return self.steps[behind, symbol]

    def walk(self, symbols: list[tuple[str, int]], behind: int | None = None) -> tuple[int, list[tuple]]:
        """(cost from grammar state 0, choices by state of each row) of rows
        before the situation ``behind`` (the end, if none)."""
        now, total, choices = self.end if behind is None else behind, 0, [()] * len(symbols)
        for k in range(len(symbols) - 1, -1, -1):
            now, low, choices[k] = self.step(now, symbols[k])
            total += low
        return total + self.situations[now][0][0], choices


SYMBOLS = [(i, f) for i in ("", *INITIALS) for f in (OK, TRUNCATED, REMOVE)]


@functools.cache
def closed() -> tuple[Composition, np.ndarray, np.ndarray, np.ndarray]:
    """All situations, in a fixed order, with their steps as tables
    (situation x symbol): situation before, cost, next state by state."""
    made, k, rows = Composition(), 0, []
    while k < len(made.situations):
        rows.append([made.step(k, s) for s in SYMBOLS])
        k += 1
    before = np.array([[s[0] for s in r] for r in rows])
    cost = np.array([[s[1] for s in r] for r in rows])
    after = np.array([[[c[2] for c in s[2]] for s in r] for r in rows])
    return made, before, cost, after


def fault_of(role: str, text: str, seen: set) -> str:
    """The first fault of a row after the rows ``seen``, which it joins."""
    words, key = text.rstrip(BLANKS), (role, text)
    if not words:
        return "blank"
    if key in seen:
        return "duplicate"
    seen.add(key)
    return "" if words[-1] in ENDS else "truncated"


def initial_of(role: str) -> str:
    return role[0] if role and role[0] in INITIALS else ""


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def written(choice: tuple, role: str, text: str) -> list[tuple[str, str]]:
    """The (role, text) rows that a choice puts out for a row."""
    labels, out, _ = choice
    given = [(ROLES[r], "") for r in out[: labels.count("I")]]
    edit = labels[-1:]
    return given + ([(role, text)] if edit == "K" else [(ROLES[out[-1]], text)] if edit == "R" else [])


def repaired(rows: list[tuple], machine: Composition) -> tuple[str, list[tuple[str, str]], list[int]]:
    """(edit initials, repaired rows, counts) of a conversation's rows
    (turn, role, text) in order."""
    seen: set = set()
    faults = [fault_of(r, t, seen) for _, r, t in rows]
    initials = [initial_of(r) for _, r, _ in rows]
    symbols = [_symbol(i, f) for i, f in zip(initials, faults, strict=True)]
    cost, choices = machine.walk(symbols)
    audit, lines, q = [], [], 0
    for (_, role, text), by_state in zip(rows, choices, strict=True):
        audit.append(by_state[q][0])
        lines += written(by_state[q], role, text)
        q = by_state[q][2]
    _, labels, _, _, out = machine.last[q]
    turns = sorted({t for t, _, _ in rows if t is not None})
    gaps = min(turns[-1] - turns[0] + 1 - len(turns), 2**63 - 1) if turns else 0
    illegal = sum(not legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
    return "".join(audit) + labels, lines + [(ROLES[r], "") for r in out], [gaps, *map(faults.count, COUNTS[1:4]), illegal, cost]


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, absent): rows with faults put in by the
    CRC-32 of ``conv_id:turn``; a dropped row stays as ``absent``."""
    rows = carried(conversations, (), conv_id=conv_id, turn=turn, role=role, text=text)[0]
    text_ = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", text_("role").alias("role"), text_("text").alias("text"), (F.crc32(F.concat(text_("conv_id"), F.lit(":"), text_("turn"))) % 20).alias("way"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("way").isin(0, 1), "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("way") == 0).alias("absent"))


def _schema(conv: T.StructField) -> T.StructType:
    """A part of a conversation: a whole short one, or a row of a long one."""
    line = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    counts = [T.StructField(c, T.LongType()) for c in COUNTS]
    return T.StructType([conv, T.StructField("part", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("audit", T.StringType()), T.StructField("lines", line), *counts])


_LINE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _short(batches):
    """Whole conversations, from rows in order."""
    machine, key, rows, out, size, kind = Composition(), (), [], [], 0, None

    def close():
        audit, lines, counts = repaired(rows, machine)
        out.append((key[0], 0, True, audit, [{"role": r, "text": t} for r, t in lines], *counts))

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, *row, absent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv,) != key:
                if key:
                    close()
                key, rows = (conv,), []
                if len(out) >= 1000 or size > 1 << 24:
                    yield _packed(out, kind)
                    out, size = [], 0
            if not absent:
                rows.append(tuple(row))
                size += len(row[2])
    if key:
        close()
        yield _packed(out, kind)


def _packed(out: list[tuple], kind) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.bool_(), pa.string(), _LINE, *[pa.int64()] * len(COUNTS)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "part", "whole", "audit", "lines", *COUNTS])


def _runs(batches, width: int):
    """(key, rows) for each run of equal first ``width`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None or row[:width] != key:
                if key is not None:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if key is not None:
        yield key, rows


def _symbol(initial: str, fault: str) -> tuple[str, int]:
    return initial, REMOVE if fault in ("blank", "duplicate") else TRUNCATED if fault else OK


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Parts of long conversations: one with the counts (part -1), one a row."""
    placed = ordered_rows(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("salt")), [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "salt"], "repair-long")
    same = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), "role", "text")
    placed = materialize(placed.select("conv_id", "turn", "role", "text", "row_rank", F.md5(same).alias("print")), "repair-rows")
    first = materialize(placed.groupBy("print").agg(F.min("row_rank").alias("first"), F.count("*").alias("n")), "repair-first")
    initial = F.when(F.substring("role", 1, 1).isin(*INITIALS), F.substring("role", 1, 1)).otherwise("")
    own = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(~F.col("text").rlike(rf"[.!?]{_SPACE}*\z"), "truncated").otherwise("")
    signs = hot_join(placed.select("conv_id", "turn", "row_rank", "print", initial.alias("initial"), own.alias("own")), first, "print", "n", placed.count())
    fault = F.when((F.col("own") != "blank") & (F.col("row_rank") > F.col("first")), "duplicate").otherwise(F.col("own"))
    signs = materialize(signs.select("conv_id", F.expr(f"row_rank div {block}").alias("block"), "row_rank", "turn", "initial", fault.alias("fault")), "repair-signs")
    conv = rows.schema["conv_id"]
    field = lambda names, kind: [T.StructField(n, kind) for n in names.split()]

    def tables(batches):
        made, before, cost, after = closed()
        n = len(made.situations)
        for (conv_id, at), rows in _runs(batches, 2):  # rows: rank, initial, fault
            state, total, through = np.arange(n), np.zeros(n, np.int64), np.tile(np.arange(STATES), (n, 1))
            for _, i, f in reversed(rows):
                s = SYMBOLS.index(_symbol(i, f))
                through = np.take_along_axis(through, after[state, s], axis=1)
                total += cost[state, s]
                state = before[state, s]
            initials, faults = [r[1] for r in rows], [r[2] for r in rows]
            illegal = sum(not legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
            yield [conv_id, at, initials[0], initials[-1], *map(faults.count, COUNTS[1:4]), illegal, *(x.astype("<i8").tobytes() for x in (state, total, through))]

    def chain(batches):
        made, _, _, _ = closed()
        for (conv_id,), blocks in _runs(batches, 1):
            behind, cost, maps = made.end, 0, []
            for b in reversed(blocks):
                state, total, through = (np.frombuffer(x, "<i8") for x in b[7:])
                maps.append((behind, through.reshape(-1, STATES)[behind]))
                cost, behind = cost + int(total[behind]), int(state[behind])
            sums = [sum(b[k] for b in blocks) for k in range(3, 7)]
            sums[3] += sum(not legal(a[2], b[1]) for a, b in zip(blocks, blocks[1:], strict=False))
            q = 0
            for k, (b, (after, through)) in enumerate(zip(blocks, reversed(maps), strict=True)):
                yield [conv_id, b[0], after, q, k == len(blocks) - 1, *((*sums, cost + made.situations[behind][0][0]) if k == 0 else [None] * 5)]
                q = int(through[q])

    def decode(batches):
        made = closed()[0]
        for (_, _, behind, q, last), rows in _runs(batches, 5):
            _, choices = made.walk([_symbol(i, f) for _, i, f in rows], behind)
            for k, (row_rank, _, _) in enumerate(rows):
                labels, out, after = choices[k][q]
                end = made.last[after] if last and k == len(rows) - 1 else None
                yield [row_rank, labels, out, end[1] if end else "", end[4] if end else ""]
                q = after

    def parts(batches):
        for batch in batches:
            out = []
            for conv_id, row_rank, role, text, labels, roles, more, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = written((labels, roles, 0), role, text) + [(ROLES[r], "") for r in tail]
                out.append((conv_id, row_rank, False, labels + more, [{"role": r, "text": t} for r, t in lines], *[None] * len(COUNTS)))
            if out:
                yield _packed(out, batch.schema.field(0).type)

    def mapped(df: DataFrame, rows, schema: list[T.StructField]) -> DataFrame:
        kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}

        def run(batches):
            given, types = [], None

            def seen():
                nonlocal types
                for batch in batches:
                    types = [kinds.get(f.dataType, batch.schema.field(0).type) for f in schema]
                    yield batch

            pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*given, strict=True), types, strict=True)], names=[f.name for f in schema])
            for row in rows(seen()):
                given.append(row)
                if len(given) >= 10_000:
                    yield pack()
                    given = []
            if given:
                yield pack()

        return df.mapInArrow(run, T.StructType(schema))

    long, string = T.LongType(), T.StringType()
    made = mapped(signs.select("conv_id", "block", "row_rank", "initial", "fault").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "row_rank"), tables,
                  [conv, *field("block", long), *field("first last", string), *field("blank duplicate truncated illegal", long), *field("state total through", T.BinaryType())])
    chained = mapped(made.repartition("conv_id").sortWithinPartitions("conv_id", "block"), chain, [conv, *field("block behind enters", long), T.StructField("last", T.BooleanType()), *field("blank duplicate truncated illegal cost", long)])
    chained = materialize(chained, "repair-chain")
    key = chained.select(F.col("conv_id").alias("id"), F.col("block").alias("at"), "behind", "enters", "last")
    asked = signs.join(key, signs["conv_id"].eqNullSafe(key["id"]) & (signs["block"] == key["at"])).select("conv_id", "block", "behind", "enters", "last", "row_rank", "initial", "fault")
    decoded = mapped(asked.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "row_rank"), decode, [*field("row_rank", long), *field("labels roles more tail", string)])
    lines = placed.select("conv_id", "row_rank", "role", "text").join(decoded, "row_rank").select("conv_id", "row_rank", "role", "text", "labels", "roles", "more", "tail").mapInArrow(parts, _schema(conv))
    turns = signs.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    turns = turns.agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("*").alias("n")).select(F.col("conv_id").alias("id"), F.least(wide("b") - wide("a") + 1 - wide("n"), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("gaps"))
    sums = chained.where("cost IS NOT NULL").join(turns, chained["conv_id"].eqNullSafe(turns["id"]), "left")
    empty = lines.schema["lines"].dataType
    sums = sums.select("conv_id", F.lit(-1).cast("long").alias("part"), F.lit(False).alias("whole"), F.lit("").alias("audit"), F.array().cast(empty).alias("lines"), F.coalesce("gaps", F.lit(0)).alias("gaps"), *COUNTS[1:])
    return sums.unionByName(lines)


def pieces(conversations: DataFrame, absent: str | None = None, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """Parts of short conversations, and of long ones if there are any."""
    ship(conversations.sparkSession)
    named = {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"} | ({"absent": absent} if absent else {})
    rows = carried(conversations, (), **named)[0]
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), given("role"), given("text"), (F.col("absent") if absent else F.lit(False)).alias("absent"))
    sizes = rows.where("NOT absent").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    large = materialize(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("id")), "repair-ids")
    long = None
    if not large.isEmpty():
        mine = rows["conv_id"].eqNullSafe(large["id"])
        long = _long(rows.where("NOT absent").join(large, mine, "left_semi"), block)
        rows = rows.join(large, mine, "left_anti")
    lying = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return lying.mapInArrow(_short, _schema(rows.schema["conv_id"])), long


def repair(conversations: DataFrame, absent: str | None = None, **given) -> DataFrame:
    """conv_id, part, whole, audit (initials of the edits), lines (repaired
    rows: role, text) and, once a conversation, its counts."""
    short, long = pieces(conversations, absent, **given)
    return short if long is None else short.unionByName(long)


def _line(x: Column) -> Column:
    return F.concat(x["role"], F.lit(":"), x["text"])


def digests(conversations: DataFrame, absent: str | None = None, **given) -> DataFrame:
    """One row a conversation: its counts, audit, SHA-256 of the repaired text."""
    short, long = pieces(conversations, absent, **given)
    text = F.array_join(F.transform("lines", _line), "\n")
    out = short.select("conv_id", *COUNTS, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    if long is None:
        return out

    def hashed(batches):
        key, audit, counts, sha, fresh, kind = (), [], (), None, True, None
        close = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key[0], *counts, "".join(audit), sha.hexdigest()), [kind, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, part, some, text, n, *sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != key:
                    if key:
                        yield close()
                    key, audit, sha, fresh = (conv,), [], hashlib.sha256(), True
                if part < 0:
                    counts = sums
                audit.append(some)
                if n:
                    sha.update(text.encode("utf-8", "surrogatepass") if fresh else b"\n" + text.encode("utf-8", "surrogatepass"))
                    fresh = False
        if key:
            yield close()

    rest = long.select("conv_id", "part", "audit", text.alias("text"), F.size("lines").alias("n"), *COUNTS)
    return out.unionByName(rest.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(hashed, out.schema))
