"""Conversation repair against plain versions."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from llm import conversation_repair as conv

COLUMNS = "conv_id long, turn long, role string, text string"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        s = lambda v: " " if v is None else str(v)
        r, x, way = s(r), s(x), zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
        if way == 0:
            continue
        x = "" if way == 1 else re.sub("[.!?]", "", x) if way == 2 else x
        out += [(c, t, "user" if way == 4 else r, x)] * (2 if way == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for r, x in rows:
        body = x.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def by_enumeration(rows, found):
    """(cost, audit, lines) over every way to edit, for few rows."""
    names, inserts, best = {"u": "user", "a": "assistant"}, [p for n in range(3) for p in itertools.product("ua", repeat=n)], None
    ways = []
    for (r, x), f in zip(rows, found, strict=True):
        more = 3 if f == "truncated" else 0
        ways.append([(4, "D", None)] + ([] if f in ("blank", "duplicate") else [(more, "K", (r, x)), (3 + more, "R", ("user", x)), (3 + more, "R", ("assistant", x))]))
    for edit in itertools.product(*ways):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            lines, audit, cost = [(names[i], "") for i in gaps[0]], "I" * len(gaps[0]), 3 * sum(map(len, gaps))
            for (c, label, line), gap in zip(edit, gaps[1:], strict=True):
                audit, cost = audit + label + "I" * len(gap), cost + c
                lines += ([line] if line else []) + [(names[i], "") for i in gap]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = min(best or (cost, audit, lines), (cost, audit, lines))
    return best


def by_strings(rows, found):
    """The same by recursion over whole strings, for longer ones."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for role, name in (("u", "user"), ("a", "assistant")):
                if (state, role) in step and (b := best(i, step[state, role], inserted + 1)):
                    ways.append((3 + b[0], "I" + b[1], ((name, ""), *b[2])))
        if i < len(rows):
            (r, x), f = rows[i], found[i]
            if b := best(i + 1, state, 0):
                ways.append((4 + b[0], "D" + b[1], b[2]))
            if f not in ("blank", "duplicate"):
                for cost, label, role in ((0, "K", r), (3, "R", "user"), (3, "R", "assistant")):
                    to = step.get((state, role[:1]))
                    if to and (b := best(i + 1, to, 0)):
                        ways.append((cost + (3 if f == "truncated" else 0) + b[0], label + b[1], ((role, x), *b[2])))
        return min(ways) if ways else None

    return best(0, "", 0)


def plain(given, search=by_strings):
    rows, out = damage(given), []
    for c in {r[0] for r in given}:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        pairs = [r[1:] for r in mine]
        found = faults(pairs)
        cost, audit, lines = search(pairs, found)
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
        out.append((c, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def found(spark, rows, **given):
    table = spark.createDataFrame(rows, COLUMNS)
    return sorted(map(tuple, conv.digests(conv.damaged(table), absent="absent", **given).collect()), key=str)


def make(seed, sizes):
    rng, rows = random.Random(seed), []
    for c, n in enumerate(sizes):
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
            rows.append((None if c == 3 else c * 11, rng.choice([t, t, t + 3, None]), role, rng.choice(["Yes.", "No", "é!", " \t", "", None, "long text?  ", f"t{t}."])))
    return rows


def test_equals_enumeration(spark):
    rows = make(1, [1, 2, 3, 1, 3, 2, 3, 3, 2, 3] * 2)
    kept = [r for c in {r[0] for r in rows} for r in [x for x in rows if x[0] == c][:2]]  # copies may make three
    assert found(spark, kept) == plain(kept, by_enumeration)


@pytest.mark.parametrize("given", [{}, {"long_rows": 5, "block": 4}, {"long_rows": 0, "block": 7}, {"long_chars": 20, "block": 1000}])
def test_short_and_long_agree_with_strings(spark, given):
    rows = make(2, [0, 1, 4, 9, 17, 30, 6, 12, 25, 40])
    assert found(spark, rows, **given) == plain(rows)


def test_one_conversation_of_equal_rows(spark):
    rows = [(1, 5, "user", "Same.")] * 80 + [(1, 6, "assistant", "Then.")] * 80 + [(2, 2**63 - 1, "user", "a."), (2, -(2**63), "assistant", "b.")]
    for given in ({}, {"long_rows": 50, "block": 64}):
        got = {r[0]: r for r in found(spark, rows, **given)}
        assert got[1] == next(r for r in plain(rows) if r[0] == 1) and got[2][1] == 2**63 - 1


def test_dropped_conversation_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(spark, []) == []


def test_repaired_rows_and_clashing_columns(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "Hello.", "x", 1, 2), (1, 1, "user", "Hi.", "y", 1, 2)], COLUMNS + ", audit string, part int, ID int")
    got = conv.repair(table).collect()
    assert [(r.conv_id, r.whole, r.audit, r.cost) for r in got] == [(1, True, "IKKI", 6)]
    assert [tuple(x) for x in got[0].lines] == [("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "")]
    split = conv.repair(table, long_rows=1).orderBy("part").collect()
    assert [r.part < 0 for r in split] == [True, False, False] and "".join(r.audit for r in split) == "IKKI"
    assert [tuple(x) for r in split for x in r.lines] == [tuple(x) for x in got[0].lines]


def test_query_equals_plain_version(spark):
    import __spark_entry__ as entry

    got = sorted(map(tuple, entry.queries()["op13_conversation_repair"](spark, "/root/testdata/sf0.01").collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain(rows)


def test_sql_equals_plain_version():
    import duckdb
    import pandas as pd

    from llm.queries import SQL

    rows = make(5, [0, 1, 2, 3, 4, 9, 14, 7, 30, 2] * 3)
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", table)
    got = con.sql(SQL["op13_conversation_repair"])
    names = ["conv_id", *conv.COUNTS, "audit", "repaired_sha256"]
    places = [got.columns.index(n) for n in names]
    assert sorted((tuple(r[p] for p in places) for r in got.fetchall()), key=str) == plain(rows)
