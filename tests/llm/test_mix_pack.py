"""Mixing and packing against plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from llm import mixing as M
from llm import packing as P
from llm.common import ordered_rows

rng = random.Random(3)
SCHEMA = "doc_id long, text string, source string, size string, extra int"


def targets(sizes, order):
    """Water filling, one cap at a time."""
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["w"] * rng.randrange(1, 300)), rng.choice(["b", "a", "é", "😀", "hot", "hot", "hot", None]), "x", i) for i in range(600)]
    rows += [(9000, None, "a", "x", 1), (9001, "", "empty", "x", 1), (None, "two words", "a", None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def test_mix(docs):
    df, rows = docs
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = targets(sizes, order)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 1 for s in sizes), (taken, want)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    key = lambda rs: sorted((r.doc_id or -1, r.copies) for r in rs)
    assert key(got) == key(M.mix(df.repartition(2)).collect())  # reruns agree
    assert sum(r.copies for r in got) == M.repeat_taken(df).count()
    assert M.mix(df.limit(0)).count() == 0


def test_ordered_rows(spark):
    rows = [(rng.randrange(50), rng.randrange(9)) for _ in range(2000)]
    got = sorted(ordered_rows(spark.createDataFrame(rows, "k int, w int").repartition(7), ["k", "w"], "t", "w").collect(), key=lambda r: r.row_rank)
    assert [(r.k, r.w) for r in got] == sorted(rows)
    assert [r.row_rank for r in got] == list(range(2000)) and [r.row_before for r in got] == np.cumsum([0, *(w for _, w in sorted(rows))])[:-1].tolist()


def check_pack(pieces, texts, capacity=4096):
    t = P.Encoder(P.tokenizer_path()).tokenizer
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for x in texts]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        a = ids[r.doc_id]
        assert r.doc_tokens == len(a) and r.ids_crc32 == zlib.crc32(a[r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(range(len(texts)))
    for d, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[d])
    padded = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / sum(map(len, ids))


TEXTS = [None, "", "Hello World! 'Tis it's <|endoftext|>x", "é é ́x ｗｉｄｅ İI Σ", "日本語のテキスト 😀😀", "w " * 20000, "tab\tand\x0bmore nbsp em\r\nend", "z" * 9000, "Word, word... ÉTÉ! straße ẞ don't, can't.x (a) a_b 12ab <|endoftext|>, x<|startoftext|> ªº ŉ Ǆ ĳ ſ |> <| - -- mot́ x y 's s'"]


def test_pack_edges(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    assert check_pack(P.pack(df).collect(), TEXTS) == 0
    assert P.pack(df.limit(0)).count() == 0
    twice = P.pack(df.union(df)).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in P.pack(df).collect())


def test_pack_many(spark):
    """Enough items for patterns; little padding, few cut documents."""
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(int(rng.lognormvariate(4.5, 0.8)))) for _ in range(3000)]
    got = P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), capacity=1024).collect()
    assert check_pack(got, texts, 1024) == 0
    cut = len({r.doc_id for r in got if r.length < r.doc_tokens and r.doc_tokens < 1024})
    assert cut < 0.25 * len(texts)


def test_cutting_stock():
    """The program's value reaches the bound of perfect packing, and covers demand."""
    sizes, demand = np.array([3, 5, 7, 11]), np.array([100, 80, 60, 40])
    patterns, times = P.cutting_stock(sizes, demand, 32)
    assert (times @ patterns >= demand - 1e-6).all() and (patterns @ sizes <= 32).all()
    assert times.sum() <= demand @ sizes / 32 * 1.02 + 1e-6
    v, counts = P.knapsack(np.array([3.1, 5.0, 7.5, 11.0]), sizes, 32)
    brute = max(a * 3.1 + b * 5 + c * 7.5 + d * 11 for a in range(11) for b in range(7) for c in range(5) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 32)
    assert abs(v - brute) < 1e-9 and counts @ sizes <= 32


def test_plan_never_takes_more_than_there_is():
    h = {int(n): int(c) for n, c in zip(np.arange(1, 4096, 7), np.random.default_rng(1).integers(0, 400, 585)) if c}
    patterns, taken = P.plan(h, 4096)
    count = defaultdict(int)
    for n, c in h.items():
        count[-(-n // P.GRID)] += c
    used = defaultdict(int)
    for p, k in patterns:
        assert sum(u * c for u, c in p.items()) <= 4096 // P.GRID
        for u, c in p.items():
            used[u] += c * k
    assert all(used[u] == taken.get(u, 0) <= count[u] for u in count) and sum(taken.values()) > 0.85 * sum(count.values())
