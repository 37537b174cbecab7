"""SimHash groups against a plain version over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from llm import simhash
from llm.bk_tree import Forest

SPACE = " \t\n\r\x0b\x0c"


def plain_print(text: str, n: int = 3) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in SPACE:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=2):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", least[find(k)]) for k, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def found(spark, rows, **given):
    out = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), **given).collect()
    return sorted(((r.doc_id, f"{r['print'] & (2**64 - 1):016x}", r.component_id) for r in out), key=str)


@pytest.mark.parametrize("slice_size", [simhash.SLICE, 3])
def test_groups_equal_all_pairs(spark, slice_size):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Éa", "ZZ", "x"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 300]))]
        for c in range(rng.choice([1, 1, 2, 4])):
            t = list(base)
            if c and len(t) > 200:
                t[rng.randrange(len(t))] = "changed"
            rows.append((7 * i + c, " ".join(t)))
    rows += [(None, "null id"), (None, "null id"), (900, None), (901, " \t\n"), (5, rows[0][1]), (5, rows[0][1])]
    assert found(spark, rows, slice_size=slice_size) == plain_groups(rows)


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base[:20] ^ np.uint64(1), base[:20] ^ np.uint64(6), base[:20] ^ np.uint64(14), np.arange(30, dtype=np.uint64)]))
    shards = np.arange(len(prints)) % 3
    hits = {(int(a), int(b)) for q, n in Forest(prints, shards).within(prints, shards, 2, chunk=7) for a, b in zip(q, n, strict=True)}
    assert hits == {(i, j) for i in range(len(prints)) for j in range(len(prints)) if shards[i] == shards[j] and int(prints[i] ^ prints[j]).bit_count() <= 2}


def test_long_text_and_chunks():
    text = " ".join(f"n{i % 977}" for i in range(140_000))
    assert simhash.fingerprint(text) == plain_print(text)


def test_empty_table_and_other_columns(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = simhash.simhash_groups(spark.createDataFrame([(1, "a b c", 2, 3), (2, "a b c", 4, 5)], "doc_id long, text string, print int, shard int"))
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1)]


def test_query_matches_plain_version(spark):
    import __spark_entry__ as entry

    got = sorted(map(tuple, entry.queries()["op11_simhash"](spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect()))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got == sorted(plain_groups(rows))
