"""The pipeline, stage by stage, against plain Python."""

import random
from collections import Counter

import corpus_pipeline as P
import __spark_entry__ as entry
from llm import secret_scan as S

rng = random.Random(21)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKEN = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def corpus():
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        text = " ".join(words)
        if i % 10 == 3:
            text += f' token = "{TOKEN}" end'
        rows.append([i, text, "en", f"s{i % 4}"])
        if i % 12 == 5:  # a near copy
            words[7] = "other"
            rows.append([1000 + i, " ".join(words), "en", "s1"])
        if i % 12 == 7:
            rows.append([2000 + i, text, "de", None])
    rows += [[3000, None, "en", "s0"], [3001, "", None, "s1"], [3002, "too short", "en", "s2"], [3003, "again and again " * 50, "en", "s3"]]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), SCHEMA)
        seen.append(docs.collect())
    kept, single, masked, mixed = seen
    by = {r[0]: r for r in rows}
    assert {r.doc_id for r in kept} == {i for i in by if i < 3000} and all(tuple(r) == by[r.doc_id] for r in kept)
    assert {r.doc_id for r in single} == set(range(120)) and all(tuple(r) == by[r.doc_id] for r in single)
    for r in masked:
        text = by[r.doc_id][1]
        want = text.replace(f'token = "{TOKEN}', "[SECRET]")
        assert r.text == want and r.n_chars == len(want)
    assert len(masked) == 120
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 2 and {r.doc_id for r in mixed} <= set(range(120))
    pieces = P.STAGES[-1][1](spark, docs, "").collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == times or sum(r.length for r in pieces) == sum(times[r.doc_id] * r.doc_tokens for r in {x.doc_id: x for x in pieces}.values())
    got = P.run(spark, str(tmp_path)).collect()
    key = lambda rs: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rs)
    assert sum(r.length for r in got) == sum(r.length for r in pieces) and {r.doc_id for r in got} == set(times)


def test_long_texts_and_repeated_rows(spark, tmp_path):
    """A text of 90,000 words, rows that are there several times, null ids and sources, through all stages."""
    words = [f"v{k:x}" for k in range(90_000)]
    words[45_000:45_000] = ["token", "=", TOKEN]
    long = " ".join(words)
    plain = " ".join(f"u{k}" for k in range(200))
    rows = [(7, long, "en", "s0", len(long))] * 3 + [(8, plain, "en", None, len(plain))] * 4 + [(None, plain + " more", "en", "s1", len(plain) + 5), (9, " ".join(f"t{k}" for k in range(80)), "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = P.STAGES[0][1](spark, docs, str(tmp_path))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows)
    single = P.STAGES[1][1](spark, kept, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in single) == [7, 8, 9]  # the null id is a near copy of 8
    masked = {r.doc_id: r for r in P.STAGES[2][1](spark, spark.createDataFrame(single, SCHEMA), str(tmp_path)).collect()}
    assert TOKEN not in masked[7].text and masked[7].text.startswith("v0 v1 ") and masked[7].text.endswith(words[-1]) and masked[7].n_chars == len(masked[7].text)
    got = P.run(spark, str(tmp_path)).collect()
    taken = {r.doc_id: r.doc_tokens for r in got}
    assert set(taken) <= {7, 8, 9} and 7 in taken
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.length
    assert all(n % taken[i] == 0 and n // taken[i] in (1, 2) for i, n in copies.items())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert len(P.STAGES) == 5 and S.KINDS[:3] == ("assign", "access", "hex")
