"""Callers' columns named like an operator's own, in two cases, come back
unchanged unless a result replaces them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from llm import jaccard_join, license_scan, mixing, pseudonyms, quality_rules, secret_scan, url_filter

INTERNAL = (
    "in_row", "range_id", "row_rank", "row_before", "join_salt", "uid", "j_id", "mix_id", "mix_uid", "mix_source", "size", "copies", "offset", "run", "part",
    "s_text", "s_in", "s_base", "s_cands", "s_spans", "s_runs", "secret_spans", "p_text", "p_found", "p_gaps", "p_new", "n_card", "l_words", "l_uid", "l_hits", "l_text",
    "n_words", "labels", "score", "q_in", "q_text", "q_words", "host", "kept", "fails", "salt", "salt_of", "bad", "verdict", "rule", "path", "u_url", "c0", "c1", "print", "group",
)
TEXT = " ".join(f"word{i}" for i in range(80)) + " call +1 (743) 555-3824. Released under the MIT License. token = abcdefgh12345"
NEAR = TEXT.replace("word7 ", "other ")


@pytest.fixture(scope="module", params=[str.lower, str.title], ids=["lower", "title"])
def docs(spark, request):
    base = [(1, TEXT, "s", len(TEXT), "http://a.org/x", "<a href='//b.org/'>"), (2, NEAR, None, len(NEAR), None, None), (None, None, "s", None, "http://b.com/de/1", "")]
    df = spark.createDataFrame(base, "doc_id long, text string, source string, n_chars long, url string, html string")
    names = [request.param(n) for n in INTERNAL]
    return df.select("*", *[F.concat(F.lit(n + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names]), names


def check(out, names, result, rows):
    taken = {r.lower() for r in result}
    got = out.collect()
    assert len(got) == rows and len({c.lower() for c in out.columns}) == len(out.columns)
    assert set(out.columns) >= {n for n in names if n.lower() not in taken} | set(result)
    for r in got:
        d = r.asDict()
        for n in names:
            if n.lower() not in taken:
                assert d[n] == f"{n}:{d['doc_id'] if d['doc_id'] is not None else '-'}"


OPERATORS = {
    "pseudonyms": (pseudonyms.pseudonyms, tuple(f"n_{k}" for k in pseudonyms.KINDS)),
    "mixing": (mixing.mix, mixing.RESULT),
    "secret_scan": (secret_scan.secret_scan, secret_scan.RESULT),
    "license_scan": (license_scan.license_scan, license_scan.RESULT),
    "quality_rules": (quality_rules.quality_rules, quality_rules.RESULT),
    "url_filter": (url_filter.url_filter, url_filter.RESULT),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, name):
    df, names = docs
    f, result = OPERATORS[name]
    check(f(df), names, result, 3)


def test_stages(spark, docs):
    df, names = docs
    for (name, stage), rows in zip(P.STAGES[:-1], (2, 2, 3, None), strict=True):
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        check(out, names, (), out.count() if rows is None else rows)


def test_jaccard_reads_its_own_columns(docs):
    df, _ = docs
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in jaccard_join.jaccard_join(df).collect()) == [(0, 0, 0), (1, 1, 1), (2, 1, 1)]
