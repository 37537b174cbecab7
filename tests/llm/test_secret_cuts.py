"""Secrets behind ``=`` and in paths: runs that no encoding fits as a whole."""

import random

from llm import secret_scan as S

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMS = ["ACCESS_ID={}", "sig={}", "https://x.org/a?auth={}&b=1", "POST /hooks/T0_1/{}", "/api_v1/{}/send", "a=1=b={}", "k_{}/x", "sig={}==", "{}=x"]


def test_tokens_after_names_and_in_paths(spark):
    rng = random.Random(11)
    token = lambda abc: "".join(rng.choice(abc) for _ in range(48))
    cases = [(f, token(ABC)) for f in FORMS for _ in range(20)]
    # both alphabets of base64 stay whole beside characters of the other one
    cases += [("/reset_pw/{}", token(ABC[:62] + "-_")) for _ in range(20)] + [("key_id_{}", token(ABC[:62] + "+/")) for _ in range(20)]
    words = [("/some/path_of/very_long-names1/that_go-on/and_on2/until-the_end", ""), ("first_name=abc1=second_name=def2=third_name=ghi3", "")]
    rows = [(i, "é " + f.format(t) + " .") for i, (f, t) in enumerate(cases + words)]
    found = {}
    for r in S.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("t", S.redact("text", "secret_spans")).collect():
        found[r.doc_id] = ([r.text[x.s : x.e] for x in r.secret_spans if x.k == 3], r.t)
    for k, form in enumerate(FORMS):
        mine = range(20 * k, 20 * k + 20)
        hit = [i for i in mine if any(x.rstrip("=") == cases[i][1] for x in found[i][0])]
        assert len(hit) >= 16, (form, len(hit))
        assert all(cases[i][1] not in found[i][1] and "[SECRET]" in found[i][1] for i in hit)
    for k in (len(FORMS), len(FORMS) + 1):
        hit = [i for i in range(20 * k, 20 * k + 20) if any(cases[i][1] in x for x in found[i][0])]
        assert len(hit) >= 14, (cases[20 * k][0], len(hit))
    assert not found[len(cases)][0] and not found[len(cases) + 1][0]


def test_offsets_of_pieces(spark):
    from pyspark.sql import functions as F

    run = "ab=cd==efghijklmnopqrstuv1/wxyz_ABCDEFGHIJKLMNOPQRSTUVWXYZ=="
    df = spark.createDataFrame([([(5, 5 + len(run), run)],)], "runs array<struct<s: int, e: int, w: string>>")
    got = [tuple(x) for x in df.select(S._pieces(F.col("runs")).alias("x")).first().x]
    assert all(run[s - 5 : e - 5] == w and len(w) >= 20 for s, e, w in got)
    assert {w for _, _, w in got} == {"wxyz_ABCDEFGHIJKLMNOPQRSTUVWXYZ==", "efghijklmnopqrstuv1/wxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ=="}
