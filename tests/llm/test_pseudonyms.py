"""Pseudonyms: format, validity, links and the exact way back."""

import datetime
import random
import re

from llm import pseudonyms as P

rng = random.Random(4)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def card(n):
    d = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def values():
    out = []
    for _ in range(40):
        c = card(rng.choice([13, 16, 16, 19]))
        out.append(c if len(c) != 16 or rng.random() < 0.5 else rng.choice(" -").join(c[i : i + 4] for i in range(0, 16, 4)))
        p = "".join(rng.choice("0123456789") for _ in range(10))
        out.append(rng.choice(["+1 ({}) {}-{}", "({}){}-{}", "+44 {}-{}-{}", "{}.{}.{}"]).format(p[:3], p[3:6], p[6:]))
        out.append(f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 666)]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}")
        out.append(".".join(str(rng.randrange(256)) for _ in range(4)))
        d = datetime.date(1500, 1, 1) + datetime.timedelta(rng.randrange(300_000))
        out.append(d.isoformat() if rng.random() < 0.5 else d.strftime("%d/%m/%Y").rjust(10, "0"))
        out.append("".join(rng.choice("abcXYZ.0129_") for _ in range(rng.randrange(1, 40))) + "@mail" + str(rng.randrange(9)) + ".example.com")
    return out


STAY = ["4111111111111112", "666-12-1234", "000-12-1234", "900-12-1234", "123-00-1234", "300.1.2.3", "2023-02-30", "99/99/2023", "1.2.3.4.5", "v1.2.3", "12345678901234567890", "no@host", "@x.com", "Version 2.0", "12", "a" * 30000]


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_card string").repartition(3)
    return [r for r in sorted(P.pseudonyms(df, **more).collect(), key=lambda r: r.doc_id)]


def shape(v):
    return re.sub("[0-9]+", lambda m: "9" * len(m[0]), re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))


def test_values(spark):
    vals = values()
    out = run(spark, [f"é {v} end" for v in vals])
    new = [r.text[2:-4] for r in out]
    for v, w, r in zip(vals, new, out, strict=True):
        assert v != w or ("@" in v and len(re.sub("[^0-9A-Za-z]", "", v.split("@")[0])) < 4), v  # short names may map to themselves
        kind = next(k for k in P.KINDS if r[f"n_{k}"])
        assert sum(r[f"n_{k}"] for k in P.KINDS) == 1
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in w.split("."))
        elif kind == "email":
            a, b = v.split("@"), w.split("@")
            assert [shape(c) for c in a[0]] == [shape(c) for c in b[0]] and a[1] == b[1]
        else:
            assert shape(v) == shape(w)
            if kind == "card":
                assert luhn(re.sub("[^0-9]", "", w))
            if kind == "date":
                datetime.date.fromisoformat(w) if "-" in w else datetime.datetime.strptime(w, "%d/%m/%Y")
            if kind == "ssn":
                a, g, s = map(int, w.split("-"))
                assert 1 <= a <= 899 and a != 666 and g and s
    assert len(set(new)) == len(set(vals))  # different values stay different
    assert [r.text[2:-4] for r in run(spark, [f"é {w} end" for w in new], back=True)] == vals
    assert [r.text for r in run(spark, [f"é {v} end" for v in vals], key="another")] != [r.text for r in out]


def test_texts(spark):
    c, ip = card(16), "10.20.30.40"
    texts = [None, "", f"{c} {ip}, {c}!!{ip}\n{c}", f"x{c} (mail a.b1@ex.org), {ip}.", " ".join(STAY), f"{c} {c}"]
    out = run(spark, texts)
    assert out[0].text is None and out[1].text == "" and out[4].text == texts[4] and not any(out[4][f"n_{k}"] for k in P.KINDS)
    a, b = out[2].text.split(" ")[0], out[2].text.split(" ")[1][:-1]
    assert out[2].text == f"{a} {b}, {a}!!{b}\n{a}" and (out[2].n_card, out[2].n_ip) == (3, 2)  # equal values stay equal
    assert a in out[3].text and b in out[3].text and out[3].n_email == 1 and out[5].text == f"{a} {a}"
    assert [r.text for r in run(spark, [r.text for r in out], back=True)] == texts
    assert P.pseudonyms(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_network_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(7 * 13).withColumn("p", P.feistel(F.col("id"), F.lit(7).cast("long"), F.lit(13).cast("long"), "k", "t"))
    rows = df.withColumn("q", P.feistel(F.col("p"), F.lit(7).cast("long"), F.lit(13).cast("long"), "k", "t", True)).collect()
    assert sorted(r.p for r in rows) == list(range(91)) and all(r.q == r.id for r in rows)
