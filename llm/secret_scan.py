"""Secret scans with a randomness test battery (DataFrame functions only).

Fixed patterns find the obvious kinds. Beyond them, every run of 20 or more
token characters that mixes letters and digits is a candidate. Runs are cut
at an inner ``=``; where the alphabet still fits no encoding (``/`` or ``+``
together with ``_`` or ``-``), a part is cut in each way that makes it fit,
and all pieces of 20 or more characters are candidates, so spans of kind
``random`` may overlap there. A candidate's encoding
is inferred from its alphabet, and four tests ask whether it looks drawn
uniformly from that alphabet: chi-squared counts of its characters and of
three classes (the letters that languages use most, other letters, the rest,
which tells names of words from keys), runs about the median, lag-one serial
correlation. The smallest p-value, times the tests, is the candidate's.

Being random is what the tests can refute, so a refutation is a discovery:
within each length class, Benjamini-Hochberg control over all candidates of
the corpus bounds the share of keys among the dismissed ones, and what it
can't tell from random is a secret of kind ``random``. Letters alone or
digits alone are no candidates, as words and numbers of that length would
often pass. The control needs only a histogram of p-values (a bounded table),
so nothing but counts is shuffled and each document judges its own candidates
by one row of thresholds.

Defined results: null and empty texts have no spans; repeated rows are
scanned alike; input columns named like a result (in any case) are replaced,
all others stay; offsets are code points, ends exclusive; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, text_of

#: Fixed patterns of the contract; group 2 of ``assign`` is the value.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE, SHORTEST = r"[A-Za-z0-9+/_=-]{20,}", 20
#: An ``=`` that is no padding at the end of a run; what two encodings don't
#: share, and the cuts that leave one of them, or names and path steps apart.
INNER, PLAIN, SAFE, CUTS = "=(?==*[^=])", "[+/]", "[_-]", ("[+/]", "[_-]", "[/_-]")
KINDS = ("assign", "access", "hex", "random")
#: (pattern of the whole token, its alphabet); the first that fits counts.
ENCODINGS = (
    ("[0-9a-f]+", "0123456789abcdef"),
    ("[0-9A-F]+", "0123456789ABCDEF"),
    ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Za-z+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("[0-9A-Za-z_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Upper ends of the length classes; share of false rejections; p-value bins.
CLASSES, FDR, BINS, PER_DECADE = (32, 48, 80), 0.05, 400, 20
#: A secret carries at least so many bits. Letters that English and its
#: neighbours use most; matches that are placed one after the other at a time.
MIN_BITS, COMMON, CHUNK = 80, "etaoinsr", 256
#: What is no common letter, and no other letter.
OUTSIDE = (f"[^{COMMON}{COMMON.upper()}]", f"[^A-Za-z]|[{COMMON}{COMMON.upper()}]")
NONE = "CAST(array() AS array<struct<s: int, k: int, e: int>>)"


def _found(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches whose ``group`` has
    ``least`` characters. The pieces between the matches give the offsets."""
    t, whole = F.col(text), F.concat(F.lit("("), F.lit(pattern), F.lit(")"))
    size = lambda group: F.transform(F.regexp_extract_all(t, whole, group), lambda x: F.length(x))
    pairs = F.zip_with(size(1), size(group + 1), lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    steps = F.zip_with(F.transform(F.split(t, pattern, -1), lambda x: F.length(x)), pairs, lambda g, x: F.struct(g.alias("g"), x["m"].alias("m"), x["v"].alias("v")))
    none = F.expr("CAST(array() AS array<struct<s: int, k: int, e: int, v: int>>)")

    def add(a, x):
        s = a["at"] + x["g"]
        e = s + F.coalesce(x["m"], F.lit(0))
        one = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), F.coalesce(x["v"], F.lit(-1)).alias("v"))
        return F.struct(e.alias("at"), F.when(x["v"].isNotNull(), F.concat(a["found"], F.array(one))).otherwise(a["found"]).alias("found"))

    # Growing one array by every match would cost their square: chunks first, by the sums before them.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))
    length = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["g"] + F.coalesce(x["m"], F.lit(0)))
    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("all"))
    before = F.aggregate(F.transform(chunks, length), begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    spans = F.flatten(F.zip_with(chunks, before, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("found")), add, lambda a: a["found"])))
    good = F.transform(F.filter(spans, lambda x: x["v"] >= least), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return F.when(t.rlike(pattern), good).otherwise(F.expr(NONE))


def _cut(c: Column, at: str) -> Column:
    """The pieces (s, e, w) of ``c`` between single characters ``at``."""
    start = F.struct(c["s"].alias("at"), F.expr("CAST(array() AS array<struct<s: int, e: int, w: string>>)").alias("found"))

    def add(a, x):
        e = a["at"] + F.length(x)
        return F.struct((e + 1).alias("at"), F.concat(a["found"], F.array(F.struct(a["at"].alias("s"), e.alias("e"), x.alias("w")))).alias("found"))

    return F.aggregate(F.split(c["w"], at, -1), start, add, lambda a: a["found"])


def _pieces(runs: Column) -> Column:
    """What is tested of ``runs`` (s, e, w): whole runs where they can be read as one token."""
    parts = F.flatten(F.transform(runs, lambda c: F.when(c["w"].rlike(INNER), _cut(c, INNER)).otherwise(F.array(c))))
    mixed = lambda c: c["w"].rlike(PLAIN) & c["w"].rlike(SAFE)
    cut = F.flatten(F.transform(parts, lambda c: F.when(mixed(c), F.array_distinct(F.concat(*[_cut(c, at) for at in CUTS]))).otherwise(F.array(c))))
    return F.filter(cut, lambda c: F.length(c["w"]) >= SHORTEST)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (a rational
    approximation good to 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def _tested(cands: Column) -> Column:
    """``cands`` (s, e, w) with n, q, p-value bin and length class."""
    body = F.transform(cands, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.regexp_replace(c["w"], "=+$", "").alias("b")))
    mixed = F.filter(body, lambda c: c["b"].rlike("[0-9]") & c["b"].rlike("[A-Za-z]"))
    alphabet = lambda b: reduce(lambda out, x: F.when(b.rlike(f"^{x[0]}$"), F.lit(x[1])).otherwise(out), reversed(ENCODINGS), F.lit(None).cast("string"))
    named = F.filter(F.transform(mixed, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["b"].alias("b"), alphabet(c["b"]).alias("a"))), lambda c: c["a"].isNotNull())
    coded = F.transform(
        named,
        lambda c: F.struct(
            c["s"].alias("s"), c["e"].alias("e"), F.length(c["b"]).cast("double").alias("n"), F.length(c["a"]).cast("double").alias("q"),
            *[F.length(F.regexp_replace(c[of], pattern, "")).cast("double").alias(f"{of}{k}") for of in ("b", "a") for k, pattern in enumerate(OUTSIDE)],
            F.transform(F.filter(F.split(c["b"], ""), lambda x: x != ""), lambda x: F.instr(c["a"], x).cast("double") - 1).alias("x"),
        ),
    )
    enough = F.filter(coded, lambda c: c["n"] * F.log2(c["q"]) >= MIN_BITS)
    zero = F.lit(0.0)
    sums = F.transform(
        enough,
        lambda c: F.struct(
            c["s"].alias("s"), c["e"].alias("e"), c["n"].alias("n"), c["q"].alias("q"), *[c[x].alias(x) for x in ("b0", "b1", "a0", "a1")],
            F.aggregate(F.array_distinct(c["x"]), zero, lambda a, v: a + F.pow(F.size(F.filter(c["x"], lambda y: y == v)).cast("double"), F.lit(2.0))).alias("cc"),
            F.aggregate(c["x"], zero, lambda a, v: a + v).alias("sx"),
            F.aggregate(c["x"], zero, lambda a, v: a + v * v).alias("sxx"),
            F.aggregate(F.zip_with(F.slice(c["x"], 1, F.size(c["x"]) - 1), F.slice(c["x"], 2, F.size(c["x"]) - 1), lambda u, v: u * v), zero, lambda a, v: a + v).alias("sxy"),
            (F.element_at(c["x"], 1) + F.element_at(c["x"], -1)).alias("ends"),
            F.size(F.filter(c["x"], lambda v: v >= c["q"] / 2)).cast("double").alias("hi"),
            F.size(F.filter(F.zip_with(F.slice(c["x"], 1, F.size(c["x"]) - 1), F.slice(c["x"], 2, F.size(c["x"]) - 1), lambda u, v: (u >= c["q"] / 2) != (v >= c["q"] / 2)), lambda b: b)).cast("double").alias("turns"),
        ),
    )

    def p_values(c):
        n, q = c["n"], c["q"]
        k = q - 1
        chi = F.pow(F.greatest(q / n * c["cc"] - n, F.lit(1e-9)) / k, F.lit(1 / 3))
        z1 = F.abs((chi - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))
        both = 2 * c["hi"] * (n - c["hi"])
        var = both * (both - n) / (n * n * (n - 1))
        z2 = F.when((c["hi"] == 0) | (c["hi"] == n) | (var <= 0), F.lit(8.0)).otherwise(F.abs(c["turns"] + 1 - 1 - both / n) / F.sqrt(F.greatest(var, F.lit(1e-9))))
        m = c["sx"] / n
        den = c["sxx"] - n * m * m
        num = c["sxy"] - m * (2 * c["sx"] - c["ends"]) + (n - 1) * m * m
        z3 = F.when(den <= 1e-9, F.lit(8.0)).otherwise(F.abs(num / F.greatest(den, F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(n)))
        want = [n / q * c["a0"], n / q * c["a1"], n / q * (q - c["a0"] - c["a1"])]
        seen = [c["b0"], c["b1"], n - c["b0"] - c["b1"]]
        classes = sum(((o - e) * (o - e) / e for o, e in zip(seen, want, strict=True)), F.lit(0.0))  # two degrees of freedom
        two_sided = F.least(_tail(F.least(z1, F.lit(8.0))), _tail(F.least(z2, F.lit(8.0))), _tail(F.least(z3, F.lit(8.0))))
        least = F.least(F.lit(1.0), 8 * two_sided, 4 * F.exp(-classes / 2))
        bin_ = F.least(F.floor(-F.log10(F.greatest(least, F.lit(1e-30))) * PER_DECADE), F.lit(BINS)).cast("int")
        klass = sum((F.when(n >= x, 1).otherwise(0) for x in CLASSES), F.lit(0))
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), klass.alias("c"), bin_.alias("b"))

    return F.transform(sums, p_values)


def scan(rows: DataFrame) -> DataFrame:
    """in_row, s_base (sorted spans s, k, e of the fixed kinds) and s_cands
    (tested candidates s, e, c, b that touch none of them) of ``rows``
    (in_row, s_in)."""
    x = rows.select("in_row", text_of("s_in").alias("s_text"))
    x = x.withColumn("s_base", F.sort_array(F.concat(_found("s_text", ASSIGN, 0, 2, 8), _found("s_text", ACCESS, 1), _found("s_text", HEX, 2))))
    x = x.withColumn("s_runs", _found("s_text", CANDIDATE, 3))
    runs = F.transform("s_runs", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.substring(F.col("s_text"), c["s"] + 1, c["e"] - c["s"]).alias("w")))
    x = x.withColumn("s_pieces", _pieces(runs))
    x = x.withColumn("s_free", F.filter("s_pieces", lambda c: ~F.exists("s_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))
    cands = F.when(F.size("s_free") > 0, _tested(F.col("s_free"))).otherwise(F.expr("CAST(array() AS array<struct<s: int, e: int, c: int, b: int>>)"))
    return x.select("in_row", "s_base", cands.alias("s_cands"))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row: ``s_limits``, the first rejected p-value bin of each length
    class. Only a histogram of at most classes x bins rows is ordered."""
    counts = scanned.select(F.explode("s_cands").alias("x")).groupBy("x.c", "x.b").agg(F.count("*").alias("n"))
    rows = counts.groupBy("c").agg(F.sum("n").alias("m"), F.collect_list(F.struct("b", "n")).alias("h"))  # at most BINS + 1 entries
    above = F.transform("h", lambda x: F.struct(x["b"].alias("b"), F.aggregate(F.filter("h", lambda y: y["b"] >= x["b"]), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("n")))
    rejected = F.filter(above, lambda x: F.pow(F.lit(10.0), -x["b"] / PER_DECADE) <= fdr * x["n"] / F.col("m"))
    limit = F.coalesce(F.array_min(F.transform(rejected, lambda x: x["b"])), F.lit(BINS + 1))
    return rows.select("c", limit.alias("b")).agg(F.collect_list(F.struct("c", "b")).alias("s_limits"))  # one entry a class


def decide(scanned: DataFrame, limits: DataFrame) -> DataFrame:
    """``scanned`` plus ``s_spans``: the base spans and the random ones."""
    both = scanned.crossJoin(F.broadcast(limits))  # one row by construction
    kept = F.filter("s_cands", lambda x: ~F.exists("s_limits", lambda y: (y["c"] == x["c"]) & (x["b"] >= y["b"])))
    added = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    return both.withColumn("s_spans", F.sort_array(F.concat("s_base", added))).drop("s_limits")


def spelled(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


RESULT = ("secret_spans",)


def scanned(rows: DataFrame) -> DataFrame:
    """``scan`` decided: in_row, s_base, s_spans. The scan is written once, as
    its candidates are counted before any is judged."""
    found = materialize(scan(rows), "secret-spans")
    return decide(found, thresholds(found))


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``secret_spans`` (array of s, k, e; k indexes ``KINDS``)."""
    rows, back = carried(docs, RESULT, s_in=text)
    return scanned(rows).select(*back, F.col("s_spans").alias("secret_spans"))


def redact(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """``text`` with each span (overlapping ones merged) replaced by ``mark``."""
    t = text_of(text)
    # the ends that rule each span: the furthest of those before it
    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<s: int, e: int, at: int>>)").alias("all"))
    add = lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["all"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), a["at"].alias("at")))).alias("all"))
    state = F.aggregate(F.col(spans), begin, add)
    pieces = F.transform(state["all"], lambda x: F.when((x["s"] >= x["at"]), F.concat(F.substring(t, x["at"] + 1, x["s"] - x["at"]), F.lit(mark))).otherwise(""))
    done = F.concat(F.array_join(pieces, ""), F.substring(t, state["at"] + 1, F.length(t)))
    return F.when(F.size(spans) > 0, done).otherwise(F.col(text))


def masked(docs: DataFrame, text: str = "text", length: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns as they are but ``text``, whose secrets are
    replaced by ``mark``, and ``length``, which follows a changed text."""
    names = docs.columns
    lower = [c.lower() for c in names]
    place = lambda n: names.index(n) if n in names else lower.index(n.lower())
    rows, cols = carried(docs, (), s_in=text)
    out = scanned(rows).select("in_row", "s_spans", F.col(f"in_row.c{place(text)}").alias("s_old"))
    out = out.select("in_row", "s_spans", redact("s_old", "s_spans", mark).alias("s_new"))
    cols[place(text)] = F.col("s_new").alias(names[place(text)])
    if length:
        at = place(length)
        cols[at] = F.when(F.size("s_spans") > 0, F.length("s_new").cast(docs.schema[at].dataType)).otherwise(F.col(f"in_row.c{at}")).alias(names[at])
    return out.select(*cols)
