"""The registered queries of this package and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair as conversations
from . import curve_search as curves
from . import hard_negatives as negatives
from . import jaccard_join as jaccard
from . import license_scan as licenses
from . import lm_scoring as lm
from . import mixing, packing
from . import pseudonyms as pii
from . import quality_rules as quality
from . import secret_scan as secrets
from . import simhash
from . import url_filter as urls
from .common import materialize, read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = quality.document_metrics(docs).select("doc_id", "host", *quality.METRICS, "n_lines", "base_failed", "fails")
    measured = materialize(measured, "quality-metrics")  # a few numbers a document, read twice below
    return quality.judge(measured, quality.host_verdicts(measured)).select("doc_id", *quality.METRICS, "base_failed", "kept")


SQL["op7_quality_rules"] = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
m AS (SELECT w.doc_id, source AS host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CAST(100 * n_symbols > 10 * n_words AS INT) AS f1, CAST(100 * n_dup_lines > 50 * n_lines AS INT) AS f2,
        CAST(word_chars < 2 * n_words OR word_chars > 12 * n_words AS INT) AS f3 FROM m),
h AS (SELECT host, rule, count(*) AS n, CAST(sum(x) AS DOUBLE) AS x
      FROM (SELECT host, unnest([1, 2, 3]) AS rule, unnest([f1, f2, f3]) AS x FROM f) GROUP BY host, rule),
o AS (SELECT rule, sum(n) AS d, count(*) AS k, sum(n * n) AS q, sum(x) / sum(n) AS m, sum(x * x / n) AS s FROM h GROUP BY rule),
v AS (SELECT rule, d, k, m, (s - d * m * m - (k - 1) * m * (1 - m)) / nullif(d - q / d, 0) AS spread FROM o),
e AS (SELECT rule, m, CASE WHEN k < 2 THEN 1.0 WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM v),
y AS (SELECT host, max(CASE WHEN rule = 1 AND rate > 0.02 THEN 1 ELSE 0 END) AS e1, max(CASE WHEN rule = 2 AND rate > 0.02 THEN 1 ELSE 0 END) AS e2,
        max(CASE WHEN rule = 3 AND rate > 0.02 THEN 1 ELSE 0 END) AS e3
      FROM (SELECT host, h.rule, (x + weight * m) / (n + weight) AS rate FROM h JOIN e USING (rule)) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (f1 = 1 AND e1 = 1) OR (f2 = 1 AND e2 = 1) OR (f3 = 1 AND e3 = 1)) AS kept
FROM f JOIN y ON f.host IS NOT DISTINCT FROM y.host
"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scanned(docs.select(F.struct("doc_id").alias("in_row"), F.col("text").alias("s_in")))  # the id alone is carried
    count = lambda k: F.size(F.filter("s_base", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "in_row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.spelled("s_base"), 256).alias("base_sha256"), secrets.spelled("s_spans").alias("spans"),
    )


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.license_scan(docs, keep=["doc_id"])
    comma = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", comma("base_labels"), comma("labels"), "score")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", mixing.n_words().alias("size")), "mix-sizes")
    return mixing.mix(sized, text=None).select("doc_id", "size", "source_size", "target", "taken")


SQL["op4_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS ss, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, {mixing.CAP} * ss AS most, sum(ss) OVER () AS words, coalesce(sum({mixing.CAP} * ss) OVER (ORDER BY ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(w) OVER (ORDER BY ss / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, row_number() OVER (ORDER BY ss / w, source) AS k FROM s),
l AS (SELECT arg_min(({mixing.SHARE} * words - full_before) / w_left, k) AS level FROM c WHERE w * (({mixing.SHARE} * words - full_before) / w_left) <= most),
t AS (SELECT source, n, ss, CASE WHEN words = 0 THEN 0.0 ELSE least(w * level, most) END AS target FROM c, l),
p AS (SELECT *, CASE WHEN ss > 0 THEN target / ss ELSE 0.0 END AS part, CAST('0x' || substr(sha256('{mixing.SEED}|' || coalesce('s' || source, 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS o FROM t),
q AS (SELECT *, CASE WHEN part > floor(part) THEN CAST(greatest(round(1 / (part - floor(part))), 1) AS BIGINT) ELSE 1 END AS run FROM p),
r AS (SELECT doc_id, size, ss, target, part, o, run, n, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) - 1 AS up FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
a AS (SELECT *, CASE WHEN (up // run) % 2 = 1 THEN up - up % run + least(up - up % run + run, n) - 1 - up ELSE up END AS rank FROM r)
SELECT doc_id, size, ss AS source_size, target, CAST(size * least(floor((rank + 1) * part + o) - floor(rank * part + o), ceil(part)) AS BIGINT) AS taken FROM a
"""


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read_table(spark, sf_dir, "documents"))


@query
def op2_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.search(read_table(spark, sf_dir, "embeddings"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL["op8_url_filter"] = urls.oracle(20)  # rounds unrolled; the pages that SQL sees link to no other host


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEMPLATES = ", ".join(f"({i}, '{label}', {len(t.split())}, {p}, '{' '.join(t.split()[p : p + licenses.K])}')" for i, (label, t) in enumerate(licenses.TEMPLATES) for p in range(len(t.split()) - licenses.K + 1))
SQL["op10_license_scan"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS i FROM w),
g AS (SELECT doc_id, i, a, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM t WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, CASE WHEN a = 'mit' THEN 'mit' WHEN a = 'apache' THEN 'apache' ELSE 'gpl' END AS label FROM g
      WHERE (a IN ('mit', 'apache') AND b = 'license') OR (a = 'general' AND b = 'public' AND c = 'license')),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
k(template, label, size, t, gram) AS (VALUES {_TEMPLATES}),
h AS (SELECT DISTINCT doc_id, template, label, size, i - t AS d, t FROM g JOIN k ON k.gram = a || ' ' || b || ' ' || c WHERE c IS NOT NULL),
d AS (SELECT DISTINCT doc_id, template, d FROM h),
f AS (SELECT *, CASE WHEN d - lag(d) OVER s <= {licenses.GAP} THEN 0 ELSE 1 END AS fresh FROM d WINDOW s AS (PARTITION BY doc_id, template ORDER BY d)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM f),
m AS (SELECT doc_id, template, label, size, run, count(DISTINCT t + x) / size AS score FROM h JOIN r USING (doc_id, template, d), (SELECT unnest([0, 1, 2]) AS x) GROUP BY doc_id, template, label, size, run),
own AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) FILTER (score >= {licenses.MIN_COVER}) AS labels FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""

SQL["op9_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM c JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r(doc_id, class) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.j, r.class FROM r JOIN e ON e.i = r.doc_id)
SELECT doc_id, min(class) AS class_id, coalesce((SELECT count(*) FROM e WHERE e.i = r.doc_id), 0) AS n_links FROM r GROUP BY doc_id
"""


@query
def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _secret_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    spans = []
    for kind, (pattern, group, least) in enumerate(((secrets.ASSIGN, 2, 8), (secrets.ACCESS, 0, 0), (secrets.HEX, 0, 0), (secrets.CANDIDATE, 0, 0))):
        p = quoted(pattern)
        spans.append(f"""SELECT doc_id, {kind} AS k, s, s + m AS e, t FROM (SELECT doc_id, t, m, v, sum(g) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
          FROM (SELECT doc_id, t, unnest(range(len(ms))) AS i, length(unnest(gs[:len(ms)])) AS g, length(unnest(ms)) AS m, length(unnest(vs)) AS v
                FROM (SELECT doc_id, t, string_split_regex(t, {p}) AS gs, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs FROM d WHERE regexp_matches(t, {p})))) WHERE v >= {least}""")
    tail = lambda z: f"(exp(-{z} * {z} / 2) / 2.5066282746310002 * (1 / (1 + 0.2316419 * {z})) * (0.319381530 + (1 / (1 + 0.2316419 * {z})) * (-0.356563782 + (1 / (1 + 0.2316419 * {z})) * (1.781477937 + (1 / (1 + 0.2316419 * {z})) * (-1.821255978 + (1 / (1 + 0.2316419 * {z})) * 1.330274429)))))"
    alphabet = "CASE " + " ".join(f"WHEN regexp_full_match(b, '{p}') THEN '{a}'" for p, a in secrets.ENCODINGS) + " END"
    klass = " + ".join(f"CASE WHEN n >= {x} THEN 1 ELSE 0 END" for x in secrets.CLASSES)
    names = "['" + "', '".join(secrets.KINDS) + "']"
    line = lambda t: f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER ({t})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(spans)}),
base AS (SELECT doc_id, k, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM a WHERE k < 3),
c AS (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, rtrim(substr(t, CAST(s AS INT) + 1, CAST(e - s AS INT)), '=') AS b FROM a WHERE k = 3
      AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = a.doc_id AND base.s < a.e AND a.s < base.e)),
f AS (SELECT *, {alphabet} AS al FROM c WHERE regexp_matches(b, '[0-9]') AND regexp_matches(b, '[A-Za-z]')),
x AS (SELECT doc_id, s, e, CAST(length(b) AS DOUBLE) AS n, CAST(length(al) AS DOUBLE) AS q, i, CAST(strpos(al, substr(b, i, 1)) - 1 AS DOUBLE) AS x
      FROM (SELECT *, CAST(unnest(range(1, length(b) + 1)) AS INT) AS i FROM f WHERE al IS NOT NULL AND length(b) * log2(length(al)) >= {secrets.MIN_BITS})),
k AS (SELECT doc_id, s, CAST(length(regexp_replace(b, '{secrets.OUTSIDE[0]}', '', 'g')) AS DOUBLE) AS b0, CAST(length(regexp_replace(b, '{secrets.OUTSIDE[1]}', '', 'g')) AS DOUBLE) AS b1,
        CAST(length(regexp_replace(al, '{secrets.OUTSIDE[0]}', '', 'g')) AS DOUBLE) AS a0, CAST(length(regexp_replace(al, '{secrets.OUTSIDE[1]}', '', 'g')) AS DOUBLE) AS a1 FROM f WHERE al IS NOT NULL),
y AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, s ORDER BY i) AS z FROM x),
cc AS (SELECT doc_id, s, sum(k * k) AS cc FROM (SELECT doc_id, s, x, CAST(count(*) AS DOUBLE) AS k FROM x GROUP BY doc_id, s, x) GROUP BY doc_id, s),
u AS (SELECT doc_id, s, e, n, q, sum(x) AS sx, sum(x * x) AS sxx, coalesce(sum(x * z), 0) AS sxy, sum(CASE WHEN i = 1 OR i = n THEN x ELSE 0 END) AS ends, CAST(count(*) FILTER (x >= q / 2) AS DOUBLE) AS hi,
        CAST(count(*) FILTER (z IS NOT NULL AND (x >= q / 2) <> (z >= q / 2)) AS DOUBLE) AS turns FROM y GROUP BY doc_id, s, e, n, q),
v AS (SELECT *, pow(greatest(q / n * cc - n, 1e-9) / (q - 1), 1.0 / 3) AS chi, 2 * hi * (n - hi) AS two, sxx - sx * sx / n AS den, sxy - sx / n * (2 * sx - ends) + (n - 1) * (sx / n) * (sx / n) AS num FROM u JOIN cc USING (doc_id, s) JOIN k USING (doc_id, s)),
w AS (SELECT *, least(abs((chi - (1 - 2 / (9 * (q - 1)))) / sqrt(2 / (9 * (q - 1)))), 8.0) AS z1,
        CASE WHEN hi = 0 OR hi = n OR two * (two - n) <= 0 THEN 8.0 ELSE least(abs(turns - two / n) / sqrt(two * (two - n) / (n * n * (n - 1))), 8.0) END AS z2,
        CASE WHEN den <= 1e-9 THEN 8.0 ELSE least(abs(num / den * sqrt(n) + 1 / sqrt(n)), 8.0) END AS z3,
        (b0 - n / q * a0) * (b0 - n / q * a0) / (n / q * a0) + (b1 - n / q * a1) * (b1 - n / q * a1) / (n / q * a1)
        + (n - b0 - b1 - n / q * (q - a0 - a1)) * (n - b0 - b1 - n / q * (q - a0 - a1)) / (n / q * (q - a0 - a1)) AS x2 FROM v),
p AS (SELECT doc_id, s, e, {klass} AS c, CAST(least(floor(-log10(greatest(least(1.0, 8 * least({tail("z1")}, {tail("z2")}, {tail("z3")}), 4 * exp(-x2 / 2)), 1e-30)) * {secrets.PER_DECADE}), {secrets.BINS}) AS INT) AS b FROM w),
h AS (SELECT c, b, sum(count(*)) OVER (PARTITION BY c ORDER BY b DESC) AS n, sum(count(*)) OVER (PARTITION BY c) AS m FROM p GROUP BY c, b),
l AS (SELECT c, min(b) AS b FROM h WHERE pow(10.0, -b / {secrets.PER_DECADE}) <= {secrets.FDR} * n / m GROUP BY c),
o AS (SELECT doc_id, k, s, e FROM base UNION ALL SELECT doc_id, 3, s, e FROM p LEFT JOIN l USING (c) WHERE l.b IS NULL OR p.b < l.b)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce({line("k < 3")}, '')) AS base_sha256, coalesce({line("k IS NOT NULL")}, '') AS spans
FROM d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id
"""


SQL["op5_secret_scan"] = _secret_sql()


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved))


SQL["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damaged(read_table(spark, sf_dir, "conversations")), absent="absent")


def _repair_sql() -> str:
    put = lambda label, cost, line, s: f"{{'c': {s}.c + {cost}, 'a': '{label}' || {s}.a, 't': {line} || {s}.t}}"
    line = lambda role: f"chr(10) || {role} || ':'"
    most = "{'c': 1000000000, 'a': '', 't': ''}"

    def read(q: int) -> str:
        """The cheapest way to read the row in grammar state ``q``."""
        user, to = q != 2, 3 if q == 2 else 2
        keep = [("u" if user else "a", to), *([("s", 1)] if q == 0 else [])]
        ways = [f"CASE WHEN f < 2 AND left(role, 1) = '{i}' THEN {put('K', '3 * f', line('role') + ' || text', f's{k}')} ELSE {most} END" for i, k in keep]
        name = "'user'" if user else "'assistant'"
        ways.append(f"CASE WHEN f < 2 THEN {put('R', '3 + 3 * f', line(name) + ' || text', f's{to}')} ELSE {most} END")
        return f"list_min([{', '.join([*ways, put('D', '4', chr(39) * 2, f's{q}')])}])"

    def insert(q: int, more: str) -> str:
        """No insert before the row, or one before what ``more`` are."""
        name, to = ("'assistant'", 3) if q == 2 else ("'user'", 2)
        return f"list_min([e{q}, {put('I', '3', line(name), f'{more}{to}')}])"

    crc = "list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda c, b: xor(c >> 8, crc_table[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295)"
    bit = lambda x: f"CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    table = "list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: " + bit("a") + "))"
    four = lambda f: ", ".join(f(q) for q in range(4))
    return rf"""
WITH RECURSIVE crc AS (SELECT {table} AS crc_table),
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
w AS (SELECT conv_id, turn, role, text, xor({crc}, 4294967295) % 20 AS way FROM g, crc),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN way = 3 THEN [0, 1] ELSE [0] END) AS copy FROM w WHERE way <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
p AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN regexp_matches(text, '[.!?][ 	-
]*\z') THEN 0 ELSE 1 END AS f,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 2) AS blank, count(*) FILTER (f = 3) AS duplicate,
        count(*) FILTER (f = 1) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY conv_id),
r(conv_id, k, s0, s1, s2, s3) AS (
  SELECT conv_id, n, {{'c': 0, 'a': '', 't': ''}}, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 't': ''}} FROM n
  UNION ALL
  SELECT conv_id, k, {four(lambda q: insert(q, 'm'))} FROM (
    SELECT *, {four(lambda q: insert(q, 'e') + f' AS m{q}')} FROM (
      SELECT r.conv_id, k - 1 AS k, {four(lambda q: read(q) + f' AS e{q}')} FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = k WHERE k > 0))),
b AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, substr(s0.t, 2) AS t FROM r WHERE k = 0)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL["op13_conversation_repair"] = _repair_sql()
