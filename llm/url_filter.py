"""URL rules, extended to unruled pages by propagation over the link graph.

A page's host and path come from its url. Fixed rules (host and its
subdomains, path prefix; the longest wins) settle what they fit. The other
pages follow their host: trust starts at hosts in proportion to their allowed
pages and flows along links (personalised PageRank), distrust starts at hosts
with blocked pages and flows against them, to whoever links there. A host is
blocked if it has distrust and that is more than ``threshold`` of both.

Edges are counted by host pair before they meet, both walks run as one table
keyed by (walk, host), and every few rounds the state is written to the
shared folder, replacing the one before. The walk ends when a round moves
less than ``TOLERANCE`` of all mass; what is still to come is then at most
damping / (1 - damping) times that. Mass at hosts without edges leaves the
walk. The links of a host with very many are spread over several tasks.

Defined results: a null url or one without ``://`` has an empty host and path
and, if no rule fits, is allowed; null html has no links; links without a
host stay on the page's host and don't count; repeated rows count each; input
columns named like a result (in any case) are replaced, all others stay; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, discard, materialize

#: Fixed rules of the contract: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, TOLERANCE, THRESHOLD, EVERY = 0.85, 1e-4, 0.5, 10
#: Rounds by which any walk has met the tolerance.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING)) + 1
SALTS = 16
RESULT = ("host", "path", "rule", "verdict")
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones win
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts, counted."""
    links = pages.select(host_of(url).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("raw"))
    dst = F.regexp_replace(F.translate("raw", UPPER, LOWER), r"^[^@]*@", "")
    return links.select("src", dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, share: int = 1024) -> DataFrame:
    """(walk, host, score) of the walks from ``seeds`` (host, trust,
    distrust), whose mass each round starts anew."""
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("walk"), F.col("trust").alias("score")), F.struct(F.lit("d").alias("walk"), F.col("distrust").alias("score")))).alias("x"))
    start = materialize(start.select("x.walk", "host", "x.score").where("score > 0"), "url-seeds")
    both = edges.select(F.lit("t").alias("walk"), "src", "dst", "n").union(edges.select(F.lit("d").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    both = materialize(both, "url-edges")
    total = both.count()
    base = start.select("walk", "host", (F.col("score") * (1 - damping)).alias("score"))
    if not total:  # nothing moves
        return base
    out = both.groupBy("walk", "src").agg(F.sum("n").alias("all"), F.count("*").alias("links"))
    out = materialize(out.withColumn("hot", F.col("links") > max(total // share, 16)), "url-hosts")  # at most ``share`` hot ones
    hot_out = F.broadcast(out.where("hot"))
    split = not out.where("hot").isEmpty()
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt")
    steps = both.join(hot_out, ["walk", "src"]).unionByName(both.join(hot_out, ["walk", "src"], "left_anti").join(out.where("NOT hot"), ["walk", "src"])) if split else both.join(out, ["walk", "src"])
    steps = materialize(steps.select("walk", "src", "dst", salt, (F.col("n") / F.col("all") * damping).alias("share")), "url-steps")
    mass = start.agg(F.sum("score")).first()[0] or 0.0
    now, written, k = start, None, 0
    while True:
        here = now.withColumnRenamed("host", "src")
        if split:  # a hot host's score meets its links in several tasks
            here = here.join(hot_out.select("walk", "src", "hot"), ["walk", "src"], "left")
            here = here.select("walk", "src", "score", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))).alias("salt"))
        moved = steps.join(here, ["walk", "src", "salt"] if split else ["walk", "src"])
        after = moved.select("walk", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score")).union(base).groupBy("walk", "host").agg(F.sum("score").alias("score"))
        k += 1
        if k % EVERY:
            now = after
            continue
        old, now = written, materialize(after, "url-walk")
        # EVERY rounds apart: bounds the change of one round from above
        then = (old or start).select("walk", "host", (-F.col("score")).alias("score"))
        change = now.unionByName(then).groupBy("walk", "host").agg(F.sum("score").alias("x")).agg(F.sum(F.abs("x"))).first()[0] or 0.0
        if old is not None:
            discard(old)
        written = now
        if change <= tolerance * mass:
            return now


def url_filter(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule``, ``verdict``."""
    rows, back = carried(pages, RESULT, u_url=url, u_html=html)
    split = rows.select("in_row", "u_url", host_of("u_url").alias("host"), path_of("u_url").alias("path"))
    name, verdict = rule_of("host", "path", rules)
    ruled = split.withColumn("rule", name).withColumn("verdict", verdict)
    count = lambda v: F.sum((F.col("verdict") == v).cast("double"))
    seeds = ruled.where("verdict IS NOT NULL AND host <> ''").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    scores = propagate(seeds, host_edges(rows, "u_url", "u_html"), damping, tolerance)
    total = lambda w: F.sum(F.when(F.col("walk") == w, F.col("score")).otherwise(0.0))
    hosts = scores.groupBy("host").agg(total("t").alias("trust"), total("d").alias("distrust"))
    bad = hosts.where((F.col("distrust") > 0) & (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))).select(F.col("host").alias("bad"))
    bad = materialize(bad, "url-blocked")
    salts = 16  # a host with very many pages is spread where the blocked hosts are too many to broadcast
    many = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = ruled.withColumn("salt_of", F.pmod(F.xxhash64("path", F.coalesce("u_url", F.lit(""))), F.lit(salts)).cast("int"))
    both = left.join(many, (F.col("host") == F.col("bad")) & (F.col("salt_of") == F.col("salt")), "left")
    return both.select(*back, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def oracle(rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD, rules=RULES) -> str:
    """The same over the ``pages`` view as DuckDB SQL, its rounds unrolled."""
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if what else v}'" for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))) + " END"
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    host, dst = lower.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')"), lower.format("raw")
    sql = rf"""WITH a AS (SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT page_id, host, path, {cases(1)} AS rule, {cases(0)} AS v FROM a),
s AS (SELECT host, w, CAST(sum(CASE WHEN v = k THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM b, (VALUES ('t', 'allow'), ('d', 'block')) AS x(w, k) WHERE v IS NOT NULL AND host <> '' GROUP BY host, w),
l AS (SELECT src, regexp_replace({dst}, '^[^@]*@', '') AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS raw FROM a)),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
f AS (SELECT 't' AS w, src, dst, n FROM e UNION ALL SELECT 'd', dst, src, n FROM e),
t AS (SELECT w, src, dst, n / sum(n) OVER (PARTITION BY w, src) * {damping} AS share FROM f),
z AS (SELECT w, host, score * (1 - {damping}) AS score FROM s WHERE score > 0),
r0 AS (SELECT w, host, score FROM s WHERE score > 0)"""
    for k in range(rounds):
        sql += f",\nr{k + 1} AS MATERIALIZED (SELECT w, host, sum(score) AS score FROM (SELECT t.w, t.dst AS host, r{k}.score * share AS score FROM r{k} JOIN t ON t.w = r{k}.w AND t.src = r{k}.host UNION ALL SELECT * FROM z) GROUP BY w, host)"
    return sql + f""",
h AS (SELECT host, sum(CASE WHEN w = 't' THEN score ELSE 0 END) AS trust, sum(CASE WHEN w = 'd' THEN score ELSE 0 END) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, b.host, path, rule, coalesce(v, CASE WHEN distrust > 0 AND distrust > {threshold} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN h ON b.host = h.host"""
