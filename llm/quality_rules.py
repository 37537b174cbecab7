"""Host-level quality rules (DataFrame functions only).

Every document is measured once; rule failures are summed by host (map-side,
so a host with a third of all rows costs no more than another), the failure
rates are shrunk towards an empirical beta prior, and the hosts' verdicts are
joined back. A rule is *enforced* on a host whose shrunken failure rate
exceeds ``max_rate``; elsewhere single failures are forgiven. A document that
fails no rule is always kept.

Defined results: null text is empty (no words, fails the length rule); a null
host is a host of its own; repeated rows each count and each come back; an
empty table gives an empty result; input columns named like a result (in any
case) are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, carried, materialize, spread_join, text_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Soft rules, enforced by host: more than one symbol per so many words,
#: more than half of all lines repeated, mean word length outside the bounds.
SYMBOL_PERCENT, DUP_LINE_PERCENT, WORD_LENGTH = 10, 50, (2, 12)
MAX_RATE = 0.02
RULES = ("short", "repeats", "symbols", "lines", "length")
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "fails", "host", "kept")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> tuple[DataFrame, list]:
    """(in_row, host, the metrics, n_lines, base_failed, fails; the columns that bring ``docs`` back)."""
    rows, keep = carried(docs, RESULT, q_text=text, q_host=host)
    packed = rows.select(F.col("in_row").alias("q_in"), text_of("q_text").alias("q_text"), F.col("q_host").alias("host"))
    split = packed.select(
        "q_in", "q_text", "host",
        F.filter(F.split("q_text", SPACE), lambda w: w != "").alias("q_words"),
        F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("q_lines"),
    )
    windows = split.select(
        "q_in", "host",
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        (F.length("q_text") - F.length(F.regexp_replace("q_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(q_words) < 4 THEN CAST(array() AS array<struct<h: bigint, p: int>>)
            ELSE transform(sequence(0, size(q_words) - 3), i -> struct(xxhash64(q_words[i], q_words[i + 1], q_words[i + 2]) AS h, i AS p)) END""").alias("q_at"),
    )
    # sorted by hash, equal windows are neighbours: n log n in any text, however repetitive
    ordered = windows.withColumn("q_at", F.expr("CASE WHEN size(array_distinct(q_at.h)) < size(q_at) THEN sort_array(q_at) ELSE CAST(array() AS array<struct<h: bigint, p: int>>) END"))
    counted = ordered.withColumn(
        "n_repeat_words",
        F.expr("""CAST(size(array_distinct(flatten(transform(
            filter(q_at, (x, i) -> (i > 0 AND q_at[i - 1].h = x.h) OR (i < size(q_at) - 1 AND q_at[i + 1].h = x.h)),
            x -> array(x.p, x.p + 1, x.p + 2))))) AS bigint)"""),
    )
    short = F.col("n_words") < MIN_WORDS
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    fails = {
        "short": short,
        "repeats": repeats,
        "symbols": F.col("n_symbols") * 100 > F.col("n_words") * SYMBOL_PERCENT,
        "lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * DUP_LINE_PERCENT,
        "length": (F.col("word_chars") < F.col("n_words") * WORD_LENGTH[0]) | (F.col("word_chars") > F.col("n_words") * WORD_LENGTH[1]),
    }
    out = counted.select(
        F.col("q_in").alias("in_row"), "host", *METRICS, "n_lines", (short | repeats).alias("base_failed"), F.struct(*[fails[r].alias(r) for r in RULES]).alias("fails")
    )
    return out, keep


def document_metrics(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` plus the metrics, ``n_lines``, ``host`` and one flag a rule."""
    out, keep = measured(docs, text, host)
    return out.select(*keep, *RESULT[:-3], "fails", "host")


def host_verdicts(metrics: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row a host: n_docs, and for each rule its failures, shrunken rate
    and whether it is enforced.

    The beta prior of a rule comes from all hosts by the method of moments:
    its mean is the overall rate, its weight follows from how much more the
    hosts' rates vary than counting alone explains.
    """
    hosts = metrics.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(f"fails.{r}").cast("long")).alias(f"f_{r}") for r in RULES])
    hosts = materialize(hosts, "quality-hosts")
    n = F.col("n_docs")
    moments = hosts.agg(
        F.sum(n).alias("all_docs"), F.count("*").alias("all_hosts"), F.sum(n * n).alias("all_squares"),
        *[F.sum(f"f_{r}").alias(f"all_{r}") for r in RULES],
        *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"sq_{r}") for r in RULES],
    )
    joined = hosts.crossJoin(F.broadcast(moments))  # one row by construction
    out = [F.col("host"), n]
    for r in RULES:
        m = F.col(f"all_{r}") / F.col("all_docs")
        within = m * (1 - m)
        between = F.col(f"sq_{r}") - F.col("all_docs") * m * m  # sum of n (rate - mean)^2
        spread = (between - (F.col("all_hosts") - 1) * within) / (F.col("all_docs") - F.col("all_squares") / F.col("all_docs"))
        weight = F.when(spread > 0, F.least(F.greatest(within / spread - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
        weight = F.when(F.col("all_hosts") < 2, F.lit(1.0)).otherwise(weight)
        rate = (F.col(f"f_{r}") + weight * m) / (n + weight)
        out += [F.col(f"f_{r}"), rate.alias(f"rate_{r}"), (rate > max_rate).alias(f"enforced_{r}")]
    return joined.select(*out)


def judge(metrics: DataFrame, hosts: DataFrame) -> DataFrame:
    """``metrics`` plus ``kept``. A host with very many documents is spread
    over several join keys where the hosts are too many to broadcast."""
    names = metrics.columns
    both = spread_join(metrics, hosts, "host", "host", list(METRICS))
    bad = F.col("d.base_failed")
    for r in RULES[2:]:
        bad = bad | (F.col(f"d.fails.{r}") & F.coalesce(F.col(f"h.enforced_{r}"), F.lit(False)))
    return both.select(*[F.col(f"d.{c}") for c in names], (~bad).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` with metrics, rule flags and ``kept``."""
    # Written once: the rules are costly, two passes need them, and a filter on
    # ``kept`` would otherwise be pushed into (and repeat) the whole measurement.
    rows, keep = measured(docs, text, host)
    rows = materialize(rows, "quality-rows")
    return judge(rows, host_verdicts(rows, max_rate)).select(*keep, *RESULT[:-3], "fails", "host", "kept")


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The documents that the rules keep, all columns as they are."""
    whole, back = carried(docs, (), q_doc=text, q_source=host)
    rows, keep = measured(whole, "q_doc", "q_source")
    rows = materialize(rows.select(*keep, *[c for c in rows.columns if c != "in_row"]).drop("q_doc", "q_source"), "quality-rows")
    return judge(rows, host_verdicts(rows, max_rate)).where("kept").select(*back)
