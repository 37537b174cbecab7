"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words: its share, by weight, of ``share`` times
all words, but at most ``cap`` times its own; what a capped source can't take
is shared again among the rest. Every document of a source expects
target / size copies. Walking the documents of a source and summing their
expected copies from one random offset, a document is taken once for every
integer boundary that its own part crosses. As the parts of a source are
equal, the prefix sum before the r-th document is r times the part: exact,
and independent of how the rows are dealt out. Ranks come from one range
exchange over (source, length, id), which splits a hot source like any other
run of rows.

The walk goes up and down: documents are ranked by length and every second
run of as many documents as cross one boundary is walked backwards. A long
document taken in one run is then set off by a short one in the next, so the
words taken come near the target whatever the offset.

Defined results: null text has no words; null sources form one source, last
in order; repeated rows are documents of their own; a source without words
takes nothing; input columns named like a result (in any case) are replaced,
all others stay; same rows and seed give the same mix; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, carried, materialize, ordered_rows, spread_join, text_of

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 17
RESULT = ("size", "source_size", "target", "copies", "taken")


def n_words(text: str = "text") -> Column:
    return F.size(F.filter(F.split(text_of(text), SPACE), lambda w: w != "")).cast("long")


def source_targets(sized: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: ``source``, ``n_docs``, ``source_size``,
    ``first_rank`` (documents in sources before it), ``target``."""
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = ordered_rows(sums, [F.col("source").asc_nulls_last()], "mix-sources", "n_docs")
    factor = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row_rank") % len(weights)).cast("int") + 1)
    order = materialize(order.select("source", "n_docs", "source_size", F.col("row_before").alias("first_rank"), factor.alias("weight")), "mix-weights")
    limit = cap * F.col("source_size")
    words = order.agg(F.sum("source_size")).first()[0] or 0
    # The level rises while more sources reach their cap; one small aggregate a step.
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level > limit
        r = order.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
        if not r[1]:
            break
        if r[2] == capped:
            break
        level, capped = (share * words - r[0]) / r[1], r[2]
    target = F.least(F.col("weight") * level, limit) if words else F.lit(0.0)
    return order.select("source", "n_docs", "source_size", "first_rank", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source: 52 bits of a keyed hash as a part of one."""
    name = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), name), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``docs`` may bring its own ``size`` instead of a text (``text=None``).
    """
    rows, back = carried(docs, RESULT, mix_id=doc_id, mix_source=source, mix_text="size" if text is None else text)
    size = F.col("mix_text").cast("long") if text is None else n_words("mix_text")
    return _mixed(rows.select("in_row", "mix_id", "mix_source", size.alias("size")), seed, weights, share, cap).select(*back, "size", "source_size", "target", "copies", "taken")


def _mixed(sized: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sized`` (in_row, mix_id, mix_source, size) with the results."""
    sized = sized.withColumn("mix_uid", F.monotonically_increasing_id())  # parts equal rows
    targets = source_targets(sized, "mix_source", weights, share, cap)
    part = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rest = F.col("part") - F.floor("part")
    run = F.when(F.col("rest") > 0, F.greatest(F.round(1 / F.col("rest")), F.lit(1.0))).otherwise(1.0).cast("long")
    targets = targets.withColumn("part", part).withColumn("rest", rest).withColumn("run", run).withColumn("offset", offset(F.col("source"), seed))
    ranked = ordered_rows(sized, [F.col("mix_source").asc_nulls_last(), F.col("size"), F.col("mix_id"), F.col("mix_uid")], "mix-ranks")
    both = spread_join(ranked, targets, "mix_source", "source", ["row_rank"])
    both = both.select("in_row", "size", "source_size", "target", "part", "offset", "run", "n_docs", (F.col("row_rank") - F.col("first_rank")).alias("up"))
    first = F.col("up") - F.col("up") % F.col("run")
    last = F.least(first + F.col("run"), F.col("n_docs")) - 1
    rank = F.when((F.col("up") - F.col("up") % F.col("run")) / F.col("run") % 2 == 1, first + last - F.col("up")).otherwise(F.col("up"))
    both = both.withColumn("at", rank.cast("double"))
    crossed = F.floor((F.col("at") + 1) * F.col("part") + F.col("offset")) - F.floor(F.col("at") * F.col("part") + F.col("offset"))
    copies = F.least(crossed, F.ceil("part")).cast("long")
    return both.select("in_row", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs``, all columns as they are, each row as often as the mix takes it."""
    rows, back = carried(docs, (), mix_id=doc_id, mix_text=text, mix_source=source)
    mixed = _mixed(rows.select("in_row", "mix_id", "mix_source", n_words("mix_text").alias("size")), **options).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("in_row", F.col("copies").cast("int"))).alias("in_row")).select(*back)
