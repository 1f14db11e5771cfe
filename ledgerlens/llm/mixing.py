"""Mixing sources to target weights.

Sizes are added up per source; each source's target is its share of a budget, never more than a multiple of its size; the
repetition rate is target / size. A document is emitted floor(rate) times, plus once more when a hash of it falls below
the fraction of the rate. DataFrame functions only.

Defined results: a missing text has size 0; a missing source is a source of its own, last in order; rows that repeat are
mixed each (equal rows draw alike, so reruns and retried tasks agree); sources of size 0 have target 0 and their documents
are emitted floor(0) = 0 times; an empty table gives an empty result; other columns are carried and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import WORD, attach, materialise, packed, whole_text

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST = 2
SEED = 20_240_607


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def _key(source: str) -> Column:
    """Sorts by code point with the missing source last (UTF-8 bytes sort as code points do)."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def numbered(keys: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the place (from 0) of each row in the order of `by`, without one task that sees all of them.

    The sorted table is written, so the places of the parts do not change; only a count per part reaches the driver.
    """
    sorted_keys = materialise(keys.orderBy(by).select("*", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = sorted_keys.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, pairs = 0, []
    for row in counts:
        pairs.append((row["part"], before))
        before += row["count"]
    offsets = sorted_keys.sparkSession.createDataFrame(pairs, "part long, before long")
    out = sorted_keys.withColumn("part", part).join(F.broadcast(offsets), "part")
    return out.withColumn(name, F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "before")


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """`source_key, source_docs, source_size, weight, target, rate`, one row per source.

    Sources whose target would exceed `most` times their size stop there, and what they leave is shared again by weight,
    until none is above. Each round is one aggregate over the table of sources; sums stay whole numbers, so the targets
    do not depend on the order of addition.
    """
    sources = sizes.groupBy("source_key").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("size").alias("source_size"))
    sources = numbered(sources, "source_key", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    sources = materialise(sources.withColumn("weight", weight).drop("place"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = most * F.col("source_size")
    above, numerator, denominator = F.lit(False), 0, 1
    wide = lambda c: c.cast("decimal(38,0)")
    last = -1
    while True:
        row = sources.agg(
            F.sum(F.when(above, cap).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"), F.sum(F.when(above, 1).otherwise(0)).alias("n")
        ).first()
        if row["n"] == last or not row["open"]:
            break
        last = row["n"]
        numerator, denominator = share_percent * total - 100 * row["held"], 100 * row["open"]
        above = wide(F.col("weight")) * F.lit(numerator).cast("decimal(38,0)") > wide(cap) * F.lit(denominator).cast("decimal(38,0)")
    target = F.when(above, cap.cast("double")).otherwise((wide(F.col("weight")) * F.lit(numerator).cast("decimal(38,0)")).cast("double") / F.lit(float(denominator)))
    target = F.when(F.col("source_size") > 0, target).otherwise(0.0)
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("rate", rate)


def copies(rate: Column, *parts: Column, seed: int = SEED) -> Column:
    """floor(rate), and one more with the probability of the fraction, drawn from 48 bits of a hash of the parts."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row per document: `doc_id, source_key, size, source_size, target, rate, copies`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(source).alias("source_key"), n_words(text).alias("size"), F.md5(F.concat_ws(":", F.col(doc_id), F.col(text))).alias("mark"))
    rows = materialise(rows)
    out = attach(rows, source_rates(rows, **how), "source_key", "source_docs")
    return out.withColumn("copies", copies(F.col("rate"), F.col("mark"))).drop("mark", "weight", "source_docs")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed documents: each row of `docs` as often as its copies say, with the columns it came with."""
    sizes = materialise(docs.select(_key(source).alias("source_key"), n_words(text).alias("size")))
    rates = source_rates(sizes, **how).select("source_key", "source_docs", "rate")
    rows = docs.select(packed(docs).alias("row"), _key(source).alias("source_key"), F.md5(F.concat_ws(":", F.col(doc_id), F.col(text))).alias("mark"))
    rows = attach(rows, rates, "source_key", "source_docs").withColumn("copies", copies(F.col("rate"), F.col("mark")).cast("int"))
    return rows.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")
