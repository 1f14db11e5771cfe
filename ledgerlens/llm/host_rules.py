"""Quality rules with host verdicts.

Every document gets rule measurements from its own text. Failures are added up by host, the failure rates are shrunk
towards the corpus with a beta prior fitted to the hosts themselves, and hosts whose shrunk rate is too high are rejected
with all their documents. DataFrame functions only.

Defined results: a missing text is empty (no words, so it fails); documents without a host form one host of their own; a
host is judged only from the rows given; repeated rows count each; an empty table gives an empty result; columns other
than the three named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import SPACE, attach, let, materialise, packed, whole_text

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A host is rejected when its shrunk failure rate exceeds `host_rate`."""

    min_words: int = 10
    repeated_percent: int = 20
    symbol_percent: int = 10
    line_percent: int = 50
    host_rate: float = 0.6


def _covered(words: Column) -> Column:
    """How many words stand in a window of five that the text has at least twice.

    Windows are compared by a 64-bit hash within one text. Only texts with a repeated window are sorted; equal neighbours
    then give the starts of repeated windows, and the gaps between starts give the words without counting one twice.
    """
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = lambda w: F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    same = lambda s, x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])

    def repeated(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(s, x, k), F.lit(False))), lambda x: x["i"])))
        gaps = let(found, lambda p: F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    counted = let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(0))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0).cast("long")


def measured(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: its measurements, `base_failed`, `soft_failed` (any rule) and `host_key`."""
    body = whole_text(text)
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host_key"), body.alias("t"))
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _covered(w).alias("n_repeat_words"),
        ),
    )
    line_facts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    frame = frame.select("doc_id", "host_key", F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), facts.alias("w"), line_facts.alias("l"))
    frame = frame.select("doc_id", "host_key", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeated_percent * F.col("n_words"))
    soft = base | (100 * F.col("n_symbols") > rules.symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > rules.line_percent * F.col("n_lines"))
    return frame.withColumn("base_failed", base).withColumn("soft_failed", soft)


def host_verdicts(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per host: documents, failures, the shrunk failure rate and the verdict.

    The prior's mean is the corpus rate; its strength comes from the variance between hosts beyond what binomial sampling
    explains. Only one row of sums reaches the driver.
    """
    hosts = rows.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("soft_failed").cast("long")).alias("host_failed"))
    n, f = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("q"), F.count(F.lit(1)).alias("k")).first()
    a, b = beta_prior(total["n"] or 0, total["f"] or 0, float(total["q"] or 0.0), total["k"] or 0)
    rate = (f + F.lit(a)) / (n + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > rules.host_rate)


def beta_prior(n: int, f: int, q: float, k: int) -> tuple[float, float]:
    """Method of moments. n documents, f failures, q = sum of f_h**2 / n_h and k = number of hosts.

    Strength = mean * (1 - mean) / (variance between hosts) - 1, kept between 2 and 10,000.
    """
    if n == 0:
        return 1.0, 1.0
    mean = f / n
    spread = mean * (1 - mean)
    between = max(0.0, (q / n - mean * mean) - spread * k / n)
    strength = min(10_000.0, max(2.0, spread / between - 1)) if between > 0 else 10_000.0
    return mean * strength, (1 - mean) * strength


def host_quality(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measurements of every document with the verdict of its host and `kept`."""
    rows = materialise(measured(docs, rules, doc_id, text, host))
    judged = attach(rows, host_verdicts(rows, rules), "host_key", "host_docs")
    return judged.withColumn("kept", ~(F.col("base_failed") | F.coalesce(F.col("host_rejected"), F.lit(False))))


def keep_good(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with the columns they came with.

    The small measurements are written once for the host sums; the texts are not: their own rule is evaluated again
    beside them, and only the list of rejected hosts is joined.
    """
    rows = materialise(measured(docs, rules, doc_id, text, host).select("host_key", "soft_failed"))
    verdicts = host_verdicts(rows, rules).where("host_rejected").select("host_key", "host_docs")
    own = docs.select(packed(docs).alias("row"), F.col(doc_id).alias(doc_id), F.col(text).alias(text), F.col(host).alias(host))
    own = own.select("row", F.struct(doc_id, text, host).alias("r"))
    flagged = _flag(own, rules, doc_id, text, host)
    return attach(flagged, verdicts, "host_key", "host_docs").where("host_docs is null").select("row.*")


def _flag(own: DataFrame, rules: Rules, doc_id: str, text: str, host: str) -> DataFrame:
    body = F.coalesce(F.col("r")[text].cast("string"), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    good = let(words, lambda w: (F.size(w) >= rules.min_words) & (100 * _covered(w) <= rules.repeated_percent * F.size(w)))
    key = F.coalesce(F.concat(F.lit("="), F.col("r")[host].cast("string")), F.lit(""))
    return own.where(good).select("row", key.alias("host_key"))
