"""Secret scan with multipart credential linking.

Three kinds of strong findings stand for themselves: `assign` (a key word, a separator and a value), `access` (an access
identifier) and `hex` (a long run of hexadecimal digits). Two kinds of weak candidates, `value` (a bare 40-character
mixed token) and `endpoint` (a URL), are reported only where their complement lies in the same scope: a value near an
access identifier, an endpoint near an access identifier or an assigned secret. A scope is `scope` code points to
either side, counted from start to start, within one document.

Candidates and complements meet in an interval join: complements are folded per (document, bin of `scope` code points) to
their first and last start before the join, so a candidate meets at most three rows per kind and no pairs are listed.
DataFrame functions only; one scan of the texts.

Defined results: a missing or empty text has no findings; rows that repeat are scanned each (they are told apart by a row
number of the written scan, not by doc_id, which may be missing); spans count code points, end exclusive; texts of any
length are scanned whole; an empty table gives an empty result; other columns are not read and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import materialise, packed, whole_text

KINDS = ("assign", "access", "hex", "value", "endpoint")
SCOPE = 300
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: An identifier ends where its characters end, and so does a run of digits; a shorter one therefore never hides a longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"https?://[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]*)?"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, value_length: int = 0) -> Column:
    """Leftmost non-overlapping matches. Each match is found with the text before it, from where the last one ended, so
    running sums of lengths place it; a failing rest of the text is read once."""
    found = rf"\G([\s\S]*?)({pattern})"
    pieces = [F.regexp_extract_all(text, F.lit(found), F.lit(g)) for g in ((1, 2, 3) if value_length else (1, 2))]
    lengths = F.transform(F.arrays_zip(*pieces), lambda p: F.struct(*[F.length(p[str(i)]).cast("long").alias(n) for i, n in enumerate("gmv"[: len(pieces)])]))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["m"]).alias("end")))
        good = (x["v"] >= value_length) if value_length else F.lit(True)
        return F.struct((start + x["m"]).alias("at"), F.when(good, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    some = F.aggregate(lengths, zero, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(SPAN))


def scanned(text: Column) -> dict[str, Column]:
    """`base` and `weak` spans of a text, each sorted by start and kind."""
    base = [_spans(text, ASSIGN, 0, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2)]
    weak = [_spans(text, VALUE, 3), _spans(text, ENDPOINT, 4)]
    return {"base": F.sort_array(F.concat(*base)), "weak": F.sort_array(F.concat(*weak))}


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row number the weak spans with a complement in scope. `parts` has `row, base, weak`."""
    asked = parts.where("size(weak) > 0 and size(base) > 0")
    span = lambda name: asked.select("row", F.explode(name).alias("s")).select("row", "s.start", "s.kind", "s.end")
    strong = span("base").where("kind < 2")  # runs of digits complete nothing
    bins = strong.groupBy("row", F.floor(F.col("start") / scope).alias("bin"), F.col("kind").alias("other")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = span("weak").withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("start") / scope) + d)))
    own = F.floor(F.col("start") / scope)
    near = (
        ((F.col("bin") == own) | ((F.col("bin") < own) & (F.col("last") >= F.col("start") - scope)) | ((F.col("bin") > own) & (F.col("first") <= F.col("start") + scope)))
        & ((F.col("kind") == 4) | (F.col("other") == 1))
    )
    found = weak.join(bins, ["row", "bin"]).where(near)
    return found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("links"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """`doc_id, base, links`: spans (start, kind as an index of KINDS, end) sorted by start and kind."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("t"))
    found = scanned(F.col("t"))
    parts = materialise(rows.select("doc_id", found["base"].alias("base"), found["weak"].alias("weak")).withColumn("row", F.monotonically_increasing_id()))
    out = parts.join(linked(parts, scope), "row", "left")
    return out.select("doc_id", "base", F.coalesce("links", F.array().cast(SPAN)).alias("links"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """The documents with every strong or linked span of the text replaced by [kind]; texts without findings are untouched.

    Weak parts are linked inside the row here, by the same rule as `linked`, so the texts need no shuffle.
    """
    rows = docs.select(packed(docs).alias("row"), whole_text(text).alias("t"))
    found = scanned(F.col("t"))
    rows = rows.select("row", "t", found["base"].alias("base"), found["weak"].alias("weak"))
    close = lambda s: F.exists("base", lambda b: (b["kind"] < 2) & (F.abs(b["start"] - s["start"]) <= scope) & ((s["kind"] == 4) | (b["kind"] == 1)))
    spans = F.when(F.size("weak") == 0, F.col("base")).otherwise(F.sort_array(F.concat(F.col("base"), F.filter("weak", close))))
    rows = rows.select("row", "t", spans.alias("spans"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("t"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        tag = F.element_at(names, s["kind"] + 1)
        inside = s["start"] < acc["at"]  # overlaps the span before it: only its rest goes, under the tag already set
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(before, tag))).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("t"), (acc["at"] + 1).cast("int"), F.length("t"))))
    return rows.select(F.when(F.size("spans") > 0, clean).otherwise(F.col("row")[text]).alias("clean"), "row").select(
        *[F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    )
