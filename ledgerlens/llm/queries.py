"""The operators of this package as queries over the benchmark tables, with the same question in SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import conversation_trie, host_rules, jaccard_join, minhash_dedup, mixing, packing, permutation_index, ranked_search, repeated_text, secret_links, token_counts, toxicity, warc
from ledgerlens.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


_QUOTED = {k: v.replace("'", "''") for k, v in {"assign": secret_links.ASSIGN, "access": secret_links.ACCESS, "hex": secret_links.HEX, "endpoint": secret_links.ENDPOINT}.items()}
_MIXED = "regexp_matches(m, '^[A-Za-z0-9+/]{40}$') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"
_NAMES = "['assign','access','hex','value','endpoint']"


def _raw(name: str, pattern: str, kind: int, kept: str = "true", value: bool = False) -> str:
    """SQL for the leftmost non-overlapping matches of a pattern with their places: each is taken with the text before it."""
    found = f"'(?s)(.*?)({pattern})'"
    third = f"regexp_extract_all(t, {found}, 3)" if value else f"regexp_extract_all(t, {found}, 2)"
    return f"""{name} AS (
  SELECT r, place - length(m) AS s, {kind} AS kind, place AS e FROM (
    SELECT r, m, v, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS place
    FROM (SELECT r, unnest(regexp_extract_all(t, {found}, 1)) AS g, unnest(regexp_extract_all(t, {found}, 2)) AS m,
                 unnest({third}) AS v, generate_subscripts(regexp_extract_all(t, {found}, 2), 1) AS i FROM d)
  ) WHERE {kept})"""


@query(
    "op2_secret_links",
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_raw("a", _QUOTED["assign"], 0, "length(v) >= 6", True)},
{_raw("b", _QUOTED["access"], 1)},
{_raw("c", _QUOTED["hex"], 2)},
{_raw("v", "[A-Za-z0-9+/=_-]{40,}", 3, _MIXED)},
{_raw("u", _QUOTED["endpoint"], 4)},
base AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
weak AS (SELECT * FROM v UNION ALL SELECT * FROM u),
links AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM base x WHERE x.r = w.r AND x.kind < 2 AND abs(x.s - w.s) <= {secret_links.SCOPE}
                                             AND (w.kind = 4 OR x.kind = 1))),
spelled AS (SELECT r, kind, s, {_NAMES}[kind + 1] || ':' || s || ':' || e AS p, kind < 3 AS strong FROM (SELECT * FROM base UNION ALL SELECT * FROM links)),
per AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               string_agg(p, ',' ORDER BY s, kind) FILTER (strong) AS base_spans, string_agg(p, ',' ORDER BY s, kind) AS spans,
               count(*) FILTER (NOT strong) AS n_linked FROM spelled GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN per USING (r)""",
)
def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: strong spans, and weak ones whose complement lies in the same scope."""
    found = secret_links.find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secret_links.spelled(F.col("base")), 256).alias("base_sha256"),
        secret_links.spelled(F.sort_array(F.concat("base", "links"))).alias("spans"),
        F.size("links").cast("long").alias("n_linked"),
    )


@query(
    "op7_mix",
    rf"""WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER w AS k, 2 * (sum(source_size) OVER w - source_size) AS held, sum(weight) OVER () - sum(weight) OVER w + weight AS open,
             sum(source_size) OVER () AS total FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT (150 * total - 100 * held)::HUGEINT AS num, (100 * open)::HUGEINT AS den FROM o
          WHERE weight * (150 * total - 100 * held) <= 2 * source_size * 100 * open ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN num IS NULL OR weight * num > 2 * source_size * den THEN (2 * source_size)::DOUBLE
             ELSE (weight * num)::DOUBLE / den::DOUBLE END AS target FROM s LEFT JOIN level ON true),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS rate,
             ('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', md5(concat_ws(':', doc_id, text)))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
)
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_R = host_rules.Rules()


@query(
    "op8_host_rules",
    rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host_key, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT r, i, ws[i:i + 4] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
q AS (SELECT r, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n FROM p GROUP BY r),
m AS (SELECT r, doc_id, host_key, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words FROM w LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.repeated_percent} * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > {_R.symbol_percent} * word_chars OR 100 * n_dup_lines > {_R.line_percent} * n_lines AS soft_failed FROM b),
h AS (SELECT host_key, count(*) AS host_docs, sum(soft_failed::INT)::BIGINT AS host_failed FROM f GROUP BY host_key),
z AS (SELECT sum(host_failed)::DOUBLE / sum(host_docs) AS mean, sum(host_docs)::DOUBLE AS n, sum(host_failed * host_failed / host_docs::DOUBLE) AS q, count(*) AS k FROM h),
y AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(10000, greatest(2, mean * (1 - mean) / between_hosts - 1)) ELSE 10000 END AS strength
      FROM (SELECT *, (q / n - mean * mean) - mean * (1 - mean) * k / n AS between_hosts FROM z)),
v AS (SELECT host_key, host_docs, host_failed, (host_failed + mean * strength) / (host_docs + strength) > {_R.host_rate} AS host_rejected FROM h, y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR host_rejected) AS kept, host_docs, host_failed
FROM f JOIN v USING (host_key)""",
)
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document; a document's host is its source."""
    judged = host_rules.host_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed")


@query("op3_pack")
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query(
    "op9_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((strpos('0123456789abcdef', substr(x, (5 * i) // 4 + 1, 1)) - 1) * 16
         + strpos('0123456789abcdef', substr(x || '0', (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""",
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives."""
    rows = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    lexicon = toxicity.learn(docs, labels, rest != 0)
    return toxicity.score_documents(docs, lexicon).select("doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_permutation_index")
def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(
    "op5_repeated_text",
    r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT r, doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
c AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE doc_id > first),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM c),
n AS (SELECT r, sum(least(50, coalesce(i - before, 50)))::BIGINT AS n_removed, count(*) FILTER (before IS NULL OR i - before > 50) AS n_spans FROM g GROUP BY r),
e AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
s AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM e GROUP BY r, run),
k AS (SELECT r, string_agg(substr(x, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS kept FROM (
        SELECT d.r, x, coalesce(lag(b) OVER (PARTITION BY d.r ORDER BY a), 0) AS p, a AS q FROM d JOIN s USING (r)
        UNION ALL SELECT d.r, x, max(b), length(x) // 2 FROM d JOIN s USING (r) GROUP BY d.r, x) GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN x ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)""",
)
def op5_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that a document with a smaller id has too."""
    found = repeated_text.without_repeats(table(spark, sf_dir, "documents"), kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    "op6_jaccard_join",
    r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE [w[i:i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN c USING (r)""",
)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document, linked at a Jaccard similarity of 0.9 over three words."""
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op13_ranked_search",
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM documents),
a AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, a GROUP BY term, docs),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * docs) // total AS m FROM d, a WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW}, '{_TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


#: CRC-32 of the ASCII text of c: bit by bit, from the fixed reversed polynomial 0xEDB88320.
_CRC = """list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')],
  lambda s, b: list_reduce([xor(s, b)] || [0::BIGINT FOR i IN range(8)], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)) + z))"""


@query(
    "op11_conversation_trie",
    rf"""WITH t AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                  ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, own, c - c % 20 AS base, (xor({_CRC}, 4294967295) % 4)::INT AS h FROM t),
r AS (SELECT h.c, list_concat(coalesce(b.own[:h], []), h.own[h + 1:]) AS s FROM h LEFT JOIN t b ON b.c = h.base),
m AS (SELECT c, d, len(s) AS n, s[:d] AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
v AS MATERIALIZED (SELECT p, d, count(*) AS n_convs, min(c) AS conv_id, max(n) AS deepest, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends,
             CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^ 	-
]+')) END AS words FROM m GROUP BY p, d),
u AS (SELECT p[:k] AS p, k AS d, sum((n_convs - 1) * words)::BIGINT AS saved_tokens, count(*) FILTER (deepest = d) AS n_leaves, count(*) FILTER (d = k + 1) AS n_children
      FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, w.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN u ON u.p = v.p AND u.d = v.d LEFT JOIN v w ON w.d = v.d - 1 AND w.p = v.p[:v.d - 1]""",
)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query(
    "op12_minhash_dedup",
    r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w] ELSE [w[i:i + 1] FOR i IN range(1, len(w))] END) AS g FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d LEFT JOIN n USING (r) JOIN c USING (r)""",
)
def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and verdict of every document, linked at a Jaccard similarity of 0.8 over two words."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
