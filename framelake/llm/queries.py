"""The corpus operators' queries over the driver's tables, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import capfilters, divergence, langid_crf, licenses, mixing, paragraphs, pseudolm, resampling, shards, simhash, tokencounts, wand, winnowing


def op1_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned without the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid_crf.labelled(docs.select("doc_id", "text"), langid_crf.fit(docs))
    return found.select("doc_id", langid_crf.held_out().alias("held_out"), "lang_pred", "score")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; slot is a row's place in its shard."""
    placed = shards.shard_places(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = winnowing.decontaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and Gumbel top-k choice of every document, all weighed at one length."""
    return resampling.resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), per_gram=True)


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links of every vector within its label."""
    return capfilters.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 15 words or more of all documents that stand elsewhere too; shorter ones are set phrases."""
    return paragraphs.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), least_words=15)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    taken = mixing.copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return pseudolm.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    groups = simhash.simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    found = licenses.scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array_sort(F.array_union("base_labels", "template_labels"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the others, and by which terms from its language."""
    return divergence.source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return wand.searched(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The tokens of every document."""
    import public_tokenizers

    return tokencounts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(tokenizer))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(md5(text), '') AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
x AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM w),
f AS (SELECT *, cap / weight AS full_at FROM x),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
    row_number() OVER (ORDER BY full_at, place) AS n FROM f),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, n) FROM l WHERE level <= full_at) * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('7|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || digest), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

#: Texts in lower case (A-Z) as lists of words, rows numbered; null has none.
WORDS_SQL = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[])"""
NEXT_SQL = ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 10))

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT r, item, least(len(w), 10) AS k, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM b),
bg AS (SELECT item, k, n, pos, [word, {NEXT_SQL}] AS next FROM bw WINDOW o AS (PARTITION BY r ORDER BY pos)),
g AS (SELECT DISTINCT item, k, array_to_string(next[1:k], ' ') AS gram FROM bg WHERE pos + k - 1 <= n),
dw AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
dg AS (SELECT r, n, pos, [word, {NEXT_SQL}] AS next FROM dw WINDOW o AS (PARTITION BY r ORDER BY pos)),
h AS (SELECT r, pos, g.k, item FROM (SELECT r, pos, s.k, array_to_string(next[1:s.k], ' ') AS gram FROM dg JOIN (SELECT DISTINCT k FROM g) s ON pos + s.k - 1 <= n) p JOIN g ON p.k = g.k AND p.gram = g.gram),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS place FROM (SELECT DISTINCT r, pos, k FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

TEMPLATE_SQL = ", ".join(f"({n}, '{label}', {sorted(set(text.split()))}, {licenses._stretch(len(text.split()), 0.8)})" for n, (label, text) in enumerate(licenses.TEMPLATES))

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {WORDS_SQL} AS w FROM documents),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
x AS (SELECT r, pos, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY r ORDER BY pos)),
p AS (SELECT r, pos, CASE WHEN word = 'mit' AND b = 'license' THEN 'mit' WHEN word = 'apache' AND b = 'license' THEN 'apache' WHEN word = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM x),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM p WHERE label IS NOT NULL GROUP BY r),
t AS (SELECT *, CAST(ceil(0.8 * len(wording) - 1e-9) AS BIGINT) AS need FROM (VALUES {TEMPLATE_SQL}) v(n, label, wording, stretch)),
ls AS (SELECT r, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
lw AS (SELECT r, line, {WORDS_SQL} AS w FROM ls),
lines AS (SELECT r, label, len(list_intersect(list_distinct(w), wording)) AS common, len(wording) AS size FROM lw JOIN t ON len(list_distinct(w)) >= need AND len(list_intersect(list_distinct(w), wording)) >= need),
lp AS (SELECT *, line - row_number() OVER (PARTITION BY r ORDER BY line) AS part FROM lw WHERE len(w) > 0),
pw AS (SELECT r, line, part, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lp),
aw AS (SELECT r, part, word, row_number() OVER (PARTITION BY r ORDER BY line, i) AS place FROM pw),
tw AS (SELECT n, label, unnest(wording) AS word, len(wording) AS size, need, stretch FROM t),
tm AS (SELECT * FROM aw JOIN tw USING (word)),
ok AS (SELECT r, n FROM tm GROUP BY r, n HAVING count(DISTINCT word) >= any_value(need)),
own AS (SELECT * FROM tm SEMI JOIN ok USING (r, n)),
spans AS (SELECT a.r, a.label, count(DISTINCT b.word) AS common, any_value(a.size) AS size FROM own a JOIN own b ON a.r = b.r AND a.n = b.n AND a.part = b.part AND b.place >= a.place AND b.place < a.place + a.stretch GROUP BY a.r, a.n, a.label, a.place HAVING count(DISTINCT b.word) >= any_value(a.need)),
f AS (SELECT * FROM lines UNION ALL SELECT * FROM spans),
best AS (SELECT r, list(DISTINCT label) AS labels, max(common / size) AS best FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 array_to_string(list_sort(coalesce(base.labels, []::VARCHAR[])), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []::VARCHAR[]), coalesce(best.labels, []::VARCHAR[])))), ',') AS labels,
 CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(s.n, 0) + 2 * v.v AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // g.total AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
t AS (SELECT r, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
a AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM t),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY r, term),
h AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM f GROUP BY term), a),
q AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {WORDS_SQL} AS w FROM benchmark)),
s AS (SELECT i, item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // length)))) AS BIGINT) AS score FROM q JOIN h USING (term) JOIN f USING (term) JOIN t USING (r), a GROUP BY i, item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_crf, op2_virtual_slots, op3_winnowing, op4_importance, op5_cap_filters, op6_paragraphs, op7_source_mix, op8_pseudo_lm, op9_simhash, op10_license_join, op11_divergence, op12_wand, op13_token_counts)}
ORACLE_SQL: dict[str, str] = {"op3_winnowing": OP3_SQL, "op7_source_mix": OP7_SQL, "op10_license_join": OP10_SQL, "op11_divergence": OP11_SQL, "op12_wand": OP12_SQL}
