"""One query for each operator, over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.llm import bpe, bytebpe, codes, divergence, jaccard, language, licenses, lm, media, mixing, pii, preference, topk
from barquet.session import table

#: Stands for the secret that a deployment keeps outside the code.
PII_KEY = "replace-me"
MIX_SEED = 20240607


def fold(doc_id: str, n: int):
    """crc32 of the id as text modulo n; null ids have none."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantized(F.col("embedding")).alias("vector"))
    return topk.top_k(rows.where(F.col("id") % 20 == 0), rows, k=20)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold("doc_id", 3) != 1))
    out = language.identify(docs, model, keep=["doc_id"])
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = preference.gather(table(spark, sf_dir, "conversations"), "conv_id")
    out = preference.format_pairs(preference.swap_last_answers(whole, "conv_id"))
    digest = lambda m: F.array_join(F.transform(m, lambda r: F.concat_ws(":", r["n_chars"].cast("string"), r["train"].cast("int").cast("string"))), ",")
    return out.withColumns({m: digest(F.col(m)) for m in ("chosen_mask", "rejected_mask")})


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.shares(docs, seed=MIX_SEED).select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.features(media.store(docs)).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("train"))
    return lm.score(docs, keep=["doc_id", "held_out"])


def tokenizer() -> str:
    """The tokenizer that the query and the pipeline encode with."""
    import public_tokenizers

    return bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer(), keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def byte_tokenizer() -> bytebpe.Ranks:
    import public_tokenizers

    return bytebpe.Ranks.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytebpe.encode(docs, byte_tokenizer(), keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_pii": op2_pii,
    "op3_jaccard": op3_jaccard,
    "op4_language": op4_language,
    "op5_preference": op5_preference,
    "op6_mix": op6_mix,
    "op7_media": op7_media,
    "op8_lm": op8_lm,
    "op9_licenses": op9_licenses,
    "op10_bpe": op10_bpe,
    "op11_divergence": op11_divergence,
    "op12_codes": op12_codes,
    "op13_bytebpe": op13_bytebpe,
}

def _codes_sql() -> str:
    """The rounds one after the other; an entry is a list of whole numbers."""
    assigned = """
a{k} AS MATERIALIZED (
  SELECT id, part, any_value(x) AS x, min(row(d, entry)) AS best FROM (
    SELECT p.id, p.part, p.x, b.entry, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT AS d FROM p JOIN b{k} b ON b.part = p.part)
  GROUP BY id, part)"""
    moved = """
m{k} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
    SELECT part, entry, i, sum(z)::BIGINT AS s, count(*) AS n FROM (
      SELECT part, best[2] AS entry, unnest(x) AS z, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL)
  GROUP BY part, entry),
b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""
    rounds = ",".join(assigned.format(k=k) + "," + moved.format(k=k, n=k + 1) for k in range(codes.ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label, [floor({codes.SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT id, k AS part, v[k * len(v) // {codes.PARTS} + 1:(k + 1) * len(v) // {codes.PARTS}] AS x FROM v, (SELECT unnest(range({codes.PARTS})) AS k)),
f AS (SELECT id, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM v WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT {codes.ENTRIES}),
b0 AS MATERIALIZED (SELECT p.part, f.entry, p.x AS c FROM f JOIN p ON p.id = f.id),{rounds},{assigned.format(k=codes.ROUNDS)},
t AS (SELECT id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS told FROM b{codes.ROUNDS})
SELECT v.vec_id, t.code, t.error, (sum(t.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, h.told AS codebooks_sha256 FROM v JOIN t ON t.id = v.id, h
"""


ORACLE_SQL = {
    "op11_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.LEAST_DOCUMENTS}),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
n AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n, v.v FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS MATERIALIZED (
  SELECT *, (1 + {divergence.SCALE}::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v))::BIGINT AS p,
         sum(n) OVER (PARTITION BY lang, term) AS m, sum(n) OVER (PARTITION BY lang) AS l FROM c),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - (1 + {divergence.SCALE}::HUGEINT * (m + 5) // (l + 5 * v)))::BIGINT AS value FROM p WHERE n > 0),
r AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term WHERE value > 0)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {divergence.MOST_TERMS}
""",
    "op12_codes": _codes_sql(),
    "op1_topk": r"""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op5_preference": r"""
WITH conv AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
last AS (
  SELECT conv_id, turns,
         coalesce(list_max([i FOR i IN range(1, len(turns) + 1) IF turns[i].role = 'assistant']), len(turns) + 1) AS last_at
  FROM conv),
pair AS (
  SELECT a.conv_id, a.turns AS c,
         list_concat(a.turns[1:a.last_at - 1], CASE WHEN b.last_at <= len(b.turns) THEN b.turns[b.last_at:b.last_at] ELSE a.turns[1:0] END) AS r
  FROM last a LEFT JOIN last b ON xor(a.conv_id, 1) = b.conv_id),
cut AS (
  SELECT conv_id, c, r,
         coalesce(list_min([i FOR i IN range(1, least(len(c), len(r)) + 1)
                            IF c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text]) - 1, least(len(c), len(r))) AS n
  FROM pair)
SELECT conv_id, n::INTEGER AS n_common,
  coalesce(list_aggregate([concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN c[1:n]], 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate([concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN c[n + 1:len(c)]], 'string_agg', ''), '') AS chosen,
  coalesce(list_aggregate([concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN r[n + 1:len(r)]], 'string_agg', ''), '') AS rejected,
  coalesce(list_aggregate([concat(length(coalesce(t.role, '')) + 5, ':0,', length(coalesce(t.text, '')) + 8, ':',
           CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END) FOR t IN c[n + 1:len(c)]], 'string_agg', ','), '') AS chosen_mask,
  coalesce(list_aggregate([concat(length(coalesce(t.role, '')) + 5, ':0,', length(coalesce(t.text, '')) + 8, ':',
           CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END) FOR t IN r[n + 1:len(r)]], 'string_agg', ','), '') AS rejected_mask
FROM cut
""",
    "op6_mix": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(text, '')), 1, 16) AS h FROM documents),
n AS (SELECT greatest(1, ceil(count(*) / {mixing.CELL_ROWS}.0))::BIGINT AS salts FROM (SELECT DISTINCT doc_id, source, h FROM d)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER f AS nth,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(source_size * 2) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s WINDOW f AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         CASE WHEN level * w >= source_size * 2 THEN (source_size * 2)::DOUBLE
              ELSE first_level * w END AS target
  FROM (SELECT *, arg_min(level, nth) FILTER (level * w < source_size * 2) OVER () AS first_level FROM l)),
r AS (
  SELECT d.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(size + 1.0::DOUBLE) * 4), ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT % n.salts, size, h, doc_id NULLS FIRST) AS nth,
         ('0x' || substr(md5('{MIX_SEED}|' || coalesce(d.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296 AS o,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM n, d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(o + nth * rate) - floor(o + (nth - 1) * rate))::BIGINT * size)::BIGINT AS taken FROM r
""",
}
