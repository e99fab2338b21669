"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (chat, exact_dedup, filter_audit, jaccard_join, language, merkle, mixing, near_dedup, packing, secret_scan,
                          token_counts, toxicity, vector_codes)

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", held_out(), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_exact_dedup", """
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
      SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(body) AS text_sha256
      FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents) WINDOW w AS (PARTITION BY body))""")
def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    decided = exact_dedup.decide(table(spark, sf, "documents"))
    return decided.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", "kept",
                          F.col("sha").alias("text_sha256"))


@query("op3_mix_sources")
def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf, "documents"))


@query("op4_pack_sequences")
def op4_pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


@query("op10_bag_minhash")
def op10_bag_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf, "documents")).drop("row")


@query("op6_merkle_fingerprints")
def op6_merkle_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf, "documents"))


@query("op7_language_codes")
def op7_language_codes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", held_out(), "lang_pred", "score", "ambiguous")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op8_chat_format")
def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, i, r, CONTROL_TEXT) for i, r in enumerate(("user", "assistant"))], rows.schema)
    return chat.digests(chat.segments(chat.text_parts(rows.unionByName(own))))


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents"))


_WORDS = r"'[^\x20\x09-\x0D]+'"


@query("op11_jaccard_join", rf"""
    WITH RECURSIVE cut AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w
      FROM documents),
    runs AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
             list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM cut),
    postings AS (SELECT doc_id, len(s) AS n, unnest(s) AS run FROM runs),
    links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM postings a JOIN postings b ON a.run = b.run AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    reach AS (
      SELECT doc_id AS a, doc_id AS b FROM runs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM runs
    JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""")
def op11_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard_join.join(table(spark, sf, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op12_filter_audit", rf"""
    WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
    failed AS (
      SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS tox,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
              regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f
      FROM words LEFT JOIN labels USING (doc_id)),
    counts AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (tox) AS x FROM failed GROUP BY part, f),
    one AS (SELECT unnest(range(1, 6)) AS k),
    orders AS (
      SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM one a, one b, one c, one d, one e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
    steps AS (SELECT o, k AS step, o[k] AS own, o[1:k - 1] AS before FROM orders, one),
    walked AS (
      SELECT part, o, step, own, n, g, x, f[own] AS fails, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda v: v)) AS many
      FROM steps, counts),
    rows_ AS (
      SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND many = 1), 0) AS unique_fails,
             coalesce(sum(g) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (fails AND NOT gone), 0) AS toxic_lost
      FROM walked GROUP BY part, o, step, own)
    SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INT) AS step,
           CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM rows_""")
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def _codebook_sql(rounds: int) -> str:
    """Every round as a pair of CTEs: nearest entries, then the floors of their means."""
    near = """near{i} AS (
      SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM (
        SELECT x.r, x.p, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d
        FROM parts x JOIN book{i} b ON x.p = b.p) GROUP BY r, p)"""
    move = """book{j} AS (
      SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
        SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS v FROM (
          SELECT p, e, k, CAST(sum(v[k]) AS BIGINT) AS s, count(*) AS n FROM (
            SELECT p, e, v, unnest(range(1, len(v) + 1)) AS k FROM near{i} JOIN parts USING (r, p)) GROUP BY p, e, k) GROUP BY p, e) m
      ON b.p = m.p AND b.e = m.e)"""
    chain = [t.format(i=i, j=i + 1) for i in range(rounds) for t in (near, move)]
    return f"""
    WITH whole AS (
      SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (
      SELECT r, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS v FROM whole, (SELECT unnest(range(4)) AS p)),
    book0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 256),
    {", ".join([*chain, near.format(i=rounds)])},
    coded AS (
      SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
    digest AS (
      SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN whole USING (r), digest"""


@query("op13_vector_codes", _codebook_sql(vector_codes.ROUNDS))
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
