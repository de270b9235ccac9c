"""The registered queries of the operators: whole tables in, the digest columns of each operator out."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import centroids, decontaminate, extract, language, negatives, neighbours, rules, sentences, shards, simhash, substring, token_counts, token_store
from factloom.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 50-word passages of earlier documents."""
    return substring.removed(documents(spark, folder)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN m USING (h) WHERE least < doc_id),
e AS (SELECT doc_id, count(*) AS n, list(j) AS js FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, w, coalesce(js, []) AS js FROM d LEFT JOIN e USING (doc_id)),
x AS (SELECT doc_id, n_words, n_removed, unnest(range(1, n_words + 1)) AS j, w FROM k WHERE n_removed > 0),
t AS (SELECT x.doc_id, string_agg(x.w[x.j], ' ' ORDER BY x.j) AS s FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id)
SELECT k.doc_id, k.n_words::BIGINT AS n_words, k.n_removed::BIGINT AS n_removed,
       sha256(CASE WHEN k.n_removed = 0 THEN array_to_string(k.w, ' ') ELSE coalesce(t.s, '') END) AS kept_sha256
FROM k LEFT JOIN t USING (doc_id)
"""


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    return decontaminate.contained(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")).select(
        "doc_id", "item_id", "n_shingles", "n_found")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM k),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
s AS (SELECT DISTINCT d.doc_id, k.k, unnest(list_transform(range(1, len(d.w) - k.k + 2), lambda j: array_to_string(d.w[j:j + k.k - 1], ' '))) AS s
      FROM d, (SELECT DISTINCT k FROM k) k WHERE len(d.w) >= k.k),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM s JOIN i USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, n_found::BIGINT AS n_found FROM f JOIN n USING (item_id) WHERE 10 * n_found >= 8 * n_shingles
"""


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = documents(spark, folder)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", "lang_pred", "score", F.size("spans").alias("n_spans")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's number of pieces and best score."""
    return token_counts.count_tokens(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place and checksum in a token store written from the whole table and read back."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    store = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write(documents(spark, folder), store, tokenizer, end_id=1)
    found = token_store.read(spark, store)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's piece ids, and the checksum of the text they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = sentences.decode(sentences.encode(documents(spark, folder), model), model)
    return found.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of 40 with near-equal bytes, and its slot there."""
    found = shards.shard(documents(spark, folder))
    return found.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's statistics and the verdict of the base rules and the learned list."""
    found = rules.judge(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    return extract.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster of eight after ten rounds, its distance, and each cluster's inertia and centroid."""
    return centroids.summarised(centroids.cluster(embeddings(spark, folder), k=8, rounds=10, dims=64, scale=1024))


def _op11_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds one after the other: each assigns, then replaces centroids."""
    def far(v: str, c: str) -> str:
        return f"list_sum(list_transform(range(1, {dims + 1}), lambda j: ({v}[j] - {c}[j]) * ({v}[j] - {c}[j])))::BIGINT"

    def assigned(n: int) -> str:
        return (f"a{n} AS MATERIALIZED (SELECT r, vec_id, x, min(struct_pack(d := d, k := k)) AS m FROM "
                f"(SELECT v.r, v.vec_id, v.x, c.k, {far('v.x', 'c.c')} AS d FROM v, c{n} c) GROUP BY r, vec_id, x)")

    def moved(n: int) -> str:
        return (f"s{n} AS (SELECT k, j, (s - (((s % n) + n) % n)) // n AS f FROM (SELECT m.k AS k, j, sum(x[j])::BIGINT AS s, count(*) AS n "
                f"FROM a{n}, range(1, {dims + 1}) t(j) GROUP BY 1, 2)), "
                f"g{n} AS (SELECT k, list(f ORDER BY j) AS c FROM s{n} GROUP BY k), "
                f"c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(g{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN g{n} USING (k))")
    steps = [part for n in range(rounds) for part in (assigned(n), moved(n))] + [assigned(rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x AS c FROM v QUALIFY k < {k}),
{", ".join(steps)}
SELECT vec_id, m.k::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.k)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k"""


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """The hard negatives of every hundredth vector and its positives, some labels shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(embeddings(spark, folder).withColumn("label", shifted))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS mine, v.vec_id, v.label, list_sum(list_transform(range(1, len(a.x) + 1), lambda j: a.x[j] * v.x[j]))::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, mine, vec_id AS positive_id, score AS positive_score FROM s WHERE label = mine
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id, mine) WHERE label <> mine AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest found of every fiftieth vector, by cosine."""
    return neighbours.nearest(embeddings(spark, folder))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_benchmark_decontamination, op3_language_id, op4_token_counts, op5_token_store, op6_sentencepiece,
                                  op7_sharding, op8_simhash_near_dedup, op9_quality_rules, op10_html_extraction,
                                  op11_centroid_clustering, op12_hard_negatives, op13_nearest_neighbours)}
ORACLES = {"op1_substring_dedup": OP1_SQL, "op2_benchmark_decontamination": OP2_SQL, "op11_centroid_clustering": _op11_sql(), "op12_hard_negatives": OP12_SQL}
