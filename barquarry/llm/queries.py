"""The queries of this subpackage: thin uses of its operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.llm import exact_dedup, html_extraction, language_id, near_dedup, packing, sentencepiece_fst, substring_dedup, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select(F.col("row.doc_id").alias("doc_id"), language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.substring_dedup(docs, with_text=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled categories: low quality first, then toxic, which sees the odds of the first."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train(docs, labels, ["low_quality", "toxic"])
    return toxicity.predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    fst = sentencepiece_fst.Transducer(vocabulary("piece_bpe_32k.model"))
    return sentencepiece_fst.encode_documents(_read(spark, sf_dir, "documents"), fst)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_html_extraction, op4_best_fit_packing, op5_exact_dedup, op6_toxicity, op7_sentencepiece, op8_warc, op9_topk, op10_near_dedup)}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 20 THEN range(1, len(w) - 18) ELSE [] END) AS s FROM d),
g AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1 AS again FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE again),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256 FROM k
""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS lead FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> lead THEN lead END AS refers_to FROM g
""",
    "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op10_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d)),
n AS (SELECT doc_id, count(g) AS n FROM s GROUP BY doc_id),
t AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM t JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(doc_id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.doc_id WHERE c.low < e.b)
SELECT n.doc_id, n.n AS n_shingles, m.low AS component_id, n.doc_id = m.low AS kept
FROM n JOIN (SELECT doc_id, min(low) AS low FROM c GROUP BY doc_id) m USING (doc_id)
""",
}
