"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.decontamination import contaminated
from timeloom.llm.embedding_dedup import embedding_dedup
from timeloom.llm.fingerprints import document_fingerprints
from timeloom.llm.hard_negatives import hard_negatives
from timeloom.llm.html_text import html_text
from timeloom.llm.language_id import language_id
from timeloom.llm.ngram_join import ngram_join
from timeloom.llm.ngram_lm import lm_scores
from timeloom.llm.packing import pack
from timeloom.llm.resampling import resample
from timeloom.llm.suffix_dedup import suffix_dedup
from timeloom.llm.toxicity import toxicity
from timeloom.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page."""
    return language_id(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard of 0.9 or more."""
    return ngram_join(_table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, root) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT e.y, r.root FROM reach r JOIN ends e ON e.x = r.id WHERE r.root < e.y),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN roots r ON r.id = d.doc_id
"""


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return pack(_table(spark, sf_dir, "documents"), byte_bpe(), capacity=1024, end=2)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain 80 % or more of a test item's 5-word shingles."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=5, percent=80)


OP4_SQL = r"""
WITH items AS (SELECT DISTINCT item_id AS id, text FROM benchmark), docs AS (SELECT DISTINCT doc_id AS id, text FROM documents),
words AS (
  SELECT 'i' AS kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM items
  UNION ALL
  SELECT 'd', id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z_\x{80}-\x{10FFFF}]+') FROM docs),
shingles AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, z.n AS n_item, count(*) AS n_shared
FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id, z.n HAVING 100 * count(*) >= 80 * z.n
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text(_table(spark, sf_dir, "pages"))


#: the rules that op6 applies: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES, otherwise="allow")


OP6_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS k
  FROM p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: of documents whose crc32(doc_id as text) mod 5 is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    scored = toxicity(docs, learnable(_table(spark, sf_dir, "labels")), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9 or more."""
    return embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of those that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    return lm_scores(docs.where("not held_out"), docs, ["doc_id", "held_out"])


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    return suffix_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive over all rows; every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, scale=256, positives=5, negatives=10, low=30, high=90)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they and the next documents' are."""
    return document_fingerprints(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents against the benchmark's texts, and the tenth of them that is drawn."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), most=1, buckets=10_000, seed=2024, percent=10, least_words=20)


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.y, r.root FROM reach r JOIN ends e ON e.x = r.id WHERE r.root < e.y),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), counts AS (SELECT x, count(*) AS n FROM ends GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN counts ON x = vec_id LEFT JOIN roots ON id = vec_id
"""

#: bytes as two hexadecimal digits each
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, 256 * b AS since, substr(h, 512 * b + 1, 610) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 512 + 1)) AS b FROM d)),
w AS (SELECT doc_id, since + p AS p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, since, h, unnest(range(0, least(256, length(h) // 2 - 49))) AS p FROM blocks)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.s = f.s AND f.least < w.doc_id),
marked AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM gone),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY 1, 2),
cut AS (SELECT s.*, d.h, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY k), 0) AS since FROM spans s JOIN d ON d.doc_id = s.doc_id),
kept AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY k) || substr(first(h), 2 * max(b) + 1) AS left_over FROM cut GROUP BY 1)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, d.h))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""

#: CRC-32 of a word: its bytes folded over a table that is made from the polynomial
OP13_SQL = r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT 's' AS kind, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
words AS (SELECT kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM texts),
bytes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
keyed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 10000 AS k FROM bytes, crc),
counts AS (SELECT k, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM words JOIN keyed USING (w) GROUP BY 1),
sums AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM counts),
gains AS (SELECT k, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM counts, sums),
means AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM words JOIN keyed USING (w) JOIN gains USING (k) WHERE kind = 's' GROUP BY 1),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN means USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS most FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op8_embedding_near_dedup": OP8_SQL,
    "op10_suffix_array_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op6_url_filter": OP6_SQL,
}
