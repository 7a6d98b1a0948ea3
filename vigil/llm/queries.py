"""One registered query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import chat, jaccard, lattice, licences, mixing, packing, pii, quality, recompression, simhash, spelling, topk, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: No other stage's Python workers share the executors with this query, so it may keep more words.
PACKING_CACHE_WORDS = 700_000

#: Turn with the template's own control strings.
CONTROL = "\\### Assistant: </turn> ok"

REPEATS_ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
         FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM wins GROUP BY h),
gone AS (SELECT r, list(p) AS places FROM wins JOIN firsts USING (h) WHERE first < doc_id GROUP BY r),
covered AS (SELECT r, list_distinct(flatten([range(p, p + 50) FOR p IN places])) AS places FROM gone),
kept AS (
  SELECT d.r, d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN w ELSE [w[i] FOR i IN list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)))] END AS k
  FROM docs d LEFT JOIN covered c USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

TOPK_ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.v, d.v)])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


SIMILAR_ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct([array_to_string(w[p:p + 2], ' ') FOR p IN range(1, len(w) - 1)]) END AS s
  FROM docs),
classes AS (SELECT s, min(r) AS node, len(s) AS n FROM sets GROUP BY s),
grams AS (SELECT node, n, unnest(s) AS g FROM classes),
met AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS shared
        FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * shared >= 90 * (na + nb - shared)),
walk AS (
  SELECT node AS a, node AS b FROM classes WHERE n > 0
  UNION
  SELECT walk.a, l.b FROM walk JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = walk.b),
members AS (SELECT c.node, s.doc_id FROM classes c JOIN sets s USING (s)),
least AS (SELECT walk.a AS node, min(m.doc_id) AS component_id FROM walk JOIN members m ON m.node = walk.b GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE l.component_id END AS component_id
FROM sets s JOIN classes c USING (s) LEFT JOIN least l ON l.node = c.node
"""


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = packing.VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_substring_dedup", REPEATS_ORACLE)
def op1(spark, sf_dir):
    cut = recompression.repeats(table(spark, sf_dir, "documents"))
    kept = F.when(F.col("n_removed") == 0, F.lower(F.hex("digest"))).otherwise(
        F.sha2(F.coalesce("kept", F.lit("")), 256))
    return cut.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


@query("op2_quality_rules")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.BASE, "base_failed", "kept")


@query("op3_lattice_scores")
def op3(spark, sf_dir):
    return lattice.score(table(spark, sf_dir, "documents"), tokenizer_file(lattice.VOCABULARY)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_packing")
def op4(spark, sf_dir):
    parts = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_file(), cache_words=PACKING_CACHE_WORDS)
    digests = packing.stored(parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.pack(digests).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op5_chat_windows", chat.ORACLE)
def op5(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)],
                                    "conv_id bigint, turn bigint, role string, text string")
    read = chat.read_back(chat.windows(said.unionByName(control)))
    return read.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("turns", 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long").alias("formatted_chars"))


@query("op6_personal_data")
def op6(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.counted(found["base"], kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed(found["base"]), 256).alias("base_sha256"), pii.listed(found["spans"]).alias("spans"))


@query("op7_simhash")
def op7(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(found["bits"]).alias("fingerprint"), "component_id")


@query("op8_licences", licences.oracle())
def op8(spark, sf_dir):
    return licences.recognise(table(spark, sf_dir, "documents"))


@query("op9_exact_topk", TOPK_ORACLE)
def op9(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_mixing", mixing.ORACLE)
def op10(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    whole = F.when(F.col("deviation") < F.lit(Decimal(1 << 63)), F.col("deviation")).otherwise(
        F.raise_error(F.lit("a deviation does not fit in a long")).cast("decimal(38,0)"))
    return white.withColumn("deviation", whole.cast("long"))


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_ngram_join", SIMILAR_ORACLE)
def op13(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
