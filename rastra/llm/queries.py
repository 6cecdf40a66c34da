"""The queries that apply this subpackage's operators to the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm import chat, decontaminate, hmm, ngram_join, packing, spotsigs, token_counts, toxicity, warc
from rastra.llm.common import join_hot, materialize, scratch
from rastra.llm.sharding import ShardStore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(of: int):
    """A row is held out if the CRC-32 of its doc_id's text leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == 2, F.lit(False))


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


#: The words of a text in DuckDB: runs of digits, letters and non-ASCII characters, A-Z lower-cased.
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS_SQL} AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, w[i:i + least(5, len(w)) - 1] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b, m.n = x.n AND m.n = y.n AS equal FROM met m JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * m.n >= 4 * (x.n + y.n - m.n)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), lowest AS (
  SELECT a, min(b) AS low FROM reach GROUP BY 1
), counted AS (
  SELECT a, count(*) AS n_links, min(CASE WHEN equal THEN b END) AS low FROM links GROUP BY 1
)
SELECT d.doc_id, least(d.doc_id, coalesce(r.low, d.doc_id)) AS class_id, least(d.doc_id, coalesce(c.low, d.doc_id)) AS copy_id, coalesce(c.n_links, 0) AS n_links
FROM documents d LEFT JOIN lowest r ON r.a = d.doc_id LEFT JOIN counted c ON c.a = d.doc_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in four lots of unequal size, are compacted, and are read back by the last manifest."""
    lot = F.floor(F.log2(F.pmod(F.xxhash64("doc_id"), F.lit(8)) + 1)).cast("int")
    store = ShardStore(spark, scratch(spark, "shards"))
    store.append_all(table(spark, sf_dir, "documents").withColumn("lot", F.coalesce(lot, F.lit(0))), "lot")
    store.compact()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_pairs(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), word_tokenizer_path())
    return found.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


#: Tokenizer versions of the token counts, and their files.
COUNTED = {"word-bpe-49k": "word_bpe_49k.json", "byte-bpe-50k": "byte_bpe_50k.tiktoken"}


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches over all documents, the last of which is delivered twice.

    Inserts with an estimate of a token for four characters; revised counts; the
    inserts of a second tokenizer version; deletes of repeated texts in both. Of
    a repeated text the rows of its least id stay, and all of them if every id
    is null.
    """
    import public_tokenizers

    words, pieces = COUNTED
    text = F.coalesce("text", F.lit(""))
    own = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.floor(F.length(text) / 4).cast("long").alias("estimate"), F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text")
    )
    files = {name: public_tokenizers.path(file) for name, file in zip(("words", "pieces"), COUNTED.values(), strict=True)}
    counts = materialize(token_counts.with_counts(own, files), "counts")
    first = counts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("met"))
    repeated = join_hot(counts, first.filter("met > 1"), ["sha"], "met", counts.count()).filter("not (doc_id <=> first)")
    col, kept = F.col, token_counts.TokenCounts(spark, scratch(spark, "token-counts"))
    kept.apply("insert", token_counts.inserts(counts, words, col("estimate")))
    kept.apply("revise", token_counts.revisions(counts, words, col("estimate"), col("words")))
    kept.apply("insert-pieces", token_counts.inserts(counts, pieces, col("pieces")))
    gone = token_counts.deletes(repeated, words, col("words")).unionByName(token_counts.deletes(repeated, pieces, col("pieces")))
    for _ in range(2):
        kept.apply("delete-repeated", gone)
    return kept.totals()


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP6_SQL = f"""
WITH words AS (
  SELECT doc_id, {WORDS_SQL} AS w FROM documents
), items AS (
  SELECT item_id, {WORDS_SQL} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, i, n FROM spots JOIN windows USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), owned AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN owned USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn_from=~held_out(4))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH told AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), last AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS kept FROM told
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM last
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.score(table(spark, sf_dir, "documents"), ~held_out(7))
    return found.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH own AS (
  SELECT conv_id, turn, replace(translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  '), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text,
    coalesce(CAST(floor(turn / 256.0) AS BIGINT), 0) AS block
  FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM own
), speakers AS (
  SELECT DISTINCT conv_id, role AS participant FROM own WHERE role <> 'system'
), said AS (
  SELECT m.conv_id, s.participant, m.block, CAST(floor((m.n - 1) / 256.0) AS BIGINT) AS part, m.n, m.text, m.role = s.participant AS own,
    '<|im_start|>' || CASE WHEN m.role = s.participant THEN 'assistant' WHEN m.role = 'system' THEN 'system' ELSE 'user name=' || m.role END || chr(10) AS head
  FROM numbered m JOIN speakers s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
)
SELECT conv_id, participant, block, part, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY n) AS rendered,
  string_agg('0:' || length(head) || CASE WHEN own THEN ',1:' ELSE ',0:' END || (length(text) + 11), ',' ORDER BY n) AS mask
FROM said GROUP BY conv_id, participant, block, part
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_spotsigs": op3_spotsigs,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_chat_formatting": op10_chat_formatting,
}

#: DuckDB SQL of the queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_sharding": OP2_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op10_chat_formatting": OP10_SQL,
}
