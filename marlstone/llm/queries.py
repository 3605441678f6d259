"""One registered query for each operator of this subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, divergence, html_text, langid, licenses, lines, packing, repeats, sentencepiece, simhash, toxicity, vectors

#: The vocabulary of op1; a file of the public tokenizers, never part of this repository.
PIECES_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and the decoded text of every document; a null or empty text has no ids, repeated rows each have a row."""
    vocabulary = sentencepiece.Vocabulary(sentencepiece.zipf_scores(sentencepiece.read_pieces(PIECES_PATH)))
    return sentencepiece.encoded(_table(spark, sf_dir, "documents"), vocabulary, decode=True)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, license and notices of every document; null and blank texts have the digest of the empty text and no licence."""
    return licenses.scanned(_table(spark, sf_dir, "documents"), licenses.known(spark))


def op3_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in a batch; blank and null texts have 0 tokens and a place, too, ties of length stand in the order of their ids."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_simhash_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null and blank texts have fingerprint zero and are linked like any other."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), most_bits=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; a null page has an empty text."""
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op6_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every hundredth vector; null, zero and broken vectors take no part, ties go to the smaller id."""
    return vectors.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; null and empty texts have the lowest score."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_threshold_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest products of every fiftieth vector; null and broken vectors take no part, zero ones do, ties go to the smaller id."""
    return vectors.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and how many lines it had and lost; a null text stays null, every document stays."""
    found = lines.without_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op10_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing all repeated strings of 200 bytes leaves of every document; a null text is empty, and whole copies go altogether."""
    return repeats.removal_digest(_table(spark, sf_dir, "documents"), length=200)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source from the others of its language and its terms over the language's; null texts, langs and sources are empty."""
    return divergence.audited(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document; null texts and ones without a letter have ``und``, a row without an id isn't held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return langid.identified(docs, langid.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every damaged conversation; nulls are one space, one without turns has zeros."""
    turns = _table(spark, sf_dir, "conversations")
    return conversations.repaired(conversations.damaged(turns), turns)


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_license_scan, op3_length_bucket_packing, op4_simhash_anchor_dedup, op5_line_block_html, op6_projected_neighbours, op7_toxic_segments, op8_threshold_top_products, op9_fuzzy_line_dedup, op10_suffix_array_repeats, op11_source_divergence, op12_language_id, op13_conversation_repair)
}

ORACLE: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op3_length_bucket_packing": packing.oracle(),
    "op13_conversation_repair": conversations.oracle(),
    "op11_source_divergence": divergence.oracle(),
    "op8_threshold_top_products": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
}
