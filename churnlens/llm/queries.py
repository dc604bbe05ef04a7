"""Registered queries of the corpus operators: one per operator, over whole tables.

Each takes its rows from its operator; the digest columns of the query contracts are
derived here.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import (bpe, chat_format, fill_middle, jaccard_join, learned_index, mixing, quality_rules, rule_ensemble,
                           sharding, simhash, sql, url_filter, vector_codes, warc)
from churnlens.llm.text import table
from churnlens.session import scratch_path

# Directory of the public tokenizer files; unset, the installed package's own.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "")
TOKENIZER = "byte_bpe_50k.json"
QUERY_STEP = 50  # searches take the ids divisible by this as queries
DOMAIN_SHARES = {"clean": 0.9, "toxic": 0.05, "junk": 0.05}


def tokenizer_path(name: str = TOKENIZER) -> str:
    if TOKENIZER_DIR:
        return os.path.join(TOKENIZER_DIR, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every text and of its edited text.  ``n_near``: documents within the
    Hamming radius (itself included), for ids divisible by 50, found in the block tables;
    ``near_class`` is the same for these and the documents near them."""
    docs = simhash.with_next(table(spark, sf, "documents")).checkpoint()
    return simhash.near_classes(docs, F.col("doc_id") % QUERY_STEP == 0)


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Rates that give the label domains their shares of all tokens."""
    return mixing.mix(table(spark, sf, "documents"), mixing.label_domains(table(spark, sf, "labels")), DOMAIN_SHARES)


def op3_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf, "documents"), n=3, percent=90)


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf, "documents").select("doc_id", "text"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_rules.kept_by("base")).alias("base_failed"), quality_rules.kept_by().alias("kept"), "fail_bits")


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    warc.write_archive(table(spark, sf, "pages"), path)
    urn = lambda c: F.regexp_extract(c, rf"^<{warc.ID_URN}(-?\d+)>$", 1)
    number = lambda c: F.when(urn(c) != "", urn(c).try_cast("long"))
    full = F.col("warc_type") == "response"
    return warc.read_archive(spark, path).select(
        number(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, warc.sha1_base32(F.col("payload"))).otherwise(F.replace("payload_digest", F.lit("sha1:"), F.lit("")))
        .alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"), "target_uri")


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"))


def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    convs = chat_format.conversations(table(spark, sf, "conversations"))
    return chat_format.format_pairs(chat_format.swapped_answers(convs))


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents").select("doc_id"), "doc_id")


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = bpe.shared(spark, tokenizer_path())
    ids = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    return bpe.decode(ids, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op10_rule_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    model = rule_ensemble.fit(docs, labels.where(~held_out()))
    return rule_ensemble.score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                       digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restore()).alias("restored_sha256"))


def op12_learned_index(spark: SparkSession, sf: str) -> DataFrame:
    return learned_index.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    codes, books, _ = vector_codes.compress(table(spark, sf, "embeddings"))
    codes = codes.checkpoint()
    # Written out, so that the join of a frequent label can be split.
    per_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_l"), "label_error").checkpoint()
    return codes.join(per_label, F.col("label").eqNullSafe(F.col("_l"))).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_mixing, op3_jaccard_join, op4_quality_rules, op5_warc, op6_url_filter, op7_chat_format, op8_sharding,
    op9_bpe, op10_rule_ensemble, op11_fill_middle, op12_learned_index, op13_vector_codes, pipeline)}
ORACLE = sql.ORACLE
