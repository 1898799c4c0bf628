"""Registered queries of the subpackage: each reads whole tables and gives its operator's full result."""
from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from ..sources.tables import table
from . import brown, decontaminate, langid, merkle, mixing, ngrams, quality, rules, secrets, spelling, tokens, urls, vectors
from .common import id_crc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return table(spark, sf_dir, "documents")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back, as op1's contract asks.

    ``tokenizer``: path of a tokenizer file on the driver, by default the public byte-level one."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardline-tokens/{uuid.uuid4().hex}"
    tokens.write_tokens(docs, path, Path(tokenizer).read_text())
    return tokens.read_tokens(spark, path)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_documents(spark, sf_dir))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.line_rules(_documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return secrets.find_secrets(_documents(spark, sf_dir)).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(s).alias("spans"),
        count(3).alias("n_markov"))


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"),
                         quality.score(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.ACCEPT).cast("int"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages, urls.repeated_urls(pages)).select(
        "page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs), F.col("text"))
    return docs.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), found.alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_found.*")
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "common")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir).select("doc_id", "text", "source"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_components(_documents(spark, sf_dir), n=4, percent=85)


def op10_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return brown.score(docs, brown.fit(docs))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and its check against texts that lost their line breaks where the id's crc32 is even (never without an id)."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    seen = F.when(odd == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.merkle_manifest(_documents(spark, sf_dir), seen)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                        "folded_root", "verified")


def op13_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_line_rules, op3_secret_scan, op4_neighbour_quality, op5_url_filter, op6_ppm_language,
    op7_latent_decontamination, op8_source_mix, op9_ngram_jaccard, op10_class_bigrams,
    op11_spelling_variants, op12_merkle_manifest, op13_vector_near_duplicates)}
