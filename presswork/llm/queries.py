"""The registered queries of the operators: whole tables in, full results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from presswork.llm import (
    ann, html_region, lattice, licenses, line_dedup, minhash, mixing, negatives, periodic, secrets, tokenfile, toxicity, winnow)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_token_files(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfile.read_digest(tokenfile.write_tokens(table(spark, sf_dir, "documents"), path))


@query
def op9_winnowing(spark, sf_dir):
    return winnow.document_fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_html_region(spark, sf_dir):
    return html_region.main_texts(table(spark, sf_dir, "pages"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query
def op2_toxicity(spark, sf_dir):
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query
def op10_sampled_segmentations(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return lattice.sample_segmentations(table(spark, sf_dir, "documents"), path)


@query
def op5_raked_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


SQL["op5_raked_mix"] = mixing.sql()


@query
def op4_line_join(spark, sf_dir):
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


SQL["op4_line_join"] = line_dedup.sql()


@query
def op1_secret_forest(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), learn_from=~held_out(), path="source")


@query
def op7_nn_descent(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL["op11_hard_negatives"] = negatives.sql()


@query
def op12_license_diagonals(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


SQL["op12_license_diagonals"] = licenses.sql()


@query
def op13_periodic_runs(spark, sf_dir):
    return periodic.scan_runs(periodic.with_loops(table(spark, sf_dir, "documents")))


SQL["op13_periodic_runs"] = periodic.sql()
