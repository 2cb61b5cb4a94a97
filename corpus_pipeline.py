"""From raw documents to token counts: each stage works on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import language, mixing, simhash, tokens, toxicity
from switchyard.llm.common import held_out, place, table, written
from switchyard.llm.queries import BLOCK_ROWS, target_shares, training_labels

MIN_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; null, letterless and foreign texts go.

    Foreign: less than ``MIN_LANGUAGE_SCORE`` of the n-grams belong to the
    best language.
    """
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    marked = docs.select(F.struct("*").alias("row"), language.predicted(spark, model, F.col("text")).alias("p"))
    return marked.where((F.col("p.lang") != language.UNKNOWN) & (F.col("p.score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score under one half."""
    model = toxicity.fit(docs, training_labels(spark, sf_dir))
    marked = docs.select(F.struct("*").alias("row"), toxicity.scored(spark, model, F.col("text")).alias("t"))
    return marked.where(F.col("t.score") < 0.5).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (SimHash, 3-word shingles, 3 bits) the row of the smallest id stays.

    If that id has several texts in the group, the one of the smaller hash
    stays; of repeated rows of an id and text one (other columns: of the
    smaller hash).  Texts of one id in different groups stay, each for its
    group.  Rows without an id stay.
    """
    text = F.xxhash64("text")
    found = simhash.near_duplicates(docs, carry=text)
    kept = found.where("doc_id = component_id").groupBy("component").agg(F.min(F.struct("carry", "doc_id")).alias("k"))
    kept = written(kept.select("k.doc_id", "k.carry").distinct(), "pipeline-kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), text.alias("h"), F.xxhash64("*").alias("other"))
    chosen = rows.join(kept, (F.col("i") == F.col("doc_id")) & (F.col("h") == F.col("carry")), "left_semi")
    chosen = chosen.groupBy("i", "h").agg(F.min_by("row", "other").alias("row"))
    return chosen.select("row.*").unionByName(rows.where("i is null").select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; rows of one id and source by their texts' hashes."""
    return mixing.reordered(docs, target_shares(docs), block_rows=BLOCK_ROWS, ties=[F.xxhash64("text")])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its place in the mix, the number of tokens and the digests of ids and decoded bytes.

    The place, ``(slot, nth_row)``, is that of the order in which the rows
    come, ``mix_sources``'s: a scan keeps no order, but the names of files and
    the rows' numbers in them do.
    """
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    marked = docs.select("doc_id", "source", place(docs).alias("at"), tokens.token_digests(spark, F.col("text"), ranks, public_tokenizers.PATTERN).alias("t"))
    encoded = written(marked.select("doc_id", "source", "at", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256"), "pipeline-tokens")
    digests = ["n_tokens", "ids_sha256", "decoded_sha256"]
    placed = mixing.in_order(encoded, target_shares(encoded), "at", block_rows=BLOCK_ROWS, carry=digests)
    return placed.select("doc_id", "source", "slot", "nth_row", *digests)


STAGES = [("language_id", identify_language), ("toxicity", drop_toxic), ("simhash_dedup", drop_near_duplicates),
          ("source_mixing", mix_sources), ("byte_bpe", encode_tokens)]

#: Hashes, learned models and components have no SQL form; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
