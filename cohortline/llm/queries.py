"""The registered queries of the corpus operators and the SQL some of them are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import alignment, chat, common, jaccard, lm, mixing, neighbours, oracle, packing, pii, quality, rangejoin, resampling, suffix, warc
from cohortline.runtime import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file of the packing query; the operator takes any."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, a row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by what four fifths of the ids teach."""
    held_out = common.crc_of("doc_id", 5) == 1
    return common.slim(lm.score(table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix of their source takes of them."""
    return common.slim(mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 5-word shingles and its class at similarity 0.75."""
    return common.slim(jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id"))


def op5_adaptive_scan_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector, against all others."""
    return common.slim(neighbours.nearest(table(spark, sf_dir, "embeddings")))


def op6_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts imitate the template, formatted and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat.read_back(chat.expand(turns.union(trial)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links at cosine 0.9 and their class."""
    return common.slim(rangejoin.near_duplicates(table(spark, sf_dir, "embeddings")))


def op8_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back by the index; a revisit has what its response's payload says."""
    folder = f"{checkpoint_dir(spark)}/cohortline-warc-{uuid.uuid4().hex}"
    records = warc.read_records(warc.write_archive(table(spark, sf_dir, "pages"), folder), folder)
    slim = common.cut(records.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"),
                                     F.sha1("payload").alias("sha1")))
    whole = slim.where("record_type = 'response'").groupBy(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest")).agg(
        F.first("bytes").alias("of_bytes"), F.first("sha1").alias("of_sha1"))
    revisits = slim.where("record_type = 'revisit'").join(whole, (F.col("refers_to") == F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = slim.where("record_type = 'response'").withColumnsRenamed({"bytes": "payload_bytes", "sha1": "payload_digest"})
    return common.slim(responses.select(*columns).union(
        revisits.withColumnsRenamed({"of_bytes": "payload_bytes", "of_sha1": "payload_digest"}).select(*columns)))


def op9_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labels of two thirds of the ids."""
    held_out = common.crc_of("doc_id", 3) == 1
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~held_out)
    return common.slim(scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that a smaller document has as well."""
    return common.slim(suffix.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def op11_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document: the base spans, and all with those that the trees add."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def said(spans: Column) -> Column:
        name = F.array(*map(F.lit, pii.KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long") for k in range(len(pii.KINDS))]
    counts = [(F.size(base) - n).alias(f"n_{kind}") for n, kind in zip(counts, pii.KINDS)]
    return common.slim(found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")))


def op12_diagonal_run_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, in groups and links, with how many documents hold its links."""
    aligned = alignment.alignments(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    links = common.cut(aligned.withColumn("groups_sha256", digest).drop("groups"), few=False)
    return common.slim(alignment.with_counts(links).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def op13_overlapped_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's n-gram importance for the benchmark texts, and the rank of the twentieth that is drawn."""
    scored = resampling.importance_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return common.slim(scored.select("doc_id", "n_features", "weight", "score", "rank"))


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_cost_balanced_packing, op2_log_frequency_bloom, op3_source_mixing, op4_ngram_jaccard, op5_adaptive_scan_neighbours, op6_prefix_target_chat, op7_metric_range_join, op8_indexed_warc,
                                   op9_quadratic_quality, op10_suffix_repeats, op11_boosted_candidates, op12_diagonal_run_alignment, op13_overlapped_resampling)}


def llm_sql() -> dict[str, str]:
    """For those that SQL can say; tokenizers, models, seeded draws and approximate search are tested against brute force."""
    return dict(oracle.SQL)
