"""The registered queries of this subpackage: thin derivations of digest columns from the operators' outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import chat, collocations, decontamination, fingerprints, html_text, languages, licenses, middle, near_dups, oracles, packing, secrets, substrings, tokens
from barline.llm._spark import sha256_of, table


def op1_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tokens.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_of(listed).alias("ids_sha256"), sha256_of(F.col("decoded")).alias("decoded_sha256"))


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op7_span_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = languages.held_out()
    model = languages.train(docs.where(F.col("lang").isNotNull() & ~out))
    found = languages.identify(docs.drop("lang"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


def op8_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", sha256_of(F.col("kept")).alias("kept_sha256"))


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = listed(F.filter("secrets", lambda s: s.kind != "markov"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), sha256_of(base).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), count("markov"))


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = chat.examples(turns.unionByName(added))
    lines = F.array_join(F.transform(chat.turns_of(F.col("text")), lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    read = made.select(
        "conv_id",
        F.when(F.col("last"), F.size(chat.turns_of(F.col("text")))).alias("n"),
        F.when(F.col("last"), sha256_of(lines)).alias("digest"),
        F.struct("example", chat.reply_of(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply")).alias("r"),
        F.char_length("text").cast("long").alias("chars"),
    )
    grouped = read.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("digest").alias("turns_sha256"), F.sort_array(F.collect_list("r")).alias("replies"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("replies.reply", "")
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"), sha256_of(loss).alias("loss_sha256"), "formatted_chars")


def op5_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.max("matched").cast("long").alias("most_matched"), F.max("longest").cast("long").alias("longest_run"), F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("items"))


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        F.col("n_chars"),
        sha256_of(F.col("edited")).alias("edited_sha256"),
        F.array_join("sketch", ",").alias("fingerprint"),
        F.array_join("edited_sketch", ",").alias("edited_fingerprint"),
        F.round("near_edited", 6).alias("near_edited"),
        F.round("near_next", 6).alias("near_next"),
    )


def op10_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: a directory for each source, in it one for each thousand and in that for each hundred ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), F.expr("doc_id div 1000"), F.lit("/"), F.expr("doc_id div 100"), F.lit("/"), F.col("doc_id"))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", "score", "origin", "from_dir")


def op11_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_skip_list_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(spark, sf_dir, "documents"))
    back = middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_of(F.col("output")).alias("output_sha256"), sha256_of(back).alias("restored_sha256"))


def op13_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chunk_reuse_bpe,
        op2_bbit_minhash,
        op3_markov_secrets,
        op4_prefix_targets,
        op5_consensus_html,
        op6_spaced_seeds,
        op7_span_languages,
        op8_difference_cover,
        op9_scaled_sketch,
        op10_license_inheritance,
        op11_nnls_packing,
        op12_skip_list_middle,
        op13_tiled_collocations,
    )
}
ORACLES = oracles.SQL
