"""The driver queries of the operators and of the pipeline, with their SQL where SQL can say it.

Every query applies its operator, with production parameters, to the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondflow.llm import (chat, decontaminate, exact_dedup, html_text, language, ngram_join, packing, phrases, pieces, prefix_trie, quality,
                          secret_scan, token_counts)
from pondflow.llm.common import crc_fold, materialise, read_table
from pondflow.llm.sql import ORACLE  # noqa: F401


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a repository of its own and ``source`` its owner."""
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "owned")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("owned"), "n_live", "n_copied")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    scores = quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), lambda i: crc_fold(i, 3) != 1)
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    lengths = token_counts.token_lengths(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "matched_words", "coverage", F.size("tiles").alias("n_tiles"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(read_table(spark, sf_dir, "documents"), lambda i: crc_fold(i, 5) != 0)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more (-7) whose texts look like the template's own marks."""
    talks = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    kinds = {f.name: f.dataType for f in talks.schema}
    extra = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    read = chat.read_back(chat.format_windows(talks.unionByName(extra)))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"),
                                        F.sum(F.length("text")).alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda w: w["turns"]))
    loss = F.array_join(F.flatten(F.transform("w", lambda w: w["targets"])), "")
    return (whole.withColumn("turns", turns).withColumn("loss", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.col("formatted_chars").cast("long").alias("formatted_chars")))


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of encoded documents. The ids are written out in one go: a string for each of a long
    text's millions of ids would fill an executor's heap. A text without ids has 0 bytes (``element_at`` fails there)."""
    listed = F.to_json("ids").cast("binary")  # [1,2,3]
    joined = F.substr(listed, F.lit(2), F.octet_length(listed) - 2)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(joined, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"),
                          F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pieces.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.token_pieces(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packing.best_fit(pieces_.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that share heads: each begins with turns of the first one of its hundred."""
    turns = materialise(prefix_trie.number_turns(read_table(spark, sf_dir, "conversations")), "numbered")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns), turns)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_ngram_jaccard_join, op3_exact_dedup, op4_quality_classifier, op5_token_counts, op6_benchmark_decontamination,
    op7_html_extraction, op8_language_id, op9_chat_formatting, op10_sentencepiece, op11_best_fit_packing,
    op12_prefix_trie, op13_phrase_collocations, pipeline)}
