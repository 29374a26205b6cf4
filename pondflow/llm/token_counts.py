"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Each text is encoded whole; only (length, documents) pairs are shuffled. The
histogram's rows then carry, for every length that occurs taken as a context limit,
the documents and tokens at or beyond it and the tokens left after truncation, all
from suffix sums done in two levels (within blocks of lengths, and over the blocks),
so no task holds more than one block.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pondflow.llm.common import documents, materialise

BLOCK = 4096  # lengths in one block of the suffix sums


def _lengths(path: str, pattern: str):
    def run(batches):
        import pyarrow as pa
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])
    return run


def token_lengths(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): one row per row of ``df``; null and empty texts have 0 tokens.
    ``ranks_path`` (a tiktoken rank file) must exist on every executor."""
    docs = documents(df, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_lengths(ranks_path, pattern), f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per length that occurs: n_tokens, n_docs, docs_from, tokens_from, truncated_tokens, docs_upto, n_all.

    For the context limit L = n_tokens: ``docs_from`` and ``tokens_from`` count documents of
    L tokens or more and their tokens; ``truncated_tokens`` is the corpus's total with
    every document cut to L; ``docs_upto`` of ``n_all`` documents fit whole (their ratio is
    the length's quantile). Null lengths count as 0; repeated rows each count; an empty table
    gives an empty result.
    """
    counts = materialise(lengths.select(F.coalesce(F.col(column), F.lit(0)).cast("long").alias("n_tokens")).groupBy("n_tokens")
                         .agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per block: as many as the longest text has blocks of tokens
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("d_beyond"),
                           F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("t_beyond"),
                           F.sum("d").over(totals).alias("n_all"), F.sum("t").over(totals).alias("t_all"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    return (counts.join(blocks, "block")
            .withColumn("docs_from", F.sum("n_docs").over(within) + F.col("d_beyond"))
            .withColumn("tokens_from", F.sum(F.col("n_docs") * F.col("n_tokens")).over(within) + F.col("t_beyond"))
            .select("n_tokens", "n_docs", "docs_from", "tokens_from",
                    (F.col("t_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"),
                    (F.col("n_all") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"), "n_all"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens of the corpus with every document cut to ``limit``, from the histogram alone."""
    row = histogram.agg(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit)))).first()
    return int(row[0] or 0)


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least the share ``q`` of the documents do not exceed."""
    row = histogram.where(F.col("docs_upto") >= F.lit(q) * F.col("n_all")).agg(F.min("n_tokens")).first()
    return row[0]
