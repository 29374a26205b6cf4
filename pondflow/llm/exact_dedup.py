"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks of the
corpus are sorted and numbered, so a block's integer name stands for its content;
then the names of adjacent blocks are paired and the distinct pairs numbered again,
until each document has one name. Texts are equal exactly when they have as many
blocks and the same last name: numbering distinct contents cannot collide.

Whole blocks are shuffled once, to find the distinct ones (map-side combining folds
the copies of a hot block). The names are brought back to the documents by a 64-bit
digest and the length, after a check that no two distinct blocks share them; if any
do, the blocks themselves are the join key instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondflow.llm.common import documents, materialise

BLOCK_BYTES = 4096


def _numbered(distinct: DataFrame, content: list[str]) -> DataFrame:
    """Distinct rows sorted by content within their partitions, numbered in that order."""
    return distinct.sortWithinPartitions(*content).withColumn("name", F.monotonically_increasing_id())


def _block_names(rows: DataFrame, digest) -> DataFrame:
    """(doc_id, sha, nb, i, name) from rows (doc_id, sha, nb, i, block)."""
    keyed = rows.withColumn("digest", digest(F.col("block"))).withColumn("bytes", F.length("block"))
    names = _numbered(rows.select("block").distinct(), ["block"])
    short = materialise(names.select(digest(F.col("block")).alias("digest"), F.length("block").alias("bytes"), "name"), "names")
    if short.groupBy("digest", "bytes").count().where("count > 1").isEmpty():
        return keyed.drop("block").join(short, ["digest", "bytes"]).drop("digest", "bytes")
    return rows.join(materialise(names, "names"), "block").drop("block")


def exact_names(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
                digest=F.xxhash64) -> DataFrame:
    """(doc_id, sha, copies, blocks, name): one row per distinct (id, text), ``copies`` its rows in ``df``.

    ``sha`` is the binary SHA-256 of the UTF-8 text and only tells rows of one id
    apart; (blocks, name) is the identity of the text. A null text counts as
    empty, which is one empty block.
    """
    docs = documents(df, doc_id, text).select("doc_id", F.col("text").cast("binary").alias("raw"))
    docs = docs.select("doc_id", F.unhex(F.sha2("raw", 256)).alias("sha"), "raw",
                       F.greatest(F.lit(1), F.ceil(F.length("raw") / block_bytes)).cast("int").alias("nb"))
    cut = F.transform(F.sequence(F.lit(0), F.col("nb") - 1),
                      lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = docs.select("doc_id", "sha", "nb", F.posexplode(cut).alias("i", "block"))
    copies = docs.groupBy("doc_id", "sha", "nb").agg(F.count("*").alias("copies"))
    # repeated rows give repeated (doc_id, sha, i), all with the same name
    names = materialise(_block_names(rows, digest).distinct(), "block-names")
    done, left = names.where("nb = 1").select("doc_id", "sha", "name"), names.where("nb > 1").select("doc_id", "sha", "nb", "i", "name")
    blocks = names.agg(F.max("nb")).first()[0] or 1
    while blocks > 1:
        pairs = materialise(
            left.groupBy("doc_id", "sha", "nb", F.shiftright("i", 1).alias("j"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
        named = materialise(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]), "names")
        left = materialise(pairs.join(named, ["a", "b"]).select("doc_id", "sha", F.ceil(F.col("nb") / 2).cast("int").alias("nb"),
                                                                F.col("j").alias("i"), "name"), "block-names")
        done = done.unionByName(left.where("nb = 1").select("doc_id", "sha", "name"))
        left = left.where("nb > 1")
        blocks = -(-blocks // 2)
    same = [copies.doc_id.eqNullSafe(done.doc_id), copies.sha == done.sha]
    return copies.join(done, same).select(copies.doc_id, copies.sha, "copies", F.col("nb").alias("blocks"), "name")


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
                digest=F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``df``.

    Texts are equal when their bytes are. Of equal texts the row with the largest id
    stays (a null id is smaller than any); of repeated rows of that id one stays.
    Null texts count as empty texts and so are copies of each other. An empty table
    gives an empty result.
    """
    named = materialise(exact_names(df, doc_id, text, block_bytes, digest), "identities")
    groups = named.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return (named.join(groups, ["blocks", "name"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    marks = materialise(exact_dedup(df, doc_id, text).groupBy("doc_id", "text_sha256")
                        .agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "decisions")
    rows = df.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), sha.alias("_sha"))

    def matching(m: DataFrame):
        return rows["_id"].eqNullSafe(m["doc_id"]) & (rows["_sha"] == m["text_sha256"])

    out = marks.where("not kept or rows > 1")
    twice = marks.where("kept and rows > 1")  # repeated rows of one id: one of them stays
    single = rows.join(out, matching(out), "left_anti")
    again = rows.join(twice, matching(twice), "left_semi").dropDuplicates(["_id", "_sha"])
    return single.unionByName(again).select("_row.*")
