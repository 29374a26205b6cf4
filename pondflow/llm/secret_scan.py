"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Matches of the base kinds and of a wide candidate pattern are located natively:
splitting a text by a pattern gives the stretches between matches, whose running
lengths are the matches' code point positions. The SHA-256 of each candidate's value
is counted over the whole corpus by distinct repositories and owners (map-side
combined, so a value copied into a third of all rows is folded before the shuffle).
A value held by many owners is a copied example; one that a single owner holds and
that does not look like a placeholder is a live-looking credential. Live-looking
candidates that no base match covers are added as spans of the kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns of the base kinds: (pattern, group of the value, least characters of that group).
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What occurs in every match kept, to pass over texts without any.
SIGN = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "owned": r"[A-Za-z0-9+/_-]{20}",
}
CANDIDATE = (r"[A-Za-z0-9+/_-]+", 0, 20)
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|redacted|your|x{4}|0{6}|123456"
KINDS = [*BASE, "owned"]
MOST_OWNERS = 1      # owners of a live-looking value
COPIED_OWNERS = 3    # owners from which on a value is a copied example
LEAST_DISTINCT = 8   # distinct characters of a live-looking value


def _found(docs: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """(doc_id, mark, repo, owner, kind, rank, start, end, value) of one kind's matches."""
    text = F.col("text")
    cut = docs.where(text.rlike(SIGN[kind])).select(
        "doc_id", "mark", "repo", "owner",
        F.posexplode(F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                                  F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                                  F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))).alias("i", "x"))
    # repeated rows give the same pieces: one of each is enough, they are joined back by (doc_id, mark)
    cut = cut.dropDuplicates(["doc_id", "mark", "repo", "owner", "i"])
    here = Window.partitionBy("doc_id", "mark", "repo", "owner").orderBy("i")
    size = F.length("x.gap") + F.coalesce(F.length("x.all"), F.lit(0))
    end = F.sum(size).over(here)
    return (cut.withColumn("end", end).where(F.length("x.value") >= least)
            .select("doc_id", "mark", "repo", "owner", F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"),
                    (F.col("end") - F.length("x.all")).alias("start"), "end", F.col("x.value").alias("value")))


def _live(value: Column) -> Column:
    return ((F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT) & ~value.rlike(PLACEHOLDER)
            & value.rlike("[0-9]") & value.rlike("[A-Za-z]"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repos): how many distinct owners and repositories hold each value."""
    return (spans.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("r"))
            .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repos")))


def secret_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per span: doc_id, mark (xxhash64 of the text), kind, start, end (code points, end exclusive),
    hash, owners, repos, live, copied. Spans of kind ``owned`` cover nothing that a base span covers."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                     F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    spans = None
    for kind, rule in {**BASE, "owned": CANDIDATE}.items():
        part = _found(docs, kind, *rule)
        if kind == "owned":
            part = part.where((F.length(F.regexp_replace("value", "[^0-9]", "")) >= 3)
                              & (F.length(F.regexp_replace("value", "[^A-Za-z]", "")) >= 3))
        spans = part if spans is None else spans.unionByName(part)
    same = ("doc_id", "mark", "repo", "owner")
    base = F.col("kind") != "owned"
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy(*same).orderBy("start", "rank"))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy(*same).orderBy(F.desc("start"), F.asc("rank")))
    spans = (spans.withColumn("before", before).withColumn("after", after)
             .where(base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))))
             .drop("before", "after")
             .withColumn("hash", F.sha2("value", 256)))
    counted = (spans.join(ownership(spans), "hash")
               .withColumn("live", (F.col("owners") <= MOST_OWNERS) & _live(F.col("value")))
               .withColumn("copied", F.col("owners") >= COPIED_OWNERS))
    return counted.where(base | F.col("live")).drop("value")


def scan_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """(doc_id, spans, n_live, n_copied): one row per row of ``df``; ``spans`` is an array of
    (start, rank, kind, end, hash, owners, repos, live, copied) in order of start and kind.

    Null and empty texts have no spans. Repeated rows each come out with the same spans and count
    once as a repository's; a null owner or repository is one like any other. An
    empty table gives an empty result. A text's spans are gathered in one row; nothing is gathered across texts.
    """
    found = (secret_spans(df, doc_id, text, repo, owner)
             .groupBy("doc_id", "mark", "repo", "owner")
             .agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "hash", "owners", "repos", "live", "copied"))).alias("spans"))
             .select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("repo").alias("_repo"), F.col("owner").alias("_owner"), "spans"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
                     F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))
    on = (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
          & F.col("repo").eqNullSafe(F.col("_repo")) & F.col("owner").eqNullSafe(F.col("_owner")))
    out = rows.join(found, on, "left")
    spans = F.coalesce(F.col("spans"), F.array().cast(found.schema["spans"].dataType))
    return (out.select("doc_id", spans.alias("spans"))
            .withColumn("n_live", F.size(F.filter("spans", lambda s: s["live"])).cast("long"))
            .withColumn("n_copied", F.size(F.filter("spans", lambda s: s["copied"])).cast("long")))
