"""Z-fast trie of conversations: a node for every distinct beginning of turns.

The trie is built compacted: an edge (low, high] of a path is a run of turns without branch or end, and is found by the prefix at its
handle, the two-fattest depth in (low, high], the one divisible by the highest power of two. A random order of the conversations (by a hash of
their ids) decides whose path a node lies on: the first of its members in that order. A conversation hangs where it leaves the trie of those before it.

That exit is found by fat binary search, for all conversations at once. At the level of a power of two every conversation whose open interval
has its two-fattest depth there probes that depth: prefixes are grouped by name, with those of the paths that others hang from, and of each group the
path it lies on, else the first conversation, is what the others go on from; a conversation alone with its prefix, or the first of a group, has missed. So
there are as many levels as bits in the number of turns of the longest conversation, whatever the size of a family, and each turn's name is moved once
over all levels.

Paths hang from paths. The expected number of paths on the way to the root grows with the logarithm of a family, and these ways are found by
doubling. What hangs at a depth of a path is summed over whole subtrees by sending each path's sums up its way; within a path, sums run
over its events (depths where others hang or end). Edges are expanded to one row per turn at the end.

A prefix's name is 128 bits: two exclusive ors of the hashes of its (place, turn digest) pairs. It is kept in segments, so a conversation
that holds a third of all turns is spread over many rows and tasks. Two equal names of different prefixes are not ruled out, but as likely as
for any 128-bit hash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pondflow.llm.common import materialise

SEGMENT = 256  # turns in one row of a path


def number_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n, digest, chars): the turns of every conversation numbered from 1 by ``turn`` (null first), ties by role and the
    text's digest; repeated rows are turns of their own. Null roles and texts are empty. ``digest`` is 16 bytes of role and text, ``chars``
    the text's code points. Rows without a conversation id belong to none and are left out; an empty table gives no rows.

    Rows are sorted over all tasks by range, so a very long conversation is numbered by many of them.
    """
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = (df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
            .select("conv_id", "turn", "role", F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("digest"),
                    F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie")))
    order = ["turn", "role", "digest", "tie"]
    rows = materialise(rows.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id()), "turns")
    # a conversation that goes on in a block is the block's first: at most one row a block
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    went = (rows.groupBy("conv_id", "block").agg(F.count("*").alias("k")).withColumn("ahead", F.sum("k").over(ahead)).where("ahead > 0")
            .select("conv_id", "block", "ahead"))
    here = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order))
    return rows.withColumn("n", here).join(went, ["conv_id", "block"], "left").select(
        "conv_id", (F.col("n") + F.coalesce("ahead", F.lit(0))).alias("n"), "digest", "chars")


def _segments(turns: DataFrame) -> DataFrame:
    """(c, seg, a, b, m0, m1): for each turn of a segment the two halves of its prefix's name, and the code points before it and through it."""
    rows = turns.select(F.col("conv_id").alias("c"), "n", "chars", F.expr(f"(n - 1) div {SEGMENT}").alias("seg"),
                        *[F.xxhash64(F.lit(k), "n", "digest").alias(s) for k, s in ((1, "a"), (2, "b"))])
    own = Window.partitionBy("c", "seg").orderBy("n")
    rows = rows.select("c", "seg", F.struct("n", F.expr("bit_xor(a)").over(own).alias("a"), F.expr("bit_xor(b)").over(own).alias("b"),
                                            F.sum("chars").over(own).alias("m1"), "chars").alias("x"))
    rows = rows.groupBy("c", "seg").agg(F.sort_array(F.collect_list("x")).alias("x")).withColumn("all", F.element_at("x", -1))
    ahead = Window.partitionBy("c").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    for name, total in (("ca", "bit_xor(all.a)"), ("cb", "bit_xor(all.b)"), ("cm", "sum(all.m1)")):
        rows = rows.withColumn(name, F.coalesce(F.expr(total).over(ahead), F.lit(0)))
    each = {"a": "e.a ^ ca", "b": "e.b ^ cb", "m0": "e.m1 - e.chars + cm", "m1": "e.m1 + cm"}
    return rows.select("c", "seg", *[F.expr(f"transform(x, e -> {how})").alias(name) for name, how in each.items()])


def _level(paths: DataFrame, step: int) -> DataFrame:
    """(c, n, a, b, m1): the name and code points of the prefixes whose depth n is an odd multiple of ``step``, a power of two."""
    first = min(step, SEGMENT)
    here = f"transform(sequence({first}, size(a), {2 * first}), k -> named_struct('n', seg * {SEGMENT} + k, 'a', a[k - 1], 'b', b[k - 1], 'm1', m1[k - 1]))"
    return paths.where(F.size("a") >= first).select("c", F.explode(F.expr(here)).alias("x")).select("c", "x.*").where(f"n % {2 * step} = {step}")


def _search(members: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """(c, len, at, low, shared): at depth ``low`` each member (c, len) leaves the trie of those before it, on path ``at`` (null at
    the root), having shared the first ``low`` turns' code points. One with low = len has no nodes of its own."""
    zero = F.lit(0).cast("long")
    work = members.select("c", "len", F.lit(None).cast(members.schema["c"].dataType).alias("at"), zero.alias("low"), zero.alias("shared"))
    columns = work.columns
    step = 1 << longest.bit_length() >> 1
    while step:
        # low is a multiple of 2 * step, so low + step is the two-fattest depth of what is open
        probing = work.where(F.col("low") + step <= F.col("len")).withColumn("n", F.col("low") + step)
        owners = probing.where("at is not null").select(F.col("at").alias("c"), "n").distinct()
        # the key has the join that brings a group's first back dealt anew, so that a very common prefix can be split
        named = probing.unionByName(owners, allowMissingColumns=True).join(_level(paths, step), ["c", "n"]).withColumn("key", F.xxhash64("n", "a", "b"))
        first = named.groupBy("n", "a", "b").agg(F.min(F.struct(F.col("len").isNotNull().alias("new"), F.xxhash64("c").alias("order"), "c"))["c"].alias("first"))
        hit = F.col("first") != F.col("c")
        new = {"at": F.col("first"), "low": F.col("n"), "shared": F.col("m1")}
        found = named.where("len is not null").join(first.withColumn("key", F.xxhash64("n", "a", "b")), ["key", "n", "a", "b"]).select(
            *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns])
        work = materialise(found.unionByName(work.where(F.col("low") + step > F.col("len"))), "search")
        step >>= 1
    return work


def _ways(own: DataFrame) -> DataFrame:
    """(path, up): the (path, depth) pairs that each path hangs from, directly or through others."""
    ways = materialise(own.select("path", F.expr("filter(array(struct(at as path, low as depth)), x -> x.path is not null)").alias("up"), F.col("at").alias("on")), "ways")
    while not ways.where("on is not null").isEmpty():
        more = ways.select(F.col("path").alias("on"), F.col("up").alias("_up"), F.col("on").alias("_on"))
        longer = ways.where("on is not null").join(more, "on").select("path", F.concat("up", "_up").alias("up"), F.col("_on").alias("on"))
        ways = materialise(ways.where("on is null").unionByName(longer), "ways")
    return ways.select("path", "up")


def _digests(ends: DataFrame) -> DataFrame:
    """(path, depth, ends_sha256) of the ids that end at a node, ascending and comma-joined. Parts of a list are joined in the tasks of a
    range partitioning, so only the digest itself goes over a very long list in one task, part by part."""
    parts = (ends.repartitionByRange("path", "depth", "c").withColumn("block", F.spark_partition_id())
             .groupBy("path", "depth", "block").agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("part")))
    name = F.xxhash64("path", "depth")

    def run(batches):
        import pyarrow as pa

        state, key, head = None, None, None
        for batch in batches:
            rows = []
            for path, depth, _, part in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or (path, depth) != key:
                    if state is not None:
                        rows.append((*key, state.hexdigest()))
                    state, key, head = hashlib.sha256(), (path, depth), ""
                state.update((head + part).encode())
                head = ","
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.string())], ["path", "depth", "ends_sha256"])
            kind = batch.column(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])],
                                             ["path", "depth", "ends_sha256"])

    kind = ends.schema["path"].dataType.simpleString()
    sorted_ = parts.repartition(name).sortWithinPartitions("path", "depth", "block")
    return sorted_.mapInArrow(run, f"path {kind}, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per node, the root (depth 0) included.

    ``turns`` has (conv_id, n, digest, chars) with n from 1 without gaps, as ``number_turns`` makes it; ``conversations`` has every
    ``conv_id`` once or more, those without turns too, which are members of the root alone. A node is named by its smallest member and its depth;
    ``n_leaves`` counts childless nodes of its subtree, itself included, ``saved_tokens`` sums (members - 1) times the code points of the last turn's
    text over it. No conversations, no nodes. Equal conversations end at one node.
    """
    kind = turns.schema["conv_id"].dataType
    zero, one, nothing = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(None).cast(kind)
    paths = materialise(_segments(turns), "paths")
    sizes = paths.groupBy("c").agg(F.max(F.col("seg") * SEGMENT + F.size("a")).alias("len"))
    members = materialise(conversations.select(F.col("conv_id").alias("c")).where("c is not null").distinct().join(sizes, "c", "left")
                          .select("c", F.coalesce("len", F.lit(0)).cast("long").alias("len")), "members")
    longest, smallest = members.agg(F.max("len"), F.min("c")).first()
    found = _search(members, paths, longest or 0)
    own = found.where("low < len").withColumnRenamed("c", "path")
    kids = own.where("at is not null").groupBy(F.col("at").alias("path"), F.col("low").alias("depth")).agg(F.count("*").alias("kids"))
    below = kids.select("path", F.col("depth").alias("len"), "kids")
    own = materialise(own.join(below, ["path", "len"], "left").withColumn("leaves", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long")).drop("kids"), "own")
    digests = materialise(_digests(found.select(F.when(F.col("low") < F.col("len"), F.col("c")).otherwise(F.col("at")).alias("path"), F.col("len").alias("depth"), "c")),
                          "digests")
    # what hangs at a depth of a path: members, the smallest, code points they share with those before them, and childless nodes
    sums = {"n": F.sum("n"), "m": F.min("m"), "shared": F.sum("shared"), "leaves": F.sum("leaves")}
    short = (found.where("low = len and len > 0").groupBy(F.col("at").alias("path"), F.col("low").alias("depth"))
             .agg(F.count("*").alias("n"), F.min("c").alias("m"), F.sum("shared").alias("shared")).withColumn("leaves", zero))
    self = own.select("path", F.col("len").alias("depth"), one.alias("n"), F.col("path").alias("m"), "shared", "leaves")
    whole = self.unionByName(short).groupBy("path").agg(*[how.alias(name) for name, how in sums.items()])
    sent = (whole.join(_ways(own), "path").select(F.explode("up").alias("x"), *sums).select("x.path", "x.depth", *sums))
    # a path shares its own nodes with none before it; its end says where it hangs
    ends = self.withColumn("shared", zero).join(own.select("path", "at", F.col("low").alias("top")), "path")
    events = (ends.unionByName(short, allowMissingColumns=True).unionByName(sent, allowMissingColumns=True).unionByName(kids, allowMissingColumns=True)
              .groupBy("path", "depth").agg(*[how.alias(name) for name, how in sums.items()], F.max("at").alias("at"), F.max("top").alias("top"),
                                            (F.coalesce(F.sum("kids"), zero) + F.when(F.max("top").isNull(), 1).otherwise(0)).alias("kids")))
    # a path has at most sqrt(2 * turns) events: each needs a conversation of that length
    line = Window.partitionBy("path").orderBy(F.desc("depth"))
    down = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.select("path", F.col("depth").alias("high"), "kids", F.lead("depth").over(line).alias("_low"), F.max("at").over(down).alias("at"),
                         F.max("top").over(down).alias("top"), F.sum("n").over(down).alias("n_convs"), F.min("m").over(down).alias("conv_id"),
                         F.sum("leaves").over(down).alias("n_leaves"), F.sum("shared").over(down).alias("shared"), "depth")
    rows = materialise(rows.withColumn("above", F.lead("conv_id").over(line)).withColumn("low", F.coalesce("_low", "top")).drop("depth", "_low"), "sums")
    # the first edge of a path is below a node of the path it hangs from
    upper = rows.select(F.col("path").alias("at"), F.col("high").alias("low"), F.col("conv_id").alias("_above"))
    hung = F.col("above").isNull() & F.col("at").isNotNull()
    under = rows.where(hung).join(upper, ["at", "low"]).withColumn("above", F.col("_above")).drop("_above")
    rows = under.unionByName(rows.where(~hung).withColumn("above", F.coalesce("above", F.lit(smallest).cast(kind))))
    empty = hashlib.sha256(b"").hexdigest()
    rows = rows.join(digests.select("path", F.col("depth").alias("high"), "ends_sha256"), ["path", "high"], "left")
    rows = rows.withColumn("seg", F.explode(F.sequence(F.expr(f"low div {SEGMENT}"), F.expr(f"(high - 1) div {SEGMENT}"))))
    rows = rows.join(paths.select(F.col("c").alias("path"), "seg", "m0"), ["path", "seg"]).select("*", F.posexplode("m0").alias("i", "before"))
    rows = rows.withColumn("depth", F.col("seg") * SEGMENT + F.col("i") + 1).where("depth > low and depth <= high")
    last = F.col("depth") == F.col("high")
    # all members share what is before the node; of the rest a member's shared code points are those it saves
    rows = rows.select("conv_id", "depth", F.when(F.col("depth") == F.col("low") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                       "n_convs", F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
                       (F.col("shared") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
                       F.when(last, F.coalesce("ends_sha256", F.lit(empty))).otherwise(empty).alias("ends_sha256"))
    top = (found.select(F.col("c").alias("conv_id"), one.alias("n_convs"), "shared")
           .unionByName(own.select("leaves", F.when(F.col("at").isNull(), 1).otherwise(0).alias("kids")), allowMissingColumns=True)
           .unionByName(digests.where("path is null").select("ends_sha256"), allowMissingColumns=True)
           .agg(F.min("conv_id").alias("conv_id"), zero.alias("depth"), nothing.alias("parent_conv_id"), F.coalesce(F.sum("n_convs"), zero).alias("n_convs"),
                F.coalesce(F.sum("kids"), zero).alias("n_children"), F.greatest(F.coalesce(F.sum("leaves"), zero), one).alias("n_leaves"),
                F.coalesce(F.sum("shared"), zero).alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(empty)).alias("ends_sha256"))
           .where("n_convs > 0"))
    return rows.unionByName(top)


def with_shared_heads(numbered: DataFrame, most: int = 6, family: int = 100) -> DataFrame:
    """(conv_id, n, digest, chars): every conversation c rebuilt to begin with the first h turns of conversation c - c % family
    (as many as it has), followed by its own turns after its first h; h is crc32 of the decimal id, modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    heads = numbered.where(F.col("n") < most)
    had = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("n").alias("had"))
    convs = (numbered.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
             .join(had, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("had", F.lit(0))).alias("taken")))
    own = numbered.where(F.col("n") > h).join(convs, "conv_id").select("conv_id", (F.col("n") - F.col("h") + F.col("taken")).alias("n"), "digest", "chars")
    lent = (convs.select("conv_id", "h", "base").join(heads.withColumnRenamed("conv_id", "base"), "base").where("n <= h")
            .select("conv_id", F.col("n").cast("long").alias("n"), "digest", "chars"))
    return own.unionByName(lent)
