"""N-gram Jaccard join: documents whose sets of word shingles overlap by 0.8 or more.

The join is the sparse product of the document by n-gram incidence matrix with its
transpose, restricted to the blocks that can hold an entry large enough:

1. Documents with equal sets become one *node* (a 64-bit name of the set), so copies
   are never paired.
2. Columns (shingles) are ordered: common ones last, by hash otherwise. With overlap
   at least 4/9 of the summed sizes, two nodes must share one of the first
   n - ceil(0.8 n) + 1 columns of each; only those entries are multiplied. Any order
   is exact; the common columns (a bounded list of hash buckets, found by counting) only save
   work. Entries whose bucket holds no other entry are dropped before the shuffle.
3. In each column one node (the pivot, the one with most common shingles) is paired
   with the others, never all with all. Size and position bounds discard pairs
   before their overlap is accumulated.
4. Links make components. Pairs still open are those of one column whose ends are in
   different components. Where they would be many, further rounds pair the nodes
   outside a column's largest component with another node of it. The rest is exact:
   columns with open pairs are cut in blocks, and what lies outside the largest
   component is joined with each block under the same bounds. No link is lost: a
   pair is left out only if its ends are already connected or a bound rules it out.

Before any overlap is accumulated a parity sketch per node (a bit is the parity of
the shingles that hash to it) bounds it from above: the sketches of two sets differ in
at most as many bits as the sets in elements.

The overlap of a surviving pair is counted on its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pondflow.llm.common import discard, documents, materialise, mix, release, string_buffers, text_slices
from pondflow.llm.components import connected_components
from pondflow.llm.shingles import Hasher, set_name

HOT_AT = 16            # a column with more nodes than this counts as common
HOT_COLUMNS = 100_000  # most buckets in the list of common ones (0.8 MB broadcast)
BUCKET_BITS = 30       # buckets that columns are counted in
SLICE = 2 << 20        # bytes of text worked on at a time
BLOCK = 1024           # nodes of a column in one block of the second product
FILTER_BITS = (1 << 16, 1 << 25)  # fewest and most bits of the filters of documents and buckets (4 MB broadcast)
WORDS = 1024           # words of a filter in one row for the driver
SKETCH = 8             # longs of the parity sketch
ROUNDS = 4             # most further rounds of pivots before the rest is joined


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _sketch(shingles: np.ndarray) -> np.ndarray:
    parity = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _sets(batches, k: int) -> Iterator:
    """(ids, shingle sets, set names) of parts of Arrow batches of (doc_id, text)."""
    hasher = Hasher()
    for whole in batches:
        for batch in text_slices(whole, 1, SLICE):
            raw, offsets = string_buffers(batch.column(1))
            with np.errstate(over="ignore"):
                sets = list(hasher.shingles(raw, offsets, k))
                yield batch.column(0), sets, [set_name(s) for s in sets]
    release()


def _describe(k: int):
    def run(batches):
        import pyarrow as pa

        for ids, sets, names in _sets(batches, k):
            node = np.array(names, np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(node, mask=sizes == 0), pa.array(sizes), pa.array([_sketch(s) for s in sets], pa.list_(pa.int64()))],
                                             ["doc_id", "node", "n", "sketch"])
    return run


def _buckets(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each shingle: bits that do not decide its place in the order."""
    return (mix(shingles) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _prefixes(batches, k: int, percent: int, hot: np.ndarray) -> Iterator:
    """(shingles of the ordered prefixes, their buckets, (node, n, prefix length, thousandths that are common) of each set): each set once a part.
    Shingles of the buckets ``hot`` are common and come last, the others by hash: one order for all sets."""
    for _, sets, names in _sets(batches, k):
        seen, parts, heads = set(), [], []
        for s, name in zip(sets, names):
            if not len(s) or name in seen:
                continue
            seen.add(name)
            with np.errstate(over="ignore"):
                bucket = _buckets(s)
            at = np.searchsorted(hot, bucket)
            at[at == len(hot)] = 0
            common = hot[at] == bucket if len(hot) else np.zeros(len(s), bool)
            p = _prefix(len(s), percent)
            first = s[~common][:p]
            parts.append(np.concatenate((first, s[common][:p - len(first)])))
            heads.append((int(np.uint64(name).view(np.int64)), len(s), p, 1000 * int(common.sum()) // len(s)))
        if parts:
            shingles = np.concatenate(parts)
            with np.errstate(over="ignore"):
                yield shingles, _buckets(shingles), heads


def _counts(k: int, percent: int, hot: np.ndarray):
    """(bucket, c): the entries of the ordered prefixes counted by bucket, part by part."""
    def run(batches):
        import pyarrow as pa

        for _, bucket, _ in _prefixes(batches, k, percent, hot):
            found, c = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(c.astype(np.int32))], ["bucket", "c"])
    return run


def _entries(k: int, percent: int, hot: np.ndarray, shared: np.ndarray):
    """Rows (col, node, n, pos, common) of the ordered prefixes, but for entries whose bucket the bitmap ``shared`` does not hold:
    they stand alone in their column."""
    def run(batches):
        import pyarrow as pa

        for shingles, bucket, heads in _prefixes(batches, k, percent, hot):
            reps = np.array([h[2] for h in heads])
            pos = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            slot = bucket & (64 * len(shared) - 1)
            kept = ((shared[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            of = np.repeat(np.arange(len(heads)), reps)[kept]
            head = [np.array([h[i] for h in heads], t)[of] for i, t in ((0, np.int64), (1, np.int32), (3, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(shingles[kept].view(np.int64)), pa.array(head[0]), pa.array(head[1]),
                                              pa.array(pos[kept].astype(np.int32)), pa.array(head[2])], ["col", "node", "n", "pos", "common"])
    return run


def _chosen(k: int, bits: np.ndarray):
    """(node, shingles) of the documents whose mark the filter lets through."""
    size = np.int64(len(bits) * 64 - 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            slot = batch.column(2).to_numpy() & size
            batch = batch.filter(pa.array((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for _, sets, names in _sets([batch], k):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)),
                                                  pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])
    return run


def _packed(what: str, digits: int):
    """The values ``what`` of all elements e of the list x as one binary of big-endian numbers."""
    return F.expr(f"unhex(array_join(transform(x, e -> lpad(hex({what}), {digits}, '0')), ''))")


def _filter(marks: DataFrame) -> np.ndarray:
    """A bitmap of the marks' low bits, built by Spark and bounded in size whatever their number. Its words reach the
    driver packed by the thousand: a row each would take many times the bitmap's memory there."""
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (8 * marks.count()).bit_length()))
    words = (marks.select(F.shiftright(F.col("mark").bitwiseAND(F.lit(size - 1)), 6).alias("w"),
                          F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    blocks = (words.groupBy(F.expr(f"w div {WORDS}").alias("block")).agg(F.collect_list(F.struct("w", "b")).alias("x"))
              .select("block", _packed(f"e.w % {WORDS}", 4).alias("at"), _packed("e.b", 16).alias("b")))
    bits = np.zeros(size // 64, np.uint64)
    for block, at, b in blocks.collect():
        bits[block * WORDS + np.frombuffer(at, ">u2").astype(np.int64)] = np.frombuffer(b, ">u8")
    release()
    return bits


def _shingle_sets(docs: DataFrame, found: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of ``nodes``, from one document of each. A bitmap of those documents' ids lets
    nearly all others pass without a shuffle."""
    first = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    bits = _filter(first.select(F.xxhash64("doc_id").alias("mark")))
    marked = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("mark"))
    sets = marked.mapInArrow(_chosen(k, bits), "node long, shingles array<long>")
    return materialise(sets.dropDuplicates(["node"]), "shingles")  # a node once, however many copies the bitmap lets through


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _possible(a: str, b: str, percent: int):
    """Whether two entries of one column (prefixes a, b of their columns' names) can reach the threshold:
    the overlap is at most 1 + the shorter rest after the shared column."""
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return ((F.least(F.col(f"{a}n"), F.col(f"{b}n")) * 100 >= F.greatest(F.col(f"{a}n"), F.col(f"{b}n")) * percent)
            & (rest * (100 + percent) >= (F.col(f"{a}n") + F.col(f"{b}n")) * percent))


def _near(a, b, n, percent: int):
    """Whether sketches a and b allow sets of n elements together to reach the threshold."""
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH)), F.lit(0))
    return differ * (100 + percent) <= n * (100 - percent)


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    u = sketches.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    v = sketches.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    return (pairs.join(u, "u").join(v, "v").where(_near(F.col("su"), F.col("sv"), F.col("nu") + F.col("nv"), percent)).select("u", "v"))


def _links(pairs: DataFrame, docs: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the threshold. Only the sets of ``pairs`` are read and moved."""
    sets = _shingle_sets(docs, found, _ends(pairs), k)
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    out = materialise(pairs.join(left, "u").join(right, "v").withColumn("o", both)
                      .where(F.col("o") * 100 >= (F.size("su") + F.size("sv") - F.col("o")) * percent).select("u", "v").distinct(), "links")
    discard(sets)
    return out


def _pair(a: str, b: str):
    return F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).alias("x")


def _open_columns(entries: DataFrame, label: DataFrame) -> DataFrame:
    """The entries of columns whose nodes are in several components, with ``component`` and the
    column's largest one as ``main``. Pairs with a column's pivot are settled, so the pivot is left out."""
    column = Window.partitionBy("col")
    found = (entries.where("m > 2 and node != p_node").join(label, "node", "left")
             .withColumn("component", F.coalesce("component", "node"))
             .withColumn("lo", F.min("component").over(column)).withColumn("hi", F.max("component").over(column))
             .where("lo != hi").select("col", "node", "n", "pos", "m", "component"))
    found = materialise(found, "open")
    main = (found.groupBy("col", "component").count().groupBy("col")
            .agg(F.max(F.struct("count", "component")).alias("x")).select("col", F.col("x.component").alias("main")))
    return found.join(main, "col")


def jaccard_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``df``.

    ``component_id`` is the smallest id reachable over links of Jaccard similarity
    ``percent``/100 or more between sets of ``k``-word shingles. Null and empty texts
    have the empty set: size 0, linked with nothing, their own id. Repeated rows each
    come out; a null id takes part and is ignored as a name. An empty table gives
    an empty result. Shingles are compared by 64-bit hashes.
    """
    docs = documents(df, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = materialise(docs.mapInArrow(_describe(k), f"doc_id {kind}, node long, n long, sketch array<long>"), "sets")
    # buckets of the columns' hashes, counted: common ones order the columns, single ones drop entries before they are shuffled
    none = np.zeros(0, np.int64)
    hot = (docs.mapInArrow(_counts(k, percent, none), "bucket int, c int").groupBy("bucket").agg(F.sum("c").alias("c"))
           .where(F.col("c") > HOT_AT).orderBy(F.desc("c"), "bucket").limit(HOT_COLUMNS)
           .agg(F.collect_list("bucket").alias("x")).select(_packed("e", 8)).first()[0])
    hot = np.sort(np.frombuffer(hot, ">u4").astype(np.int64))
    several = materialise(docs.mapInArrow(_counts(k, percent, hot), "bucket int, c int").groupBy("bucket").agg(F.sum("c").alias("c"))
                          .where("c > 1").select(F.col("bucket").cast("long").alias("mark")), "several")
    shared = _filter(several)
    discard(several)

    column = Window.partitionBy("col")
    entries = (docs.mapInArrow(_entries(k, percent, hot, shared), "col long, node long, n int, pos int, common int")
               .repartition("col").dropDuplicates(["col", "node"])
               .withColumn("m", F.count("*").over(column))
               .withColumn("pivot", F.max(F.struct("common", (-F.col("n")).alias("less"), "node", "n", "pos")).over(column))
               .where("m > 1")
               .select("col", "node", "n", "pos", "m", F.col("pivot.node").alias("p_node"),
                       F.col("pivot.n").alias("p_n"), F.col("pivot.pos").alias("p_pos")))
    entries = materialise(entries, "entries")

    sketches = materialise(found.join(entries.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
                           .select("node", "n", "sketch"), "sketches")
    stars = entries.where((F.col("node") != F.col("p_node")) & _possible("", "p_", percent))
    tried = materialise(stars.select(_pair("node", "p_node")).distinct().select("x.*"), "pairs")
    pairs = materialise(_plausible(tried, sketches, percent), "pairs")
    links = _links(pairs, docs, found, k, percent)
    label = connected_components(links)
    total = entries.count()
    for turn in range(ROUNDS):
        open_ = _open_columns(entries, label)
        outside, work = open_.where("component != main").agg(F.countDistinct("node"), F.sum(F.col("m").cast("double"))).first()
        if (work or 0) <= 8 * total:
            break
        # any node of the largest component, another one in each column and round
        pivot = F.max(F.struct(F.col("component") == F.col("main"), F.xxhash64("col", "node", F.lit(turn)), "node", "n", "pos")).over(column)
        more = (open_.withColumn("p", pivot).where("component != main")
                .select("*", F.col("p.node").alias("p_node"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"))
                .where(_possible("", "p_", percent)).select(_pair("node", "p_node")).distinct().select("x.*")
                .join(tried, ["u", "v"], "left_anti"))
        more = materialise(more, "pairs")
        tried = tried.unionByName(more)
        more = _links(materialise(_plausible(more, sketches, percent), "pairs"), docs, found, k, percent)
        links = links.unionByName(more)
        label = connected_components(links)
        if more.count() * 50 < outside:  # what is still outside hardly links to it
            break

    open_ = _open_columns(entries, label).join(sketches.select("node", "sketch"), "node")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rest = (open_.where("component != main").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("col", "block", *[F.col(c).alias(f"r_{c}") for c in ("node", "n", "pos", "component", "sketch")]))
    pairs = (open_.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).join(rest, ["col", "block"])
             .where((F.col("component") != F.col("r_component"))
                    & ((F.col("component") == F.col("main")) | (F.col("node") < F.col("r_node")))
                    & _possible("", "r_", percent) & _near(F.col("sketch"), F.col("r_sketch"), F.col("n") + F.col("r_n"), percent))
             .select(_pair("node", "r_node")).distinct().select("x.*").join(tried, ["u", "v"], "left_anti"))
    pairs = materialise(pairs, "pairs")
    links = links.unionByName(_links(pairs, docs, found, k, percent))
    label = materialise(connected_components(links), "labels")

    named = (found.select("doc_id", "node", "n").join(label, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    first = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("first"))
    return (named.join(first, "component", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id")))
