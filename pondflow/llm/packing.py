"""Best-fit packing: best-fit decreasing over all documents, planned on the histogram of lengths.

Best-fit decreasing looks only at lengths, so equal pieces are placed together: with the open
bins kept by remaining capacity, a segment tree finds the tightest one that still holds
a length in logarithmic time, and the bin goes on taking pieces of that length until it is too
full, exactly as it would one by one. The plan is a table of runs (length, ranks, bins); its size depends
on the capacity alone, so the driver never holds more than that, whatever the corpus.

On Spark, texts are encoded and cut into pieces in one pass; every task numbers its pieces of each
length; prefix sums over the tasks make these numbers ranks in the corpus, and a piece's
rank looks up its place in the plan. Pieces of one length may be a third of all rows: their numbers come from
the tasks that made them, so no group of them is ever gathered.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pondflow.llm.common import documents, materialise

SLICE_CHARS = 1_000_000  # characters encoded at a time
RANK_BITS = 48           # a rank within one length; the length stands above them

# The byte-level BPE's split pattern and its printable stand-ins for bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """A tokenizers file in one task. A plain byte-level BPE without normaliser is run by tiktoken on the same
    vocabulary, which gives the same ids several times faster; every other model, and texts that hold
    the string of an added token, go through the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel"
                 and not split.get("add_prefix_space") and split.get("use_regex", True)
                 and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")))
        if not plain:
            return None
        stand = {chr(b): b for b in SHOWN}
        hidden = [b for b in range(256) if b not in set(SHOWN)]
        stand.update({chr(256 + i): b for i, b in enumerate(hidden)})
        added = {t["content"] for t in spec.get("added_tokens") or ()}
        ranks = {bytes(stand[c] for c in word): i for word, i in model["vocab"].items() if word not in added}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"].get(a + b, -1) for a, b in merged]
        if order != sorted(set(order)) or len(ranks) != 256 + len(order) or order[:1] < [256]:
            return None  # merges in another order than ids: ranks would merge otherwise
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, texts: list[str]) -> list[list[int]]:
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return [self._library.encode(t, add_special_tokens=False).ids for t in texts]

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self._slow(texts)
        out = []
        for t in texts:
            if any(a in t for a in self.added):
                out += self._slow([t])
                continue
            try:
                out.append(self.fast.encode_ordinary(t))
            except ValueError:  # the pattern's stack on a very long run of white space
                out += self._slow([t])
        return out


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum([0] + [len(t) for t in texts.to_pylist()])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE_CHARS, "right")) - 1)
                rows, piece, start, length, ids = [], [], [], [], []
                for i, found in enumerate(encoder.ids(texts.slice(at, stop - at).to_pylist()), at):
                    found.append(end)
                    raw = np.array(found, "<u4").tobytes()
                    head = len(found) % capacity or min(len(found), capacity)
                    cuts = [0, *range(head, len(found) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(raw[4 * a:4 * b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])
                at = stop
    return run


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the pieces of every row of ``df``.

    A document's tokens are its text's ids without special tokens and one ``end`` id; documents of more than
    ``capacity`` tokens are cut so that only the first piece may be shorter. ``ids`` are little-endian
    unsigned 32-bit numbers. Null and empty texts are the end id alone; repeated rows and ids are documents of their own;
    an empty table gives no pieces. ``tokenizer_path`` must exist on every executor.
    """
    docs = documents(df, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_pieces(tokenizer_path, capacity, end), f"doc_id {kind}, piece int, start long, length long, ids binary")


class Tightest:
    """A segment tree over remaining capacities 0..capacity: the least one not below a length that has an open bin."""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1).bit_length()
        self.any = bytearray(2 * self.width)

    def mark(self, room: int, used: bool) -> None:
        at = room + self.width
        self.any[at] = used
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def find(self, length: int) -> int | None:
        """Up to the first right-hand neighbour that has a bin, then down to its leftmost leaf."""
        at = length + self.width
        if self.any[at]:
            return length
        while at > 1 and (at & 1 or not self.any[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.width:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.width


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces in each bin, offset in the bin) of the best-fit decreasing packing
    of ``histogram[length]`` pieces of each length into bins of ``capacity``, by length and rank.

    Bins filled alike are one group (first bin, bins). A length splits at most two groups and opens at most two, so
    there are at most 4 * capacity groups, and a bin holds at most sqrt(2 * capacity) different lengths.
    """
    tree, groups = Tightest(capacity), {}
    runs, opened = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if bins:
            groups.setdefault(room, []).append((first, bins))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                bins = -(-left // (capacity // length))
                put(capacity, opened, bins)
                opened, room = opened + bins, capacity
            first, bins = groups[room].pop()
            if not groups[room]:
                tree.mark(room, False)
            each = room // length
            full = min(bins, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = left if full < bins else 0
            if rest:
                runs.append((length, rank, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
                left, full = 0, full + 1
            put(room, first + full, bins - full)
    return sorted(runs)


def _numbered(names: list[str], length: str):
    """Appends (task, number of the row among the task's rows of its length)."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            lengths = batch.column(names.index(length)).to_numpy()
            order = np.argsort(lengths, kind="stable")
            values, at, counts = np.unique(lengths[order], return_index=True, return_counts=True)
            number = np.empty(len(lengths), np.int64)
            number[order] = np.arange(len(lengths)) - np.repeat(at - [seen.get(v, 0) for v in values.tolist()], counts)
            for v, c in zip(values.tolist(), counts.tolist()):
                seen[v] = seen.get(v, 0) + c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), task, np.int32)), pa.array(number)],
                                             [*names, "_task", "_number"])
    return run


def _placed(runs: np.ndarray, names: list[str], length: str):
    """Replaces (_rank) by (sequence_id, offset)."""
    key = (runs[:, 0] << RANK_BITS) | runs[:, 1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size, rank = batch.column(names.index(length)).to_numpy(), batch.column(len(names)).to_numpy()
            r = runs[np.searchsorted(key, (size << RANK_BITS) | rank, "right") - 1]
            nth = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(r[:, 2] + nth // r[:, 3]), pa.array(r[:, 4] + nth % r[:, 3] * size)],
                                             [*names, "sequence_id", "offset"])
    return run


def best_fit(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with (sequence_id, offset): its place in a best-fit decreasing packing of all rows.

    ``length`` is a long from 1 to ``capacity``; rows without one (null) or of another length are an error,
    as they have no place. Sequences are numbered from 0 and gapless; equal lengths are interchangeable, so their order
    is the order of the tasks that read them. An empty table gives an empty result. Columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "_task", "_number", "_rank")
    names = pieces.columns
    sized = pieces.withColumn(length, F.when(F.col(length).between(1, capacity), F.col(length).cast("long")).otherwise(
        F.raise_error(F.lit(f"a length outside 1 to {capacity} has no place"))))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema)
    rows = materialise(sized.mapInArrow(_numbered(names, length), f"{kept}, _task int, _number long"), "pieces")
    counts = materialise(rows.groupBy("_task", F.col(length).alias("_length")).agg(F.count("*").alias("n")), "counts")
    total = {r["_length"]: r["n"] for r in counts.groupBy("_length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    runs = np.array(plan_runs(total, capacity), np.int64).reshape(-1, 5)
    before = Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    bases = counts.select("_task", "_length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = (rows.withColumnRenamed(length, "_length").join(bases, ["_task", "_length"])
              .select(*[F.col("_length" if c == length else c).alias(c) for c in names], (F.col("_base") + F.col("_number")).alias("_rank")))
    return ranked.mapInArrow(_placed(runs, names, length), f"{kept}, sequence_id long, offset long")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the sequences themselves, from placed pieces with their ids; ``documents`` lists
    (offset, doc_id, piece) in order. A sequence has at most ``capacity`` tokens, so its group is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return (placed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
                    F.expr("transform(p, x -> struct(x.offset, x.doc_id, x.piece))").alias("documents")))
