"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared when they share a run of ``min_match``
words: the runs' Karp-Rabin hashes (a rolling sum over word hashes) of all items are
the seeds, looked up for every run of every document. Neighbouring seeds on a diagonal make maximal
matches; the longest unmarked match is marked as a tile again and again, on both
sides, until none of ``min_match`` words is left. The tiles' share of the item's
words is its coverage, whatever their order, so reordered passages count in full.

The benchmark is cut into blocks of bounded size; each block's seeds go to the tasks
and all documents pass it once, so no document is shuffled and no pair is listed
unless it shares a seed.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondflow.llm.common import GOLDEN, documents, mix, row_key, string_buffers, without_rows
from pondflow.llm.shingles import NOT_WORD, Hasher, fold_latin

MIN_MATCH = 5
THRESHOLD = 0.6
BLOCK_CHARS = 8_000_000  # characters of benchmark items in one block


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of k words."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    for j in range(k):
        out += words[j:j + n] * weights[j]
    return mix(out)


def tiles(at: np.ndarray, item_at: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds: (document position, item position, words) of each tile.

    ``at`` and ``item_at`` are the positions of all shared runs of k words. Longer
    matches go first, ties by item then document position.
    """
    order = np.lexsort((at, at - item_at))
    at, item_at = at[order], item_at[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(at - item_at) != 0))))
    ends = np.append(new[1:], len(at))
    heap = [(-(int(e - s) + k - 1), int(item_at[s]), int(at[s])) for s, e in zip(new, ends)]
    heapq.heapify(heap)
    used, used_item, out = set(), set(), []
    while heap:
        length, p, t = heapq.heappop(heap)
        length = -length
        free = [t + i not in used and p + i not in used_item for i in range(length)]
        if all(free):
            out.append((t, p, length))
            used.update(range(t, t + length))
            used_item.update(range(p, p + length))
            continue
        i = 0
        while i < length:  # what earlier tiles have left of this match
            j = i
            while j < length and free[j]:
                j += 1
            if j - i >= k:
                heapq.heappush(heap, (-(j - i), p + i, t + i))
            i = j + 1
    return out


class _Block:
    """The seeds of one block of items, sorted by hash."""

    def __init__(self, ids: list, texts: list[str], k: int):
        self.k, self.ids = k, ids
        hasher = Hasher(NOT_WORD)
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        joined = fold_latin(np.concatenate(raw)) if raw else np.zeros(0, np.uint8)
        words, first = hasher.words(joined, offsets)
        seeds = [_runs(words[a:b], k) for a, b in zip(first[:-1], first[1:])]
        self.sizes = np.diff(first)
        hashes = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, int)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.bits = np.zeros(1 << 16, bool)  # which low 16 bits occur, to pass over most runs at once
        self.bits[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matches(self, words: np.ndarray):
        """(item index, tiles) for every item that shares a run with the document."""
        runs = _runs(words, self.k)
        at = np.flatnonzero(self.bits[(runs & np.uint64(0xFFFF)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, runs[at])
        hi = np.searchsorted(self.hashes, runs[at], "right")
        hit = hi > lo
        at, lo, hi = at[hit], lo[hit], hi[hit]
        if not len(at):
            return
        many = hi - lo
        seed = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, item, place = np.repeat(at, many), self.item[seed], self.place[seed]
        for i in np.unique(item).tolist():
            mine = item == i
            yield i, tiles(at[mine], place[mine], self.k)


def _compare(block: _Block, threshold: float):
    def run(batches):
        import pyarrow as pa

        hasher = Hasher(NOT_WORD)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            if not len(raw):
                continue
            doc, item, found = [], [], []
            with np.errstate(over="ignore"):
                low, high = int(offsets[0]), int(offsets[-1])
                words, first = hasher.words(fold_latin(raw[low:high]), offsets - low)
                for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    for j, t in block.matches(words[a:b]):
                        if sum(x[2] for x in t) >= threshold * block.sizes[j]:
                            doc.append(i)
                            item.append(j)
                            found.append(t)
            if doc:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array([block.ids[j] for j in item]),
                     pa.array([int(block.sizes[j]) for j in item], pa.int32()),
                     pa.array([[{"doc_word": t, "item_word": p, "words": n} for t, p, n in x] for x in found],
                              pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])))],
                    ["doc_id", "item_id", "item_words", "tiles"])
    return run


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_words, tiles, matched_words, coverage) for every document and
    item whose tiles cover ``threshold`` of the item's words or more.

    Words are runs of ASCII letters, digits and other bytes from 0x80 on, Latin capitals
    lower-cased. Items of fewer than ``min_match`` words, null and empty texts match
    nothing. Repeated rows of ``df`` each come out; repeated rows of ``benchmark`` count once.
    Empty tables give an empty result.
    """
    docs = documents(df, doc_id, text)
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, item_words int, tiles array<struct<doc_word: int, item_word: int, words: int>>"
    out = None
    for b in range(blocks):  # a block of the stated query set against all rows
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toPandas()
        with np.errstate(over="ignore"):
            block = _Block([None if i is None or i != i else int(i) for i in part["item_id"]], part["text"].tolist(), min_match)
        found = docs.mapInArrow(_compare(block, threshold), schema)
        out = found if out is None else out.unionByName(found)
    matched = F.aggregate("tiles", F.lit(0), lambda a, t: a + t["words"])
    return out.withColumn("matched_words", matched).withColumn("coverage", F.col("matched_words") / F.col("item_words"))


def clean_rows(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that hold no benchmark item, with all their columns. Each row is judged by its own text."""
    keyed = df.select(row_key(F.col(doc_id), F.col(text)).alias("doc_id"), F.col(text).alias("text"))
    return without_rows(df, contaminated(keyed, benchmark, **options).select(F.col("doc_id").alias("row_key")), doc_id, text)
