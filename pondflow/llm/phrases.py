"""Phrase collocation mining by top-order marginalisation.

Every word is the first of one window of ``longest`` words of its piece, padded with nulls where the piece ends.
Only these windows are counted; Spark's ROLLUP over the window's columns then sums them to the counts of
all shorter phrases, for a phrase occurs once as the beginning of each window that starts with it.

Windows are read off as lead columns of the word sequence, batch by batch, and added up
before they are shuffled. A phrase below the least count is of no use, nor is any longer one that holds
it, so padding may begin earlier: passes over 2, 3, ... words count hash buckets, and a window ends
before the first run of words whose bucket stays below the least count. That changes no count of a phrase
that reaches it, whatever collides, and leaves few distinct windows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pondflow.llm.common import GOLDEN, materialise, mix, string_buffers

SLICE = 2 << 20                 # bytes worked on at a time
BUCKET_BITS = 30                # buckets that runs of words are counted in
FILTER_BITS = (1 << 16, 1 << 26)  # fewest and most bits of a pass's bitmap (8 MB)
SALTS = 256                     # parts in which a language's phrases are ranked first

_BYTE = np.arange(256)
SPACE = (_BYTE == 32) | (_BYTE == 9)
MARK = np.isin(_BYTE, [ord(c) for c in ".,;:!?"]) | ((_BYTE >= 10) & (_BYTE <= 13))
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def _slices(raw: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about SLICE bytes that end where a document or, in a very long one, a piece ends."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + SLICE, end)
        if hi < end:
            whole = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if whole > lo:
                hi = whole
            else:
                stop = int(offsets[np.searchsorted(offsets, hi, "right")])
                while hi < stop:
                    found = np.flatnonzero(MARK[raw[hi:min(hi + SLICE, stop)]])
                    hi = hi + int(found[0]) + 1 if len(found) else min(hi + SLICE, stop)
                    if len(found):
                        break
        yield lo, hi
        lo = hi


class Words:
    """The words of one slice: where they begin and end, two hashes of each (with its language), and whether
    the next one follows in the same piece."""

    _value = [mix((LOWER.astype(np.uint64) + np.uint64(1 + 1000 * i)) * GOLDEN) | np.uint64(1) for i in (0, 1)]
    _power = [np.ones(1, np.uint64)] * 2

    def __init__(self, raw: np.ndarray, edges: np.ndarray, langs: np.ndarray):
        """``edges``: where the slice's documents begin; ``langs``: a number for each one's language."""
        mark = MARK[raw]
        inside = ~(mark | SPACE[raw])
        turn = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.begin, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        split = edges[(edges > 0) & (edges < len(raw))]
        split = split[inside[split] & inside[split - 1]]  # a document that ends in a word, the next begins with one
        if len(split):
            split = np.unique(split)
            self.begin, self.end = np.sort(np.append(self.begin, split)), np.sort(np.append(self.end, split))
        doc = np.searchsorted(edges, self.begin, "right") - 1
        pieces = np.cumsum(mark, dtype=np.int32)
        self.next = np.zeros(len(self.begin), bool)
        self.next[:-1] = (doc[1:] == doc[:-1]) & (pieces[self.begin[1:]] == pieces[self.begin[:-1]])
        self.raw = raw
        size = self.end - self.begin
        first = np.cumsum(size) - size
        within = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first, size).astype(np.int32)
        letters = raw[inside]
        lang = langs[doc]
        self.hash = [mix(np.add.reduceat(v[letters] * self._powers(i, int(size.max()))[within], first) + lang * GOLDEN)
                     if len(first) else np.zeros(0, np.uint64) for i, v in enumerate(self._value)]

    @classmethod
    def _powers(cls, i: int, n: int) -> np.ndarray:
        if len(cls._power[i]) < n:
            base = np.full(max(n, 64), (0xA24BAED4963EE407, 0x9FB21C651E98DF25)[i], np.uint64)
            base[0] = 1
            cls._power[i] = np.multiply.accumulate(base)
        return cls._power[i]

    def reach(self, bits: list[np.ndarray]):
        """For every number of words k from 2 on, one more than there are bitmaps: whether the k words from here on are in one
        piece and all shorter runs in them pass the bitmaps, their bucket, and whether they pass their own bitmap, if any."""
        run, ok = self.hash[0], self.next
        for k in range(2, len(bits) + 3):
            run = mix(run[:-1] * GOLDEN + self.hash[0][k - 1:])
            ok = ok[:len(run)]
            bucket = (run >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            passed = ok
            if k - 2 < len(bits):
                words = bits[k - 2]
                slot = bucket & (64 * len(words) - 1)
                passed = ok & ((words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            yield ok, bucket, passed
            ok = passed[:-1] & passed[1:]

    def names(self):
        """(number of every word among the slice's distinct ones, their texts as an Arrow array)."""
        import pyarrow as pa

        key = self.hash[0]
        _, at, number = np.unique(key, return_index=True, return_inverse=True)
        if (self.hash[1][at][number] != self.hash[1]).any():  # two words with one hash: tell them apart by both
            key = np.rec.fromarrays(self.hash)
            _, at, number = np.unique(key, return_index=True, return_inverse=True)
        size = (self.end - self.begin)[at]
        offs = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(offs[-1]) + np.repeat(self.begin[at] - offs[:-1], size)
        texts = pa.StringArray.from_buffers(len(at), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(LOWER[self.raw[take]]))
        return number, texts, at


def _each(batch):
    """The Words of every slice of a batch of (lang, text), each with its documents' languages."""
    raw, offsets = string_buffers(batch.column(1))
    langs = batch.column(0).dictionary_encode()
    codes = langs.indices.to_numpy()
    numbers = np.array([zlib.crc32(x.encode()) for x in langs.dictionary.to_pylist()] or [0], np.uint64)
    for lo, hi in _slices(raw, offsets):
        a = np.searchsorted(offsets, lo, "right") - 1
        b = np.searchsorted(offsets, hi, "left")
        edges = offsets[a:b] - lo
        with np.errstate(over="ignore"):
            words = Words(raw[lo:hi], edges, numbers[codes[a:b]])
        if len(words.begin):
            yield words, edges, langs, codes[a:b]


def _buckets(bits: list[np.ndarray]):
    """(bucket, n): the runs of len(bits) + 2 words, counted by bucket slice by slice."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for words, *_ in _each(batch):
                with np.errstate(over="ignore"):
                    ok, bucket, _ = list(words.reach(bits))[-1]
                found, n = np.unique(bucket[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int32))], ["bucket", "n"])
    return run


def _windows(bits: list[np.ndarray], longest: int):
    """(lang, w1..wk, c): the padded windows, equal ones of a slice added up and in order."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for words, edges, langs, codes in _each(batch):
                number, texts, at = words.names()
                size = np.ones(len(number), np.int8)
                with np.errstate(over="ignore"):
                    for *_, passed in words.reach(bits):
                        size[:len(passed)] += passed
                # lead columns; 0 pads
                lead = np.zeros((len(number), longest), np.int32)
                for k in range(longest):
                    n = len(number) - k
                    lead[:n, k] = np.where(size[:n] > k, number[k:] + 1, 0)
                order = np.lexsort(lead.T[::-1])
                lead = lead[order]
                head = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]).any(axis=1))))
                count = np.diff(np.append(head, len(lead)))
                lead = lead[head]
                doc = np.searchsorted(edges, words.begin[at], "right") - 1  # of each distinct word: it names its language
                lang = langs.dictionary.take(pa.array(codes[doc][lead[:, 0] - 1]))
                columns = [texts.take(pa.array(lead[:, k] - 1, mask=lead[:, k] == 0)) for k in range(longest)]
                yield pa.RecordBatch.from_arrays([lang, *columns, pa.array(count)], ["lang", *_names(longest), "c"])
    return run


def _names(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def _bitmap(hot: DataFrame) -> np.ndarray:
    """The buckets ``hot.bucket`` as a bitmap on their low bits, its size bounded whatever their number."""
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (8 * hot.count()).bit_length()))
    words = (hot.select(F.shiftright(F.col("bucket").bitwiseAND(F.lit(size - 1)), 6).alias("w"),
                        F.expr("shiftleft(1L, cast(bucket & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    bits = np.zeros(size // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def phrase_counts(df: DataFrame, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, words, phrase, f): how often every phrase of 1 to ``longest`` words occurs within pieces, for those of ``least``
    or more; with words = 0 and an empty phrase, all word occurrences of a language.

    Texts are lower-cased (A-Z), cut in pieces at ``. , ; : ! ?`` and line ends, and pieces in words at spaces and tabs.
    A null text is empty, a null language ``und``; repeated rows count each; texts without words and empty tables give nothing.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bits: list[np.ndarray] = []
    for _ in range(2, longest):
        hot = materialise(docs.mapInArrow(_buckets(bits), "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n"))
                          .where(F.col("n") >= least).select("bucket"), "buckets")
        bits.append(_bitmap(hot))
    names = _names(longest)
    schema = "lang string, " + ", ".join(f"{w} string" for w in names) + ", c long"
    tops = docs.mapInArrow(_windows(bits, longest), schema).groupBy("lang", *names).agg(F.sum("c").alias("c"))
    sums = tops.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    last = F.coalesce(*[F.when(F.col("g") == (1 << (longest - k)) - 1, F.col(w)) for k, w in enumerate(names, 1)])
    words = F.lit(longest) - F.bit_count("g")
    rows = sums.where((F.col("g") == (1 << longest) - 1) | (last.isNotNull() & (F.col("f") >= least)))
    return rows.select("lang", words.cast("int").alias("words"), F.concat_ws(" ", *names).alias("phrase"), "f")


def collocations(df: DataFrame, longest: int = 4, least: int = 30, cover: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    ``a`` is a phrase's count, at least ``least``; the score is floor(2000000 a / (l + r)) for the cut in two parts of counts l and r
    where it is lowest (ties: after the fewest words); ``n`` counts the language's words. Phrases inside a longer one that
    has at least ``cover`` percent of their count are left out. Ranks go by score and count downwards, then by phrase. Arithmetic is
    in decimals, so no product overflows. Nulls and empty input as in ``phrase_counts``.
    """
    counts = materialise(phrase_counts(df, longest, least, text, lang), "phrases")
    phrases = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = counts.where("words > 0").select("lang", "phrase", "f")
    cuts = (phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .select("lang", F.col("phrase").alias("whole"), "words", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"),
                    F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("rest")))
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    big = "cast({} as decimal(20, 0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(2000000 * {big.format('a')} div ({big.format('l')} + {big.format('r')}) as long)"))
    scored = cuts.groupBy("lang", "whole").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", F.col("whole").alias("phrase"), "x.*")
    inner = (phrases.where("words > 2").select("lang", "a", "w", F.explode(F.expr("sequence(2, words - 1)")).alias("m"))
             .select("lang", "a", F.explode(F.expr("transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    free = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.expr(f"longer is null or 100 * {big.format('longer')} < {cover} * {big.format('a')}")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
