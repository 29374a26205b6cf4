"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed
character n-grams.

Each text's 1- to 3-grams of lower-cased characters (letters; everything else is one
space) are counted in a fixed number of buckets. Document frequencies come from all
learning documents by an aggregate over buckets; the weights from a bounded sample of
them by follow-the-regularised-leader with L1 and L2 penalties, which leaves most
weights zero; a temperature fitted on another part of the sample calibrates the
probabilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondflow.llm.common import GOLDEN, documents, materialise, mix

BUCKETS = 1 << 14
SAMPLE_ROWS = 6_000        # most learning documents the weights are fitted on, shared out over the languages
CALIBRATION = 5            # every fifth of them only calibrates
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 0.1
_CHUNK = 1 << 20           # characters hashed at a time


class Grams:
    """Bucket counts of a text's character n-grams."""

    def __init__(self):
        # letters of the basic plane keep their own code; others become a space
        self.letter = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(1 << 16)])

    def counts(self, text: str) -> np.ndarray | None:
        """Counts per bucket, or None without a letter."""
        total, any_letter, lower = None, False, text.lower()
        for at in range(0, len(lower), _CHUNK):
            part = lower[max(at - 2, 0):at + _CHUNK]  # two characters again, for the n-grams across the cut
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            good = np.ones(len(code), bool)
            small = code < (1 << 16)
            good[small] = self.letter[code[small]]
            if not small.all():
                good[~small] = [chr(c).isalpha() for c in code[~small].tolist()]
            any_letter |= bool(good.any())
            code = np.where(good, code, 32).astype(np.uint64) + np.uint64(1)
            code = code[(code != 33) | np.concatenate(([True], code[:-1] != 33))]
            seen = np.zeros(BUCKETS, np.int64)
            run = np.zeros(len(code), np.uint64)
            for n in (1, 2, 3):
                if len(code) < n:
                    break
                run = run[:len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1:]
                seen += np.bincount((mix(run * GOLDEN + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            total = seen if total is None else total + seen
        return total if any_letter else None


def _frequencies(batches):
    """(bucket, df) sums of one task's learning documents."""
    import pyarrow as pa

    grams, found = Grams(), np.zeros(BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = grams.counts(text)
                if counts is not None:
                    found += counts > 0
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["bucket", "df"])


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(float(np.sqrt((x * x).sum())), 1e-12)


def _vectors(idf: np.ndarray):
    """(mark, lang, at, x) of (mark, lang, text): each row's own label beside its vector."""
    def run(batches):
        import pyarrow as pa

        grams = Grams()
        for batch in batches:
            rows, at, x = [], [], []
            with np.errstate(over="ignore"):
                for i, text in enumerate(batch.column(2).to_pylist()):
                    counts = grams.counts(text)
                    if counts is not None:
                        a, v = _vector(counts, idf)
                        rows.append(i)
                        at.append(a.astype(np.int32))
                        x.append(v.astype(np.float32))
            kept = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(at, pa.list_(pa.int32())),
                                              pa.array(x, pa.list_(pa.float32()))], ["mark", "lang", "at", "x"])
    return run


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights (buckets by classes) and the temperature, from (buckets, values, class) rows."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    learn = [r for i, r in enumerate(rows) if i % CALIBRATION or len(rows) < 10]
    rest = [r for i, r in enumerate(rows) if not i % CALIBRATION] or rows
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            at, x, y = learn[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
            z[at] += g - root / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS))
    scores = np.array([x @ w[at] for at, x, _ in rest]) if rest else np.zeros((0, classes))
    wanted = np.array([y for _, _, y in rest], int)

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), wanted]).mean())

    grid = np.geomspace(0.05, 20, 60)
    return w, float(grid[int(np.argmin([loss(t) for t in grid]))]) if len(rest) else 1.0


def _predict(w: np.ndarray, temperature: float, idf: np.ndarray, classes: list[str]):
    def run(batches):
        import pyarrow as pa

        grams = Grams()
        for batch in batches:
            names, scores = [], []
            with np.errstate(over="ignore"):
                for text in batch.column(1).to_pylist():
                    counts = grams.counts(text)
                    if counts is None or not classes:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    at, x = _vector(counts, idf)
                    s = x @ w[at] / temperature
                    p = np.exp(s - s.max())
                    names.append(classes[int(np.argmax(p))])
                    scores.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])
    return run


def identify(df: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of ``df``.

    Learns from the text and non-null ``lang`` of rows whose id satisfies ``learn`` (a function of
    the id column): document frequencies over all of them, weights on at most about
    ``sample_rows`` (of every language those whose hash of id, language and text is smallest). Rows that share an id, or have none, are
    learned from each with its own text and label. A null or empty text,
    or one without a letter, is ``und`` with score 0, as is everything where nothing can be learned. Repeated
    rows are predicted each; an empty table gives an empty result.
    """
    docs = documents(df, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull())
    known = known.where(learn(F.col("doc_id")))
    sums = known.select("text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    classes = sorted(sizes)
    found = np.zeros(BUCKETS)
    found[sums["bucket"].to_numpy(np.int64)] = sums["df"].to_numpy(float)
    idf = np.log((1 + sum(sizes.values())) / (1 + found)) + 1
    rows = []
    if classes:
        each = max(1, sample_rows // len(classes))
        # a row's mark is the hash of its id, language and text: rows that share an id stay apart, each with its own label
        marked = known.select(F.xxhash64("doc_id", "lang", "text").alias("mark"), "lang", "text")
        place = F.pmod("mark", F.lit(1 << 30)) / (1 << 30)
        share = F.lit(0.0)
        for name, count in sizes.items():
            share = F.when(F.col("lang") == name, min(1.0, each / count)).otherwise(share)
        vectors = marked.where(place < share).mapInArrow(_vectors(idf), "mark long, lang string, at array<int>, x array<float>")
        got = vectors.orderBy("mark", "lang").limit(2 * sample_rows).select("at", "x", "lang").toArrow()
        rows = [(a.values.to_numpy(), x.values.to_numpy(), classes.index(y.as_py()))  # views of the table, no copies
                for a, x, y in zip(*(got[c] for c in ("at", "x", "lang")))]
        del got
    w, temperature = fit(rows, max(len(classes), 1))
    learned = bool(rows)
    del rows
    return docs.mapInArrow(_predict(w, temperature, idf, classes if learned else []), f"doc_id {kind}, lang_pred string, score double")
