"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document's strength is a linear function of features of its whole text. Pairs of a
labelled good and a labelled bad document are preferences; the logistic loss on
their feature difference is minimised by Newton steps. The cut is the quantile of
the learning documents' strengths at their share of bad labels, and the score is the
logistic function of a strength's distance from the cut.

Features come from one pass over the texts in numpy (Arrow batches); only the
bounded learning sample's features reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondflow.llm.common import bounded_sample, documents, materialise, release, string_buffers, text_slices
from pondflow.llm.shingles import Hasher

SAMPLE_ROWS = 20_000   # most labelled rows the model is fitted on
PAIRS = 200_000        # preference pairs drawn from them
SLICE = 1 << 20        # bytes of text described at a time
RIDGE = 1e-3

FEATURES = ("log_bytes", "upper", "symbol", "mark", "digit", "other_space", "non_ascii", "word_bytes", "line_bytes", "log_lines",
            "distinct_words", "distinct_lines", "loud_lines", "symbol_lines", "symbol_max", "loud_max", "end_marks", "starts")

_B = np.arange(256)
_UPPER = ((_B >= 65) & (_B <= 90))
_LETTER = _UPPER | ((_B >= 97) & (_B <= 122))
_DIGIT = (_B >= 48) & (_B <= 57)
_MARK = np.isin(_B, [ord(c) for c in ".,;:'\"-()?!"])
_SYMBOL = (_B > 32) & (_B < 127) & ~_LETTER & ~_DIGIT & ~np.isin(_B, [ord(c) for c in ".,;:'\"-()?"])
_SPACES = (_B < 32) & (_B != 10)
CLASSES = [_UPPER, _LETTER, _SYMBOL, _MARK, _DIGIT, _SPACES, _B >= 128, (_B == 32) | _SPACES | (_B == 10)]


def _line_features(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per line (bytes, count of each class); ``ends``: where lines end in ``raw``."""
    starts = np.concatenate(([0], ends[:-1]))
    out = np.zeros((len(ends), len(CLASSES) + 1))
    out[:, 0] = ends - starts
    for c, table in enumerate(CLASSES):
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(table[raw], dtype=np.int32, out=total[1:])
        out[:, c + 1] = total[ends] - total[starts]
    return out


def features_of(raw: np.ndarray, offsets: np.ndarray, hasher: Hasher, line_hasher: Hasher) -> np.ndarray:
    """A row of FEATURES for each document of a batch of UTF-8 texts."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    words, first = hasher.words(raw, offsets)
    lines, first_line = line_hasher.words(raw, offsets)
    for i in range(n):
        text = raw[offsets[i]:offsets[i + 1]]
        if not len(text):
            continue
        ends = np.flatnonzero(text == 10) + 1
        if not len(ends) or ends[-1] < len(text):
            ends = np.append(ends, len(text))
        by_line = _line_features(text, ends)
        by_line = by_line[by_line[:, 0] > 1] if (by_line[:, 0] > 1).any() else by_line
        size, upper, letter, symbol, mark, digit, odd, wide, space = by_line.sum(axis=0)
        shares = by_line[:, 3] / by_line[:, 0]
        loud = by_line[:, 1] / np.maximum(by_line[:, 2], 1)
        w, ln = words[first[i]:first[i + 1]], lines[first_line[i]:first_line[i + 1]]
        k = max(len(w), 1)
        out[i] = (np.log1p(len(text)), upper / max(letter, 1), symbol / size, mark / size, digit / size, odd / size, wide / size,
                  np.log1p((size - space) / k), np.log1p(size / len(by_line)), np.log1p(len(by_line)),
                  np.log1p(len(np.unique(w))) - np.log1p(len(w)), len(np.unique(ln)) / max(len(ln), 1),
                  by_line[loud > 0.5, 0].sum() / size, by_line[shares > 0.08, 0].sum() / size, shares.max(), loud.max(),
                  symbol / k, upper / k)
    return out


def _describe(batches):
    import pyarrow as pa

    newline = np.zeros(256, bool)
    newline[10] = True
    hasher, line_hasher = Hasher(), Hasher(newline)
    for whole in batches:
        for batch in text_slices(whole, 1, SLICE):
            raw, offsets = string_buffers(batch.column(1))
            with np.errstate(over="ignore"):
                x = features_of(raw, offsets, hasher, line_hasher).astype(np.float32)
            flat = pa.array(x.ravel())
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, flat), *batch.columns[2:]], ["doc_id", "x", *batch.schema.names[2:]])
    release()


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> dict:
    """Weights, centre, scale and cut from features and 0/1 labels; without both classes every score is 0.5."""
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    flat = {"w": np.zeros(d), "mid": np.zeros(d), "scale": np.ones(d), "cut": 0.0}
    yes, no = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(yes) or not len(no):
        return flat
    mid, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mid) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    diff = z[yes[draw.integers(0, len(yes), pairs)]] - z[no[draw.integers(0, len(no), pairs)]]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance given to the wrong order
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d), diff.T @ p / pairs - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    strength = np.sort(z @ w)
    at = round(len(no) / len(x) * len(strength))
    cut = (strength[max(at - 1, 0)] + strength[min(at, len(strength) - 1)]) / 2
    return {"w": w, "mid": mid, "scale": scale, "cut": float(cut)}


def _scorer(model: dict):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            z = np.clip((x - model["mid"]) / model["scale"], -8, 8)
            score = 1 / (1 + np.exp(-np.clip(z @ model["w"] - model["cut"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])
    return run


def quality_scores(df: DataFrame, labels: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                   sample_rows: int = SAMPLE_ROWS, carry: str | None = None) -> DataFrame:
    """(doc_id, score, predicted): one row per row of ``df``; score in 0 to 1, predicted 1 from 0.5 on.

    ``labels`` has (``doc_id``, ``label``); rows whose label is 0 or 1 and whose id
    satisfies the condition ``learn`` (a function of the id column) are learned from, at most ``sample_rows``
    of them (those with the smallest hashes of their ids). Null and empty texts have
    all features 0 and get a score like any other. Without labels of both kinds
    every score is 0.5. Repeated rows are scored each; an empty table gives none. A column ``carry`` of ``df`` comes out, too.
    """
    docs = documents(df, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    also = f", {carry} {df.schema[carry].dataType.simpleString()}" if carry else ""
    if carry:
        docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), carry)
    features = materialise(docs.mapInArrow(_describe, f"doc_id {kind}, x array<float>{also}"), "features")
    marks = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("good"))
             .where("good in (0, 1)").where(learn(F.col("doc_id"))).dropDuplicates(["doc_id"]))
    known = features.select("doc_id", "x").join(bounded_sample(marks, "doc_id", sample_rows), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    x = np.array(known["x"].tolist(), float) if len(known) else np.zeros((0, len(FEATURES)))
    model = fit(x, known["good"].to_numpy())
    return (features.mapInArrow(_scorer(model), f"doc_id {kind}, score double{also}")
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))
