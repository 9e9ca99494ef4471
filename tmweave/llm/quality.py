"""Quality classifier: random Fourier features, ridge by partition sums, isotonic
calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import saved, table

FOURIER = 384                # random features
WIDTH = 4.0                  # kernel width in standard deviations of the statistics
RIDGE = 1e-3                 # penalty per training row
CLIP = 6.0                   # standardised statistics are kept within this
BINS = 2000                  # equal bins of the ridge score that calibration sums
THRESHOLD = 0.3
SEED = 7

# Byte classes of the statistics.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r\t",
           b".,;:?", b"!", b"&$%#*@", b"|", b"()[]{}<>", b"/\\_=+~^`", b"\"'-", bytes(range(128, 256)))
N_STATS = len(CLASSES) + 14


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text: sizes, shares of byte classes, words, repetition, lines."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if n else np.zeros(256)
    out = [counts[list(c)].sum() / max(n, 1) for c in CLASSES]
    words = text.split()
    w = len(words)
    freq = Counter(words)
    top = freq.most_common(1)[0][1] if w else 0
    lens = np.fromiter(map(len, words), float, w)
    lines = text.split("\n")
    share = counts[counts > 0] / max(n, 1)
    out += [
        math.log1p(n), math.log1p(w), lens.mean() if w else 0.0, lens.std() if w else 0.0,
        len(freq) / w if w else 0.0, top / w if w else 0.0,
        sum(map(str.__eq__, words, words[1:])) / w if w else 0.0,
        len(set(zip(words, words[1:], words[2:]))) / (w - 2) if w > 2 else 1.0,
        math.log(len(freq) + 1) / math.log(w + 2),
        sum(map(str.isupper, words)) / w if w else 0.0,
        sum(map(str.isalpha, words)) / w if w else 0.0,
        len(set(lines)) / len(lines), math.log1p(len(lines)),
        float(-(share * np.log(share)).sum()) if n else 0.0]
    return out


def _key(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id's text divisible by 5."""
    return _key(doc_id) % 5 == 0


def featurise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the statistics of every whole text (one pass, no shuffle)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [statistics(t) for t in b["t"]]})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<double>")


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["std"], -CLIP, CLIP)
    f = np.sqrt(2.0 / FOURIER) * np.cos(z @ model["omega"] + model["phase"])
    return np.hstack([f, np.ones((len(z), 1))])


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, N_STATS))


def pool(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) weighted least squares by pooling adjacent violators."""
    means: list[float] = []
    sizes: list[float] = []
    spans: list[int] = []
    for v, w in zip(value, weight):
        means.append(v), sizes.append(w), spans.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            total = sizes[-2] + sizes[-1]
            means[-2:] = [(means[-2] * sizes[-2] + means[-1] * sizes[-1]) / total]
            sizes[-2:] = [total]
            spans[-2:] = [spans[-2] + spans[-1]]
    return np.repeat(means, spans)


def fit(train: DataFrame) -> dict | None:
    """Model from ``x``, ``y`` (0 or 1) and ``fold``: folds 0 to 2 fit the ridge, fold 3 the
    calibration.  None without rows in the former.

    Every labelled row counts.  A partition sums its part of the normal equations; the sums
    meet by matrix row, so what the driver gets is FOURIER + 1 rows whatever the input, and
    for the calibration BINS rows.
    """
    rng = np.random.default_rng(SEED)
    base, cal = train.where("fold < 3"), train.where("fold = 3")
    moments = base.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{n}{i}")
                       for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return None
    std = np.array([moments[f"s{i}"] for i in range(N_STATS)])
    model = {"mean": np.array([moments[f"m{i}"] for i in range(N_STATS)]),
             "std": np.where(std > 1e-9, std, 1.0),
             "omega": rng.normal(size=(N_STATS, FOURIER)) / WIDTH,
             "phase": rng.uniform(0, 2 * math.pi, FOURIER)}
    size = FOURIER + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for p in batches:
            f, y = fourier(_matrix(p["x"]), model), p["y"].to_numpy(float)
            a += f.T @ f
            b += f.T @ y
        yield pd.DataFrame({"i": range(size), "v": [np.append(a[i], b[i]).tobytes() for i in range(size)]})

    def add(p: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, float) for v in p["v"])
        return pd.DataFrame({"i": [p["i"].iloc[0]], "v": [total.tobytes()]})

    parts = base.select("x", "y").mapInPandas(sums, "i int, v binary") \
        .groupBy("i").applyInPandas(add, "i int, v binary").toPandas().sort_values("i")
    full = np.stack([np.frombuffer(v, float) for v in parts["v"]])
    a, b = full[:, :-1], full[:, -1]
    penalty = RIDGE * moments["n"] * np.eye(size)
    penalty[-1, -1] = 1e-9
    model["weights"] = np.linalg.solve(a + penalty, b)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            s = fourier(_matrix(p["x"]), model) @ model["weights"]
            yield pd.DataFrame({"bin": np.clip((s + 0.5) / 2 * BINS, 0, BINS - 1).astype(int),
                                "s": s, "y": p["y"].to_numpy(float)})

    bins = cal.select("x", "y").mapInPandas(binned, "bin int, s double, y double").groupBy("bin").agg(
        F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")
    if len(bins):
        model["knots"] = bins["s"].to_numpy()
        model["levels"] = pool(bins["y"].to_numpy(), bins["n"].to_numpy(float))
    else:
        model["knots"], model["levels"] = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(features: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id`` and ``score``; 0.5 everywhere without a model."""
    if model is None:
        return features.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            s = fourier(_matrix(p["x"]), model) @ model["weights"]
            yield pd.DataFrame({"doc_id": p["doc_id"],
                                "score": np.clip(np.interp(s, model["knots"], model["levels"]), 0, 1)})

    return features.mapInPandas(run, f"doc_id {dict(features.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (probability of quality 1), ``predicted`` per row.

    ``labels``: ``doc_id``, ``quality``; null qualities and ids do not count; repeated ones each
    do.  Null and empty texts are scored as texts of size 0; repeated rows keep their rows;
    a null doc_id is scored and never learnt from; empty tables give an empty result (no
    labels: score 0.5); other columns are ignored.
    """
    features = saved(featurise(docs, text=text), "quality-x")
    return _scored(features, labels, threshold)


def _model(features: DataFrame, labels: DataFrame) -> dict | None:
    known = labels.select("doc_id", F.col("quality").alias("y")) \
        .where("doc_id is not null and y in (0, 1)")
    train = features.join(known.where(~held_out(F.col("doc_id"))), "doc_id")
    return fit(saved(train.select("x", "y", (_key(F.col("doc_id")) % 5 - 1).alias("fold")),
                     "quality-train"))


def _scored(features: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    return score(features, _model(features, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns kept.

    The model is fitted on statistics alone; then every row is judged by its own text where it
    lies, so that no text is joined or shuffled.
    """
    model = _model(saved(featurise(docs, text=text), "quality-x"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(len(b), 0.5)
            if model is not None and len(b):
                f = fourier(np.array([statistics(t.as_py()) for t in b.column(text)]), model)
                s = np.clip(np.interp(f @ model["weights"], model["knots"], model["levels"]), 0, 1)
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
