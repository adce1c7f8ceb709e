"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each text are taken once. The random features approximate a Gaussian kernel; the ridge solution needs
only the sums X'X and X'y, which each task forms over its rows and Spark adds up by matrix row, so the fit reads all
labelled rows and the driver gets one small matrix. Calibration uses scores of folds left out of the fit.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.rules import STOP_WORDS
from meltemi.llm.shared import pruned, short_batches, trimmed, written

_STOP = frozenset(w.encode() for w in STOP_WORDS)
N_STATISTICS = 14
FOLDS = 4
BINS = 2048


def statistics(text: bytes) -> list[float]:
    """Length, character classes, repetition of words, word pairs and lines, stop words, compressibility."""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    part = lambda chars: float(n[np.frombuffer(chars, np.uint8)].sum()) / size
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    top = Counter(words).most_common(1)
    return [
        float(np.log1p(len(words))),
        min(20.0, (size - float(n[[32, 9, 10, 11, 12, 13]].sum())) / m),
        part(bytes(range(65, 91))),
        part(bytes(range(48, 58))),
        part(b"#*$%&|<>"),
        part(b"!?.,;:"),
        part(b"!"),
        float(n[128:].sum()) / size,
        len(set(words)) / m,
        len(set(zip(words, words[1:]))) / m,
        top[0][1] / m if top else 0.0,
        len(set(lines)) / max(1, len(lines)),
        sum(map(_STOP.__contains__, words)) / m,
        len(zlib.compress(text, 1)) / size,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and f array<double>; null text counts as empty, repeated rows stay."""

    def run(batches):
        for b in trimmed(batches):
            rows = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    return pruned(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind}, f array<double>")


@dataclass
class Model:
    """score() of rows of statistics; parts is None where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    parts: np.ndarray | None
    at: np.ndarray
    value: np.ndarray

    def features(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1]), np.ones((len(f), 1))])

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(f), self.value[0])
        return np.clip(np.interp(self.features(f) @ self.parts[-1], self.at, self.value), 0, 1)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y under weights w (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, k in zip(y, w):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(train: DataFrame, width: int = 128, length_scale: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """train: f array<double>, y 0 or 1, fold int below FOLDS. All its rows take part.

    The driver receives two sums per statistic, FOLDS * (width + 1) matrix rows and at most BINS counts.
    """
    sums = train.agg(F.count("*"), *[g(F.col("f")[i]) for i in range(N_STATISTICS) for g in (F.avg, F.stddev_pop)], F.avg("y")).first()
    rnd = np.random.default_rng(seed)
    omega, phase = rnd.normal(size=(N_STATISTICS, width)) / length_scale, rnd.uniform(0, 2 * np.pi, width)
    prior = sums[-1] if sums[0] else 0.5
    if not sums[0] or prior in (0.0, 1.0):
        zero = np.zeros(N_STATISTICS)
        return Model(zero, zero + 1, omega, phase, None, np.zeros(1), np.array([prior]))
    mean = np.array(sums[1:-1:2], float)
    scale = np.maximum(np.array(sums[2:-1:2], float), 1e-9)
    model = Model(mean, scale, omega, phase, None, np.zeros(1), np.array([prior]))
    d = width + 1

    def normal(batches):
        total = np.zeros((FOLDS, d, d + 1))
        for b in batches:
            x = model.features(np.vstack(b["f"].to_list())) if len(b) else np.zeros((0, d))
            y = b["y"].to_numpy(float)
            for k in range(FOLDS):
                m = b["fold"].to_numpy() == k
                total[k] += x[m].T @ np.column_stack([x[m], y[m]])
        for k in range(FOLDS):
            yield pd.DataFrame({"k": k * d + np.arange(d), "row": [r.tobytes() for r in total[k]]})

    def added(key, part):
        return pd.DataFrame({"k": [key[0]], "row": [np.sum([np.frombuffer(r) for r in part["row"]], axis=0).tobytes()]})

    schema = "k int, row binary"
    rows = train.select("f", "y", "fold").mapInPandas(normal, schema).groupBy("k").applyInPandas(added, schema).collect()
    total = np.zeros((FOLDS * d, d + 1))
    for r in rows:
        total[r.k] = np.frombuffer(r.row)
    total = total.reshape(FOLDS, d, d + 1)

    def solved(s):
        return np.linalg.solve(s[:, :d] + ridge * max(s[d - 1, d - 1], 1) * np.eye(d), s[:, d])

    model.parts = np.array([solved(total.sum(0) - total[k]) for k in range(FOLDS)] + [solved(total.sum(0))])

    def binned(batches):
        for b in batches:
            x = model.features(np.vstack(b["f"].to_list())) if len(b) else np.zeros((0, d))
            s = np.einsum("ij,ij->i", x, model.parts[b["fold"].to_numpy(int)])
            yield pd.DataFrame({"bin": np.clip((s + 0.5) / 2 * BINS, 0, BINS - 1).astype("int32"), "y": b["y"]})

    bins = train.select("f", "y", "fold").mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    got = sorted(map(tuple, bins.collect()))
    model.at = np.array([(b + 0.5) / BINS * 2 - 0.5 for b, _, _ in got])
    model.value = isotonic(np.array([y for _, _, y in got]), np.array([n for _, n, _ in got], float))
    return model


def fitted(docs: DataFrame, labels: DataFrame, label_col: str, held_out: str) -> tuple[Model, DataFrame]:
    """The model of the labelled rows that held_out doesn't name, and the statistics of all documents."""
    short_batches(docs.sparkSession)
    stats = written(with_statistics(docs), "statistics")
    y = pruned(labels, "doc_id", label_col).toDF("doc_id", "y").where(f"y in (0, 1) and not ({held_out})")
    fold = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FOLDS)).cast("int")
    train = written(stats.join(y, "doc_id").select("f", F.col("y").cast("double").alias("y"), fold.alias("fold")), "training")
    return fit(train), stats


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: str = "false", threshold: float = 0.5) -> DataFrame:
    """The documents that score at least threshold, as they are: each is scored where it stands, so no text is shuffled."""
    model, _ = fitted(docs, labels, label_col, held_out)
    at = docs.columns.index("text")

    def run(batches):
        for b in trimmed(batches):
            if len(b):
                rows = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(at)])
                yield b.filter(pa.array(model.score(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: str = "crc32(cast(doc_id as string)) % 3 = 1", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted (score >= threshold).

    held_out is an expression over doc_id; labels of such rows are never read. Null labels and ids don't train. Without
    labelled rows, or with those of one label only, the score is their mean, or 0.5. Repeated rows get equal scores.
    """
    model, stats = fitted(docs, labels, label_col, held_out)

    def run(batches):
        for b in batches:
            s = model.score(np.vstack(b.column(1).to_pylist())) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    out = stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.expr(f"coalesce({held_out}, false)").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
