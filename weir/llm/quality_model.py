"""Operator 6, quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

1. Every text is measured once: a vector of document statistics, written to the shared folder.
2. The labelled vectors (a bounded sample) are standardised and mapped by random Fourier features, which
   approximate a Gaussian kernel; each partition sums its part of the normal equations, and the driver solves
   one system of `features` unknowns.
3. Scores of the training rows, counted in bins, are calibrated by isotonic regression.
4. Every vector is scored.

The text is read once and never shuffled; only the vectors (a few dozen numbers a row) join the labels.

Cases: null text counts as empty, which has statistics and so a score; rows without a label or with a null
one don't train; a document labelled twice trains twice; with no labels, or one class alone, every score is
the share of class 1 (0.5 with none); repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import bounded_sample
from .shared import map_column, materialize, text_rows

STATISTICS = (
    "log_words", "log_chars", "word_length", "distinct_words", "next_word_equal", "repeated_triples", "symbol_share", "pipe_share",
    "digit_share", "upper_share", "stop_share", "comma_share", "other_share", "line_words", "repeated_lines", "closed_lines", "non_ascii", "top_word",
)


@dataclass(frozen=True)
class QualitySetup:
    """Bounds and constants of training."""

    max_rows: int = 40_000  # labelled rows that training reads
    partitions: int = 16  # partial sums that meet on the driver, each features² numbers
    features: int = 192
    width: float = 3.0  # of the Gaussian kernel, in standard deviations
    ridge: float = 1e-3  # of the number of rows
    bins: int = 400
    seed: int = 7


def _classes() -> np.ndarray:
    """Byte -> class: 0 letters, 1 symbols, 2 pipes, 3 digits, 4 upper case, 5 sentence ends, 6 commas, 7 other marks, 8 space, 9 beyond ASCII."""
    out = np.full(256, 9, dtype=np.int64)
    out[:128] = 7
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", 0), ("#*$%&<>@^~=+_\\{}[]", 1), ("|", 2), ("0123456789", 3), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4), (".!?", 5), (",;:", 6), (" \t\n\r\x0b\x0c", 8)):
        for c in chars:
            out[ord(c)] = kind
    return out


KIND = _classes()


def measure(text: str) -> list[float]:
    """The STATISTICS of one text; linear in its length."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    kinds = np.bincount(KIND, weights=by_byte, minlength=10)
    words = text.split()
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    chars = max(1.0, len(raw) - kinds[8])
    m = max(1, n)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    closed = sum(x.rstrip()[-1] in ".!?" for x in lines)
    common = max(counts.values(), default=0)
    return [
        np.log1p(n), np.log1p(len(raw)), min(40.0, chars / m), len(counts) / m, sum(map(eq, words, words[1:])) / m, 1 - triples / max(1, n - 2) if n > 2 else 0.0,
        kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, kinds[5] / m, kinds[6] / m, kinds[7] / chars,
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), closed / max(1, len(lines)), kinds[9] / chars, common / m,
    ]


def measure_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, x (array<float> of STATISTICS) and the carried columns for each row."""

    def start():
        return lambda values: {"x": pa.array([np.asarray(measure(t or ""), dtype=np.float32) for t in values], pa.list_(pa.float32()))}

    return map_column(text_rows(docs, doc_id, text, carry), "text", start, "x array<float>")


class QualityModel:
    """Small and of fixed size: standardisation, random features, weights and calibration steps."""

    def __init__(self, mean, spread, w, b, weights, steps, levels, constant=None):
        self.mean, self.spread, self.w, self.b, self.weights, self.steps, self.levels, self.constant = mean, spread, w, b, weights, steps, levels, constant

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2.0 / len(self.b)) * np.cos(z @ self.w + self.b), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), self.steps, self.levels), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values in weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def train(measured: DataFrame, labels: DataFrame, setup: QualitySetup = QualitySetup()) -> QualityModel:
    """measured: (doc_id, x); labels: (doc_id, label 0 or 1). Null labels don't train."""
    labelled = measured.select("doc_id", "x").join(labels.filter(F.col("label").isNotNull()).select("doc_id", F.col("label").cast("double").alias("y")), "doc_id")
    rows = materialize(bounded_sample(labelled, "doc_id", setup.max_rows).repartition(setup.partitions), "quality-rows")
    k = len(STATISTICS)
    head = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(f(F.col("x")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not head["n"] or head["y"] in (0.0, 1.0):
        return QualityModel(None, None, None, None, None, None, None, constant=0.5 if not head["n"] else head["y"])
    rng = np.random.default_rng(setup.seed)
    model = QualityModel(
        np.array([head[f"m{i}"] for i in range(k)]), np.array([max(1e-6, head[f"s{i}"]) for i in range(k)]),
        rng.standard_normal((k, setup.features)) / setup.width, rng.uniform(0, 2 * np.pi, setup.features), None, None, None,
    )
    d = setup.features + k + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zz, zy, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            if len(batch):
                z = model.lift(np.stack(batch["x"].to_numpy()).astype(np.float64))
                zz += z.T @ z
                zy += z.T @ batch["y"].to_numpy()
                n += len(batch)
        if n:
            yield pd.DataFrame({"zz": [zz.tobytes()], "zy": [zy.tobytes()], "n": [n]})

    zz, zy, n = np.zeros((d, d)), np.zeros(d), 0
    for r in rows.select("x", "y").mapInPandas(partial, "zz binary, zy binary, n long").toLocalIterator():
        zz += np.frombuffer(r["zz"]).reshape(d, d)
        zy += np.frombuffer(r["zy"])
        n += r["n"]
    model.weights = np.linalg.solve(zz + setup.ridge * n * np.eye(d), zy)
    fitted = score_documents(rows.select("y", "x"), model, raw=True)
    bins = fitted.groupBy(F.round(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "score")) * (setup.bins / 2)).alias("bin")).agg(F.avg("y").alias("y"), F.avg("score").alias("at"), F.count("*").alias("n")).orderBy("bin").collect()
    # a whisper of both classes at the ends, so that no score is certain
    level = isotonic(np.array([(r["y"] * r["n"] + head["y"]) / (r["n"] + 1) for r in bins]), np.array([float(r["n"] + 1) for r in bins]))
    model.steps, model.levels = np.array([r["at"] for r in bins]), level
    return model


def score_documents(measured: DataFrame, model: QualityModel, raw: bool = False) -> DataFrame:
    """measured with a score in place of x."""

    def start():
        f = model.raw if raw else model.score
        return lambda values: {"score": pa.array(f(np.array(values, dtype=np.float64).reshape(-1, len(STATISTICS))), pa.float64())}

    return map_column(measured, "x", start, "score double")
