"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table for each feature and one for each chosen pair
of features; a document's score is the sigmoid of the sum of the table entries of its bins. Features of
whole texts are computed where the texts are; only the features of a bounded labelled sample reach the
driver, where the small tables are fitted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_chars", "log_words", "mean_word", "upper_share", "space_share", "digit_share", "mark_share", "bar_share",
    "odd_share", "bang_share", "line_words", "repeated_lines", "distinct_words", "repeated_pairs", "mark_end_share", "top_word_share",
)

#: At most so many labelled documents are used to fit (those with the smallest hashes of their id).
MOST_LABELLED = 20_000
BINS = 32
ROUNDS = 60
PAIR_ROUNDS = 20
PAIRS = 6
RATE = 0.15

_ODD = re.compile(r"[#*$%&|<>]")
_OTHER = re.compile(r"[\W\d_]+")
_MARKED = re.compile(r"[^\w\s]{2,}(?=\s|$)")


def text_features(text: str | None) -> list[float]:
    """Fixed-length description of a whole text; zeros for null, empty and blank ones."""
    text = text or ""
    ws = text.split()
    n, k = len(text), len(ws)
    if not k:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = Counter(ws)
    pairs = set(zip(ws, ws[1:]))
    squeezed = sum(map(len, ws))
    letters = len(_OTHER.sub("", text))
    digits = len(re.findall(r"\d", text))
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    return [
        math.log1p(n), math.log1p(k), squeezed / k, capitals / max(letters, 1), (n - squeezed) / n, digits / n,
        max(squeezed - letters - digits, 0) / squeezed, text.count("|") / k, len(_ODD.findall(text)) / k, text.count("!") / k,
        k / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), len(kinds) / k, 1 - len(pairs) / max(k - 1, 1),
        len(_MARKED.findall(text)) / k, max(kinds.values()) / k,
    ]


@dataclass
class Model:
    """Bin edges of each feature, and tables: (features, values by bin)."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[tuple[tuple[int, ...], np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: vectorised additions of table entries."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for which, values in self.tables:
            total += values[tuple(b[:, j] for j in which)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Model:
    """Fit on rows of features and labels 0/1. Without rows, or with one label only, the model is the (smoothed) share of 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return Model([np.zeros(0)] * x.shape[1], base, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Model(edges, base, [])
    b = model.bins(x)
    f = np.full(len(y), base)
    mains = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(rounds):
        for j, t in enumerate(mains):  # cyclic: a shallow tree of each feature in turn
            step = rate * _tree(b[:, j], _slopes(f, y), len(t))
            t += step
            f += step[b[:, j]]
    chosen = sorted(((_gain(b, f, y, i, j, edges), i, j) for i in range(len(edges)) for j in range(i)), reverse=True)[:pairs]
    tables = [((i, j), np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for _, i, j in chosen]
    for _ in range(pair_rounds):
        for (i, j), t in tables:
            step = rate * _pair_tree(b[:, i], b[:, j], _slopes(f, y), t.shape)
            t += step
            f += step[b[:, i], b[:, j]]
    model.tables = [((j,), t) for j, t in enumerate(mains)] + tables
    return model


def _slopes(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-f))
    return y - p, p * (1 - p)


def _tree(bin_of: np.ndarray, slopes, n: int, leaves: int = 4, ridge: float = 2.0) -> np.ndarray:
    """Newton steps of a tree of up to ``leaves`` leaves over ordered bins, as a table by bin."""
    g, h = (np.bincount(bin_of, s, n) for s in slopes)
    return _grown(np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()]), n, leaves, ridge)


def _grown(cg: np.ndarray, ch: np.ndarray, n: int, leaves: int, ridge: float) -> np.ndarray:
    parts = [(0, n)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            if p[1] - p[0] > 1:
                at = np.arange(p[0] + 1, p[1])
                gain = worth(p[0], at) + worth(at, p[1]) - worth(*p)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), p, int(at[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(n)
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(bi: np.ndarray, bj: np.ndarray, slopes, shape, ridge: float = 4.0) -> np.ndarray:
    """One cut of the first feature, and a cut of the second on each side of it."""
    g, h = (np.bincount(bi * shape[1] + bj, s, shape[0] * shape[1]).reshape(shape) for s in slopes)
    best, out = -1.0, np.zeros(shape)
    for cut in range(1, shape[0]):
        trial, gain = np.zeros(shape), 0.0
        for rows in (slice(0, cut), slice(cut, shape[0])):
            cg, ch = (np.concatenate([[0], m[rows].sum(0).cumsum()]) for m in (g, h))
            step = _grown(cg, ch, shape[1], 2, ridge)
            gain += float(step @ np.diff(cg))
            trial[rows] = step
        if gain > best:
            best, out = gain, trial
    return out


def _gain(b: np.ndarray, f: np.ndarray, y: np.ndarray, i: int, j: int, edges: list[np.ndarray]) -> float:
    """What a coarse table of the two features would still add."""
    shape = (len(edges[i]) + 1, len(edges[j]) + 1)
    coarse = lambda k, n: b[:, k] * 4 // max(n, 1)
    g, h = (np.bincount(coarse(i, shape[0]) * 4 + coarse(j, shape[1]), s, 16) for s in _slopes(f, y))
    return float((g**2 / (h + 4.0)).sum())


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x: array<double>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Fit on labelled documents that aren't held out; ids are taken by the smallest hash, ``most`` at most.

    Rows with a null id or label are not learned from. Where an id has several labels the largest counts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(known), "__id")
    x = features(sample, id_col="__id", text_col="__t").join(F.broadcast(known), F.col("id") == F.col("__id"))
    rows = sorted((r["id"], r["x"], r["__y"]) for r in x.select("id", "x", "__y").collect())  # ``most`` rows at most, short ones
    return fit(np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[2] for r in rows], float))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """(id, score) of every document; the model is a few thousand numbers and travels with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t.as_py()) for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], [id_col, out])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {out} double")


def with_score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``out``; rows stay where they are."""
    kind = docs.schema[text_col].dataType.simpleString()
    if kind != "string":
        raise TypeError(f"{text_col} is {kind}")

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(out, scored(F.col(text_col)))


def op2_quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The contract's columns. Null and empty texts have all-zero features and are scored like any other."""
    model = fit_labelled(docs, labels)
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
