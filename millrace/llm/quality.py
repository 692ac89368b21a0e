"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, cut, mix, raw, release, sampled, word_hashes

_U = np.uint64
#: Bound of the labelled rows that are learned from.
SAMPLE_ROWS = 20_000
NAMES = ("words", "length", "upper", "letters", "symbols", "bang", "bar", "digits", "stops", "distinct", "repeats", "triples", "fives", "lines", "top", "short")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC0:] = True  # first bytes of letters beyond ASCII, mostly
_SPACE = _class(" \t\n\r\x0b\x0c")
_SETS = (_UPPER, _LETTER, _class("#$%&*+=<>@^_~{}[]\\/"), _class("!"), _class("|"), _class("0123456789"), _class(".?"), _SPACE)


def _shares(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each owner, distinct ones, and the count of the commonest."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[new], np.diff(np.append(new, len(keys))))
    return np.bincount(owner, minlength=n), np.bincount(owner[new], minlength=n), most


def features(texts: list[bytes]) -> np.ndarray:
    """(n, len(NAMES)) float32 features of whole texts; an empty text has zeros."""
    n = len(texts)
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, n)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    counts = np.stack([np.add.reduceat(mask[data], begin[:-1], dtype=np.int64) for mask in _SETS], axis=1)
    counts[:, -1] -= 1
    follow = np.add.reduceat((data & 0xC0) == 0x80, begin[:-1], dtype=np.int64)
    with np.errstate(over="ignore"):
        hashes, first = word_hashes(texts)
        words = np.diff(first)
        owner = np.repeat(np.arange(n), words)
        total, distinct, most = _shares(hashes, owner, n)
        repeats = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(owner) else np.zeros(n)
        grams = []
        for k in (3, 5):
            key = np.zeros(max(len(hashes) - k + 1, 0), _U)
            for j in range(k):
                key = key * _U(0xFF51AFD7ED558CCD) + hashes[j : j + len(key)]
            inside = owner[: len(key)] == owner[k - 1 :]
            grams.append(_shares(key[inside], owner[: len(key)][inside], n)[:2])
        lines = np.flatnonzero(data == 10)
        # a line's key is the hash of its words, so that its place doesn't matter
        word_line = np.searchsorted(lines, _word_starts(data))
        keys = np.zeros(len(lines), _U)
        np.add.at(keys, word_line, mix(hashes))
        line_owner = np.searchsorted(begin, lines, side="right") - 1
        full = keys != 0
        all_lines, own_lines, _ = _shares(keys[full], line_owner[full], n)
    upper, letters, symbols, bang, bar, digits, stops, spaces = counts.T
    solid = np.maximum(size - follow - spaces, 1)
    some = np.maximum(words, 1)
    out = np.stack([
        np.log1p(words), solid / some, upper / np.maximum(letters, 1), letters / solid, symbols / solid, bang / solid, bar / solid, digits / solid, stops / some,
        distinct / some, repeats / some, 1 - grams[0][1] / np.maximum(grams[0][0], 1), 1 - grams[1][1] / np.maximum(grams[1][0], 1), 1 - own_lines / np.maximum(all_lines, 1), most / some, spaces / some,
    ], axis=1)
    out[size == 0] = 0
    return out.astype(np.float32)


def _word_starts(data: np.ndarray) -> np.ndarray:
    blank = _SPACE[data]
    return np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))


@dataclass
class Additive:
    """Bin edges, an intercept, a table for each feature and a grid for each chosen pair."""

    edges: list[np.ndarray]
    intercept: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: table entries are added, then squashed."""
        at = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j in range(at.shape[1]):
            total += self.tables[j, at[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a row of bins in two: its gain, and the first bin on the right."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    at = int(gains.argmax())
    return float(gains[at] - _gain(g.sum(), h.sum())), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values by bin of a shallow regression tree over one feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b]), a, b) for a, b in parts if b - a > 1), default=(0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, at, a, b = best
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a two-level tree over two features: a cut of one, then of the other on either side."""
    best, value = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _split(a.sum(axis=1), b.sum(axis=1))
        out, gain = np.zeros_like(a), 0.0
        for rows in (slice(0, at), slice(at, len(a))):
            x, y = a[rows].sum(axis=0), b[rows].sum(axis=0)
            _, cut_at = _split(x, y)
            for columns in (slice(0, cut_at), slice(cut_at, len(x))):
                gain += _gain(x[columns].sum(), y[columns].sum())
                out[rows, columns] = x[columns].sum() / (y[columns].sum() + 1.0)
        if gain > best:
            best, value = gain, out.T if turned else out
    return value


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, most_pairs: int = 6) -> Additive:
    """Fit by cyclic boosting: each round gives every feature one shallow tree, then every chosen pair one.

    Pairs are chosen by the gain of a two-level tree on what the features leave
    over. Without rows, or with one label only, the score is the smoothed share of label 1.
    """
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    share = (y.sum() + 0.5) / (n + 1.0)
    model = Additive(edges, float(np.log(share / (1 - share))), np.zeros((d, bins)), [], [])
    if not n or y.min() == y.max():
        return model
    at = model.bins(x)
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[:, j], g, bins), np.bincount(at[:, j], h, bins))
            model.tables[j] += step
            total += step[at[:, j]]
    g, h = slopes()
    gains = []
    for i, j in combinations(range(d), 2):
        cell = at[:, i] * bins + at[:, j]
        grid = _grid_tree(np.bincount(cell, g, bins * bins).reshape(bins, bins), np.bincount(cell, h, bins * bins).reshape(bins, bins)).ravel()
        gains.append((float((grid[cell] * g).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:most_pairs]]
    model.grids = [np.zeros((bins, bins)) for _ in model.pairs]
    for _ in range(rounds // 3):
        for (i, j), grid in zip(model.pairs, model.grids):
            g, h = slopes()
            cell = at[:, i] * bins + at[:, j]
            step = rate * _grid_tree(np.bincount(cell, g, bins * bins).reshape(bins, bins), np.bincount(cell, h, bins * bins).reshape(bins, bins))
            grid += step
            total += step.ravel()[cell]
    return model


def _measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        parts = []
        for start in range(0, len(column), 512):
            held = column.slice(start, 512).to_pylist()
            parts += [features(held[a:b]) for a, b in blocks(held)]
        values = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * len(NAMES)), pa.array(values))
    release()


def measure(docs: DataFrame) -> DataFrame:
    """Add `measured`, the features of each whole text (null: empty), to docs."""
    # as not deterministic, so that no use of the result runs it again
    return docs.withColumn("measured", F.arrow_udf(_measure, "array<float>").asNondeterministic()(raw(F.col("text"))))


def train(measured: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Additive:
    """Fit on a bounded sample: the `most` labelled rows of least hash of doc_id.

    labels has doc_id and quality (0 or 1); null labels are left out, repeated
    ones of a document count as their mean, 0.5 and more as 1.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    rows = measured.join(known, "doc_id").select("doc_id", "measured", "label")
    rows = sampled(rows, F.col("doc_id").cast("string"), most).orderBy("doc_id", "measured").collect()
    x = np.array([r["measured"] for r in rows], np.float32).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r["label"] for r in rows], float))


def _scorer(model):
    def score(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in rows:
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))
            yield pa.array(model.value.score(x), pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()


def apply(measured: DataFrame, model: Additive) -> DataFrame:
    """Replace `measured` by `score`, the probability of label 1."""
    shared = measured.sparkSession.sparkContext.broadcast(model)
    return measured.withColumn("score", _scorer(shared)("measured")).drop("measured")


def rate(docs: DataFrame, model: Additive, name: str = "score") -> DataFrame:
    """Add the score as column `name` to docs in one pass over each whole text (null: empty), with one Python worker a task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rated(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in _measure(texts):
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(NAMES))
            yield pa.array(shared.value.score(x), pa.float64())
        release()

    return docs.withColumn(name, F.arrow_udf(rated, "double").asNondeterministic()(raw(F.col("text"))))


def score(docs: DataFrame, labels: DataFrame, learns, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score) of every row of docs, learned from the labels of rows for which the Column `learns` holds.

    Texts are read once: their features, 16 numbers a row, are checkpointed, and
    both the sample and the scores are taken from these. A null text is empty and is scored like an empty one. A null doc_id
    is scored and never learned from. Repeated rows are scored each; an empty table gives no rows.
    """
    measured = cut(measure(docs.select("doc_id", "text")).drop("text"))
    return apply(measured, train(measured.where(learns), labels, most))
