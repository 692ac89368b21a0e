"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import blocks, fresh, mix, release, sliced

#: The labelled sample: documents, how many of each language at least if it has them, and spans of each that are learned from.
SAMPLE_DOCS, SAMPLE_LANG, SAMPLE_SPANS = 2000, 64, 8
SLOTS = 1 << 17
_U = np.uint64
SPAN = 32


def _numerals() -> str:
    """The characters that \\w takes but that are neither letters nor decimal digits, as ½, ² and Ⅷ, as ranges of a character class; there are none above the first two planes."""
    odd = [i for i in range(0x20000) if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalnum() and not c.isalpha() and not c.isdecimal()]
    starts = [i for i, before in zip(odd, [-2, *odd]) if i != before + 1]
    ends = [i for i, after in zip(odd, [*odd[1:], 0]) if i + 1 != after]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


#: Runs of letters, of any script.
_WORD = re.compile(rf"[^\W\d_{_numerals()}]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def feature_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots of all words' features, and the word that each is of.

    Features: the whole word, its length, prefixes and suffixes of 1 to 3 letters, and
    the 2- and 3-grams of the word between < and >; all words are hashed at once.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(sizes)
    begin = end - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    found, of = [], []

    def add(kind: int, value: np.ndarray, who: np.ndarray) -> None:
        found.append((mix(value + _U(kind << 56)) >> _U(47)).astype(np.int64))
        of.append(who)

    with np.errstate(over="ignore"):
        coded = mix(codes)
        for k in (2, 3):
            gram = np.zeros(max(len(codes) - k + 1, 0), np.uint64)
            for j in range(k):
                gram = gram * _U(0xFF51AFD7ED558CCD) + coded[j : j + len(gram)]
            inside = owner[: len(gram)] == owner[k - 1 :]
            add(k, gram[inside], owner[: len(gram)][inside])
        head = tail = np.zeros(len(words), np.uint64)
        for k in (1, 2, 3):
            head = head * _U(0xC4CEB9FE1A85EC53) + coded[np.minimum(begin + k, end - 1)]
            tail = tail * _U(0xC4CEB9FE1A85EC53) + coded[np.maximum(end - 1 - k, begin)]
            add(10 + k, head, np.arange(len(words)))
            add(20 + k, tail, np.arange(len(words)))
        place = (np.arange(len(codes)) - begin[owner]).astype(np.uint64)
        total = np.concatenate([[_U(0)], np.cumsum(mix(codes + (place << _U(32))))])
        add(30, total[end] - total[begin], np.arange(len(words)))
        add(31, np.minimum(sizes, 14).astype(np.uint64), np.arange(len(words)))
    return np.concatenate(found), np.concatenate(of)


def _summed(values: np.ndarray, slots: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[slots, j], n) for j in range(values.shape[1])], axis=1)


@dataclass
class Field:
    """A fitted field: its labels, hashed feature weights, lexicon, transitions and start scores."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexical: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each label for each distinct word."""
        out = _summed(self.weights, *feature_slots(words), len(words))
        for i, word in enumerate(words):
            if (label := self.lexicon.get(word)) is not None:
                out[i, label] += self.lexical[label]
        return out


def _lexicon(words: list[list[str]], labels: np.ndarray, n: int) -> dict[str, int]:
    """Words of the sample that one label has at least 5 times and nine times in ten."""
    seen: dict[str, np.ndarray] = {}
    for text, label in zip(words, labels):
        for w in text:
            if w not in seen:
                seen[w] = np.zeros(n, np.int32)
            seen[w][label] += 1
    return {w: int(c.argmax()) for w, c in seen.items() if c.max() >= 5 and c.max() >= 0.9 * c.sum()}


def _passes(score: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over equally long chains: label marginals (n, t, k), and expected moves (k, k)."""
    n, t, k = score.shape
    emit = np.exp(score - score.max(axis=2, keepdims=True))
    step = np.exp(moves)
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    now = np.exp(start) * emit[:, 0]
    ahead[:, 0] = now = now / now.sum(axis=1, keepdims=True)
    for i in range(1, t):
        now = now @ step * emit[:, i]
        ahead[:, i] = now = now / now.sum(axis=1, keepdims=True)
    behind[:, -1] = now = np.full((n, k), 1.0 / k)
    expected = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        later = now * emit[:, i + 1]
        joint = ahead[:, i, :, None] * step * later[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        now = later @ step.T
        behind[:, i] = now = now / now.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both / both.sum(axis=2, keepdims=True), expected


def fit(texts: list[str], langs: list[str], rounds: int = 40, seed: int = 7) -> Field | None:
    """Fit the field on labelled texts; None if no text has a letter.

    Spans of the texts are joined two and two into chains of 2 * SPAN words, half
    of them of two languages, so that moves between languages are learned. The
    likelihood's gradient drives AdaGrad over all chains at once.
    """
    words = [words_of(t) for t in texts]
    kept = [i for i, w in enumerate(words) if w]
    if not kept:
        return None
    labels = sorted({langs[i] for i in kept})
    at = {x: i for i, x in enumerate(labels)}
    words, k = [words[i] for i in kept], len(labels)
    gold = np.array([at[langs[i]] for i in kept])
    lexicon = _lexicon(words, gold, k)
    ids: dict[str, int] = {}
    spans, span_gold = [], []
    for text, label in zip(words, gold):
        for i in range(0, len(text), SPAN):
            part = text[i : i + SPAN]
            part = (part * SPAN)[:SPAN]
            spans.append([ids.setdefault(w, len(ids)) for w in part])
            span_gold.append(label)
    spans, span_gold = np.array(spans), np.array(span_gold)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(spans))
    if len(order) % 2:
        order = np.append(order, order[0])
    # a third of the chains pair spans at random, the rest pair spans of one label
    same = order[np.argsort(span_gold[order], kind="stable")]
    cutoff = len(order) // 3 // 2 * 2
    order = np.concatenate([order[:cutoff], same[: len(order) - cutoff]]) if cutoff else same
    chains = spans[order].reshape(-1, 2 * SPAN)
    truth = np.repeat(span_gold[order], SPAN).reshape(-1, 2 * SPAN)
    vocabulary = list(ids)
    flat, owner = feature_slots(vocabulary)
    listed = np.array([lexicon.get(w, -1) for w in vocabulary])
    weights, lexical, moves, start = np.zeros((SLOTS, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k)
    sums = [np.full(x.shape, 1e-6) for x in (weights, lexical, moves, start)]
    onehot = np.eye(k)[truth]
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    scale = 1.0 / truth.size
    for _ in range(rounds):
        emit = _summed(weights, flat, owner, len(vocabulary))
        has = listed >= 0
        emit[has, listed[has]] += lexical[listed[has]]
        share, expected = _passes(emit[chains], moves, start)
        gap = (onehot - share).reshape(-1, k)
        by_word = np.stack([np.bincount(chains.ravel(), gap[:, j], len(vocabulary)) for j in range(k)], axis=1)
        steps = (
            np.stack([np.bincount(flat, by_word[owner, j], SLOTS) for j in range(k)], axis=1) * scale - 1e-6 * weights,
            np.bincount(listed[has], by_word[has, listed[has]], k) * scale - 1e-6 * lexical,
            (seen_moves - expected) * scale - 1e-6 * moves,
            (onehot[:, 0] - share[:, 0]).sum(axis=0) * scale - 1e-6 * start,
        )
        for value, total, grad in zip((weights, lexical, moves, start), sums, steps):
            total += grad**2
            value += 0.4 * grad / np.sqrt(total)
    return Field(labels, weights.astype(np.float32), lexicon, lexical, moves, start)


def marginal_sums(score: np.ndarray, begin: np.ndarray, field: Field, chunk: int = 64) -> np.ndarray:
    """Sum of the words' label marginals of each chain; chain i has the scores begin[i]:begin[i+1], one at least.

    Exact forward-backward, by parts: every chunk of words is first reduced to one
    matrix, all chunks at once; the chunks' matrices carry the messages along a
    chain; then all chunks are filled in at once.
    """
    k = len(field.labels)
    lengths = np.diff(begin)
    parts = -(-lengths // chunk)
    base = np.concatenate([[0], np.cumsum(parts)])
    owner = np.repeat(np.arange(len(lengths)), parts)
    within = np.arange(base[-1]) - base[owner]
    at = (begin[owner] + within * chunk)[:, None] + np.arange(chunk)
    live = at < begin[owner + 1][:, None]
    emit = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    emit = emit[np.where(live, at, 0)]
    emit[~live] = 1.0
    step, eye = np.exp(field.moves), np.eye(k)
    whole = np.broadcast_to(eye, (len(owner), k, k)).copy()
    for i in range(chunk):
        on = live[:, i]
        moved = whole[on] @ step * emit[on, i][:, None, :]
        whole[on] = moved / moved.max(axis=(1, 2), keepdims=True)
    # the first word of a chain has the start scores in the place of a move
    entry = np.exp(field.start) @ np.linalg.pinv(step)
    ahead, behind = np.empty((len(owner), k)), np.empty((len(owner), k))
    by_length = np.argsort(-parts, kind="stable")
    order = parts[by_length]
    now = np.broadcast_to(entry, (len(lengths), k)).copy()
    for i in range(int(order[0])):
        rows = by_length[: np.searchsorted(-order, -i, side="left")]
        ahead[base[rows] + i] = now[rows]
        moved = np.einsum("nk,nkj->nj", now[rows], whole[base[rows] + i])
        now[rows] = moved / np.abs(moved).max(axis=1, keepdims=True)
    now = np.ones((len(lengths), k))
    for i in range(int(order[0])):
        rows = by_length[: np.searchsorted(-order, -i, side="left")]
        last = base[rows + 1] - 1 - i
        behind[last] = now[rows]
        moved = np.einsum("nkj,nj->nk", whole[last], now[rows])
        now[rows] = moved / moved.max(axis=1, keepdims=True)
    first = within == 0
    messages = np.empty((len(owner), chunk, k))
    now = ahead
    for i in range(chunk):
        on = live[:, i]
        moved = now @ step * emit[:, i]
        if i == 0:
            moved[first] = np.exp(field.start) * emit[first, 0]
        moved /= moved.max(axis=1, keepdims=True)
        now = np.where(on[:, None], moved, now)
        messages[:, i] = now
    total = np.zeros((len(owner), k))
    now = behind
    for i in range(chunk - 1, -1, -1):
        on = live[:, i]
        both = messages[:, i] * now
        total[on] += (both / both.sum(axis=1, keepdims=True))[on]
        moved = (now * emit[:, i]) @ step.T
        now = np.where(on[:, None], moved / moved.max(axis=1, keepdims=True), now)
    return np.add.reduceat(total, base[:-1], axis=0)


class Labeller:
    """Document languages by a fitted field; remembers the scores of up to `most` words."""

    def __init__(self, field: Field | None, most: int = 200_000):
        self.field, self.most = field, most
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(field.labels) if field else 0), np.float32)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if self.field is None:
            return out
        if len(self.ids) > self.most:
            self.ids.clear()
            self.scores = self.scores[:0]
        found = [words_of(t) if t else [] for t in texts]
        rows = [i for i, w in enumerate(found) if w]
        if not rows:
            return out
        new = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in self.ids]
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            self.scores = np.concatenate([self.scores, self.field.emissions(new).astype(np.float32)])
        begin = np.concatenate([[0], np.cumsum([len(found[i]) for i in rows])])
        flat = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(found)), np.int64, int(begin[-1]))
        share = marginal_sums(self.scores[flat], begin, self.field) / np.diff(begin)[:, None]
        for i, s in zip(rows, share):
            best = int(s.argmax())
            out[i] = (self.field.labels[best], float(min(1.0, max(0.0, s[best]))))
        return out


def _predictor(model):
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(model.value)
        for column in texts:
            found: list[tuple[str, float]] = []
            for start in range(0, len(column), 256):
                part = column.slice(start, 256).to_pylist()
                for begin, end in blocks([t or "" for t in part], 1 << 20):
                    found += labeller(part[begin:end])
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.StructArray.from_arrays(made, names=["lang_pred", "score"])
        release()

    # as not deterministic, so that a filter on the result doesn't run it twice
    return F.arrow_udf(predict, "lang_pred string, score double").asNondeterministic()


def spread(text: str, key: str, spans: int = SAMPLE_SPANS) -> str:
    """Words of `spans` spans of SPAN words, hashed uniformly over the whole text, in its order; all words if there are no more."""
    words = words_of(text)
    n = -(-len(words) // SPAN)
    if n > spans:
        with np.errstate(over="ignore"):
            drawn = mix(np.arange(1, n + 1, dtype=np.uint64) + (_U(zlib.crc32(key.encode("utf-8", "replace"))) << _U(32)))
        words = [w for i in np.sort(np.argsort(drawn, kind="stable")[:spans]).tolist() for w in words[i * SPAN : (i + 1) * SPAN]]
    return " ".join(words)


def _spreading(batches):
    for batch in sliced(batches):
        texts = [spread(t, i or "") for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(texts, pa.string())], names=["id", "lang", "text"])


def _by_language(rows: DataFrame, most: int, least: int) -> DataFrame:
    """Of (id, text, lang), about `most` rows in proportion to each lang's, but `least` of each lang if it has them: those of least hash.

    Only rows whose hash is below a bound for about twice as many are ranked.
    """
    rows = rows.withColumn("_hash", F.xxhash64("id", "text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    quota = {lang: min(n, max(least, round(most * n / total))) for lang, n in counts.items()}

    def below(whole: set) -> DataFrame:
        bounds = [(lang, q, 2**63 - 1 if lang in whole or counts[lang] <= 4 * q else int(-(2**63) + 2**64 * 2 * q / counts[lang])) for lang, q in quota.items()]
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, "lang string, _quota long, _bound long")), "lang").where("_hash <= _bound")

    few = below(set())
    held = {r["lang"]: r["n"] for r in few.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if lacking := {lang for lang, q in quota.items() if held.get(lang, 0) < q}:  # rows repeat, so that their hashes do
        few = below(lacking)
    ranked = few.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_hash", "id", "text")))
    return ranked.where("_rank <= _quota").select("id", "text", "lang")


def train(labelled: DataFrame, most: int = SAMPLE_DOCS) -> Field | None:
    """Fit on a sample of labelled (doc_id, text, lang) that holds every lang: about `most` rows, and SAMPLE_LANG of each lang if it has them.

    Of each sampled row SAMPLE_SPANS spans, drawn over its whole text on the executors, are learned from, so the driver holds a bounded
    number of words a row; rows with a null text or lang are no examples.
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    chosen = _by_language(rows, most, SAMPLE_LANG).mapInArrow(_spreading, "id string, lang string, text string").orderBy("id", "lang", "text").collect()
    return fit([r["text"] for r in chosen], [r["lang"] for r in chosen])


def said(docs: DataFrame, field: Field | None, name: str) -> DataFrame:
    """Add the struct column `name`, of lang_pred and score, to docs: the language with the greatest mean word marginal over the whole text.

    A null text, or one without a letter, and every text when nothing was learned,
    is `und` with score 0. Texts are taken in blocks, a long one whole, and memory is bounded by the longest. All columns
    are kept; `name` must be new.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)
    return docs.withColumn(name, _predictor(model)("text"))


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """Add lang_pred and score to docs, as `said`; columns so named are replaced, repeated rows stay, an empty table gives no rows."""
    docs = docs.drop("lang_pred", "score")
    name = fresh(docs, "_said")
    return said(docs, field, name).select(*docs.columns, f"{name}.lang_pred", f"{name}.score")
