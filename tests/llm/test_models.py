"""The three trained models against plain second versions: the queries' scores, and the steps by which they are learned."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import class_lm, language_id, quality, queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
BLANK = b" \t\n\v\f\r"


def plain_words(data):
    found, now = [], bytearray()
    for b in data + b" ":
        if b in BLANK:
            if now:
                found.append(bytes(now))
            now = bytearray()
        else:
            now.append(b + 32 if 65 <= b <= 90 else b)
    return found


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_class_scores(spark, docs, monkeypatch):
    """op1's score, from the classes and counts that its fit gives: plain trigrams of classes, and plain emissions."""
    monkeypatch.setattr(class_lm, "HEAD", 300)  # most words are joined, not broadcast
    kept, whole = [], class_lm.classes
    monkeypatch.setattr(class_lm, "classes", lambda *a: kept.append(whole(*a)) or kept[-1])
    found = {r["doc_id"]: r["score"] for r in queries.op1_class_lm(spark, DATA).collect()}
    named, form_class = kept[0]
    with np.errstate(over="ignore"):
        texts = {r["doc_id"]: plain_words((r["text"] or "").encode()) for r in docs.collect()}
        every = sorted({w for t in texts.values() for w in t})
        keys, _, forms = class_lm.word_forms([b" ".join(every)], class_lm.FORMS)
    of, count, members, total = {}, {}, Counter(form_class.tolist()), Counter()
    rows = {r["word"]: r for r in named.collect()}
    for w, key, form in zip(every, keys.view(np.int64).tolist(), forms.tolist()):
        r = rows.get(key)
        of[w], count[w] = (r["klass"], r["n"]) if r else (int(form_class[form]), 0)
        if r:
            members[r["klass"]] += 1
            total[r["klass"]] += r["n"]
    learned = Counter(w for i, t in texts.items() if fold(i, 10) for w in t)
    assert {w: n for w, n in count.items() if n} == learned and 0 not in of.values()

    def chain(text):
        path = [of[w] for w in text] + [0]
        return [(0 if i < 2 else path[i - 2], path[i - 1] if i else 0, k) for i, k in enumerate(path)]

    three, two, one, after = Counter(), Counter(), Counter(), Counter()
    for i, text in texts.items():
        if fold(i, 10):
            for a, b, c in chain(text):
                three[a, b, c] += 1
                two[b, c] += 1
                one[c] += 1
                after[a, b] += 1
    before, n = Counter(), sum(one.values())
    for (b, _), x in two.items():
        before[b] += x

    def move(a, b, c):
        p = (one[c] + 0.5) / (n + 0.5 * class_lm.CLASSES)
        p = (two[b, c] + class_lm.LOWER * p) / (before[b] + class_lm.LOWER)
        return (three[a, b, c] + class_lm.LOWER * p) / (after[a, b] + class_lm.LOWER)

    for i, text in texts.items():
        score = sum(math.log10(move(*x)) for x in chain(text))
        score += sum(math.log10((count[w] + class_lm.WORD) / (total[of[w]] + class_lm.WORD * members[of[w]])) for w in text)
        assert math.isclose(found[i], score, rel_tol=1e-9)


def test_words_are_exchanged_by_rounds():
    """Each word goes to the class under which its neighbours' classes are likeliest, itself left out; rounds don't lose likelihood."""
    rng = np.random.default_rng(4)
    k = class_lm.CLASSES
    truth = rng.integers(1, 5, 60)
    kinds = rng.dirichlet(np.full(k, 0.05), (5, 2))
    around = np.stack([[rng.multinomial(n, kinds[t, side]) for side in (0, 1)] for t, n in zip(truth, rng.integers(1, 200, 60))]).astype(float)
    own = np.where(rng.random(60) < 0.4, rng.integers(1, 5, 60), truth)
    fits = []
    for _ in range(4):
        before, after = np.zeros((k, k)), np.zeros((k, k))
        for w in range(60):
            before[:, own[w]] += around[w, 0]
            after[own[w]] += around[w, 1]
        tables = class_lm.Tables(before, after)
        fits.append(tables.fit())
        expected = []
        for w in range(60):
            best = (-math.inf, 0)
            for c in range(1, k):
                b, a = before[:, c].copy(), after[c].copy()
                if c == own[w]:
                    b, a = b - around[w, 0], a - around[w, 1]
                size = b.sum() + around[w, 0].sum()
                value = sum(x * math.log(y + class_lm.FLOOR) for x, y in zip(around[w, 0], b)) + sum(x * math.log(y + class_lm.FLOOR) for x, y in zip(around[w, 1], a))
                value -= around[w, 0].sum() * (math.log(a.sum() + class_lm.FLOOR) + math.log(size))
                best = max(best, (value, -c))
            expected.append(-best[1])
        owner, cells = np.nonzero(around.reshape(60, -1))
        own = tables.choose(around.reshape(60, -1), cells, around.reshape(60, -1)[owner, cells], owner, own)
        assert own.tolist() == expected
    assert fits[0] < fits[1] and fits[-1] >= max(fits) - 1e-6


def test_words_are_gathered_over_batches():
    rng = np.random.default_rng(6)
    words = np.sort(rng.choice([-9, 3, 5, 8, 2**62], 60))
    rows = [Counter(rng.integers(0, 2 * class_lm.CLASSES, 5).tolist()) for _ in words]
    expected = defaultdict(Counter)
    for w, r in zip(words.tolist(), rows):
        expected[w] += r
    table = pa.table({"word": pa.array(words), "cells": pa.array([list(r) for r in rows], pa.list_(pa.int16())), "times": pa.array([list(r.values()) for r in rows], pa.list_(pa.int64()))})
    for size in (1, 2, 7, 60):
        made = [x for b in class_lm._gathered(table.to_batches(max_chunksize=size)) for x in b.to_pylist()]
        assert [x["word"] for x in made] == sorted(expected)
        assert all(dict(zip(x["cells"], x["times"])) == expected[x["word"]] for x in made)
    assert not list(class_lm._gathered(iter([])))


def test_words_that_occur_once_are_moved_as_all_others():
    rng = np.random.default_rng(7)
    rounds = [class_lm.Tables(*rng.integers(0, 50, (2, class_lm.CLASSES, class_lm.CLASSES)).astype(float)) for _ in range(3)]
    rows = [[[int(b), class_lm.CLASSES + int(a)], [1, 1]] for b, a in rng.integers(0, class_lm.CLASSES, (30, 2))] + [[[1, 2, class_lm.CLASSES], [1, 2, 3]]]
    batch = pa.record_batch({"word": pa.array(range(31), pa.int64()), "cells": pa.array([r[0][::-1] for r in rows], pa.list_(pa.int16())), "times": pa.array([r[1][::-1] for r in rows], pa.list_(pa.int64()))})
    (_, cells, times, owner, klass), = class_lm._chosen(iter([batch]), rounds)
    assert klass.tolist() == class_lm._moved(cells, times, owner, 31, rounds).tolist()


def plain_features(data):
    words = plain_words(data)
    if not data:
        return [0.0] * len(quality.NAMES)
    some = max(len(words), 1)
    spaces, follow = sum(b in BLANK for b in data), sum(128 <= b < 192 for b in data)
    solid = max(len(data) - follow - spaces, 1)
    upper = sum(65 <= b <= 90 for b in data)
    letters = upper + sum(97 <= b <= 122 or b >= 192 for b in data)
    grams = {k: [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] for k in (3, 5)}
    lines = [tuple(sorted(x)) for x in map(plain_words, data.split(b"\n")) if x]
    share = lambda found: 1 - len(set(found)) / max(len(found), 1)
    had = lambda chars: sum(b in chars for b in data)
    return [
        math.log1p(len(words)), solid / some, upper / max(letters, 1), letters / solid, had(b"#$%&*+=<>@^_~{}[]\\/") / solid, had(b"!") / solid, had(b"|") / solid,
        had(b"0123456789") / solid, had(b".?") / some, len(set(words)) / some, sum(a == b for a, b in zip(words, words[1:])) / some,
        share(grams[3]), share(grams[5]), share(lines), max(Counter(words).values(), default=0) / some, spaces / some,
    ]


def test_quality_scores(spark, docs):
    """op8's score: plain features of each whole text, looked up in the fitted tables one by one."""
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["quality"] is not None}
    learned = sorted(i for i in rows if i in labels and fold(i, 4) != 2)
    x = {i: np.array(plain_features(t), np.float32) for i, t in rows.items()}
    model = quality.fit(np.array([x[i] for i in learned]), np.array([labels[i] for i in learned], float))
    found = {r["doc_id"]: r for r in queries.op8_quality(spark, DATA).collect()}
    for i in rows:
        at = [sum(v >= e for e in edges) for v, edges in zip(x[i], model.edges)]
        total = model.intercept + sum(model.tables[j][b] for j, b in enumerate(at)) + sum(grid[at[a]][at[b]] for (a, b), grid in zip(model.pairs, model.grids))
        p = 1 / (1 + math.exp(-total))
        assert math.isclose(found[i]["score"], p, rel_tol=1e-6, abs_tol=1e-9)
        assert found[i]["predicted"] == (found[i]["score"] >= 0.7) and found[i]["held_out"] == (fold(i, 4) == 2)


def plain_boost(x, y, bins, rounds, rate, most_pairs):
    """Cyclic boosting by trying every cut; returns each row's log odds."""
    n, d = x.shape
    edges = [sorted(set(np.quantile(x[:, j], [i / bins for i in range(1, bins)]).tolist())) for j in range(d)]
    at = [[sum(v >= e for e in edges[j]) for j, v in enumerate(row)] for row in x]
    share = (sum(y) + 0.5) / (n + 1)
    total = [math.log(share / (1 - share))] * n

    def worth(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    def leaf(rows, g, h):
        return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)

    def cuts(rows, j, span, g, h):
        """Best cut of rows by feature j within the bins span: gain, the bin, both sides."""
        best = None
        for c in range(span[0] + 1, span[1]):
            left, right = [i for i in rows if at[i][j] < c], [i for i in rows if at[i][j] >= c]
            gain = worth(left, g, h) + worth(right, g, h)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, c, left, right)
        return best and (best[0] - worth(rows, g, h), *best[1:])

    def slopes():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]

    def tree(j):
        g, h = slopes()
        parts = [((0, bins), list(range(n)))]
        while len(parts) < 4:
            tried = [(cuts(rows, j, span, g, h), span, rows) for span, rows in parts if span[1] - span[0] > 1]
            best = max((t for t in tried if t[0]), key=lambda t: t[0][0], default=None)
            if not best or best[0][0] <= 1e-9:
                break
            (_, c, left, right), span, rows = best
            parts.remove((span, rows))
            parts += [((span[0], c), left), ((c, span[1]), right)]
        return [(leaf(rows, g, h), rows) for _, rows in parts]

    def grid(i, j):
        g, h = slopes()
        best = None
        for a, b in ((i, j), (j, i)):
            top = cuts(range(n), a, (0, bins), g, h)
            leaves = [rows for side in top[2:] for rows in cuts(side, b, (0, bins), g, h)[2:]]
            gain = sum(worth(rows, g, h) for rows in leaves)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, [(leaf(rows, g, h), rows) for rows in leaves])
        return g, best[1]

    def add(leaves):
        for value, rows in leaves:
            for i in rows:
                total[i] += rate * value

    for _ in range(rounds):
        for j in range(d):
            add(tree(j))
    ranked = []
    for i in range(d):
        for j in range(i + 1, d):
            g, leaves = grid(i, j)
            ranked.append((sum(v * g[r] for v, rows in leaves for r in rows), i, j))
    for _ in range(rounds // 3):
        for _, i, j in sorted(ranked, reverse=True)[:most_pairs]:
            add(grid(i, j)[1])
    return total


def test_boosting():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + 0.3 * rng.normal(size=150) > 0).astype(float)
    model = quality.fit(x, y, bins=6, rounds=9, rate=0.3, most_pairs=2)
    expected = [1 / (1 + math.exp(-t)) for t in plain_boost(x, y.tolist(), 6, 9, 0.3, 2)]
    assert np.allclose(model.score(x), expected, atol=1e-9)


def test_language_scores(spark, docs):
    """op9's language and score: runs of letters, one word's features at a time, forward-backward in logarithms over the whole text."""
    field = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    found = {r["doc_id"]: r for r in queries.op9_language(spark, DATA).collect()}
    k = len(field.labels)
    known = {}

    def emission(word):
        if word not in known:
            slots, owner = language_id.feature_slots([word])
            assert not owner.any()
            known[word] = [sum(float(field.weights[s, j]) for s in slots) + (field.lexical[j] if field.lexicon.get(word) == j else 0.0) for j in range(k)]
        return known[word]

    def log_sum(values):
        most = max(values)
        return most + math.log(sum(math.exp(v - most) for v in values))

    for r in docs.collect():
        text = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        emits = [emission(w) for w in text.split(" ") if w]
        if not emits:
            assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        ahead = [[field.start[j] + emits[0][j] for j in range(k)]]
        for e in emits[1:]:
            ahead.append([e[j] + log_sum([ahead[-1][i] + field.moves[i, j] for i in range(k)]) for j in range(k)])
        behind = [[0.0] * k]
        for e in emits[:0:-1]:
            behind.append([log_sum([field.moves[i, j] + e[j] + behind[-1][j] for j in range(k)]) for i in range(k)])
        whole, share = log_sum(ahead[-1]), [0.0] * k
        for a, b in zip(ahead, reversed(behind)):
            for j in range(k):
                share[j] += math.exp(a[j] + b[j] - whole) / len(emits)
        got = found[r["doc_id"]]
        assert math.isclose(got["score"], max(share), abs_tol=1e-4)
        assert math.isclose(share[field.labels.index(got["lang_pred"])], max(share), abs_tol=1e-4)


def test_marginals_and_moves_by_all_paths():
    rng = np.random.default_rng(5)
    score, moves, start = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    share, expected = np.zeros((2, 5, 3)), np.zeros((3, 3))
    for c in range(2):
        weight = defaultdict(float)
        for path in product(range(3), repeat=5):
            weight[path] = math.exp(start[path[0]] + sum(score[c, i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total = sum(weight.values())
        for path, w in weight.items():
            for i, k in enumerate(path):
                share[c, i, k] += w / total
            for a, b in zip(path, path[1:]):
                expected[a, b] += w / total
    got = language_id._passes(score, moves, start)
    assert np.allclose(got[0], share) and np.allclose(got[1], expected)
