"""Brown class-based n-grams: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, cut, raw, sliced, word_forms

_U = np.uint64
#: Classes; forms that stand for words outside the units; words and forms that are exchanged; words whose counts and classes are broadcast.
CLASSES, FORMS, UNITS, HEAD = 64, 255, 1024, 262_144
#: A word whose class comes by a join, in a sequence of classes.
RARE = 255
#: Pseudo-counts: of a word, and of the lower order in a class transition.
WORD, LOWER = 0.1, 4.0
#: Exchange over all words: rounds after the first choice at most, the least gain of a round in nats a word, and what a table's cell has at least.
ROUNDS, GAIN, FLOOR = 4, 0.001, 0.01


def _spread(batches):
    """Word counts of a task, summed before the shuffle; ends are word 0 of form -1."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def total():
        words, forms, counts = (np.concatenate(x) for x in zip(*held))
        keys, first, where = np.unique(words, return_index=True, return_inverse=True)
        held[:] = [(keys, forms[first], np.bincount(where, counts, len(keys)).astype(np.int64))]
        return len(keys)

    def emit():
        words, forms, counts = held.pop()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(forms), pa.array(counts)], names=["word", "form", "n"])

    for batch in sliced(batches):
        texts = batch.column("raw").to_pylist()
        for a, b in blocks(texts):
            with np.errstate(over="ignore"):
                hashes, _, forms = word_forms(texts[a:b], FORMS)
            keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            held += [(keys, forms[first], counts), (np.zeros(1, np.uint64), np.full(1, -1), np.array([b - a]))]
            size += len(keys)
            if size > 2_000_000:
                size = total()
                if size > 1_000_000:
                    yield emit()
                    size = 0
    if held:
        total()
        yield emit()


@dataclass
class Head:
    """The commonest words, sorted by hash: counts, units (or -1) and classes (or -1: not known yet, that of the word's form)."""

    words: np.ndarray
    counts: np.ndarray
    unit: np.ndarray
    klass: np.ndarray
    form_class: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


def _sequences(texts: list[bytes]):
    """Distinct words of some texts, their forms, and the texts as one sequence of places, -1 for each end."""
    with np.errstate(over="ignore"):
        hashes, first, forms = word_forms(texts, FORMS)
    keys, at, where = np.unique(hashes, return_index=True, return_inverse=True)
    n = np.diff(first)
    tokens = np.full(len(hashes) + len(texts), -1)
    ends = np.cumsum(n + 1) - 1
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = where
    return keys, forms[at], tokens, ends, np.repeat(np.arange(len(texts)), n + 1)


def _unit_counter(shared):
    """Bigram counts of a task over units, as (cell, n)."""

    def count(batches):
        head = shared.value
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in sliced(batches):
            texts = batch.column("raw").to_pylist()
            for a, b in blocks(texts):
                keys, forms, tokens, _, _ = _sequences(texts[a:b])
                at = head.find(keys)
                unit = np.where((at >= 0) & (head.unit[at] >= 0), head.unit[at], 1 + forms) if len(head.words) else 1 + forms
                path = np.append(unit, 0)[tokens]
                before = np.append(0, path[:-1])
                total += np.bincount(before * UNITS + path, minlength=UNITS * UNITS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    return count


def _neighbours(shared, most: int = 2_000_000):
    """Classes before (cell < CLASSES) and after every word that isn't a unit, as (word, cells, times) summed in the task."""

    def merged(held):
        words, cells, n = (np.concatenate(x) for x in zip(*held))
        keys, where = np.unique(words, return_inverse=True)
        code, at = np.unique(where * (2 * CLASSES) + cells, return_inverse=True)
        return keys[code // (2 * CLASSES)], code % (2 * CLASSES), np.bincount(at, n, len(code)).astype(np.int64)

    def emit(found):
        words, cells, n = found
        if not len(words):
            return
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        ends = np.append(first[1:], len(words))
        for i in range(0, len(first), 20_000):
            yield _contexts(words[first[i : i + 20_000]].view(np.int64), first[i : i + 20_000], ends[i : i + 20_000], cells, n)

    def count(batches):
        head, held, size = shared.value, [], 0
        for batch in sliced(batches):
            texts = batch.column("raw").to_pylist()
            for a, b in blocks(texts):
                keys, forms, tokens, _, _ = _sequences(texts[a:b])
                at = head.find(keys)
                path = np.append(_class_of(head, at, forms), 0)[tokens]
                other = np.append((at < 0) | (head.unit[at] < 0) if len(head.words) else np.ones(len(keys), bool), False)[tokens]
                code = np.concatenate([tokens[other] * (2 * CLASSES) + np.append(0, path[:-1])[other], tokens[other] * (2 * CLASSES) + CLASSES + np.append(path[1:], 0)[other]])
                code, n = np.unique(code, return_counts=True)
                held.append((keys[code // (2 * CLASSES)], code % (2 * CLASSES), n))
                size += len(code)
                if size > most:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if 2 * size > most:
                        yield from emit(held.pop())
                        size = 0
        if held:
            yield from emit(merged(held))

    return count


def _contexts(words: np.ndarray, first: np.ndarray, ends: np.ndarray, cells: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """(word, cells, times) of words whose cells lie one after another, each word's from first to end."""
    offsets = pa.array(np.append(first, ends[-1:]) - first[0], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[first[0] : ends[-1]], kind)) for x, kind in ((cells, pa.int16()), (times, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(words), *lists], names=["word", "cells", "times"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells and times of a batch's words, and the row that each is of."""
    cells, times = batch.column("cells"), batch.column("times")
    owner = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
    return cells.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy(), owner


def _gathered(batches):
    """Sums the rows of each word, which come one after another."""
    word, held = None, np.zeros(2 * CLASSES, np.int64)

    def last():
        cells = np.flatnonzero(held)
        return _contexts(np.array([word]), np.array([0]), np.array([len(cells)]), cells, held[cells])

    for batch in sliced(batches, 20_000):
        words = np.asarray(batch.column("word"))
        if not len(words):
            continue
        cells, times, owner = _flat(batch)
        new = np.append(True, words[1:] != words[:-1])
        keys, place = words[new], (np.cumsum(new) - 1)[owner]
        code, at = np.unique(place * (2 * CLASSES) + cells, return_inverse=True)
        n = np.bincount(at, times, len(code)).astype(np.int64)
        ends = np.searchsorted(code, np.arange(1, len(keys) + 1) * (2 * CLASSES))
        cells = code % (2 * CLASSES)
        if word is not None and word != keys[0]:
            yield last()
            held[:] = 0
        if len(keys) > 1:
            if word == keys[0]:
                held[cells[: ends[0]]] += n[: ends[0]]
                yield last()
                held[:] = 0
                skip = 1
            else:
                skip = 0
            if len(keys) - 1 > skip:
                first = np.append(0, ends[:-1])
                yield _contexts(keys[skip:-1], first[skip:-1], ends[skip:-1], cells, n)
        begin = ends[-2] if len(keys) > 1 else 0
        held[cells[begin:]] += n[begin:]
        word = keys[-1]
    if word is not None:
        yield last()


@dataclass
class Tables:
    """How often each class has each class before it (before[c, k]: c before k) and after it (after[k, c])."""

    before: np.ndarray
    after: np.ndarray

    def fit(self) -> float:
        """Log-likelihood of the classes around all words, given the words' classes, but for a constant."""
        return float(sum(_xlogx(x).sum() - _xlogx(x.sum(axis=axis)).sum() for x, axis in ((self.before, 0), (self.after, 1))))

    def choose(self, around: np.ndarray, cells: np.ndarray, times: np.ndarray, owner: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """The class that explains the classes around each word best; a word is first taken out of its own class, if it is in one.

        The words' counts are given as rows of around (words, 2 * CLASSES), and those above 0 as (cells, times, owner) too.
        """
        joint = np.concatenate([self.before, self.after.T])
        before, after = self.before.sum(axis=0), self.after.sum(axis=1)
        n = around[:, :CLASSES].sum(axis=1)
        sizes, which = np.unique(n, return_inverse=True)
        fit = around @ np.log(joint + FLOOR) - (sizes[:, None] * (np.log(after + FLOOR) + np.log(before + sizes[:, None])))[which]
        if own is not None:
            rest = np.log(np.maximum(joint[cells, own[owner]] - times, 0) + FLOOR)
            left = np.log(np.maximum(after[own] - n, 0) + FLOOR) + np.log(np.maximum(before[own], n))
            fit[np.arange(len(own)), own] = np.bincount(owner, times * rest, len(own)) - n * left
        fit[:, 0] = -np.inf
        return fit.argmax(axis=1)


def _moved(cells: np.ndarray, times: np.ndarray, owner: np.ndarray, words: int, rounds: list[Tables]) -> np.ndarray:
    """The classes that the rounds move words to, one round after another."""
    around = np.bincount(owner * (2 * CLASSES) + cells, times, words * 2 * CLASSES).reshape(words, -1)
    klass = None
    for tables in rounds:
        klass = tables.choose(around, cells, times, owner, klass)
    return klass


def _chosen(batches, rounds: list[Tables]):
    """Each batch of (word, cells, times) with its cells, times and their owners, and the words' classes after the rounds.

    Words that occur once have one of CLASSES**2 contexts, whose classes are found once a task.
    """
    both = np.stack([np.repeat(np.arange(CLASSES), CLASSES), CLASSES + np.tile(np.arange(CLASSES), CLASSES)], axis=1).ravel()
    once = _moved(both, np.ones(len(both)), np.repeat(np.arange(CLASSES**2), 2), CLASSES**2, rounds)
    for batch in sliced(batches, 8000):
        cells, times, owner = _flat(batch)
        klass = np.zeros(batch.num_rows, np.int64)
        single = np.bincount(owner, times, batch.num_rows) == 2
        pair = cells[single[owner]].reshape(-1, 2)
        klass[single] = once[pair.min(axis=1) * CLASSES + pair.max(axis=1) - CLASSES]
        if not single.all():
            more = ~single[owner]
            place = np.cumsum(~single) - 1
            klass[~single] = _moved(cells[more], times[more], place[owner[more]], int((~single).sum()), rounds)
        yield batch, cells, times, owner, klass


def _chooser(rounds: list[Tables]):
    def choose(batches):
        for batch, *_, klass in _chosen(batches, rounds):
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(klass)], names=["word", "klass"])

    return choose


def _table_counter(rounds: list[Tables]):
    """What a task's words add to the tables, as (cell, n) of (klass, side, class)."""

    def count(batches):
        total = np.zeros(2 * CLASSES**2, np.int64)
        for _, cells, times, owner, klass in _chosen(batches, rounds):
            total += np.bincount(klass[owner] * (2 * CLASSES) + cells, times, len(total)).astype(np.int64)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    return count


def _exchanged(around: DataFrame, first: Tables, units: Tables, most: int = ROUNDS) -> list[Tables]:
    """Rounds of exchange over all words of around (word, cells, times), by whose tables each finds its class.

    A round moves every word at once to the class that explains its neighbours' classes best under the tables that the
    round before has left, to which the units add theirs; until one gains less than GAIN a word, `most` at most. Only the
    tables come to the driver, 2 * CLASSES**2 cells a task.
    """
    rounds, last = [first], -np.inf
    while len(rounds) <= most:
        total = _collected(around.mapInArrow(_table_counter(rounds), "cell long, n long"), 2 * CLASSES**2).reshape(CLASSES, 2, CLASSES).astype(float)
        now = Tables(units.before + total[:, 0].T, units.after + total[:, 1])
        if now.fit() - last < GAIN * now.before.sum():
            break
        last = now.fit()
        rounds.append(now)
    return rounds


def _class_of(head: Head, at: np.ndarray, forms: np.ndarray) -> np.ndarray:
    own = head.klass[at] if len(head.words) else np.full(len(at), -1)
    return np.where((at >= 0) & (own >= 0), own, head.form_class[forms])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each unit by exchange clustering of the counts pairs[u, v] of v after u; unit 0 keeps class 0 to itself.

    Units are taken by falling count; each is moved to the class that
    gives the class bigrams the greatest likelihood, until a round moves none.
    """
    units = len(pairs)
    order = np.argsort(-pairs.sum(axis=1), kind="stable")
    order = order[order != 0]
    klass = np.zeros(units, np.int64)
    klass[order] = 1 + np.arange(units - 1) % (classes - 1)
    member = np.eye(classes)[klass]
    joint = member.T @ pairs @ member
    out, into = pairs.sum(axis=1).astype(float), pairs.sum(axis=0).astype(float)
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not out[w] and not into[w]:
                continue
            own = klass[w]
            right = np.bincount(klass, pairs[w], classes)
            left = np.bincount(klass, pairs[:, w], classes)
            self_ = float(pairs[w, w])
            right[own] -= self_
            left[own] -= self_
            joint[own] -= right
            joint[:, own] -= left
            joint[own, own] -= self_
            rows, columns = joint.sum(axis=1), joint.sum(axis=0)
            gain = (_xlogx(joint + right) - _xlogx(joint)).sum(axis=1) + (_xlogx(joint.T + left) - _xlogx(joint.T)).sum(axis=1)
            diagonal = np.diagonal(joint)
            gain += _xlogx(diagonal + right + left + self_) + _xlogx(diagonal) - _xlogx(diagonal + right) - _xlogx(diagonal + left)
            # each class's row and column sums bear the word's own
            gain -= _xlogx(rows + out[w]) - _xlogx(rows) + _xlogx(columns + into[w]) - _xlogx(columns)
            gain[0] = -np.inf
            best = int(gain.argmax())
            best = own if gain[own] >= gain[best] - 1e-9 else best
            klass[w] = best
            joint[best] += right
            joint[:, best] += left
            joint[best, best] += self_
            moved += best != own
        if not moved:
            break
    return klass


@dataclass
class Model:
    """What the words' part of scoring needs: the head, and by class log10 of the mass of its members."""

    head: Head
    room: np.ndarray
    tokens: int
    distinct: int
    ends: int


def _collected(df: DataFrame, cells: int) -> np.ndarray:
    """Summed counts by cell, at most `cells` rows."""
    table = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[np.asarray(table.column("cell"))] = np.asarray(table.column("n"))
    return out


def classes(docs: DataFrame, counts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(word, n, klass) of every word, and the class of each form, from raw texts, whose word counts are (word, form, n).

    END is class 0, alone. The UNITS - FORMS - 1 commonest words and all other words, grouped by
    form, are clustered by exchange over their bigrams. Then every other word, however rare, is exchanged too, by rounds over the
    counts of the classes around it, which stay in Spark; a neighbour outside the units counts there with its form's class. Words
    that were never seen go with their form.
    """
    spark = docs.sparkSession
    top = counts.where("form >= 0").orderBy(F.desc("n"), "word").limit(UNITS - FORMS - 1).toArrow()
    words, n = (np.asarray(top.column(c)) for c in ("word", "n"))
    order = np.argsort(words.view(np.uint64))
    head = Head(words.view(np.uint64)[order], n[order], 1 + FORMS + order, np.full(len(words), -1), np.zeros(FORMS, np.int64))
    shared = spark.sparkContext.broadcast(head)
    pairs = _collected(docs.mapInArrow(_unit_counter(shared), "cell long, n long"), UNITS * UNITS).reshape(UNITS, UNITS).astype(float)
    klass = exchange(pairs, CLASSES)
    head.form_class, head.klass = klass[1 : 1 + FORMS], klass[head.unit]
    member = np.eye(CLASSES)[klass]
    follows = member.T @ pairs @ member
    alone = np.r_[0, 1 + FORMS : UNITS]
    units = Tables((member.T @ pairs)[:, alone] @ member[alone], member[alone].T @ (pairs @ member)[alone])
    shared = spark.sparkContext.broadcast(head)
    # a task has summed its own counts, so a common word has few rows of each task
    kind = "word long, cells array<short>, times array<long>"
    around = cut(docs.mapInArrow(_neighbours(shared), kind).repartition("word").sortWithinPartitions("word").mapInArrow(_gathered, kind))
    chosen = around.mapInArrow(_chooser(_exchanged(around, Tables(follows, follows), units)), "word long, klass long")
    named = chosen.unionAll(spark.createDataFrame([(int(w), int(k)) for w, k in zip(head.words.view(np.int64), head.klass)], "word long, klass long"))
    return cut(counts.where("form >= 0").select("word", "n").join(named, "word")), head.form_class


def fit(docs: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The classes' members and (word, n, klass) of every word; what comes to the driver is bounded: HEAD words, UNITS**2 and CLASSES cells."""
    totals = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("form") == -1, F.col("n")))).first()
    tokens, distinct, ends = (int(x or 0) for x in totals)
    named, form_class = classes(docs, counts)
    total, members = np.zeros(CLASSES), np.bincount(form_class, minlength=CLASSES).astype(float)
    for r in named.groupBy("klass").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        total[r["klass"]] = r["n"]
        members[r["klass"]] += r["v"]
    top = named.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    words, n, klass = (np.asarray(top.column(c)) for c in ("word", "n", "klass"))
    order = np.argsort(words.view(np.uint64))
    head = Head(words.view(np.uint64)[order], n[order], np.full(len(words), -1), klass[order], form_class)
    return Model(head, np.log10(np.maximum(total + WORD * members, WORD)), tokens, distinct, ends), named


def _sequencer(shared):
    """Each text as a sequence of classes, RARE for a word outside the head, with these words, their forms and places; and sums over the others."""

    def sequence(batches):
        model: Model = shared.value
        head = model.head
        end_base = np.log10(model.ends + WORD)
        for batch in sliced(batches):
            texts = batch.column("raw").to_pylist()
            made: list[list] = [[], [], [], [], [], [], [], []]
            for a, b in blocks(texts):
                keys, forms, tokens, ends, owner = _sequences(texts[a:b])
                at = head.find(keys)
                found = at >= 0
                n = b - a
                klass = np.where(found, head.klass[at], RARE) if len(head.words) else np.full(len(keys), RARE)
                base = np.where(found, np.log10(head.counts[at] + WORD), 0.0) if len(head.words) else np.zeros(len(keys))
                emit = np.where(found, base - model.room[np.where(found, klass, 0)], 0.0)
                path = np.append(klass, 0)[tokens].astype(np.uint8)
                bounds = np.concatenate([[0], ends + 1])
                size = np.diff(bounds)
                made[0] += size.tolist()
                made[1] += np.bincount(owner, np.append(found, model.ends > 0)[tokens], n).astype(np.int64).tolist()
                made[2] += np.bincount(owner, np.append(base, end_base)[tokens], n).tolist()
                made[3] += np.bincount(owner, np.append(emit, 0.0)[tokens], n).tolist()
                made[4] += [path[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
                rare = np.append(~found, False)[tokens]
                cell, where = np.unique(owner[rare] * max(len(keys), 1) + tokens[rare], return_inverse=True)
                whose, which = cell // max(len(keys), 1), cell % max(len(keys), 1)
                cuts, places = np.searchsorted(whose, np.arange(n + 1)), np.searchsorted(owner[rare], np.arange(n + 1))
                words, of = keys[which].view(np.int64), forms[which]
                made[5] += [words[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
                made[6] += [of[i:j].astype(np.int16) for i, j in zip(cuts[:-1], cuts[1:])]
                made[7] += [(where[i:j] - k).astype(np.int32) for i, j, k in zip(places[:-1], places[1:], cuts[:-1])]
            kept = [c for c in batch.schema.names if c != "raw"]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int16()), pa.list_(pa.int32()))
            names = ["n_tokens", "known", "base", "emit", "path", "words", "forms", "places"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, k) for x, k in zip(made, kinds))], names=[*kept, *names])

    return sequence


def _resolver(form_class: np.ndarray, room: np.ndarray):
    """Puts the classes of the joined words (at, klass, n) into the sequences, and their counts into the sums; words that were never seen have none."""

    def resolve(batches):
        for batch in sliced(batches):
            known, base, emit, path = (batch.column(c).to_pylist() for c in ("known", "base", "emit", "path"))
            columns = [[x.values.to_numpy() for x in batch.column(c)] for c in ("forms", "places")]
            joined = batch.column("joined").to_pylist()
            for i, (forms, places) in enumerate(zip(*columns)):
                if not len(places):
                    continue
                klass, n = form_class[forms], np.zeros(len(forms), np.int64)
                for x in joined[i] or ():
                    klass[x["at"]], n[x["at"]] = x["klass"], x["n"]
                each = np.log10(n + WORD)
                now = np.frombuffer(path[i], np.uint8).copy()
                now[now == RARE] = klass[places]
                path[i] = now.tobytes()
                known[i] += int((n > 0)[places].sum())
                base[i] += float(each[places].sum())
                emit[i] += float((each - room[klass])[places].sum())
            made = [pa.array(known), pa.array(base), pa.array(emit), pa.array(path, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "learns", "n_tokens")), *made], names=["doc_id", "learns", "n_tokens", "known", "base", "emit", "path"])

    return resolve


def _trigrams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Class trigram of each place of a batch's sequences, and the row it is in."""
    size = np.asarray(batch.column("n_tokens"))
    path = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).astype(np.int64)
    before = np.append(0, path[:-1])
    further = np.append(0, before[:-1])
    further[before == 0] = 0  # nothing is known of what lies before a text
    return (further * CLASSES + before) * CLASSES + path, np.repeat(np.arange(len(size)), size)


def _class_counter(batches):
    total = np.zeros(CLASSES**3, np.int64)
    for batch in sliced(batches):
        total += np.bincount(_trigrams(batch)[0], minlength=CLASSES**3)
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])


def _moves(three: np.ndarray) -> np.ndarray:
    """log10 of the class transitions, from trigram counts down to class unigrams."""
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * CLASSES)
    p2 = (two + LOWER * p1) / (two.sum(axis=1, keepdims=True) + LOWER)
    p3 = (three + LOWER * p2) / (three.sum(axis=2, keepdims=True) + LOWER)
    return np.log10(p3).ravel()


def _scorer(shared, room: float):
    def score(batches):
        moves = shared.value
        for batch in sliced(batches):
            cell, owner = _trigrams(batch)
            size = np.asarray(batch.column("n_tokens"))
            total = np.asarray(batch.column("emit")) + np.bincount(owner, moves[cell], len(size))
            base = np.asarray(batch.column("base")) - size * room
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "known")), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return score


def score(docs: DataFrame, learns: Column) -> DataFrame:
    """Score every text of docs (doc_id, text) by a model of the rows for which the Column `learns` holds.

    Returns doc_id, n_tokens (words and one end), n_known (those seen in training),
    train_tokens, base_score (log10, unigrams) and score (log10, class trigrams down to class
    unigrams, and emissions). Counts and classes of the HEAD commonest words are broadcast; a text's other
    words are joined with theirs. Words are known by 64-bit hashes. A null text is empty: an end only. Repeated rows are scored each; without
    training rows every probability is a smoothed one; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(learns, F.lit(False)).alias("learns"), raw(F.col("text")).alias("raw"))
    training = texts.where("learns").select("raw")
    counts = cut(training.mapInArrow(_spread, "word long, form long, n long").groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n")))
    model, named = fit(training, counts)
    shared = spark.sparkContext.broadcast(model)
    schema = f"doc_id {kind}, learns boolean, row long, n_tokens long, known long, base double, emit double, path binary, words array<long>, forms array<short>, places array<int>"
    sequences = cut(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sequencer(shared), schema))
    rare = sequences.select("row", F.posexplode("words").alias("at", "word")).join(named, "word")
    joined = rare.groupBy("row").agg(F.collect_list(F.struct("at", "klass", "n")).alias("joined"))
    whole = sequences.drop("words").join(joined, "row", "left").drop("row")
    whole = cut(whole.mapInArrow(_resolver(model.head.form_class, model.room), f"doc_id {kind}, learns boolean, n_tokens long, known long, base double, emit double, path binary"))
    three = _collected(whole.where("learns").select("n_tokens", "path").mapInArrow(_class_counter, "cell long, n long"), CLASSES**3)
    moves = spark.sparkContext.broadcast(_moves(three.reshape(CLASSES, CLASSES, CLASSES).astype(float)))
    room = float(np.log10(model.tokens + WORD * (model.distinct + 1)))
    scored = whole.drop("learns").mapInArrow(_scorer(moves, room), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
