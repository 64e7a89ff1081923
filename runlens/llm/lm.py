"""Language-model scores by deleted interpolation.

The probability of a token mixes the relative frequency of the word after the word before, from counts
of all word pairs, with a class model. How much the pairs weigh depends on how often the word before was
seen, in buckets of powers of two; the weights are learned as those of the class model below, from the
held-out pairs' ratios of both estimates, summed in steps of 1/``STEPS`` of a power of two.

The class model: the probability of the class after the class before, times that of the word in its class. The ``CLASSES`` - 2 most frequent words and the end are classes of their own, all other
words share one. As in the base score, words that training never met are one event, the unknown word.

The class sequence is a mixture of maximum-likelihood estimates: after the class before, without
context, and uniform. The mixture depends on how often the context was seen, in buckets of powers of
two, and its weights are learned by expectation maximisation: estimates come from most of the training
documents, the likelihood from counts of a part that was held out of them. Inside the shared class the
unknown word has the share that words unseen among the kept documents have in the held-out ones, and
the known ones their relative frequency of the rest. Scoring uses the counts of all training documents.

What is counted per word and per word pair over the corpus stays a distributed table. On the driver there
are at most ``HEAD`` frequent words, ``PAIR_HEAD`` frequent pairs and CLASSES**2 class pairs, whatever the
corpus; words and pairs beyond the frequent ones meet their counts in a join.

Pairs are dealt by digest into groups of about ``GROUP_TOKENS`` tokens' pairs. They travel, and lie in the work
tables, as arrays, one row per group and batch, and are summed and looked up a group at a time. A pair of two frequent
words that the corpus holds once is not written down. The document that holds it is the only one that asks for it
and knows the count, so every such pair is first scored as met once, in that document; the table of the others has
what that falls short of.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bytes as B
from runlens.llm.registry import CLEANUP, ZSTD, discard, query, remainder, setting, stored, table

FOLDS, LEFT_OUT, HELD = 7, 2, 3
HEAD = 1 << 19
PAIR_HEAD = 1 << 20
CLASSES = 1024
STEPS = 64
#: Tokens (fewer than twice as many) whose pairs are summed in a task at a time; three counts of them fit a long.
PAIR_TOKENS = 1 << 20
COUNT_BITS = 21
#: Class pairs are summed in groups of so many cells from so many tasks.
CLASS_CELLS, CLASS_TASKS = 1 << 13, 64
#: A group holds the pairs of about so many training tokens.
GROUP_TOKENS = 1 << 19
OTHER, END = 0, 1
#: Kinds of counted pairs: of two frequent words, with another word, of classes. Then what is known of all pairs of a
#: task: held-out counts by bucket and ratio, and how many pairs there are by band of their count.
PLAIN, RARE, CLASS, HELD_SUMS, BAND_SUMS = range(5)
#: Pairs wait for their counts in so many rounds, so that shuffle files of one round go before the next.
PARTS = 4
ROUNDS = 40
BUCKETS = 40
_END_ID = 0x1D1E5EED0E0D0C0B


def buckets(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket per power of two."""
    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def mixture_weights(parts: np.ndarray, bucket: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Weights per bucket that make the held-out counts likeliest; ``parts`` has a column per estimate."""
    def learn(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(ROUNDS):
            share = p * w
            share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            got = (share * n[:, None]).sum(axis=0) + 1e-3 * start
            w = got / got.sum()
        return w

    m = parts.shape[1]
    overall = learn(parts, held, np.full(m, 1 / m)) if held.sum() else np.full(m, 1 / m)
    out = np.tile(overall, (BUCKETS, 1))
    for b in np.unique(bucket[held > 0]):
        rows = (bucket == b) & (held > 0)
        out[b] = learn(parts[rows], held[rows], overall)
    # An unseen context has no estimate of its own: its weight goes to the lower orders.
    out[0, 0] = 0
    out[0] /= out[0].sum()
    return out


def pair_estimates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two-gram estimates, one-gram estimates, context counts) of a matrix of pair counts."""
    context, total = counts.sum(axis=1), counts.sum()
    return counts / np.maximum(context, 1)[:, None], counts.sum(axis=0) / max(total, 1), context


def class_model(kept: np.ndarray, held: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from pair counts of kept and held-out documents."""
    return class_models(kept, held)[0]


def class_models(kept: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
    """``class_model`` with the counts of all and of kept documents; the weights are the same."""
    k = len(kept)
    two, one, context = pair_estimates(kept.astype(float))
    h, w = np.nonzero(held)
    parts = np.stack([two[h, w], one[w], np.full(len(h), 1 / k)], 1)
    weights = mixture_weights(parts, buckets(context)[h], held[h, w].astype(float))
    out = []
    for counts in (kept + held, kept):
        two, one, context = pair_estimates(counts.astype(float))
        mix = weights[buckets(context)]
        out.append(np.log10(mix[:, :1] * two + mix[:, 1:2] * one[None, :] + mix[:, 2:] / k).astype(np.float32))
    return out


class Tokens:
    """Words and ends of a run in reading order."""

    def __init__(self, run: B.Run):
        w = B.words(run, lower=True)
        self.doc = np.repeat(np.arange(run.n), np.diff(w.first) + 1)
        self.ids = np.full(len(self.doc), B.U64(_END_ID))
        self.ids[np.arange(len(w.ids)) + w.doc] = w.ids

    def before(self, cls: np.ndarray, end: int = END) -> np.ndarray:
        """Class (or number) before each token; a text begins after an end."""
        first = np.append(True, self.doc[1:] != self.doc[:-1]) if len(cls) else np.zeros(0, bool)
        return np.where(first, cls.dtype.type(end), np.append(cls.dtype.type(end), cls[:-1]) if len(cls) else cls)


def pair_keys(v: np.ndarray, w: np.ndarray, frequent: int) -> np.ndarray:
    """One number per pair: both places side by side, or below zero a digest if a word is not frequent."""
    mixed = B.signed(B.mix(B.mix(v.astype(np.int64).view(B.U64) + B.U64(0x9E3779B97F4A7C15)) ^ w.astype(np.int64).view(B.U64)))
    both = (v >= 0) & (v < frequent) & (w >= 0) & (w < frequent)
    return np.where(both, np.where(both, v, 0) << 31 | np.where(both, w, 0), mixed | np.int64(-1 << 63))


class Lookup:
    """Places in a sorted array of distinct digests, which are spread evenly: two slots or more per digest."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = len(keys).bit_length() + 1
        self.shift = B.U64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=B.U64)).astype(np.int32)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id, -1 if it has none."""
        if not len(self.keys):
            return np.full(len(ids), -1, np.int64)
        last = len(self.keys) - 1
        at = np.minimum(self.first[(ids >> self.shift).astype(np.int64)], last).astype(np.int64)
        have = self.keys[at]
        out = np.where(have == ids, at, -1)
        rest = np.flatnonzero(have < ids)
        at = at[rest] + 1
        while len(rest):
            more = at <= last
            rest, at = rest[more], at[more]
            have, want = self.keys[at], ids[rest]
            out[rest[have == want]] = at[have == want]
            more = have < want
            rest, at = rest[more], at[more] + 1
        return out


def _digests(key: np.ndarray) -> np.ndarray:
    return B.mix(key.view(B.U64))


def _groups(key: np.ndarray, groups: int) -> np.ndarray:
    """The group of each pair, as short numbers if they suffice: NumPy sorts those in one pass."""
    return (_digests(key) % B.U64(groups)).astype(np.uint16 if groups <= 1 << 16 else np.int32)


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def _lists(key: np.ndarray, *values: np.ndarray) -> tuple[pa.Array, list[pa.ListArray]]:
    """(distinct keys, values as one list per key)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _runs(key)
    cut = pa.array(np.append(at, len(key)), pa.int32())
    return pa.array(key[at].astype(np.int32)), [pa.ListArray.from_arrays(cut, pa.array(x[order])) for x in values]


def _flat(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """All values of a column of lists."""
    return pc.list_flatten(rows[name]).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else \
        pc.list_flatten(rows[name]).to_numpy()


def _one_row(schema: pa.Schema, **values) -> pa.RecordBatch:
    """A row whose arrays are lists; what is not given is null."""
    return pa.RecordBatch.from_arrays([
        pa.nulls(1, f.type) if f.name not in values else
        pa.ListArray.from_arrays(pa.array([0, len(values[f.name])], pa.int32()), pa.array(values[f.name])).cast(f.type)
        if isinstance(values[f.name], np.ndarray) else pa.array([values[f.name]], f.type) for f in schema], schema=schema)


def _band(count: Column) -> Column:
    """Small counts by themselves, others by powers of two."""
    return F.when(count < 64, count).otherwise(F.length(F.bin(count)) + 57).cast("int")


def _bands(count: np.ndarray) -> np.ndarray:
    """``_band`` of an array."""
    return np.where(count < 64, count, np.frexp(count.astype(float))[1] + 57)


def _lowest(sizes: dict[int, int], limit: int) -> int:
    """The lowest band such that it and those above hold at most ``limit``."""
    lowest, room = 128, limit
    for b in sorted(sizes, reverse=True):
        if sizes[b] > room:
            break
        room, lowest = room - sizes[b], b
    return lowest


def _bucket(count: Column) -> Column:
    """``buckets`` as a column: the number of binary digits, which is exact."""
    return F.when(count > 0, F.least(F.length(F.bin(count)), F.lit(BUCKETS - 1))).otherwise(0)


def _folds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fold", remainder(F.col("id"), FOLDS))


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, kept, held) over the training documents, summed per batch before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            ids: tuple[list, list] = ([], [])
            for run in B.slices(batch["text"]):
                t = Tokens(run)
                held = fold[run.first + t.doc] == HELD
                ids[0].append(t.ids[~held])
                ids[1].append(t.ids[held])
            if ids[0]:
                # Plain sorts of each part and a short one of the distinct words; an inverse of all tokens costs many times more.
                (kept, n_kept), (held, n_held) = (np.unique(np.concatenate(x), return_counts=True) for x in ids)
                key, at = np.unique(np.concatenate([kept, held]), return_inverse=True)
                sums = np.zeros((2, len(key)), np.int64)
                sums[0, at[:len(kept)]] = n_kept
                sums[1, at[len(kept):]] = n_held
                yield pa.RecordBatch.from_pydict({"word": B.signed(key), "kept": sums[0], "held": sums[1]})

    train = rows.where(F.col("fold") != LEFT_OUT).select("text", "fold")
    return train.mapInArrow(count, "word long, kept long, held long").groupBy("word").agg(
        F.sum("kept").alias("kept"), F.sum("held").alias("held"))


class Head:
    """The frequent words, sorted by digest, with their training counts and classes."""

    def __init__(self, counts: DataFrame, limit: int = HEAD, classes: int = CLASSES):
        total = F.col("kept") + F.col("held")
        band = _band(total)
        sizes = dict(counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect())
        lowest = _lowest(sizes, limit)
        got = counts.where((band >= lowest) | (F.col("word") == F.lit(_END_ID))).select("word", total.alias("n"), "kept").toArrow()
        ids, n = got["word"].to_numpy().view(B.U64), got["n"].to_numpy()
        order = np.argsort(ids)
        self.ids, self.n, self.kept = ids[order], n[order], got["kept"].to_numpy()[order]
        self.cls = np.full(len(self.ids), OTHER, np.int64)
        top = np.lexsort((self.ids, -self.n))
        top = top[self.ids[top] != B.U64(_END_ID)][:classes - 2]
        self.cls[top] = np.arange(2, 2 + len(top))
        self.cls[self.ids == B.U64(_END_ID)] = END

    @classmethod
    def of(cls, ids: np.ndarray, n: np.ndarray, classes: np.ndarray, kept: np.ndarray) -> Head:
        out = cls.__new__(cls)
        out.ids, out.n, out.cls, out.kept = ids, n, classes, kept
        return out

    @cached_property
    def places(self) -> Lookup:
        return Lookup(self.ids)

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """Place of each frequent word, digest of any other; digests among the places would be taken for them."""
        at = self.places.find(ids)
        return np.where(at >= 0, at, B.signed(ids))

    def pairs(self, t: Tokens, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the word before, number of the word, key of the pair) of each token; ``w`` if known already."""
        w = self.numbers(t.ids) if w is None else w
        v = t.before(w, int(self.numbers(np.array([_END_ID], B.U64))[0]))
        return v, w, pair_keys(v, w, len(self.ids))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is frequent, count, class) of each token."""
        return self.look(ids, self.numbers(ids))

    def look(self, ids: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``find`` with the ``numbers`` of the tokens."""
        if not len(self.ids):
            return np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), np.where(ids == B.U64(_END_ID), END, OTHER)
        hit = (number >= 0) & (number < len(self.ids))
        at = np.where(hit, number, 0)
        return hit, np.where(hit, self.n[at], 0), np.where(hit, self.cls[at], np.where(ids == B.U64(_END_ID), END, OTHER))


def _class_pairs(pairs: DataFrame, classes: int) -> np.ndarray:
    """(2, classes, classes): how often a class follows another in kept and in held-out training documents."""
    cells = pairs.where(F.col("kind") == CLASS).select(F.inline(F.arrays_zip("key", "kept", "held")))
    got = cells.groupBy("key").agg(F.sum("kept").alias("kept"), F.sum("held").alias("held")).toArrow()
    matrix = np.zeros((2, classes * classes), np.int64)
    for side, name in enumerate(("kept", "held")):
        matrix[side, got["key"].to_numpy()] = got[name].to_numpy()
    return matrix.reshape(2, classes, classes)


def _word_pairs(rows: DataFrame, head: Head, classes: int, groups: int) -> DataFrame:
    """(kind, grp, key, w, kept, held, n), a row per group with an array entry per pair of a word and the word before it in
    the whole corpus, but for pairs of frequent words that it holds once, and per pair of their classes in each share of the tasks.

    ``key`` is that of ``pair_keys``; where a word is not frequent the word before, beside ``w``. Summed over
    ``PAIR_TOKENS`` tokens before the shuffle; ``n`` has the documents that are left out of training, too.
    """
    send = rows.sparkSession.sparkContext.broadcast((head.ids, head.n, head.cls, head.kept))
    names = ["kind", "grp", "key", "w", "packed"]
    result = pa.schema([("kind", pa.int32()), ("grp", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("key", "w", "kept", "held", "n"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head.of(*send.value)
        parts: list[tuple] = []
        cells = np.zeros(2 * classes * classes, np.int64)

        def dealt(kind: int, grp: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
            grp, lists = _lists(grp, *values)
            if len(lists) == 2:
                lists.insert(1, pa.nulls(len(grp), pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grp), kind, np.int32)), grp, *lists], names)

        def summed() -> Iterator[pa.RecordBatch]:
            v, w, key, cell, side = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            cells[:] += np.bincount(cell[side < 2] * 2 + side[side < 2], minlength=len(cells))
            plain = key >= 0
            every = np.sort(key[plain] << 2 | side[plain])
            at = _runs(every)
            every, times = every[at], np.diff(np.append(at, len(every)))
            yield dealt(PLAIN, _groups(every >> 2, groups), every >> 2, times << COUNT_BITS * (every & 3))
            rare = ~plain
            yield dealt(RARE, _groups(key[rare], groups), v[rare], w[rare], np.int64(1) << COUNT_BITS * side[rare].astype(np.int64))

        size = 0
        for batch in batches:
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            sides = np.where(fold == HELD, 1, np.where(fold == LEFT_OUT, 2, 0)).astype(np.int8)
            for run in B.slices(batch["text"]):
                t = Tokens(run)
                number = head.numbers(t.ids)
                cls = head.look(t.ids, number)[2]
                every = (*head.pairs(t, number), t.before(cls) * classes + cls, sides[run.first + t.doc])
                for at in range(0, len(t.ids), PAIR_TOKENS):
                    parts.append(tuple(x[at:at + PAIR_TOKENS] for x in every))
                    size += len(parts[-1][0])
                    if size >= PAIR_TOKENS:
                        yield from summed()
                        size = 0
        if parts:
            yield from summed()
        met = np.flatnonzero(cells.reshape(-1, 2).any(axis=1))
        if len(met):
            parts_of_cells = classes * classes // CLASS_CELLS + 1
            share = TaskContext.get().partitionId() // CLASS_TASKS
            yield dealt(CLASS, share * parts_of_cells + met % parts_of_cells, met, cells[2 * met + 1], cells[2 * met])

    def add(rows: pa.Table) -> pa.Table:
        kind, grp, key, packed = rows["kind"][0].as_py(), rows["grp"][0].as_py(), _flat(rows, "key"), _flat(rows, "packed")
        w = None if kind == PLAIN else _flat(rows, "w")
        by = pair_keys(key, w, size) if kind == RARE else key
        order = np.argsort(by)
        at = _runs(by[order])
        key = key[order][at]
        if kind == CLASS:
            kept, held = (np.add.reduceat(x[order], at) for x in (packed, w))
            return pa.Table.from_batches([_one_row(result, kind=kind, grp=grp, key=key, kept=kept, held=held)])
        packed = packed[order]
        kept, held, out = (np.add.reduceat(packed >> COUNT_BITS * k & ((1 << COUNT_BITS) - 1), at) for k in range(3))
        n = kept + held + out
        if kind == RARE:
            return pa.Table.from_batches([_one_row(result, kind=kind, grp=grp, key=key, w=w[order][at], kept=kept, held=held, n=n)])
        more = n > 1
        return pa.Table.from_batches([_one_row(result, kind=kind, grp=grp, key=key[more], kept=kept[more], held=held[more], n=n[more])])

    size = len(head.ids)
    return rows.select("text", "fold").mapInArrow(
        count, "kind int, grp int, key array<long>, w array<long>, packed array<long>").groupBy("kind", "grp").applyInArrow(
        add, "kind int, grp int, key array<long>, w array<long>, kept array<long>, held array<long>, n array<long>")


def _pair_ratios(pairs: DataFrame, counts: DataFrame, head: Head, logs: list[np.ndarray], new: float, other: int,
                 other_kept: int, groups: int) -> DataFrame:
    """(kind, grp, key, n, seen, unit, bucket): every pair of the stored table ``pairs``, which is deleted, in arrays by group.

    ``seen`` counts the training documents, ``unit`` is the relative frequency of a pair met once over the class model's
    probability, ``bucket`` that of the count of the word before. Rows of ``HELD_SUMS`` have the held-out counts ``n`` by
    bucket and ratio of both from kept documents only, the ratio in steps of its logarithm; those of ``BAND_SUMS`` how
    many pairs are in each band of ``n``.
    """
    send = pairs.sparkSession.sparkContext.broadcast((head.ids, head.n, head.cls, head.kept, *logs))
    size = len(head.ids)
    result = pa.schema([("kind", pa.int32()), ("grp", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("key", "n", "seen")),
                        ("unit", pa.list_(pa.float64())), ("bucket", pa.list_(pa.int8()))])
    kind = "kind int, grp int, key array<long>, n array<long>, seen array<long>, unit array<double>, bucket array<byte>"

    def weigher():
        *frequent, log_every, log_kept = send.value
        head = Head.of(*frequent)
        # Held-out counts by bucket and step, pairs by band.
        sums = np.zeros(BUCKETS << 16, np.int64)
        bands = np.zeros(128, np.int64)

        def weigh(v, w, kept, held, n, cv, kv, cw, kw) -> tuple[np.ndarray, ...]:
            def known(x: np.ndarray, c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                hit = (x >= 0) & (x < size)
                at = np.where(hit, x, 0)
                end = np.where(x == np.int64(_END_ID), END, OTHER)
                return (np.where(hit, head.n[at], c), np.where(hit, head.kept[at], k), np.where(hit, head.cls[at], end)) \
                    if size else (c, k, end)

            cv, kv, class_v = known(v, cv, kv)
            cw, kw, class_w = known(w, cw, kw)

            def lower(log: np.ndarray, at: np.ndarray | slice, c: np.ndarray, total: int) -> np.ndarray:
                inside = np.where(c > 0, (1 - new) * c / max(total, 1), new)
                return 10 ** log[class_v[at], class_w[at]].astype(float) * np.where(class_w[at] == OTHER, inside, 1.0)

            unit = 1 / (np.maximum(cv, 1) * lower(log_every, slice(None), cw, other))
            h = np.flatnonzero(held > 0)
            past = kept[h] / (np.maximum(kv[h], 1) * lower(log_kept, h, kw[h], other_kept))
            cell = np.where(kept[h] > 0, np.rint(STEPS * np.log2(np.where(kept[h] > 0, past, 1.0))), -(1 << 15)).astype(np.int64)
            np.add.at(sums, buckets(kv[h]) << 16 | cell + (1 << 15), held[h])
            bands[:] += np.bincount(_bands(n), minlength=128)
            return n, kept + held, unit, buckets(cv).astype(np.int8)

        def ended() -> Iterator[pa.RecordBatch]:
            for kind, of in ((HELD_SUMS, sums), (BAND_SUMS, bands)):
                met = np.flatnonzero(of)
                yield _one_row(result, kind=kind, grp=0, key=met, n=of[met])

        return weigh, ended

    def weigh_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, ended = weigher()
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                key, kept, held, n = (_flat(row, c) for c in ("key", "kept", "held", "n"))
                none = np.zeros(len(key), np.int64)
                got = weigh(key >> 31, key & ((1 << 31) - 1), kept, held, n, none, none, none, none)
                yield _one_row(result, kind=PLAIN, grp=row["grp"][0].as_py(), key=key, **dict(zip(("n", "seen", "unit", "bucket"), got)))
        yield from ended()

    def weigh_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, ended = weigher()
        parts: list[tuple] = []
        waiting = 0

        def dealt() -> pa.RecordBatch:
            key, *got = (np.concatenate(c) for c in zip(*parts))
            grp, lists = _lists(_groups(key, groups), key, *got)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grp), RARE, np.int32)), grp, *lists], schema=result)

        for batch in batches:
            v, w, *rest = (batch[c].to_numpy(zero_copy_only=False) for c in ("v", "w", "kept", "held", "n", "cv", "kv", "cw", "kw"))
            parts.append((pair_keys(v, w, size), *weigh(v, w, *rest)))
            waiting += len(v)
            if waiting >= PAIR_TOKENS:
                yield dealt()
                parts.clear()
                waiting = 0
        if waiting:
            yield dealt()
        yield from ended()

    zero = F.lit(0).cast("long")
    columns = ["v", "w", "kept", "held", "n"]
    plain = pairs.where(F.col("kind") == PLAIN).select("grp", "key", "kept", "held", "n").mapInArrow(weigh_plain, kind)
    met = pairs.where(F.col("kind") == RARE).select(F.inline(F.arrays_zip(F.col("key").alias("v"), "w", "kept", "held", "n"))).toDF(*columns)
    for x in "vw":
        # Frequent words carry their counts already; they go past the join under the pair's own digest.
        on = F.when(F.col(x).between(0, size - 1), F.xxhash64("v", "w")).otherwise(F.col(x))
        own = counts.select(F.col("word").alias("on"), (F.col("kept") + F.col("held")).alias(f"c{x}"), F.col("kept").alias(f"k{x}"))
        met = met.withColumn("on", on).join(own, "on", "left").drop("on")
    rare = met.select(*columns, *(F.coalesce(c, zero).alias(c) for c in ("cv", "kv", "cw", "kw"))).mapInArrow(weigh_rare, kind)
    out = stored(plain.unionByName(rare), "lm-pairs", ZSTD)
    discard(pairs)
    return out


def _sums(ratios: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, sums) of one kind of sums."""
    got = (ratios.where(F.col("kind") == kind).select(F.inline(F.arrays_zip("key", "n"))).groupBy("key").agg(F.sum("n").alias("n"))).toArrow()
    return got["key"].to_numpy(), got["n"].to_numpy()


def _pair_weights(ratios: DataFrame, counts: DataFrame) -> np.ndarray:
    """How much word pairs weigh against the class model, per bucket of the count of the word before.

    Every held-out token follows a word; those whose pair has no row are met once in the corpus, so never in kept documents.
    """
    number, n = _sums(ratios, HELD_SUMS)
    bucket, cell = number >> 16, (number & 0xFFFF) - (1 << 15)
    every = counts.where(F.col("held") > 0).groupBy(_bucket(F.col("kept")).alias("b")).agg(F.sum("held").alias("n")).collect()
    once = np.zeros(BUCKETS)
    for b, held in every:
        once[b] = held
    once -= np.bincount(bucket, n, BUCKETS)
    ratio = np.append(np.where(cell > -(1 << 15), np.exp2(cell.astype(float) / STEPS), 0.0), np.zeros(BUCKETS))
    return mixture_weights(np.stack([ratio, np.ones(len(ratio))], 1), np.append(bucket.astype(np.int64), np.arange(BUCKETS)),
                           np.append(n, once).astype(float))[:, 0]


def _gain(weights: np.ndarray, bucket: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """What a pair's estimate adds to the logarithm of the class model."""
    weight = weights[bucket]
    return np.log10(weight * ratio + 1 - weight)


def _frequent_pairs(ratios: DataFrame, weights: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(digests of keys in order, gains) of the most frequent pairs, at most ``limit``, and the lowest band of their counts."""
    lowest = _lowest(dict(zip(*(x.tolist() for x in _sums(ratios, BAND_SUMS)))), limit)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, seen, unit, bucket = (_flat(batch, c) for c in ("key", "n", "seen", "unit", "bucket"))
            top = _bands(n) >= lowest
            yield pa.RecordBatch.from_pydict({"key": key[top], "gain": _gain(weights, bucket[top], seen[top] * unit[top])})

    got = ratios.where(F.col("kind").isin(PLAIN, RARE)).select("key", "n", "seen", "unit", "bucket").mapInArrow(
        pick, "key long, gain double").toArrow()
    keys, gain = _digests(got["key"].to_numpy()), got["gain"].to_numpy()
    order = np.argsort(keys)
    return keys[order], gain[order], lowest


def _late_gains(asked: DataFrame, told: DataFrame, weights: np.ndarray, lowest: int) -> DataFrame:
    """(row, g) of the documents' pairs that wait for their counts, met group by group; pairs of band ``lowest`` or more wait nowhere."""
    def meet(asked: pa.Table, told: pa.Table) -> pa.Table:
        key, n, seen, unit, bucket = (_flat(told, c) for c in ("key", "n", "seen", "unit", "bucket"))
        late = np.flatnonzero(_bands(n) < lowest)
        digest = _digests(key)
        late = late[np.argsort(digest[late])]
        lookup = Lookup(digest[late])
        key, unit, bucket = key[late], unit[late], bucket[late]
        whole = _gain(weights, bucket, seen[late] * unit)
        # A pair of frequent words was scored as met once by the documents of the training, as never met by the others.
        once = np.where(key >= 0, _gain(weights, bucket, unit), 0.0)
        never = np.where(key >= 0, _gain(weights, bucket, np.zeros(len(key))), 0.0)
        out = []
        if len(key) and len(asked):
            want, place = _flat(asked, "key"), _flat(asked, "place")
            lists = asked["place"].combine_chunks()
            chunk = np.repeat(np.arange(len(asked)), pc.list_value_length(lists).to_numpy())
            at = lookup.find(_digests(want))
            met = at >= 0
            at, place, chunk = at[met], place[met], chunk[met]
            g = whole[at] - np.where(place & 1, once[at], never[at])
            by, lists = _lists(chunk, place >> 1, g)
            out = [asked["begun"].combine_chunks().take(by), *lists]
        return pa.table(out or [[], [], []], pa.schema([("begun", pa.int64()), ("place", pa.list_(pa.int32())), ("g", pa.list_(pa.float64()))]))

    def add(rows: pa.Table) -> pa.Table:
        place, g = _flat(rows, "place"), _flat(rows, "g")
        row = np.flatnonzero(np.bincount(place))
        return pa.table({"row": rows["begun"][0].as_py() + row, "g": np.bincount(place, g)[row]})

    return asked.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(
        meet, "begun long, place array<int>, g array<double>").groupBy("begun").applyInArrow(add, "row long, g double")


def _once_a_document(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, times, cuts at documents) with each key once per document."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    at = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))) if len(d) else np.zeros(0, np.int64)
    return k[at], np.diff(np.append(at, len(order))).astype(np.int32), np.searchsorted(d[at], np.arange(n + 1))


def score_documents(docs: DataFrame, text: str = "text", row_id: str = "doc_id", head_limit: int = HEAD,
                    classes: int = CLASSES, pair_limit: int = PAIR_HEAD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null text is empty: its one token is the end. Ids may be null or repeat; every row is scored by
    itself. Without training rows the counts are 0 and the model is the uniform one. An empty table gives
    an empty result.
    """
    rows = _folds(docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    counts = stored(_word_counts(rows), "lm-words")
    every = F.col("kept") + F.col("held")
    n, v, n_kept = counts.agg(F.coalesce(F.sum(every), F.lit(0)), F.count("*"), F.coalesce(F.sum("kept"), F.lit(0))).first()
    head = Head(counts, head_limit, classes)
    # Words of the shared class: how much of the held-out words was never seen among the kept ones.
    own = np.sort(head.ids[head.cls != OTHER])
    shared = counts.where(~F.col("word").isin(B.signed(own).tolist())) if len(own) <= classes else counts
    other, other_held, unseen = shared.agg(F.coalesce(F.sum(every), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0)),
                                           F.coalesce(F.sum(F.when(F.col("kept") == 0, F.col("held"))), F.lit(0))).first()
    new = (unseen + 1) / (other_held + 2)
    floor = np.log10(float(n + v + 1))
    groups = max(1, n // GROUP_TOKENS)
    pairs = stored(_word_pairs(rows, head, classes, groups), "lm-pair-counts", ZSTD)
    matrix = _class_pairs(pairs, classes)
    log_class, log_kept = class_models(matrix[0], matrix[1])
    ratios = _pair_ratios(pairs, counts, head, [log_class, log_kept], new, other, other - other_held, groups)
    weights = _pair_weights(ratios, counts)
    pair_key, pair_gain, lowest = _frequent_pairs(ratios, weights, pair_limit)
    send = docs.sparkSession.sparkContext.broadcast(
        (head.ids, head.n, head.cls, head.kept, pair_key, pair_gain, log_class, weights))

    kind = rows.schema["id"].dataType.simpleString()
    columns = (f"row long, id {kind}, n_tokens long, n_known long, base double, total double, "
               "waiting array<struct<word: long, times: int>>, begun long, grp int, key array<long>, place array<int>")
    names = ["row", "id", "n_tokens", "n_known", "base", "total", "waiting", "begun", "grp", "key", "place"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *frequent, pair_key, pair_gain, log_class, weights = send.value
        head = Head.of(*frequent)
        frequent_pairs = Lookup(pair_key)
        row = TaskContext.get().partitionId() << 33
        # Pairs that wait for their counts, of all documents since row ``begun``: key, and twice the document plus whether it was trained on.
        late_pairs: list[tuple] = []
        begun, size = row, 0

        def asked(id_type: pa.DataType) -> pa.RecordBatch:
            key, place = (np.concatenate(c) for c in zip(*late_pairs))
            grp, lists = _lists(_groups(key, groups), key, place)
            m = len(grp)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, id_type), *(pa.nulls(m, x) for x in absent), pa.array(np.full(m, begun)), grp, *lists], names)

        absent: list[pa.DataType] = []
        for batch in batches:
            trained = batch["fold"].to_numpy(zero_copy_only=False) != LEFT_OUT
            id_type = batch["id"].type
            for run in B.slices(batch["text"]):
                t = Tokens(run)
                number = head.numbers(t.ids)
                done, c, cls = head.look(t.ids, number)
                model = log_class[t.before(cls), cls].astype(float)
                known = np.flatnonzero(done & (cls == OTHER))
                model[known] += np.log10((1 - new) * c[known] / max(other, 1))
                if not len(head.ids):
                    done = t.ids == B.U64(_END_ID)
                base = np.bincount(t.doc, np.where(done, np.log10(c + 1.0) - floor, 0), run.n)
                v, _, key = head.pairs(t, number)
                at = frequent_pairs.find(_digests(key))
                met = at >= 0
                once = np.flatnonzero(~met & (key >= 0))
                fit = trained[run.first + t.doc]
                weight = weights[buckets(head.n[v[once]])] if len(once) else np.zeros(0)
                unit = np.where(fit[once], 1 / (np.maximum(head.n[v[once]], 1) * 10 ** model[once]), 0) if len(once) else np.zeros(0)
                model[once] += np.log10(weight * unit + 1 - weight)
                model[met] += pair_gain[at[met]]
                total = np.bincount(t.doc, model, run.n)
                late = ~met
                late_pairs.append((key[late], ((row - begun + t.doc[late]) * 2 + fit[late]).astype(np.int32)))
                size += len(late_pairs[-1][0])
                # Words that are not frequent wait for the join with their counts, each once per document.
                value, times, cut = _once_a_document(t.doc[~done], B.signed(t.ids)[~done], run.n)
                waiting = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(value), pa.array(times)], ["word", "times"]))
                own = [pa.array(np.bincount(t.doc, minlength=run.n)),
                       pa.array(np.bincount(t.doc[done], (c[done] > 0), run.n).astype(np.int64)), pa.array(base), pa.array(total), waiting]
                absent = [x.type for x in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + run.n)), batch["id"].slice(run.first, run.n), *own, pa.nulls(run.n, pa.int64()),
                     pa.nulls(run.n, pa.int32()), pa.nulls(run.n, pa.list_(pa.int64())), pa.nulls(run.n, pa.list_(pa.int32()))], names=names)
                row += run.n
                if size >= PAIR_TOKENS:
                    yield asked(id_type)
                    late_pairs.clear()
                    begun, size = row, 0
        if size:
            yield asked(id_type)

    written = stored(rows.select("id", "text", "fold").mapInArrow(score, columns), "lm-scored", ZSTD)
    scored = written.where(F.col("grp").isNull()).select("row", "id", "n_tokens", "n_known", "base", "total", "waiting")
    waiting = scored.select("row", F.explode("waiting").alias("t")).select("row", "t.*")
    c = F.coalesce(every, F.lit(0))
    inside = F.when(c > 0, F.log10(F.lit(1 - new) * c / F.lit(float(max(other, 1))))).otherwise(F.lit(float(np.log10(new))))
    met = waiting.join(counts, "word", "left").select(
        "row", "times", c.alias("c"), (F.col("times") * (F.log10(c + 1.0) - F.lit(float(floor)))).alias("b"),
        (F.col("times") * inside).alias("m"))
    rest = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
                                  F.sum("b").alias("b"), F.sum("m").alias("m"))
    # The rounds run one after another, each into a table of one number per document, so that the shuffle files of one go before the next.
    late = [stored(_late_gains(written.where(F.col("grp") % PARTS == part).select("begun", "grp", "key", "place"),
                               ratios.where(F.col("kind").isin(PLAIN, RARE) & (F.col("grp") % PARTS == part)).drop("kind"), weights, lowest),
                   "lm-pair-gains") for part in range(PARTS)]
    discard(ratios)
    paired = reduce(DataFrame.unionByName, late).groupBy("row").agg(F.sum("g").alias("g"))
    out = scored.drop("waiting").join(rest, "row", "left").join(paired, "row", "left")
    zero = F.lit(0)
    return out.select(
        F.col("id").alias(row_id), (remainder(F.col("id"), FOLDS) == LEFT_OUT).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known", zero)).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("total") + F.coalesce("m", zero) + F.coalesce("g", zero)).alias("score"))


@query("op8_lm")
def op8_lm(spark: SparkSession, folder: str) -> DataFrame:
    with setting(spark, CLEANUP, "true"):
        return score_documents(table(spark, folder, "documents"))
