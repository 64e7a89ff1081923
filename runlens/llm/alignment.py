"""Alignment of two tokenizers' tokens over the bytes of whole texts.

Equal texts are brought together first: texts are shuffled by their full text, and each distinct
text is tokenised and aligned once. Its pairs of ids enter the corpus-wide counts with the number of
documents that have the text, and its measures are joined back to them by digest.

Neither tokenizer merges anything over a border between a character that is no white space and a
space, so a text is cut there into segments, and a segment that was met before is not encoded again.
Both tokens end at such a border, so groups, links and their text are those of the segments in order.

Pair counts stay a distributed table. Those of the most frequent pairs, at most ``HEAD`` of them,
travel with the tasks; all other pairs meet their counts in a join. The best count of each first id
is bounded by the first vocabulary.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte for byte,
have no tokens. Rows with a null or repeated id stay rows of their own. An empty table gives an empty
result. Other columns than id and text are not read. Ties for the best count all count as best.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.registry import query, stored, table

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts travel with every task.
HEAD = 1 << 20
#: Characters of text that are aligned at a time, and bytes of known segments that a task keeps between slices.
SLICE, KNOWN = 2 << 20, 48 << 20
#: White space and what follows up to the next space after a character that is no white space.
_SEGMENT = re.compile(r"\s+\S*(?:[^\S ]\s*\S*)*")
_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.b_space = self.b.piece_to_id("▁")
        self.a_bytes, self.b_bytes = self._a_bytes(), self._b_bytes()
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.a_names = np.array([b"%d%s" % (i, end) for end in (b",", b"|") for i in range(na)])
        self.b_names = np.array([b"%d%s" % (i, end) for end in (b",", b";") for i in range(nb)])

    def _a_bytes(self) -> list[bytes]:
        # Byte-level vocabularies write printable bytes as themselves and the others, in order, as U+0100 onwards.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        return [bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode() for name in names]

    def _b_bytes(self) -> list[bytes]:
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        return [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode()
                for i, n in enumerate(names)]


class Segments:
    """What is known of the segments met so far: sizes, ids of their links, and their groups in writing."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.sizes, self.ok = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.keys, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups: list[bytes] = []
        self.held = 0

    def numbers(self, segments: list[str]) -> np.ndarray:
        if self.held > KNOWN:
            self.forget()
        if new := [s for s in dict.fromkeys(segments) if s not in self.at]:
            self._learn(new)
        return np.fromiter(map(self.at.__getitem__, segments), np.int64, len(segments))

    def _learn(self, new: list[str]) -> None:
        p = self.pair
        a = [e.ids for e in p.a.encode_batch(new, add_special_tokens=False)]
        # The second tokenizer puts the leading space in itself, except before an empty text.
        b = [ids or [p.b_space] for ids in p.b.encode([s[1:] for s in new], num_threads=1)]
        ok = np.array([b"".join([p.a_bytes[i] for i in x]) == raw and b"".join([p.b_bytes[i] for i in y]) == raw
                       for x, y, raw in zip(a, b, (s.encode() for s in new))])
        sizes, keys, ends, groups = align(p, [x for x, k in zip(a, ok) if k], [y for y, k in zip(b, ok) if k])
        full, each = np.zeros((len(new), 4), np.int64), np.zeros(len(new), np.int64)
        full[ok], each[ok] = sizes, np.diff(ends, prepend=0)
        written = iter(groups)
        names = [next(written) if k else b"" for k in ok]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.sizes, self.ok = np.concatenate([self.sizes, full]), np.append(self.ok, ok)
        self.keys, self.start = np.append(self.keys, keys), np.append(self.start, self.start[-1] + np.cumsum(each))
        self.groups += names
        self.held += sum(map(len, names)) + 8 * len(keys) + sum(map(len, new)) + 200 * len(new)


def align(p: Pair, a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Sizes, ids of the links as one number, ends of each text's links, and groups, of texts that both tokenizers give back."""
    na, nb = (np.array([len(x) for x in v], np.int64) for v in (a, b))
    fa, fb = (np.fromiter(chain.from_iterable(v), np.int64, n.sum()) for v, n in ((a, na), (b, nb)))
    ea, eb = np.cumsum(p.a_len[fa]), np.cumsum(p.b_len[fb])
    # Between two neighbouring ends lies one token of each side, and every overlap is one such stretch.
    u = np.union1d(ea, eb)
    ia, ib = np.searchsorted(ea, u), np.searchsorted(eb, u)
    both = (ea[ia] == u) & (eb[ib] == u)
    text = np.searchsorted(ea[np.cumsum(na) - 1], u) if len(a) else np.zeros(0, np.int64)
    links, groups = np.bincount(text, minlength=len(a)), np.bincount(text[both], minlength=len(a))
    cut = u[both]
    ga, gb = np.searchsorted(cut, ea), np.searchsorted(cut, eb)
    n_a, n_b = np.bincount(ga, minlength=len(cut)), np.bincount(gb, minlength=len(cut))
    last_a, last_b = np.zeros(len(fa), np.int64), np.zeros(len(fb), np.int64)
    last_a[ia[both]], last_b[ib[both]] = 1, 1
    written = np.empty(len(fa) + len(fb), max(p.a_names.dtype, p.b_names.dtype, key=lambda t: t.itemsize))
    written[np.arange(len(fa)) + (np.cumsum(n_b) - n_b)[ga]] = p.a_names[fa + last_a * len(p.a_len)]
    written[np.arange(len(fb)) + np.cumsum(n_a)[gb]] = p.b_names[fb + last_b * len(p.b_len)]
    ends = np.cumsum(na + nb)
    names = [written[lo:hi].tobytes().translate(None, b"\0")[:-1] for lo, hi in zip((ends - na - nb).tolist(), ends.tolist())]
    return np.column_stack([na, nb, groups, links]), fa[ia] * len(p.b_len) + fb[ib], np.cumsum(links), names


def sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def measured(texts: list[str], known: Segments) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, digest of the groups, number of distinct pairs, the pairs text by text, and how often each is linked."""
    cut = [_SEGMENT.findall(" " + t) for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    at = known.numbers(list(chain.from_iterable(cut)))
    first = np.cumsum(n) - n
    ok = np.logical_and.reduceat(known.ok[at], first)
    sizes = np.add.reduceat(known.sizes[at], first) * ok[:, None]
    digests = [hashlib.sha256(b";".join([known.groups[i] for i in at[lo:lo + k].tolist()])).hexdigest() if good else ""
               for lo, k, good in zip(first.tolist(), n.tolist(), ok.tolist())]
    width = np.int64(len(known.ok))
    segment, times = sums(np.repeat(np.arange(len(texts)), n) * width + at, np.ones(len(at), np.int64))
    owner, segment = segment // width, segment % width
    kept = ok[owner]
    owner, segment, times = owner[kept], segment[kept], times[kept]
    size = known.start[segment + 1] - known.start[segment]
    width = np.int64(len(known.pair.a_len) * len(known.pair.b_len))
    keys, times = sums(np.repeat(owner, size) * width + known.keys[ranges(known.start[segment], size)], np.repeat(times, size))
    return sizes, digests, np.bincount(keys // width, minlength=len(texts)), keys % width, times


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """One stored row per distinct text: number, digest, copies, sizes, digest of the groups, pairs and their links."""
    distinct = (docs.select(F.col(text).cast("string").alias("text")).where("text <> ''")
                .groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
                .select("text", "copies", F.unhex(F.sha2(F.col("text"), 256)).alias("digest")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            size = np.cumsum(np.diff(np.frombuffer(batch[0].buffers()[1], np.int32, batch.num_rows + 1 + batch[0].offset)[batch[0].offset:]))
            cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                known = known or Segments(Pair(a_path, b_path))
                part = batch.slice(lo, hi - lo)
                sizes, digests, n, keys, times = measured(part[0].to_pylist(), known)
                at = np.append(0, np.cumsum(n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part[1], part[2], *(pa.array(sizes[:, i]) for i in range(4)), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(at, pa.array(keys)), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                    names=["copies", "digest", *_MEASURES, "groups_sha256", "pairs", "times"])

    shape = f"copies long, digest binary, {', '.join(f'{m} long' for m in _MEASURES)}, groups_sha256 string, pairs array<long>, times array<int>"
    return stored(distinct.mapInArrow(each, shape).select(F.monotonically_increasing_id().alias("text_no"), "*"), "alignment")


def pair_counts(texts: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): how many documents have the pair linked, and whether no pair of its first id has more."""
    counts = stored(texts.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("count")), "pair-counts")
    first = F.expr(f"pair div {b_size}")
    # A row per id of the first vocabulary at most.
    top = counts.groupBy(first.alias("first")).agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), first == F.col("first")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def head(counts: DataFrame, limit: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A power of two that at most ``limit`` pairs' counts reach, and those pairs in order with count and best."""
    sizes = {r.level: r["count"] for r in counts.groupBy(F.floor(F.log2("count")).alias("level")).count().collect()}
    level, n = max(sizes, default=0) + 1, 0
    while level > 0 and n + sizes.get(level - 1, 0) <= limit:
        level, n = level - 1, n + sizes.get(level - 1, 0)
    rows = counts.where(F.col("count") >= 2 ** level).toArrow()
    order = np.argsort(pair := rows["pair"].to_numpy())
    return 2 ** level, (pair[order], rows["count"].to_numpy()[order], rows["best"].to_numpy()[order])


def resolved(texts: DataFrame, counts: DataFrame, limit: int = HEAD) -> DataFrame:
    """Per distinct text its sizes, the links whose pair is best for its first id, and the sum of the counts over the links."""
    counts = stored(counts, "pair-best")
    least, lead = head(counts, limit)
    sent = texts.sparkSession.sparkContext.broadcast(lead)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for batch in batches:
            n = batch[1].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            keys, times = batch[1].flatten().to_numpy(), batch[2].flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
            hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            total, top = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            np.add.at(total, owner[hit], times[hit] * count[at[hit]])
            np.add.at(top, owner[hit], times[hit] * best[at[hit]])
            rest = np.append(0, np.cumsum(np.bincount(owner[~hit], minlength=len(n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(top), pa.array(total), pa.ListArray.from_arrays(rest, pa.array(keys[~hit])),
                 pa.ListArray.from_arrays(rest, pa.array(times[~hit]))], names=["text_no", "n_best", "count_sum", "pairs", "times"])

    known = stored(texts.select("text_no", "pairs", "times").mapInArrow(
        look_up, "text_no long, n_best long, count_sum long, pairs array<long>, times array<long>"), "alignment-head")
    rest = (known.select("text_no", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .select("text_no", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
            .join(counts.where(F.col("count") < least), "pair")
            .select("text_no", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum")))
    both = known.select("text_no", "n_best", "count_sum").union(rest).groupBy("text_no").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.select("text_no", "digest", *_MEASURES, "groups_sha256").join(both, "text_no")


def measures(docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}", *,
             text: str = "text", row_id: str = "doc_id", limit: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    import sentencepiece

    texts = aligned_texts(docs, a_path, b_path, text)
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    by_text = resolved(texts, pair_counts(texts, b_size), limit)
    numbers = [*_MEASURES, "n_best", "count_sum"]
    return (docs.select(F.col(row_id).alias("_id"), F.unhex(F.sha2(F.col(text).cast("string"), 256)).alias("digest"))
            .join(by_text, "digest", "left")
            .select(F.col("_id").alias(row_id), *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in numbers),
                    F.coalesce(F.col("groups_sha256"), F.lit("")).alias("groups_sha256")))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return measures(table(spark, folder, "documents"))
