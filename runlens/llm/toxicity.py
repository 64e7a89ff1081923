"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Vocabulary: every word that speaks for the label among at most ``MAX_EXAMPLES`` labelled
documents: it is in at least ``MIN_DOCS`` of them, more than twice as often with the label
as expected. Cosines are those of these words; document frequencies are counted over the
whole corpus. The examples form a sparse index in blocks of ``BLOCK``: for each term the
blocks it occurs in with its largest weight there. A document's cosine with a block is at
most its dot product with these maxima, so blocks are read in the order of that bound, each
time twice as many, until no bound reaches the k-th best cosine; short posting
lists are read whole. What is found is the exact top k.

The neighbours' distance-weighted vote is turned into a chance by a logistic curve that is
fitted to the examples' own votes with themselves left out. Index and vocabulary are bounded
by the examples, so they travel with the task; every document is scored whole, where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bytes as B
from runlens.llm.labelled import examples
from runlens.llm.registry import query, remainder, stored, table

MAX_EXAMPLES = 8192
MIN_DOCS = 3
BLOCK = 64
NEIGHBOURS = 15
SHORT_LISTS = 1 << 14
THRESHOLD = 0.5


def term_counts(run: B.Run, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term number, count) of the vocabulary's words in each document."""
    w = B.tokens(run, lower=True)
    at = np.searchsorted(terms, w.ids)
    hit = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == w.ids) if len(terms) else np.zeros(0, np.int64)
    key, count = np.unique(w.doc[hit] * max(len(terms), 1) + at[hit], return_counts=True)
    return key // max(len(terms), 1), key % max(len(terms), 1), count


class Sparse:
    """Entries (row, term, value) of a matrix in the order of rows, or of terms."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, shape: tuple[int, int], by_term: bool = False):
        order = np.lexsort((row, term) if by_term else (term, row))
        self.row, self.term, self.value, self.shape = row[order].astype(np.int32), term[order].astype(np.int32), value[order], shape
        lead, n = (self.term, shape[1]) if by_term else (self.row, shape[0])
        self.start = np.searchsorted(lead, np.arange(n + 1))

    def entries(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places of the entries of the leading numbers [first, last), range by range."""
        a, n = self.start[first], self.start[last] - self.start[first]
        return np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())

    def __getitem__(self, at: tuple) -> np.ndarray:
        dense = np.zeros(self.shape, self.value.dtype)
        dense[self.row, self.term] = self.value
        return dense[at]


def sparse(vectors: np.ndarray | Sparse) -> Sparse:
    if isinstance(vectors, Sparse):
        return vectors
    row, term = np.nonzero(vectors)
    return Sparse(row, term, vectors[row, term], vectors.shape)


class BlockMaxIndex:
    """Examples as sparse unit vectors over the vocabulary, in blocks with the largest weight of each term."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, y: np.ndarray, vectors: np.ndarray | Sparse):
        v = sparse(vectors)
        # Examples without any term are never near: their cosine is 0. Equal directions stand together.
        size = np.diff(v.start)
        filled = np.flatnonzero(size)
        best = np.lexsort((v.term, -v.value, v.row))
        one = v.term[best[v.start[filled]]]
        two = np.where(size[filled] > 1, v.term[best[np.minimum(v.start[filled] + 1, max(len(best) - 1, 0))]], -1)
        order = filled[np.lexsort((ids[filled], two, one))]
        place = np.zeros(len(size), np.int64)
        place[order] = np.arange(len(order))
        self.terms, self.idf, self.ids, self.y = terms, idf, ids[order], y[order]
        self.vectors = Sparse(place[v.row], v.term, v.value.astype(np.float32), (len(order), len(terms)))
        self.lists = Sparse(self.vectors.row, self.vectors.term, self.vectors.value, self.vectors.shape, True)
        # (term, block) pairs and the largest weight of each.
        n_blocks = -(-len(order) // BLOCK)
        key = self.vectors.term.astype(np.int64) * max(n_blocks, 1) + self.vectors.row // BLOCK
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[by]) > 0)) if len(key) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(self.vectors.value[by], first) if len(first) else np.zeros(0, np.float32)
        self.largest = Sparse(key[by][first] % max(n_blocks, 1), key[by][first] // max(n_blocks, 1), most, (n_blocks, len(terms)), True)

    def weigh(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (1 + np.log(count)) * self.idf[term]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest with a cosine above 0; ties go to the earlier example."""
        q = (weight / np.sqrt(weight @ weight)).astype(np.float32)
        at, best = np.zeros(0, np.int64), np.zeros(0, np.float32)
        n_blocks = self.largest.shape[0]
        if not n_blocks:
            return at, best
        lengths = self.lists.start[term + 1] - self.lists.start[term]
        if lengths.sum() <= SHORT_LISTS:
            e = self.lists.entries(term, term + 1)
            sims = np.bincount(self.lists.row[e], self.lists.value[e] * np.repeat(q, lengths), len(self.ids)).astype(np.float32)
            at = np.flatnonzero(sims > 0)
            at = at[at != leave_out]
            at = at[np.argsort(-sims[at], kind="stable")[:k]]
            return at, sims[at]
        e = self.largest.entries(term, term + 1)
        weights = np.repeat(q, self.largest.start[term + 1] - self.largest.start[term])
        bounds = np.bincount(self.largest.row[e], self.largest.value[e] * weights, n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        query_weights = np.zeros(self.largest.shape[1], np.float32)
        query_weights[term] = q
        done, step = 0, 1
        while done < len(order) and not (len(best) == k and bounds[order[done]] < best[-1] - 1e-6):
            group = np.sort(order[done:done + step])
            done, step = done + step, 2 * step
            e = self.vectors.entries(group * BLOCK, np.minimum((group + 1) * BLOCK, len(self.ids)))
            sims = np.bincount(self.vectors.row[e], self.vectors.value[e] * query_weights[self.vectors.term[e]], len(self.ids)).astype(np.float32)
            rows = np.flatnonzero(sims > 0)
            rows = rows[rows != leave_out]
            at, best = np.append(at, rows), np.append(best, sims[rows])
            top = np.lexsort((at, -best))[:k]
            at, best = at[top], best[top]
        return at, best

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        """Between -1 and 1: weights fall with the distance 1 - cosine; a lone neighbour counts less than many."""
        weight = 1 / (1.05 - cosines)
        return float(weight @ (2.0 * self.y[near] - 1) / (weight.sum() + 1))


def _vocabulary(rows: DataFrame, min_docs: int) -> np.ndarray:
    """Digests of all words that speak for the label, counted in Spark."""
    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch["y"].to_numpy(zero_copy_only=False)
            for run in B.slices(batch["text"]):
                w = B.tokens(run, lower=True)
                key = np.unique(np.stack([w.doc.astype(B.U64), w.ids], 1), axis=0)
                yield pa.RecordBatch.from_pydict({"term": B.signed(key[:, 1]),
                                                  "y": y[run.first + key[:, 0].astype(np.int64)].astype(np.int64)})

    n, p = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = rows.mapInArrow(distinct_words, "term long, y long").groupBy("term") \
        .agg(F.count("*").alias("df"), F.sum("y").alias("a")).where(F.col("df") >= min_docs)
    share = p / n if n else 0.0
    expected = F.col("df") * F.lit(share)
    # Only words that speak for the label: their absence says nothing about a document's kind of harm.
    got = seen.where(F.col("a") > 2 * expected).select("term").toArrow()
    return np.sort(got["term"].to_numpy().view(B.U64))


def _document_frequencies(docs: DataFrame, terms: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    """In how many documents of the corpus each term occurs, and the number of documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            for run in B.slices(batch[0]):
                df[:-1] += np.bincount(term_counts(run, terms)[1], minlength=len(terms))[:len(terms)]
                n += run.n
        df[-1] = n
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": met, "n": df[met]})

    got = docs.select(F.col(text).cast("string")).mapInArrow(count, "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(terms) + 1, np.int64)
    for r in got:
        df[r.term] = r.n
    return df[:-1], int(df[-1])


def _logistic(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a damped logistic fit of the label on the vote (Newton's method)."""
    x = np.stack([votes, np.ones(len(votes))], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    ab = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ ab))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, x.T @ (target - p) - np.array([1e-3, 1e-6]) * ab)
        ab = ab + step
        if np.abs(step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


class Model:
    """The index and the curve that turns votes into chances."""

    def __init__(self, index: BlockMaxIndex, curve: tuple[float, float], k: int):
        self.index, self.curve, self.k = index, curve, k

    def chance(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * vote + self.curve[1], -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_EXAMPLES,
          min_docs: int = MIN_DOCS, k: int = NEIGHBOURS, text: str = "text",
          row_id: str = "doc_id") -> Model:
    """Fit on at most ``limit`` labelled documents. Without any, every score is the same."""
    rows = examples(docs, labels, label, limit, text=text, row_id=row_id)
    terms = _vocabulary(rows, min_docs)
    df, n = _document_frequencies(docs, terms, text)
    idf = np.log((n + 1) / (df + 1)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in B.slices(batch["text"]):
                doc, term, count = term_counts(run, terms)
                cut = np.searchsorted(doc, np.arange(run.n + 1))
                own = slice(run.first, run.first + run.n)
                yield pa.RecordBatch.from_pydict({
                    "id": batch["id"].to_numpy(zero_copy_only=False)[own], "y": batch["y"].to_numpy(zero_copy_only=False)[own],
                    "term": [term[a:b] for a, b in zip(cut[:-1], cut[1:])],
                    "count": [count[a:b] for a, b in zip(cut[:-1], cut[1:])]})

    # At most ``limit`` ids with the numbers of their words in the vocabulary.
    got = rows.mapInArrow(vectors, "id long, y int, term array<long>, count array<long>").orderBy("id").toArrow()
    ids, y = got["id"].to_numpy(), got["y"].to_numpy().astype(np.float64)
    size = pc.list_value_length(got["term"]).to_numpy()
    row = np.repeat(np.arange(len(ids)), size)
    term, count = (pc.list_flatten(got[c]).to_numpy() for c in ("term", "count"))
    weight = (1 + np.log(count)) * idf[term]
    weight = weight / np.sqrt(np.bincount(row, weight ** 2, len(ids)))[row]
    index = BlockMaxIndex(terms, idf, ids, y, Sparse(row, term, weight, (len(ids), len(terms))))
    votes = np.zeros(len(index.ids))
    for i in range(len(index.ids)):
        own = slice(index.vectors.start[i], index.vectors.start[i + 1])
        near, cosines = index.nearest(index.vectors.term[own], index.vectors.value[own].astype(np.float64), k, leave_out=i)
        votes[i] = index.vote(near, cosines) if len(near) else -1.0
    bare = size == 0  # nothing near: the vote of a document without any of the terms
    every_vote = np.append(votes, np.full(int(bare.sum()), -1.0))
    return Model(index, _logistic(every_vote, np.append(index.y, y[bare])), k)


def score(docs: DataFrame, model: Model, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(id, score, vote, evidence) of every document; evidence names the nearest examples and their cosines.

    A null or empty text, like any without a term of the vocabulary, has no neighbour and votes -1.
    """
    index = model.index

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in B.slices(batch[1]):
                doc, term, count = term_counts(run, index.terms)
                votes = np.full(run.n, -1.0)
                evidence: list[list] = [[] for _ in range(run.n)]
                cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
                for a, b in zip(cut, [*cut[1:], len(doc)] if len(doc) else []):
                    found, cosines = index.nearest(term[a:b], index.weigh(term[a:b], count[a:b]), model.k)
                    if len(found):
                        votes[doc[a]] = index.vote(found, cosines)
                        evidence[doc[a]] = [{"id": int(i), "cosine": float(c), "label": int(v)} for i, c, v in
                                            zip(index.ids[found[:3]], cosines[:3], index.y[found[:3]])]
                yield pa.RecordBatch.from_arrays(
                    [batch[0].slice(run.first, run.n), pa.array(model.chance(votes)), pa.array(votes),
                     pa.array(evidence, pa.list_(pa.struct({"id": pa.int64(), "cosine": pa.float64(), "label": pa.int32()})))],
                    names=["id", "score", "vote", "evidence"])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        near, f"id {kind}, score double, vote double, evidence array<struct<id: long, cosine: double, label: int>>") \
        .withColumnRenamed("id", row_id)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows whose score is below ``threshold``, columns untouched; they are judged where they are read."""
    index = model.index

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = np.full(batch.num_rows, -1.0)
            for run in B.slices(batch[text]):
                doc, term, count = term_counts(run, index.terms)
                cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
                for a, b in zip(cut, np.append(cut[1:], len(doc))):
                    found, cosines = index.nearest(term[a:b], index.weigh(term[a:b], count[a:b]), model.k)
                    if len(found):
                        votes[run.first + doc[a]] = index.vote(found, cosines)
            yield batch.filter(pa.array(model.chance(votes) < threshold))

    return docs.mapInArrow(clean, docs.schema)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"))
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
