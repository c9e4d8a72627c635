"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are the words of a text and their prefixes of ``PREFIX`` bytes (inflected words share one). All of
them count, in the examples and in the texts. The model is fitted on the examples: the inverse document
frequency of a term is that of the examples, each class weighted to its share of all labelled rows, and a
term that no example holds has the largest one. Such a term meets no example but lengthens the text's
vector, so cosines are over whole vectors. Each term's weight has a factor between ``LEAST_FACTOR`` and 1
that grows with the chi-square of its presence in the two classes of examples: terms that tell nothing of
the classes weigh little beside those that do, and decide where a text has no others.

Index: the examples lie in blocks, ordered by class and strongest term. Postings of terms that ``COMMON``
examples hold are rows of a matrix, those of rarer terms are lists. Every block has the largest weight of
each common term (block-max); what the lists add is short work and known beforehand. A text's upper bound
for a block is the dot product with the block maxima and the largest addition; blocks are visited in descending order of bound, and a
block is skipped when its bound does not exceed the text's ``k``-th best cosine so far. Skipped blocks
cannot change the neighbours: the search is exact.

Score: neighbours vote with weight 1 / (1 - cosine + ``NEAREST``); a logistic curve over the vote share and
its product with the best cosine, fitted on the examples' own leave-one-out votes with the class shares of
all labelled rows, and with weight ``COPY_WEIGHT`` on the votes for a copy of each, turns votes into a
probability. A text that shares no term with any example gets the
score of an empty vote.

Bounds: ``PER_CLASS`` examples of each class, smallest md5 of the id first, while the distinct terms of all
examples stay within ``MOST_POSTINGS``; the index that every task gets has one weight for each of them.
Labels are learned only from rows that the caller marks as training rows.

Cases: null text counts as empty; null or repeated labels: the largest value per id, null ignored; an
example whose id has several texts is the smallest of them; equal cosines are taken in the order of md5 of
the example's id, whatever its label; no labelled rows of a class: every score is the share of the other,
smoothed; repeated documents are scored alike; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import (
    crc_remainder,
    id_and_text,
    id_text,
    map_steps,
    record_batch,
    written,
)
from titlegauge.llm.textwords import WHITE_SPACE_OR_PUNCTUATION, find_words

PER_CLASS = 512
MOST_POSTINGS = 2_000_000
PREFIX = 4
NEIGHBOURS = 15
NEAREST = 0.05
BLOCK = 64
#: Examples from which on a term's postings are a row of a matrix (at most MOST_POSTINGS / COMMON rows).
COMMON = 64
#: Texts that are searched together.
TOGETHER = 128
#: Chi-square at which a term has its full weight (1 degree of freedom; about 1e-5 by chance).
FULL_CHI_SQUARE, LEAST_FACTOR = 20.0, 0.02
COPY_WEIGHT = 0.1
REJECT_AT = 0.7


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times in the row): words and word prefixes, sorted by row and term."""
    words = find_words(column, WHITE_SPACE_OR_PUNCTUATION)
    long = words.end - words.start > PREFIX
    begin = words.start[long]
    rows = np.concatenate([words.row, words.row[long]])
    terms = np.concatenate([words.hashes(), words.hashes(begin, begin + PREFIX) ^ np.uint64(1)])
    return _counted(rows, terms)


def _counted(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    first = np.flatnonzero(new)
    return rows[first], terms[first], np.diff(np.append(first, len(rows)))


@dataclass
class Vectors:
    """Sparse rows: ``terms`` and ``weights`` of row i lie at ``first[i] : first[i + 1]``, by term."""

    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def rows(self, a: int, b: int) -> Vectors:
        i, j = self.first[a], self.first[b]
        return Vectors(self.first[a : b + 1] - i, self.terms[i:j], self.weights[i:j])

    def take(self, order: np.ndarray) -> Vectors:
        sizes = np.diff(self.first)[order]
        first = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.first[:-1][order] - first[:-1], sizes) + np.arange(first[-1])
        return Vectors(first, self.terms[at], self.weights[at])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


class ExampleIndex:
    """Examples in blocks with block maxima, the vocabulary with its frequencies, and the fitted curve."""

    def __init__(self, vocabulary, idf, unseen_idf, ids, tie, toxic, vectors: Vectors, prior):
        self.vocabulary, self.idf, self.unseen_idf = vocabulary, idf, unseen_idf
        place = np.arange(len(ids))
        strongest = np.zeros(len(ids), np.int64)
        by_weight = np.lexsort((vectors.terms, -vectors.weights, vectors.row_of()))
        filled = np.diff(vectors.first) > 0
        strongest[filled] = vectors.terms[by_weight[vectors.first[:-1][filled]]]
        order = np.lexsort((place, strongest, toxic))
        self.ids, self.tie, self.toxic, vectors = ids[order], tie[order], toxic[order], vectors.take(order)
        self.starts = np.arange(0, len(order), BLOCK)
        self._lay_out(vectors)
        self.prior = prior
        self.curve = self._fit(vectors) if len(set(self.toxic.tolist())) == 2 else None

    def _lay_out(self, vectors: Vectors) -> None:
        """Postings by term: those of common terms as rows of a matrix, the others as lists."""
        example, terms, weights = vectors.row_of(), vectors.terms, vectors.weights
        held = np.bincount(terms, minlength=len(self.vocabulary))
        common = held >= COMMON
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), len(self.ids)), np.float32)
        there = common[terms]
        self.matrix[self.column[terms[there]], example[there]] = weights[there]
        self.maxima = np.maximum.reduceat(self.matrix, self.starts, axis=1) if len(self.starts) else self.matrix
        order = np.argsort(terms[~there], kind="stable")
        self.list_first = np.append(0, np.cumsum(np.where(common, 0, held)))
        self.list_example, self.list_weight = example[~there][order], weights[~there][order]

    def _by_lists(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """What the lists of the terms add to the cosines of each text and example."""
        begin = self.list_first[terms]
        sizes = self.list_first[terms + 1] - begin
        ends = np.cumsum(sizes)
        at = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        place = np.repeat(rows, sizes) * len(self.ids) + self.list_example[at]
        each = np.repeat(weights, sizes) * self.list_weight[at]
        return np.bincount(place, weights=each, minlength=n * len(self.ids)).reshape(n, -1).astype(np.float32)

    def vectors_of(self, column: pa.Array) -> Vectors:
        """Unit vectors of texts; terms outside the vocabulary are in their length alone."""
        rows, hashes, times = text_terms(column)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        idf = np.where(known, self.idf[at], self.unseen_idf) if len(self.vocabulary) else np.full(len(hashes), self.unseen_idf)
        weights = (1 + np.log(times)) * idf
        length = np.sqrt(np.bincount(rows, weights=weights * weights, minlength=len(column)))
        weights = weights / np.maximum(length, 1e-12)[rows]
        first = np.searchsorted(rows[known], np.arange(len(column) + 1))
        return Vectors(first, at[known], weights[known].astype(np.float32))

    def neighbours(self, queries: Vectors, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``NEIGHBOURS`` best cosines of each query and their example numbers (-1: none)."""
        n = len(queries)
        best, found = np.zeros((n, NEIGHBOURS), np.float32), np.full((n, NEIGHBOURS), -1, np.int64)
        for a in range(0, n if len(self.ids) else 0, TOGETHER):
            b = min(n, a + TOGETHER)
            part = None if without is None else without[a:b]
            best[a:b], found[a:b] = self._search(queries.rows(a, b), part)
        return best, found

    def _search(self, queries: Vectors, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(queries), NEIGHBOURS
        best, found = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
        keys, kth = np.zeros((n, k), np.int64), np.zeros(n)
        row, column = queries.row_of(), self.column[queries.terms]
        there = column >= 0
        dense = np.zeros((n, len(self.matrix)), np.float32)
        dense[row[there], column[there]] = queries.weights[there]
        listed = self._by_lists(row[~there], queries.terms[~there], queries.weights[~there], n)
        bounds = dense @ self.maxima + np.maximum.reduceat(listed, self.starts, axis=1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for turn in range(len(self.starts)):
            block_of = order[:, turn]
            bound = bounds[np.arange(n), block_of]
            # Not below: an equal cosine may win its tie. The margin covers single precision sums.
            alive = np.flatnonzero((bound > 0) & (bound + 1e-5 >= kth))
            if not len(alive):
                break
            for b in np.unique(block_of[alive]):
                block = slice(self.starts[b], self.starts[b] + BLOCK)
                rows = alive[block_of[alive] == b]
                scores = np.minimum(dense[rows] @ self.matrix[:, block] + listed[rows, block], 1)
                if without is not None:
                    own = without[rows][:, None] == np.arange(len(self.ids))[block]
                    scores = np.where(own, 0, scores)
                # By cosine to six places, then md5 of the id: ties depend on no order of visits and no label.
                steps = np.rint(scores * 1e6).astype(np.int64)
                key = np.where(steps > 0, (steps << 32) + len(self.ids) - self.tie[block], 0)
                both = np.concatenate([keys[rows], key], axis=1)
                keys[rows] = -np.partition(-both, k - 1, axis=1)[:, :k]
                kth[rows] = (keys[rows].min(axis=1) >> 32) / 1e6
        keys = -np.sort(-keys, axis=1)
        by_tie = np.argsort(self.tie)
        held = keys > 0
        found[held] = by_tie[(len(self.ids) - (keys[held] & 0xFFFFFFFF))]
        best[held] = (keys[held] >> 32) / 1e6
        return best, found

    def votes(self, best: np.ndarray, found: np.ndarray) -> np.ndarray:
        """(1, vote share, best cosine) of each query; an empty vote is at the prior."""
        weight = np.where(found >= 0, 1 / (1 + NEAREST - np.minimum(best, 1)), 0)
        toxic = np.where(found >= 0, self.toxic[np.maximum(found, 0)], 0)
        share = (weight * toxic).sum(axis=1) + self.prior
        share = share / (weight.sum(axis=1) + 1)
        return np.stack([np.ones(len(best)), share, share * best[:, 0]], axis=1)

    def _fit(self, vectors: Vectors) -> np.ndarray:
        """Logistic regression on leave-one-out votes, classes weighted to their real shares."""
        alone, copied = self.neighbours(vectors, without=np.arange(len(vectors))), self.neighbours(vectors)
        x = np.concatenate([self.votes(*alone), self.votes(*copied)])
        y = self.toxic.astype(float)
        weight = np.where(y > 0, self.prior / max(y.mean(), 1e-9), (1 - self.prior) / max(1 - y.mean(), 1e-9))
        y, weight = np.tile(y, 2), np.concatenate([weight, COPY_WEIGHT * weight])
        curve, ridge = np.zeros(3), 0.5 * np.eye(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            gradient = x.T @ (weight * (y - p)) - ridge @ curve
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
            move = np.linalg.solve(hessian, gradient)
            curve = curve + move
            if np.abs(move).max() < 1e-9:
                break
        return curve

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, neighbours' cosines and their numbers for the texts of one batch."""
        best, found = self.neighbours(self.vectors_of(column))
        if self.curve is None:
            return np.full(len(column), self.prior), best, found
        score = 1 / (1 + np.exp(-np.clip(self.votes(best, found) @ self.curve, -30, 30)))
        return score, best, found


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def fit_index(docs: DataFrame, labels: DataFrame, training) -> ExampleIndex:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic (once per id); ``training``: a condition on doc_id."""
    labels = labels.filter(training)
    shares = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    order = F.md5(F.concat(F.lit("example"), id_text(F.col("doc_id"))))
    parts = [labels.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(PER_CLASS) for c in (0, 1)]
    chosen = written(parts[0].unionByName(parts[1]))
    examples = (
        docs.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .withColumn("place", order)
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, terms, times = text_terms(batch.column("text"))
        cut = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
        return record_batch(
            doc_id=batch.column("doc_id"), toxic=batch.column("toxic"), place=batch.column("place"),
            terms=pa.ListArray.from_arrays(cut, pa.array(terms.view(np.int64))),
            times=pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32))),
        )

    counted = written(
        map_steps(examples, step, "doc_id long, toxic int, place string, terms array<long>, times array<int>")
    )
    # The sizes of at most 2 * PER_CLASS rows, then the rows within the bound.
    sizes = counted.select("place", "doc_id", F.size("terms").alias("n")).orderBy("place", "doc_id").collect()
    total = np.cumsum([r["n"] for r in sizes])
    kept = [r["doc_id"] for r, t in zip(sizes, total, strict=True) if t <= MOST_POSTINGS]
    inside = counted if len(kept) == len(sizes) else counted.filter(F.col("doc_id").isin(kept))
    table = inside.orderBy("place", "doc_id").select("doc_id", "toxic", "terms", "times").toArrow().combine_chunks()
    ids, toxic = table["doc_id"].to_numpy(), table["toxic"].to_numpy().astype(np.int64)
    terms = _flat(table["terms"]).view(np.uint64)
    times = _flat(table["times"])
    sizes_of = np.array([len(x) for x in table["terms"]], np.int64)
    first = np.append(0, np.cumsum(sizes_of)).astype(np.int64)
    vocabulary, place = np.unique(terms, return_inverse=True)
    of_toxic = np.repeat(toxic, sizes_of)
    # A term's share of all labelled rows, from its share of each class.
    n_toxic = int(toxic.sum())
    held = [np.bincount(place[of_toxic == c], minlength=len(vocabulary)) for c in (0, 1)]
    share = prior * held[1] / max(n_toxic, 1) + (1 - prior) * held[0] / max(len(toxic) - n_toxic, 1)
    n = max(len(ids), 1)
    idf = (np.log((n + 1) / (share * n + 1)) + 1) * _factors(held[1], held[0], n_toxic, len(toxic) - n_toxic)
    unseen = LEAST_FACTOR * float(np.log(n + 1) + 1)
    weights = (1 + np.log(times)) * idf[place]
    row = np.repeat(np.arange(len(ids)), sizes_of)
    length = np.sqrt(np.bincount(row, weights=weights * weights, minlength=len(ids)))
    unit = (weights / np.maximum(length, 1e-12)[row]).astype(np.float32)
    by_term = np.lexsort((place, row))
    vectors = Vectors(first, place[by_term], unit[by_term])
    return ExampleIndex(vocabulary, idf, unseen, ids, np.arange(len(ids)), toxic, vectors, prior)


def _factors(t: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How much each term counts, from the examples of either class that hold it."""
    total, held = n_toxic + n_clean, t + c
    spread = held * (total - held) * float(max(n_toxic, 1)) * max(n_clean, 1)
    chi = total * (t * float(n_clean) - c * float(n_toxic)) ** 2 / np.maximum(spread, 1)
    return np.maximum(np.minimum(chi / FULL_CHI_SQUARE, 1) ** 2, LEAST_FACTOR)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    training=None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """doc_id, score, predicted, and the evidence: ids, labels and cosines of the neighbours.

    ``training``: condition on ``doc_id`` that says which labels may be learned (all by default).
    """
    docs = id_and_text(docs, id_col, text_col)
    index = fit_index(docs, _labelled(labels, id_col, label_col), F.lit(True) if training is None else training)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        score, best, found = index.score(batch.column("text"))
        cut = np.append(0, np.cumsum((found >= 0).sum(axis=1))).astype(np.int32)
        real = found >= 0
        lists = [index.ids[found[real]], index.toxic[found[real]].astype(np.int32), best[real].astype(np.float64)]
        ids, votes, cosines = (pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in lists)
        return record_batch(
            doc_id=batch.column("doc_id"), score=score, predicted=(score >= REJECT_AT).astype(np.int32),
            neighbours=ids, neighbour_labels=votes, cosines=cosines,
        )

    return map_steps(
        docs, step,
        "doc_id long, score double, predicted int, neighbours array<long>, neighbour_labels array<int>, cosines array<double>",
    )


def held_out(doc_id="doc_id"):
    """The rows whose labels are never learned in the contract's query."""
    return crc_remainder(F.col(doc_id), 3) == 1


def contract_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, labels, ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours", "cosines")
