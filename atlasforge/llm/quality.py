"""Document quality by similarity-weighted votes of labelled latent-semantic vectors.

A text is a bag of terms in two groups: its words, and its style (what stands between words, the case shape of words, words that repeat
one of the last three words, and the magnitude of its length). Every term of the labelled texts has a column of its own.
Each group is log-TF-IDF weighted with frequencies counted over all documents, scaled to unit length, and weighted. Terms that no
labelled text has lie on no axis; they lengthen their group as if each occurred once and in one document. A truncated SVD of the
labelled sample gives the latent axes. The labelled vectors are broadcast (at most 2 * calibrate.SAMPLE_PER_CLASS rows of
DIMS numbers); every document's exact cosines with all of them are computed in blocks, its nearest neighbours and all that tie with the
last of them vote by the fourth power of similarity, and isotonic regression on left-one-out votes makes probabilities of them.

Every document is scored by its whole text; null is empty. A text without words has only its length and case of style,
so it is nearest to others of that kind; where nothing of it is known, all labelled texts tie and vote. Without labelled rows
every score is 0.5. Repeated doc_ids are scored row by row; a null doc_id is scored and is not held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import SAMPLE_PER_CLASS, Isotonic, Sample, held_out, labelled_sample
from .common import U64, Words, mix, span_hashes
from .terms import TermTable, count_terms, document_frequencies

WORD_WEIGHT, STYLE_WEIGHT = 0.35, 1.0
DIMS, SPARE, NEIGHBOURS, BLOCK, TIE = 48, 16, 25, 512, 1e-6
#: Rows of a term matrix that the driver takes at a time when it makes the axes.
PART = 1 << 14
#: The lowest bit of a term's hash tells its group.
STYLE = U64(1)


def terms_of(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, term hash) of words, gaps, case shapes, repeats and lengths."""
    w, n_docs, n = Words(data, offs), len(offs) - 1, len(data)
    sizes = np.diff(w.bounds)
    owner = np.repeat(np.arange(n_docs), sizes)
    word = w.hashes()
    yield owner, word & ~STYLE
    # from the word's end to the next word or the text's end
    until = np.minimum(np.append(w.starts[1:], n)[: len(w.ends)], offs[owner + 1])
    yield owner, span_hashes(data, w.ends, until, salt=11) | STYLE
    upper = np.zeros(n + 1, dtype=np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    big, size = upper[w.ends] - upper[w.starts], w.ends - w.starts
    shape = np.select([big == 0, (big == size) & (size > 1), (big == 1)], [0, 1, 2], 3)
    again = np.zeros(len(word), dtype=bool)
    for k in (1, 2, 3):
        again[k:] |= (word[k:] == word[:-k]) & (owner[k:] == owner[:-k])
    length = np.ceil(np.log2(sizes + 1)).astype(np.int64)
    named = np.concatenate([shape, np.full(int(again.sum()), 4), 8 + length])
    yield np.concatenate([owner, owner[again], np.arange(n_docs)]), mix(named.astype(U64) * U64(0xD1342543DE82EF95) + U64(12)) | STYLE


def weighted(n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray, unknown: np.ndarray, idf: np.ndarray, style: np.ndarray, rare: float) -> np.ndarray:
    """Weights of the triples: log-TF-IDF, unit length within each group of a text, times the group's weight."""
    value = np.log1p(count) * idf[term]
    group = 2 * row + style[term]
    square = np.bincount(group, weights=value**2, minlength=2 * n).astype(float)
    square[::2] += unknown * (np.log(2) * rare) ** 2
    return value / np.sqrt(np.maximum(square, 1e-24))[group] * np.where(style[term], STYLE_WEIGHT, WORD_WEIGHT)


class Model:
    def __init__(self, sample: Sample, df: np.ndarray, n_docs: int, dims: int = DIMS, k: int = NEIGHBOURS):
        self.terms, self.y, self.weight, self.k = sample.terms, sample.y, sample.weight, k
        self.idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)
        self.rare = float(np.log((1 + n_docs) / 2) + 1)
        self.style = (sample.terms & STYLE).astype(np.int64)
        n = len(sample.y)
        owner = sample.owner.astype(np.int32)
        value = weighted(n, owner, sample.number, sample.count, np.zeros(n), self.idf, self.style, self.rare).astype(np.float32)
        # axes of the truncated SVD: a randomised range of the rows, sharpened by power iterations
        wide = min(dims + SPARE, n)
        y = np.random.default_rng(7).standard_normal((n, wide)).astype(np.float32)
        turn = np.argsort(sample.number, kind="stable")
        by_term = (np.searchsorted(sample.number[turn], np.arange(len(sample.terms) + 1)), owner[turn], value[turn])
        del owner, turn
        for _ in range(4):
            y, _ = np.linalg.qr(product(sample.bounds, sample.number, value, product(*by_term, y)))
        side = product(*by_term, y)  # terms by wide, the largest array here: all that follows takes it some rows at a time
        del by_term
        parts = [slice(i, i + PART) for i in range(0, len(side), PART)]
        power, turned = np.linalg.eigh(sum((x.T @ x for x in (side[p].astype(np.float64) for p in parts)), np.zeros((wide, wide))))
        top = np.argsort(-power)[: min(dims, int((power > 1e-9 * max(power.max(), 1e-30)).sum()))]
        turned = (turned[:, top] / np.sqrt(power[top])).astype(np.float32)
        self.axes = np.empty((len(side), len(top)), dtype=np.float32)
        for p in parts:
            self.axes[p] = side[p] @ turned
        del side
        self.bank = unit(product(sample.bounds, sample.number, value, self.axes))
        votes = [self.votes(self.bank[i : i + BLOCK], np.arange(i, min(i + BLOCK, n))) for i in range(0, n, BLOCK)] if n > 1 else [np.full(n, 0.5)]
        self.map = Isotonic(np.concatenate(votes), sample.y, sample.weight)

    def votes(self, x: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
        cosine = x @ self.bank.T
        if skip is not None:
            cosine[np.arange(len(x)), skip] = -2
        k = min(self.k, cosine.shape[1] - (skip is not None))
        kth = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
        i, j = np.nonzero(cosine >= np.maximum(kth, -1.5)[:, None] - TIE)
        w = np.maximum(cosine[i, j], 1e-3).astype(np.float64) ** 4 * self.weight[j]
        return np.bincount(i, weights=w * self.y[j], minlength=len(x)) / np.bincount(i, weights=w, minlength=len(x))

    def table(self) -> TermTable:
        if "_table" not in self.__dict__:
            self._table = TermTable(self.terms)
        return self._table

    def vectors(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Per slice: first row, and the latent unit vectors of its texts."""
        for row, n, r, t, c, unknown in count_terms(col, self.table(), terms_of):
            value = weighted(n, r, t, c, unknown, self.idf, self.style, self.rare).astype(np.float32)
            yield row, unit(product(np.searchsorted(r, np.arange(n + 1)), t, value, self.axes))

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        for row, x in self.vectors(col):
            for i in range(0, len(x), BLOCK):
                out[row + i : row + i + len(x[i : i + BLOCK])] = self.map(self.votes(x[i : i + BLOCK]))
        return out


def product(bounds: np.ndarray, number: np.ndarray, value: np.ndarray, dense: np.ndarray, entries: int = 1 << 16) -> np.ndarray:
    """A sparse matrix given by rows (entries bounds[i]:bounds[i+1] of row i), times a dense one, some entries at a time."""
    out = np.zeros((len(bounds) - 1, dense.shape[1]), dtype=np.float32)
    for a in range(0, len(number), entries):
        b = min(a + entries, len(number))
        first, last = np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, b, side="left")
        start = np.maximum(bounds[first:last], a)
        full = np.flatnonzero(np.minimum(bounds[first + 1 : last + 1], b) > start)
        part = dense[number[a:b]]
        part *= value[a:b, None]
        out[first + full] += np.add.reduceat(part, start[full] - a, axis=0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """The model from labelled rows outside the held-out fold; None without any."""
    sample = labelled_sample(docs, labels, label, ~held_out(folds, fold), terms_of, per_class)
    return Model(sample, *document_frequencies(docs, sample.terms, terms_of)) if len(sample.y) else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every document."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            p = np.full(batch.num_rows, 0.5) if m is None else m.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold. Without a model all stay."""
    if model is None:
        return docs
    cast, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            yield batch.filter(pa.array(m.scores(batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
