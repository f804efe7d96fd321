"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings of 4 and 6 bytes, all of them: the vocabulary is every term of the labelled examples. A
term's weight in a text is (1 + ln tf) * idf * relevance; document frequencies come from all documents, and relevance is FLOOR plus
the squared smoothed log ratio of the term's rates in the two classes, so a term without evidence counts little but counts.
Terms that no labelled example has add nothing to any product; they would only lengthen the document's own vector, by which
all its cosines are divided alike, so they change neither the order nor the votes.

Examples are ordered by their heaviest term and taken in blocks of BLOCK. The terms that most examples have (as many as fit
HEAD_BYTES) are stored as full rows, whose part of the cosine is taken for all examples at once; the lists of rare terms are added
whole. The lists in between are cut by block, and each piece keeps its greatest weight: to what a block's best example has so far
a query adds these maxima, a bound for every block. It scores the blocks of the highest bounds, and then all others whose bound
reaches the k-th best cosine so far, so the
result is exact to the rounding of single floats (TIE). The k best examples, and all that tie with the
k-th, vote by squared cosine. Isotonic regression turns votes into probabilities; its votes come from FOLDS folds, in each
of which relevance and index are made without the fold's own labels. The nearest examples are returned as evidence.

The labelled sample is bounded (calibrate.SAMPLE_PER_CLASS rows a class, SAMPLE_BYTES of text), and with it the broadcast
model. Every document is scored by its whole text; null is empty. A text without known terms has cosine 0 with every example, so all of
them tie and vote. Without labelled rows every score is 0.5. Repeated doc_ids are scored row by row; a null doc_id is
scored and is not held out. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import SAMPLE_PER_CLASS, Isotonic, Sample, held_out, labelled_sample
from .common import Words, span_hashes
from .terms import TermTable, count_terms, document_frequencies

BEGINNINGS = (4, 6)
FLOOR, SMOOTHING = 0.05, 5.0
NEIGHBOURS, BLOCK, FOLDS = 9, 32, 4
TIE, HEAD_BYTES, MIDDLE_BYTES, RARE, BATCH = 2e-6, 32 << 20, 8 << 20, 48, 128


def terms_of(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, term hash) of the words, then of the beginnings of each length."""
    w = Words(data, offs)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(w.bounds))
    yield owner, w.hashes()
    for k in BEGINNINGS:
        at = np.flatnonzero(w.ends - w.starts > k)
        yield owner[at], span_hashes(w.low, w.starts[at], w.starts[at] + k, salt=k)


def relevance(sample: Sample, rows: np.ndarray) -> np.ndarray:
    """FLOOR + squared log ratio of each term's rates in the two classes, from the sampled texts marked in `rows`."""
    owner, n = sample.owner, len(sample.terms)
    part = rows[owner]
    rate = []
    for c in (1, 0):
        mine = rows & (sample.y == c)
        have = np.bincount(sample.number[part & (sample.y[owner] == c)], minlength=n)
        prior = mine.sum() / max(1, rows.sum())
        rate.append((have + SMOOTHING * max(prior, 1e-6)) / (mine.sum() + SMOOTHING))
    return FLOOR + (np.log(rate[0]) - np.log(rate[1])) ** 2


class BlockMaxIndex:
    """Postings of vectors by term and example, cut where the block of examples changes, with each piece's greatest weight."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, n_terms: int, block: int = BLOCK, head_bytes: int = HEAD_BYTES, middle_bytes: int = MIDDLE_BYTES):
        order = np.lexsort((row, term))
        self.row, self.value = row[order].astype(np.int32), value[order].astype(np.float32)
        term = term[order]
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        self.term_start = np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int32)
        df = np.diff(self.term_start)
        by = np.argsort(-df, kind="stable")
        head = min(head_bytes // (4 * self.blocks * block), int((df * 128 > n).sum()))
        middle = min(middle_bytes // (4 * self.blocks), int((df > RARE).sum()) - head)
        self.head, self.middle = by[:head], np.sort(by[head : head + max(0, middle)])

    @cached_property
    def tier(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term: 2 for the head, 1 for those with block maxima, 0 for the rest; and its number in its tier."""
        kind, number = np.zeros(len(self.term_start) - 1, dtype=np.int8), np.zeros(len(self.term_start) - 1, dtype=np.int32)
        for k, terms in ((1, self.middle), (2, self.head)):
            kind[terms], number[terms] = k, np.arange(len(terms))
        return kind, number

    @cached_property
    def rows(self) -> np.ndarray:
        """The head terms' weights in all examples."""
        out = np.zeros((len(self.head), self.blocks * self.block), dtype=np.float32)
        for i, t in enumerate(self.head.tolist()):
            a, b = self.term_start[t], self.term_start[t + 1]
            out[i, self.row[a:b]] = self.value[a:b]
        return out

    @cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The middle terms by block: greatest weight, first posting, and number of postings."""
        best = np.zeros((len(self.middle), self.blocks), dtype=np.float32)
        first, size = np.zeros(best.shape, dtype=np.int32), np.zeros(best.shape, dtype=np.int32)
        at = _ranges(self.term_start[self.middle], np.diff(self.term_start)[self.middle])
        who = np.repeat(np.arange(len(self.middle)), np.diff(self.term_start)[self.middle])
        block = self.row[at] // self.block
        start = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (block[1:] != block[:-1]))) if len(at) else at
        if len(at):
            best[who[start], block[start]] = np.maximum.reduceat(self.value[at], start)
            first[who[start], block[start]] = at[start]
            size[who[start], block[start]] = np.diff(np.append(start, len(at)))
        return best, first, size

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("tier", "rows", "pieces")}

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, values): examples and products of the k best and of all that equal the k-th, best first."""
        k = min(k, self.n)
        kind, number = self.tier
        for a in range(0, len(queries), BATCH):
            part = queries[a : a + BATCH]
            dense = np.zeros((len(part), len(self.head)), dtype=np.float32)
            for i, (term, value) in enumerate(part):
                at = kind[term] == 2
                dense[i, number[term[at]]] = value[at]
            base = dense @ self.rows
            for i, (term, value) in enumerate(part):
                yield self._one(term, value, base[i].astype(np.float64), k)

    def _one(self, term: np.ndarray, value: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        kind, number = self.tier
        rest, middle = kind[term] == 0, kind[term] == 1
        start = self.term_start[term[rest]]
        self._add(score, start, self.term_start[term[rest] + 1] - start, value[rest])
        row, weight = number[term[middle]], value[middle]
        best, first, size = self.pieces
        bound = score.reshape(self.blocks, self.block).max(axis=1) + weight.astype(np.float32) @ best[row]
        # the blocks of the highest bounds give a k-th best, which rules out most others
        some = np.argsort(-bound, kind="stable")[: max(4, -(-2 * k // self.block))]
        self._add_blocks(score, row, weight, some, first, size)
        seen = (some[:, None] * self.block + np.arange(self.block)).reshape(-1)
        seen = score[seen[seen < self.n]]
        kth = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else -1.0
        live = bound >= kth - TIE
        live[some] = False
        self._add_blocks(score, row, weight, np.flatnonzero(live), first, size)
        # examples of blocks left out have parts of their scores, which are below the k-th best
        score = score[: self.n]
        kth = np.partition(score, self.n - k)[self.n - k]
        found = np.flatnonzero(score >= kth - TIE)
        order = np.lexsort((found, -score[found]))
        return found[order], score[found[order]]

    def _add_blocks(self, score: np.ndarray, row: np.ndarray, weight: np.ndarray, blocks: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        many = size[row[:, None], blocks]
        i, j = np.nonzero(many)
        self._add(score, first[row[i], blocks[j]], many[i, j], weight[i])

    def _add(self, score: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray) -> None:
        at = _ranges(start, size)
        score += np.bincount(self.row[at], weights=self.value[at] * np.repeat(weight, size), minlength=len(score))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Examples:
    """Unit vectors of labelled texts under given term weights, their index and their votes."""

    def __init__(self, sample: Sample, rows: np.ndarray, weight: np.ndarray, k: int):
        self.k = k
        chosen = np.flatnonzero(rows)
        owner = sample.owner
        value = (1 + np.log(sample.count)) * weight[sample.number]
        length = np.sqrt(np.bincount(owner, weights=value**2, minlength=len(sample.y)))
        part = rows[owner]
        owner, term, value = owner[part], sample.number[part], value[part] / np.maximum(length[owner[part]], 1e-300)
        # examples with the same heaviest term side by side, so that blocks are alike
        lead = np.full(len(sample.y), -1, dtype=np.int64)
        by = np.lexsort((value, owner))
        last = np.flatnonzero(np.append(owner[by][1:] != owner[by][:-1], True)) if len(by) else by
        lead[owner[by][last]] = term[by][last]
        order = chosen[np.lexsort((chosen, lead[chosen]))]
        place = np.full(len(sample.y), -1, dtype=np.int64)
        place[order] = np.arange(len(order))
        self.index = BlockMaxIndex(place[owner], term, value, len(order), len(sample.terms))
        self.y, self.weight, self.ids = sample.y[order], sample.weight[order], sample.ids[order]

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray]]:
        for at, cosine in self.index.nearest(queries, self.k):
            w = np.maximum(cosine, 1e-6) ** 2 * self.weight[at]
            yield float((w * self.y[at]).sum() / w.sum()), self.ids[at[:3]]


class Model:
    def __init__(self, sample: Sample, df: np.ndarray, n_docs: int, k: int = NEIGHBOURS, folds: int = FOLDS):
        self.terms = sample.terms
        self.idf = np.log((1 + n_docs) / (1 + df)) + 1
        n = len(sample.y)
        votes, fold = np.full(n, 0.5), np.arange(n) % folds
        for f in range(folds if n > 1 else 0):
            mine = fold == f
            if not mine.any() or mine.all():
                continue
            weight = self.idf * relevance(sample, ~mine)
            others = Examples(sample, ~mine, weight, k)
            ends = [(sample.bounds[i], sample.bounds[i + 1]) for i in np.flatnonzero(mine)]
            votes[mine] = [v for v, _ in others.votes([self.vector(sample.number[a:b], sample.count[a:b], weight) for a, b in ends])]
            del others
        self.map = Isotonic(votes, sample.y, sample.weight)
        self.relevant = relevance(sample, np.ones(n, dtype=bool)) * self.idf
        self.examples = Examples(sample, np.ones(n, dtype=bool), self.relevant, k)
        self.memo: dict[bytes, tuple[float, list[int]]] = {}

    @staticmethod
    def vector(term: np.ndarray, count: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = (1 + np.log(count)) * weight[term]
        return term, value / max(float(np.sqrt(value @ value)), 1e-300)

    def table(self) -> TermTable:
        if "_table" not in self.__dict__:
            self._table = TermTable(self.terms)
        return self._table

    def scores(self, col: pa.Array) -> list[tuple[float, list[int]]]:
        """Probability and nearest examples of each text. What equal vectors got is remembered."""
        found = []
        for _, n, row, term, count, _ in count_terms(col, self.table(), terms_of):
            bounds = np.searchsorted(row, np.arange(n + 1)).tolist()
            parts = [(term[a:b], count[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            keys = [hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() for t, c in parts]
            if len(self.memo) >= 50_000:
                self.memo.clear()
            new = {key: part for key, part in zip(keys, parts, strict=True) if key not in self.memo}
            got = list(self.examples.votes([self.vector(t, c, self.relevant) for t, c in new.values()]))
            p = self.map(np.array([v for v, _ in got]))
            self.memo.update((key, (float(x), ids.tolist())) for key, x, (_, ids) in zip(new, p, got, strict=True))
            found += [self.memo[key] for key in keys]
        return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """The model from labelled rows outside the held-out fold; None without any."""
    sample = labelled_sample(docs, labels, label, ~held_out(folds, fold), terms_of, per_class)
    if not len(sample.y):
        return None
    return Model(sample, *document_frequencies(docs, sample.terms, terms_of))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, evidence (doc_ids of the nearest labelled examples)."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            found = [(0.5, [])] * batch.num_rows if m is None else m.scores(batch.column(1))
            p = np.array([f[0] for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "score", "predicted", "evidence"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>")
