"""Terms of texts as 64-bit hashes: lookup tables, counts by text, and frequencies over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, text_slices

#: Gives arrays of (text number, term hash) for the texts of a slice (bytes, offsets).
Featurizer = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


class TermTable:
    """Numbers of sorted term hashes, found by their leading bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        bits = max(10, int(np.ceil(np.log2(2 * max(1, len(terms))))))
        self.shift = U64(64 - bits)
        self.start = np.searchsorted(terms, np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(terms)))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, or -1."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.terms[here] == hashes[left]
            out[left[hit]] = here[hit]
            at[left] += 1
            left = left[~hit & (here + 1 < end[left])]
        return out


def count_terms(col: pa.Array, table: TermTable, featurize: Featurizer) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first row, number of rows, (row, term number, count) triples sorted by row and term, and each row's unknown terms."""
    n_terms = max(1, len(table.terms))
    for row, data, offs in text_slices(col):
        codes, n = [np.zeros(0, np.int64)], len(offs) - 1
        unknown = np.zeros(n, dtype=np.int64)
        for owner, h in featurize(data, offs):
            number = table.numbers(h)
            known = number >= 0
            codes.append(owner[known] * n_terms + number[known])
            unknown += np.bincount(owner[~known], minlength=n)
        code, count = np.unique(np.concatenate(codes), return_counts=True)
        yield row, n, code // n_terms, code % n_terms, count, unknown


def own_terms(rows: DataFrame, featurize: Featurizer) -> pa.Table:
    """doc_id, y, terms (sorted hashes) and counts of a bounded number of rows (doc_id, y, text), counted in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offs in text_slices(batch.column(2)):
                n = len(offs) - 1
                owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
                for owner, h in featurize(data, offs):
                    owners.append(owner)
                    hashes.append(h)
                owner, h = np.concatenate(owners), np.concatenate(hashes)
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(h))).astype(np.int32)
                bounds = np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (h[first].view(np.int64), count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), *lists], names=["doc_id", "y", "terms", "counts"])

    return rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, terms array<long>, counts array<int>").toArrow()


def document_frequencies(docs: DataFrame, terms: np.ndarray, featurize: Featurizer, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents, over all documents.

    Tasks count into one array each; what is shuffled and sent back has one row for each term.
    """
    cast = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, df, n_docs = TermTable(cast.value), np.zeros(len(cast.value) + 1, dtype=np.int64), 0
        for batch in batches:
            for _, n, _, term, _, _ in count_terms(batch.column(0), table, featurize):
                n_docs += n
                df += np.bincount(term, minlength=len(df))
        df[-1] = n_docs
        seen = np.flatnonzero(df)
        for k in range(0, len(seen), 1 << 16):
            part = seen[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(df[part])], names=["term", "df"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms) + 1, dtype=np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out[:-1], int(out[-1])
