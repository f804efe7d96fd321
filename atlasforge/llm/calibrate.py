"""Bounded labelled samples, and calibration of votes by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_bucket, materialize, release
from .terms import Featurizer, own_terms

#: Most labelled rows taken of each class, and most bytes of their texts. A smaller labelled set is taken whole.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 3000, 32 << 20


@dataclass
class Sample:
    """Labelled texts by their terms: all different terms of them (sorted hashes), and each text's numbers and counts of these."""

    ids: np.ndarray
    y: np.ndarray
    weight: np.ndarray  # labelled rows that each sampled row stands for
    terms: np.ndarray
    bounds: np.ndarray  # entries of text i: bounds[i]:bounds[i+1]
    number: np.ndarray
    count: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.y)), np.diff(self.bounds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, featurize: Featurizer, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Sample:
    """At most per_class training rows of each class, and of these so many that their texts have at most most_bytes (one at least).

    Rows are taken in the order of a hash of doc_id, so the sample does not depend on the partitioning. Null labels
    are left out; of rows that repeat a doc_id one label counts (the greatest) and one text (the least). Texts stay on the executors.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(train)
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = parts[0].union(parts[1])  # at most 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialize(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    total = np.cumsum(sizes.column("n").to_numpy().astype(np.int64))
    chosen = rows
    if len(total) and total[-1] > most_bytes:
        some = sizes.column("doc_id").to_numpy()[: max(1, int(np.searchsorted(total, most_bytes, side="right")))]
        chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in some], "doc_id long")), "doc_id", "left_semi")
    got = own_terms(chosen, featurize)
    release(rows)
    got = got.sort_by("doc_id").combine_chunks()
    ids, y = got.column("doc_id").to_numpy().copy(), got.column("y").to_numpy().astype(np.int64)
    have = np.bincount(y, minlength=2)
    weight = np.array([totals.get(c, 0) / max(1, have[c]) for c in (0, 1)])[y] if len(y) else np.zeros(0)
    lists = got.column("terms").combine_chunks()
    count = np.asarray(got.column("counts").combine_chunks().flatten()).astype(np.int32)
    bounds = np.append(0, np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))).astype(np.int64)
    flat = np.asarray(lists.flatten()).astype(np.int64).view(U64)
    del got, lists
    pa.default_memory_pool().release_unused()  # of what was collected nothing stays on the driver but these arrays
    terms = np.unique(flat)
    return Sample(ids, y, weight, terms, bounds, np.searchsorted(terms, flat).astype(np.int32), count)


def held_out(n: int, remainder: int) -> Column:
    return F.coalesce(crc_bucket(F.col("doc_id"), n) == remainder, F.lit(False))


class Isotonic:
    """A non-decreasing map from votes to label frequencies, by pooling adjacent violators, linear between pools.

    A pseudo-count of one row at the overall frequency keeps small pools from 0 and 1.
    """

    def __init__(self, votes: np.ndarray, y: np.ndarray, weight: np.ndarray):
        if not len(votes):
            self.x, self.p = np.array([0.0, 1.0]), np.array([0.5, 0.5])
            return
        order = np.argsort(votes, kind="stable")
        x, value, w = votes[order], y[order].astype(float), weight[order].astype(float)
        pools: list[list[float]] = []
        for a, b, c in zip(x, value, w, strict=True):
            pools.append([b * c, c, a, a])
            while len(pools) > 1 and (pools[-2][2] == a or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
                last = pools.pop()
                pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
        base = float((value * w).sum() / w.sum())
        unit = float(np.median(w))
        self.x = np.array([v for q in pools for v in (q[2], q[3])])
        self.p = np.repeat([(q[0] + base * unit) / (q[1] + unit) for q in pools], 2)
        self.p = np.maximum.accumulate(self.p)

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        # ties in x come from pools of one vote; interp takes either end, which are equal
        return np.clip(np.interp(votes, self.x, self.p), 0.0, 1.0)
