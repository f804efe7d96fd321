"""Benchmark decontamination by a positional inverted index over the training documents.

The index is partitioned by blocks of documents (about a megabyte of text, whole documents). A block has a row with its documents and
number of words of each, its distinct words as sorted hashes, and for each word the list of its places in the block. It is made
once, from the documents alone, and any set of phrases can be searched in it. Search takes, in each block, the phrases of which
the block has every term; it goes from the list of a phrase's rarest term in the block, shifted by the term's offset,
and intersects it with the shifted lists of the other terms, from the rarest on, at most EXPANDED candidates at a time. Phrases
(exact) need every term at its offset within one document; proximity matches need all terms within a stretch of the phrase's
length and `slop` further words, in any order.

The distinct phrases are made on the executors and kept as a table. A search broadcasts them, so of more than PASS_PHRASES
they are searched in passes over the index, each for one part of the table by the phrases' hash, and the passes' matches are merged by
row. The driver holds one pass's phrases at a time, as arrays. Nothing of the documents is collected.

Words: A-Z are lower-cased, then runs of characters other than ASCII non-alphanumerics. They are compared by the 64-bit hashes
of common.span_hashes, which are exact for words of up to 7 bytes; for two given longer words they are equal with probability 2**-64. Defined
results: null or empty texts have no words and no hits; items without words give no phrase; items that repeat an item_id
are searched each and reported under that id; items without an id are searched, and their hits count but name no item; repeated
doc_ids are rows of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, U64, Words, materialize, release, repeats, text_slices

WINDOW = 10
PASS_PHRASES, EXPANDED = 250_000, 1 << 20


@dataclass
class Phrases:
    """Distinct windows of items as rows of term numbers (-1 after the last); terms are sorted word hashes."""

    terms: np.ndarray
    windows: np.ndarray  # phrase by offset
    length: np.ndarray
    items: pa.ListArray  # ids of the items that have it


def phrase_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The distinct windows of `width` consecutive words of the items with the ids of their items: w (word hashes), items. A shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offs in text_slices(batch.column(1)):
                w = Words(data, offs)
                h = w.hashes().view(np.int64)
                many, size, parts = np.zeros(len(offs) - 1, np.int64), np.diff(w.bounds), [np.zeros(0, np.int64)]
                for i in np.flatnonzero(size):
                    found = np.lib.stride_tricks.sliding_window_view(h[w.bounds[i] : w.bounds[i + 1]], min(width, size[i]))
                    many[i] = len(found)
                    parts.append(found.reshape(-1))
                ends = np.append(0, np.cumsum(np.repeat(np.minimum(width, size), many))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + np.repeat(np.arange(len(many)), many))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)))], names=["i", "w"])

    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "i string, w array<long>").groupBy("w").agg(F.sort_array(F.collect_set("i")).alias("items"))


def phrases_of(table: DataFrame) -> Phrases:
    """The rows of a part of phrase_table()."""
    got = table.select("w", "items").toArrow().combine_chunks()
    if not got.num_rows:
        return Phrases(np.zeros(0, U64), np.zeros((0, 1), np.int64), np.zeros(0, np.int64), pa.array([], pa.list_(pa.string())))
    w = got.column("w").combine_chunks()
    terms, number = np.unique(np.asarray(w.flatten()).astype(np.int64).view(U64), return_inverse=True)
    length = np.asarray(w.value_lengths()).astype(np.int64)
    windows = np.full((len(length), int(length.max())), -1, dtype=np.int32)
    windows[np.arange(windows.shape[1]) < length[:, None]] = number
    return Phrases(terms, windows, length, got.column("items").combine_chunks())


# ---------------------------------------------------------------- the index

POSTINGS = "docs array<long>, n_words array<int>, terms array<long>, ends array<int>, places array<int>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings, one row per block: block, docs, n_words, terms (sorted), ends (of each term's part of places) and places.

    A place is the number of a word among all words of its block, so those of one document are consecutive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offs in text_slices(batch.column(1)):
                w = Words(data, offs)
                h = w.hashes().view(np.int64)
                place = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.append(True, h[place[1:]] != h[place[:-1]])) if len(h) else place
                ends = np.append(first[1:], len(h)) if len(h) else first
                ids = pa.ListArray.from_arrays(pa.array([0, len(offs) - 1], pa.int32()), batch.column(0).slice(row, len(offs) - 1))
                lists = [_one_list(x) for x in (np.diff(w.bounds).astype(np.int32), h[place[first]], ends.astype(np.int32), place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([ids, *lists], names=["docs", "n_words", "terms", "ends", "places"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, POSTINGS).withColumn("block", F.monotonically_increasing_id()), "postings")


def _one_list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


class Block:
    """One row of the index, with the phrases' terms found in it."""

    def __init__(self, row: dict, ph: Phrases):
        self.n_words = np.asarray(row["n_words"].values).astype(np.int64)
        self.bounds = np.append(0, np.cumsum(self.n_words))
        terms = np.asarray(row["terms"].values).astype(np.int64)
        ends = np.append(0, np.asarray(row["ends"].values)).astype(np.int64)
        self.places = np.asarray(row["places"].values).astype(np.int64)
        self.span = len(self.places) + ph.windows.shape[1] + 1
        # the block's terms are in the order of signed numbers, those of the phrases in that of unsigned ones
        want = ph.terms.view(np.int64)
        at = np.minimum(np.searchsorted(terms, want), max(0, len(terms) - 1))
        here = terms[at] == want if len(terms) else np.zeros(len(want), bool)
        self.start, self.end = np.where(here, ends[at], 0), np.where(here, ends[np.minimum(at + 1, len(ends) - 1)], 0)
        self.df = self.end - self.start
        # term and place of each posting as one sorted number, for the phrases' terms alone
        chosen = np.flatnonzero(self.df)
        size = self.df[chosen]
        self.code = np.repeat(chosen, size) * self.span + self.places[np.arange(size.sum()) + np.repeat(self.start[chosen] - (np.cumsum(size) - size), size)]

    def owner(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, place, side="right") - 1

    def plans(self, ph: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of which the block has every term, and the offsets of each from its rarest term on."""
        if not len(ph.windows) or not len(self.code):
            return np.zeros(0, np.int64), np.zeros((0, 1), np.int64)
        df = np.append(self.df, np.iinfo(np.int64).max)[ph.windows]  # -1 takes the last
        alive = np.flatnonzero((df > 0).all(axis=1))
        return alive, np.argsort(df[alive], axis=1, kind="stable")

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = term * self.span + place
        return self.code[np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)] == want

    def exact(self, ph: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, phrase) of every occurrence."""
        alive, order = self.plans(ph)
        starts, phrases = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        many = self.df[ph.windows[alive, order[:, 0]]] if len(alive) else np.zeros(0, np.int64)
        part = np.cumsum(many) // EXPANDED
        for k in np.unique(part):
            rows = np.flatnonzero(part == k)
            # a term with very many places is taken in stretches of them
            longest = int(many[rows].max())
            for low in range(0, longest, EXPANDED):
                size = np.clip(many[rows] - low, 0, EXPANDED)
                row = np.repeat(rows, size)
                anchor = ph.windows[alive[row], order[row, 0]]
                within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low
                start = self.places[self.start[anchor] + within] - order[row, 0]
                p = alive[row]
                ok = (start >= 0) & (start + ph.length[p] <= len(self.places))
                start, row, p = start[ok], row[ok], p[ok]
                ok = self.owner(start) == self.owner(start + ph.length[p] - 1)
                start, row, p = start[ok], row[ok], p[ok]
                for j in range(1, ph.windows.shape[1]):
                    off = order[row, j]
                    ok = self.has(ph.windows[p, off], start + off) | (j >= ph.length[p])
                    start, row, p = start[ok], row[ok], p[ok]
                    if not len(row):
                        break
                starts.append(start)
                phrases.append(p)
        return np.concatenate(starts), np.concatenate(phrases)

    def near(self, ph: Phrases, slop: int) -> list[tuple[int, int, int]]:
        """(document, phrase, first place) of the first stretch of length + slop words that has all terms of a phrase."""
        alive, order = self.plans(ph)
        out = []
        for p, by in zip(alive.tolist(), order, strict=True):
            terms, reach, seen = np.unique(ph.windows[p, : ph.length[p]]), int(ph.length[p]) + slop, set()
            rare = ph.windows[p, by[0]]
            for anchor in self.places[self.start[rare] : self.end[rare]].tolist():
                doc = int(self.owner(np.array([anchor]))[0])
                if doc in seen:
                    continue
                low, high = max(self.bounds[doc], anchor - reach + 1), self.bounds[doc + 1]
                starts = np.concatenate([self._between(t, low, anchor + 1) for t in terms])
                for first in np.sort(starts).tolist():
                    if all(len(self._between(t, first, min(high, first + reach))) for t in terms):
                        out.append((doc, p, first - int(self.bounds[doc])))
                        seen.add(doc)
                        break
        return out

    def _between(self, term: int, low: int, high: int) -> np.ndarray:
        own = self.places[self.start[term] : self.end[term]]
        return own[np.searchsorted(own, low) : np.searchsorted(own, high)]


def _blocks(batches: Iterator[pa.RecordBatch], ph: Phrases) -> Iterator[tuple[int, pa.Array, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in ("n_words", "terms", "ends", "places")}
            yield batch.column("block")[i].as_py(), batch.column("docs")[i].values, Block(row, ph)


MATCHES = "block long, nth int, doc_id long, n_words long, n_hit long, n_phrases long, items array<string>, span_starts array<int>, span_ends array<int>"


def search(index: DataFrame, ph: Phrases) -> DataFrame:
    """Exact phrase matches, a row for each document: block and nth (its place in the index), doc_id, n_words, n_hit, n_phrases, items (sorted item ids), spans (merged [start, end) of hit words)."""
    cast = index.sparkSession.sparkContext.broadcast(ph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = cast.value
        for block, ids, b in _blocks(batches, p):
            start, phrase = b.exact(p)
            yield _match_rows(block, ids, b, p, start, phrase)

    return index.mapInArrow(run, MATCHES)


def _match_rows(block: int, ids: pa.Array, b: Block, ph: Phrases, start: np.ndarray, phrase: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    items: list[list[str]] = [[] for _ in range(n)]
    hit, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    starts: list[list[int]] = [[] for _ in range(n)]
    ends: list[list[int]] = [[] for _ in range(n)]
    order = np.argsort(start, kind="stable")
    start, phrase = start[order], phrase[order]
    owner = b.owner(start)
    for d in np.unique(owner).tolist():
        i, j = np.searchsorted(owner, [d, d + 1])
        begin = start[i:j] - b.bounds[d]
        reach = np.maximum.accumulate(begin + ph.length[phrase[i:j]])
        first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
        starts[d], ends[d] = begin[first].tolist(), reach[np.append(first[1:] - 1, j - i - 1)].tolist()
        items[d] = sorted(set(ph.items.take(pa.array(np.unique(phrase[i:j]))).flatten().to_pylist()))
        count[d], hit[d] = j - i, sum(ends[d]) - sum(starts[d])
    lists = [pa.array(items, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(b.n_words), pa.array(hit), pa.array(count), *lists],
        names=["block", "nth", "doc_id", "n_words", "n_hit", "n_phrases", "items", "span_starts", "span_ends"],
    )


def proximity(index: DataFrame, ph: Phrases, slop: int) -> DataFrame:
    """Documents that have all terms of a phrase within its length and slop further words, in any order: doc_id, phrase, position (of the first such stretch), items."""
    cast = index.sparkSession.sparkContext.broadcast(ph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = cast.value
        for _, ids, b in _blocks(batches, p):
            out = [(ids[d].as_py(), q, at, p.items[q].as_py()) for d, q, at in b.near(p, slop)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["doc_id", "phrase", "position", "items"])

    return index.mapInArrow(run, "doc_id long, phrase long, position long, items array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, pass_phrases: int = PASS_PHRASES, id_col: str = "doc_id") -> DataFrame:
    """Exact phrase matches of every item's windows in every document: doc_id, n_words, n_hit, n_phrases, items, span_starts, span_ends."""
    return find(build_index(docs, id_col), items, width, pass_phrases)


def find(index: DataFrame, items: DataFrame, width: int = WINDOW, pass_phrases: int = PASS_PHRASES) -> DataFrame:
    """The same from an index that is there."""
    table = materialize(phrase_table(items, width=width), "phrases")
    passes = max(1, -(-table.count() // pass_phrases))
    columns = ("n_hit", "n_phrases", "items", "span_starts", "span_ends")
    if passes == 1:
        return search(index, phrases_of(table)).select("doc_id", "n_words", *columns)
    hits = every = None
    for k in range(passes):
        got = materialize(search(index, phrases_of(table.where(F.pmod(F.xxhash64("w"), F.lit(passes)) == k))), "pass")
        every = got.select("block", "nth", "doc_id", "n_words") if every is None else every
        hit = got.where("n_hit > 0").select("block", "nth", *columns)
        hits = hit if hits is None else hits.unionAll(hit)
    zero = F.lit(0).cast("long")
    none = {"n_hit": zero, "n_phrases": zero, "items": F.array().cast("array<string>"), "span_starts": F.array().cast("array<int>"), "span_ends": F.array().cast("array<int>")}
    return every.join(merged(hits), ["block", "nth"], "left").select("doc_id", "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def merged(hits: DataFrame) -> DataFrame:
    """One row for each document of the passes' matches: items and spans united."""
    lists = hits.groupBy("block", "nth").agg(
        F.sum("n_phrases").alias("n_phrases"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("span_starts").alias("a"), F.col("span_ends").alias("b"))))).alias("spans"),
    )
    grown = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b")))),
    ).otherwise(F.concat(done, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))
    spans = lists.withColumn("spans", F.aggregate("spans", F.array().cast("array<struct<a:int,b:int>>"), grown))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]).cast("long"))
    return spans.select("block", "nth", n_hit.alias("n_hit"), "n_phrases", "items", F.col("spans.a").alias("span_starts"), F.col("spans.b").alias("span_ends"))


def match_digests(matches: DataFrame) -> DataFrame:
    """The per-document digest columns of the matches."""
    return matches.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that hold no phrase of the items. Each row is judged by its own text: where ids repeat or lack, rows get a key of their own, and are written with it."""
    own = id_col
    rows = docs
    if repeats(docs.select(id_col), id_col) or docs.where(F.col(id_col).isNull()).limit(1).count():
        own = "__row"
        rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    index = build_index(rows, own)
    hit = materialize(find(index, items, width).where("n_hit > 0").select(F.col("doc_id").alias(own)), "hit")
    release(index)
    n = hit.limit(BROADCAST_ROWS + 1).count()
    return rows.join(F.broadcast(hit) if n <= BROADCAST_ROWS else hit, own, "left_anti").select(*docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, k, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
per AS (
  SELECT h.doc_id, (SELECT count(DISTINCT p) FROM (SELECT unnest(range(x.k, x.k + x.n)) AS p FROM hits x WHERE x.doc_id = h.doc_id)) AS n_hit,
         count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits h GROUP BY h.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id)
"""
