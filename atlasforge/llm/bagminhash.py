"""Near-duplicate documents by BagMinHash signatures of weighted (multiset) five-word shingles.

Every unit of a shingle's count is a level of a Poisson process over (time, register). Levels are
grouped in dyadic blocks, (0,1], (1,2], (2,4], (4,8], ...; a block's process is the same in every text, and a
text keeps the points at levels up to its own count. The earliest point of each register is the signature,
so two texts agree in a register with probability equal to their weighted Jaccard similarity.

Candidates come from banded signatures. Small buckets give all their pairs (linear in the rows, as the bound is
fixed); larger ones link each member to the bucket's most central document. Members of a larger bucket that are not in its class
after that are searched again, exactly, by their rarest shingles (prefix filter), so that no bucket size loses a pair.
Every candidate pair is verified on the multisets themselves; verified links make classes.

Defined results: null or empty texts, and texts without words, match only texts that are equal byte for byte (null
equals empty). Texts with fewer than five words have one shingle of all their words. Rows that repeat a doc_id are
kept as rows and judged by their own text: each different multiset is a node of its own, whatever ids it has, and a class
is named by the least doc_id in it (two classes with different texts of one doc_id may bear the same name). The result does not depend
on the order of rows. A null doc_id gets a null class and links nothing. Columns other than the id and text columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import BROADCAST_ROWS, U64, Words, materialize, mix, release, repeats, semi_join_ids, shingle_hashes, text_slices

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
BUCKET_PAIRS = 8  # buckets up to this size give all their pairs
_GAMMA = U64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- signatures (numpy, per slice of texts)


def signatures(elements: np.ndarray, counts: np.ndarray, owner: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash registers of n_docs multisets given as (element, count, owner) triples. Empty sets stay inf."""
    sig = np.full(n_docs * m, np.inf)
    if not len(elements):
        return sig.reshape(n_docs, m)
    blocks = np.ones(len(elements), dtype=np.int64)
    many = counts > 1
    blocks[many] += np.ceil(np.log2(counts[many])).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), blocks)
    b = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.where(b > 1, 1 << np.maximum(b - 1, 0), 1).astype(U64)
    base = np.where(b > 0, size.astype(np.int64), 0)  # levels base+1 .. base+size
    seed = mix(elements[at] + (b.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95))
    limit, who = counts[at], owner[at]
    weight = np.bincount(owner, weights=counts, minlength=n_docs)
    horizon = m * (np.log(m) + 4) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight > 0)
    pick = np.arange(len(at))
    while len(todo):
        _points(sig, m, seed[pick], size[pick], base[pick], limit[pick], who[pick], horizon[who[pick]])
        todo = todo[np.isinf(sig.reshape(n_docs, m)[todo]).any(axis=1)]
        horizon[todo] *= 2
        pick = np.flatnonzero(np.isin(who, todo)) if len(todo) else pick
    return sig.reshape(n_docs, m)


def _points(sig, m, seed, size, base, limit, who, until) -> None:
    """All points of each process up to its horizon, a few at a time, into the registers' minima."""
    rate = size.astype(np.float64)
    last = np.zeros(len(seed))
    drawn = np.zeros(len(seed), dtype=np.int64)
    steps = np.maximum(2, (rate * until * 1.5).astype(np.int64) + 2)
    while len(seed):
        width = int(min(max(2, np.median(steps)), max(2, 2_000_000 // len(seed))))
        k = (drawn[:, None] + np.arange(1, width + 1)).astype(U64)
        r = mix(seed[:, None] + k * _GAMMA)
        gap = -np.log(((r >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate[:, None]
        gap[:, 0] += last
        t = np.cumsum(gap, axis=1)
        live = t <= until[:, None]
        i, j = np.nonzero(live)
        r2 = mix(r[i, j] ^ U64(0xA0761D6478BD642F))
        level = base[i] + 1 + ((r2 >> U64(32)) % size[i]).astype(np.int64)
        ok = level <= limit[i]
        i, r2, when = i[ok], r2[ok], t[live][ok]
        np.minimum.at(sig, who[i] * m + (r2 & U64(0xFFFFFFFF)).astype(np.int64) % m, when)
        go = live[:, -1]
        last, drawn = t[go, -1], drawn[go] + width
        seed, size, base, limit, who, until, rate, steps = (x[go] for x in (seed, size, base, limit, who, until, rate, steps))


def sorted_shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    out = []
    for i in range(len(bounds) - 1):
        s = shingle_hashes(words[bounds[i] : bounds[i + 1]], width)
        s.sort()
        out.append(s)
    return out


def multiset(col: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Per slice: first row, each text's sorted shingles, and the bytes and offsets."""
    for row, data, offs in text_slices(col):
        w = Words(data, offs)
        yield row, sorted_shingles(w.hashes(), w.bounds, width), data, offs


def digests(sets: list[np.ndarray], data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """What equal multisets share, and without shingles equal texts."""
    return [hashlib.blake2b(s.tobytes() if len(s) else b"text:" + data[offs[i] : offs[i + 1]].tobytes(), digest_size=16).digest() for i, s in enumerate(sets)]


def with_digest(df: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """df and its texts' digests in the column __digest."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for _, sets, data, offs in multiset(batch.column(at).cast(pa.string()), width):
                found += digests(sets, data, offs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "__digest"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("__digest", BinaryType())]))


def _signature_batches(width: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets, data, offs in multiset(batch.column(1), width):
                n = len(sets)
                sizes = np.array([len(s) for s in sets])
                digest = digests(sets, data, offs)
                flat = np.concatenate(sets) if n else np.zeros(0, U64)
                owner = np.repeat(np.arange(n), sizes)
                first = np.ones(len(flat), dtype=bool)
                first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(first)
                sig = signatures(flat[at], np.diff(np.append(at, len(flat))), owner[at], n, m)
                bits = sig.view(U64).reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * _GAMMA, (n, bands)).copy()
                for j in range(rows):
                    key = mix(key ^ bits[:, :, j])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32), pa.array(key[sizes > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(digest, pa.binary()), pa.array(sizes.astype(np.int64)), lists],
                    names=["doc_id", "digest", "weight", "bands"],
                )

    return run


# ---------------------------------------------------------------- verification


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted multisets."""
    if not len(a) or not len(b):
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (len(a) + len(b) - both)


def _verify_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                sides = []
                for c in (2, 3):
                    side: list[np.ndarray] = []
                    for _, sets, _, _ in multiset(batch.column(c), width):
                        side += sets
                    sides.append(side)
                sim = [overlap(a, b) for a, b in zip(*sides, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Exact weighted Jaccard of the pairs (a, b); texts has (doc_id, text) of every document named."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify_batches(width), "a long, b long, similarity double")


# ---------------------------------------------------------------- exact search for the rest of large buckets


def _prefix_elements(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets, _, _ in multiset(batch.column(1), width):
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
                owner = np.repeat(np.arange(len(sets)), sizes)
                # the k-th copy of a shingle is an element of its own: a multiset becomes a set
                start = np.ones(len(flat), dtype=bool)
                start[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(start)
                copy = np.arange(len(flat)) - np.repeat(at, np.diff(np.append(at, len(flat))))
                element = mix(flat + copy.astype(U64) * _GAMMA)
                ids = batch.column(0).slice(row, len(sets)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([ids, pa.array(element.view(np.int64)), pa.array(sizes[owner].astype(np.int64))], names=["doc_id", "element", "weight"])

    return run


def prefix_pairs(probes: DataFrame, texts: DataFrame, classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of a probe and a text of another class that may reach the threshold; every pair that does is among them.

    Elements are ordered from the rarest on. A pair at the threshold shares an element of both prefixes, and its first shared
    one leaves room for the overlap it needs: from places i and j on there are 1 + min(weight - place) at most.
    """
    elements = materialize(texts.select("doc_id", "text").mapInArrow(_prefix_elements(width), "doc_id long, element long, weight long"), "elements")
    df = elements.groupBy("element").agg(F.count("*").alias("df"))
    ranked = elements.join(df, "element")
    # each group is one text's own words; the prefix is weight - ceil(threshold * weight) + 1 elements
    ordered = ranked.groupBy("doc_id", "weight").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("e"))
    head = F.slice("e", 1, (F.col("weight") - F.ceil(F.lit(threshold) * F.col("weight")) + 1).cast("int"))
    prefix = ordered.select("doc_id", "weight", F.posexplode(head).alias("place", "e")).select("doc_id", "weight", "place", "e.element")
    prefix = materialize(prefix.join(classes, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")), "prefix")
    p, q = prefix.join(probes, "doc_id", "left_semi").alias("p"), prefix.alias("q")
    room = F.least(F.col("p.weight") - F.col("p.place"), F.col("q.weight") - F.col("q.place"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("p.weight") + F.col("q.weight"))
    fits = (F.col("p.element") == F.col("q.element")) & (F.col("p.class_id") != F.col("q.class_id")) & (room >= need - 1e-6)
    return p.join(q, fits).select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")).distinct()


# ---------------------------------------------------------------- classes


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(doc_id, class_id) of every document in edges (a, b): the least id reachable. Hash-min with pointer jumping."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("class_id")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["doc_id"]).groupBy("a").agg(F.min("class_id").alias("m"))
        lowered = labels.join(near, labels["doc_id"] == near["a"]).select("doc_id", F.least("class_id", "m").alias("class_id"), F.col("class_id").alias("was"))
        jump = labels.select(F.col("doc_id").alias("class_id"), F.col("class_id").alias("far"))
        new = materialize(lowered.join(jump, "class_id", "left").select("doc_id", F.coalesce(F.least("class_id", "far"), "class_id").alias("class_id"), "was"), "labels")
        if new.where("class_id <> was").limit(1).count() == 0:
            return new.select("doc_id", "class_id")
        labels = new.select("doc_id", "class_id")
    raise RuntimeError(f"classes did not settle in {rounds} rounds")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    bucket_pairs: int = BUCKET_PAIRS,
) -> DataFrame:
    """One row per document: doc_id, copy_of (first document with the same shingle multiset), class_id (first of its class).

    bands * rows registers; a pair of similarity s becomes a candidate with probability 1 - (1 - s**rows)**bands,
    0.999997 at 0.8 with the defaults.
    """
    sig, nodes = _classify(docs, id_col, text_col, width, threshold, bands, rows, bucket_pairs)
    named = nodes.select("digest", "copy_of", "class_id")
    # written first, so that both sides of the join come from plain exchanges and a digest with very many copies can be split
    out = sig.select("doc_id", "digest").join(materialize(named, "classes"), "digest", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("copy_of")).alias("copy_of"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def _classify(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, bands: int, rows: int, bucket_pairs: int) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and the nodes: digest, copy_of (its least doc_id), class_id (its class's), first (whether it is the class's first, by doc_id and digest)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = materialize(texts.mapInArrow(_signature_batches(width, bands, rows), "doc_id long, digest binary, weight long, bands array<long>"), "signatures")
    # one node for each multiset: min() combines on the map side, however many copies there are
    reps = sig.where("doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    reps = materialize(reps.select("digest", F.col("x.doc_id").alias("rep_id"), F.col("x.bands").alias("bands")).withColumn("rep", F.monotonically_increasing_id()), "nodes")
    rep_bands = reps.where("size(bands) > 0").select("rep", F.explode("bands").alias("key"))
    shared = rep_bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(rep_bands.join(shared, "key"), "buckets")

    small = members.where(F.col("n") <= bucket_pairs).select("key", "rep")
    pairs = small.join(small.withColumnRenamed("rep", "other"), "key").where("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    # the hub of a larger bucket is its most central member: the one that meets most texts in all its buckets
    central = members.groupBy("rep").agg(F.sum("n").alias("met"))
    large = members.where(F.col("n") > bucket_pairs).join(central, "rep")
    large = materialize(large, "members")
    hubs = large.groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("back"))).alias("h")).select("key", (-F.col("h.back")).alias("hub"))
    # both sides written first, so that a bucket with very many members can be split in the join
    large = materialize(large.join(materialize(hubs, "hubs"), "key").select("key", "rep", "hub"), "large")
    stars = large.where("hub <> rep").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    pairs = materialize(pairs.union(stars).distinct(), "pairs")

    named = materialize(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct(), "named")
    chosen = materialize(_texts_of(texts, sig, semi_join_ids(reps.select("rep", "digest", "rep_id"), named, "rep"), width), "texts")
    links = materialize(verify(pairs, chosen, width).where(F.col("similarity") >= threshold).select("a", "b"), "links")
    classes = components(links)

    # members of larger buckets that are not in their hub's class may still have links that no star shows
    of = large.join(classes.select(F.col("doc_id").alias("rep"), F.col("class_id").alias("own")), "rep", "left").join(classes.select(F.col("doc_id").alias("hub"), F.col("class_id").alias("hubs")), "hub", "left")
    apart = materialize(of.where(F.coalesce("own", "rep") != F.coalesce("hubs", "hub")).select("key", F.col("rep").alias("doc_id")), "apart")
    if apart.limit(1).count():
        in_reach = large.join(apart.select("key").distinct(), "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
        more = prefix_pairs(apart.select("doc_id").distinct(), semi_join_ids(chosen, in_reach, "doc_id"), classes, width, threshold)
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "more")
        found = materialize(verify(more, chosen, width).where(F.col("similarity") >= threshold).select("a", "b"), "found")
        if found.limit(1).count():
            classes = components(links.union(found))

    # numbers of nodes carry no order of documents: a class is named by its least doc_id
    known = materialize(reps.select("digest", "rep_id", "rep").join(classes.select(F.col("doc_id").alias("rep"), F.col("class_id").alias("class")), "rep", "left").withColumn("class", F.coalesce("class", "rep")), "known")
    heads = known.groupBy("class").agg(F.min(F.struct("rep_id", "digest")).alias("h"))
    for done in (chosen, members, pairs):  # the classes are written, and nothing else reads these
        release(done)
    nodes = known.join(materialize(heads, "heads"), "class")
    return sig, nodes.select("digest", F.col("rep_id").alias("copy_of"), F.col("h.rep_id").alias("class_id"), (F.col("h.digest") == F.col("digest")).alias("first"))


def _texts_of(texts: DataFrame, sig: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """One text (doc_id: the node's number, text) of each wanted node (rep, digest, rep_id)."""
    near = semi_join_ids(texts.where("doc_id is not null"), wanted.select(F.col("rep_id").alias("doc_id")).distinct(), "doc_id")
    if not repeats(sig.where("doc_id is not null").select("doc_id"), "doc_id"):
        return near.join(wanted.select(F.col("rep_id").alias("doc_id"), "rep"), "doc_id").select(F.col("rep").alias("doc_id"), "text")
    own = with_digest(near, width).withColumnRenamed("__digest", "digest").withColumnRenamed("doc_id", "rep_id")
    return own.join(wanted, ["rep_id", "digest"]).groupBy(F.col("rep").alias("doc_id")).agg(F.min("text").alias("text"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their class: one row for each class, with its least doc_id.

    Where ids repeat, rows are told apart by their texts' digests, and of rows with the same id and digest one stays, the
    first by a hash of its columns. Rows without an id all stay.
    """
    sig, nodes = _classify(docs, id_col, text_col, width, threshold, bands, rows, bucket_pairs)
    first = materialize(nodes.where("first").select(F.col("copy_of").alias("__id"), F.col("digest").alias("__digest")), "first")
    n = first.limit(BROADCAST_ROWS + 1).count()
    known = docs.where(F.col(id_col).isNotNull()).withColumn("__id", F.col(id_col).cast("long"))
    if not repeats(sig.where("doc_id is not null").select("doc_id"), "doc_id"):
        kept = known.join(F.broadcast(first.select("__id")) if n <= BROADCAST_ROWS else first.select("__id"), "__id", "left_semi")
    else:
        rows_of = semi_join_ids(known, first.select("__id").distinct(), "__id")
        rows_of = with_digest(rows_of.withColumn("__text", F.col(text_col).cast("string")), width, "__text").drop("__text")
        kept = rows_of.join(first, ["__id", "__digest"], "left_semi")
        every = F.struct(*[F.col(c) for c in docs.columns])
        kept = kept.groupBy("__id", "__digest").agg(F.min_by(every, F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in docs.columns])).alias("x")).select("x.*")
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (
  SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0) GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS total, md5(string_agg(g || ':' || n, '|' ORDER BY g)) AS digest FROM c GROUP BY doc_id),
key AS (SELECT d.doc_id, coalesce(digest, 'text:' || text) AS digest, total FROM d LEFT JOIN z USING (doc_id)),
rep AS (SELECT digest, min(doc_id) AS doc_id FROM key GROUP BY digest),
m AS (SELECT c.*, total FROM c JOIN rep USING (doc_id) JOIN z USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common, any_value(a.total) + any_value(b.total) AS total FROM m a JOIN m b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE common / (total - common) >= 0.8),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS root FROM rep UNION SELECT b, root FROM reach JOIN links ON a = doc_id),
class AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id)
SELECT key.doc_id, rep.doc_id AS copy_of, class_id FROM key JOIN rep USING (digest) JOIN class ON class.doc_id = rep.doc_id
"""
