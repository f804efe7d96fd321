"""Exact Jaccard join of documents on four-word shingles by PartEnum signatures.

Sets of one band of sizes that reach the threshold differ in at most k elements. The elements' domain is cut by a hash in n1 first-level
partitions, so one of them holds at most `edits` of the differences; it is cut again in n2 parts, of which at least
n2 - edits are equal in both sets. A set therefore gives, for each first-level partition, one signature for each choice of n2 - edits of its parts,
and two sets that reach the threshold share a signature. A set also signs in the next band if its larger partners may be there.

Signatures of few elements are shared by chance. With 2 * d first-level partitions more than needed, 2 * d + 1 of them are good, so
each set leaves out the d with the fewest elements, and a good one remains that both sets kept: no pair is lost.

Equal sets are one node. Buckets of up to BUCKET_PAIRS nodes give their pairs; in a larger one each member is held against the
most central one. All pairs are verified on the sets. A bucket that lies in one component is done, as further links inside it
change nothing. The others take the most central node that any member has met for a common centre, so that a group which meets in very many buckets
has few. Members near the centre are held against one another by what sets them apart from it: the
elements that a member lacks or has more. Two members of different components must share most of these differences to be linked, so they
share one of the rarest; this prefix filter is exact, and leaves few pairs even where very many members are almost similar. Members far from the centre
have met it by a passage that happens to fill a signature. They sign again with longer signatures (the next of LEVELS); as 1 - similarity is a
metric, no member nearer than FAR is linked to one beyond FAR and the threshold's distance. After the last level all go through their differences.

Defined results: a document with fewer words than a shingle has one of all its words; null texts and texts without words have an empty
set and are linked with nothing, not even with each other; rows that share a doc_id are judged by their own text; a row without
doc_id has its set's size, links nothing and has a null component; an empty table gives an empty result. Columns other than the id and text
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import components
from .common import BROADCAST_ROWS, U64, Words, materialize, mix, release, repeats, semi_join_ids, shingle_hashes, text_slices

SHINGLE = 4
PERCENT = 85  # least similarity
BUCKET_PAIRS = 8  # buckets up to this size give all their pairs
LEVELS = ((1, 3), (2, 6))  # differences that a first-level partition may hold, and its parts
FAR = 0.3  # distance from a bucket's centre beyond which members sign again
SPARE = 20  # one in so many first-level partitions may be left out
_GAMMA = U64(0x9E3779B97F4A7C15)
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False

# ---------------------------------------------------------------- sets of shingles


def shingle_sets(col: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per slice: first row, and each text's different shingles as sorted hashes."""
    for row, data, offs in text_slices(col):
        words = Words(data, offs, _WORD)
        h, b = words.hashes(), words.bounds
        yield row, [np.unique(shingle_hashes(h[b[i] : b[i + 1]], width)) for i in range(len(b) - 1)]


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), width):
                size = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([digest(s) for s in sets], pa.binary()), pa.array(size, pa.int64())], names=["doc_id", "digest", "n_shingles"])

    return run


# ---------------------------------------------------------------- signatures


def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Largest size of each band; a band's sizes differ by less than the square of the threshold."""
    ends, low = [], 1
    while low <= most:
        ends.append(max(low, low * 10_000 // (percent * percent)))
        low = ends[-1] + 1
    return np.array(ends, dtype=np.int64)


def shape(ends: np.ndarray, percent: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """First-level partitions of each band, and how many of them a set leaves out. Bands in which only equal sets are linked have none."""
    k = 2 * ends * (100 - percent) // (100 + percent)
    need = -(-(k + 1) // (edits + 1))
    out = np.where(need >= SPARE // 2, -(-need // SPARE), 0)
    return np.where(k > 0, need + 2 * out, 0), out


def signatures(sets: list[np.ndarray], percent: int, edits: int, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) of sets of hashes."""
    ends = bands(percent)
    n_first, left_out = shape(ends, percent, edits)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    own, last = np.searchsorted(ends, size), np.searchsorted(ends, size * 100 // percent)
    # a set signs in its own band and in those of its larger partners
    times = np.where(size > 0, last - own + 1, 0)
    of = np.repeat(np.arange(len(sets)), times)
    band = own[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    of, band = of[n_first[band] > 0], band[n_first[band] > 0]
    if not len(of):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = n_first[band]
    base = np.cumsum(first) - first
    total = int(first.sum())
    elements = np.concatenate([sets[i] for i in of.tolist()])
    who = np.repeat(np.arange(len(of)), size[of])
    h = mix(elements ^ _GAMMA)
    part = (((h >> U64(32)) * first[who].astype(U64)) >> U64(32)).astype(np.int64)
    cell = (base[who] + part) * n_parts + ((h & U64(0xFFFFFF)) % U64(n_parts)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]]))
    sums = np.zeros(total * n_parts, dtype=U64)
    sums[cell[order][edges]] = np.add.reduceat(mix(h + _GAMMA)[order], edges)
    counts = np.bincount(cell, minlength=total * n_parts).reshape(total, n_parts)
    sums = sums.reshape(total, n_parts)
    # the partitions whose smallest choice of parts holds the fewest elements are left out
    least = np.sort(counts, axis=1)[:, : n_parts - edits].sum(axis=1)
    owner = np.repeat(np.arange(len(of)), first)
    number = np.arange(total) - base[owner]
    rank = np.empty(total, dtype=np.int64)
    rank[np.lexsort((number, least, owner))] = number
    stay = np.flatnonzero(rank >= left_out[band][owner])
    name = mix(band[owner[stay]].astype(U64) * U64(0xD1342543DE82EF95) + number[stay].astype(U64))
    choices = list(combinations(range(n_parts), n_parts - edits))
    salts = mix(np.arange(1, len(choices) + 1, dtype=U64) * _GAMMA)
    keys = [mix(mix(sums[stay][:, list(chosen)].sum(axis=1, dtype=U64) + name) ^ salt) for chosen, salt in zip(choices, salts, strict=True)]
    return np.concatenate(keys), np.tile(of[owner[stay]], len(keys))


def _signature_batches(width: int, percent: int, edits: int, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for row, sets in shingle_sets(batch.column(1), width):
                key, at = signatures(sets, percent, edits, n_parts)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes[row + at])], names=["key", "node"])

    return run


# ---------------------------------------------------------------- verification


def _sides(batch: pa.RecordBatch, width: int) -> list[list[np.ndarray]]:
    """The sets of the texts in columns 2 and 3. A centre's text is on many rows, and is read once."""
    sides = []
    for c in (2, 3):
        column = batch.column(c).dictionary_encode()
        sets = [s for _, found in shingle_sets(column.dictionary, width) for s in found]
        sides.append([sets[i] for i in column.indices.to_pylist()])
    return sides


def _verify_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                sides = _sides(batch, width)
                both = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sides, strict=True)]
                either = [len(a) + len(b) - n for a, b, n in zip(*sides, both, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "common", "either"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")


def verify(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Sizes of the intersection (common) and the union (either) of the sets of the pairs (a, b); texts has (node, text)."""
    return _with_texts(pairs, texts).mapInArrow(_verify_batches(width), "a long, b long, common long, either long")


# ---------------------------------------------------------------- nodes and classes


class Nodes:
    """The different sets of a table: node, rep_id (least doc_id), digest, n_shingles; and their texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int):
        self.width = width
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.sets = materialize(self.texts.mapInArrow(_set_batches(width), "doc_id long, digest binary, n_shingles long"), "sets")
        known = self.sets.where("doc_id is not null and n_shingles > 0")
        reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep_id"), F.min("n_shingles").alias("n_shingles"))
        self.reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.repeated = repeats(known.select("doc_id"), "doc_id")

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of each wanted row (node, rep_id, digest)."""
        wanted = wanted.select(F.col("rep_id").alias("doc_id"), "node", "digest")
        n = wanted.limit(BROADCAST_ROWS + 1).count()
        near = self.texts.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "doc_id")
        if not self.repeated:
            return near.select("node", "text")
        # rows that share an id are told apart by their sets
        width = self.width

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [digest(s) for _, sets in shingle_sets(batch.column(1), width) for s in sets]
                yield batch.select([0, 1]).filter(pa.array([a == b for a, b in zip(found, batch.column(2).to_pylist(), strict=True)], pa.bool_()))

        return near.select("node", "text", "digest").mapInArrow(own, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def _buckets(signed: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, node, n (nodes of the bucket), n_shingles of the signatures that more than one node has."""
    counted = signed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    return materialize(counted.join(sizes, "node").select("key", "node", "n", "n_shingles"), "buckets")


def _candidates(buckets: DataFrame, bucket_pairs: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of small buckets and of larger ones' centres with their members; and the larger ones: key, node, hub, hub_met."""
    small = buckets.where(F.col("n") <= bucket_pairs).select("key", "node", "n_shingles")
    other = small.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("n_b"))
    fits = (F.col("node") < F.col("b")) & (F.least("n_shingles", "n_b") * 100 >= F.greatest("n_shingles", "n_b") * percent)
    pairs = small.join(other, "key").where(fits).select(F.col("node").alias("a"), "b")
    large = materialize(buckets.where(F.col("n") > bucket_pairs).join(buckets.groupBy("node").agg(F.sum("n").alias("met")), "node"), "large")
    hubs = large.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("back"))).alias("h")).select("key", (-F.col("h.back")).alias("hub"), F.col("h.met").alias("hub_met"))
    # both sides come from files, so a bucket with very many members can be split in the join
    large = materialize(large.join(materialize(hubs, "hubs"), "key").select("key", "node", "hub", "hub_met"), "stars")
    stars = large.where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    return pairs.union(stars).distinct(), large


def _recentred(large: DataFrame) -> DataFrame:
    """key, node, hub, hub_met with the most central of the hubs that a bucket's members have in any bucket."""
    best = materialize(large.groupBy("node").agg(F.max(F.struct("hub_met", (-F.col("hub")).alias("back"))).alias("c")), "centres")
    per = materialize(large.select("key", "node").join(best, "node").groupBy("key").agg(F.max("c").alias("c")), "centres")
    return materialize(large.select("key", "node").join(per, "key").select("key", "node", (-F.col("c.back")).alias("hub"), F.col("c.hub_met").alias("hub_met")), "stars")


def _open(large: DataFrame, classes: DataFrame) -> DataFrame:
    """The buckets in which a member is not in the centre's component."""
    apart = _apart(large.select("key", F.col("hub").alias("a"), F.col("node").alias("b")), classes).select("key").distinct()
    return materialize(large.join(apart, "key", "left_semi"), "open")


def _difference_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                sides = _sides(batch, width)
                diff = [np.setxor1d(h, x, assume_unique=True) for h, x in zip(*sides, strict=True)]
                times = np.array([len(d) for d in diff])
                at = pa.array(np.repeat(np.arange(len(diff)), times))
                sizes = [np.repeat([len(s) for s in side], times) for side in sides]
                columns = [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(x, pa.int64()) for x in (*sizes, np.repeat(times, times))], pa.array(np.concatenate(diff).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["hub", "node", "hub_size", "size", "n", "element"])

    return run


def difference_pairs(stars: DataFrame, texts: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (hub, node of stars) of one hub and different components that may be linked; every link is among them.

    With D the difference of a node from its hub, |x - y| counts |D(x)| + |D(y)| less twice what they share, and a link allows k(x, y) =
    t - 2 * ceil(p * t / (100 + p)) differences, t being both sizes and p the percentage. So a link needs max((|D(x)| + |D(y)| - k) / 2, |D(x)| - k, |D(y)| - k)
    shared elements, and the first of them, in the order of rarity, lies so far from the ends of both lists. One of the two, the probe, is
    not in the hub's component; then |D(x)| > k(x, hub), which bounds the others' lists to about their rarer half.
    """
    pairs = stars.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    both = _with_texts(pairs, texts)
    elements = both.mapInArrow(_difference_batches(width), "hub long, node long, hub_size long, size long, n long, element long")
    # what no other member has comes first in the order of rarity, and only takes places
    shared = elements.withColumn("df", F.count("*").over(Window.partitionBy("hub", "element"))).where("df > 1")
    lists = shared.groupBy("hub", "node", "hub_size", "size", "n").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("e"))
    own = classes.select(F.col("doc_id").alias("node"), F.col("class_id").alias("class"))
    hubs = classes.select(F.col("doc_id").alias("hub"), F.col("class_id").alias("hub_class"))
    lists = lists.join(own, "node", "left").join(hubs, "hub", "left").withColumns({"class": F.coalesce("class", "node"), "probe": F.coalesce("class", "node") != F.coalesce("hub_class", "hub"), "alone": F.col("n") - F.size("e")})
    more = F.col("size") - F.col("hub_size")
    least = F.greatest(F.lit(1), F.ceil((F.col("n") + F.when(more >= 0, 2 - more).otherwise(1)) / 2))  # shared with any probe
    most = F.floor(F.col("size") * (100 - percent) / percent) + 1  # k, whatever the partner, and one
    ends = lists.withColumns({"mine": F.least("n", most), "theirs": F.least(F.col("n") - least + 1, most)})
    kept = F.slice("e", 1, F.greatest(F.greatest(F.when(F.col("probe"), F.col("mine")).otherwise(0), F.col("theirs")) - F.col("alone"), F.lit(0)).cast("int"))
    prefix = ends.select("hub", "node", "size", "n", "class", "probe", "mine", "theirs", "alone", F.posexplode(kept).alias("place", "x")).withColumns({"element": F.col("x.element"), "place": F.col("alone") + F.col("place") + 1}).drop("x", "alone")
    prefix = materialize(prefix, "prefix")
    p, q = prefix.where("probe and place <= mine").alias("p"), prefix.where("place <= theirs").alias("q")
    t = F.col("p.size") + F.col("q.size")
    k = t - 2 * F.floor((percent * t + 99 + percent) / (100 + percent))
    needed = F.greatest(F.ceil((F.col("p.n") + F.col("q.n") - k) / 2), F.col("p.n") - k, F.col("q.n") - k, F.lit(1))
    sizes = F.least("p.size", "q.size") * 100 >= F.greatest("p.size", "q.size") * percent
    fits = (F.col("p.hub") == F.col("q.hub")) & (F.col("p.element") == F.col("q.element")) & (F.col("p.class") != F.col("q.class")) & sizes
    fits = fits & (F.col("p.place") <= F.col("p.n") - needed + 1) & (F.col("q.place") <= F.col("q.n") - needed + 1)
    return p.join(q, fits).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def links(nodes: Nodes, percent: int = PERCENT, levels: tuple[tuple[int, int], ...] = LEVELS, bucket_pairs: int = BUCKET_PAIRS, far: float = FAR) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, common, either) that connect all nodes that links connect, and the components (doc_id: the node, class_id) of nodes that have links."""
    similar = F.col("common") * 100 >= F.col("either") * percent
    checked: list[DataFrame] = []
    classes, todo = None, nodes.reps

    def hold(pairs: DataFrame) -> DataFrame:
        """The components after these pairs; no pair is verified twice."""
        for done in checked:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        texts = materialize(nodes.texts_of(_of(nodes, pairs)), "texts")
        checked.append(materialize(verify(pairs, texts, nodes.width), "checked"))
        release(texts)
        if classes is not None and not checked[-1].where(similar).limit(1).count():
            return classes
        return components(reduce(DataFrame.union, checked).where(similar))

    for level, (edits, n_parts) in enumerate(levels):
        signed = nodes.texts_of(todo).mapInArrow(_signature_batches(nodes.width, percent, edits, n_parts), "key long, node long")
        pairs, large = _candidates(_buckets(signed, nodes.reps.select("node", "n_shingles")), bucket_pairs, percent)
        classes = hold(pairs if classes is None else _apart(pairs, classes))
        large = _open(large, classes)
        if not large.limit(1).count():
            break
        large = _recentred(large)
        ends = [F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")]
        classes = hold(large.where("node <> hub").select(*ends).distinct())
        stars = _open(large, classes).where("node <> hub").select("hub", "node").distinct()
        d = reduce(DataFrame.union, checked).select("a", "b", (1 - F.col("common") / F.col("either")).alias("d"))
        stars = materialize(stars.select("hub", "node", *ends).join(d, ["a", "b"], "left").select("hub", "node", "d"), "distances")
        if not stars.limit(1).count():
            break
        last = level == len(levels) - 1
        near = stars if last else stars.where(F.coalesce(F.col("d") <= far + 1 - percent / 100 + 1e-9, F.lit(True)))
        near = near.select("hub", "node")
        texts = materialize(nodes.texts_of(_of(nodes, near.select(F.col("hub").alias("a"), F.col("node").alias("b")))), "texts")
        found = materialize(difference_pairs(near, texts, classes, nodes.width, percent), "candidates")
        release(texts)
        classes = hold(found)
        if last:
            break
        beyond = stars.where(F.coalesce(F.col("d") > far - 1e-9, F.lit(True)))
        beyond = materialize(beyond.select("hub", "node"), "beyond")
        todo = nodes.reps.join(beyond.select("node").union(beyond.select(F.col("hub").alias("node"))).distinct(), "node", "left_semi")
        todo = materialize(todo, "todo")
        if not todo.limit(1).count():
            break
    return reduce(DataFrame.union, checked).where(similar), classes


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    own = classes.select(F.col("doc_id").alias("a"), F.col("class_id").alias("class_a"))
    others = classes.select(F.col("doc_id").alias("b"), F.col("class_id").alias("class_b"))
    return pairs.join(own, "a", "left").join(others, "b", "left").where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select(*pairs.columns)


def _of(nodes: Nodes, pairs: DataFrame) -> DataFrame:
    """The nodes that pairs (a, b) name."""
    named = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "named")
    return semi_join_ids(nodes.reps, named, "node")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, levels: tuple[tuple[int, int], ...] = LEVELS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id that links reach, its own included)."""
    nodes = Nodes(docs, id_col, text_col, width)
    _, classes = links(nodes, percent, levels, bucket_pairs)
    known = nodes.reps.join(classes.select(F.col("doc_id").alias("node"), F.col("class_id").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    known = materialize(known, "known")
    heads = materialize(known.groupBy("class").agg(F.min("rep_id").alias("component_id")), "heads")
    named = materialize(known.join(heads, "class").select("digest", "component_id"), "components")
    # both sides come from files, so a set with very many copies can be split in the join
    full = nodes.sets.where("doc_id is not null and n_shingles > 0").join(named, "digest", "left").select("doc_id", "n_shingles", "component_id")
    alone = nodes.sets.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(alone)


ORACLE = f"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least({SHINGLE}, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS t(k) WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM g GROUP BY doc_id),
rep AS (SELECT digest, min(doc_id) AS doc_id, any_value(n) AS n FROM z GROUP BY digest),
m AS (SELECT g.doc_id, g, n FROM g JOIN rep USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) AS total FROM m a JOIN m b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE common * 100 >= (total - common) * {PERCENT}),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS root FROM rep UNION SELECT b, root FROM reach JOIN links ON a = doc_id),
class AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN rep USING (digest) LEFT JOIN class ON class.doc_id = rep.doc_id
"""
