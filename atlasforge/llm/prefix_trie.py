"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. In each round every class that has members is split by its members' next
turn; the parts are its children. A part with one member is retired: what is left of it is a chain of nodes with one child
each, emitted from its turns without any further round. Conversations that are equal as a whole are one member with a weight, so
copies cost no rounds. After every BLOCK rounds each class runs on, in one step, to the end of what all its members share, so a long common
prefix is a chain too, and rounds are bounded by BLOCK times the branchings on a path, not by the turns. At last the classes are
folded back from the deepest round to the root, which sums leaves and saved units.

Turns are told apart by the first 16 bytes of the SHA-256 of their role and text, so texts are read once and never shuffled.
Members carry their next BLOCK turns and fetch more only if still in a class after them. Places within a
conversation come from a range partitioning with offsets, so a conversation of any length is split over tasks.

Defined results: null role or text is empty; turns are ordered by turn (null first), equal turn numbers by the digest of
role and text; repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; a
conversation without turns is a member of the root only; an empty table gives an empty result. Columns other than the four
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 16  # turns that a member carries at a time
PIECE = 1024  # turns of a chain that are summed in one group
IDS = 4096  # width of a range of ids that are joined into one piece of a list
NO_IDS = hashlib.sha256(b"").hexdigest()

# ---------------------------------------------------------------- turns and their places


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that equal turns share: the role's length parts role and text."""
    return F.substring(F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)), 1, 16)


def numbered(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """The turns (conv_id, pos from 1, key, n_chars and, if asked for, role and text) of each conversation in their order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        turn_key(role, text).alias("key"),
        F.length(text).cast("long").alias("n_chars"),
        *([role.alias("role"), text.alias("text")] if texts else []),
        F.monotonically_increasing_id().alias("row"),  # parts equal turns, so that any number of them can be spread
    )
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("row")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()})
    ranged = materialize(ranged.drop("row", "turn"), "turns")
    # a conversation's rows in one part have consecutive numbers; its rows in earlier parts come before them
    spans = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = materialize(spans.select("conv_id", "part", (before - F.col("first") + 1).alias("shift")), "spans")
    placed = ranged.join(spans, ["conv_id", "part"]).withColumn("pos", F.col("seq") + F.col("shift"))
    return placed.select("conv_id", "pos", "key", "n_chars", *(["role", "text"] if texts else []))


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation rebuilt from the head of its group's base and its own further turns.

    turns: numbered(). With h = crc32(conv_id as text) mod `most`, conversation c takes the first h turns of c - c % group (all
    if fewer), then its own turns after its first h. Gives the sequences and the ids of all conversations, also of those left without turns.
    """
    own = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    c = F.col("conv_id")
    ids = own.select("conv_id", "n", (F.crc32(F.encode(c.cast("string"), "UTF-8")) % most).alias("h"), (c - c % group).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = materialize(ids.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("got")), "rebuilt-ids")
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    taken = ids.where("got > 0").join(heads, "base").where("pos <= got").select("conv_id", "pos", "key", "n_chars")
    kept = turns.join(ids.select("conv_id", "h", "got"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "key", "n_chars")
    return materialize(taken.union(kept), "rebuilt"), ids.select("conv_id")


# ---------------------------------------------------------------- members: different sequences


def _next_turns(sequences: DataFrame, done: int) -> Column:
    """The keys and sizes of the BLOCK turns after the first `done`, in order."""
    inside = (F.col("pos") > done) & (F.col("pos") <= done + BLOCK)
    return F.transform(F.sort_array(F.collect_list(F.when(inside, F.struct("pos", "key", "n_chars")))), lambda t: F.struct(t["key"].alias("key"), t["n_chars"].alias("n_chars")))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's pieces of ids, which come sorted; one state is kept, however many pieces there are."""
    conv, state = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for c, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if c == conv:
                state.update(b",")
            else:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "ends_sha256"])


def members(sequences: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each different sequence: conv_id (its least), weight (conversations that are equal to it), len, next (its first turns);
    and conv_id, ends_sha256 of the list of those conversations, numerically sorted."""
    whole = sequences.groupBy("conv_id").agg(
        F.count("*").alias("len"),
        F.bit_xor(F.xxhash64("pos", "key")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "key", "pos")).alias("y"),
        _next_turns(sequences, 0).alias("next"),
    )
    zero = F.lit(0).cast("long")
    named = materialize(ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("len", "x", "y")], "next"), "whole")
    same = ["len", "x", "y"]
    # ids of copies meet in ranges of ids, then ranges of a group are few rows
    pieces = named.groupBy(*same, F.floor(F.col("conv_id") / IDS).alias("piece")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    pieces = materialize(pieces, "pieces")
    groups = materialize(pieces.groupBy(*same).agg(F.min("first").alias("conv_id"), F.sum("n").alias("weight"), F.count("*").alias("n_pieces"), F.min("ids").alias("ids")), "groups")
    one = groups.where("n_pieces = 1").select("conv_id", F.sha2("ids", 256).alias("ends_sha256"))
    many = pieces.join(groups.where("n_pieces > 1").select(*same, "conv_id"), same).select("conv_id", "piece", "ids")
    many = many.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_digest_batches, "conv_id long, ends_sha256 string")
    distinct = groups.select("conv_id", "weight").join(named.select("conv_id", "len", "next"), "conv_id")
    return materialize(distinct, "members"), materialize(one.union(many), "ends")


# ---------------------------------------------------------------- refinement, chains, folding


def _chain_sums(chains: DataFrame) -> DataFrame:
    """chains (conv_id, pos, n_chars, ...) with `below`: n_chars summed from the row's place to the end of its conversation, in pieces."""
    chains = chains.withColumn("piece", F.floor(F.col("pos") / PIECE))
    later = chains.groupBy("conv_id", "piece").agg(F.sum("n_chars").alias("s"))
    later = later.select("conv_id", "piece", F.coalesce(F.sum("s").over(Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    inner = F.sum("n_chars").over(Window.partitionBy("conv_id", "piece").orderBy(F.desc("pos")))
    return chains.withColumn("inner", inner).join(later, ["conv_id", "piece"]).withColumn("below", F.col("inner") + F.col("later")).drop("piece", "inner", "later")


def _run_on(sequences: DataFrame, going: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes taken on to the end of what all their members share: the members with their new `done` and next turns, and the nodes on the way (conv_id, pos, n_convs, n_chars)."""
    going = materialize(going.drop("next"), "going")
    sizes = going.groupBy("cls").agg(F.count("*").alias("m"), F.sum("weight").alias("n_convs"), F.min("done").alias("done"))
    rows = sequences.join(going.select("conv_id", "cls", "done"), "conv_id").where("pos > done")
    places = rows.groupBy("cls", "pos").agg(F.count("*").alias("k"), F.min("key").alias("a"), F.max("key").alias("b"), F.min("n_chars").alias("n_chars"))
    places = materialize(places.join(sizes, "cls"), "places")
    # different members part at some place; a member that is alone stays where it is
    parts = places.groupBy("cls", "m", "done").agg(F.min(F.when((F.col("k") < F.col("m")) | (F.col("a") != F.col("b")), F.col("pos"))).alias("stop"))
    upto = materialize(parts.select("cls", F.when(F.col("m") > 1, F.col("stop") - 1).otherwise(F.col("done")).alias("upto")), "upto")
    chain = places.join(upto, "cls").where("pos <= upto").select(F.col("cls").alias("conv_id"), "pos", "n_convs", "n_chars")
    moved = materialize(going.drop("done").join(upto.withColumnRenamed("upto", "done"), "cls"), "moved")
    ahead = sequences.join(moved.select("conv_id", "done"), "conv_id").where(F.col("pos") <= F.col("done") + BLOCK).where("pos > done")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("pos", "key", "n_chars"))), lambda t: F.struct(t["key"].alias("key"), t["n_chars"].alias("n_chars")))
    fetched = moved.join(ahead.groupBy("conv_id").agg(turns.alias("next")), "conv_id", "left")
    return materialize(fetched.select("conv_id", "weight", "len", "cls", "done", "next"), "fetched"), materialize(chain, "run")


def _refined(sequences: DataFrame, distinct: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame], dict[int, DataFrame]]:
    """Rounds of splitting: per round the classes with several members, the retired members, the members that end in a class, and the chains that follow a round's classes."""
    top = distinct.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs")).where("conv_id is not null")
    zero = F.lit(0).cast("long")
    shared = [materialize(top.select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", zero.alias("n_chars"), zero.alias("depth")), "root")]
    root = shared[0].first()
    active = distinct.withColumns({"cls": F.lit(root["conv_id"] if root else None).cast("long"), "done": zero})
    retired: list[DataFrame] = []
    ended: list[DataFrame] = []
    chains: dict[int, DataFrame] = {}
    place = [F.col("conv_id").alias("member"), F.col("cls").alias("conv_id"), F.col("done").alias("depth")]
    while True:
        ended.append(active.where("len = done").select(*place))
        going = active.where("len > done")
        level = len(shared) - 1
        if level and level % BLOCK == 0:
            going, chains[level] = _run_on(sequences, going)
            ended.append(going.where("len = done").select(*place))
            going = going.where("len > done")
        first = F.get("next", F.lit(0))
        going = going.select("conv_id", "weight", "len", "cls", (F.col("done") + 1).alias("done"), first["key"].alias("key"), first["n_chars"].alias("n_chars"), F.expr(f"slice(next, 2, {BLOCK})").alias("next"))
        parts = going.groupBy("cls", "key").agg(F.min("conv_id").alias("part"), F.count("*").alias("k"), F.sum("weight").alias("n_convs"), F.min("n_chars").alias("n_chars"), F.min("done").alias("depth"))
        parts = materialize(parts, "parts")
        node = [F.col("part").alias("conv_id"), F.col("cls").alias("parent"), "n_convs", "n_chars", "depth"]
        retired.append(parts.where("k = 1").select(*node))
        shared.append(parts.where("k > 1").select(*node))
        if not shared[-1].limit(1).count():
            return shared[:-1], retired, ended, chains
        # both sides come from files, so a class with very many members can be split in the join
        stay = parts.where("k > 1").select("cls", "key", "part")
        active = materialize(going.join(stay, ["cls", "key"]).select("conv_id", "weight", "len", F.col("part").alias("cls"), "done", "next"), "active")


def nodes(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie of sequences (conv_id, pos from 1 on, key, n_chars) of the conversations ids (conv_id).

    One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    distinct, ends = members(sequences, ids)
    shared, retired, ended, runs = _refined(sequences, distinct)

    # retired members: all that is left of them, from their own first node on
    tops = reduce(DataFrame.union, [r.select("conv_id", "parent", F.lit(i + 1).alias("round"), F.col("depth").alias("top"), F.col("n_convs").alias("weight")) for i, r in enumerate(retired)])
    tops = materialize(tops.join(distinct.select("conv_id", "len"), "conv_id"), "tops")
    rows = sequences.select("conv_id", "pos", "n_chars").join(tops, "conv_id").where("pos >= top")
    single = rows.where("weight = 1").withColumn("below", F.lit(0).cast("long"))
    chains = materialize(single.unionByName(_chain_sums(rows.where("weight > 1"))), "chains")
    saved = ((F.col("weight") - 1) * F.col("below")).alias("saved_tokens")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = chains.select("conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("weight").alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), saved)

    # fold back: each class gets the sums of its parts, from the deepest round up
    chain_tops = chains.where("pos = top").select("parent", "round", one.alias("n_leaves"), saved)
    folded: list[DataFrame] = []
    between: list[DataFrame] = []
    for level in range(len(shared) - 1, -1, -1):
        kids = chain_tops.where(F.col("round") == level + 1).drop("round")
        if folded:
            kids = kids.unionByName(folded[-1].select(F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens"))
        sums = kids.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        classes = shared[level].withColumn("run", zero)
        if level in runs:  # what follows the class before it is split
            sums = materialize(sums, "sums")
            run = materialize(_chain_sums(runs[level]), "run-sums")
            whole = run.groupBy("conv_id").agg(F.max("pos").alias("last"), F.max((F.col("n_convs") - 1) * F.col("below")).alias("run"))
            way = run.join(whole.drop("run"), "conv_id").join(sums, "conv_id")
            way = way.select("conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_convs", F.when(F.col("pos") == F.col("last"), F.col("kids")).otherwise(one).alias("n_children"), F.col("leaves").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("below") + F.col("saved")).alias("saved_tokens"))
            between.append(materialize(way, "way"))
            classes = shared[level].join(whole.select("conv_id", "run"), "conv_id", "left")
            sums = sums.join(whole.select("conv_id", F.lit(True).alias("ran")), "conv_id", "left").withColumn("kids", F.when(F.col("ran"), one).otherwise(F.col("kids"))).drop("ran")
        own = (F.col("n_convs") - 1) * F.col("n_chars")
        folded.append(materialize(classes.join(sums, "conv_id", "left").select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("kids", zero).alias("n_children"),
            F.coalesce("leaves", one).alias("n_leaves"),  # only a root without turns has no parts
            (own + F.coalesce("run", zero) + F.coalesce("saved", zero)).alias("saved_tokens"),
        ), "folded"))

    # the conversations that end in a node: a chain's in its last one, others where they left their class
    last = tops.select(F.col("conv_id").alias("member"), "conv_id", F.col("len").alias("depth"))
    at = reduce(DataFrame.union, [last, *ended]).join(ends.withColumnRenamed("conv_id", "member"), "member").select("conv_id", "depth", "ends_sha256")
    every = reduce(DataFrame.unionByName, [tails, *folded, *between])
    return every.join(at, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = materialize(numbered(conversations), "numbered")
    return nodes(turns, turns.select("conv_id").distinct())


def shared_head_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt by with_shared_heads()."""
    return nodes(*with_shared_heads(materialize(numbered(conversations), "numbered")))


def last_turns(trie_nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The role and text that each node of trie(conversations) ends with; the root has none."""
    turns = numbered(conversations, texts=True).select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return trie_nodes.join(turns, ["conv_id", "depth"], "left")


ORACLE = """
WITH RECURSIVE
bits AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS turns FROM (
  SELECT conv_id, turn, {'k': substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32), 'n': length(coalesce(text, ''))} AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, turns,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: xor(t[(xor(c & 255, b) + 1)::INT], c >> 8)), 4294967295) % 6 AS h
  FROM own, crc_table),
seq AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1 : a.h], a.turns[a.h + 1 :]) AS s FROM heads a LEFT JOIN own b ON b.conv_id = a.base),
member AS (
  SELECT conv_id, d, len(s) AS n_turns, CASE WHEN d = 0 THEN 0 ELSE s[d].n END AS chars, sha256(list_aggregate(list_transform(s[1 : d], lambda x: x.k), 'string_agg', ',')) AS path
  FROM seq, unnest(range(0, len(s) + 1)) AS u(d)),
node AS (
  SELECT d, coalesce(path, '') AS path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = d), '')) AS ends_sha256
  FROM member GROUP BY ALL),
up AS (
  SELECT n.conv_id, n.d, p.conv_id AS parent_conv_id FROM node n JOIN member m ON m.conv_id = n.conv_id AND m.d = n.d - 1 JOIN node p ON p.d = m.d AND p.path = coalesce(m.path, '')),
kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
below AS (
  SELECT n.conv_id, n.d, sum((y.n_convs - 1) * y.chars) AS saved, count(*) FILTER (WHERE k.n_children IS NULL) AS leaves
  FROM node n JOIN member m ON m.d = n.d AND coalesce(m.path, '') = n.path JOIN node y ON y.conv_id = m.conv_id AND y.d >= n.d LEFT JOIN kids k ON k.conv_id = y.conv_id AND k.d = y.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN below b USING (conv_id, d) LEFT JOIN up USING (conv_id, d) LEFT JOIN kids k USING (conv_id, d)
"""
