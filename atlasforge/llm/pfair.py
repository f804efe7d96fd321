"""Mixing sources to target weights by a Pfair schedule, with DataFrame functions only.

Rows of a source are put in a fixed pseudo-random order and cut into blocks. With integer weights w of total W, block j
(from 0) of a source may run from slot floor(j * W / w) on and must end by slot ceil((j + 1) * W / w). At every slot
the earliest deadline among the released blocks goes first (ties by source name). Every source then gets w slots in W, and
at any slot its count differs from its share by less than one block. The schedule repeats every W slots, so
only one period is planned. When a source runs out, a new phase begins with the others' weights.

Integer weights are target weights rounded to a resolution. It is doubled until all that rounding moves a source, from the
first slot to its last, is less than one block, so a count differs from the unrounded share by less than two. It
ends at MOST_RESOLUTION; beyond (some millions of blocks, or weights under its inverse) a share is off by up to about half its inverse a slot,
and a smaller one is raised to it.

The plan has at most a period a phase and never more than one number for each block. From the rows it takes one
count per source, and at most MAX_SOURCES of them. Rows of one source are numbered by pieces of its order, so that a
source with most of the rows is spread over many tasks.

The columns mix_block, mix_slot and mix_position of the input, if it has them, are replaced.

Defined results: a null source is a source of its own; sources absent from given weights, or of weight 0 or less, follow
after all others with equal weights; rows that repeat a doc_id are ordered by a hash of their text, and equal rows
take places one after the other; an empty table gives an empty result. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import heapq
import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, RESOLUTION, EXPONENT, MAX_SOURCES = 16, 512, 0.5, 4096
MOST_RESOLUTION = 1 << 20
LEAST_PIECE, MOST_PIECE = 64, 20_000  # rows of a piece, about


def period(weights: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, list[int]]:
    """Slots of each source within one period of sum(weights) slots: earliest deadline first among the released.

    With the sources' numbers of blocks, it ends early with the first slot that is a source's last.
    """
    total = sum(weights.values())
    waiting = [(0, name, 0) for name in sorted(weights)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {name: [] for name in weights}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, name, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[name]), name, j))
        deadline, name, j = heapq.heappop(ready)
        if t + 1 > deadline:
            raise AssertionError("a block missed its deadline")
        slots[name].append(t)
        if blocks and len(slots[name]) == blocks[name]:
            break
        if j + 1 < weights[name]:
            heapq.heappush(waiting, ((j + 1) * total // weights[name], name, j + 1))
    return slots


def plan(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Phases of the schedule: for each phase and source its first block, number of blocks, first slot, period and places."""
    left = {k: n for k, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        active = {k: weights[k] for k in left if weights.get(k, 0) > 0} or dict.fromkeys(left, 1)
        common = math.gcd(*active.values())
        active = {k: w // common for k, w in active.items()}
        total, slots = sum(active.values()), period(active, left)
        whole = all(len(slots[k]) == w for k, w in active.items())
        ends = {k: (left[k] - 1) // w * total + slots[k][(left[k] - 1) % w] for k, w in active.items() if whole or len(slots[k]) == left[k]}
        end = min(ends.values()) + 1
        for k, w in active.items():
            full, rest = divmod(end, total)
            used = full * w + sum(s < rest for s in slots[k])
            if used:
                out.append({"key": k, "first": done[k], "used": used, "start": start, "total": total, "places": slots[k]})
            done[k] += used
            left[k] -= used
        left = {k: n for k, n in left.items() if n}
        start += end
    return out


def target_weights(rows: dict[str, int], exponent: float = EXPONENT, resolution: int = RESOLUTION) -> dict[str, int]:
    """Integer weights in proportion to rows ** exponent, at least 1."""
    return rounded({k: n**exponent for k, n in rows.items() if n > 0}, resolution)


def rounded(share: dict[str, float], resolution: int) -> dict[str, int]:
    total = sum(share.values())
    return {k: max(1, math.floor(resolution * v / total + 0.5)) for k, v in share.items()}


def rounding(share: dict[str, float], whole: dict[str, int], blocks: dict[str, int]) -> float:
    """At most so many blocks are moved, for any source and slot, by the integer weights in place of the shares."""
    names = [k for k in share if blocks.get(k, 0) > 0]
    if not names:
        return 0.0
    t, w, n = (np.array([d[k] for k in names], dtype=float) for d in (share, whole, blocks))
    order = np.argsort(n / t, kind="stable")  # the order in which sources run out
    t, w, n = t[order], w[order], n[order]
    time, moved, before = n / t, np.zeros(len(t)), 0.0
    for i in range(len(t)):
        slots, before = (time[i] - before) * t[i:].sum(), time[i]
        moved[i:] += slots * np.abs(w[i:] / w[i:].sum() - t[i:] / t[i:].sum())
    return float(moved.max())


def whole_weights(share: dict[str, float], blocks: dict[str, int], resolution: int = RESOLUTION) -> dict[str, int]:
    """Integer weights of the least resolution, doubled from the given one, at which rounding moves less than one block."""
    while resolution < MOST_RESOLUTION and rounding(share, rounded(share, resolution), blocks) >= 1:
        resolution *= 2
    return rounded(share, resolution)


def interleave(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    resolution: int = RESOLUTION,
    piece_rows: int | None = None,
) -> DataFrame:
    """docs with mix_block (of its source), mix_slot (of its block) and mix_position (slot * block_rows + place in the block).

    weights: relative weights by source; by default rows ** EXPONENT. resolution: the least to which they are rounded.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.withColumns({"__mix_key": key, "__mix_order": order, "__mix_tie": text})
    counts = rows.groupBy("__mix_key").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    n = {r["__mix_key"]: r.n for r in counts}
    blocks = {k: -(-v // block_rows) for k, v in n.items()}
    share = {k: v**EXPONENT for k, v in n.items()} if weights is None else {("null" if k is None else f"={k}"): v for k, v in weights.items() if v > 0}
    phases = plan(blocks, whole_weights(share, blocks, resolution))

    # numbering within a source: by pieces of its order, each small, then offsets of the pieces
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece_rows = piece_rows or min(MOST_PIECE, max(LEAST_PIECE, sum(n.values()) // (2 * tasks)))
    width = 1
    while max(n.values(), default=0) / 16**width > piece_rows and width < 8:
        width += 1
    rows = rows.withColumn("__mix_piece", F.substring("__mix_order", 1, width))
    pieces = rows.groupBy("__mix_key", "__mix_piece").agg(F.count("*").alias("m"))
    before = Window.partitionBy("__mix_key").orderBy("__mix_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = pieces.select("__mix_key", "__mix_piece", (F.sum("m").over(before) - F.col("m")).alias("__mix_before"))
    within = F.row_number().over(Window.partitionBy("__mix_key", "__mix_piece").orderBy("__mix_order", id_col, "__mix_tie"))
    numbered = rows.withColumn("__mix_row", within).join(offsets, ["__mix_key", "__mix_piece"]).withColumn("__mix_row", F.col("__mix_before") + F.col("__mix_row") - 1)
    numbered = numbered.withColumn("mix_block", F.floor(F.col("__mix_row") / block_rows).cast("long"))

    schema = "array<struct<key string, first long, used long, start long, total long, places array<long>>>"
    planned = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(phases)), schema)).alias("__mix_plan"))
    p = F.col("__mix_plan")
    j = F.col("mix_block") - p["first"]
    w = F.size(p["places"])
    slot = p["start"] + F.floor(j / w) * p["total"] + F.element_at(p["places"], (j % w + 1).cast("int"))
    here = (F.col("__mix_key") == p["key"]) & (F.col("mix_block") >= p["first"]) & (F.col("mix_block") < p["first"] + p["used"])
    placed = numbered.join(F.broadcast(planned), here).withColumn("mix_slot", slot.cast("long"))
    placed = placed.withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("__mix_row") % block_rows)
    return placed.select(*[c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_position")], "mix_block", "mix_slot", "mix_position")


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of docs, with their columns alone, range-partitioned and sorted by their mixed position: files written from it hold the mixed order."""
    mixed = interleave(docs, weights, **options)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


ORACLE = f"""
WITH RECURSIVE n AS (SELECT coalesce('=' || source, 'null') AS k, count(*) AS n FROM documents GROUP BY 1),
o AS (
  SELECT list(k ORDER BY k) AS ks, list(CAST(ceil(n / {BLOCK_ROWS}.0) AS BIGINT) ORDER BY k) AS blocks,
         list(CAST(greatest(1, floor({RESOLUTION} * sqrt(n) / (SELECT sum(sqrt(n)) FROM n) + 0.5)) AS BIGINT) ORDER BY k) AS ws FROM n),
run AS (
  SELECT CAST(-1 AS BIGINT) AS slot, blocks AS todo, list_transform(blocks, lambda x: CAST(0 AS BIGINT)) AS j, list_transform(blocks, lambda x: CAST(0 AS BIGINT)) AS done,
         CAST(0 AS BIGINT) AS t, CAST(list_sum(ws) AS BIGINT) AS total, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS block FROM o
  UNION ALL
  SELECT slot + 1, todo2, CASE WHEN ended THEN list_transform(j, lambda x: CAST(0 AS BIGINT)) ELSE list_transform(range(1, len(j) + 1), lambda i: j[i] + CASE WHEN i = p THEN 1 ELSE 0 END) END,
         list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), CASE WHEN ended THEN 0 ELSE t + 1 END,
         CASE WHEN ended THEN CAST(coalesce(list_sum(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN todo2[i] > 0 THEN ws[i] ELSE 0 END)), 0) AS BIGINT) ELSE total END, p, done[p]
  FROM (
    SELECT *, list_transform(range(1, len(todo) + 1), lambda i: todo[i] - CASE WHEN i = p THEN 1 ELSE 0 END) AS todo2, todo[p] = 1 AS ended
    FROM (
      SELECT run.*, ws, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: todo[i] > 0 AND j[i] * total // ws[i] <= t),
        lambda i: ((j[i] + 1) * total + ws[i] - 1) // ws[i] * 10000 + i)) % 10000 AS p
      FROM run, o WHERE list_sum(todo) > 0))),
r AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS k, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents)
SELECT r.doc_id, r.source, r.place // {BLOCK_ROWS} AS mix_block, run.slot AS mix_slot, run.slot * {BLOCK_ROWS} + r.place % {BLOCK_ROWS} AS mix_position
FROM r, o, run WHERE run.slot >= 0 AND r.k = o.ks[run.pick] AND run.block = r.place // {BLOCK_ROWS}
"""
