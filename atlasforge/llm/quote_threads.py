"""Quotation linking: conversations in reply order without their quotes, with DataFrame functions only.

Lines that begin with '>' marks are quotes; their number is the level. Consecutive lines of one level, without an empty line between
them, are a passage. Passages, their sentences and their lines are normalised (lower case, letters and digits, single spaces) and
hashed, so a quote that was wrapped anew is found by its passage or sentences, and a part of a passage by its sentences or
lines. A quoted piece is joined, within its conversation, to the earliest message that has the same piece in its own, unquoted
text. A message replies to the earlier message that owns most characters of its level-1 pieces (ties: the later one);
deeper levels give the ancestors it quotes. A message without a linked quote follows the previous message of its conversation.

Messages are ordered by thread and turn: a message that replies to one that is not the previous message starts a branch, and each
message belongs to the branch it continues; the branch's root is found by pointer doubling over branch heads alone.
The previous message, the running branch head and the reply rank are all found in two steps, within pieces of PIECE turns
and over the pieces, so that a conversation with a third of all messages is spread over many tasks.

Defined results: null text is empty; quoted lines without letters or digits, or that no earlier message of the conversation has,
link to nothing and are still removed; several messages of one conversation and turn keep their own text and quotes, share
the place and count as one turn for linking; a message with a null conv_id or turn is kept without a place (parent, thread, branch,
depth and rank are null) and links nothing; empty tables give empty results. Of other columns only role is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIECE = 1024
_MARKS = "^[ \\t]*((?:>[ \\t]?)+)"


def normal_line(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, "[^\\p{L}\\p{N}]+", " ")))


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Each message with `lines`: array of (level, text without marks, normal form)."""
    lines = F.transform(
        F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\r?\n"),
        lambda x: F.struct(quote_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line"), normal_line(F.regexp_replace(x, _MARKS, "")).alias("normal")),
    )
    return messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), "role", lines.alias("lines"))


_RUN, _LEVEL, _SENTENCE = "\u0002", "\u0003", "\u0001"


def pieces() -> Column:
    """Of a message's `lines`: (level, normal form) of its passages, their sentences and its lines, each once and none empty."""
    bare = lambda x: F.regexp_replace(x["line"], "[\u0001-\u0003]", " ")

    def joined(x: Column, i: Column) -> Column:
        before = F.get("lines", i - 1)
        same = (i > 0) & (before["level"] == x["level"]) & (before["normal"] != "") & (x["normal"] != "")
        return F.concat(F.when(same, " ").otherwise(F.concat(F.lit(_RUN), x["level"].cast("string"), F.lit(_LEVEL))), bare(x))

    runs = F.filter(F.split(F.array_join(F.transform("lines", joined), ""), _RUN), lambda r: r != "")

    def parts(run: Column) -> Column:
        level, text = F.substring_index(run, _LEVEL, 1).cast("int"), F.substring_index(run, _LEVEL, -1)
        sentences = F.split(F.regexp_replace(text, "([.!?]+)\\s+", f"$1{_SENTENCE}"), _SENTENCE)
        return F.transform(F.concat(F.array(text), sentences), lambda t: F.struct(level.alias("level"), normal_line(t).alias("normal")))

    lines = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), x["normal"].alias("normal")))
    return F.array_distinct(F.filter(F.concat(F.flatten(F.transform(runs, parts)), lines), lambda x: x["normal"] != ""))


def passages(parsed: DataFrame) -> DataFrame:
    """Quoted and own pieces that have letters or digits: conv_id, turn, level, hash, n_chars."""
    return (
        parsed.where("conv_id is not null and turn is not null")
        .select("conv_id", "turn", F.explode(pieces()).alias("x"))
        .select("conv_id", "turn", F.col("x.level").alias("level"), F.sha2("x.normal", 256).alias("hash"), F.length("x.normal").alias("n_chars"))
    )


def links(lines: DataFrame) -> DataFrame:
    """For each message and level: the earlier message that owns most of the quoted characters (conv_id, turn, level, target)."""
    origin = lines.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("target"))
    quoted = lines.where("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.sum("n_chars").alias("n_chars"))
    found = quoted.join(origin, ["conv_id", "hash"]).where("target < turn").groupBy("conv_id", "turn", "level", "target").agg(F.sum("n_chars").alias("n"))
    return found.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("n", "target")).alias("best")).select("conv_id", "turn", "level", F.col("best.target").alias("target"))


def _carry(df: DataFrame, value: str, out: str, inclusive: bool) -> DataFrame:
    """The greatest `value` among a conversation's rows up to this turn (or before it), in pieces of turns."""
    piece = F.floor(F.col("turn") / PIECE)
    rows = df.withColumn("_piece", piece)
    upto = Window.currentRow if inclusive else -1
    inside = Window.partitionBy("conv_id", "_piece").orderBy("turn").rowsBetween(Window.unboundedPreceding, upto)
    over = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv_id", "_piece").agg(F.max(value).alias("_top")).select("conv_id", "_piece", F.max("_top").over(over).alias("_earlier"))
    return rows.withColumn("_own", F.max(value).over(inside)).join(pieces, ["conv_id", "_piece"]).withColumn(out, F.coalesce("_own", "_earlier")).drop("_piece", "_own", "_earlier")


def threads(messages: DataFrame, rounds: int = 40) -> DataFrame:
    """One row per message in reply order.

    conv_id, turn, role, parent_turn, quoted_turns (targets by level), thread (turn of the thread's first message), branch
    (turn of the branch's head), depth (branches between it and the thread's first), reply_rank (from 0, within the
    conversation, by thread, branch and turn) and text without quotes.
    """
    parsed = materialize(parse(messages), "messages")
    found = links(passages(parsed))
    by_turn = found.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("level") == 1, F.col("target"))).alias("quoted"), F.transform(F.array_sort(F.collect_list(F.struct("level", "target"))), lambda x: x["target"]).alias("quoted_turns")
    )
    turns = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    turns = _carry(turns, "turn", "previous", inclusive=False).join(by_turn, ["conv_id", "turn"], "left")
    parent = F.coalesce("quoted", "previous")
    head = parent.isNull() | (parent != F.col("previous"))
    turns = turns.withColumn("parent_turn", parent).withColumn("_head", F.when(head, F.col("turn")))
    # a message continues the branch of the message it replies to: the latest head at or before it
    turns = materialize(_carry(turns, "_head", "branch", inclusive=True), "turns")

    of = turns.select("conv_id", F.col("turn").alias("parent_turn"), F.col("branch").alias("up"))
    heads = turns.where("_head is not null").select("conv_id", "branch", "parent_turn").join(of, ["conv_id", "parent_turn"], "left")
    heads = materialize(heads.select("conv_id", "branch", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth")), "heads")
    for _ in range(rounds):
        if heads.where("up is not null").limit(1).count() == 0:
            break
        far = heads.select("conv_id", F.col("branch").alias("up"), F.col("up").alias("upper"), F.col("depth").alias("more"), F.coalesce(*[F.col(c) for c in heads.columns if c == "root"], F.col("branch")).alias("_r"))
        step = heads.join(far, ["conv_id", "up"], "left")
        root = F.when(F.col("up").isNotNull(), F.col("_r")).otherwise(F.coalesce(*[F.col(c) for c in heads.columns if c == "root"], F.col("branch")))
        heads = materialize(step.select("conv_id", "branch", F.col("upper").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), root.alias("root")), "heads")
    else:
        raise RuntimeError("threads did not settle")
    if "root" not in heads.columns:
        heads = heads.withColumn("root", F.col("branch"))
    placed = turns.join(heads.select("conv_id", "branch", "depth", F.col("root").alias("thread")), ["conv_id", "branch"])

    # rank by (thread, branch, turn): within pieces of a branch's turns, then offsets of the pieces
    rows = placed.withColumn("_piece", F.floor(F.col("turn") / PIECE))
    pieces = rows.groupBy("conv_id", "thread", "branch", "_piece").agg(F.count("*").alias("m"))
    over = Window.partitionBy("conv_id").orderBy("thread", "branch", "_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = pieces.select("conv_id", "branch", "_piece", (F.sum("m").over(over) - F.col("m")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "branch", "_piece").orderBy("turn"))
    ranked = rows.withColumn("_in", inside).join(offsets, ["conv_id", "branch", "_piece"])
    ranked = ranked.select("conv_id", "turn", "parent_turn", "quoted_turns", "thread", "branch", "depth", (F.col("_before") + F.col("_in") - 1).cast("long").alias("reply_rank"))

    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    texts = parsed.select("conv_id", "turn", "role", own.alias("text"))
    none = F.array().cast("array<bigint>")
    return texts.join(ranked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("quoted_turns", none).alias("quoted_turns"), "thread", "branch", F.col("depth").cast("int").alias("depth"), "reply_rank", "text"
    )


ORACLE = """
WITH RECURSIVE raw AS (SELECT conv_id, turn, role, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls, row_number() OVER () AS rid FROM conversations),
l AS (
  SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(ls[i], '^[ \\t]*((?:>[ \\t]?)+)', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(ls[i], '^[ \\t]*((?:>[ \\t]?)+)', '') AS line,
         trim(lower(regexp_replace(regexp_replace(ls[i], '^[ \\t]*((?:>[ \\t]?)+)', ''), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS normal
  FROM raw, unnest(range(1, len(ls) + 1)) AS t(i)),
u AS (SELECT *, sum(brk) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
  SELECT *, CASE WHEN normal <> '' AND lag(normal) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS brk FROM l WINDOW w AS (PARTITION BY rid ORDER BY i))),
runs AS (SELECT rid, conv_id, turn, level, string_agg(line, ' ' ORDER BY i) AS text FROM u GROUP BY rid, conv_id, turn, level, run),
pc AS (SELECT DISTINCT rid, conv_id, turn, level, trim(lower(regexp_replace(x, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS normal FROM (
  SELECT rid, conv_id, turn, level, text AS x FROM runs UNION ALL SELECT rid, conv_id, turn, level, line FROM l
  UNION ALL SELECT rid, conv_id, turn, level, unnest(string_split(regexp_replace(text, '([.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1))) FROM runs)),
own AS (SELECT rid, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), '')) AS text FROM l GROUP BY rid),
origin AS (SELECT conv_id, normal, min(turn) AS target FROM pc WHERE level = 0 AND normal <> '' GROUP BY ALL),
f AS (SELECT q.conv_id, q.turn, level, target, sum(length(q.normal)) AS n FROM pc q JOIN origin o ON q.conv_id = o.conv_id AND q.normal = o.normal
      WHERE level > 0 AND q.normal <> '' AND target < q.turn GROUP BY ALL),
b AS (SELECT conv_id, turn, level, max((n, target))[2] AS target FROM f GROUP BY ALL),
bt AS (SELECT conv_id, turn, max(target) FILTER (WHERE level = 1) AS quoted, list(target ORDER BY level) AS quoted_turns FROM b GROUP BY ALL),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM raw WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
p AS (SELECT t.*, quoted_turns, coalesce(quoted, previous) AS parent_turn FROM t LEFT JOIN bt USING (conv_id, turn)),
h AS (SELECT *, max(CASE WHEN parent_turn IS NULL OR parent_turn <> previous THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS branch FROM p),
heads AS (SELECT c.conv_id, c.branch, u.branch AS up FROM h c LEFT JOIN h u ON u.conv_id = c.conv_id AND u.turn = c.parent_turn WHERE c.turn = c.branch),
walk AS (
  SELECT conv_id, branch, branch AS thread, 0 AS depth FROM heads WHERE up IS NULL
  UNION ALL SELECT x.conv_id, x.branch, w.thread, w.depth + 1 FROM heads x JOIN walk w ON x.conv_id = w.conv_id AND x.up = w.branch)
SELECT r.conv_id, r.turn, r.role, h.parent_turn, coalesce(h.quoted_turns, []) AS quoted_turns, w.thread, h.branch, w.depth,
       CAST(k.rank AS BIGINT) AS reply_rank, own.text
FROM raw r JOIN own USING (rid) LEFT JOIN h ON h.conv_id = r.conv_id AND h.turn = r.turn LEFT JOIN walk w ON w.conv_id = h.conv_id AND w.branch = h.branch
LEFT JOIN (SELECT h.conv_id, h.turn, row_number() OVER (PARTITION BY h.conv_id ORDER BY thread, h.branch, h.turn) - 1 AS rank FROM h JOIN walk w ON w.conv_id = h.conv_id AND w.branch = h.branch) k
  ON k.conv_id = r.conv_id AND k.turn = r.turn
"""
