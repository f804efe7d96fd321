"""Near-duplicate line removal by a deletion-neighbourhood join; the earliest line stays.

Lines are normalised (lower case, single spaces). Equal lines of any length but 0 meet in one
aggregation that keeps the first place (document, line). Two different lines of at least MIN_CHARS characters within one edit are found by their
deletion variants: lines that differ by a substitution are equal after deleting the same place in both, and
a line with one character more equals the other after one deletion. Variants are hashed, equal keys are joined, and
the edit distance is verified on the texts.

One edit touches one of m pieces of a line, so the rest on both sides of that piece is equal. Lines are first held
against this with 2 pieces, the remaining ones with 8, and only deletions inside the piece in question are emitted. This loses no
pair. Within a key only the first place is joined to the others (all lines of a substitution key are within one edit of
each other), so no key gives all its pairs.

A line is removed if an equal line or a line within one edit stands at an earlier place, removed or not. Defined results: null
text is one empty line; empty lines stay; lines shorter than MIN_CHARS go only as exact copies; every row has places of its own: rows that share a
doc_id, or lack one, are ordered by a hash of their text, then the text, and of equal rows one comes first; a null doc_id comes
first of all; an empty table gives an empty result. Columns other than the id and text columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, repeats

MIN_CHARS, EXACT_CHARS = 12, 1
COARSE, FINE = 2, 8
PLACE = "decimal(30,0)"


def normal_line(line: Column) -> Column:
    """Lower case, single spaces, trimmed. Only lines with more than single spaces go through the pattern."""
    odd = F.contains(line, F.lit("  "))
    for space in "\t\r\f":
        odd = odd | F.contains(line, F.lit(space))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, "[ \\t\\r\\f]+", " ")).otherwise(line)))


def place(doc_id: Column, line_no: Column) -> Column:
    """Order of a line over all documents as one number: document, then line."""
    return (doc_id.cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + line_no).cast(PLACE)


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each different line with its first place: norm, at."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))
    lines = lines.select(normal_line(F.col("line")).alias("norm"), place(F.col("doc_id"), F.col("no")).alias("at")).where(F.length("norm") >= min_chars)
    return lines.groupBy("norm").agg(F.min("at").alias("at"))


def piece_keys(lines: DataFrame, m: int) -> DataFrame:
    """For the line as the shorter (l = its length) and as the longer partner (l = length - 1) and each of m pieces: the key of what is outside it."""
    n = F.length("norm")
    roles = F.array(F.struct(n.alias("l"), F.lit(True).alias("own")), F.struct((n - 1).alias("l"), F.lit(False).alias("own")))
    rows = lines.withColumn("r", F.explode(roles)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    l, j = F.col("r.l"), F.col("j")
    begin, end = F.floor(j * l / m).cast("int"), F.floor((j + 1) * l / m).cast("int")
    rows = rows.select(*lines.columns, l.alias("l"), F.col("r.own").alias("own"), begin.alias("a"), end.alias("b"))
    key = F.xxhash64("l", "a", F.left("norm", F.col("a")), F.right("norm", F.col("l") - F.col("b")))
    return rows.withColumn("key", key)


def _shared(keys: DataFrame) -> DataFrame:
    """Keys of two or more different lines, at least one of which is not the longer partner."""
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 and own").select("key")


def _with(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    n = keys.limit(BROADCAST_ROWS + 1).count()
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, name, "left_semi")


def near_lines(lines: DataFrame) -> DataFrame:
    """Places of lines (norm, at) that have a line within one edit at an earlier place."""
    coarse = materialize(piece_keys(lines, COARSE).select("key", "own", F.xxhash64("norm").alias("line")), "coarse")
    chosen = _with(coarse, materialize(_shared(coarse), "keys"), "key").select("line").distinct()
    near = materialize(_with(lines.withColumn("line", F.xxhash64("norm")), materialize(chosen, "lines"), "line").select("norm", "at"), "near")
    fine = materialize(piece_keys(near, FINE), "fine")
    fine = fine.join(_shared(fine), "key", "left_semi")
    # deletions inside the piece; a longer line may have its extra character right after it
    cut = fine.withColumn("i", F.explode(F.sequence(F.col("a"), F.col("b") - F.col("own").cast("int"))))
    cut = cut.where("own = false or i < b")
    variant = F.concat(F.left("norm", F.col("i")), F.right("norm", F.length("norm") - F.col("i") - 1))
    # two unrelated hashes, as only the first place of a key is held against the others
    own, same = F.col("own"), (F.lit("same"), F.col("l"), F.col("i"), variant)
    hashed = lambda h: F.when(own, h(*same)).otherwise(h(F.lit("more"), variant))
    cuts = cut.select("at", F.when(own, F.lit("same")).otherwise(F.lit("long")).alias("kind"), hashed(F.xxhash64).alias("v"), hashed(F.hash).alias("u"))
    whole = fine.where("own").select("at", F.lit("short").alias("kind"), F.xxhash64(F.lit("more"), "norm").alias("v"), F.hash(F.lit("more"), "norm").alias("u"))
    variants = materialize(cuts.union(whole).distinct(), "variants")

    first = {k: F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"first_{k}") for k in ("same", "long", "short")}
    groups = variants.groupBy("v", "u").agg(F.count("*").alias("n"), *first.values()).where("n > 1").drop("n")
    partner = F.when(F.col("kind") == "same", F.col("first_same")).when(F.col("kind") == "long", F.col("first_short")).otherwise(F.col("first_long"))
    pairs = variants.join(groups, ["v", "u"]).select("at", partner.alias("earlier")).where("earlier < at").distinct()
    texts = near.select(F.col("at").alias("earlier"), F.col("norm").alias("other"))
    checked = pairs.join(near, "at").join(texts, "earlier").where(F.levenshtein("norm", "other") <= 1)
    return checked.select("at").distinct()


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `place_id`: doc_id where all rows have one of their own, else the row's rank by (doc_id, hash of the text, text)."""
    if not repeats(docs.select("doc_id"), "doc_id") and not docs.where("doc_id is null").limit(1).count():
        return docs.withColumn("place_id", F.col("doc_id"))
    by = ["doc_id", "tie", "text"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # numbers grow with the partition, and with the row in it; written, so that they are the same wherever they are read
    ranked = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions(*by).withColumn("place_id", F.monotonically_increasing_id())
    return materialize(ranked.drop("tie"), "numbered")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """One row per document: doc_id, text without the removed lines, n_lines, n_kept.

    min_chars: least length of lines that an edit may set apart; exact_chars: of lines that go as exact copies.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    lines = materialize(distinct_lines(rows.select(F.col("place_id").alias("doc_id"), "text"), min(exact_chars, min_chars)), "distinct")
    removed = materialize(near_lines(lines.where(F.length("norm") >= min_chars)), "removed")
    n = removed.limit(BROADCAST_ROWS + 1).count()
    stay = lines.select("at").join(F.broadcast(removed) if n <= BROADCAST_ROWS else removed, "at", "left_anti")
    # a place back to its document: places of one document are within one step of 10**9
    doc = F.floor(F.col("at") / F.lit(10**9).cast("decimal(10,0)")).cast("decimal(20,0)")
    kept = stay.select(doc.cast("long").alias("place_id"), (F.col("at") - doc * F.lit(10**9).cast("decimal(10,0)")).cast("int").alias("no")).groupBy("place_id").agg(F.collect_list("no").alias("kept"))
    joined = rows.join(kept, "place_id", "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    takes_part = F.filter(every, lambda i: F.length(normal_line(F.get("lines", i))) >= min(exact_chars, min_chars))
    gone = F.array_except(takes_part, F.coalesce("kept", F.array().cast("array<int>")))
    left = joined.withColumn("left", F.array_except(every, gone))
    return left.select("doc_id", F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("left").cast("long").alias("n_kept"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, trim(lower(regexp_replace(ls[i], '[ \\t\\r\\f]+', ' ', 'g'))) AS norm
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)),
d AS (SELECT norm, min(row(doc_id, i)) AS pos FROM l WHERE length(norm) >= {EXACT_CHARS} GROUP BY norm),
k AS (
  SELECT norm, pos, length(norm) - s AS n, p,
         CASE p WHEN 0 THEN left(norm, (length(norm) - s) // 2) ELSE right(norm, (length(norm) - s) - (length(norm) - s) // 2) END AS part
  FROM d, (SELECT unnest([0, 1]) AS s), (SELECT unnest([0, 1]) AS p) WHERE length(norm) >= {MIN_CHARS}),
near AS (
  SELECT DISTINCT x.norm FROM k x JOIN k y ON x.n = y.n AND x.p = y.p AND x.part = y.part AND y.pos < x.pos
  WHERE abs(length(x.norm) - length(y.norm)) <= 1 AND levenshtein(x.norm, y.norm) <= 1),
f AS (
  SELECT l.*, length(norm) < {EXACT_CHARS} OR (EXISTS (SELECT 1 FROM d WHERE d.norm = l.norm AND d.pos = row(l.doc_id, l.i)) AND norm NOT IN (SELECT norm FROM near)) AS stays FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE stays) AS n_kept, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
