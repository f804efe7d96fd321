"""Spelling variants: words within one edit of each other, each led to the far more frequent one.

Two words are near if they differ by exactly one inserted, deleted or replaced character. Each word gives an integer key for each
text that one deletion leaves, from polynomial hashes of what stands before and after the deleted place, computed for a
whole batch at once; and a key for the word itself. Keys are dealt out to partitions and sorted there; a key that stands alone ends there. For the others
the texts themselves are compared, so that a collision of keys never makes words near.

Deleting any character of a run of equal ones leaves the same text, so a run (from, to) gives one key. Words that leave the same
text and whose runs share a place are replacements of one another at that place: at most one word for each letter, so such a group is as small
as the alphabet. A word that equals what others leave is their neighbour by insertion.

A word's form is its near word with the largest count (of equal counts the first in code-point order) if that is at least
RATIO times its own. Forms have ever larger counts, so following them ends; the last is the root.

Counts cover all documents; each task counts the words of its texts before anything is shuffled. Defined results: null texts have no
words; a null doc_id counts as empty text in the checksum that marks typing errors; rows with the same id and text count each; words
shorter than min_chars or rarer than min_count are no words; an empty table gives an empty result. Columns other than the id and
text columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, U64, materialize, mix, text_slices

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
TYPO = 199  # a run of letters whose checksum this divides loses a letter
HELD = 1 << 18  # different words that a task holds before it passes their counts on

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = U64(pow(_BASE, -1, 1 << 64))
_SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))  # a random number for each letter, by its last byte

# ---------------------------------------------------------------- words and their counts


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text number of each run of letters."""
    low, n = _LOWER[data], len(data)
    lead = low == _LEAD
    inside = _LETTER[low] | lead
    inside[1:] |= lead[:-1]
    before, after = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    before[1:] = after[:n] = inside
    before[offs] = after[offs] = False
    starts, ends = np.flatnonzero(inside & ~before[:n]), np.flatnonzero(inside & ~after[1:]) + 1
    return low, starts, ends, np.searchsorted(offs, starts, side="right") - 1


def checksums(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from the crc32 values in state. Short spans a byte at a time, all together."""
    size = ends - starts
    crc = ~state.astype(np.uint32)
    for k in range(int(min(size.max(initial=0), 64))):
        go = np.flatnonzero((size > k) & (size <= 64))
        crc[go] = _CRC[(crc[go] ^ low[starts[go] + k]) & 255] ^ (crc[go] >> 8)
    crc = ~crc
    for i in np.flatnonzero(size > 64).tolist():
        crc[i] = zlib.crc32(low[starts[i] : ends[i]], int(state[i]))
    return crc.astype(np.int64)


def slice_words(data: np.ndarray, offs: np.ndarray, ids: list[str], min_chars: int, typo: int) -> pa.StructArray:
    """Words of a slice with their counts: values, counts."""
    low, starts, ends, owner = letter_runs(data, offs)
    leads = np.concatenate([[0], np.cumsum(low == _LEAD)])
    chars = ends - starts - (leads[ends] - leads[starts])
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    crc = checksums(low, starts, ends, seeds[owner])
    hit = crc % typo == 0
    typed = []
    for i in np.flatnonzero(hit & (chars > min_chars)).tolist():
        run, at = low[starts[i] : ends[i]].tobytes().decode(), int(crc[i] % chars[i])
        typed.append(run[:at] + run[at + 1 :])
    keep = np.flatnonzero(~hit & (chars >= min_chars))
    edge = np.zeros(len(low) + 1, dtype=np.int8)
    edge[starts[keep]] = 1
    edge[ends[keep]] -= 1
    size = np.concatenate([[0], np.cumsum(ends[keep] - starts[keep])]).astype(np.int64)
    bytes_ = np.ascontiguousarray(low[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)])
    plain = pa.LargeStringArray.from_buffers(len(keep), pa.py_buffer(size), pa.py_buffer(bytes_))
    return pa.chunked_array([plain, pa.array(typed, pa.large_string())]).value_counts()


def _count_batches(min_chars: int, typo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"word": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})
        for batch in batches:
            ids = pc.fill_null(batch.column(0).cast(pa.string()), "").to_pylist()
            for row, data, offs in text_slices(batch.column(1)):
                found = slice_words(data, offs, ids[row : row + len(offs) - 1], min_chars, typo)
                held = pa.concat_tables([held, pa.table({"word": found.field("values"), "n": found.field("counts")})])
                if held.num_rows > HELD:
                    held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                    if held.num_rows > HELD // 2:
                        yield from held.to_batches()
                        held = held.slice(0, 0)
        yield from held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """word, n of every word that is long and frequent enough, over all documents."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_count_batches(min_chars, typo), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- deletion keys


def deletion_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word number, from, to) of what each deletion leaves, and of each word itself with from = to = -1.

    A text's hash is the sum of symbol(c[j]) * base**j. With sums up to each place, what one deletion leaves is what stands before it
    plus what stands after it, the latter moved down by one power.
    """
    last = data != _LEAD  # one byte for each character
    at = np.concatenate([[0], np.cumsum(last)])[offs]
    symbols, size = data[last], np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(symbols)) - at[:-1][owner]
    power = np.cumprod(np.concatenate([[U64(1)], np.full(int(size.max(initial=1)), U64(_BASE))]), dtype=U64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_SYMBOL[symbols] * power[pos], dtype=U64)])
    begin, whole = sums[at[:-1]], sums[at[1:]] - sums[at[:-1]]
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (pos[1:] == 0)
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(symbols)) - 1
    who = owner[first]
    left = (sums[first] - begin[who]) + (sums[at[1:]][who] - sums[first + 1]) * _INVERSE
    key = np.concatenate([mix(left + mix((size[who] - 1).astype(U64))), mix(whole + mix(size.astype(U64)))])
    own = np.full(len(size), -1)
    return key.view(np.int64), np.concatenate([who, np.arange(len(size))]), np.concatenate([pos[first], own]), np.concatenate([pos[final], own])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for row, data, offs in text_slices(batch.column(1)):
            key, word, begin, end = deletion_keys(data, offs)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row + word]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=["key", "id", "begin", "end"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key is on another row too. The last row of a batch waits for the next one."""
    wait, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([wait, batch] if wait is not None else [batch]).combine_chunks()
        key = whole.column("key").to_numpy()
        same = key[1:] == key[:-1]
        shared = np.concatenate([[before is not None and bool(key[0] == before)], same]) | np.concatenate([same, [False]])
        yield from whole.slice(0, len(key) - 1).filter(pa.array(shared[:-1])).to_batches()
        if len(key) > 1:
            before = key[-2]
        wait = whole.slice(len(key) - 1).to_batches()[0]
    if wait is not None and before is not None and wait.column(0)[0].as_py() == before:
        yield wait


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (negative count and text of its near word with the largest count) of the words (word, n) that have near words."""
    known = materialize(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    keys = known.select("id", "word").mapInArrow(_key_batches, "key long, id long, begin int, end int")
    alike = materialize(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_batches, "key long, id long, begin int, end int"), "alike")
    left = F.when(F.col("begin") < 0, F.col("word")).otherwise(F.concat(F.expr("left(word, begin)"), F.expr("substring(word, begin + 2)")))
    texts = materialize(alike.join(known, "id").select("key", left.alias("left"), "begin", "end", "word", "n"), "texts")

    me = F.struct((-F.col("n")).alias("minus_n"), F.col("word"))
    cut = texts.where("begin >= 0")
    # replacements: one word for each letter at most, so a group's list is short
    places = cut.withColumn("place", F.explode(F.sequence("begin", "end")))
    groups = places.groupBy("key", "left", "place").agg(F.sort_array(F.collect_list(me)).alias("all")).where("size(all) > 1")
    one = groups.select("all", F.explode("all").alias("me"))
    first, second = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    replaced = one.select(F.col("me.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("me.word") == first["word"], second).otherwise(first).alias("best"))
    # insertions: a word that is what others leave
    whole = texts.where("begin < 0").select("key", "left", me.alias("shorter"))
    both = cut.select("key", "left", me.alias("longer")).join(whole, ["key", "left"])
    unit = F.lit(1).cast("long").alias("n_near")
    inserted = both.select(F.explode(F.array(F.struct("longer", F.col("shorter").alias("best")), F.struct(F.col("shorter").alias("longer"), F.col("longer").alias("best")))).alias("x"))
    inserted = inserted.select(F.col("x.longer.word").alias("word"), unit, F.col("x.best").alias("best"))
    return replaced.unionByName(inserted).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words (word, form): the last of the forms that follow one another. Each round doubles the steps."""
    known = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while known.where("moved").limit(1).count():
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = materialize(known.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return known.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, typo: int = TYPO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of all documents."""
    words = materialize(count_words(docs, id_col, text_col, min_chars, min_count, typo), "counts")
    near = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.minus_n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    near = materialize(near.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus_n")).alias("form_n")), "near")
    led = roots(near.where("form is not null").select("word", "form"))
    return near.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE
bits AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS said, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
marked AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(said))), lambda i: ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::BIGINT)),
         lambda s, b: xor(t[(xor(s & 255, b) + 1)::INT], s >> 8)), 4294967295) AS h FROM runs, crc_table),
typed AS (SELECT CASE WHEN h % {TYPO} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM marked),
w AS (SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.here WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, last(here ORDER BY k) AS root FROM way GROUP BY word) USING (word)
"""
