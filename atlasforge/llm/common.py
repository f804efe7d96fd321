"""Shared pieces: scratch tables in the cluster's shared folder, and vectorised text hashing.

The numpy helpers work on the UTF-8 bytes of an Arrow string column, a slice of
about a megabyte at a time, so memory does not depend on the batch or the row count.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 1 << 20

# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/atlasforge-scratch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    remove(spark, path)


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder name under the shared folder; removed when the session's program ends unless kept."""
    path = f"{shared_dir(spark)}/atlasforge/{name}-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(_remove_quietly, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the files of a frame that materialize() returned, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def repeats(df: DataFrame, key: str) -> bool:
    """Whether a key, or the lack of one, is on more than one row."""
    return df.groupBy(key).count().where("count > 1").limit(1).count() > 0


BROADCAST_ROWS = 1_000_000


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in ids. Up to `most` ids (8 bytes each) are broadcast; beyond it both sides shuffle."""
    n = ids.limit(most + 1).count()
    return df.join(F.broadcast(ids) if n <= most else ids, key, "left_semi")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


# ---------------------------------------------------------------- vectorised hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an unsigned array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SALT, _STEP = U64(0xA0761D6478BD642F), U64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
_CHAINED = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans. Spans of up to 7 bytes never collide with one another.

    Up to 64 bytes are mixed eight at a time, each into the state that went before; longer spans go through blake2b.
    Another salt gives another, unrelated hash.
    """
    size = (ends - starts).astype(np.int64)
    if not len(size):
        return np.zeros(0, dtype=U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    salted = mix(np.array([salt], dtype=U64) + _SALT)[0]
    h = mix((eight[starts] & _KEEP[np.minimum(size, 8)] | np.where(size < 8, size, 0).astype(U64) << U64(56)) ^ salted)
    at = np.flatnonzero((size > 7) & (size <= _CHAINED))
    if len(at):
        s, n, state = starts[at], size[at], mix(h[at] + size[at].astype(U64) * _STEP)
        for k in range(8, int(n.max()), 8):
            go = np.flatnonzero(n > k)
            state[go] = mix(state[go] * _STEP ^ (eight[s[go] + k] & _KEEP[np.minimum(n[go] - k, 8)]))
        h[at] = state
    far = np.flatnonzero(size > _CHAINED)
    if len(far):
        raw, person = data.tobytes(), salt.to_bytes(8, "little")
        h[far] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, person=person).digest(), "little") for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return h


#: Bytes of a word: digits, a-z and every byte of a non-ASCII character. A-Z are lower-cased first.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of whole texts with about `limit` bytes: (first row, bytes, offsets). Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if len(col) == 0:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null's offsets may span bytes
        col = col.fill_null("")
        yield from text_slices(col, limit)
        return
    row = 0
    while row < len(col):
        last = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), len(col))
        o = offs[row : last + 1] - offs[row]
        yield row, raw[offs[row] : offs[last]], o
        row = last


class Words:
    """Words of a slice: byte spans, 64-bit hashes, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, word: np.ndarray = _WORD):
        """word: whether each (lower-cased) byte belongs to a word."""
        low = _LOWER[data]
        inside = word[low]
        n = len(data)
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside
        before[offs] = False
        starts = np.flatnonzero(inside & ~before[:n])
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = inside
        after[offs] = False
        # the word ends where the next byte is outside or belongs to the next text
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.low, self.starts, self.ends = low, starts, ends
        self.bounds = np.searchsorted(starts, offs)  # words of text i: bounds[i]:bounds[i+1]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.low, self.starts, self.ends)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of `width` word hashes; a shorter text that has words gives one for all of them."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=U64)
    for j in range(width):
        out = (out ^ words[j : n - width + 1 + j]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(32)
    return mix(out)
