"""Token ids in Parquet list columns: ordered, dictionary-encoded, with small pages and page indexes.

Texts are range-partitioned by doc_id, encoded, and written as `ids` lists in ascending doc_id order, one contiguous
range to a file. Row groups and pages have set sizes and the writer adds column and offset indexes, so a reader can take
only the metadata columns, or only the pages of a doc_id range. Each row has its offset within its file's part;
the offset over all parts is added on reading from one small row per part.

Encoding uses the tokenizers library. A text is cut where no token of this vocabulary's kind can cross (white space,
and borders between ASCII letters, digits and punctuation; apostrophes and non-ASCII characters keep to their
neighbours), so a piece seen before is looked up in a table of bounded size. A piece of up to 7 bytes is its own key; a longer one
must agree in two unrelated 64-bit hashes. `pieces_are_safe` says whether a tokenizer
allows that; any other is applied to whole texts.

Defined results: null texts are encoded as empty and give only the end id. Rows that share a doc_id are ordered by text
(null first); a null doc_id comes first of all. An empty table gives an empty result. Columns besides the id and text
columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, U64, span_hashes, text_slices

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 64 << 10
SLOTS, POOL = 1 << 22, 1 << 24  # pieces remembered by a worker, and ids they may take together

# piece kinds: 0 white space, 1 letters, 2 digits, 3 punctuation, 4 sticks to its neighbours
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 4


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHAR = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _latin_letters(piece: str) -> str | None:
    """The byte-level form of a piece of Latin letters; None for any other piece."""
    if max(piece) >= "\u0250":
        return None
    piece = unicodedata.normalize("NFC", piece).lower()
    if not piece.isalpha() or max(piece) >= "\u0250":
        return None
    return "".join(map(_BYTE_CHAR.__getitem__, piece.encode()))


def pieces_are_safe(spec: dict) -> bool:
    """Lower-casing, white space dropped, and letters, digits and other characters pre-tokenised apart."""
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    pattern = splits[0]["pattern"].get("Regex", "") if splits else ""
    return kinds == ["NFC", "Replace", "Lowercase"] and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and spec["pre_tokenizer"]["pretokenizers"][-1]["type"] == "ByteLevel" and spec.get("post_processor") is None


class PieceEncoder:
    """Encodes slices of texts; remembers pieces in a table in which each has two possible places."""

    def __init__(self, path: str, slots: int = SLOTS, pool: int = POOL):
        self.tok = tokenizer(path)
        spec = json.loads(self.tok.to_str())
        marks = [x for x in spec.get("added_tokens", []) if x["special"] and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"])]
        self.by_piece = pieces_are_safe(spec) and bool(marks)
        self.mark = marks[-1] if marks else None
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.slots, self.most = slots, pool
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(self.slots, dtype=U64), np.zeros(self.slots, dtype=U64)
        self.at = np.zeros(self.slots, dtype=np.int32)
        self.size = np.zeros(self.slots, dtype=np.int32)
        self.pool, self.used = np.zeros(self.most, dtype=np.int32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.int32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces and their sizes.

        A piece of Latin letters is one pre-token, so the model takes it as it is; the others go through the whole
        tokenizer in one call, kept apart by a special token, which no piece holds.
        """
        found: list = [None] * len(pieces)
        rest = []
        model = self.tok.model.tokenize
        for i, p in enumerate(pieces):
            if not (p.isascii() and p.isalpha()):
                p = _latin_letters(p)
                if p is None:
                    rest.append(i)
                    continue
            found[i] = [t.id for t in model(p)]
        if rest:
            ids = self.tok.encode(self.mark["content"].join(pieces[i] for i in rest), add_special_tokens=False).ids
            part: list[int] = []
            at = iter(rest)
            for x in [*ids, self.mark["id"]]:
                if x == self.mark["id"]:
                    found[next(at)] = part
                    part = []
                else:
                    part.append(x)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter((x for f in found for x in f), dtype=np.int32, count=int(sizes.sum())), sizes

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes & U64(self.slots - 1)).astype(np.int64), ((hashes >> U64(32)) & U64(self.slots - 1)).astype(np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice, and their offsets by text."""
        raw = data.tobytes()
        if not self.by_piece or any(s in raw for s in self.special):
            return self._large(data, offs)
        starts, ends, hashes, checks, low = self.pieces(data, offs)
        one, two = self._places(hashes)
        place = np.where((self.key[one] == hashes) & (self.check[one] == checks), one, two)
        at, size = self.at[place].astype(np.int64), self.size[place].astype(np.int64)
        miss = np.flatnonzero((self.key[place] != hashes) | (self.check[place] != checks))
        if len(miss):
            miss = miss[np.lexsort((checks[miss], hashes[miss]))]
            new, check = hashes[miss], checks[miss]
            first = np.flatnonzero(np.append(True, (new[1:] != new[:-1]) | (check[1:] != check[:-1])))
            back = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(miss))))
            new, check, first = new[first], check[first], miss[first]
            text = low.tobytes()
            ids, sizes = self._new([text[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            if self.used + len(ids) > self.most:
                self.clear()
                return self._large(data, offs)
            where = self.used + np.cumsum(sizes) - sizes
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            at[miss], size[miss] = where[back], sizes[back]
            one, two = self._places(new)
            place = np.where(self.key[one] == 0, one, two)
            self.key[place], self.check[place], self.at[place], self.size[place] = new, check, where, sizes
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offs)]

    def _large(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        parts = self.whole([raw[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in range(len(offs) - 1)])
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), bounds

    def pieces(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        low, kind = _LOWER[data], _KIND[data]
        cut = np.zeros(n + 1, dtype=bool)
        if n:
            a, b = kind[:-1], kind[1:]
            cut[1:n] = (a != b) & ((a == 0) | (b == 0) | ((a < 4) & (b < 4)))
        cut[offs] = True
        edges = np.flatnonzero(cut)
        if not n:
            return edges[:0], edges[:0], np.zeros(0, U64), np.zeros(0, U64), low
        starts, ends = edges[:-1], edges[1:]
        text = kind[starts] != 0
        starts, ends = starts[text], ends[text]
        checks = np.zeros(len(starts), dtype=U64)
        long = np.flatnonzero(ends - starts > 7)
        checks[long] = span_hashes(low, starts[long], ends[long], salt=1)
        return starts, ends, np.maximum(span_hashes(low, starts, ends), U64(1)), checks, low


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process; what it remembers serves later tasks."""
    return PieceEncoder(path)


def _encode_batches(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = encoder(path), 0
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            for row, data, offs in text_slices(batch.column(1)):
                ids, bounds = coder.encode(data, offs)
                n = len(offs) - 1
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(n + 1)
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(np.full(n, part, np.int32)), pa.array(seen + bounds[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                seen += int(sizes.sum())

    return run


SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    order: list[Column] | None = None,
) -> None:
    """Encode whole texts and write them in ascending doc_id order, or in the order of the given columns."""
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if order:
        names = [f"order_{i}" for i in range(len(order))]
        ordered = docs.select(*columns, *[c.alias(k) for c, k in zip(order, names, strict=True)]).repartitionByRange(n, *names).sortWithinPartitions(*names).select("doc_id", "text")
    else:  # a doc_id that many rows share is split by its text
        ordered = docs.select(*columns).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    (
        ordered.mapInArrow(_encode_batches(tokenizer_path, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.writer.version", "v2")
        .parquet(path)
    )


def file_order(docs: DataFrame) -> list[Column] | None:
    """Columns that order rows as their files hold them; None where docs does not come straight from files."""
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:
        return None
    return place


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. Selecting fewer columns reads fewer; doc_id filters skip row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one row per part, whatever the number of documents
    parts = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = parts.select("part", (before - F.col("total")).alias("base"))
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offs = np.asarray(lists.offsets)
        flat = np.asarray(lists.values.fill_null(0)).astype("<u4")  # the whole buffer: offsets index it
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return stored.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
