"""Planes of volume files as a Python Data Source with one partition for each slab of planes of each file.

    spark.dataSource.register(VolumePlanes)
    spark.read.format("volume_planes").option("path", "s3://bucket/volumes").option("slab", 32).load()

A partition reads the byte ranges of its own planes and nothing else, whatever the size of the file; the plan needs a header, and of a TIFF
the places of its directories. Where slabs or files are very many, PARTITIONS tasks share them: neighbours are read by one task, and a file smaller
than a task's share is not divided, so that only its task reads its header. Filters on `plane` leave out whole slabs. The path is a folder in a store that all executors reach (a
local path or a URI); .mrc, .rec, .map, .tif and .tiff files below it are read in order of their names, others are not looked at.

Values are unsigned and little-endian: signed MRC values are moved by half their range, white-is-zero TIFF values inverted, big-endian values
swapped, and `transform` names what was done, so that it can be undone. Files that cannot be read whole raise ValueError with the path and a code:
invalid_mrc_header, invalid_mrc_dimensions, unsupported_mrc_axis_mapping, unsupported_mrc_mode, mrc_payload_truncated,
invalid_tiff_dimensions_or_dtype, unsupported_tiff_bits, unsupported_tiff_photometric, unsupported_tiff_orientation, unsupported_tiff_compression,
unsupported_tiff_samples, inconsistent_tiff_ifd_shape_or_dtype, inconsistent_tiff_photometric, invalid_tiff_strip_layout, truncated_tiff_strip_payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .volumes import BITS, HEIGHT, WIDTH, Read, tiff_chain, tiff_directory

PLANES = "relative_path string, plane long, height long, width long, dtype string, transform string, raw binary"
MRC_NAMES, TIFF_NAMES = (".mrc", ".rec", ".map"), (".tif", ".tiff")

# Fixed values of the formats: stored type of each MRC mode, and TIFF tags.
MRC_TYPES = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}
COMPRESSION, PHOTOMETRIC, STRIPS, ORIENTATION, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 259, 262, 273, 274, 277, 278, 279


@dataclass
class Slab(InputPartition):
    """Planes first to last (exclusive) of a file, and what its header says. places: a TIFF's directories of these planes."""

    name: str
    first: int
    last: int
    size: int
    order: str = "<"
    height: int = 0
    width: int = 0
    kind: str = ""
    data: int = 0
    swapped: bool = False
    places: tuple[int, ...] = ()
    photometric: int = 1


@dataclass
class Slabs(InputPartition):
    """Neighbouring slabs, in order; one without a kind is a whole file whose header is still to be read."""

    slabs: tuple[Slab, ...]


PARTITIONS = 512  # most partitions of a read, and most headers that its plan reads, nearly
FILE_COST = 1 << 16  # bytes that opening a file counts for when tasks are dealt
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1000


def dealt(slabs: list[Slab], costs: list[float]) -> list[Slabs]:
    """A partition for each slab; beyond PARTITIONS, runs of neighbours of about equal cost."""
    share = sum(costs) / PARTITIONS if len(slabs) > PARTITIONS else 0
    out, run, size = [], [], 0.0
    for slab, cost in zip(slabs, costs, strict=True):
        run.append(slab)
        size += cost
        if size >= share:
            out.append(Slabs(tuple(run)))
            run, size = [], 0.0
    return [*out, Slabs(tuple(run))] if run else out


def unsigned(values: np.ndarray, white_is_zero: bool = False) -> tuple[np.ndarray, str]:
    """Little-endian unsigned values, and what was done: identity, integer_offset or unsigned_inversion. Floats stay as they are."""
    values = values.astype(values.dtype.newbyteorder("<"), copy=False)
    if values.dtype.kind == "i":
        same = values.view(values.dtype.str.replace("i", "u"))
        return same ^ same.dtype.type(1 << (8 * same.itemsize - 1)), "integer_offset"
    if white_is_zero:
        return ~values, "unsigned_inversion"
    return values, "identity"


# ---------------------------------------------------------------- headers


def mrc_slab(name: str, read: Read, size: int) -> Slab:
    """All planes of an MRC file: either byte order, a header of any length, columns and rows along x and y in either order, sections along z."""
    head = read(0, 1024)
    if len(head) < 1024 or head[208:212] != b"MAP ":
        raise ValueError(f"{name}: invalid_mrc_header")
    order = ">" if head[212:214] == b"\x11\x11" else "<"
    nx, ny, nz, mode = struct.unpack_from(order + "4i", head, 0)
    axes = struct.unpack_from(order + "3i", head, 64)
    (extended,) = struct.unpack_from(order + "i", head, 92)
    if min(nx, ny, nz) <= 0 or extended < 0:
        raise ValueError(f"{name}: invalid_mrc_dimensions")
    if axes not in ((0, 0, 0), (1, 2, 3), (2, 1, 3)):
        raise ValueError(f"{name}: unsupported_mrc_axis_mapping:{axes}")
    if mode not in MRC_TYPES:
        raise ValueError(f"{name}: unsupported_mrc_mode:{mode}")
    kind = order + MRC_TYPES[mode]
    if size < 1024 + extended + nx * ny * nz * np.dtype(kind).itemsize:
        raise ValueError(f"{name}: mrc_payload_truncated")
    return Slab(name, 0, nz, size, order, ny, nx, kind, 1024 + extended, axes == (2, 1, 3))


def tiff_slab(name: str, read: Read, size: int) -> Slab:
    """All planes of a classic TIFF, one directory each; the first one's shape and type hold for all."""
    try:
        order, places = tiff_chain(read, size)
        tags = tiff_directory(read, order, places[0]) if places else {}
    except (ValueError, struct.error) as e:
        raise ValueError(f"{name}: {e}") from e
    one = lambda tag, default=0: (tags.get(tag) or [default])[0]
    width, height, bits, photometric = one(WIDTH), one(HEIGHT), one(BITS, 8), one(PHOTOMETRIC, 1)
    if min(width, height) <= 0:
        raise ValueError(f"{name}: invalid_tiff_dimensions_or_dtype")
    if bits not in (8, 16):
        raise ValueError(f"{name}: unsupported_tiff_bits:{bits}")
    if photometric not in (0, 1):
        raise ValueError(f"{name}: unsupported_tiff_photometric:{photometric}")
    return Slab(name, 0, len(places), size, order, height, width, f"{order}u{bits // 8}", places=tuple(places), photometric=photometric)


# ---------------------------------------------------------------- planes


def mrc_plane(slab: Slab, read: Read, z: int) -> tuple[np.ndarray, str]:
    n = slab.height * slab.width * np.dtype(slab.kind).itemsize
    raw = read(slab.data + z * n, n)
    if len(raw) < n:
        raise ValueError(f"{slab.name}: mrc_payload_truncated")
    values, done = unsigned(np.frombuffer(raw, slab.kind).reshape(slab.height, slab.width))
    return (values.T if slab.swapped else values), done


def tiff_plane(slab: Slab, read: Read, z: int) -> tuple[np.ndarray, str]:
    try:
        tags = tiff_directory(read, slab.order, slab.places[z - slab.first])
    except (ValueError, struct.error) as e:
        raise ValueError(f"{slab.name}: {e}") from e
    one = lambda tag, default=0: (tags.get(tag) or [default])[0] or default
    item = np.dtype(slab.kind).itemsize
    if (one(WIDTH), one(HEIGHT), one(BITS, 8)) != (slab.width, slab.height, 8 * item):
        raise ValueError(f"{slab.name}: inconsistent_tiff_ifd_shape_or_dtype")
    if (tags.get(PHOTOMETRIC) or [1])[0] != slab.photometric:
        raise ValueError(f"{slab.name}: inconsistent_tiff_photometric")
    for tag, code in ((ORIENTATION, "orientation"), (COMPRESSION, "compression"), (SAMPLES, "samples")):
        if one(tag, 1) != 1:
            raise ValueError(f"{slab.name}: unsupported_tiff_{code}:{one(tag, 1)}")
    places, counts = tags.get(STRIPS, []), tags.get(STRIP_BYTES, [])
    if not places or len(places) != len(counts) or one(ROWS_PER_STRIP, slab.height) * len(places) < slab.height:
        raise ValueError(f"{slab.name}: invalid_tiff_strip_layout")
    need = slab.height * slab.width * item
    if sum(counts) < need or any(n <= 0 or at + n > slab.size for at, n in zip(places, counts, strict=True)):
        raise ValueError(f"{slab.name}: truncated_tiff_strip_payload")
    raw = b"".join(read(at, n) for at, n in zip(places, counts, strict=True))
    return unsigned(np.frombuffer(raw[:need], slab.kind).reshape(slab.height, slab.width), slab.photometric == 0)


class PlaneReader(DataSourceReader):
    def __init__(self, path: str, slab: int):
        self.path, self.slab = path, slab
        self.low, self.high = 0, 1 << 62  # planes that are asked for

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the plane leave out slabs; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) and f.attribute == ("plane",) and isinstance(f.value, int):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual) and f.attribute == ("plane",) and isinstance(f.value, int):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            yield f

    def _file(self, name: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        return store.open_input_file(f"{root}/{name}")

    def _headers(self, name: str) -> Slab:
        with self._file(name) as f:
            size = f.size()
            read = lambda at, n: f.read_at(min(n, max(0, size - at)), min(at, size))
            return (mrc_slab if name.lower().endswith(MRC_NAMES) else tiff_slab)(name, read, size)

    def partitions(self) -> list[Slabs]:
        from concurrent.futures import ThreadPoolExecutor

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        sizes = dict(sorted((i.path[len(root.rstrip("/")) + 1 :], i.size) for i in found if i.is_file and i.path.lower().endswith(MRC_NAMES + TIFF_NAMES)))
        share = sum(sizes.values()) / PARTITIONS if len(sizes) > PARTITIONS else -1
        divided = [n for n, size in sizes.items() if size > share]  # fewer than PARTITIONS, or all of few files
        with ThreadPoolExecutor(16) as pool:
            headers = dict(zip(divided, pool.map(self._headers, divided), strict=True))
        out, costs = [], []
        for name, size in sizes.items():
            if name not in headers:
                out.append(Slab(name, 0, 0, size))
                costs.append(size + FILE_COST)
                continue
            w = headers[name]
            for z in range(0, w.last, self.slab):
                last = min(z + self.slab, w.last)
                if z < self.high and last > self.low:
                    out.append(Slab(**(w.__dict__ | {"first": z, "last": last, "places": w.places[z:last]})))
                    costs.append(size * (last - z) / w.last + FILE_COST)
        return dealt(out, costs)

    def _planes(self, slab: Slab) -> Iterator[tuple]:
        s = slab if slab.kind else self._headers(slab.name)
        one = mrc_plane if s.name.lower().endswith(MRC_NAMES) else tiff_plane
        with self._file(s.name) as f:
            read = lambda at, n: f.read_at(min(n, max(0, s.size - at)), min(at, s.size))
            for z in range(max(s.first, self.low), min(s.last, self.high)):
                values, done = one(s, read, z)
                kind = values.dtype.str if values.itemsize > 1 else "|" + values.dtype.str[1:]
                yield (s.name, z, *values.shape, kind, done, np.ascontiguousarray(values).tobytes())

    def read(self, partition: Slabs | None) -> Iterator[pa.RecordBatch]:
        """Batches of about BATCH_BYTES, or of one plane that has more."""
        if not isinstance(partition, Slabs):  # what Spark gives where there are no partitions
            return
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = [c.split()[0] for c in PLANES.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        rows, size = [], 0
        for slab in partition.slabs:
            for row in self._planes(slab):
                if rows and (size + len(row[-1]) > BATCH_BYTES or len(rows) >= BATCH_ROWS):
                    yield batch(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield batch(rows)


class VolumePlanes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_planes"

    def schema(self) -> str:
        return PLANES

    def reader(self, schema) -> PlaneReader:
        slab = int(self.options.get("slab", 32))
        if slab < 1 or "path" not in self.options:
            raise ValueError("volume_planes needs a path, and a positive number of planes a slab")
        return PlaneReader(self.options["path"].rstrip("/"), slab)


def planes(spark: SparkSession, path: str, slab: int = 32) -> DataFrame:
    """The planes of the volume files below path, `slab` planes a partition. Lets the session push filters to Python sources, so that filters on plane leave out slabs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumePlanes)
    return spark.read.format("volume_planes").option("path", path).option("slab", slab).load()


# ---------------------------------------------------------------- files


def mrc_bytes(values: np.ndarray, order: str = "<", axes: tuple[int, int, int] = (1, 2, 3), extended: int = 0) -> bytes:
    """An MRC file of (sections, rows, columns) of int8, int16, uint16 or float32 values."""
    modes = {v: k for k, v in MRC_TYPES.items()}
    head = bytearray(1024)
    struct.pack_into(order + "4i", head, 0, *values.shape[::-1], modes[values.dtype.str[1:]])
    struct.pack_into(order + "3i", head, 64, *axes)
    struct.pack_into(order + "i", head, 92, extended)
    head[208:212], head[212:214] = b"MAP ", (b"\x11\x11" if order == ">" else b"\x44\x44")
    return bytes(head) + bytes(extended) + values.astype(values.dtype.newbyteorder(order)).tobytes()


def tiff_bytes(values: np.ndarray, order: str = "<", rows_per_strip: int = 0, photometric: int = 1, extra: dict[int, int] | None = None) -> bytes:
    """A classic TIFF of (planes, rows, columns) of uint8 or uint16 values in uncompressed strips; of `extra` tags the values are short."""
    depth, height, width = values.shape
    rows = rows_per_strip or height
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for plane in values.astype(values.dtype.newbyteorder(order)):
        strips = [plane[y : y + rows].tobytes() for y in range(0, height, rows)]
        places = [len(out) + sum(map(len, strips[:i])) for i in range(len(strips))]
        out += b"".join(strips) + bytes(sum(map(len, strips)) % 2)
        tags = {WIDTH: width, HEIGHT: height, BITS: 8 * values.itemsize, COMPRESSION: 1, PHOTOMETRIC: photometric, SAMPLES: 1, ROWS_PER_STRIP: rows} | (extra or {})
        far = len(out)
        if len(strips) > 1:
            out += struct.pack(f"{order}{2 * len(strips)}I", *places, *map(len, strips))
        lists = {STRIPS: (far, places), STRIP_BYTES: (far + 4 * len(strips), [len(s) for s in strips])}
        entries = [(t, struct.pack(order + "HHIHH", t, 3, 1, v, 0)) for t, v in tags.items()]
        entries += [(t, struct.pack(order + "HHII", t, 4, len(v), at if len(v) > 1 else v[0])) for t, (at, v) in lists.items()]
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(e for _, e in sorted(entries))
        link = len(out)
        out += bytes(4)
    return bytes(out)


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Files (relative_path, content) below path, in a store that all executors reach; name and length of each. A file is moved into place when it is whole."""
    import uuid

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for name, content in zip(b["relative_path"], b["content"], strict=True):
                folder, _, last = f"{root}/{name}".rpartition("/")
                store.create_dir(folder, recursive=True)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{folder}/{last}")
            yield pd.DataFrame({"relative_path": b["relative_path"], "length": [len(c) for c in b["content"]]})

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string, length long")
