"""Volume arrays (V1-V11, A28-A31, X37, K10, S18): chunks are rows, voxels of small grids are rows of (row, position, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.volumes import tiff_directories
from .catalog import values_at_ranks

CHUNKS = "cz int, cy int, cx int, z0 int, y0 int, x0 int, z1 int, y1 int, x1 int, raw binary"


def chunk_grid(spark: SparkSession, shape: tuple[int, int, int], chunks: tuple[int, int, int]) -> DataFrame:
    """V1: one row per chunk with its half-open bounds; edge chunks are truncated."""
    grid = spark.range(1)
    for axis, n, c in zip("zyx", shape, chunks, strict=True):
        grid = grid.withColumn(f"c{axis}", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // c))))
    for axis, n, c in zip("zyx", shape, chunks, strict=True):
        grid = grid.withColumn(f"{axis}0", F.col(f"c{axis}") * c).withColumn(f"{axis}1", F.least(F.col(f"c{axis}") * c + c, F.lit(n)))
    name = F.concat_ws(".", "cz", "cy", "cx")
    return grid.drop("id").withColumn("name", name).withColumn("voxels", ((F.col("z1") - F.col("z0")) * (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).cast("bigint"))


def axis_slice(voxels: DataFrame, axis: str, index: int) -> DataFrame:
    """V2 on voxel rows: one row or one position."""
    return voxels.where(F.col(axis) == index)


def downsample(voxels: DataFrame, step: int = 4) -> DataFrame:
    """V3: every step-th voxel of the global grid in both directions."""
    if step < 1:
        raise ValueError("the step must be positive")
    kept = voxels.where((F.col("row") % step == 0) & (F.col("position") % step == 0))
    return kept.select((F.col("row") / step).cast("bigint").alias("row"), (F.col("position") / step).cast("int").alias("position"), "value")


SAMPLE = 10_000  # voxels of a chunk that a histogram takes at least, if it has as many


def chunk_histogram(chunks: DataFrame, dtype: str = "|u1") -> DataFrame:
    """Counts in 256 bins of every step-th voxel of each chunk, the step being its number of voxels over SAMPLE (1 at least).

    8-bit values are their own bins; 16-bit ones are scaled by 255 / 65535. Each chunk gives one partial row for each bin that it meets.
    """
    if dtype not in ("|u1", "<u2"):
        raise ValueError(f"no histogram of {dtype!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["raw"]:
                a = np.frombuffer(raw, dtype)
                a = a[:: max(1, len(a) // SAMPLE)]
                bins = a if dtype == "|u1" else np.minimum(255, np.floor(a / 65535 * 255)).astype(np.int64)
                counts = np.bincount(bins, minlength=256)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"bin": at.astype(np.int32), "n": counts[at]})

    return chunks.select("raw").mapInPandas(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def histogram(voxels: DataFrame, lo: float, hi: float, bins: int = 256) -> DataFrame:
    """Counts by bin of the clamped values of all voxels."""
    scaled = F.floor((F.col("value") - lo) / (hi - lo) * bins).cast("int")
    return voxels.groupBy(F.least(F.greatest(scaled, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def histogram_stats(hist: DataFrame) -> DataFrame:
    """Total, first peak bin and the bin that holds the middle count. The histogram has a row per bin at most."""
    upto = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy())
    rows = hist.withColumn("upto", upto).withColumn("total", total)
    return rows.agg(F.max("total").alias("total"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("peak_bin"), F.min(F.when(F.col("upto") >= F.col("total") / 2, F.col("bin"))).alias("median_bin"))


def percentiles(voxels: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """One row of linear percentiles of the finite values, exact, from the values at the ranks on both sides, with the least and the greatest value."""
    finite = voxels.where(~F.isnan("value") & (F.abs("value") < float("inf"))).withColumn("_all", F.lit(0))
    at = {k: (F.col("n") - 1) * q for k, q in wanted.items()}
    ranks = {f"{k}_{side}": (wanted[k], f(p) + 1) for k, p in at.items() for side, f in (("below", F.floor), ("above", F.ceil))}
    ends = values_at_ranks(finite, "_all", "value", ranks).crossJoin(F.broadcast(finite.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))))  # one row each
    return ends.select("least", "most", *[(F.col(f"{k}_below") + (p - F.floor(p)) * (F.col(f"{k}_above") - F.col(f"{k}_below"))).alias(k) for k, p in at.items()])


def percentile_stretch(voxels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values between two percentiles stretched to 0-255, truncated; between the extremes where these percentiles are equal, and all 0 where they are too. NaN is 0."""
    wide = F.col("hi") > F.col("lo")
    ends = percentiles(voxels, {"lo": low, "hi": high}).select(F.when(wide, F.col("lo")).otherwise(F.col("least")).alias("lo"), F.when(wide, F.col("hi")).otherwise(F.col("most")).alias("hi"))
    scaled = F.floor(F.least(F.greatest((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return voxels.crossJoin(F.broadcast(ends)).select("row", "position", F.when((F.col("hi") > F.col("lo")) & ~F.isnan("value"), scaled).otherwise(0).alias("u8"))  # one row of percentiles


def threshold(value: Column, op: str, level: float) -> Column:
    """V4: 1 where the comparison holds, else 0."""
    tests = {"ge": value >= level, "gt": value > level, "le": value <= level, "lt": value < level}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return tests[op].cast("int")


def confusion(rows: DataFrame, prediction: Column, truth: Column) -> DataFrame:
    """Counts and rates of binary labels; a rate without a denominator is null."""
    p, t = prediction == 1, truth == 1
    c = rows.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    rate = lambda num, den: F.try_divide(num.cast("double"), den.cast("double"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn", rate(2 * tp, 2 * tp + fp + fn).alias("dice"), rate(tp, tp + fp + fn).alias("iou"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
        rate(tn, tn + fp).alias("specificity"), rate(fp, fp + tn).alias("false_positive_rate"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def acceptance(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """V7: not_configured without limits; else passed when every named rate is at least its limit."""
    if not limits:
        return metrics.withColumn("acceptance", F.lit("not_configured"))
    ok = F.lit(True)
    for name, least in limits.items():
        ok = ok & F.coalesce(F.col(name) >= least, F.lit(False))
    return metrics.withColumn("acceptance", F.when(ok, "passed").otherwise("failed"))


def label_box(labels: DataFrame) -> DataFrame:
    """Number and share of foreground voxels and their inclusive bounding box."""
    on = F.col("label01") == 1
    edge = lambda f, c: f(F.when(on, F.col(c)))
    return labels.agg(
        F.count_if(on).alias("foreground"), F.round(F.count_if(on) / F.count("*"), 6).alias("fraction"),
        edge(F.min, "row").alias("row_min"), edge(F.max, "row").alias("row_max"), edge(F.min, "position").alias("position_min"), edge(F.max, "position").alias("position_max"),
    )


# ---------------------------------------------------------------- binary chunks


def to_chunks(voxels: DataFrame, chunk_rows: int, width: int, dtype: str = "<f4") -> DataFrame:
    """Chunk table of a (rows x width) grid: one binary payload for chunk_rows rows; edge chunks are truncated.

    Voxels come to a task in their order, so it holds one Arrow batch of them, the chunk that is open and about a megabyte of finished ones.
    """
    key = F.floor(F.col("row") / chunk_rows).cast("int").alias("cz")
    order = [F.asc_nulls_last(c) for c in ("row", "position", "value")]
    ordered = voxels.select(key, "row", "position", "value").repartition("cz").sortWithinPartitions("cz", *order).select("cz", "value")
    names, ints = [c.split()[0] for c in CHUNKS.split(", ")], pa.int32()

    def rows_of(done: list[tuple[int, bytes]]) -> pa.RecordBatch:
        cz = np.array([c for c, _ in done], np.int32)
        n = np.array([len(raw) // np.dtype(dtype).itemsize // width for _, raw in done], np.int32)
        none = np.zeros(len(done), np.int32)
        columns = (cz, none, none, cz * chunk_rows, none, none, cz * chunk_rows + n, none + 1, none + width)
        return pa.RecordBatch.from_arrays([*[pa.array(c, ints) for c in columns], pa.array([raw for _, raw in done], pa.binary())], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, done, size = None, bytearray(), [], 0
        for b in batches:
            if b.num_rows == 0:
                continue
            if b.column(0).null_count or (b.column(1).null_count and np.dtype(dtype).kind != "f"):
                raise ValueError("a voxel without a row, or without a value of a whole type")
            keys, values = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(dtype)
            ends = [*(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for start, end in zip([0, *ends], ends, strict=False):
                if now is not None and keys[start] != now:
                    done.append((now, bytes(raw)))
                    raw, size = bytearray(), size + len(raw)
                    if size >= 1 << 20:
                        yield rows_of(done)
                        done, size = [], 0
                now = int(keys[start])
                raw += values[start:end].tobytes()
        if now is not None:
            yield rows_of([*done, (now, bytes(raw))])

    return ordered.mapInArrow(pack, CHUNKS)


def chunk_values(chunks: DataFrame) -> DataFrame:
    """Voxel rows of a chunk table, with global offsets."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b.itertuples(index=False):
                shape = (c.z1 - c.z0, c.x1 - c.x0)
                a = np.frombuffer(c.raw, dtype="<f4").reshape(shape)
                r, p = np.indices(shape)
                yield pd.DataFrame({"row": (r + c.z0).reshape(-1), "position": (p + c.x0).reshape(-1), "value": a.reshape(-1).astype(float)})

    return chunks.mapInPandas(unpack, "row long, position int, value double")


def threshold_chunks(chunks: DataFrame, op: str, level: float) -> DataFrame:
    """V4 on chunks: float payloads to uint8 labels of the same shape."""
    compare = {"ge": np.greater_equal, "gt": np.greater, "le": np.less_equal, "lt": np.less}[op]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(raw=[compare(np.frombuffer(r, dtype="<f4"), level).astype(np.uint8).tobytes() for r in b.raw])

    return chunks.mapInPandas(run, CHUNKS)


def evaluate_chunks(prediction: DataFrame, truth: DataFrame) -> DataFrame:
    """Positional comparison of equal grids of uint8 labels; each chunk gives four partial counts."""
    keys = ["cz", "cy", "cx"]
    both = prediction.select(*keys, F.col("raw").alias("p")).join(truth.select(*keys, F.col("raw").alias("t")), keys, "full_outer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, t in zip(b.p, b.t, strict=True):
                if p is None or t is None or len(p) != len(t):
                    raise ValueError("the grids differ")
                x, y = np.frombuffer(p, np.uint8) == 1, np.frombuffer(t, np.uint8) == 1
                out.append(tuple(int(v.sum()) for v in (x & y, x & ~y, ~x & y, ~x & ~y)))
            yield pd.DataFrame(out, columns=["tp", "fp", "fn", "tn"])

    return both.mapInPandas(run, "tp long, fp long, fn long, tn long").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def reversible(values: np.ndarray, kind: str) -> np.ndarray:
    """V8: int8 to uint8, int16 to uint16, white-is-zero inversion; applying the rule to its result gives the input again."""
    if kind == "int8":
        return values.view(np.uint8) ^ np.uint8(0x80)
    if kind == "int16":
        return values.view(np.uint16) ^ np.uint16(0x8000)
    if kind == "inverted":
        return np.iinfo(values.dtype).max - values
    raise ValueError(f"unknown transform {kind!r}")


def missing_chunks(grid: DataFrame, stored: DataFrame, item_bytes: int) -> DataFrame:
    """Chunks that are absent or of the wrong size (stored: name, length), to be written again."""
    have = stored.select("name", "length")
    return grid.join(have, "name", "left").where("length is null or length <> voxels * " + str(int(item_bytes))).select("name", "voxels", "length")


# ---------------------------------------------------------------- 3-D chunk operators


def _cells(c) -> np.ndarray:
    return np.frombuffer(c.raw, dtype=np.uint8).reshape(c.z1 - c.z0, c.y1 - c.y0, c.x1 - c.x0)


def slice_plane(chunks: DataFrame, axis: str, index: int) -> DataFrame:
    """The voxels (u, v, value) of an orthogonal plane of uint8 chunks: z gives (y, x), y gives (z, x), x gives (z, y).

    Only chunks that meet the plane are read; absent chunks give no rows, which readers take as zeros.
    """
    across = {"z": "yx", "y": "zx", "x": "zy"}[axis]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b.itertuples(index=False):
                plane = _cells(c).take(index - getattr(c, f"{axis}0"), axis="zyx".index(axis))
                u, v = np.indices(plane.shape)
                yield pd.DataFrame({"u": (u + getattr(c, f"{across[0]}0")).reshape(-1), "v": (v + getattr(c, f"{across[1]}0")).reshape(-1), "value": plane.reshape(-1).astype(np.int32)})

    return chunks.where((F.col(f"{axis}0") <= index) & (F.col(f"{axis}1") > index)).mapInPandas(run, "u long, v long, value int")


def stride(chunks: DataFrame, step: int = 4) -> DataFrame:
    """V3: every step-th voxel of the global grid in three directions as (z, y, x, value); chunks without one are not decoded."""
    if step < 1:
        raise ValueError("the step must be positive")
    meets = F.lit(True)
    for a in "zyx":
        meets = meets & (F.ceil(F.col(f"{a}0") / step) * step < F.col(f"{a}1"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b.itertuples(index=False):
                at = [-c.z0 % step, -c.y0 % step, -c.x0 % step]
                sub = _cells(c)[at[0] :: step, at[1] :: step, at[2] :: step]
                z, y, x = np.indices(sub.shape)
                yield pd.DataFrame({"z": (z + (c.z0 + at[0]) // step).reshape(-1), "y": (y + (c.y0 + at[1]) // step).reshape(-1), "x": (x + (c.x0 + at[2]) // step).reshape(-1), "value": sub.reshape(-1).astype(np.int32)})

    return chunks.where(meets).mapInPandas(run, "z long, y long, x long, value int")


def label_report(chunks: DataFrame) -> DataFrame:
    """Are all values 0 or 1 and all payloads of their chunk's size; foreground and inclusive box. Each chunk gives one partial row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c in b.itertuples(index=False):
                n = (c.z1 - c.z0) * (c.y1 - c.y0) * (c.x1 - c.x0)
                if len(c.raw) != n:
                    out.append((False, True, n, 0, *(None,) * 6))
                    continue
                a = _cells(c)
                where = np.argwhere(a == 1)
                box = (None,) * 6 if not len(where) else tuple(int(v) for v in (*(where.min(0) + [c.z0, c.y0, c.x0]), *(where.max(0) + [c.z0, c.y0, c.x0])))
                out.append((True, bool((a <= 1).all()), n, len(where), *box))
            yield pd.DataFrame(out, columns=names).astype(dict.fromkeys(names[4:], "Int64"))

    names = ["sized", "binary", "voxels", "foreground", "z_min", "y_min", "x_min", "z_max", "y_max", "x_max"]
    schema = "sized boolean, binary boolean, " + ", ".join(f"{n} long" for n in names[2:])
    ends = [F.min(c).alias(c) for c in names[4:7]] + [F.max(c).alias(c) for c in names[7:]]
    out = chunks.mapInPandas(run, schema).agg(F.bool_and("sized").alias("sized"), F.bool_and("binary").alias("binary"), F.sum("voxels").alias("voxels"), F.sum("foreground").alias("foreground"), *ends)
    valid = F.col("sized") & F.col("binary") & (F.col("foreground") > 0) & (F.col("foreground") < F.col("voxels"))
    return out.withColumn("usable", valid)


def probe(chunks: DataFrame, z: int, y: int, x: int, scale_nm: tuple[float, float, float]) -> DataFrame:
    """The value of one voxel and its place in micrometres."""
    inside = F.lit(True)
    for a, v in zip("zyx", (z, y, x), strict=True):
        inside = inside & (F.col(f"{a}0") <= v) & (F.col(f"{a}1") > v)
    at = ((z - F.col("z0")) * (F.col("y1") - F.col("y0")) + (y - F.col("y0"))) * (F.col("x1") - F.col("x0")) + (x - F.col("x0"))
    value = F.conv(F.hex(F.substring("raw", at + 1, F.lit(1))), 16, 10).cast("int")
    place = [F.lit(v * s / 1000).alias(f"{a}_um") for a, v, s in zip("zyx", (z, y, x), scale_nm, strict=True)]
    return chunks.where(inside).select(value.alias("value"), *place)


def read_planes(files: DataFrame, width: int, height: int, item: str, offset: int = 1024) -> DataFrame:
    """Planes (relative_path, plane, raw) of contiguous volume files with a fixed-size header; truncated files raise."""
    size = np.dtype(item).itemsize * width * height

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["relative_path"], b["content"], strict=True):
                n, rest = divmod(len(c) - offset, size)
                if rest or n < 1:
                    raise ValueError(f"{p} is truncated")
                for z in range(n):
                    yield pd.DataFrame({"relative_path": [p], "plane": [z], "raw": [bytes(c[offset + z * size : offset + (z + 1) * size])]})

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string, plane long, raw binary")


def tiff_planes(files: DataFrame) -> DataFrame:
    """Planes (relative_path, plane, height, width, dtype, raw) of classic TIFF files with uncompressed strips of one channel, one directory to a plane, in directory order.

    Values come in little-endian order whatever the file's. Compressed, tiled or cut files raise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["relative_path"], b["content"], strict=True):
                data = bytes(c)
                for z, page in enumerate(tiff_directories(data)):
                    yield pd.DataFrame([(p, z, *_tiff_plane(p, data, page))], columns=["relative_path", "plane", "height", "width", "dtype", "raw"])

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string, plane long, height long, width long, dtype string, raw binary")


# Fixed values of the TIFF format: tags of compression, strip offsets, samples of a pixel, and strip byte counts.
COMPRESSION, STRIPS, SAMPLES, STRIP_BYTES = 259, 273, 277, 279


def _tiff_plane(path: str, data: bytes, page: dict[int, list]) -> tuple[int, int, str, bytes]:
    one = lambda tag, default: (page.get(tag) or [default])[0]
    width, height, bits, form = one(256, 0), one(257, 0), one(258, 1), one(339, 1)
    kind = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((form, bits))
    if one(COMPRESSION, 1) != 1 or one(SAMPLES, 1) != 1 or kind is None or not page.get(STRIPS):
        raise ValueError(f"{path}: only uncompressed strips of one channel can be read")
    raw = b"".join(data[a : a + n] for a, n in zip(page[STRIPS], page.get(STRIP_BYTES, [len(data)]), strict=True))
    item = np.dtype(kind).itemsize
    if len(raw) < width * height * item:
        raise ValueError(f"{path} is truncated")
    order = "<" if data[:2] == b"II" else ">"
    values = np.frombuffer(raw[: width * height * item], dtype=order + kind)
    return height, width, "<" + kind if item > 1 else "|" + kind, values.astype("<" + kind).tobytes()


def chunked(planes: DataFrame, shape: tuple[int, int, int], chunks: tuple[int, int, int], item_bytes: int) -> DataFrame:
    """Planes (plane, raw) of one volume as chunk rows: each plane is cut into tiles in its task, and a chunk gathers its own tiles alone."""
    depth, height, width = shape
    size_z, size_y, size_x = chunks

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for z, raw in zip(b["plane"], b["raw"], strict=True):
                a = np.frombuffer(raw, dtype=np.uint8).reshape(height, width * item_bytes)
                out = []
                for y in range(0, height, size_y):
                    for x in range(0, width, size_x):
                        tile = np.ascontiguousarray(a[y : y + size_y, x * item_bytes : (x + size_x) * item_bytes])
                        out.append((z // size_z, y // size_y, x // size_x, z, tile.tobytes()))
                yield pd.DataFrame(out, columns=["cz", "cy", "cx", "z", "tile"])

    tiles = planes.select("plane", "raw").mapInPandas(cut, "cz int, cy int, cx int, z long, tile binary")

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cz, cy, cx = key
        rows = rows.sort_values("z")
        ends = [min(n, (c + 1) * m) for c, m, n in zip(key, chunks, shape, strict=True)]
        if len(rows) != ends[0] - cz * size_z:
            raise ValueError(f"planes are missing or repeated in chunk {key}")
        return pd.DataFrame([(cz, cy, cx, cz * size_z, cy * size_y, cx * size_x, *ends, b"".join(rows["tile"]))], columns=[f.split()[0] for f in CHUNKS.split(", ")])

    return tiles.groupBy("cz", "cy", "cx").applyInPandas(join, CHUNKS)
