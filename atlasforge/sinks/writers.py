"""Sinks (K1-K16): exports, refreshes, staged publication, chunk stores, slice images, reports."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import escape_formula
from ..scratch import remove, scratch_path


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """K1, K4, K8: header and rows; every text is kept from running as a formula."""
    safe = [escape_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*safe).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """K2, K8: one object a line, nulls left out."""
    rows.write.mode("overwrite").json(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """K3: one text column."""
    rows.select(column).write.mode("overwrite").text(path)


def refresh(rows: DataFrame, path: str) -> None:
    """K6: replace a table. The new files are complete before the old ones go."""
    staged = scratch_path(rows.sparkSession, "refresh")
    rows.write.parquet(staged)
    publish(rows.sparkSession, {staged: path})


def publish(spark: SparkSession, moves: dict[str, str]) -> None:
    """K7: move finished folders into place, one rename each, after all have been written; nothing moves if one is missing. What must be seen together goes through runs.publish_all()."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = {jvm.org.apache.hadoop.fs.Path(a): jvm.org.apache.hadoop.fs.Path(b) for a, b in moves.items()}
    for a in paths:
        if not a.getFileSystem(conf).exists(a):
            raise FileNotFoundError(str(a))
    for a, b in paths.items():
        fs = b.getFileSystem(conf)
        fs.mkdirs(b.getParent())
        old = jvm.org.apache.hadoop.fs.Path(str(b) + ".replaced")
        if fs.exists(b):
            fs.rename(b, old)
        if not fs.rename(a, b):
            if fs.exists(old):
                fs.rename(old, b)
            raise OSError(f"could not publish {b}")
        fs.delete(old, True)


# ---------------------------------------------------------------- chunk stores


def array_metadata(shape: tuple[int, ...], chunks: tuple[int, ...], dtype: str, scale_nm: tuple[float, float, float]) -> dict[str, str]:
    """K9: the metadata files of a version-2 chunk store with a multiscale description."""
    axes = [{"name": a, "type": "space", "unit": "nanometer"} for a in "zyx"]
    multi = {"multiscales": [{"version": "0.4", "axes": axes, "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": list(scale_nm)}]}]}]}
    array = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "compressor": None, "fill_value": 0, "filters": None, "order": "C"}
    return {".zgroup": json.dumps({"zarr_format": 2}), ".zattrs": json.dumps(multi), "0/.zarray": json.dumps(array)}


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk rows to a table, partitioned by slab, with each chunk's SHA-256. Only chunks whose digest is not there yet are appended."""
    spark = chunks.sparkSession
    rows = chunks.withColumn("sha256", F.sha2("raw", 256)).withColumn("name", F.concat_ws(".", "cz", "cy", "cx"))
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        rows = rows.join(spark.read.parquet(path).select("name", "sha256"), ["name", "sha256"], "left_anti")
    rows.write.mode("append").partitionBy("cz").parquet(path)


def write_chunk_files(chunks: DataFrame, path: str) -> DataFrame:
    """Each chunk as the file 0/z.y.x below path, in a store that all executors reach (a local path or a URI); name, length and SHA-256 of the written ones.

    A file is written under another name and moved, so a task that is tried again leaves whole files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(f"{root}/0", recursive=True)
        for b in batches:
            out = []
            for c in b.itertuples(index=False):
                name = f"{c.cz}.{c.cy}.{c.cx}"
                part = f"{root}/0/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(c.raw)
                store.move(part, f"{root}/0/{name}")
                out.append((name, len(c.raw), hashlib.sha256(c.raw).hexdigest()))
            yield pd.DataFrame(out, columns=["name", "length", "sha256"])

    return chunks.select("cz", "cy", "cx", "raw").mapInPandas(run, "name string, length long, sha256 string")


JOURNAL = "name string, length long, sha256 string"


def journal_rows(spark: SparkSession, journal: str) -> DataFrame:
    """The chunks that runs have recorded as written; none before the first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(journal)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return (spark.read.schema(JOURNAL).parquet(journal) if there else spark.createDataFrame([], JOURNAL)).distinct()


def kept_chunks(journal: DataFrame, path: str) -> DataFrame:
    """Names of the recorded chunks whose files below path still have the recorded length and SHA-256. Files are read and hashed in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            same = []
            for name, length, digest in zip(b["name"], b["length"], b["sha256"], strict=True):
                info = store.get_file_info(f"{root}/0/{name}")
                if info.is_file and info.size == length:
                    state = hashlib.sha256()
                    with store.open_input_stream(f"{root}/0/{name}") as f:
                        while part := f.read(8 << 20):
                            state.update(part)
                    if state.hexdigest() == digest:
                        same.append(name)
            yield pd.DataFrame({"name": same})

    return journal.select("name", "length", "sha256").mapInPandas(run, "name string").distinct()


def resume_chunks(chunks: DataFrame, grid: DataFrame, path: str, journal: str, item_bytes: int) -> DataFrame:
    """Write the chunks of the grid that are not recorded, or whose files no longer are what was recorded; the grid's chunks that are still not there.

    Each run appends what it wrote to the journal, in the same job, so a run that was cut short goes on with the rest. A recorded chunk
    of another size than the grid's counts as missing.
    """
    spark = chunks.sparkSession
    sized = lambda: grid.join(journal_rows(spark, journal).where("length is not null"), "name").where(F.col("length") == F.col("voxels") * item_bytes)
    todo = grid.select("name").join(kept_chunks(sized(), path), "name", "left_anti")
    named = chunks.withColumn("name", F.concat_ws(".", "cz", "cy", "cx"))
    write_chunk_files(named.join(todo, "name", "left_semi"), path).write.mode("append").parquet(journal)
    return grid.select("name").join(kept_chunks(sized(), path), "name", "left_anti")


def stored_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and length of the chunk files below path, listed on the driver as any file index is; none where the folder is not there."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/0", allow_not_found=True))
    rows = [(f.base_name, f.size) for f in found if f.is_file and not f.base_name.startswith(".")]
    return spark.createDataFrame(rows, "name string, length long")


def convert_asset(chunks: DataFrame, gate: str, digest: str, expected: str, shape: tuple[int, int, int], sizes: tuple[int, int, int], dtype: str, scale_nm: tuple[float, float, float], path: str) -> str:
    """V9: a volume as a chunk store: gate, digest, recipe, resumed chunks, validation and publication; the recipe's id.

    The recipe is a digest of the source and the layout; its staging folder and the journal of its chunks lie beside path, and a second run writes
    only what is missing or is not what the journal says. Nothing is published unless every chunk is there as recorded. A store of the same recipe is left as it is.
    """
    if gate != "ready":
        raise ValueError(f"the asset cannot be converted: {gate}")
    if digest != expected:
        raise ValueError("the source is not the registered one")
    from pyarrow import fs

    from ..operators.volume import chunk_grid

    spark = chunks.sparkSession
    recipe = hashlib.sha256(json.dumps({"source": digest, "shape": shape, "chunks": sizes, "dtype": dtype, "scale_nm": scale_nm}, sort_keys=True).encode()).hexdigest()[:16]
    store, root = fs.FileSystem.from_uri(path)
    stage = f"{path.rstrip('/')}.stage-{recipe}"
    marker = f"{root}/recipe.json"
    if store.get_file_info(marker).is_file:
        with store.open_input_stream(marker) as f:
            if json.loads(f.read())["recipe"] == recipe:
                return recipe
        raise ValueError("another recipe is published there")
    grid = chunk_grid(spark, shape, sizes)
    item = np.dtype(dtype).itemsize
    journal = f"{path.rstrip('/')}.journal-{recipe}"
    if resume_chunks(chunks, grid, stage, journal, item).limit(1).count():
        raise ValueError("chunks are missing after the conversion")
    _, staged = fs.FileSystem.from_uri(stage)
    for name, text in (array_metadata(shape, sizes, dtype, scale_nm) | {"recipe.json": json.dumps({"recipe": recipe})}).items():
        with store.open_output_stream(f"{staged}/{name}") as f:
            f.write(text.encode())
    store.move(staged, root)
    remove(spark, journal)
    return recipe


def load_chunks(spark: SparkSession, path: str, cz: int | None = None) -> DataFrame:
    """The stored chunks; a slab is one partition folder."""
    rows = spark.read.parquet(path)
    return rows if cz is None else rows.where(F.col("cz") == cz)


# ---------------------------------------------------------------- images


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG without filters."""
    h, w = gray.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((h, w + 1), dtype=np.uint8)
    lines[:, 1:] = gray
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def shrink(plane: np.ndarray, max_width: int, max_height: int) -> np.ndarray:
    """Nearest neighbour by floor index, to fit; never enlarged."""
    h, w = plane.shape
    ratio = min(1.0, max_width / w, max_height / h)
    nh, nw = max(1, int(h * ratio)), max(1, int(w * ratio))
    return plane[(np.arange(nh) * h // nh)[:, None], (np.arange(nw) * w // nw)[None, :]]


def stretch(plane: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """Percentile stretch to 0-255, truncated; not finite is 0; falls back to the extremes and then to 0."""
    values = plane.astype(np.float64)
    finite = values[np.isfinite(values)]
    if not len(finite):
        return np.zeros(plane.shape, dtype=np.uint8)
    lo, hi = np.percentile(finite, [low, high])
    if hi <= lo:
        lo, hi = finite.min(), finite.max()
    if hi <= lo:
        return np.zeros(plane.shape, dtype=np.uint8)
    out = np.clip((np.where(np.isfinite(values), values, lo) - lo) / (hi - lo), 0, 1) * 255
    return np.where(np.isfinite(values), out, 0).astype(np.uint8)


def slice_images(chunks: DataFrame, max_width: int = 512, max_height: int = 512) -> DataFrame:
    """A PNG for each chunk plane (cz, png)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c in b.itertuples(index=False):
                plane = np.frombuffer(c.raw, dtype="<f4").reshape(c.z1 - c.z0, c.x1 - c.x0)
                out.append((c.cz, png(shrink(stretch(plane), max_width, max_height))))
            yield pd.DataFrame(out, columns=["cz", "png"])

    return chunks.mapInPandas(run, "cz int, png binary")


# ---------------------------------------------------------------- reports and documents


def measurement_rows(m: DataFrame) -> DataFrame:
    """Measurements with 1-based voxels and distances to 6 decimals."""
    one = lambda c: (F.col(c) + 1).alias(c)
    return m.select("label", *[one(c) for c in ("x1", "y1", "z1", "x2", "y2", "z2")], F.format_string("%.6f", "distance_um").alias("distance_um"))


def handoff_document(fields: list[str]) -> Column:
    """One JSON document of the given fields and a schema name."""
    return F.to_json(F.struct(F.lit("catalog-handoff").alias("schema"), F.lit(1).alias("schema_version"), *fields))


def markdown_report(title: str, counters: DataFrame, assets: DataFrame, most: int = 25) -> str:
    """A summary table and the first assets as Markdown. Collects the counters (a few rows) and `most` assets."""
    lines = [f"# {title}", "", "| name | count |", "|-|-|"]
    lines += [f"| {r['name']} | {r['n']} |" for r in counters.orderBy("name").limit(200).collect()]
    lines += ["", "## Assets", ""]
    lines += [f"* `{r.relative_path}` ({r.readiness})" for r in assets.orderBy("relative_path").limit(most).collect()]
    return "\n".join(lines) + "\n"

