"""Volume file headers (S8-S14): bytes of binaryFile rows to typed columns, by Arrow batches; malformed files give a status, not an error."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import NANOMETRES, unit_nm

HEADER = "relative_path string, status string, format string, x long, y long, z long, dtype string, voxel_x_nm double, voxel_y_nm double, voxel_z_nm double"
_FIELDS = [f.split()[0] for f in HEADER.split(", ")]

# Fixed values of the TIFF format: bytes of each field type, and the tags that are read.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, DESCRIPTION, X_RES, Y_RES, RES_UNIT, SAMPLE_FORMAT = 256, 257, 258, 270, 282, 283, 296, 339
# Element type of each MRC mode.
MRC_MODES = {0: "int8", 1: "int16", 2: "float32", 4: "complex64", 6: "uint16"}
HDF5_MAGIC = b"\x89HDF\r\n\x1a\n"
MAX_DIRECTORIES = 100_000


Read = Callable[[int, int], bytes]


def tiff_directories(data: bytes, most: int = MAX_DIRECTORIES) -> list[dict[int, list]]:
    """Every image directory of a classic TIFF as tag -> values. A chain that leaves the file ends with the directories before; BigTIFF, loops and cut entries raise ValueError."""
    read = lambda at, n: data[at : at + n]
    order, places = tiff_chain(read, len(data), most)
    return [tiff_directory(read, order, at) for at in places]


def tiff_chain(read: Read, size: int, most: int = MAX_DIRECTORIES) -> tuple[str, list[int]]:
    """Byte order and places of a classic TIFF's directories, by ranges of the file: two short reads for each."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    magic, at = struct.unpack_from(order + "HI", head, 2)
    if magic != 42:
        raise ValueError("BigTIFF is not supported" if magic == 43 else "not a TIFF file")
    places: list[int] = []
    seen: set[int] = set()
    while at:
        if at in seen or len(places) >= most:
            raise ValueError("the directory chain does not end")
        seen.add(at)
        if at + 2 > size:
            break
        (n,) = struct.unpack(order + "H", read(at, 2))
        if at + 2 + 12 * n > size:
            raise ValueError("the file ends early")
        if at + 6 + 12 * n > size:
            break
        places.append(at)
        (at,) = struct.unpack(order + "I", read(at + 2 + 12 * n, 4))
    return order, places


def tiff_directory(read: Read, order: str, at: int) -> dict[int, list]:
    """Tags and values of the directory at a place."""
    (n,) = struct.unpack(order + "H", read(at, 2))
    block = read(at + 2, 12 * n)
    return dict(_entry(read, order, block[12 * i : 12 * i + 12]) for i in range(n))


def _entry(read: Read, order: str, entry: bytes) -> tuple[int, list]:
    tag, kind, count = struct.unpack_from(order + "HHI", entry)
    size = TYPE_BYTES.get(kind, 0) * count
    raw = entry[8 : 8 + size] if size <= 4 else read(struct.unpack_from(order + "I", entry, 8)[0], size)
    if len(raw) < size:
        raise ValueError("a value lies outside the file")
    if kind == 2:
        return tag, [raw.split(b"\0")[0].decode("latin-1")]
    if kind in (5, 10):
        v = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
        return tag, [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
    code = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
    return tag, list(struct.unpack(f"{order}{count}{code}", raw)) if code else []


def image_description(text: str) -> dict[str, str]:
    """key=value lines with lower-cased keys; lines without '=' are skipped and the last value of a key stays."""
    return {k.strip().lower(): v.strip() for k, sep, v in (line.partition("=") for line in text.splitlines()) if sep}


def tiff_header(data: bytes) -> tuple:
    """Size, type and scale of a TIFF: nanometres per unit over pixels per unit; z from the description's spacing."""
    pages = tiff_directories(data)
    if not pages:
        raise ValueError("no image in the file")
    first = pages[0]
    one = lambda tag, default=None: (first.get(tag) or [default])[0]
    about = image_description(one(DESCRIPTION, "") or "")
    bits, form = int(one(BITS, 1) or 1), int(one(SAMPLE_FORMAT, 1) or 1)
    dtype = {1: "uint", 2: "int", 3: "float"}.get(form, "uint") + str(bits)
    unit = about.get("unit") or {2: "inch", 3: "cm"}.get(int(one(RES_UNIT, 1) or 1))
    nm = NANOMETRES.get((unit or "").strip().lower().replace("\\u00b5", "µ"))
    per = lambda tag: nm / one(tag) if nm and one(tag) else None
    spacing = about.get("spacing")
    z = nm * float(spacing) if nm and spacing else None
    planes = int(about.get("slices") or about.get("images") or len(pages))
    return "readable", "TIFF", one(WIDTH), one(HEIGHT), planes, dtype, per(X_RES), per(Y_RES), z


def mrc_header(data: bytes) -> tuple:
    """Size, mode and voxel size (cell in angstroms over samples, in nm, for all axes or none) from the 1024-byte header of either byte order. Without a positive size the header is partial."""
    if len(data) < 1024:
        raise ValueError("the header is incomplete")
    order = "<" if 0 <= struct.unpack_from("<i", data, 12)[0] <= 16 else ">"
    nx, ny, nz, mode = struct.unpack_from(order + "4i", data, 0)
    sized = min(nx, ny, nz) > 0
    samples = struct.unpack_from(order + "3i", data, 28)
    cell = struct.unpack_from(order + "3f", data, 40)
    voxel = [c / m / 10 for c, m in zip(cell, samples, strict=True)] if min(samples) > 0 and min(cell) > 0 else [None] * 3
    return "readable" if sized else "partial", "MRC", *((nx, ny, nz) if sized else (None,) * 3), MRC_MODES.get(mode, f"mrc-mode-{mode}"), *voxel


def header(path: str, data: bytes) -> tuple:
    """The header of a file by its leading bytes and extension; (path, status, ...)."""
    nothing = (None,) * 7
    try:
        if data[:8] == HDF5_MAGIC:  # S12: the inner arrays are not read
            return (path, "detected", "HDF5", *nothing)
        if data[:2] in (b"II", b"MM"):
            return (path, *tiff_header(data))
        if path.lower().endswith((".mrc", ".rec", ".map")):
            return (path, *mrc_header(data))
    except (ValueError, struct.error) as e:
        return (path, "unreadable", str(e)[:80], *nothing)
    return (path, "unsupported", "", *nothing)


def headers(files: DataFrame) -> DataFrame:
    """Headers of (relative_path, content) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [header(p, bytes(c)) for p, c in zip(b["relative_path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=_FIELDS).astype({"x": "Int64", "y": "Int64", "z": "Int64"})

    return files.select("relative_path", "content").mapInPandas(run, HEADER)


def zarr_scale(arrays: DataFrame, attributes: DataFrame) -> DataFrame:
    """Each .zarray (relative_path, text) with the scale of the nearest ancestor .zattrs whose multiscales name it.

    Ancestors are exploded, so the join is on equality; the deepest match wins. Units become nanometres.
    """
    shape = "shape array<long>, chunks array<long>, dtype string"
    a = arrays.select(F.regexp_replace("relative_path", "/?\\.zarray$", "").alias("array_path"), F.from_json("text", shape).alias("j"))
    parts = F.split("array_path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("parent")))
    a = a.withColumn("u", F.explode(up)).select("array_path", "j", "u.depth", "u.parent")
    a = a.withColumn("inner", F.when(F.col("parent") == "", F.col("array_path")).otherwise(F.expr("substring(array_path, length(parent) + 2)")))
    spec = "multiscales array<struct<axes:array<struct<name:string,unit:string>>,datasets:array<struct<path:string,coordinateTransformations:array<struct<type:string,scale:array<double>>>>>>>"
    m = attributes.select(F.regexp_replace("relative_path", "/?\\.zattrs$", "").alias("parent"), F.explode(F.from_json("text", spec)["multiscales"]).alias("m"))
    m = m.select("parent", F.col("m.axes").alias("axes"), F.explode("m.datasets").alias("d"))
    scale = F.get(F.transform(F.filter("d.coordinateTransformations", lambda t: t["type"] == "scale"), lambda t: t["scale"]), F.lit(0))
    m = m.select("parent", "axes", F.col("d.path").alias("inner"), scale.alias("scale"))
    found = a.join(m, ["parent", "inner"]).groupBy("array_path").agg(F.max_by(F.struct("axes", "scale"), "depth").alias("s"))
    base = a.where("depth = 0").select("array_path", "j")
    out = base.join(found, "array_path", "left")
    nm = lambda i: F.get("s.scale", F.lit(i)) * unit_nm(F.get("s.axes", F.lit(i))["unit"])
    return out.select("array_path", "j.shape", "j.chunks", "j.dtype", nm(0).alias("z_nm"), nm(1).alias("y_nm"), nm(2).alias("x_nm"))


def trakem2_calibration(text: Column) -> Column:
    """struct(x, y, z, raw_z, layer_thickness, z_source, unit) in nm of a TrakEM2 text; null without a calibration of a known unit and three numbers.

    z is the pixel's depth; where the first layer's thickness is over 1 and the depth is that of a cube (within 5 % of both sides), it is so many depths.
    """
    attribute = lambda element, name: F.regexp_extract(element, f'(?:^|\\W){name}="([^"]*)"', 1)
    element = F.regexp_extract(text, r"(?is)<t2_calibration\b([^>]*)/>", 1)
    unit = attribute(element, "unit")
    x, y, z = (F.trim(attribute(element, f"pixel{name}")).try_cast("double") * unit_nm(unit) for name in ("Width", "Height", "Depth"))
    thick = F.trim(attribute(F.regexp_extract(text, r'(?is)<t2_layer\s+oid="[^"]+"([^>]*)>', 1), "thickness")).try_cast("double")
    close = lambda a, b: F.abs(a - b) <= 0.05 * F.greatest(F.abs(a), F.abs(b))
    layers = F.coalesce((thick > 1) & close(z, x) & close(z, y), F.lit(False))
    source = F.when(layers, "trakem2_calibration_times_layer_thickness").otherwise("trakem2_calibration")
    found = F.struct(x.alias("x"), y.alias("y"), F.when(layers, z * thick).otherwise(z).alias("z"), z.alias("raw_z"), thick.alias("layer_thickness"), source.alias("z_source"), unit.alias("unit"))
    return F.when((x + y + z).isNotNull(), found)


def array_report(arrays: DataFrame) -> DataFrame:
    """Required checks of a chunked array (columns shape, chunks, dtype): ready, warning or unsupported."""
    positive = lambda c: F.coalesce(F.forall(c, lambda v: v > 0), F.lit(False))
    checks = F.array(F.size("shape") == 3, F.size("chunks") == 3, positive(F.col("shape")), positive(F.col("chunks")), F.coalesce(F.col("dtype").isin("|u1", "<u2"), F.lit(False)))
    scaled = F.coalesce(F.col("z_nm") > 0, F.lit(False))
    ok = F.forall(checks, lambda c: F.coalesce(c, F.lit(False)))
    return arrays.withColumn("report", F.when(~ok, "unsupported").when(~scaled, "warning").otherwise("ready"))
