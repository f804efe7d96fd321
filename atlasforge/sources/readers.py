"""Record sources (S2-S7, S22-S23): explicit schemas, no inference, bad rows refused or set apart."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A header CSV with quoted line breaks, every column a string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def unique_headers(values: Iterable[object]) -> list[str]:
    """Blank headers become unnamed_i; the n-th repeat of a header gets _n."""
    seen: dict[str, int] = {}
    out = []
    for i, v in enumerate(values, start=1):
        name = " ".join(str(v if v is not None else "").replace(" ", " ").split()) or f"unnamed_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def excel_sheet(spark: SparkSession, path: str, sheet: str, header_row: int = 1, start_row: int | None = None) -> DataFrame:
    """S3: one worksheet (a small curated file, read on the driver) as cleaned strings; blank rows drop out. Needs openpyxl."""
    import pandas as pd

    raw = pd.read_excel(path, sheet_name=sheet, header=None, dtype=object)
    names = unique_headers([None if pd.isna(v) else v for v in raw.iloc[header_row - 1]])
    body = raw.iloc[(start_row or header_row + 1) - 1 :]
    rows = [tuple("" if pd.isna(v) else " ".join(str(v).replace(" ", " ").split()) for v in r) for r in body.itertuples(index=False)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([r for r in rows if any(r)], schema)


def jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines drop out, anything but objects fails (strict) or lands in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def download_manifest(spark: SparkSession, path: str) -> DataFrame:
    """TSV of path, url, size; a size that is no number is null, rows without path or url drop out."""
    rows = csv_tsv(spark, path, ["path", "url", "size"])
    return rows.select("path", "url", F.col("size").try_cast("bigint").alias("size")).where("coalesce(path, '') <> '' and coalesce(url, '') <> ''")


def csv_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def archive_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Files below a folder: relative_path, size_bytes, modified_at (and content). Links are followed as Hadoop does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    keep = ["content"] if with_content else []
    return files.select(F.substring(plain, F.length(base) + 2, F.length(plain)).alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), *keep)


def workset(header: DataFrame, assets: DataFrame, schema: str, most: int = 10_000) -> DataFrame:
    """The assets of a workset; raises for a wrong schema, missing or duplicate ids, or too many rows."""
    if header.where(F.col("schema") == schema).limit(1).count() == 0:
        raise ValueError(f"not a {schema} file")
    if assets.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} assets")
    bad = assets.where("coalesce(asset_id, '') = ''").select("asset_id").union(assets.groupBy("asset_id").count().where("count > 1").select("asset_id"))
    if (first := bad.first()) is not None:
        raise ValueError(f"missing or duplicate asset id {first[0]!r}")
    return assets


def curated_lookup(entries: DataFrame, curated: DataFrame, key: str, position: str) -> DataFrame:
    """For each entry (letters and digits, as EMPIAR-10094) the first curated row whose joined upper-case text has it, with or without a hyphen, as a part of the text.

    Of a row's letters and the digits after them, those endings and beginnings are keys that are as long as some entry's, so the join is on
    equality. Keys are many times the rows, which no estimate knows: neither they nor the rows found for them are ever broadcast.
    """
    entry = F.replace(F.upper(key), F.lit("-"), F.lit(""))
    parts = lambda t: (F.regexp_extract(t, "^[A-Z]+", 0), F.regexp_extract(t, "[0-9]+$", 0))
    letters, digits = parts(entry)
    shapes = entries.where(entry.rlike("^[A-Z]+[0-9]+$")).select(F.length(letters).alias("_letters"), F.length(digits).alias("_digits")).distinct()  # a row for each pair of lengths
    text = F.upper(F.concat_ws(" ", *[c for c in curated.columns if c != position]))
    letters, digits = parts(F.col("_found"))
    found = curated.withColumn("_found", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z]+-?[0-9]+"), 0)))).withColumns({"_w": letters, "_n": digits})
    named = found.join(F.broadcast(shapes), (F.col("_letters") <= F.length("_w")) & (F.col("_digits") <= F.length("_n"))).withColumn("entry", F.concat(F.expr("right(_w, _letters)"), F.expr("left(_n, _digits)")))
    first = named.groupBy("entry").agg(F.min_by(F.struct(*curated.columns), position).alias("curated"))
    return entries.withColumn("entry", entry).join(first.hint("merge"), "entry", "left").drop("entry")
