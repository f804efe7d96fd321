"""Chained runs over tables, whose results are published together.

A stage is built from sources and earlier stages. Its signature covers its version and the signatures of its inputs; a source's is
the identity of its files. A stage whose result of the same signature is there is kept, whoever built it: a run that failed half-way goes on with
the first stage that is missing, and after a change only what depends on it is built. Results are written to folders of their own, and one pointer
file names them all; it is replaced in one step, so that readers see all results of one run or all of another.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..scratch import file_identity, read_text, remove, replace_text


@dataclass(frozen=True)
class Stage:
    """name, inputs (names of sources or earlier stages), build (frames by name to the result), version (to be changed with the code)."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[[dict[str, DataFrame]], DataFrame]
    version: str = "1"


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()


def publish_all(spark: SparkSession, root: str, paths: dict[str, str]) -> None:
    """K7: name finished folders as the published set, in one step."""
    replace_text(spark, f"{root}/current.json", json.dumps({"artifacts": paths}, sort_keys=True))


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """K7: the published results by name, all of one run; none before the first."""
    current = json.loads(read_text(spark, f"{root}/current.json") or '{"artifacts": {}}')
    return {name: spark.read.parquet(path) for name, path in current["artifacts"].items()}


def run_chain(spark: SparkSession, root: str, stages: Sequence[Stage], sources: dict[str, str]) -> dict[str, str]:
    """Run the stages in order over the tables at the sources' paths and publish all results; what became of each stage: built or kept."""
    signatures = {name: _digest(file_identity(spark, path)) for name, path in sources.items()}
    frames = {name: spark.read.parquet(path) for name, path in sources.items()}
    paths, report = {}, {}
    for stage in stages:
        signature = signatures[stage.name] = _digest(stage.name, stage.version, [signatures[i] for i in stage.inputs])
        path = paths[stage.name] = f"{root}/artifacts/{stage.name}-{signature[:32]}"
        if read_text(spark, f"{path}.done") is None:
            stage.build({i: frames[i] for i in stage.inputs}).write.mode("overwrite").option("compression", "zstd").parquet(path)
            replace_text(spark, f"{path}.done", signature)
            report[stage.name] = "built"
        else:
            report[stage.name] = "kept"
        frames[stage.name] = spark.read.parquet(path)
    publish_all(spark, root, paths)
    return report


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Remove results that the published set does not name; the removed folders. For times at which no run is on and no reader holds an older set."""
    current = json.loads(read_text(spark, f"{root}/current.json") or '{"artifacts": {}}')
    kept = {p.rsplit("/", 1)[1] for p in current["artifacts"].values()}
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/artifacts")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    gone = [n for n in names if n.removesuffix(".done") not in kept]
    for n in gone:
        remove(spark, f"{root}/artifacts/{n}")
    return sorted(n for n in gone if not n.endswith(".done"))
