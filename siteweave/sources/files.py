"""Small files, logs, run folders and result bundles."""

from __future__ import annotations

import ast
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_NAME = r"^(rf|lightgbm|xgboost)_(.+)_\d{8}-\d{6}$"


def decode_npy(data: bytes) -> np.ndarray:
    """An array of the .npy format, version 1 to 3."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("no array file")
    wide = data[6] > 1
    start = 12 if wide else 10
    n = int.from_bytes(data[8:start], "little")
    head = ast.literal_eval(data[start : start + n].decode("latin-1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("an array of objects")
    return np.frombuffer(data[start + n :], kind).reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def encode_npy(a: np.ndarray) -> bytes:
    """The array in the .npy format, version 1."""
    head = repr({"descr": a.dtype.str, "fortran_order": False, "shape": a.shape})
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode("latin-1") + np.ascontiguousarray(a).tobytes()


def ingest_patches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(patches, skipped) of a folder of {sample_id}.npy files."""
    return decode_patches(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content"))


def decode_patches(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches, skipped) of (path, content): three-dimensional and finite arrays, the others with a reason."""
    def decoded(items):
        for batch in items:
            out = {"sample_id": [], "p": [], "c": [], "patch": [], "reason": []}
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out["sample_id"].append(path.rsplit("/", 1)[-1].removesuffix(".npy"))
                why, a = None, None
                try:
                    a = decode_npy(data)
                    why = "not three-dimensional" if a.ndim != 3 else None if np.isfinite(a).all() else "not finite"
                except (ValueError, SyntaxError, KeyError, TypeError) as e:
                    why = f"unreadable: {type(e).__name__}"
                out["reason"].append(why)
                ok = why is None
                out["p"].append(a.shape[0] if ok else None)
                out["c"].append(a.shape[2] if ok else None)
                out["patch"].append(a.astype(np.float32).ravel().tolist() if ok else None)
            yield pa.RecordBatch.from_arrays([pa.array(out["sample_id"]), pa.array(out["p"], pa.int32()), pa.array(out["c"], pa.int32()), pa.array(out["patch"], pa.list_(pa.float32())), pa.array(out["reason"], pa.string())], names=list(out))

    rows = files.select("path", "content").mapInArrow(decoded, "sample_id string, p int, c int, patch array<float>, reason string")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select(F.col("sample_id").alias("id"), "reason", F.lit("ingest").alias("stage"))


def ingest_feature_cache(spark: SparkSession, folder: str, schema: str, key: str = "sample_id") -> DataFrame:
    """Feature rows of a folder of JSON files, for each key the first by file and text."""
    rows = spark.read.schema(schema).json(folder)
    place = F.struct(F.col("_metadata.file_path"), F.to_json(F.struct(*rows.columns)))
    first = rows.select(key, place.alias("__at"), F.struct(*rows.columns).alias("__row")).groupBy(key).agg(F.min_by("__row", "__at").alias("__row"))
    return first.select("__row.*")


def parse_run_names(runs: DataFrame, column: str) -> DataFrame:
    """model and config from the names of run folders; other names are dropped."""
    model = F.regexp_extract(column, RUN_NAME, 1)
    return runs.where(model != "").withColumns({"model": model, "config": F.regexp_extract(column, RUN_NAME, 2)}).drop(column)


def scan_runs(spark: SparkSession, root: str, file: str, schema: str, bare: str | None = None) -> DataFrame:
    """The metric files (or folders of parts) named `file` of all run folders under root, with their model and config.

    Folders of other names are dropped. bare is a pattern of names that are a model's alone, as of a
    run of the whole feature set; their config is null.
    """
    rows = spark.read.option("header", True).schema(schema).csv(f"{root}/*/{file}").withColumn("__dir", F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{re.escape(file)}(?:/|$)", 1))
    runs = parse_run_names(rows, "__dir")
    if bare is None:
        return runs
    alone = rows.where(F.col("__dir").rlike(f"^(?:{bare})$")).select(*[c for c in rows.columns if c != "__dir"], F.col("__dir").alias("model"), F.lit(None).cast("string").alias("config"))
    return runs.unionByName(alone)


def combine_summaries(tables: list[DataFrame], metric: str = "r2_mean") -> DataFrame:
    """Summaries in one table, columns that a table lacks as nulls, best first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).orderBy(F.desc_nulls_last(metric))


def scan_summaries(spark: SparkSession, root: str, schema: str, metric: str = "r2_mean", lines: bool = False) -> DataFrame:
    """All JSON files under root, at any depth, in one table, best first; a field that a file lacks is null. lines: a summary for each line instead of each file."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", not lines).option("pathGlobFilter", "*.json").json(root).orderBy(F.desc_nulls_last(metric))


def log_status(logs: DataFrame, key: str, text: str, marker: str = "Partition complete: succeeded") -> DataFrame:
    """(key, status): success with the marker in the log, unknown without a log, else failure."""
    return logs.select(key, F.when(F.col(text).isNull(), "unknown").when(F.col(text).contains(marker), "success").otherwise("failure").alias("status"))


def failed_ids(spark: SparkSession, folder: str, marker: str = "Partition complete: succeeded", pattern: str = r"([^/]*?)(?:\.[^./]*)?$") -> DataFrame:
    """(id, status) of the logs under folder none of which has the marker; pattern finds the id in a log's path, by default its name."""
    logs = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_path", pattern, 1).alias("id"), F.col("value").alias("text"))
    return log_status(logs, "id", "text", marker).groupBy("id").agg(F.max("status").alias("status")).where("status <> 'success'")  # of success and failure, success is the greater


def retry_ids(lines: DataFrame, inputs: DataFrame, pattern: str = r"^s2_(.+)_P[0-9]+$", key: str = "id") -> DataFrame:
    """Ids on the lines of a failure log (blank lines and comments aside) whose input is there."""
    found = lines.select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')").select(F.regexp_extract("v", pattern, 1).alias(key)).where(F.col(key) != "").distinct()
    return found.join(inputs.select(key), key, "left_semi")


def write_bundle(root: str, name: str, tables: dict[str, DataFrame]) -> None:
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{t}")


def read_bundle(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/{table}")


def list_bundles(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, table) of what write_bundle() has written under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+/part-[^/]*$", 1).alias("bundle"), F.regexp_extract("path", r"([^/]+)/part-[^/]*$", 1).alias("table")).distinct()


def export(df: DataFrame, path: str, kind: str = "csv", files: int | None = None) -> None:
    """A table as text: a file for each task, or the given number of files (1 for a small report)."""
    out = (df if files is None else df.coalesce(files)).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)
