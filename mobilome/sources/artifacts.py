"""Matrices, settings, manifests, reports and caches, all through the paths that Spark reads and writes."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings and classifiers that the driver reads are no larger than this.
MOST_BYTES = 64 << 20


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


@contextmanager
def fresh(spark: SparkSession, *paths: str) -> Iterator[None]:
    """Destinations that must not exist; if the work inside fails, whatever it has written to them is removed."""
    taken = [p for p in paths if exists(spark, p)]
    if taken:
        raise FileExistsError(f"destination exists: {', '.join(taken)}")
    try:
        yield
    except BaseException:
        for p in paths:
            remove(spark, p)
        raise


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, computed and written first if it is absent or was never finished."""
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_by_key(rows: DataFrame, key: str, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute`` of the rows whose key the cache at ``path`` does not hold, which it holds afterwards; then all rows of the cache with their keys.

    ``compute`` gives one row per key, with the key.
    """
    spark = rows.sparkSession
    wanted = rows.select(key).distinct()
    missing = rows.dropDuplicates([key])
    if exists(spark, f"{path}/_SUCCESS"):
        missing = missing.join(spark.read.parquet(path).select(key), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted, key, "left_semi")


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of the rows of .npy matrices; one file is one task, so large matrices come as several files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for a in range(0, len(m), 10_000):
                    yield pd.DataFrame({"path": [name] * len(m[a : a + 10_000]), "row": np.arange(a, a + len(m[a : a + 10_000])), "vector": list(m[a : a + 10_000])})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row long, vector array<float>")


def with_metadata(matrix: DataFrame, index: DataFrame, metadata: DataFrame, place: str = "embedding_idx", key: str = "seq_id") -> DataFrame:
    """``metadata`` with the ``vector`` of each key, as an index (``key``, ``place``) says which row of ``read_matrix`` it is.

    Keys without a row, and rows without a key, are left out; a key that the index has twice comes twice.
    """
    placed = index.select(F.col(key).alias("_key"), F.col(place).cast("long").alias("_row")).join(matrix.select(F.col("row").alias("_at"), "vector"), F.col("_row") == F.col("_at"))
    return metadata.join(placed, F.col(key) == F.col("_key")).drop("_key", "_row", "_at")


def _content(spark: SparkSession, path: str) -> bytes:
    found = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MOST_BYTES).select("content").take(1)
    if not found:
        raise ValueError(f"{path}: larger than {MOST_BYTES} bytes")
    return bytes(found[0]["content"])


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The named arrays of a small .npz file, such as a classifier's mean, scale, coefficients, intercept and threshold."""
    with np.load(io.BytesIO(_content(spark, path)), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def read_settings(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML document."""
    text = _content(spark, path).decode()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the yaml package; JSON settings do not") from e
        return yaml.safe_load(text)
    return json.loads(text)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text as one file in a new folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def manifest_lines(counts: DataFrame, split: str, values: Sequence[str]) -> DataFrame:
    """(line_no, line) of a YAML manifest: per split, in order, its counts; ``counts`` is one row a split."""
    entries = F.array(F.lit("    name: "), *[F.lit(f"    {v}: ") for v in values])
    texts = F.array(F.col(split).cast("string"), *[F.col(v).cast("string") for v in values])
    rows = counts.select(F.col(split).alias("_s"), F.posexplode(F.zip_with(entries, texts, lambda a, b: F.concat(a, b))).alias("_i", "line"))
    body = rows.select((F.dense_rank().over(_all("_s")) * 1000 + F.col("_i")).alias("line_no"), F.when(F.col("_i") == 0, F.concat(F.lit("  - "), F.substr("line", F.lit(5)))).otherwise(F.col("line")).alias("line"))
    head = counts.sparkSession.createDataFrame([(0, "splits:")], "line_no int, line string")
    return head.unionByName(body.withColumn("line_no", F.col("line_no").cast("int")))


def _all(*order):
    """A window over a table of a few rows, such as one a split."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*order)


def markdown_lines(table: DataFrame, columns: Sequence[str], order: Sequence, most: int) -> DataFrame:
    """(line_no, line) of a Markdown table of the first ``most`` rows in an order: a report, so its length is the feature."""
    top = table.orderBy(*order).limit(most)
    cell = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = top.select((F.row_number().over(_all(*order)) + 2).alias("line_no"), cell.alias("line"))
    head = [(1, f"| {' | '.join(columns)} |"), (2, f"| {' | '.join('---' for _ in columns)} |")]
    return table.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body.withColumn("line_no", F.col("line_no").cast("int")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Numbered lines as one text file in a new folder; for reports of bounded length."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("errorifexists").text(path)
