"""Writers, and the saved state of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators.search import SearchState


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``id, dataset, embedding`` as Parquet, one folder per dataset."""
    rows = df.select("id", "dataset", F.col("embedding").cast("array<float>").alias("embedding"))
    rows.write.mode(mode).partitionBy("dataset").parquet(path)


def write_csv(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """CSV under ``path``, or under ``path/run_id`` to keep several runs side by side."""
    target = f"{path}/{run_id}" if run_id else path
    df.write.mode("error").options(header=True, quote='"', escape='"').csv(target)
    return target


def write_parquet(df: DataFrame, path: str, run_id: str | None = None) -> str:
    target = f"{path}/{run_id}" if run_id else path
    df.write.mode("error").parquet(target)
    return target


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def write_split(df: DataFrame, path: str) -> None:
    """Train/validation corpus, one folder per ``split``."""
    df.write.mode("error").partitionBy("split").parquet(path)


STATE_SCHEMA = (
    "step int, beams array<struct<words: array<string>, score: double, beam_score: double>>, "
    "trace array<struct<step: int, score: double, text: string>>"
)


def save_state(spark: SparkSession, state: SearchState, path: str) -> None:
    """One folder per step, so a failed write never harms an earlier step."""
    row = spark.createDataFrame([(state.step, state.beams, state.trace)], STATE_SCHEMA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={state.step:05d}")


def load_state(spark: SparkSession, path: str) -> SearchState | None:
    """State of the highest complete step, or None when there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    steps = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("step=")]
    done = [p for p in steps if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        return None
    newest = max(done, key=lambda p: int(p.getName().split("=")[1]))
    row = spark.read.schema(STATE_SCHEMA).parquet(newest.toString()).first()
    beams = [(list(b["words"]), b["score"], b["beam_score"]) for b in row["beams"]]
    return SearchState(row["step"], beams, [tuple(t) for t in row["trace"]])
