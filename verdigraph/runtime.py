"""Session helpers: tables, checkpoints, and Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "verdigraph", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, in case it isn't installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_verdigraph", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="verdigraph-")) / "verdigraph.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._verdigraph = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; set where it is unset.

    Only a local session may run without it; it then gets a temporary folder of this machine.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="verdigraph-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder within the shared one."""
    return f"{shared_folder(spark)}/verdigraph-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def by_size(rows: DataFrame, scope: list[str], bound: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of scopes of at most ``bound`` rows; those of larger ones, with a number ``large`` for the scope; these scopes.

    Larger scopes are a counted table that is joined, however many they are; (rows, None, None) if there are none. No
    columns are one scope. The number is never null, so it can be joined on.
    """
    counted = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound)
    if counted.isEmpty():
        return rows, None, None
    names = [F.col(c).alias(f"_{c}") for c in scope]
    large = checkpointed(counted.select(*names, F.monotonically_increasing_id().alias("large")))
    if not scope:
        return rows.limit(0), rows.withColumn("large", F.lit(large.first().large)), large
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope])
    return rows.join(large, same, "left_anti"), rows.join(large, same).drop(*[f"_{c}" for c in scope]), large


def with_scope(found: DataFrame, large: DataFrame, scope: list[str]) -> DataFrame:
    """``found`` with the columns of the scopes that ``large`` numbers."""
    back = large.select("large", *[F.col(f"_{c}").alias(c) for c in scope])
    return found.join(back, "large").drop("large")


def slices(batches: Iterable[pa.RecordBatch], rows: int, scope: list[str] | None = None) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from a partition; with ``scope``, which must be sorted by it, no scope is torn apart (one of no columns is the whole partition)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        cut = whole.num_rows if scope is None else _last_change(whole, scope)
        if cut:
            yield whole.slice(0, cut).combine_chunks()
        held = whole.slice(cut).combine_chunks().to_batches()
        n = whole.num_rows - cut
        if not cut:
            rows *= 2  # one scope fills the slice: look again only when it has doubled
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _last_change(whole: pa.Table, scope: list[str]) -> int:
    """Where the last scope of a sorted table begins."""
    last = [whole[c][whole.num_rows - 1].as_py() for c in scope]
    low, high = 0, whole.num_rows - 1
    while low < high:
        mid = (low + high) // 2
        if [whole[c][mid].as_py() for c in scope] == last:
            high = mid
        else:
            low = mid + 1
    return low
