"""Session helpers shared by every plan: sessions, table access, parallelism and checkpoints."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "ontoweave", cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the plans assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ONTOWEAVE_DRIVER_MEMORY", "8g"))
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give a CPU-heavy Python stage enough tasks when its input has fewer splits than there are cores.

    At scale an input has far more splits than cores and the frame passes through unchanged, so the
    round-robin exchange only ever moves inputs that are small against the cluster. A plain scan is asked
    for its splits; behind a shuffle the optimizer's estimate of the size decides, since asking for the
    partitions would run the shuffle under AQE.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
        few = size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    else:
        few = df.rdd.getNumPartitions() < cores
    return df.repartition(cores * per_core) if few else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where the setting is absent (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "ontoweave-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder; it survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def over_rows(df: DataFrame, schema: str, step: Callable[[dict[str, list]], Iterable[tuple]], batch: int = 2000) -> DataFrame:
    """``mapInArrow`` where ``step`` turns the columns of one Arrow batch into output tuples."""

    def each(parts: Iterator[dict[str, list]]) -> Iterator[tuple]:
        for part in parts:
            yield from step(part)

    return over_parts(df, schema, each, batch)


def over_parts(df: DataFrame, schema: str, step: Callable[[Iterator[dict[str, list]]], Iterable[tuple]], batch: int = 2000) -> DataFrame:
    """``mapInArrow`` where ``step`` turns all the batches of a task into output tuples, so that it may sum over them.

    Output is emitted in slices of ``batch`` rows so that a fan-out never builds one huge batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in step(got.to_pydict() for got in batches):
            out.append(row)
            if len(out) >= batch:
                yield _pack(out, arrow)
                out = []
        if out:
            yield _pack(out, arrow)

    return df.mapInArrow(run, schema)


def _pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


def collect_bounded(df: DataFrame, most: int, what: str) -> list:
    """Collect a frame whose size is bounded by the schema, not by the data, and prove it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; this is meant to be bounded by the schema")
    return rows


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors, once for each application.

    Workers that already have the driver's path (local mode with PYTHONPATH, installed packages) lose
    nothing: the archive comes after it on their path.
    """
    import hashlib
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_ontoweave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(at, f) for at, _, names in os.walk(root) for f in names if f.endswith((".py", ".yaml")))
    digest = hashlib.sha256(b"".join(open(f, "rb").read() for f in files)).hexdigest()[:12]
    where = os.path.join(tempfile.mkdtemp(prefix="ontoweave-"), f"ontoweave-{digest}.zip")
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, os.path.relpath(f, os.path.dirname(root)))
    sc.addPyFile(where)
    sc._ontoweave_shipped = True
