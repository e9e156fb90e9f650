"""Shared helpers: the shared work folder, Arrow maps over document texts, stable hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that Python workers get; keeps a batch of long texts small.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset a temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package where neither their path nor their folder holds it; once for each Spark context."""
    root = Path(__file__).resolve().parents[2]
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _shipped or Path.cwd() == root or any(p and Path(p).resolve() == root for p in paths):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="tracewell-")
    atexit.register(shutil.rmtree, folder, True)
    at = os.path.join(folder, "tracewell.zip")
    with zipfile.ZipFile(at, "w") as out:
        for f in sorted((root / "tracewell").rglob("*.py")):
            out.write(f, str(f.relative_to(root)))
    spark.sparkContext.addPyFile(at)


_shipped: set[str] = set()


class Workspace:
    """Tables of one operator run, written to the shared folder so that lineage is cut and lost executors cost nothing."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tracewell-{name}-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df as a table and reads it back."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def folder(self, name: str) -> str:
        """The URI of a subfolder, for files that tasks write themselves."""
        return f"{self.path}/{name}" if "://" in self.path else f"file://{self.path}/{name}"

    def drop(self, name: str) -> None:
        """Deletes a table that nothing will read again."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(
    df: DataFrame,
    text: str,
    results: Sequence[tuple[str, str]],
    make: Callable[[], Callable[[list[str | None]], Sequence[Sequence]]],
) -> DataFrame:
    """Appends the columns of results to df. make() runs once in a worker and gives a function from a list of texts
    (None: null) to one sequence for each new column. A result whose name a column of df has, in any case of letters, gets underscores in front."""
    ship(df.sparkSession)
    taken, named = {c.lower() for c in df.columns}, []
    for n, t in results:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        named.append((n, t))
    results = named
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, T._parse_datatype_string(t)) for n, t in results])
    at = df.columns.index(text)
    kinds = [_arrow(t) for _, t in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            out = f(batch.column(at).to_pylist())
            arrays = [pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    """The Arrow type of a simple Spark type name."""
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(),
    }[kind]


def walked(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], chunk: int = 64) -> Column:
    """The outputs of a fold over an array: step(state, item) gives the next state and one output. Outputs are gathered in chunks, so a fold over n items copies
    about n * chunk / 2 of them and not n * n / 2. items should be a plain column: an expression would be computed again for each chunk."""
    n = F.size(items)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / chunk).cast("int"), F.lit(0))), lambda k: F.slice(items, k * chunk + 1, F.lit(chunk)))

    def one(acc: Column, x: Column) -> Column:
        now, out = step(acc["s"], x)
        return F.struct(now.alias("s"), F.concat(acc["o"], F.array(out)).alias("o"))

    none = F.transform(F.slice(items, 1, 0), lambda x: step(state, x)[1])
    inner = lambda acc, part: F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("o")), one)
    outer = lambda acc, part: F.get(F.transform(F.array(inner(acc, part)), lambda i: F.struct(i["s"].alias("s"), F.concat(acc["o"], F.array(i["o"])).alias("o"))), F.lit(0))
    return F.aggregate(chunks, F.struct(state.alias("s"), F.transform(F.slice(chunks, 1, 0), lambda _: none).alias("o")), outer, lambda acc: F.flatten(acc["o"]))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: projections do not fold through a generator, so no lambda above computes them again."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")).select(*df.columns, *(f"_once.{n}" for n in columns))


def fold(id_column, parts: int):
    """The fold of a row: crc32 of the id as text, modulo parts. Null ids are fold 0."""
    return F.coalesce(F.crc32(id_column.cast("string")) % F.lit(parts), F.lit(0))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
