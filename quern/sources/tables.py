"""Reading and writing relations: Arrow IPC files, delimited text, parquet, and seeks in tables."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import written


class SourceError(ValueError):
    """Input that a relation cannot be made of."""


#: The Spark type that holds every unsigned 64-bit number.
UNSIGNED = "decimal(20,0)"


def from_record_batch(spark: SparkSession, batch: pa.RecordBatch | pa.Table) -> DataFrame:
    """A relation of unsigned 64-bit columns without nulls: longs, or, for a column with values from 2**63 on, whole
    decimals of 20 digits, which hold them all."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    columns = []
    for f in table.schema:
        if f.type != pa.uint64():
            raise SourceError(f"{f.name} is {f.type}, not uint64")
        column = table.column(f.name)
        if column.null_count:
            raise SourceError(f"{f.name} has nulls")
        top = pc.max(column).as_py() or 0
        columns.append(column.cast(pa.int64() if top < 1 << 63 else pa.decimal128(20, 0)))
    return spark.createDataFrame(pa.table(columns, names=table.column_names))


def load_arrow(spark: SparkSession, path: str) -> DataFrame:
    """All batches of an Arrow IPC file on the driver's disk; a file without batches is an error."""
    with pa.memory_map(path) as source, pa.ipc.open_file(source) as f:
        if not f.num_record_batches:
            raise SourceError(f"{path} has no batches")
        return from_record_batch(spark, f.read_all())


def save_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file on the driver's disk, for exchange of small relations; large ones are written as parquet."""
    table = df.toArrow()
    whole = lambda t: pa.types.is_integer(t) or pa.types.is_decimal(t) and t.scale == 0
    unsigned = table.cast(pa.schema([(f.name, pa.uint64() if whole(f.type) else f.type) for f in table.schema]))
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, unsigned.schema) as out:
        out.write_table(unsigned)


def from_flat(spark: SparkSession, columns: Sequence[str], values: Sequence[int]) -> DataFrame:
    """Rows from one flat list, row after row."""
    n = len(columns)
    if not n or len(values) % n:
        raise SourceError(f"{len(values)} values don't fill rows of {n}")
    return spark.createDataFrame([tuple(values[k : k + n]) for k in range(0, len(values), n)], ", ".join(f"`{c}` bigint" for c in columns))


def _header(spark: SparkSession, path: str, columns: Mapping[str, str], delimiter: str, header: bool) -> list[str]:
    """A file's columns in their order; the header's names may be quoted and hold the delimiter."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise SourceError(f"{path} is empty")
    found = [x.strip() for x in next(csv.reader([first[0][0]], delimiter=delimiter))] if header else list(columns)
    if header and (len(set(found)) < len(found) or set(found) != set(columns)):
        raise SourceError(f"header {found} for columns {list(columns)}")
    return found


def copy_from(spark: SparkSession, path: str, columns: Mapping[str, str], delimiter: str = ",", header: bool = True) -> DataFrame:
    """A table's columns (name: Spark type) from delimited text. With a header, columns go by name, in any order;
    one that is missing, unknown or there twice is an error, as is a value of another type when it is read."""
    found = _header(spark, path, columns, delimiter, header)
    schema = ", ".join(f"`{c}` {columns[c]}" for c in found)
    rows = spark.read.option("header", header).option("sep", delimiter).option("mode", "FAILFAST").schema(schema).csv(path)
    return rows.select(*(F.col(f"`{c}`") for c in columns))


def copy_chunks(spark: SparkSession, path: str, columns: Mapping[str, str], chunk_rows: int, delimiter: str = ",", header: bool = True) -> DataFrame:
    """As `copy_from`, with `chunk` (rows are counted in the file's order) and `bad`, the line of a row that cannot be
    read in its types, else null. Counts of the file's parts come to the driver."""
    found = _header(spark, path, columns, delimiter, header)
    schema = ", ".join([*(f"`{c}` {columns[c]}" for c in found), "`__bad` string"])
    rows = spark.read.option("header", header).option("sep", delimiter).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").schema(schema).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    _, placed = written(rows.select(place.alias("__part"), F.monotonically_increasing_id().alias("__at"), *(F.col(f"`{c}`") for c in columns), F.col("__bad").alias("bad")), "copy")
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("least")).orderBy("__part").collect()
    at, starts = 0, []
    for r in parts:
        starts.append((r["__part"], at - r.least))
        at += r.n
    shift = F.broadcast(spark.createDataFrame(starts, "p struct<file:string,start:bigint>, shift long"))
    joined = placed.join(shift, F.col("__part") == F.col("p"))
    return joined.select(*(F.col(f"`{c}`") for c in columns), F.floor((F.col("__at") + F.col("shift")) / chunk_rows).cast("long").alias("chunk"), "bad")


def seek(df: DataFrame, **equals: object) -> DataFrame:
    """Rows with these values; a null finds nulls."""
    for c, v in equals.items():
        if c not in df.columns:
            raise SourceError(f"no column {c}")
        df = df.filter(F.col(f"`{c}`").eqNullSafe(F.lit(v)))
    return df


def index_seek(df: DataFrame, index: Sequence[str], key: Sequence[object]) -> DataFrame:
    """Rows with a whole compound key."""
    if len(index) != len(key):
        raise SourceError(f"an index over {list(index)} needs {len(index)} values")
    return seek(df, **dict(zip(index, key, strict=True)))


def lookup(df: DataFrame, **equals: object) -> bool:
    return not seek(df, **equals).limit(1).isEmpty()


def range_seek(df: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    """Rows from `low` on and below `high`; parquet statistics prune what lies outside."""
    if low is not None:
        df = df.filter(F.col(f"`{column}`") >= low)
    return df if high is None else df.filter(F.col(f"`{column}`") < high)


def sorted_index(df: DataFrame, permutation: Sequence[str]) -> DataFrame:
    """Rows in the order of a permutation of all columns: sorted ranges, so files written from it prune seeks."""
    if sorted(permutation) != sorted(df.columns):
        raise SourceError(f"{list(permutation)} is no permutation of {df.columns}")
    return df.repartitionByRange(*(F.col(f"`{c}`") for c in permutation)).sortWithinPartitions(*(F.col(f"`{c}`") for c in permutation))
