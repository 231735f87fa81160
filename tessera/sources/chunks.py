"""A frame as encoded column chunks and back: one binary for each column of each row group.

``write`` and ``read`` keep chunks as Parquet rows (row_group, n, column_name, kind, payload), and the schema as a
section among them; a read of few columns decodes only their chunks. Columns may nest: see :mod:`tessera.functions.columns`.
``TesseraSource`` offers the same as a Spark data source named ``tessera``, for reading and writing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns
from ..functions.scalar import GROUP
from ..operators import reconcile, schema
from ..operators.position import with_positions
from ..session import ship

CHUNK = "row_group long, n long, column_name string, kind string, payload binary"
NAMES = ["row_group", "n", "column_name", "kind", "payload"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
#: The kind of the row that holds the section.
SECTION = "section"


def _rows(t: pa.Table, group: int, names: list[str]) -> pa.Table:
    """The chunks of one row group."""
    rows = [(group, t.num_rows, c, columns.kind_of(t.schema.field(c).type), columns.encode(t.column(c))) for c in names]
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def encode_chunks(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Chunks of ``df`` in row groups of 4096 rows under a total order."""
    ship(df.sparkSession)
    names = df.columns
    for f in to_arrow_schema(df.schema):
        columns.kind_of(f.type)  # refuses before any job

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos_")
        return _rows(t, t.column("row_group_")[0].as_py(), names)

    placed = with_positions(df, order_by, "pos_", "row_group_", None)
    return placed.groupBy("row_group_").applyInArrow(run, CHUNK)


def decode_chunks(chunks: DataFrame, wanted: T.StructType) -> DataFrame:
    """Rows of ``wanted``'s columns; chunks of others aren't read. Groups are decoded each by itself, into Arrow."""
    ship(chunks.sparkSession)
    arrow = to_arrow_schema(wanted)

    def run(t: pa.Table) -> pa.Table:
        return _decoded(t, arrow)

    rows = chunks.where(F.col("column_name").isin(wanted.names) & (F.col("kind") != SECTION))
    return rows.groupBy("row_group").applyInArrow(run, _nullable(wanted))


def _nullable(t: T.StructType) -> T.StructType:
    """What comes out of Python may be null to Spark."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in t.fields])


def _decoded(t: pa.Table, arrow: pa.Schema) -> pa.Table:
    by = dict(zip(t.column("column_name").to_pylist(), range(t.num_rows), strict=True))
    out = []
    for f in arrow:
        if f.name not in by:
            raise ValueError(f"no chunk of {f.name}")
        k = by[f.name]
        payload = t.column("payload")[k].as_py()
        arr, end = columns.decode(f.type, payload, t.column("n")[k].as_py())
        if end != len(payload):
            raise ValueError(f"{f.name}: bytes are left after the column")
        out.append(arr)
    return pa.table(out, names=arrow.names)


def section_row(spark: SparkSession, t: T.StructType) -> DataFrame:
    """The chunk that holds a schema's section."""
    return spark.createDataFrame([(-1, 0, "", SECTION, bytearray(schema.section(t)))], CHUNK)


def schema_in(chunks: DataFrame) -> T.StructType:
    """The schema that a chunk set carries."""
    row = chunks.where(F.col("kind") == SECTION).select("payload").first()
    if row is None:
        raise schema.Refused("the chunks carry no section")
    return schema.schema_of(bytes(row.payload))


def write(df: DataFrame, path: str, order_by: list[str]) -> None:
    encode_chunks(df, order_by).unionByName(section_row(df.sparkSession, df.schema)).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, wanted: T.StructType | None = None) -> DataFrame:
    """The columns of ``wanted``, or all that the section names."""
    chunks = spark.read.schema(CHUNK).parquet(path)
    return decode_chunks(chunks, wanted or schema_in(chunks))


def read_as(spark: SparkSession, path: str, target: T.StructType) -> DataFrame:
    """What was written under any schema, read as ``target``: by name, converted where no value is lost, zero where missing."""
    chunks = spark.read.schema(CHUNK).parquet(path)
    have = schema_in(chunks)
    needed = T.StructType([f for f in have.fields if f.name in target.names])
    return reconcile.reconcile(decode_chunks(chunks, needed or have), target)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, wanted: T.StructType, options: dict) -> None:
        self.schema, self.path = wanted, options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, path = _folder(self.path)
        found = where.get_file_info(fs.FileSelector(path))
        return [_File(f.path) for f in found if f.path.endswith(".parquet") and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        arrow = to_arrow_schema(self.schema)
        t = pq.read_table(partition.path, filesystem=_folder(self.path)[0], filters=[("kind", "!=", SECTION), ("column_name", "in", arrow.names)])
        for group in t.column("row_group").unique():
            yield from _decoded(t.filter(pa.compute.equal(t.column("row_group"), group)), arrow).to_batches()


class _Written(WriterCommitMessage):
    def __init__(self, name: str) -> None:
        self.name = name


class _Writer(DataSourceArrowWriter):
    """Row groups in the order that rows come; files get their names when all are written."""

    def __init__(self, wanted: T.StructType, options: dict, overwrite: bool) -> None:
        self.section, self.path, self.overwrite = schema.section(wanted), options["path"], overwrite
        self.arrow = to_arrow_schema(wanted)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        where, path = _folder(self.path)
        where.create_dir(path)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        name = f"part-{part:05d}-{uuid.uuid4().hex}.parquet"
        with where.open_output_stream(f"{path}/_{name}") as sink, pq.ParquetWriter(sink, pa.schema(list(zip(NAMES, TYPES, strict=True)))) as out:
            out.write_table(pa.table([pa.array([x], t) for x, t in zip((-1, 0, "", SECTION, self.section), TYPES, strict=True)], names=NAMES))
            held, rows, group = [], 0, 0
            for batch in iterator:
                held.append(pa.table(batch.columns, names=self.arrow.names))
                rows += batch.num_rows
                while rows >= GROUP:
                    whole = pa.concat_tables(held)
                    out.write_table(_rows(whole.slice(0, GROUP), part << 32 | group, self.arrow.names))
                    held, rows, group = [whole.slice(GROUP)], rows - GROUP, group + 1
            if rows:
                out.write_table(_rows(pa.concat_tables(held), part << 32 | group, self.arrow.names))
        return _Written(name)

    def commit(self, messages: list[_Written]) -> None:
        from pyarrow import fs

        where, path = _folder(self.path)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(path)):
                if f.path.endswith(".parquet") and not f.base_name.startswith("_"):
                    where.delete_file(f.path)
        for m in messages:
            where.move(f"{path}/_{m.name}", f"{path}/{m.name}")

    def abort(self, messages: list[_Written]) -> None:
        where, path = _folder(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(f"{path}/_{m.name}")


class TesseraSource(DataSource):
    """``spark.read.format("tessera").load(path)`` and ``df.write.format("tessera").mode(...).save(path)``.

    A reader without a schema takes the section's. A row group's chunks are in one file. The path must be open to pyarrow.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera"

    def schema(self) -> T.StructType:
        import pyarrow.parquet as pq

        reader = _Reader(T.StructType(), self.options)
        for f in reader.partitions():
            found = pq.read_table(f.path, filesystem=_folder(self.options["path"])[0], filters=[("kind", "=", SECTION)])
            if found.num_rows:
                return _nullable(schema.schema_of(found.column("payload")[0].as_py()))
        raise schema.Refused("the chunks carry no section: give the schema of the columns to read")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, self.options, overwrite)


def group_report(df: DataFrame, order_by: list[str]) -> DataFrame:
    """(row_group, n, first_pos, last_pos)."""
    got = with_positions(df, order_by).groupBy("row_group")
    return got.agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
