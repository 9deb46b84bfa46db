"""A table as a log of commits, as a Python data source: spark.read / readStream / write.format("weftlog").

A table is a folder that driver and executors share. Tasks write Parquet files into it; a commit is a
small file that names those of one write, with the ranges of their whole numbers, so what no commit names
does not exist: an aborted write and a task that failed leave no rows, and their files are deleted. Readers
take filters on whole numbers, text, time and booleans; they leave out files whose ranges rule them
out and pass the filters on to the Parquet reader. Commits are a stream's offsets, so each batch is the
commits since the last one and a batch that is run again reads the same files.

One writer commits at a time. The columns must have types that Parquet and Arrow hold.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

COMMITS, FILES = "_commits", "_files"
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
_COMPARE = {D.EqualTo: "equal", D.GreaterThan: "greater", D.GreaterThanOrEqual: "greater_equal", D.LessThan: "less", D.LessThanOrEqual: "less_equal"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system and its place there; file:/x is what Hadoop makes of a local path."""
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Files(D.InputPartition):
    """A file of the table."""

    name: str
    value: None = None


@dataclass
class Written(D.WriterCommitMessage):
    """A file that a task has written: its name, rows and the ranges of its whole numbers."""

    name: str | None
    rows: int
    least: dict
    most: dict


def _commits(path: str) -> list[dict]:
    """All commits in order."""
    fs, root = _open(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json"))
    return [json.loads(fs.open_input_file(n).read()) for n in names]


def _expression(f: D.Filter) -> pc.Expression | None:
    """A filter for Arrow; none for what Arrow would decide in another way or not at all."""
    if len(f.attribute) != 1:
        return None
    field = pc.field(f.attribute[0])
    if isinstance(f, D.IsNotNull):
        return field.is_valid()
    if isinstance(f, D.IsNull):
        return field.is_null()
    if isinstance(f, D.In):
        return field.isin([v for v in f.value if v is not None]) if f.value else None
    if type(f) in _COMPARE and isinstance(f.value, (int, str, bool, dt.date, dt.datetime)):
        return getattr(pc, _COMPARE[type(f)])(field, pc.scalar(f.value))
    return None


def _possible(f: D.Filter, file: dict) -> bool:
    """Whether a file may hold a row that passes a filter, by its ranges."""
    name = f.attribute[0]
    if name not in file["least"] or type(f) not in _COMPARE:
        return True
    low, high = file["least"][name], file["most"][name]
    return {
        D.EqualTo: low <= f.value <= high,
        D.GreaterThan: high > f.value,
        D.GreaterThanOrEqual: high >= f.value,
        D.LessThan: low < f.value,
        D.LessThanOrEqual: low <= f.value,
    }[type(f)]


class _Reading:
    """What batch and stream readers share: files to batches."""

    def __init__(self, path: str, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.schema, self.arrow, self.filters = path, schema, to_arrow_schema(schema), []

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        wanted = None
        for f in self.filters:
            wanted = _expression(f) if wanted is None else wanted & _expression(f)
        held = ds.dataset(f"{root}/{FILES}/{part.name}", schema=self.arrow, format="parquet", filesystem=fs)
        yield from held.to_batches(columns=self.arrow.names, filter=wanted)

    def files_of(self, commits: list[dict]) -> list[Files]:
        every = [x for c in commits for x in c["files"]]
        return [Files(x["name"]) for x in every if all(_possible(f, x) for f in self.filters)] or [Files("")]


class LogReader(_Reading, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            known = len(getattr(f, "attribute", ())) == 1 and isinstance(kinds.get(f.attribute[0]), _EXACT)
            if known and _expression(f) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        commits = _commits(self.path)
        last = max((k for k, c in enumerate(commits) if c["overwrite"]), default=0)
        return self.files_of(commits[last:])

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        yield from super().read(part) if part.name else ()


class LogStreamReader(_Reading, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commit": len(_commits(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.files_of(_commits(self.path)[start["commit"] : end["commit"]])

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        yield from super().read(part) if part.name else ()


class LogWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A task's rows as one file; a task that fails deletes what it wrote."""
        fs, root = _open(self.path)
        name, out, rows, least, most = f"{uuid.uuid4().hex}.parquet", None, 0, {}, {}
        place = f"{root}/{FILES}/{name}"
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    fs.create_dir(f"{root}/{FILES}", recursive=True)
                    out = pq.ParquetWriter(fs.open_output_stream(place), batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
                for field in batch.schema:
                    ends = pc.min_max(batch.column(field.name)).as_py() if pa.types.is_integer(field.type) else {"min": None}
                    if ends["min"] is not None:
                        least[field.name] = min(ends["min"], least.get(field.name, ends["min"]))
                        most[field.name] = max(ends["max"], most.get(field.name, ends["max"]))
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(place)
            raise
        return Written(name if rows else None, rows, least, most)

    def commit(self, messages: list[Written | None]) -> None:
        """Name the files of all tasks in one new file, which appears whole or not at all."""
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/{COMMITS}", recursive=True)
        files = [{"name": m.name, "rows": m.rows, "least": m.least, "most": m.most} for m in messages if m and m.name]
        draft = f"{root}/{COMMITS}/{uuid.uuid4().hex}.draft"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"overwrite": self.overwrite, "files": files}).encode())
        fs.move(draft, f"{root}/{COMMITS}/{len(_commits(self.path)):012d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        vacuum(self.path)


def vacuum(path: str) -> int:
    """Delete the files that no commit names, those of killed tasks among them; gives their number. Not beside a writer."""
    fs, root = _open(path)
    named = {x["name"] for c in _commits(path) for x in c["files"]}
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{FILES}", allow_not_found=True))
    loose = [f.path for f in found if f.base_name not in named]
    for place in loose:
        fs.delete_file(place)
    return len(loose)


class Log(D.DataSource):
    """Options: path. The schema is given by the reader: .schema(...)."""

    @classmethod
    def name(cls) -> str:
        return "weftlog"

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> LogStreamReader:  # noqa: N802
        return LogStreamReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)


def _known(spark: SparkSession) -> None:
    """Make the source known to a session and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Log)


def write_log(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One commit of a frame's rows; overwrite: readers see none before it."""
    _known(df.sparkSession)
    df.write.format("weftlog").mode("overwrite" if overwrite else "append").option("path", path).save()


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as it is. Read anew for each query: Spark keeps the filters that one has handed to a loaded table."""
    _known(spark)
    return spark.read.format("weftlog").schema(schema).option("path", path).load()


def stream_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The commits as a stream."""
    _known(spark)
    return spark.readStream.format("weftlog").schema(schema).option("path", path).load()
