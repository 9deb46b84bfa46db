"""Tables in databases: reads in parts by bounds of a number, filters and columns that the database decides.

Where no database server is at hand and executors are processes of their own, a table can be a folder of database files:
Spark's jars hold Derby's embedded engine, which lets one process at a time change a database, but any number read one
that lies in an archive. Each task loads its rows into a database of its own and leaves it as an archive.
"""

from __future__ import annotations

import glob
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as pafs
from py4j.java_gateway import JavaGateway
from py4j.protocol import Py4JJavaError
from pyspark.find_spark_home import _find_spark_home
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources import log_source

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
TABLE = "PART"
ROWS = 200_000  # of a database file, so that a task's work has a bound
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "string": "CLOB"}


def write_jdbc(df: DataFrame, url: str, table: str, types: str = "", driver: str | None = None, batch: int = 5000) -> None:
    """Append a frame's rows, a connection for each partition; types: column types where the database's default isn't wanted."""
    writer = df.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=batch)
    if types:
        writer = writer.option("createTableColumnTypes", types)
    (writer.option("driver", driver) if driver else writer).save()


def read_jdbc(
    spark: SparkSession, url: str, table: str, by: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, driver: str | None = None
) -> DataFrame:
    """A table, in `parts` queries that split the range of the whole number `by` evenly; rows beyond the bounds are in the first and last."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table)
    if driver:
        reader = reader.option("driver", driver)
    if by and bounds:
        reader = reader.options(partitionColumn=by, lowerBound=bounds[0], upperBound=bounds[1] + 1, numPartitions=parts)
    return reader.load()


def has_database(spark: SparkSession) -> bool:
    """Whether all executors can reach a database to write to: a server's, or one in the JVM that they share with the driver."""
    return bool(spark.conf.get("spark.weftline.jdbc.url", "")) or spark.sparkContext.master.split("[")[0] == "local"


def database(spark: SparkSession) -> tuple[str, str | None]:
    """The address and driver of the database that spark.weftline.jdbc.url names, else one in the memory of this JVM.

    The latter is for sessions whose executors are in this JVM too; others have `write_files`.
    """
    url = spark.conf.get("spark.weftline.jdbc.url", "")
    if url:
        return url, None
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("executors in other processes need a database server: name it in spark.weftline.jdbc.url")
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:memory:weft{uuid.uuid4().hex};create=true", DERBY


def ends(df: DataFrame, column: str) -> tuple[int, int]:
    """The smallest and the largest value of a column."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return low or 0, high or 0


def write_files(df: DataFrame, folder: str, types: str = "", rows: int = ROWS, parts: int = 4) -> list[str]:
    """Load a frame's rows into database files in a new folder that driver and executors share; gives their addresses.

    A file takes about `rows` rows; there are at least `parts`. Types are as in `write_jdbc`.
    """
    fs, root = log_source._open(folder)
    if not isinstance(fs, pafs.LocalFileSystem):
        raise ValueError(f"Derby opens files of mounted folders only, not {folder}: name a database server in spark.weftline.jdbc.url")
    columns = _columns(df.schema, types)
    os.makedirs(root)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"name": [_load_file(batches, root, columns)]})

    n = df.count()
    if n:
        made = df.repartition(max(parts, -(-n // rows))).mapInArrow(load, "name string")
    else:
        made = df.sparkSession.range(1).coalesce(1).mapInArrow(lambda _: load(iter(())), "name string")
    return [f"jdbc:derby:jar:({root}/{r['name']})db" for r in made.collect()]


def read_files(spark: SparkSession, urls: list[str]) -> DataFrame:
    """The rows of database files, a query for each."""
    frames = []
    for url in urls:
        frames.append(read_jdbc(spark, url, TABLE, driver=DERBY))
        # the driver has read the columns' types and needs the database no more
        _close(spark._jvm, url)
    return reduce(DataFrame.unionAll, frames)


def _columns(schema: T.StructType, types: str) -> str:
    """The columns of CREATE TABLE."""
    given = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(types)} if types else {}
    made = []
    for f in schema:
        kind = given.get(f.name) or f.dataType.simpleString()
        if kind not in _TYPES and not kind.startswith(("decimal(", "varchar(", "char(")):
            raise ValueError(f"no type for column {f.name}: {kind}")
        name = f.name.replace('"', '""')
        made.append(f'"{name}" {_TYPES.get(kind, kind)}')
    return ", ".join(made)


def _load_file(batches: Iterator[pa.RecordBatch], root: str, columns: str) -> str:
    """In a task: a database of these rows, loaded by Derby's import from a file of text; gives the archive's name."""
    with tempfile.TemporaryDirectory() as tmp:
        text, writer = f"{tmp}/rows.csv", None
        for batch in batches:
            if writer is None:
                # nulls are written without quotes, texts with them, empty ones too
                writer = pc.CSVWriter(text, batch.schema, write_options=pc.WriteOptions(include_header=False, quoting_style="needed"))
            writer.write(batch)
        if writer is not None:
            writer.close()
        with _derby(tmp) as jvm:
            connection = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{tmp}/db;create=true")
            connection.createStatement().execute(f"CREATE TABLE {TABLE} ({columns})")
            if writer is not None:
                call = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
                call.setString(1, TABLE)
                call.setString(2, text)
                call.execute()
            connection.close()
            _close(jvm, f"jdbc:derby:{tmp}/db")
        name = f"{uuid.uuid4().hex}.jar"
        # not compressed, so that Derby finds a page without reading those before it
        with zipfile.ZipFile(f"{root}/{name}", "w", zipfile.ZIP_STORED) as z:
            for place, _, files in os.walk(f"{tmp}/db"):
                for file in files:
                    z.write(f"{place}/{file}", os.path.relpath(f"{place}/{file}", tmp))
    return name


@contextmanager
def _derby(tmp: str):
    """A Java process with Spark's Derby, which ends with the block or with this process."""
    jars = [j for name in ("derby", "py4j") for j in glob.glob(f"{_find_spark_home()}/jars/{name}*.jar")]
    options = ["-Xmx128m", "-XX:+UseSerialGC", f"-Dderby.stream.error.file={tmp}/derby.log"]
    gateway = JavaGateway.launch_gateway(
        jarpath=next(j for j in jars if "py4j" in j), classpath=os.pathsep.join(jars), javaopts=options, java_path=None, die_on_exit=True, enable_auth=True
    )
    try:
        gateway.jvm.java.lang.Class.forName(DERBY)
        yield gateway.jvm
    finally:
        gateway.shutdown()
        gateway.java_process.stdin.close()
        gateway.java_process.wait()


def _close(jvm, url: str) -> None:
    """Close a Derby database in a JVM; Derby reports that as an error of state 08006."""
    try:
        jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":
            raise
