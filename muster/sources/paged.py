"""A data source of pages: a folder of JSON-lines files, as a document store exports and takes them, read in ranges of pages and written in bulk requests.

    spark.dataSource.register(Pages)
    spark.read.format("pages").schema("natural_key string, n int").load(path)
    df.write.format("pages").mode("append").save(path)

Reading: a partition is a range of pages, and with the option filters equalities are tried while pages are read; spark.sql.python.filterPushdown.enabled must then be on. Writing: each task writes requests of at most
BULK rows to a folder of its own; when all tasks are done their requests become pages, and if one fails none does. A request is named by the keys that it carries, so one that has
landed before, as when a commit broke off and is tried again, is not taken twice. Paths are any that pyarrow reaches.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .records import BULK_MAX

PAGES, STAGED = "pages", "_staged"
#: Pages that a task reads.
RANGE = 32


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def pages(path: str) -> list[str]:
    """Names of a folder's pages in order."""
    files, base = _store(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/{PAGES}", allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.endswith(".json"))


@dataclass
class Range(InputPartition):
    names: list[str]


class PagesReader(DataSourceReader):
    def __init__(self, path: str, schema, per: int):
        self.path, self.schema, self.per, self.equal = path, to_arrow_schema(schema), per, []

    def partitions(self) -> list[Range]:
        names = pages(self.path)
        return [Range(names[i : i + self.per]) for i in range(0, len(names), self.per)] or [Range([])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        files, _ = _store(self.path)
        parse = pj.ParseOptions(explicit_schema=self.schema, unexpected_field_behavior="ignore")
        for name in part.names:
            with files.open_input_stream(name) as stream:
                if not (raw := stream.read()).strip():
                    continue
            table = pj.read_json(pa.BufferReader(raw), pj.ReadOptions(block_size=max(1 << 20, len(raw) + 1)), parse).select(self.schema.names)
            for column, value in self.equal:
                table = table.filter(pc.equal(table.column(column), pa.scalar(value, self.schema.field(column).type)))
            yield from table.to_batches()


class FilteredReader(PagesReader):
    """Spark refuses a reader that takes filters where the session does not push them, so it is one of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.schema.names and isinstance(f.value, str | int | bool):
                self.equal.append((f.attribute[0], f.value))
            else:
                yield f


@dataclass
class Requests(WriterCommitMessage):
    staged: list[tuple[str, str]]  # where a request lies, and the page that it becomes


class PagesWriter(DataSourceWriter):
    def __init__(self, path: str, schema, size: int, key: str):
        if not 1 <= size <= BULK_MAX:
            raise ValueError(f"a request carries 1 to {BULK_MAX} rows")
        if key not in schema.names:
            raise ValueError(f"rows need a {key}")
        self.path, self.names, self.size, self.key, self.job = path, schema.names, size, key, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Requests:
        files, base = _store(self.path)
        folder = f"{base}/{STAGED}/{self.job}/{uuid.uuid4().hex}"  # of this attempt of a task
        files.create_dir(folder, recursive=True)
        staged, held = [], []

        def send():
            name = hashlib.sha256("\n".join(sorted(str(r[self.key]) for r in held)).encode()).hexdigest()
            with files.open_output_stream(f"{folder}/{len(staged)}.json") as out:
                out.write("".join(json.dumps({c: r[c] for c in self.names}, ensure_ascii=False, default=str) + "\n" for r in held).encode())
            staged.append((f"{folder}/{len(staged)}.json", f"{base}/{PAGES}/{name}.json"))
            held.clear()

        for row in rows:
            held.append(row)
            if len(held) == self.size:
                send()
        if held:
            send()
        return Requests(staged)

    def commit(self, messages: list[Requests | None]) -> None:
        files, base = _store(self.path)
        files.create_dir(f"{base}/{PAGES}", recursive=True)
        for message in messages:
            for lies, page in message.staged if message else []:
                if files.get_file_info(page).type == fs.FileType.NotFound:
                    files.move(lies, page)
        files.delete_dir(f"{base}/{STAGED}/{self.job}")

    def abort(self, messages: list[Requests | None]) -> None:
        files, base = _store(self.path)
        if files.get_file_info(f"{base}/{STAGED}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{STAGED}/{self.job}")


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self):
        raise ValueError("pages are read with a schema that is given")

    def reader(self, schema) -> PagesReader:
        kind = FilteredReader if self.options.get("filters", "false") == "true" else PagesReader
        return kind(self.options["path"], schema, int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> PagesWriter:
        if overwrite:
            raise ValueError("pages are appended")
        return PagesWriter(self.options["path"], schema, int(self.options.get("size", BULK_MAX)), self.options.get("key", "natural_key"))


def read(spark, path: str, schema: str) -> DataFrame:
    """A folder's rows; a full export where nothing is asked of it. Equalities are left to the reader where the session pushes filters to Python sources."""
    spark.dataSource.register(Pages)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("pages").schema(schema).option("filters", pushed).load(path)


def write_missing(df: DataFrame, path: str, key: str = "natural_key", size: int = BULK_MAX) -> None:
    """Writes the rows of df whose key is not stored, one of each key (the least row), in requests in order of keys. What conflicts with stored keys is thus left out of every request, and the rest of it written."""
    spark = df.sparkSession
    spark.dataSource.register(Pages)
    kind = dict(df.dtypes)[key]
    fresh = df.where(F.col(key).isNotNull())
    if pages(path):
        fresh = fresh.join(read(spark, path, f"`{key}` {kind}").distinct(), key, "left_anti")
    one = fresh.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in df.columns])).alias("row")).select("row.*")
    ordered = one.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ordered.write.format("pages").option("key", key).option("size", size).mode("append").save(path)
