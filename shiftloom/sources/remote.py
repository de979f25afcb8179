"""Tables and models behind HTTP, with JSON both ways.

``spark.read.format("remote_table").option("url", ..).option("table", ..)`` scans a table page by page. The server answers

    GET URL/TABLE?where=W                 {"schema": DDL, "rows": number of rows}
    GET URL/TABLE?where=W&offset=O&limit=L&columns=C    {"rows": [[..], ..]}, in an order that stays

where W is a JSON list of [op, column, value] that all must hold. Tasks read ``pages_per_task`` pages of ``page`` rows each,
so the driver sees no row; with the option ``pushdown`` the server gets the filters that it can apply (the session's
``spark.sql.python.filterPushdown.enabled`` must be set then; ``read_remote`` asks it). ``posted`` sends rows of a DataFrame to an endpoint in batches and reads rows back (a model behind a server).

A request that fails (no connection, time-out, a 5xx answer, an answer that isn't JSON or has fewer rows than it must) is made
again up to ``retries`` times, after 1, 2, 4 .. times ``wait`` seconds; a 4xx answer is an error at once. Tasks may be run
again: requests must not change what the server holds. Empty tables: no rows.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

PAGE, PAGES_PER_TASK, TIMEOUT, RETRIES, WAIT = 1000, 16, 600.0, 4, 0.5
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNull: "null", IsNotNull: "not null", StringStartsWith: "starts"}


class Refused(Exception):
    """The server's answer won't change by asking again."""


def asked(url: str, body: dict | None, timeout: float, retries: int, wait: float, good: Callable[[Any], bool] = lambda x: True) -> Any:
    """The JSON that the server answers, once it is ``good``."""
    data = None if body is None else json.dumps(body).encode()
    for turn in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                out = json.loads(answer.read())
            if good(out):
                return out
            why = "the answer lacks rows"
        except urllib.error.HTTPError as e:
            if e.code < 500:
                raise Refused(f"{url}: {e.code} {e.reason}") from e
            why = f"{e.code} {e.reason}"
        except (OSError, ValueError) as e:  # no connection, time-out, cut off, not JSON
            why = str(e)
        if turn < retries:
            time.sleep(wait * 2**turn)
    raise OSError(f"{url}: {why}, {retries + 1} times")


def from_json(value: Any, kind: T.DataType) -> Any:
    """A JSON value as one of a column's type: times in ISO form, binary in Base64."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [from_json(x, kind.elementType) for x in value]
    if isinstance(kind, T.StructType):
        return {f.name: from_json(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.MapType):
        return [(from_json(k, kind.keyType), from_json(x, kind.valueType)) for k, x in value.items()]
    if isinstance(kind, T.TimestampType):
        at = datetime.datetime.fromisoformat(value)
        return at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
    if isinstance(kind, T.TimestampNTZType):
        return datetime.datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value))
    if isinstance(kind, T.BinaryType):
        return base64.b64decode(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    return value


class Pages(InputPartition):
    def __init__(self, offset: int, rows: int) -> None:
        self.offset, self.rows = offset, rows


class RemoteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.columns, self.where = schema, []
        self.url = f"{options['url'].rstrip('/')}/{urllib.parse.quote(options['table'], safe='')}"
        self.page, self.pages_per_task = int(options.get("page", PAGE)), int(options.get("pages_per_task", PAGES_PER_TASK))
        self.calls = float(options.get("timeout", TIMEOUT)), int(options.get("retries", RETRIES)), float(options.get("wait", WAIT))

    def get(self, good: Callable[[Any], bool], **more: Any) -> Any:
        query = urllib.parse.urlencode({"where": json.dumps(self.where), **more})
        return asked(f"{self.url}?{query}", None, *self.calls, good)

    def partitions(self) -> list[Pages]:
        rows, step = self.get(lambda x: "rows" in x)["rows"], self.page * self.pages_per_task
        return [Pages(at, min(step, rows - at)) for at in range(0, rows, step)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.columns)
        for at in range(partition.offset, partition.offset + partition.rows, self.page):
            many = min(self.page, partition.offset + partition.rows - at)
            rows = self.get(lambda x: len(x["rows"]) == many, offset=at, limit=many, columns=",".join(self.columns.names))["rows"]  # noqa: B023
            columns = [pa.array([from_json(r[k], f.dataType) for r in rows], schema.field(k).type) for k, f in enumerate(self.columns.fields)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class FilteringReader(RemoteReader):
    """Hands the server what it can filter."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            value = getattr(f, "value", None)
            plain = all(x is None or isinstance(x, (str, int, float, bool)) for x in (value if isinstance(value, (list, tuple)) else [value]))
            if type(f) in OPERATORS and len(f.attribute) == 1 and plain:
                self.where.append([OPERATORS[type(f)], f.attribute[0], list(value) if isinstance(value, tuple) else value])
            else:
                yield f


class RemoteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_table"

    def schema(self) -> str:
        reader = RemoteReader(T.StructType(), self.options)
        return reader.get(lambda x: "schema" in x)["schema"]

    def reader(self, schema: T.StructType) -> RemoteReader:
        kind = FilteringReader if self.options.get("pushdown") == "true" else RemoteReader
        return kind(schema, dict(self.options))


def read_remote(spark: SparkSession, url: str, table: str, **options: object) -> DataFrame:
    spark.dataSource.register(RemoteTable)
    options = {"pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | options
    reader = spark.read.format("remote_table").option("url", url).option("table", table)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def posted(df: DataFrame, url: str, schema: str, batch: int = 64, timeout: float = TIMEOUT, retries: int = RETRIES, wait: float = WAIT) -> DataFrame:
    """Rows that a server makes from rows: {"rows": [{column: value}, ..]} goes there, {"rows": [[..], ..]} comes back."""
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for held in batches:
            for at in range(0, len(held), batch):
                rows = asked(url, {"rows": held.slice(at, batch).to_pylist()}, timeout, retries, wait, lambda x: "rows" in x)["rows"]
                yield pa.RecordBatch.from_arrays([pa.array([from_json(r[k], f.dataType) for r in rows], arrow.field(k).type) for k, f in enumerate(out.fields)], schema=arrow)

    return df.mapInArrow(run, out)
