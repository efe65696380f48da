"""What other providers plug in: a source of landing-page visits with a declared schema, and a table function over their JSON."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

VISITS = "date date, page string, visits long, valid boolean"
_VISITS = pa.schema([("date", pa.date32()), ("page", pa.string()), ("visits", pa.int64()), ("valid", pa.bool_())])
#: Lines of a file that are held at once.
LINES = 10_000


def _file_system(path: str):
    """The file system that holds a path, with or without a scheme, and the path there."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class VisitFile(InputPartition):
    def __init__(self, path: str, day: str) -> None:
        self.path, self.day = path, day


class VisitsReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options.get("path")
        if not self.path:
            raise ValueError("landing_page_visits needs a path")
        self.first, self.last = (dt.date.fromisoformat(options.get(k, otherwise)) for k, otherwise in (("startdate", "0001-01-01"), ("enddate", "9999-12-31")))
        if self.first > self.last:
            raise ValueError("startDate is after endDate")

    def partitions(self) -> list[VisitFile]:
        """A partition for each file of the days that were asked for; the names of the folders say which these are."""
        from pyarrow import fs

        files, root = _file_system(self.path)
        found = []
        for x in files.get_file_info(fs.FileSelector(root, recursive=True)):
            day = x.path.rpartition("/")[0].rpartition("/")[2].removeprefix("date=")
            if x.type == fs.FileType.File and not x.path.rpartition("/")[2].startswith((".", "_")) and self.first <= dt.date.fromisoformat(day) <= self.last:
                found.append(VisitFile(x.path, day))
        return sorted(found, key=lambda p: p.path)

    def read(self, partition: VisitFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is of these days
            return
        files, _ = _file_system(self.path)
        day, rows = dt.date.fromisoformat(partition.day), []
        with files.open_input_stream(partition.path) as stream:
            for line in _lines(stream):
                rows.append((day, *visit(line)))
                if len(rows) == LINES:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _VISITS, strict=True)], schema=_VISITS)


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while part := stream.read(size):
        *whole, rest = (rest + part).split(b"\n")
        yield from whole
    if rest:
        yield rest


def visit(line: bytes) -> tuple[str | None, int | None, bool]:
    """page, visits and whether a line is a visit: an object with a page that is text and a whole number of visits, 0 or more."""
    try:
        row = json.loads(line)
        page, visits = row["page"], row["visits"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return None, None, False
    ok = isinstance(page, str) and page != "" and isinstance(visits, int) and not isinstance(visits, bool) and 0 <= visits < 2**63
    return (page, visits, True) if ok else (None, None, False)


class LandingPageVisits(DataSource):
    """spark.read.format("landing_page_visits").load(path): JSON lines in folders date=YYYY-MM-DD, between the options startDate and
    endDate. Lines that are no visits come as rows that aren't valid."""

    @classmethod
    def name(cls) -> str:
        return "landing_page_visits"

    def schema(self) -> str:
        return VISITS

    def reader(self, schema) -> VisitsReader:
        return VisitsReader(self.options)


def visits_summary(visits: DataFrame, row_limit: int) -> DataFrame:
    """One row: returned and invalid lines, distinct valid pages and days retained up to row_limit, their visits, and the status of the
    data: partial where lines are invalid or the limit was reached."""
    valid = visits.filter("valid").groupBy("date", "page").agg(F.sum("visits").alias("visits"))
    kept = valid.orderBy(F.desc("visits"), "date", "page").limit(row_limit)
    lines = visits.agg(F.count("*").alias("returned"), F.count_if(~F.col("valid")).alias("invalid"))
    t = valid.agg(F.count("*").alias("available")).join(kept.agg(F.count("*").alias("retained"), F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"))).join(lines)  # one row each
    reached = F.col("available") > row_limit
    status = F.when(reached | (F.col("invalid") > 0), "partial").otherwise("complete")
    return t.select("returned", "invalid", "available", "retained", "visits", reached.alias("limit_reached"), status.alias("status"))


#: How large, deep and wide a provider's object may be.
MOST_BYTES, MOST_DEPTH, MOST_VALUES, MOST_ENTRIES, MOST_KEY, MOST_TEXT = 64 * 1024, 16, 5_000, 1_000, 256, 8_192


def json_rows(text: str | None) -> list[tuple[str | None, str, str | None]]:
    """(path, kind, value) of every value within a JSON object; one row of kind `refused` with the reason if it goes beyond a bound."""
    if text is None:
        return [(None, "refused", "null")]
    if len(text) > 4 * MOST_BYTES or len(text.encode()) > MOST_BYTES:
        return [(None, "refused", "bytes")]
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return [(None, "refused", "json")]
    if not isinstance(root, dict):
        return [(None, "refused", "object")]
    out, todo = [], [("$", root, 0)]
    while todo:
        path, value, depth = todo.pop()
        if depth > MOST_DEPTH or len(out) >= MOST_VALUES:
            return [(None, "refused", "depth" if depth > MOST_DEPTH else "values")]
        if isinstance(value, dict | list):
            if len(value) > MOST_ENTRIES or isinstance(value, dict) and any(len(k) > MOST_KEY for k in value):
                return [(None, "refused", "entries")]
            out.append((path, "object" if isinstance(value, dict) else "array", None))
            inner = [(f"{path}.{k}", v) for k, v in value.items()] if isinstance(value, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(value)]
            todo += [(p, v, depth + 1) for p, v in reversed(inner)]
        elif isinstance(value, str) and len(value) > MOST_TEXT or isinstance(value, float) and not math.isfinite(value):
            return [(None, "refused", "text" if isinstance(value, str) else "number")]
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
            out.append((path, kind, None if value is None else value if isinstance(value, str) else json.dumps(value)))
    return out


@udtf(returnType="path string, kind string, value string")
class JsonValues:
    """json_values(text): json_rows as a table function, for LATERAL joins."""

    def eval(self, text: str):
        yield from json_rows(text)


def register(spark: SparkSession) -> None:
    """Makes the source and the table function known to a session."""
    spark.dataSource.register(LandingPageVisits)
    spark.udtf.register("json_values", JsonValues)
