"""Files of other tools: what their first line says of them, lists of objects, and CSV as others read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t", "|"]


def delimiter_of(header: str) -> str:
    """The candidate that the header has most often outside quotes; of those that tie, the first of the list."""
    bare = "".join(header.split('"')[::2])
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


def encoding_of(head: bytes) -> str:
    """By the byte order mark: UTF-16 of either order, else UTF-8. UTF-32 is refused."""
    if head.startswith((b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff")):
        raise ValueError("UTF-32 files can't be read")
    return "UTF-16LE" if head.startswith(b"\xff\xfe") else "UTF-16BE" if head.startswith(b"\xfe\xff") else "UTF-8"


#: Bytes of a file that are looked at.
HEAD_BYTES = 65_536


def heads(spark: SparkSession, path: str) -> dict[str, bytes]:
    """The first bytes of a file, or of each file of a folder, from any store that Spark reads. Hidden and empty files are left out."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(sc._jsc.hadoopConfiguration())
    found = {}
    for status in store.globStatus(root) or []:
        for f in store.listStatus(status.getPath()):
            if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
                stream = store.open(f.getPath())
                found[f.getPath().toString()] = bytes(stream.readNBytes(HEAD_BYTES))
                stream.close()
    return found


def read_export(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV files with a header, each of the delimiter and encoding that its own first bytes show; all columns are strings.

    Columns that a file lacks are null in its rows. Cells with line breaks need multi_line, with which a file is read by one task. A
    folder without files gives an empty table without columns.
    """
    alike: dict[tuple[str, str, str], list[str]] = {}
    for name, head in sorted(heads(spark, path).items()):
        encoding = encoding_of(head)
        first = head[: len(head) // 2 * 2 if encoding != "UTF-8" else len(head)].decode(encoding, errors="ignore").lstrip("\ufeff").split("\n")[0].rstrip("\r")
        alike.setdefault((encoding, delimiter_of(first), first), []).append(name)
    out = None
    for (encoding, delimiter, _), names in alike.items():
        lines = {} if encoding == "UTF-8" or multi_line else {"lineSep": "\n"}
        rows = spark.read.options(**lines).csv(names, header=True, sep=delimiter, multiLine=multi_line, quote='"', escape='"', inferSchema=False, encoding=encoding)
        rows = rows.toDF(*[c.lstrip("\ufeff").rstrip("\r") for c in rows.columns])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], "value string").drop("value") if out is None else out


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file that holds one list of them."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_csv(rows: DataFrame, path: str) -> None:
    """A header, quotes where cells need them, doubled inside; nulls are empty cells. Nested columns become JSON."""
    nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    rows.withColumns({c: F.to_json(c) for c in nested}).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
