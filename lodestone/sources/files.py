"""Files of rows: tables by suffix, lines of JSON, and tagged tokens."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are decoded at a time.
_PIECE = 1 << 20

#: What a CSV file may be written in, the first that all its bytes fit.
ENCODINGS = ("utf-8", "gb18030")


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, header of each file: the first encoding that all its bytes fit, null if none does, and its first record."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch["content"]:
                data = content.as_buffer()
                encoding = next((e for e in ENCODINGS if _fits(data, e)), None)
                found.append((encoding, next(_records(data, encoding), []) if encoding else None))
            names = [pa.array([e for e, _ in found], pa.string()), pa.array([h for _, h in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch["path"], *names], ["path", "encoding", "header"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(told, "path string, encoding string, header array<string>")


def _fits(data: pa.Buffer, encoding: str) -> bool:
    decoder = codecs.getincrementaldecoder(encoding)("strict")
    try:
        for at in range(0, max(1, len(data)), _PIECE):
            decoder.decode(data.slice(at, min(_PIECE, len(data) - at)).to_pybytes(), at + _PIECE >= len(data))
    except UnicodeDecodeError:
        return False
    return True


def _records(data: pa.Buffer, encoding: str) -> Iterator[list[str]]:
    lines = io.TextIOWrapper(pa.BufferReader(data), encoding=encoding.replace("utf-8", "utf-8-sig"), newline="")
    return csv.reader(lines)


def _decoded(spark: SparkSession, paths: list[str], encoding: str, header: list[str]) -> DataFrame:
    """Files of one header in an encoding that Spark's own reader doesn't take; records leave a task as they are read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                records = islice(_records(content.as_buffer(), encoding), 1, None)
                while part := list(islice(records, 10_000)):
                    cells = [[(r[i] or None) if i < len(r) else None for r in part if r] for i in range(len(header))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names)

    names = [f"c{i}" for i in range(len(header))]
    whole = spark.read.format("binaryFile").load(paths).select("content")
    return whole.mapInArrow(rows, ", ".join(f"{n} string" for n in names)).toDF(*header)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as they are written; an empty cell is null. Columns of all files by name.

    Each file of a folder is UTF-8, with or without a byte order mark, or else GB18030, as its own bytes say; one that
    is neither is an error. Spark reads and splits UTF-8; a file in the other encoding is one task's work.
    """
    files = encodings(spark, path).collect()  # names and headers of files, not their content
    broken = sorted(r["path"] for r in files if r["encoding"] is None)
    if broken:
        raise ValueError(f"neither {' nor '.join(ENCODINGS)}: {', '.join(broken[:5])}")
    groups: dict[tuple, list[str]] = {}
    for r in files:
        groups.setdefault((ENCODINGS.index(r["encoding"]), tuple(r["header"])), []).append(r["path"])
    frames = []
    for (nth, header), paths in sorted(groups.items()):
        if nth:
            frames.append(_decoded(spark, sorted(paths), ENCODINGS[nth], list(header)))
        else:
            rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(sorted(paths))
            frames.append(rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: csv, parquet, json (an array) or jsonl; ValueError for any other."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("json", "jsonl"):
        return read_json(spark, path)
    raise ValueError(f"no reader for files of this kind: {path}")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line: lines of a JSONL file that aren't objects, blank ones left aside."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    whole = F.try_parse_json("line")
    return lines.where((F.trim("line") != "") & (whole.isNull() | ~F.startswith(F.ltrim("line"), F.lit("{"))))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """sentence, at, token, tag: a token and its tag a line, a blank line after each sentence; a token alone is O."""
    sentences = spark.read.option("lineSep", "\n\n").text(path).where(F.btrim("value", F.lit("\n ")) != "").withColumn("sentence", F.monotonically_increasing_id())
    lines = sentences.select("sentence", F.posexplode(F.split(F.btrim("value", F.lit("\n")), "\n")).alias("at", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select("sentence", "at", F.element_at(parts, 1).alias("token"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("O").alias("tag"))


def write_tagged(tokens: DataFrame, path: str) -> None:
    """The same form: sentences of (at, token, tag), each a text of its lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "token", "tag"))), lambda t: F.concat_ws(" ", t["token"], t["tag"]))
    tokens.groupBy("sentence").agg(F.concat(F.array_join(lines, "\n")).alias("value")).select("value").write.option("lineSep", "\n\n").text(path)


_LOG = "version long, columns array<string>, whole boolean"


def append_version(rows: DataFrame, path: str, version: int, whole: bool = False) -> None:
    """Rows as one version of a keyed store: whole rows, or the key and the columns that change.

    The rows are written to a folder of the version's own, and only then does the store's log name it. A write that fails
    leaves the store as it was; writing a version again changes nothing. whole: the rows are all there is, so readers
    need no earlier version.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/of={version}")
    spark.createDataFrame([(version, rows.columns, whole)], _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def read_latest(spark: SparkSession, path: str, key: list[str], upto: int | None = None) -> DataFrame:
    """Of each key the newest value of each column, and the newest version that has the key.

    A column keeps its value through versions that don't have it; a null that a version writes is a value. upto: as the
    store was at that version. One aggregate by key over the named versions; a filter on the key reaches their scans.
    """
    log = spark.read.schema(_LOG).parquet(f"{path}/log").distinct().orderBy("version").collect()
    log = [r for r in log if upto is None or r["version"] <= upto]
    first = max((r["version"] for r in log if r["whole"]), default=None)
    named = {r["version"]: r["columns"] for r in log if first is None or r["version"] >= first}
    if not named:
        raise ValueError(f"no version at {path}")
    frames = [spark.read.parquet(f"{path}/of={v}").select(*columns).withColumn("_version", F.lit(v)) for v, columns in named.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    rest = [c for c in rows.columns if c not in (*key, "_version")]
    holds = lambda c: F.when(F.col("_version").isin([v for v, columns in named.items() if c in columns]), F.col("_version"))
    newest = [F.max_by(F.struct(c), holds(c))[c].alias(c) for c in rest]
    return rows.groupBy(*key).agg(*newest, F.max("_version").alias("version"))


def compact(spark: SparkSession, path: str, key: list[str], version: int) -> None:
    """All that the store says as one whole version, after which earlier ones aren't read."""
    append_version(read_latest(spark, path, key).drop("version"), path, version, whole=True)


def write_sheets(sheets: dict[str, DataFrame], path: str, rows_per_file: int = 50_000) -> None:
    """A report of several tables: a folder of CSV files each, none with more rows than that, names in the first row."""
    for name, rows in sheets.items():
        plain = rows.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, kind in rows.dtypes))
        plain.write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", rows_per_file).csv(f"{path}/{name}.csv")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects of files that are a JSON array or lines of JSON, told by each file's first character.

    Arrays are parsed whole, a file a task; lines are split.
    """
    heads = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.substring(F.ltrim("value"), 1, 1).alias("first"))
    files = heads.groupBy("first").agg(F.collect_list("path").alias("paths")).collect()
    frames = []
    for array in (True, False):
        own = sorted(p for r in files if (r["first"] == "[") == array for p in r["paths"])
        if own:
            frames.append(spark.read.option("multiLine", array).json(own))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_number, line: lines of JSON files that aren't objects, with their numbers from 1, blank ones left aside."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("nth", "line"))
    bad = F.try_parse_json("line").isNull() | ~F.startswith(F.ltrim("line"), F.lit("{"))
    return whole.where((F.trim("line") != "") & bad).select("file", (F.col("nth") + 1).alias("line_number"), "line")
