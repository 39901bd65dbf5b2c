"""Readers and writers: delimited files, curated Parquet, event logs, ledgers, grids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import expr
from tabulon.operators import relational as R
from tabulon.operators.cleaning import clean_headers

SNIFFED = "path string, encoding string, delimiter string, header array<string>"
_SAMPLE = 4 << 20


def sniff_bytes(content: bytes, path: str) -> tuple[str, str, list[str]]:
    """Encoding, delimiter and header of the start of a file."""
    import csv

    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding = "utf-16"
    else:
        for encoding in ("utf-8-sig", "cp1252", "latin-1"):
            try:
                content.decode(encoding)
                break
            except UnicodeDecodeError as e:
                if encoding == "utf-8-sig" and e.start > len(content) - 4 and len(content) >= _SAMPLE:
                    break  # the sample ends within a character
    lines = [x for x in content.decode(encoding, "ignore").splitlines() if x.strip()][:25]
    if path.lower().endswith(".tsv"):
        best = "\t"
    else:

        def rank(d: str) -> tuple[float, int]:
            widths = [len(r) for r in csv.reader(lines, delimiter=d)]
            return (sum(w == widths[0] for w in widths) / len(widths), widths[0]) if widths and widths[0] > 1 else (0.0, 0)

        best = max(",;\t|", key=lambda d: (rank(d), d == ","))
    return encoding, best, next(csv.reader(lines[:1], delimiter=best), [])


def sniff_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, encoding, delimiter, header``, one row per file, from its first 4 MB.

    Paths and sizes are listed; the heads are read and judged by tasks, each
    through the store's own client. Where a store has none outside Spark, tasks
    get the file's content from Spark instead.
    """
    listed = spark.read.format("binaryFile").load(paths)
    near = F.regexp_extract("path", "^([a-z0-9]+):", 1).isin(*_CLIENTS)
    head = lambda path, _: _head(path)
    whole = lambda _, content: bytes(content)[:_SAMPLE]
    by_client = listed.filter(near).select("path", F.lit(None).cast("binary").alias("content")).mapInPandas(_sniffer(head), SNIFFED)
    return by_client.unionByName(listed.filter(~near).select("path", "content").mapInPandas(_sniffer(whole), SNIFFED))


def _sniffer(head):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(p, *sniff_bytes(head(p, c), p)) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame(found, columns=["path", "encoding", "delimiter", "header"])

    return run


#: Stores that pyarrow opens by their URI.
_CLIENTS = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _head(uri: str) -> bytes:
    """The first 4 MB of a file."""
    from pyarrow import fs

    # Hadoop writes local files as file:/a and names S3 after its own client.
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri.replace("s3a://", "s3://", 1)
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read(_SAMPLE)


_JAVA = {"utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1", "utf-16": "UTF-16"}


def _odd_quotes(lines: DataFrame) -> DataFrame:
    return lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1)


def has_quoted_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some line holds an odd number of quotes, as the lines of a cell with a line break do."""
    return _odd_quotes(spark.read.text(path)).limit(1).count() > 0


def read_delimited(spark: SparkSession, path: str | list[str], header: list[str], delimiter: str = ",", encoding: str = "utf-8-sig", multiline: bool | None = None) -> DataFrame:
    """All-text rows with ``_corrupt`` set on rows of another width; cells trimmed, blank rows dropped.

    Files whose cells hold no line breaks are split over many tasks; with line
    breaks a file is one task. Unless told, the lines' quotes are counted to tell.
    """
    names = clean_headers(header)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_corrupt", T.StringType())])
    if multiline is None:
        multiline = encoding == "utf-16" or has_quoted_breaks(spark, path)
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", delimiter)
        .option("encoding", _JAVA.get(encoding, encoding))
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
    )
    cells = [expr.strip(F.col(f"`{n}`")).alias(n) for n in names]
    blank = F.concat_ws("", *[F.col(f"`{n}`") for n in names]) == ""
    return raw.select(*cells, "_corrupt").filter(~blank)


def malformed_lines(spark: SparkSession, path: str | list[str], width: int, delimiter: str = ",") -> DataFrame:
    """``file, line, fields`` of data lines whose number of fields is not ``width``; the header is line 1.

    A block of a file is read in order by one task, so a line's number is the
    count of lines in the blocks before it, and its place in its own. Blank lines
    are counted but not told. Files without line breaks in cells.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quoted = r'"(?:[^"]|"")*"'
    fields = F.regexp_count(F.regexp_replace("value", quoted, ""), F.lit(re.escape(delimiter))) + 1
    blank = F.regexp_replace("value", rf'[\s"{re.escape(delimiter)}]', "") == ""
    bad = lines.withColumn("fields", fields).filter((F.col("fields") != width) & ~blank)
    numbered = bad.join(blocks.withColumn("before", before), ["file", "block"])
    return numbered.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "fields").filter("line > 1")


def malformed_counts(df: DataFrame) -> DataFrame:
    """One row: ``rows`` of the header's width, ``malformed`` ones, and their ``share``."""
    bad = F.count_if(F.col("_corrupt").isNotNull() & F.lit(True))
    n = df.select("_corrupt", *df.columns[:1]).agg((F.count(F.lit(1)) - bad).alias("rows"), bad.alias("malformed"))
    return n.withColumn("share", F.round(F.coalesce(F.try_divide("malformed", F.col("rows") + F.col("malformed")), F.lit(0.0)), 6))


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the header's width, and the others."""
    return df.filter("_corrupt is null").drop("_corrupt"), df.filter("_corrupt is not null")


def repair_row_width(df: DataFrame) -> DataFrame:
    """Keep rows of another width: short ones padded with null, long ones cut."""
    return df.drop("_corrupt")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its ending, else delimited text as sniffed."""
    if path.rstrip("/").endswith(".parquet"):
        return read_curated(spark, path)
    found = sniff_files(spark, [path]).first()
    return split_malformed(read_delimited(spark, path, found["header"], found["delimiter"], found["encoding"]))[0]


def read_curated(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table without bookkeeping columns, in the engine's plain types."""
    df = spark.read.parquet(path)
    shown = [c for c in df.columns if not c.startswith("__")]
    if unknown := [c for c in columns or [] if c not in shown]:
        raise ValueError(f"unknown columns: {unknown}")

    def plain(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal") or kind in ("float", "double"):
            return expr.finite(c.cast("double")).alias(name)
        if kind in ("boolean", "date") or kind.startswith("timestamp"):
            return c.cast("string").alias(name)
        return (c.cast("bigint") if kind in ("tinyint", "smallint", "int") else c).alias(name)

    kinds = dict(df.dtypes)
    return df.select(*[plain(c, kinds[c]) for c in columns or shown])


# The fields of an event and of a load record, with their types.
EVENT_FIELDS = {
    "event": "string", "ts": "timestamp", "host": "string", "project_id": "string", "user_id": "string", "dataset": "string", "load_id": "string", "request_id": "string",
    "status": "string", "stage": "string", "mode": "string", "source": "string", "tool": "string", "routing_tier": "string", "model": "string", "error_type": "string",
    "duration_ms": "bigint", "turns": "bigint", "tool_calls": "bigint", "input_tokens": "bigint", "output_tokens": "bigint", "estimated_cost_usd": "double",
    "verification_passed": "boolean", "rows_in": "bigint", "rows_out": "bigint", "rows_rejected": "bigint", "raw_bytes": "bigint", "quality_status": "string",
}
LEDGER_SCHEMA = (
    "load_id string, project_id string, dataset string, mode string, source string, status string, stage string, created_at string, finished_at string, raw_bytes string, duration_ms string, "
    "counts struct<rows_in:string,rows_out:string,rows_rejected:string>, quality struct<status:string>, error struct<type:string,message:string>, snapshot_id string"
)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed events of JSON lines; a field that does not fit is null, a row without ``event`` goes."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    text = T.StructType([T.StructField(n, T.StringType()) for n in EVENT_FIELDS])
    raw = spark.read.schema(text).option("recursiveFileLookup", True).json(path) if fs.exists(jvm_path) else spark.createDataFrame([], text)
    rows = raw.select(*[F.col(n).try_cast(t).alias(n) for n, t in EVENT_FIELDS.items()])
    return rows.filter("event is not null").withColumn("dt", F.to_date("ts"))


def read_load_ledger(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One flat row per load record; nested counts, quality and error are pulled out.

    A file holds one record, or with ``lines`` one on each line.
    """
    raw = spark.read.schema(LEDGER_SCHEMA).option("multiLine", not lines).json(path)
    number = lambda c: F.col(c).try_cast("bigint").alias(c.rpartition(".")[2])
    return raw.filter("load_id is not null").select(
        "load_id", "project_id", "dataset", "mode", "source", "status", "stage",
        *[F.col(c).try_cast("timestamp").alias(c) for c in ("created_at", "finished_at")],
        number("raw_bytes"), number("duration_ms"), number("counts.rows_in"), number("counts.rows_out"), number("counts.rows_rejected"),
        F.col("quality.status").alias("quality_status"), F.col("error.type").alias("error_type"), "snapshot_id",
    )


#: Rows of a pull's limit that one task may sort.
_HELD = 200_000


def extract_incremental(source: DataFrame, cursor: str | None, last: object = None, limit: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Rows after the cursor, in its order, and the new cursor as one row.

    Rows that tie with the last one are taken as well, so the next pull, which
    asks for greater values, loses none. No cursor column: everything.
    """
    if cursor is None:
        return source, source.limit(0).agg(F.lit(None).cast("string").alias("cursor"))
    if cursor not in source.columns:
        raise ValueError(f"unknown cursor column: {cursor}")
    new = source.filter(F.col(cursor).isNotNull())
    if last is not None:
        new = new.filter(F.col(cursor) > F.lit(last))
    kind = source.schema[cursor].dataType
    if limit <= _HELD or not isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        end = new.select(cursor).orderBy(cursor).limit(limit).agg(F.max(cursor).alias("cursor"))
    else:  # by ranks within ranges: no task holds the rows of the limit
        at = lambda total: F.least(F.lit(limit).cast("bigint"), total) - 1
        found = R.ranked_values(new, {"cursor": F.col(cursor)}, lambda total: [at(total)])
        end = found.agg(R._element(at(F.col("total"))).alias("cursor"))
    rows = new.join(F.broadcast(end), F.col(cursor) <= F.col("cursor"), "left_semi")
    return rows, end


def sheet_snapshot(grid: DataFrame, order: str, cells: str, header: list[str]) -> DataFrame:
    """Ragged rows of cells as a table of the header's width; ``order`` numbers the rows, the least is the header."""
    first = grid.agg(F.min(order).alias("__first"))
    body = grid.join(F.broadcast(first), F.col(order) > F.col("__first"))
    return body.select(order, *[F.coalesce(F.try_element_at(cells, F.lit(k + 1)), F.lit("")).alias(n) for k, n in enumerate(clean_headers(header))])


def validate_source(files: DataFrame, sniffed: DataFrame, max_mb: int = 512, max_columns: int = 200) -> DataFrame:
    """``path, reason`` of files that cannot be loaded; ``files`` lists path and length."""
    j = files.select("path", "length").join(sniffed.select("path", "header"), "path", "left")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = (
        F.when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_mb << 20, "too_large")
        .when(~ending.isin("csv", "tsv", "txt"), "wrong_extension")
        .when(F.coalesce(F.size(F.filter("header", lambda h: h != "")), F.lit(0)) == 0, "no_header")
        .when(F.size("header") > max_columns, "too_many_columns")
    )
    return j.select("path", reason.alias("reason")).filter("reason is not null")


def write_typed_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def write_jsonl_events(df: DataFrame, path: str) -> None:
    """Gzip JSON lines by day and hour; null fields are left out."""
    rows = df.withColumn("dt", F.date_format("ts", "yyyy-MM-dd")).withColumn("hour", F.date_format("ts", "HH"))
    rows.write.partitionBy("dt", "hour").option("compression", "gzip").option("ignoreNullFields", True).mode("append").json(path)


def write_delimited(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def write_mart(df: DataFrame, name: str, root: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")


