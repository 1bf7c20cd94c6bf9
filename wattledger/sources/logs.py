"""Reading and landing raw accounting logs."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import job_id, null_if_na, submit_timestamp
from ..functions.sql import name, quoted
from ..operators.filters import parse_period
from ..schemas import LOG_LACKS, LOG_SEQ, OPTIONAL_RAW_FIELDS, RAW_FIELDS, require_columns

# Day a log row was submitted; landed logs are laid out by it.
SUBMIT_DAY = "SubmitDay"


def _csv_options(sep: str) -> dict:
    # Quotes are doubled inside quoted fields; a backslash is an ordinary character.
    return {"sep": sep, "header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _position() -> Column:
    """Position of a row in the log: file, block of the file, row within the task.

    Rows of a block are read in order by one task, so this orders the rows of a
    file as they stand in it however the file was split, and files by path.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _header_of(spark: SparkSession, paths: list[str], sep: str) -> list[str]:
    """Column names as they stand in the first file; reads one line."""
    return spark.read.options(**_csv_options(sep)).csv(paths).columns


def read_logs(spark: SparkSession, paths: str | Sequence[str], sep: str = "|") -> DataFrame:
    """Delimited log files with a header: every field as text, missing values as NULL.

    ``paths`` may be files, directories or globs. The header decides which
    columns there are and every file is checked against it; see
    ``read_mixed_logs`` for files of different age. Files are split into blocks and read in parallel; columns that
    are not used are not parsed. A position column orders the rows, unless the
    log brings its own.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _read(spark, paths, _header_of(spark, paths, sep), sep)


def _read(spark: SparkSession, paths: list[str], header: Sequence[str], sep: str) -> DataFrame:
    """Files that all have this header."""
    names = [n for n in header if n != SUBMIT_DAY]
    require = [f for f in RAW_FIELDS if f not in OPTIONAL_RAW_FIELDS]
    missing = [f for f in require if f not in names]
    if missing:
        raise ValueError(f"the log lacks the columns {missing}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).options(**_csv_options(sep), enforceSchema="false").csv(paths)
    fields = [f"{null_if_na(name(n))} AS {name(n)}" for n in names if n != LOG_SEQ]
    position = F.col(LOG_SEQ).cast("bigint") if LOG_SEQ in names else _position()
    return rows.select(position.alias(LOG_SEQ), *[F.expr(text) for text in fields])


# Headers that are read at the same time; each is a job of one task that stops after a line.
_HEADER_THREADS = 16


def headers(spark: SparkSession, files: Sequence[str], sep: str = "|", in_order: bool = False) -> dict[str, tuple[str, ...]]:
    """File -> column names; a file without a line has none.

    One job of one line per file, so the cost grows with the number of files and
    not with their size. With ``in_order`` the header is taken to change now and
    then along the sorted files, as it does in a log that is written day by day:
    what lies between two files with one header has it too, and only the changes are
    searched for. The reader checks every file's header, so a wrong guess stops it.
    """
    files = sorted(files)
    found: dict[str, tuple[str, ...]] = {}

    def look(some: Sequence[str]) -> None:
        with ThreadPool(_HEADER_THREADS) as pool:
            found.update(zip(some, pool.map(lambda f: tuple(_header_of(spark, [f], sep)), some), strict=True))

    if not in_order:
        look(files)
        return found
    spans = [(0, len(files) - 1)] if files else []
    look([files[i] for i in {i for span in spans for i in span}])
    while spans:
        open_ = []
        for a, b in spans:
            if found[files[a]] == found[files[b]]:
                found.update((files[i], found[files[a]]) for i in range(a + 1, b))
            elif b - a > 1:
                open_ += [(a, (a + b) // 2), ((a + b) // 2, b)]
        look([files[b] for _, b in open_[::2]])
        spans = open_
    return found


def read_mixed_logs(spark: SparkSession, paths: str | Sequence[str], sep: str = "|", in_order: bool = False) -> DataFrame:
    """Log files of different age in one table: ``read_logs`` for files whose headers differ.

    Files with one header are read together, so there is one scan per header and not
    per file; columns are matched by name, in whatever order a file has them. The
    column ``log_lacks`` names the optional fields that the file of a row does not
    have; ``operators.steps`` decides the defaults by it, row by row. Fields that only
    some files have are NULL in the others. Files without a line are left out.
    The driver holds the path and the header of each file (``headers``, which also
    explains ``in_order``), about as much as Spark's own list of files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    # Lists the files; their content is not read.
    files = [row.path for row in spark.read.format("binaryFile").load(paths).select("path").toLocalIterator()]
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers(spark, files, sep, in_order).items():
        if names:
            by_header.setdefault(names, []).append(file)
    if not by_header:
        raise ValueError("no file has a header")
    parts, whole = [], set()
    for names, group in sorted(by_header.items()):
        lacks = [f for f in OPTIONAL_RAW_FIELDS if f not in names]
        marker = F.expr(f"CAST(array({quoted(lacks)}) AS ARRAY<STRING>)").alias(LOG_LACKS)
        parts.append(_read(spark, sorted(group), names, sep).select("*", marker))
        whole.add(LOG_SEQ in names)
    if len(whole) > 1:
        raise ValueError(f"some files bring a {LOG_SEQ} and others do not, so their rows have no common order")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for field in OPTIONAL_RAW_FIELDS:  # no file has it
        if field not in out.columns:
            out = out.withColumn(field, F.lit(None).cast("string"))
    return out


def parse_lines(lines: DataFrame, names: Sequence[str], sep: str = "|") -> DataFrame:
    """Lines of a log that come from elsewhere than files, in the column ``line``, under the same rules as ``read_logs``.

    Every other column is kept, among them the position of the line.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {k: v for k, v in _csv_options(sep).items() if k != "header"}
    rows = lines.withColumn("line", F.from_csv("line", schema.toDDL(), options)).select(
        *[c for c in lines.columns if c != "line"], "line.*")
    return rows.selectExpr(*[name(c) for c in lines.columns if c != "line"], *[f"{null_if_na(name(n))} AS {name(n)}" for n in names])


def to_line(fields: Sequence[str], missing: str, sep: str = "|") -> str:
    """Expression of the line that holds these fields, quoted throughout; ``missing`` is what stands for NULL, unquoted."""
    quote = "'\"'"
    parts = [f"coalesce({quote} || replace({name(f)}, {quote}, '\"\"') || {quote}, {missing})" for f in fields]
    return f"concat_ws('{sep}', {', '.join(parts)})"


def land_logs(logs: DataFrame, path: str, fmt: str = "parquet", by_day: bool = True, sep: str = "|") -> None:
    """Keep a copy of the raw log, for replay or for inspection.

    By day of submission, so that later reads skip other days. Rows are
    rebalanced by day before writing: a busy day is split over many files, quiet
    days do not leave one small file per task. Rows whose day cannot be read are
    kept under the NULL day. Next to it, in ``spans_path``, go the days of jobs with
    rows on several days (``day_spans``), which reading a period needs. Text formats cannot hold a composite position
    column; it is left out there and made anew on reading.
    """
    if fmt not in ("parquet", "orc", "csv"):
        raise ValueError(f"cannot land a log as {fmt!r}")
    if fmt == "csv" and isinstance(logs.schema[LOG_SEQ].dataType, T.StructType):
        logs = logs.drop(LOG_SEQ)
    if by_day:
        logs = logs.withColumn(SUBMIT_DAY, submit_day()).hint("rebalance", SUBMIT_DAY)
    writer = logs.write.mode("errorifexists")
    if by_day:
        writer = writer.partitionBy(SUBMIT_DAY)
    if fmt == "csv":
        writer = writer.options(sep=sep, header="true", quote='"', escape='"', emptyValue="")
    writer.format(fmt).save(path)
    if by_day and fmt != "csv":
        landed = logs.sparkSession.read.format(fmt).schema(logs.schema).load(path)
        # Cut by day into files of sensible size, not into a folder per day: tasks times days would be a great many files.
        spans = day_spans(landed).repartitionByRange(SUBMIT_DAY, "job").sortWithinPartitions(SUBMIT_DAY)
        spans.write.mode("errorifexists").parquet(spans_path(path))


def spans_path(path: str) -> str:
    """Where the index of a landed log is."""
    return f"{path.rstrip('/')}-spans"


def day_spans(landed: DataFrame) -> DataFrame:
    """(job, first_day, last_day, SubmitDay) of a log with days: every further day of jobs with rows on several days.

    One roll-up of two short columns, and a second read of them for the days of the
    few jobs that it leaves. Rows without a day are not part of it.
    """
    rows = landed.filter(F.col(SUBMIT_DAY).isNotNull()).selectExpr(f"{job_id('JobID')} AS job", SUBMIT_DAY)
    ends = rows.groupBy(F.col("job").alias("_job")).agg(F.min(SUBMIT_DAY).alias("first_day"), F.max(SUBMIT_DAY).alias("last_day"))
    spread = ends.filter("first_day < last_day")
    days = rows.join(spread, F.expr("job <=> _job")).filter(f"{SUBMIT_DAY} > first_day")
    return days.select("job", "first_day", "last_day", SUBMIT_DAY).distinct()


_SPANS = f"job string, first_day date, last_day date, {SUBMIT_DAY} date"


# Column that a bucketed log is dealt out by.
JOB = "single_jobID"


# Rows of a log that a bucket holds on average, at most: a task sorts or rolls up one bucket. The bound on buckets is Spark's.
ROWS_PER_BUCKET, MOST_BUCKETS = 1_000_000, 100_000


def land_bucketed(logs: DataFrame, table: str, buckets: int) -> None:
    """Keep a copy of the log as a table in buckets by job, each sorted by job and position.

    There are ``buckets`` of them, or more where they would hold more than ROWS_PER_BUCKET
    rows each: tasks do not grow with the log, their number does. The log is counted and shuffled once, here. Rows of a job lie in one file, so a roll-up of the
    table needs no shuffle, however often it is made. A job that holds a large part of
    all rows makes one bucket as much larger; ``land_logs`` is for such logs. The table
    must not exist yet. Rows of several clusters share a bucket if their job ids agree.
    """
    if buckets < 1:
        raise ValueError("a table needs at least one bucket")
    keyed = logs.withColumn(JOB, F.expr(job_id("JobID")))
    buckets = min(max(buckets, -(-logs.count() // ROWS_PER_BUCKET)), max(buckets, MOST_BUCKETS))
    # Dealt out as the buckets are, so every task writes one file per bucket it holds.
    dealt = keyed.repartition(buckets, JOB)
    dealt.write.bucketBy(buckets, JOB).sortBy(JOB).format("parquet").saveAsTable(table)


def submit_day() -> Column:
    """Day of the raw Submit text, NULL when the text is not readable."""
    return F.expr(f"to_date({submit_timestamp('Submit')})")


def read_landed(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    max_span_days: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read a columnar copy written by ``land_logs``.

    With a period, only its days are read and those on which jobs of the period have
    further rows, as the index names them; how far a job's rows spread makes no
    difference. Of the days outside only the rows of such jobs are taken, and jobs
    that began before the period are left out, so ``operators.filters.in_period`` on
    the jobs gives the same result as on the whole log. Rows without a readable day
    are always read. The driver gets the further days, at most one row per day there
    is. ``max_span_days`` is a claim about the log, no bound on what is read: it is an
    error if some job of the log spreads over more days.
    """
    if fmt not in ("parquet", "orc"):
        raise ValueError("only columnar copies are read back; use read_logs for text")
    if (start is None) != (end is None):
        raise ValueError("a period needs both a start and an end day")
    logs = spark.read.format(fmt).load(path)
    require_columns(logs, [LOG_SEQ], "the landed log")
    if max_span_days is not None:
        longest = _spans(spark, path).agg(F.max(F.date_diff("last_day", "first_day"))).first()[0] or 0
        if longest > max_span_days:
            raise ValueError(f"a job of the log has rows {longest} days apart, more than {max_span_days}")
    if start is not None:
        logs = _of_period(spark, logs, path, *parse_period(start, end))
    return logs.drop(SUBMIT_DAY)


def _spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SPANS).parquet(spans_path(path))


def _of_period(spark: SparkSession, logs: DataFrame, path: str, first: datetime.date, last: datetime.date) -> DataFrame:
    """Rows that the jobs submitted in a period have in a landed log."""
    spans, day, job = _spans(spark, path), F.col(SUBMIT_DAY), F.expr(job_id("JobID"))
    begun = spans.filter(day.between(F.lit(first), F.lit(last)) & (F.col("first_day") < F.lit(first)))
    going_on = spans.filter((day > F.lit(last)) & F.col("first_day").between(F.lit(first), F.lit(last)))
    further = sorted(row[0] for row in going_on.select(day).distinct().toLocalIterator())

    def of(found: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        return rows.join(found.select(F.col("job").alias("_job")).distinct(), job.eqNullSafe(F.col("_job")), how)

    inside = of(begun, "left_anti", logs.filter(day.isNull() | day.between(F.lit(first), F.lit(last))))
    if not further:
        return inside
    return inside.unionByName(of(going_on, "left_semi", logs.filter(day.isin(further))))
