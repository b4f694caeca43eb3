"""Readers and writers for CSV and parquet, and checks on what was read."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.session import checkpointed, join_measured

SOURCE_FILE = "source_file"


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _fitting(candidate: str | re.Pattern, folded: Mapping[str, str]) -> list[str]:
    if isinstance(candidate, str):
        return [name for name in [candidate.strip().lower()] if name in folded]
    return sorted(name for name in folded if candidate.fullmatch(name))


def resolve_names(columns: Sequence[str], candidates: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Which real column stands for each logical one; case and outer blanks do not matter.

    A candidate is a name or a compiled pattern for the whole folded name.
    """
    folded = {c.strip().lower(): c for c in reversed(columns)}
    found = {}
    for logical, names in candidates.items():
        hit = next((folded[f] for n in names for f in _fitting(n, folded)), None)
        if hit is not None:
            found[logical] = hit
    return found


def require_files(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raise one error that names every input that is not there."""
    conf = spark._jsc.hadoopConfiguration()
    absent = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(conf).exists(place):
            absent.append(path)
    if absent:
        raise FileNotFoundError(f"missing inputs: {', '.join(absent)}")


def resolve_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Select the logical columns that exist, under their logical names."""
    found = resolve_names(df.columns, candidates)
    return df.select(*[F.col(f"`{real}`").alias(logical) for logical, real in found.items()])


def _csv(spark: SparkSession, encoding: str, header: bool):
    return spark.read.option("header", header).option("encoding", encoding).option("enforceSchema", False)


def read_csv_projected(
    spark: SparkSession, paths: str | Sequence[str], cols: Sequence[str], encoding: str = "UTF-8",
) -> DataFrame:
    """Named columns of many CSV files that share one header, sub-folders included.

    All columns come as text, so no pass is spent on guessing types; a file
    with another header is an error rather than a silent shift of columns.
    """
    reader = _csv(spark, encoding, True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    return require_columns(df, cols).select(*[F.col(f"`{c}`") for c in cols])


def read_headers(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8", exclude: str | None = None) -> DataFrame:
    """(path, header): the column names of every CSV file below the given folders.

    One job: the listing is spread over tasks, which read each file up to the
    end of its first line that is not blank. Names matching ``exclude`` are
    passed over; a file without such a line has an empty header. ``path`` is
    written as the scan's own file path.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv").load(paths if isinstance(paths, str) else list(paths))
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    )
    if exclude:
        listing = listing.where(~F.col("name").rlike(f"(?i){exclude}"))

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in incoming:
            found = batch.column(0).to_pylist()
            headers = []
            for path in found:
                store, place = fs.FileSystem.from_uri(path)
                with io.TextIOWrapper(io.BufferedReader(store.open_input_stream(place)), encoding, "replace") as lines:
                    texts = (line.lstrip("\ufeff").rstrip("\r\n") for line in lines)
                    headers.append(next(csv.reader(t for t in texts if t.strip()), []))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(headers, pa.list_(pa.string()))], names=["path", "header"]
            )

    spread = listing.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(batches, "path string, header array<string>")


def _position(header: Column, names: Sequence[str | re.Pattern]) -> Column:
    """Place (from 0) of the first candidate that a header has; case and outer blanks do not matter."""
    folded = F.transform(header, lambda name: F.lower(F.trim(name)))

    def place(candidate: str | re.Pattern) -> Column:
        if isinstance(candidate, str):
            return F.array_position(folded, F.lit(candidate.strip().lower()))
        whole = f"^(?:{candidate.pattern})$"
        return F.array_position(folded, F.array_min(F.filter(folded, lambda name: name.rlike(whole))))

    return F.coalesce(*[F.when(place(n) > 0, place(n) - 1) for n in names]).cast("int")


def read_csv_drifting(
    spark: SparkSession, paths: str | Sequence[str], candidates: Mapping[str, Sequence[str | re.Pattern]],
    required: Sequence[str] = (), encoding: str = "UTF-8", exclude: str | None = None,
) -> DataFrame:
    """CSV files whose headers differ from file to file.

    Each logical column takes the first of its candidate names that the file
    has, ignoring case. Files lacking a required column are passed over, as are
    names matching ``exclude``. Column ``source_file`` keeps the file name.

    The headers of all files are read in one job and become a table of places,
    (path, place of each logical column), which no driver holds. All files are
    then one scan by position, joined with that table, so neither jobs nor the
    plan grow with the number of files or layouts. Of a scan's columns only
    those that stand for a logical one in some file are parsed out.
    """
    headers = read_headers(spark, paths, encoding, exclude)
    places = checkpointed(headers.select(
        "path", F.size("header").alias("width"), *[_position(F.col("header"), n).alias(f"at_{c}") for c, n in candidates.items()]
    ).where(reduce(lambda a, b: a & b, [F.col(f"at_{r}").isNotNull() for r in required], F.lit(True))))
    # bounded by the widest header, whatever the number of files
    summary = places.agg(
        F.max("width").alias("width"), F.sum(F.length("path") + 8 * (len(candidates) + 4)).alias("bytes"),
        *[F.sort_array(F.collect_set(f"at_{c}")).alias(c) for c in candidates],
    ).first()
    if summary["width"] is None or not any(summary[c] for c in candidates):
        raise ValueError("no file has the required columns")
    schema = ", ".join(f"c{i} string" for i in range(summary["width"]))
    scan = (
        spark.read.option("header", True).option("enforceSchema", True).option("encoding", encoding).schema(schema)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(paths if isinstance(paths, str) else list(paths))
    )
    if exclude:
        scan = scan.where(~F.col("_metadata.file_name").rlike(f"(?i){exclude}"))
    used = sorted({place for c in candidates for place in summary[c]})
    lines = scan.select(
        *[F.col(f"c{i}") for i in used], F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias(SOURCE_FILE)
    )
    found = [c for c in candidates if summary[c]]
    return join_measured(lines, places, ["path"], summary["bytes"]).select(
        *[F.coalesce(*[F.when(F.col(f"at_{c}") == i, F.col(f"c{i}")) for i in summary[c]]).alias(c) for c in found], SOURCE_FILE
    )


def read_csv_headerless(
    spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], keep: Sequence[str],
    encoding: str = "UTF-8",
) -> DataFrame:
    """Positional CSV columns: ``names`` from the left, ``keep`` of them are read."""
    schema = ", ".join(f"`{n}` string" for n in names)
    reader = spark.read.option("encoding", encoding).option("header", False).schema(schema)
    return reader.csv(paths if isinstance(paths, str) else list(paths)).select(*keep)


def key_from_filename(
    df: DataFrame, pattern: str, out: str, group: int = 1, fmt: str | None = None,
) -> DataFrame:
    """Add a key found in the file name: a whole number, or a date if ``fmt`` is given.

    Rows of files without a match are left out.
    """
    text = F.regexp_extract(F.col(SOURCE_FILE), pattern, group)
    if fmt:
        value: Column = F.try_to_date(F.replace(text, F.lit("_"), F.lit(" ")), fmt)
    else:
        value = text.try_cast("int")
    return df.withColumn(out, value).where(F.col(out).isNotNull())


def exclude_files(df: DataFrame, pattern: str = "provisional") -> DataFrame:
    """Drop rows of files whose name contains ``pattern``, in any case."""
    return df.where(~F.lower(F.col(SOURCE_FILE)).contains(pattern.lower()))


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), files: int | None = None,
    order: Sequence[str] = (), fmt: str = "parquet",
) -> None:
    """Replace a table. ``files`` with ``order`` writes that many contiguous, sorted slices."""
    if files and order:
        df = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    elif files:
        df = df.repartition(files)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).format(fmt).save(path)


def write_bucketed(df: DataFrame, name: str, key: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Replace a catalog table that is kept in ``buckets`` by ``key`` and sorted in each; returns the table.

    Tables with equal buckets meet without a shuffle, see ``session.co_partitioned``.
    One task writes a bucket as one file. With ``path`` the files lie there.
    """
    writer = df.repartition(buckets, *key).write.mode("overwrite").format("parquet").bucketBy(buckets, *key).sortBy(*key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several places that holds a parquet table."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except Exception as error:  # noqa: BLE001 - only a missing path moves on
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(", ".join(paths))


def source_registry(spark: SparkSession, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """Data sources: id, name, attribution (with {year}), url, notes."""
    fields = ("id", "name", "attribution", "url", "notes")
    return spark.createDataFrame(
        [tuple(r.get(f, "") for f in fields) for r in rows], ", ".join(f"{f} string" for f in fields)
    )


def attribution_list(registry: DataFrame, year: Column | int | None = None) -> DataFrame:
    """Sources by name with the year put into their attribution."""
    shown = F.year(F.current_date()) if year is None else year if isinstance(year, Column) else F.lit(year)
    text = F.replace(F.col("attribution"), F.lit("{year}"), shown.cast("string"))
    line = F.format_string("- **[%s](%s):** %s", F.col("name"), F.col("url"), text)
    return registry.withColumn("attribution", text).withColumn("line", line).orderBy("name")
