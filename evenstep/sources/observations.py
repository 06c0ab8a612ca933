"""Readings from any table, in any order, as one panel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from evenstep.errors import DataSourceError
from evenstep.schema import SERIES, TS, VALUE

# CSV cell texts that mean "no value".
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


_SURPLUS = "_surplus"
_PACKING = "spark.sql.files.openCostInBytes"


def require_source_columns(columns: list[str], needed: list[str], source: str) -> None:
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise DataSourceError(f"{source} lacks column(s) {missing}; it has {columns}")


def _parse(text: Column, dtype: str, source: str) -> Column:
    """Parse text, failing the query on text that does not parse whether or not ANSI mode is on."""
    text = F.when(~F.trim(text).isin(*MISSING_TEXTS), F.trim(text))
    parsed = text.try_cast(dtype)
    complaint = F.concat(F.lit(f"{source}: cannot read as {dtype}: "), text)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(complaint).cast(dtype)).otherwise(parsed)


def _number(df: DataFrame, column: str, source: str) -> Column:
    dtype = df.schema[column].dataType
    number = _parse(F.col(column), "double", source) if isinstance(dtype, StringType) else F.col(column).cast("double")
    if isinstance(dtype, (DoubleType, FloatType, StringType)):
        # Spark's avg turns NaN if any input is NaN, so a missing reading must be NULL from the scan on.
        number = F.when(~F.isnan(number), number)
    return number


def observations(
    df: DataFrame,
    ts: str,
    value: str,
    series: str | Column | None = None,
    keep: tuple[str, ...] = (),
    source: str = "source",
) -> DataFrame:
    """Rename and cast any DataFrame to ``[series_id, ts, value]`` plus ``keep``.

    Only the named columns are read, and rows pass one by one: their order, repeats and gaps are for later
    operators. Without ``series`` the whole frame is one series named ``all``.
    """
    needed = [ts, value, *keep] + ([series] if isinstance(series, str) else [])
    require_source_columns(df.columns, needed, source)
    if series is None:
        key = F.lit("all")
    else:
        key = (F.col(series) if isinstance(series, str) else series).cast("string")
    is_text = isinstance(df.schema[ts].dataType, StringType)
    stamp = _parse(F.col(ts), "timestamp_ntz", source) if is_text else F.col(ts).cast("timestamp_ntz")
    return df.select(
        key.alias(SERIES), stamp.alias(TS), _number(df, value, source).alias(VALUE), *[F.col(c) for c in keep]
    )


def _first_lines(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line to the files that begin with it.

    Every split of a file becomes a task of its own, which reads one batch of lines and stops; the first split's
    first line that is not blank is the header. The driver gets a line and a name for each file, which it lists anyway.
    """

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, line in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "value"))):
                if at:
                    return
                if line.strip():
                    yield pa.RecordBatch.from_pydict({"file": [file], "header": [line.lstrip("\ufeff").rstrip("\r")]})
                    return

    before = spark.conf.get(_PACKING)
    # A file that is this dear to open shares its task with no other.
    spark.conf.set(_PACKING, str(1 << 40))
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        found = lines.mapInArrow(leading, "file string, header string").collect()
    finally:
        spark.conf.set(_PACKING, before)
    by_header: dict[str, list[str]] = {}
    for row in found:
        by_header.setdefault(row.header, []).append(row.file)
    return by_header


def _headed(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("header", True).option("escape", '"')


def read_csv(
    spark: SparkSession,
    path: str,
    ts: str,
    value: str,
    series: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """A headed CSV file or folder as a panel. Types are set here, not inferred from a second scan.

    Each file is read by its own header: files are grouped by their header line, and each group is one read that
    takes the named columns, wherever they stand. A file whose header lacks one of them is refused by name. A row with more fields
    than its header fails the query; one with fewer lacks its last values.
    """
    path = str(path)
    try:
        by_header = _first_lines(spark, path)
    except AnalysisException as cause:
        raise DataSourceError(f"no readable CSV at {path}: {cause.getCondition()}") from cause
    if not by_header:
        raise DataSourceError(f"no CSV with a header at {path}")
    panels = []
    for header, files in sorted(by_header.items()):
        names = _headed(spark).csv(spark.sparkContext.parallelize([header], 1)).columns
        needed = [ts, value, *keep] + ([series] if series else [])
        require_source_columns(names, needed, path if len(by_header) == 1 else sorted(files)[0])
        # One column more than the header has catches the first field too many.
        fields = StructType([StructField(name, StringType()) for name in [*names, _SURPLUS]])
        raw = _headed(spark).schema(fields).csv(path)
        if len(by_header) > 1:
            raw = raw.where(F.col("_metadata.file_path").isin(files))  # prunes files before they are read
        complaint = F.concat(F.lit(f"{path}: a row has more fields than the header, from: "), F.col(_SURPLUS))
        whole = F.when(F.col(_SURPLUS).isNotNull(), F.raise_error(complaint).cast("string")).otherwise(F.col(f"`{ts}`"))
        panels.append(observations(raw.withColumn(ts, whole).drop(_SURPLUS), ts, value, series, keep, source=path))
    whole = panels[0]
    for panel in panels[1:]:
        whole = whole.unionByName(panel)
    return whole


def read_table(
    spark: SparkSession,
    path: str,
    ts: str,
    value: str,
    series: str | None = None,
    keep: tuple[str, ...] = (),
    format: str = "parquet",
) -> DataFrame:
    """A columnar file or folder (parquet, orc) as a panel."""
    try:
        raw = spark.read.format(format).load(str(path))
    except AnalysisException as cause:
        raise DataSourceError(f"no readable {format} at {path}: {cause.getCondition()}") from cause
    return observations(raw, ts, value, series, keep, source=str(path))
