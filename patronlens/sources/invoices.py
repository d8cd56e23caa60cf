"""Invoice ingestion: CSV scan, union and year shift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.functions.dates import timestamp_text, years
from patronlens.schemas import INVOICE_CSV


def read_invoice_csvs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Scan one CSV location per sheet, ``{sheet: path}``, and union them by name.

    The sheet name becomes ``source_sheet``. Columns are found by their names in the
    header, in any order; quoted texts may hold line ends (so a file is one split); a
    value that is no number is an error, an empty one NULL. No inference pass runs.
    """
    sheets = []
    for sheet, path in paths.items():
        texts = spark.read.csv(path, header=True, multiLine=True, escape='"')
        typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in INVOICE_CSV]
        sheets.append(texts.select(*typed, F.lit(sheet).alias("source_sheet")))
    combined = sheets[0]
    for sheet in sheets[1:]:
        combined = combined.unionByName(sheet)
    return combined


def shift_years(df: DataFrame, column: str, target_year: int) -> DataFrame:
    """Move a timestamp column by whole years so that its latest year is ``target_year``."""
    offset = df.agg((F.lit(target_year) - F.year(F.max(column))).alias("offset")).scalar()
    return df.withColumn(column, F.col(column) + years(offset))


def parse_invoice_dates(df: DataFrame) -> DataFrame:
    """Strict parse of the CSV date text; an unparsable date is an error."""
    return df.withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))


def load_invoices(spark: SparkSession, paths: dict[str, str], target_year: int) -> DataFrame:
    """CSV files to raw invoices with shifted dates as text."""
    parsed = parse_invoice_dates(read_invoice_csvs(spark, paths))
    shifted = shift_years(parsed, "InvoiceDate", target_year)
    return shifted.withColumn("InvoiceDate", timestamp_text(F.col("InvoiceDate")))
