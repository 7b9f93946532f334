"""CSV hand-over between steps, typed read-back, stage materialization.

Paths must be on storage every executor sees (the session's checkpoint folder
or a table location), never a machine-local temporary folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sink_csv(df: DataFrame, path: str) -> None:
    """Write with a header; dates as ISO text; one file per partition."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def export_delimited(df: DataFrame, path: str) -> None:
    """The published extract: comma, header, every field double-quoted, quotes doubled."""
    df.write.mode("overwrite").options(
        header=True, quoteAll=True, escape='"', dateFormat="yyyy-MM-dd", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


CORRUPT = "_corrupt_record"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An extract of ``export_delimited`` under its schema; ``_corrupt_record`` holds a line that does not fit it.

    Quoted line breaks stay in their field.  An empty field is NULL, and so is an
    empty text, which the format does not tell apart.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    options = {"header": True, "multiLine": True, "escape": '"', "dateFormat": "yyyy-MM-dd", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.schema(wide).options(**options).csv(path)


def _content(df: DataFrame, *more) -> DataFrame:
    """Number of rows and the sum of their hashes, an empty text as NULL; every column is parsed for it."""
    fields = [f for f in df.schema.fields if f.name != CORRUPT]
    values = [F.nullif(F.col(f"`{f.name}`"), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in fields]
    return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*values).cast("decimal(38,0)")), *more)


def checked_export(df: DataFrame, path: str) -> DataFrame:
    """Write the extract, read it back, and return the rows read; raises if a row is lost, added, changed or does not parse."""
    spark = df.sparkSession
    sent = stage_table(df, "extract")  # counted and written from the same rows
    export_delimited(sent, path)
    back = read_delimited(spark, path, df.schema)
    told = _content(sent).first()
    found = _content(back, F.count_if(F.col(CORRUPT).isNotNull())).first()
    if found[2] or tuple(found[:2]) != tuple(told):
        raise ValueError(f"extract at {path}: {found[0]} rows read of {told[0]}, {found[2]} of them corrupt, or others than written")
    return back.drop(CORRUPT)


def scan_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV with a header under a declared schema (no inference pass).

    Every column is read as text, then cast once: an empty field stays NULL
    (never the text 'nan'), dates are parsed as ``yyyy-MM-dd``.
    """
    text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).csv(path)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            cols.append(F.to_date(c, "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """``create table as select``: write the stage as parquet and read it back.

    Later queries read only the columns they use and push their filters into
    the scan; the lineage of the stage is cut (a lost executor re-reads files
    instead of recomputing the stage).
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Materialize ``df`` under the session's shared checkpoint folder."""
    import uuid

    from churnscope.session import checkpoint_dir

    return materialize(df, f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}")
