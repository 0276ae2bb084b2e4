"""Sources: the placement file and the four ad logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from viewlens.functions.scalars import day_of, to_ts
from viewlens.operators.filters import day_column, time_column
from viewlens.sources.schemas import LOG_SCHEMAS, LOG_TIMES, PLACEMENT_COLUMNS, PLACEMENT_RAW


CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
BAD_LINE = "bad_line"
# A character that no placement file has, to read lines whole.
NO_SEPARATOR = "\x01"


def read_placement_csv(spark: SparkSession, path: str, expected_header: list[str] | None = None, **options) -> DataFrame:
    """Daily publisher/placement file with a header row.

    Columns are taken by position (the header's names vary and contain
    characters Spark needs quoted) and kept as text; ``placement_clean`` types
    them.  Quoted numbers such as ``"1,234"`` are read whole.  With
    ``expected_header`` the header of every file has to have these names, else
    reading raises.  Rows with too few or too many fields are filled up or cut;
    ``read_placement_csv_checked`` keeps them apart.
    """
    schema = PLACEMENT_RAW
    opts = {**CSV_OPTIONS, **options}
    if expected_header is not None:
        if len(expected_header) != len(PLACEMENT_COLUMNS):
            raise ValueError(f"a placement file has {len(PLACEMENT_COLUMNS)} columns, not {len(expected_header)}")
        schema = StructType([StructField(n, f.dataType) for n, f in zip(expected_header, schema.fields)])
        opts["enforceSchema"] = "false"
    return spark.read.options(**opts).schema(schema).csv(path).toDF(*PLACEMENT_COLUMNS)


def read_placement_csv_checked(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """The file's good rows, and its bad lines as they stand (column ``bad_line``).

    A line is bad if it has not the file's number of fields, or a quote that is never
    closed.  Good rows and bad lines together are all lines but the headers and empty
    ones.  Lines are read whole, then parsed, so a bad one is kept as it stands.
    """
    opts = {**CSV_OPTIONS, **options}
    lines = (spark.read.options(header=opts["header"], sep=NO_SEPARATOR, quote="", mode="PERMISSIVE")
             .schema(StructType([StructField(BAD_LINE, StringType())])).csv(path))
    fields = ", ".join([*PLACEMENT_COLUMNS, "_corrupt"])
    schema = ", ".join(f"`{c}` string" for c in fields.split(", "))
    how = {k: v for k, v in opts.items() if k != "header"} | {"columnNameOfCorruptRecord": "_corrupt"}
    line = F.col(BAD_LINE)
    parsed = lines.select(line, F.from_csv(line, schema, how).alias("row"),
                          (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))).alias("quotes"))
    is_bad = F.col("row._corrupt").isNotNull() | (F.col("quotes") % 2 == 1)
    return (parsed.where(~is_bad).select(*[F.col(f"row.{c}").alias(c) for c in PLACEMENT_COLUMNS]),
            parsed.where(is_bad).select(BAD_LINE))


def quarantine_placement_csv(spark: SparkSession, path: str, bad_path: str, **options) -> tuple[DataFrame, DataFrame]:
    """The good rows of the file, and a report after its bad lines were written to ``bad_path``.

    The report has one row: ``good`` and ``bad`` lines.
    """
    good, bad = read_placement_csv_checked(spark, path, **options)
    seen = Observation()
    bad.observe(seen, F.count(F.lit(1)).alias("bad")).write.mode("overwrite").parquet(bad_path)
    return good, good.agg(F.count(F.lit(1)).alias("good")).withColumn("bad", F.lit(seen.get["bad"]))


def normalise_log(df: DataFrame, kind: str) -> DataFrame:
    """A log as scanned -> the declared columns of its kind.

    A log with a day and a time-of-day column gets its timestamp from both
    (NULL if either is, or if the text is no time of day).  Both columns are kept
    and marked as the timestamp's own, so that windows are tested on them
    (``in_log_window``): a log partitioned by day is pruned, and the timestamp is
    made for the rows that are left, if it is used at all.  A log with a timestamp
    column only gets its day from that.  A column that is missing raises.
    """
    day, time, ts = LOG_TIMES[kind]
    have = set(df.columns)
    marked = F.col(day)
    kept = []
    if {day, time} <= have:
        df = df.withColumn(ts, to_ts(day, time))
        marked, kept = day_column(day, ts), [time_column(time, ts)]
    elif ts in have:
        df = df if day in have else df.withColumn(day, day_of(ts))
    else:
        raise ValueError(f"the {kind} log needs {ts}, or {day} and {time}; it has {df.columns}")
    missing = [f.name for f in LOG_SCHEMAS[kind].fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"the {kind} log lacks {missing}; it has {sorted(have)}")
    return df.withColumn(day, marked).select(*[
        F.col(f.name).cast(f.dataType) if df.schema[f.name].dataType != f.dataType else F.col(f.name)
        for f in LOG_SCHEMAS[kind].fields], *kept)


def read_log(spark: SparkSession, kind: str, src: str, fmt: str = "parquet",
             **options) -> DataFrame:
    """Scan one of the logs (``bid``, ``notify``, ``ad``, ``event``) and normalise it.

    ``src`` is a catalog table name for ``fmt="table"``, a JDBC table for
    ``fmt="jdbc"`` (pass ``url`` and, for parallel reads, ``partitionColumn``,
    ``lowerBound``, ``upperBound``, ``numPartitions``), else a path of a
    self-describing format.  Filters and column pruning reach the scan.
    """
    if fmt == "table":
        df = spark.table(src)
    elif fmt == "jdbc":
        df = spark.read.format("jdbc").option("dbtable", src).options(**options).load()
    else:
        df = spark.read.format(fmt).options(**options).load(src)
    return normalise_log(df, kind)
