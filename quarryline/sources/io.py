"""Reading and writing catalogue files: JSON Lines, JSON documents, directories of JSON, CSV, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

MODES = {"permissive": "DROPMALFORMED", "strict": "FAILFAST", "plain": "FAILFAST"}

#: What a listing file holds.
LISTING = "datasetId long, datasetSlug string, ownerUser string, title string, subtitle string, description string, expectedUpdateFrequency string, licenses array<struct<name:string>>, usabilityRating double, totalViews long, totalVotes long, totalDownloads long, keywords array<string>, userSpecifiedSources string"


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None, mode: str = "permissive") -> DataFrame:
    """JSON Lines; ``permissive`` drops bad lines and takes a missing path as empty (a schema is needed then), ``strict`` and ``plain`` raise."""
    reader = spark.read.option("mode", MODES[mode])
    reader = reader.schema(schema) if schema is not None else reader
    try:
        return reader.json(path)
    except AnalysisException as e:
        if mode != "permissive" or schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that a permissive scan drops."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    return spark.read.text(path).where(F.trim("value") != "").where(parsed["_corrupt_record"].isNotNull()).select(F.col("value").alias("line"))


def json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A file that is one JSON list or object."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def unwrap(raw: Column, kind: str = LISTING) -> Column:
    """Struct from an object, an object inside ``info``, or either as JSON inside a JSON string; null otherwise."""
    inner = F.coalesce(F.when(F.trim(raw).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")), raw)
    plain = F.from_json(inner, kind)
    wrapped = F.from_json(inner, f"info struct<{_fields(kind)}>")["info"]
    return F.coalesce(wrapped, F.when(F.get_json_object(inner, "$.info").isNull(), plain))


def _fields(kind: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (x.strip().split(" ", 1) for x in kind.split(", ")))


def json_directory(spark: SparkSession, pattern: str | list[str], kind: str = LISTING, lines: bool = False) -> DataFrame:
    """(info, folder, path) of one JSON file a row; the folder's name is data. Files are small; the whole text of one is a row. With ``lines`` files are bundles of any size, every line of which is a row."""
    rows = spark.read.option("wholetext", not lines).text(pattern).select("value", F.col("_metadata.file_path").alias("path"))
    return rows.select(unwrap(F.col("value"), kind).alias("info"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "path")


def vectors(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """A vector table; a count that differs from the mapping's raises."""
    df = spark.read.parquet(path)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} vectors for {expected} documents")
    return df


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """K1, K2."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_json_document(df: DataFrame, path: str, most: int = 10_000) -> None:
    """K5: a small table as one JSON document, a list of objects in order of their columns; more than ``most`` rows raise."""
    held = df.limit(most + 1)
    row = F.struct(*map(F.col, df.columns))
    document = held.agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("value"))
    document = document.select(F.when(F.col("n") > most, F.raise_error(F.lit(f"a document of more than {most} rows"))).otherwise(F.col("value")).alias("value"))
    document.coalesce(1).write.mode("overwrite").text(path)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants."""
    return spark.createDataFrame(rows, schema)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A header, arrays joined by bars, nulls empty; with ``columns`` these in this order."""
    df = df.select(*columns) if columns else df
    flat = [F.array_join(F.col(c).cast("array<string>"), " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def write_vectors(df: DataFrame, path: str, column: str = "embedding") -> int:
    """K6: the vector table; a row without a vector raises, the number of rows is returned."""
    missing = df.where(F.col(column).isNull() | (F.size(column) == 0)).count()
    if missing:
        raise ValueError(f"{missing} rows without a vector")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_index(docs: DataFrame, path: str) -> None:
    """K7: the mapping table, by document id."""
    docs.write.mode("overwrite").parquet(path)


def report(summary: DataFrame, title: str, columns: list[str], most: int = 200) -> str:
    """K8, K9: a Markdown table of a summary (a summary has few rows; more than ``most`` raise)."""
    rows = summary.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""])
