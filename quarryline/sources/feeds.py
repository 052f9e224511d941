"""Line feeds, CSV registries and sorted exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; a line that is not JSON keeps its text in ``_corrupt`` and nulls elsewhere."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def split_feed(rows: DataFrame, kind: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of wanted kinds, and one row of counters: lines, bad, wanted, other."""
    bad = F.col(CORRUPT).isNotNull()
    is_wanted = ~bad & F.coalesce(F.col(kind).isin(wanted), F.lit(False))
    counters = rows.select(bad.alias("b"), is_wanted.alias("w")).agg(F.count("*").alias("lines"), F.count_if("b").alias("bad"), F.count_if("w").alias("wanted"), F.count_if(F.expr("not b and not w")).alias("other"))
    return rows.filter(is_wanted).drop(CORRUPT), counters


def observed_feed(rows: DataFrame, kind: str, wanted: list[str], name: str = "feed") -> tuple[DataFrame, Observation]:
    """The rows of wanted kinds, and counters of all lines (``lines``, ``bad``, ``wanted``, ``other``) that are there once they have been read: one pass for both."""
    bad = F.col(CORRUPT).isNotNull()
    is_wanted = ~bad & F.coalesce(F.col(kind).isin(wanted), F.lit(False))
    counters = Observation(name)
    counts = [F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("bad"), F.count_if(is_wanted).alias("wanted"), F.count_if(~bad & ~is_wanted).alias("other")]
    return rows.observe(counters, *counts).filter(is_wanted).drop(CORRUPT), counters


#: Fields of an object that can be its id, the first that has one. Fixed values.
ID_FIELDS = ["id", "video_id", "url", "link", "video_url", "text"]


def _scalar_id(v: Column) -> Column:
    """The id in a variant that is text or a number; null for anything else."""
    kind = F.schema_of_variant(v)
    text = F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit(""))
    return F.when((kind == "STRING") | kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text)


def as_id(v: Column) -> Column:
    """An id from a variant of any type: text, a number, or an object by its first field that has one."""
    fields = [_scalar_id(F.try_variant_get(v, f"$.{name}", "variant")) for name in ID_FIELDS]
    return F.coalesce(_scalar_id(v), *fields)


def as_ids(v: Column) -> Column:
    """The different ids of a variant that is a list, in order; of anything else its own id, if it has one."""
    listed = F.try_variant_get(v, "$", "array<variant>")
    own = F.array_compact(F.array(as_id(v)))
    return F.coalesce(F.array_distinct(F.array_compact(F.transform(listed, as_id))), own)


def as_count(v: Column) -> Column:
    """A count from a variant: a number (its whole part), text of digits, true as 1, a list by its different ids; null for anything else."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double").cast("long")
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind.startswith("ARRAY"), F.size(as_ids(v)).cast("long"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long"))
        .when(kind == "STRING", F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("long")))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number)
    )


def as_list(text) -> Column:
    """A JSON list as strings; a single value or an object becomes a list of one, nothing an empty list."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    listed = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    return F.when(raw == "", F.array().cast("array<string>")).when(listed.isNotNull(), listed).otherwise(F.array(F.regexp_replace(raw, '^"|"$', "")))


def as_number(text) -> Column:
    """A number from text with blanks or commas between digits; null for anything else."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\s,\x{00A0}]", "").try_cast("double")


def read_registry(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV file with a header; one row per key, names without @ and in lower case."""
    rows = spark.read.option("header", True).csv(path)
    named = rows.withColumn(key, F.lower(F.regexp_replace(F.trim(key), "^@", ""))).filter(F.col(key) != "")
    return named.dropDuplicates([key])


def export_jsonl(df: DataFrame, path: str, order: list[str], exported_at: str, single: bool = False) -> None:
    """JSON lines in order, with the time of the export. ``single`` makes one file, for small reports only."""
    rows = df.withColumn("exported_at", F.lit(exported_at)).orderBy(*order)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").json(path)


def append_journal(df: DataFrame, path: str, partition: list[str]) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)
