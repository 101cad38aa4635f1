"""Scans: delimited text, feature-clustered Parquet, bounded and disjunctive reads, catalog views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelgrid.session import small_frame

LITERAL_LIST_LIMIT = 500  # values of a pushed-down IN predicate; longer lists are joined, with the same rows


def scan_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True, skip: int = 0) -> DataFrame:
    """Comma, tab or space separated text with a declared schema; gzip is read as it is.

    ``skip`` drops the leading lines of each file. The first split of a file is the one that
    starts at byte 0, so the dropped lines are found by position there, never by content.
    """
    if skip == 0:
        return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"))
    dropped = skip + (1 if header else 0)
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_pos"))  # a first split is bounded by the split size
    first = lines.where("_start = 0").withColumn("_place", place).where(F.col("_place") > dropped)
    body = first.select("value").unionByName(lines.where("_start > 0").select("value"))
    return body.select(F.from_csv("value", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields), {"sep": sep}).alias("r")).select("r.*")


def value_filter(column: str, values: list[str]) -> Column:
    return F.col(column).isin(list(values))


def read_features(table: DataFrame, features: list[str] | DataFrame, column: str = "feature") -> DataFrame:
    """Only rows of the requested features.

    A short list becomes a pushed-down IN predicate; a table of features becomes a semi join.
    """
    if isinstance(features, DataFrame):
        return table.join(features.select(column).distinct(), column, "left_semi")
    if len(features) <= LITERAL_LIST_LIMIT:
        return table.where(value_filter(column, features))
    wanted = small_frame(table.sparkSession, [(f,) for f in features], f"{column} string")
    return table.join(wanted.distinct(), column, "left_semi")


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """One row per key; a repeated key fails the job when the row is reached."""
    others = [c for c in df.columns if c not in keys]
    checked = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in others])
    message = F.concat(F.lit(f"{what}: repeated key "), F.to_json(F.struct(*keys)))
    return checked.where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).select(*df.columns)


def read_measurements(table: DataFrame, entities: DataFrame, features: list[str]) -> DataFrame:
    """Rows of the requested entities and features; a repeated (entity, feature) is an error."""
    rows = read_features(table, features).join(entities.select("entity").distinct(), "entity", "left_semi")
    return require_unique(rows, ["entity", "feature"], "measurements")


def read_pair_events(events: DataFrame, entities: DataFrame, features: list[str], a: str = "feature", b: str = "partner") -> DataFrame:
    """Events of requested entities with a requested feature on either side."""
    either = value_filter(a, features) | F.coalesce(value_filter(b, features), F.lit(False))
    return events.where(either).join(entities.select("entity").distinct(), "entity", "left_semi")


def distinct_column(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).where(F.col(column).isNotNull()).distinct()


def describe_tables(tables: dict[str, DataFrame], grain: dict[str, list[str]]) -> DataFrame:
    """Columns, types, key roles and row counts of the given tables."""
    parts = []
    for name, df in tables.items():
        keys = grain.get(name, [])
        fields = F.array(*[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                     F.lit("key" if f.name in keys else "value").alias("column_role")) for f in df.schema.fields])
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("table_name"), F.lit("+".join(keys)).alias("grain"), "n_rows", F.inline(fields)))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def preview(table: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A window of rows in an explicit order."""
    return table.orderBy(*order).offset(offset).limit(limit)


def availability(entities: DataFrame, layer: DataFrame) -> DataFrame:
    present = layer.select("entity").distinct().withColumn("available", F.lit(True))
    return entities.select("entity").join(present, "entity", "left").withColumn("available", F.coalesce("available", F.lit(False)))


def build_manifest(tables: dict[str, DataFrame], keys: dict[str, list[str]], coverage: DataFrame, state_columns: list[str]) -> DataFrame:
    """Long (section, item, detail, n): row counts, repeated keys, and state counts per coverage column."""
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("section"), F.lit(name).alias("item"), F.lit("").alias("detail"), "n"))
        repeated = df.groupBy(*keys[name]).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k") - 1)), F.lit(0)).cast("bigint").alias("n"))
        parts.append(repeated.select(F.lit("repeated_keys").alias("section"), F.lit(name).alias("item"), F.lit("").alias("detail"), "n"))
    states = coverage.unpivot(["entity"], state_columns, "item", "detail").groupBy("item", "detail").agg(F.count(F.lit(1)).alias("n"))
    parts.append(states.select(F.lit("states").alias("section"), "item", "detail", "n"))
    return union_all(parts)


def row_number(partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
