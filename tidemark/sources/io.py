"""Sources and sinks: labelled JSON lines, dictionaries, curve tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.curves import CURVE
from ..operators.dictionary import export_dictionary
from ..operators.quality import DATA_LINE


def read_labelled_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of the lines that are neither blank nor comments; malformed ones have null fields and stand in `_corrupt`."""
    lines = spark.read.text(path).filter(~F.rlike("value", F.lit(DATA_LINE)))
    parsed = F.from_json(F.trim("value"), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(parsed.alias("r")).select("r.*")
    return rows.select(*[F.when(F.col("_corrupt").isNull(), F.col(c)).alias(c) for c in rows.columns[:-1]], "_corrupt")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, by file name and place in the file) and value.

    Lines of a block of a file follow each other in one task, so a line's number is that of the block's first line and its
    distance to it: only the blocks, a row each, are counted and summed up; lines are not shuffled."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")  # one row a block
    blocks = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (before + 1 - F.col("first")).alias("_shift"))
    own = lines.join(blocks, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return own.select((F.col("at") + F.col("_shift")).alias("line_no"), "value")


def read_dictionary_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """alias, entity_id and the entities' other fields of a JSON array of {id, name, …, aliases[]}, or of a line for each
    entity, as write_dictionary leaves them, where multi_line is false."""
    rows = spark.read.option("multiLine", multi_line).json(path)
    return rows.withColumn("alias", F.explode_outer("aliases")).drop("aliases").withColumnRenamed("id", "entity_id")


def write_dictionary(catalogue: DataFrame, dictionary: DataFrame, path: str, format: str = "json") -> None:
    """One row for each entity with its sorted aliases."""
    export_dictionary(catalogue, dictionary).write.format(format).mode("errorifexists").save(path)


def title_case(c) -> object:
    """WATER_LIQUID as Water Liquid."""
    return F.initcap(F.trim(F.regexp_replace(F.lower(c), r"[\s_]+", " ")))


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """The curve table; range0 is null where the file has none."""
    rows = spark.read.parquet(path)
    return rows if "range0" in rows.columns else rows.withColumn("range0", F.lit(None).cast("double"))


def programs(names: DataFrame, excluded: DataFrame) -> DataFrame:
    """The listed programs: names (id, name, …) less the excluded ids."""
    return names.join(excluded.select("id"), "id", "left_anti")


def supported(curves: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """program_id and the entities (id, name, …) that it has curves for; key is particle_id or material_id."""
    own = curves.select("program_id", F.col(key).alias("id")).distinct()
    return own.join(entities, "id").withColumn("name", title_case(F.col("name")))


def write_results(results: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Intents or results as Parquet, partitioned if asked."""
    out = results.write.mode("errorifexists")
    (out.partitionBy(*by) if by else out).parquet(path)


__all__ = ["CURVE", "programs", "read_curves", "read_dictionary_json", "read_labelled_jsonl", "read_numbered_lines", "supported", "title_case", "write_dictionary", "write_results"]
