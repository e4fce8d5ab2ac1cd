"""Alias dictionaries: catalogues, layered aliases, checks and the exported form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import seed
from ..functions.text import normalize_text


def build_catalogue(elements: DataFrame, compounds: DataFrame, last_z: int = seed.LAST_MATERIAL_Z) -> DataFrame:
    """id, name, kind of the elements up to last_z and the compounds."""
    own = elements.filter(F.col("z") <= last_z).select(F.col("z").alias("id"), "name", F.lit("element").alias("kind"))
    return own.unionByName(compounds.select("id", "name", F.lit("compound").alias("kind")))


def build_particle_catalogue(elements: DataFrame, electron_id: int = seed.ELECTRON) -> DataFrame:
    """id, symbol, name, default_mass_number of all elements and the electron."""
    own = elements.select(F.col("z").alias("id"), "symbol", "name", "default_mass_number")
    return own.unionByName(elements.sparkSession.createDataFrame([(electron_id, "e⁻", "Electron", 0)], own.schema))


def derive_base_alias(catalogue: DataFrame) -> DataFrame:
    """catalogue with alias: the normalized name without a trailing qualifier in brackets."""
    return catalogue.withColumn("alias", normalize_text(F.regexp_replace("name", r"\s*\(.*\)\s*$", "")))


def drop_ambiguous_alias(aliases: DataFrame) -> DataFrame:
    """alias, entity_id of the aliases (alias, entity_id) that stand for one entity only; empty ones go."""
    return aliases.filter("alias <> ''").groupBy("alias").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).filter("n = 1").select("alias", "entity_id")


def build_dictionary(tiers: list[DataFrame], values: list[str]) -> DataFrame:
    """alias_key, the value columns and ord.

    tiers have alias, seq (their order, below 2^40) and the values. A later put wins the values; ord is the place of the
    first put, tier times 2^40 and seq, so it needs no sort."""
    rows = reduce(DataFrame.unionByName, [t.select(normalize_text(F.col("alias")).alias("alias_key"), F.struct(F.lit(k).alias("tier"), F.col("seq").cast("long").alias("seq")).alias("put"), F.struct(*values).alias("v")) for k, t in enumerate(tiers)])
    kept = rows.filter("alias_key <> ''").groupBy("alias_key").agg(F.max_by("v", "put").alias("v"), F.min("put").alias("first"))
    return kept.withColumn("ord", F.col("first.tier").cast("long") * (1 << 40) + F.col("first.seq")).select("alias_key", "v.*", "ord")


def material_dictionary(spark: SparkSession) -> DataFrame:
    """alias_key, entity_id, ord of the seed."""
    e, v = seed.elements(spark), seed.element_variants(spark)
    names = e.filter(F.col("z") <= seed.LAST_MATERIAL_Z).select(F.col("z").alias("entity_id"), F.posexplode(F.array("symbol", "name")).alias("k", "alias")).withColumn("seq", F.col("entity_id") * 2 + F.col("k"))
    more = v.filter(F.col("z") <= seed.LAST_MATERIAL_Z).select(F.col("z").alias("entity_id"), F.col("variant").alias("alias"), F.col("z").alias("seq"))
    base = derive_base_alias(seed.compounds(spark)).withColumnRenamed("id", "entity_id")
    base = drop_ambiguous_alias(base).withColumn("seq", F.col("entity_id"))
    return build_dictionary([names, more, base, seed.material_names(spark)], ["entity_id"])


def particle_dictionary(spark: SparkSession) -> DataFrame:
    """alias_key, entity_id, mass_number, assumed, ord of the seed."""
    e, v = seed.elements(spark), seed.element_variants(spark)
    assumed = F.lit(True).alias("assumed")
    names = e.select(F.col("z").alias("entity_id"), F.col("default_mass_number").alias("mass_number"), assumed, F.posexplode(F.array("name", "symbol")).alias("k", "alias")).withColumn("seq", F.col("entity_id") * 2 + F.col("k"))
    more = v.join(e, "z").select(F.col("z").alias("entity_id"), F.col("default_mass_number").alias("mass_number"), assumed, F.col("variant").alias("alias"), F.col("z").alias("seq"))
    named = seed.particle_names(spark).withColumn("assumed", F.lit(False))
    return build_dictionary([names, more, named], ["entity_id", "mass_number", "assumed"])


def audit_dictionary(dictionary: DataFrame, catalogue: DataFrame) -> DataFrame:
    """problem, alias_key, entity_id: unknown entities, keys that are not normalized, entities that the catalogue repeats."""
    ids = catalogue.select(F.col("id").alias("entity_id"))
    unknown = dictionary.join(ids, "entity_id", "left_anti").select(F.lit("unknown_entity").alias("problem"), "alias_key", "entity_id")
    folded = dictionary.filter(normalize_text(F.col("alias_key")) != F.col("alias_key")).select(F.lit("not_normalized").alias("problem"), "alias_key", "entity_id")
    twice = ids.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated_entity").alias("problem"), F.lit(None).cast("string").alias("alias_key"), "entity_id")
    return unknown.unionByName(folded).unionByName(twice)


def dictionary_drift(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The rows that only one of two tables of the same columns has, with side stored or rebuilt."""
    rebuilt = rebuilt.select(stored.columns)
    return stored.exceptAll(rebuilt).withColumn("side", F.lit("stored")).unionByName(rebuilt.exceptAll(stored).withColumn("side", F.lit("rebuilt")))


def export_dictionary(catalogue: DataFrame, dictionary: DataFrame) -> DataFrame:
    """A row for each catalogue entity with its aliases sorted; entities without one keep an empty list."""
    own = dictionary.groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_list("alias_key")).alias("aliases"))
    return catalogue.join(own, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
