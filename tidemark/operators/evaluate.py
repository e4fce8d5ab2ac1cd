"""Scoring of predictions against gold labels: verdicts per field, rates, misses, tags and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fold_unit

FIELDS = ["quantity", "compare_dim", "particles", "materials", "energies", "target", "assumptions"]
# fixed values: label, low end (in), high end (out)
BANDS = [("[0.90, 1.00]", 0.9, 1.0001), ("[0.80, 0.90)", 0.8, 0.9), ("[0.50, 0.80)", 0.5, 0.8), ("[0.00, 0.50)", 0.0, 0.5)]


def _entities(pairs: DataFrame, field: str, resolver, extra: list[str]) -> DataFrame:
    """id, verdict of one entity list: position by position, by resolved entity or else by phrase."""
    long = pairs.select("id", F.posexplode(F.arrays_zip(F.col(f"predicted.{field}").alias("p"), F.col(f"expected.{field}").alias("g"))).alias("k", "x"))
    long = long.select("id", F.col("x.p").alias("p"), F.col("x.g").alias("g"))
    phrases = long.select(F.explode(F.array("p.match", "g.match")).alias("phrase"))
    found = resolver(phrases).select("phrase", F.struct("entity_id", *extra).alias("e"))
    both = long.join(found.select(F.col("phrase").alias("_p"), F.col("e").alias("pe")), F.col("p.match") == F.col("_p"), "left").join(found.select(F.col("phrase").alias("_g"), F.col("e").alias("ge")), F.col("g.match") == F.col("_g"), "left")
    by_entity = F.col("pe") == F.col("ge")
    if extra:
        by_entity &= F.col("p.isotope_assumed").isNotNull() == F.col("g.isotope_assumed").isNotNull()
    same = F.when(F.col("pe").isNotNull() & F.col("ge").isNotNull(), by_entity).otherwise(F.coalesce(F.lower("p.match") == F.lower("g.match"), F.lit(False)))
    return both.groupBy("id").agg(F.min(same).alias(field))


def field_verdicts(pairs: DataFrame, particle_resolver, material_resolver) -> DataFrame:
    """pairs (id, predicted, expected, …) with a boolean column for each of FIELDS, prefixed ok_."""
    p, g = F.col("predicted"), F.col("expected")
    flag = lambda a, b: F.coalesce(a == b, F.lit(False))
    energies = (F.size(p["energies"]) == F.size(g["energies"])) & F.forall(F.zip_with(p["energies"], g["energies"], lambda a, b: F.coalesce((a["value"] == b["value"]) & (a["unit"] == b["unit"]) & a["per_nucleon"].eqNullSafe(b["per_nucleon"]), F.lit(False))), lambda x: x)
    target = F.when(p["target"].isNull() | g["target"].isNull(), p["target"].isNull() & g["target"].isNull()).otherwise((p["target"]["value"] == g["target"]["value"]) & (fold_unit(p["target"]["unit"]) == fold_unit(g["target"]["unit"])))
    out = pairs.withColumn("ok_quantity", flag(p["quantity"], g["quantity"])).withColumn("ok_compare_dim", flag(p["compare_dim"], g["compare_dim"]))
    for field, resolver, extra in (("particles", particle_resolver, ["mass_number"]), ("materials", material_resolver, [])):
        own = _entities(pairs, field, resolver, extra)
        same_size = F.size(p[field]) == F.size(g[field])
        out = out.join(own, "id", "left").withColumn(f"ok_{field}", same_size & F.coalesce(field, F.lit(True))).drop(field)
    notes = F.sort_array(p["assumptions"]) == F.sort_array(g["assumptions"])
    return out.withColumn("ok_energies", energies).withColumn("ok_target", F.coalesce(target, F.lit(False))).withColumn("ok_assumptions", F.coalesce(notes, F.lit(False)))


def slot_exact_flags(verdicts: DataFrame, slots: list[str] | None = None, rest: list[str] | None = None) -> DataFrame:
    """verdicts with slot (all slot fields right) and exact (and the rest)."""
    every = lambda names: _all([F.col(f"ok_{n}") for n in names])
    slot = every(slots or FIELDS[:-1])
    return verdicts.withColumn("slot", slot).withColumn("exact", slot & every(rest or FIELDS[-1:]))


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def coverage_summary(scored: DataFrame) -> DataFrame:
    """total, slot_matches, exact_matches, slot_rate, exact_rate (null without rows)."""
    out = scored.agg(F.count(F.lit(1)).alias("total"), F.count_if("slot").alias("slot_matches"), F.count_if("exact").alias("exact_matches"))
    return out.withColumn("slot_rate", F.try_divide("slot_matches", "total")).withColumn("exact_rate", F.try_divide("exact_matches", "total"))


def field_misses(verdicts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """field, misses, accuracy."""
    names = fields or FIELDS
    long = verdicts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"ok_{n}").alias("ok")) for n in names])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count_if(~F.col("ok")).alias("misses"), F.try_divide(F.count_if("ok"), F.count(F.lit(1))).alias("accuracy"))


def tag_stats(scored: DataFrame) -> DataFrame:
    """tag, total, slot, exact."""
    return scored.select(F.explode("tags").alias("tag"), "slot", "exact").groupBy("tag").agg(F.count(F.lit(1)).alias("total"), F.count_if("slot").alias("slot"), F.count_if("exact").alias("exact"))


def calibration(scored: DataFrame, bands: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """label, lo, hi, total, exact of each confidence band; empty bands stay."""
    own = bands or BANDS
    band = F.coalesce(*[F.when((F.col("confidence") >= lo) & (F.col("confidence") < hi), label) for label, lo, hi in own])
    counts = scored.groupBy(band.alias("label")).agg(F.count(F.lit(1)).alias("total"), F.count_if("exact").alias("exact"))
    table = scored.sparkSession.createDataFrame(own, "label string, lo double, hi double")
    return table.join(counts, "label", "left").select("label", "lo", "hi", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("exact", F.lit(0)).alias("exact"))


def misses(scored: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The rows that are not exact, with wrong, the names of their wrong fields."""
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"ok_{n}"), F.lit(n)) for n in fields or FIELDS]))
    return scored.filter(~F.col("exact")).withColumn("wrong", wrong)


def coverage_gate(scored: DataFrame, floor: float) -> DataFrame:
    """slot_rate, floor, passed; no rows do not pass."""
    rate = F.try_divide(F.count_if("slot"), F.count(F.lit(1)))
    return scored.agg(rate.alias("slot_rate")).withColumn("floor", F.lit(floor)).withColumn("passed", F.coalesce(F.col("slot_rate") >= floor, F.lit(False)))
