"""Requests to numbers: legs of a request, their programs, points, results, and the nested form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import seed
from ..functions.tables import bucketed, saved
from ..functions.text import fold_name
from . import curves as C
from .extract import FROM_POWER, FROM_RANGE, POWER
from .resolve import resolve_all


def choose_program(rows: DataFrame, keys: DataFrame, programs_of: DataFrame) -> DataFrame:
    """rows (program, particle_id, …) with program_id and program_source: the named one if known, else the particle's first."""
    named = keys.select(F.col("program_key").alias("_key"), F.col("program_id").alias("_named"))
    first = programs_of.filter("pos = 0")
    own = first.filter("for_particle <> 0").select(F.col("for_particle").alias("particle_id"), F.col("program_id").alias("_own"))
    other = first.filter("for_particle = 0").select(F.col("program_id").alias("_other"))
    out = rows.withColumn("_key", fold_name(F.col("program"))).join(named, "_key", "left").join(own, "particle_id", "left").crossJoin(other)  # one row
    out = out.withColumn("program_id", F.coalesce("_named", "_own", "_other")).withColumn("program_source", F.when(F.col("_named").isNotNull(), "explicit").otherwise("auto"))
    return out.drop("_key", "_named", "_own", "_other")


def structural_errors(intents: DataFrame, electron_id: int = seed.ELECTRON) -> DataFrame:
    """intents (request_id, intent, particles, materials: resolved arrays with nulls) with request_error."""
    i = F.col("intent")
    inverse = i["quantity"].isin(FROM_RANGE, FROM_POWER)
    of_particles, of_materials = i["compare_dim"] == "particle", i["compare_dim"] == "material"
    used = lambda c, every: F.when(every, c).otherwise(F.slice(c, 1, 1))
    p, m = used(F.col("particles"), of_particles), used(F.col("materials"), of_materials)
    error = (
        F.when(F.size(i["particles"]) == 0, "request has no particle")
        .when(F.size(i["materials"]) == 0, "request has no material")
        .when(~inverse & (F.size(i["energies"]) == 0), "request has no energy")
        .when(F.exists(p, lambda x: x["entity_id"].isNull()), "particle not resolved")
        .when(F.exists(p, lambda x: x["entity_id"] == electron_id), "electrons are not supported")
        .when(F.exists(m, lambda x: x["entity_id"].isNull()), "material not resolved")
    )
    return intents.withColumn("request_error", error.cast("string"))


def resolved_entities(intents: DataFrame, particle_resolver=None, material_resolver=None) -> DataFrame:
    """intents (request_id, intent) with particles and materials: the resolved mentions in order, nulls where none. What the
    extraction has resolved (entities) is taken as it is; otherwise the intent's phrases are resolved."""
    if "entities" in intents.columns:
        return intents.select("request_id", "intent", "entities.particles", "entities.materials")
    out = intents
    for field, resolver, columns in (("particles", particle_resolver, ["entity_id", "name", "mass_number", "isotope"]), ("materials", material_resolver, ["entity_id", "name"])):
        long = intents.select("request_id", F.posexplode(F.col(f"intent.{field}.match")).alias("k", "phrase"))
        found = resolve_all(long, saved(resolver(long.select("phrase")), "resolved-phrases"))
        own = found.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("k", *columns))).alias(field))
        out = out.join(own.hint("merge"), "request_id", "left")
    return out


def fan_out(rows: DataFrame, keys: DataFrame, names: DataFrame, programs_of: DataFrame) -> DataFrame:
    """A row for each leg: request_id, leg, label, particle and material, program_id, program_name, program_source,
    dropped_entities. rows are those of structural_errors without an error."""
    dim = F.col("intent.compare_dim")
    pick = lambda c, every: F.when(dim == every, F.col(c)).otherwise(F.slice(c, 1, 1))
    base = rows.select("request_id", "intent", dim.alias("dim"), F.posexplode(pick("particles", "particle")).alias("kp", "p"), (F.size("particles") + F.size("materials") - 2).alias("_more"), "materials")
    base = base.select("*", F.posexplode(F.when(F.col("dim") == "material", F.col("materials")).otherwise(F.slice("materials", 1, 1))).alias("km", "m"))
    dropped = F.when(F.col("dim") == "particle", F.size("materials") - 1).when(F.col("dim") == "material", F.col("_more") - F.size("materials") + 1).otherwise(F.col("_more"))
    flat = base.select("request_id", "intent", "dim", F.greatest("kp", "km").alias("leg"), F.col("intent.program").alias("program"), F.col("p.entity_id").alias("particle_id"), F.col("p.name").alias("particle_name"), F.col("p.mass_number").alias("mass_number"), F.col("p.isotope").alias("isotope"), F.col("m.entity_id").alias("material_id"), F.col("m.name").alias("material_name"), dropped.alias("dropped_entities"))
    single = choose_program(flat.filter("dim <> 'program'"), keys, programs_of)
    several = flat.filter("dim = 'program'").drop("leg")
    own = programs_of.select(F.col("for_particle").alias("_for"), F.col("pos").alias("leg"), "program_id")
    special = [r.for_particle for r in programs_of.select("for_particle").distinct().collect() if r.for_particle]  # a handful
    several = several.withColumn("_for", F.when(F.col("particle_id").isin(special), F.col("particle_id")).otherwise(0)).join(own, "_for").drop("_for").withColumn("program_source", F.lit("comparison"))
    legs = single.unionByName(several).join(names, "program_id", "left").withColumn("program_name", F.coalesce("program_name", F.concat(F.lit("program "), F.col("program_id").cast("string"))))
    label = F.when(F.col("dim") == "particle", F.coalesce(F.nullif("isotope", F.lit("")), "particle_name")).when(F.col("dim") == "program", F.col("program_name")).otherwise(F.col("material_name"))
    return legs.withColumn("label", label).drop("program")


def compute_requests(intents: DataFrame, particle_resolver, material_resolver, curves: DataFrame, particles: DataFrame, materials: DataFrame, keys: DataFrame, names: DataFrame, programs_of: DataFrame, version: str = "1") -> DataFrame:
    """The long result: one row for each point of each leg, or one row with an error.

    intents: (request_id, intent and, from the extraction, entities; without those the resolvers are asked). Legs stand in
    buckets of the request, so what follows shuffles no request again. particles: (id, atomic_mass); materials: (id, density). error_scope is request, leg or
    null. Stopping-power requests do not compute ranges."""
    cells = saved(C.curve_cells(curves), "cells")
    checked = bucketed(structural_errors(resolved_entities(intents, particle_resolver, material_resolver)), "checked", "request_id")
    failed = checked.filter("request_error is not null").select("request_id", F.col("intent.quantity").alias("quantity"), F.col("request_error").alias("error"), F.lit("request").alias("error_scope"))
    legs = fan_out(checked.filter("request_error is null"), keys, names, programs_of)
    legs = legs.join(particles.select(F.col("id").alias("particle_id"), "atomic_mass"), "particle_id", "left").join(materials.select(F.col("id").alias("material_id"), "density"), "material_id", "left")
    legs = bucketed(legs, "legs", "request_id")  # nothing before needs the buckets of checked, so Spark reads it by file size
    quantity = F.col("intent.quantity")
    mass = F.when(F.col("mass_number") > 1, F.col("atomic_mass")).otherwise(F.col("mass_number"))
    forward = legs.filter(~quantity.isin(FROM_RANGE, FROM_POWER)).select("*", F.posexplode("intent.energies").alias("pos", "e"))
    forward = forward.withColumn("energy", C.energy_to_mev_per_nucl(F.col("e.value"), F.col("e.unit"), F.col("e.per_nucleon"), F.col("mass_number"), mass)).drop("e")
    forward = C.check_bounds(forward, C.energy_bounds(curves), ["request_id", "leg"])
    good, bad = forward.filter("leg_error is null"), forward.filter("leg_error is not null and pos = 0").withColumn("error", F.col("leg_error")).drop("energy", "pos")
    power = C.lookup_stopping_power(good.filter(quantity == POWER), cells, with_range=False)
    far = C.lookup_stopping_power(good.filter(quantity != POWER), cells).drop("range_is_relative")
    target = F.col("intent.target")
    of_range = legs.filter(quantity == FROM_RANGE).withColumn("t", C.range_target_to_areal(target["value"], target["unit"], F.col("density")))
    of_power = legs.filter(quantity == FROM_POWER).withColumn("t", C.stp_target_to_mass(target["value"], target["unit"], F.col("density")))
    missing = lambda df: df.withColumn("error", F.when(F.col("intent.target").isNull(), "an inverse request needs a target").otherwise(F.col("t.error"))).filter("error is not null")
    ready = lambda df: df.filter("t.value is not null and t.error is null").withColumn("value", F.col("t.value"))
    by_range = C.inverse_range(ready(of_range), cells).withColumn("csda_range", F.when(F.col("error").isNull(), F.col("value"))).withColumn("pos", F.lit(0))
    solved = C.inverse_stopping_power(ready(of_power).withColumn("side", F.lit(1)).select("request_id", "leg", *C.CURVE, "value", "side"), curves, cells, ["request_id", "leg"])
    by_power = of_power.join(solved.select("request_id", "leg", "value", "energy", "error").hint("merge"), ["request_id", "leg"]).withColumn("stopping_power", F.when(F.col("error").isNull(), F.col("value"))).withColumn("pos", F.lit(0))
    parts = [power, far, bad, missing(of_range), missing(of_power), by_range, by_power]
    columns = {"request_id": None, "leg": None, "pos": "int", "label": None, "particle_id": None, "material_id": None, "program_id": None, "program_name": None, "program_source": None, "dropped_entities": None, "energy": "double", "stopping_power": "double", "csda_range": "double", "error": "string"}
    out = None
    for part in parts:
        own = part.select(quantity.alias("quantity"), *[F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
        out = own if out is None else out.unionByName(own)
    out = out.withColumn("error_scope", F.when(F.col("error").isNotNull(), "leg"))
    return out.unionByName(failed, allowMissingColumns=True).withColumn("data_version", F.lit(version))


def nest_results(results: DataFrame) -> DataFrame:
    """request_id, quantity, series: array of legs in order, each with its points in order."""
    results = bucketed(results, "results", "request_id")  # both groupings read it as it lies
    keep = ["label", "particle_id", "material_id", "program_id", "program_name"]
    point: Column = F.when(F.col("pos").isNotNull() & F.col("error").isNull(), F.struct("pos", "energy", "stopping_power", "csda_range"))
    legs = results.filter("leg is not null").groupBy("request_id", "quantity", "leg", *keep).agg(F.max("error").alias("error"), F.array_sort(F.collect_list(point)).alias("points"))
    series = F.array_sort(F.collect_list(F.struct("leg", *keep, "error", "points")))
    every = legs.groupBy("request_id", "quantity").agg(series.alias("series"))
    failed = results.filter("leg is null").select("request_id", "quantity", F.col("error").alias("request_error"))
    return every.withColumn("request_error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)
