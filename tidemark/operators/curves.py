"""Jobs over a curve table: (program_id, particle_id, material_id, energy, stopping_power, range0).

A curve is a power law between grid energies (linear where a value is 0 or less). Probes meet cells by an equi-join on
the curve and a logarithmic bucket, so a probe looks at a few cells and never at its whole curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.tables import saved

CURVE = ["program_id", "particle_id", "material_id"]
PER_DECADE, SMALLEST = 4, 1e-12


def energy_to_mev_per_nucl(value: Column, unit: Column, per_nucleon: Column, mass_number: Column, atomic_mass: Column) -> Column:
    a = F.when(mass_number > 0, mass_number).otherwise(1)
    mev = F.when(unit == "keV", value / 1000).when(unit == "GeV", value * 1000).otherwise(value)
    scaled = value * F.when(atomic_mass > 0, atomic_mass).otherwise(a) / a
    return F.when(unit == "MeV/nucl", value).when(unit == "MeV/u", scaled).when(F.coalesce(per_nucleon, F.lit(False)), mev).otherwise(mev / a)


def range_target_to_areal(value: Column, unit: Column, density: Column) -> Column:
    """struct<value, error>: g/cm2; lengths need a density, unknown units are errors."""
    u = F.regexp_replace(F.lower(unit), r"\s+", "")
    cm = F.when(u == "cm", value).when(u == "mm", value / 10).when(u == "m", value * 100).when(u.isin("um", "µm", "μm"), value / 10000)
    areal = u.isin("g/cm2", "g/cm²", "gcm-2")
    good = density > 0
    error = F.when(areal, F.lit(None)).when(cm.isNull(), F.concat(F.lit("unknown range unit "), unit)).when(~F.coalesce(good, F.lit(False)), "density needed to convert a length")
    return F.struct(F.when(areal, value).when(good, cm * density).alias("value"), error.cast("string").alias("error"))


def stp_target_to_mass(value: Column, unit: Column, density: Column) -> Column:
    """struct<value, error>: MeV cm2/g; linear units (MeV/cm, keV/um = 10 MeV/cm) need a density, unknown units pass."""
    u = F.regexp_replace(F.lower(unit), r"\s+", "")
    linear = F.when(u == "mev/cm", value).when(u.isin("kev/um", "kev/µm", "kev/μm"), value * 10)
    good = F.coalesce(density > 0, F.lit(False))
    error = F.when(linear.isNotNull() & ~good, "density needed to convert a linear stopping power")
    return F.struct(F.when(linear.isNull(), value).when(good, linear / density).alias("value"), error.cast("string").alias("error"))


def curve_cells(curves: DataFrame) -> DataFrame:
    """A row for each interval of a curve: e0, e1, s0, s1, b, r0, r1 (range at the ends), last, range_is_relative."""
    w = Window.partitionBy(*CURVE).orderBy("energy")
    rows = curves.withColumn("e1", F.lead("energy").over(w)).withColumn("s1", F.lead("stopping_power").over(w)).withColumn("last", F.lead("energy", 2).over(w).isNull())
    rows = rows.withColumn("base", F.first("range0").over(w))
    cells = rows.filter("e1 is not null").select(*CURVE, F.col("energy").alias("e0"), "e1", F.col("stopping_power").alias("s0"), "s1", "last", "base")
    b = F.when((F.col("s0") > 0) & (F.col("s1") > 0) & (F.col("e0") > 0), F.log(F.col("s1") / F.col("s0")) / F.log(F.col("e1") / F.col("e0")))
    cells = cells.withColumn("b", b)
    cells = cells.withColumn("r0", F.coalesce(F.sum(_part(F.col("e1"))).over(Window.partitionBy(*CURVE).orderBy("e0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.coalesce("base", F.lit(0.0)))
    return cells.withColumn("r1", F.col("r0") + _part(F.col("e1"))).withColumn("range_is_relative", F.col("base").isNull()).drop("base")


def _stretches(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by ranges of its keys and sorted, with the number of the range (_part): a long curve is several ranges of energy."""
    return saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "stretches")


def long_curve_cells(curves: DataFrame) -> DataFrame:
    """`curve_cells` of curves of any length: a curve is dealt over tasks by ranges of energy, and the range is a prefix sum
    of two levels, within a stretch and over the stretches, of which there is a row each."""
    rows = _stretches(curves.select(*CURVE, "energy", "stopping_power", "range0"), *CURVE, "energy")
    w = Window.partitionBy(*CURVE, "_part").orderBy("energy")
    over = Window.partitionBy(*CURVE).orderBy("_part")
    begins = rows.groupBy(*CURVE, "_part").agg(F.min_by(F.struct("energy", "stopping_power"), "energy").alias("first"))
    begins = begins.select(*CURVE, "_part", F.lead("first").over(over).alias("_next"))
    whole = rows.groupBy(*CURVE).agg(F.max("energy").alias("_top"), F.min_by("range0", "energy").alias("base"))
    ends = rows.join(begins, [*CURVE, "_part"]).join(whole, CURVE)
    own = ends.select(*CURVE, "_part", "base", "_top", F.col("energy").alias("e0"), F.coalesce(F.lead("energy").over(w), "_next.energy").alias("e1"), F.col("stopping_power").alias("s0"), F.coalesce(F.lead("stopping_power").over(w), "_next.stopping_power").alias("s1"))
    b = F.when((F.col("s0") > 0) & (F.col("s1") > 0) & (F.col("e0") > 0), F.log(F.col("s1") / F.col("s0")) / F.log(F.col("e1") / F.col("e0")))
    cells = saved(own.filter("e1 is not null").withColumn("b", b).withColumn("_own", _part(F.col("e1"))), "long-cells")
    totals = cells.groupBy(*CURVE, "_part").agg(F.sum("_own").alias("_sum"))
    before = totals.select(*CURVE, "_part", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.coalesce(F.sum("_own").over(Window.partitionBy(*CURVE, "_part").orderBy("e0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = cells.withColumn("_inside", inside).join(before, [*CURVE, "_part"]).withColumn("r0", F.coalesce("base", F.lit(0.0)) + F.col("_before") + F.col("_inside"))
    last = F.col("e1") == F.col("_top")
    return out.select(*CURVE, "e0", "e1", "s0", "s1", last.alias("last"), "b", "r0", (F.col("r0") + F.col("_own")).alias("r1"), F.col("base").isNull().alias("range_is_relative"))


def as_of(points: DataFrame, cells: DataFrame, x: str, start: str) -> DataFrame:
    """points with the struct _cell: of the cells of their curve that begin (column `start`) at or before x the last one,
    null without any. Points and cells are merged in ranges of curve and place, so a curve with many cells or many points is
    dealt over tasks, and a point meets one cell. Where a range begins with points, the cell comes from the ranges before,
    of which there is a row each."""
    columns = [c for c in cells.columns if c not in CURVE]
    cell, row = F.struct(*columns), F.struct(*points.columns)
    none = lambda df, of: F.lit(None).cast(df.select(of.alias("s")).schema["s"].dataType)
    begins = cells.select(*CURVE, F.col(start).cast("double").alias("_x"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_salt"), cell.alias("_cell"), none(points, row).alias("_row"))
    asks = points.select(*CURVE, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_kind"), F.xxhash64(*points.columns).alias("_salt"), none(cells, cell).alias("_cell"), row.alias("_row"))
    merged = _stretches(begins.unionByName(asks), *CURVE, "_x", "_kind", "_salt")
    seen = Window.partitionBy(*CURVE, "_part").orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    tails = merged.groupBy(*CURVE, "_part").agg(F.max_by("_cell", F.when(F.col("_kind") == 0, F.col("_x"))).alias("_tail"))
    earlier = Window.partitionBy(*CURVE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*CURVE, "_part", F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    found = merged.withColumn("_own", F.last("_cell", ignorenulls=True).over(seen)).filter("_kind = 1").join(carried, [*CURVE, "_part"], "left")
    return found.select("_row.*", F.coalesce("_own", "_carried").alias("_cell"))


def _merged(points: DataFrame, cells: DataFrame, x: str, start: str, inside) -> DataFrame:
    """What `_probed` gives, by `as_of`; for cells that follow each other by `start`."""
    columns = [c for c in cells.columns if c not in CURVE]
    found = as_of(points, cells, x, start)
    wide = found.select("*", *[F.col(f"_cell.{c}").alias(c) for c in columns]).withColumn("_in", F.coalesce(inside, F.lit(False)))
    return wide.select(*points.columns, *[F.when(F.col("_in"), F.col(c)).alias(c) for c in columns])


def _part(e: Column) -> Column:
    """Range from e0 to e within a cell, in closed form."""
    e0, s0, b = F.col("e0"), F.col("s0"), F.col("b")
    power = F.when(F.abs(1 - b) < 1e-9, e0 / s0 * F.log(e / e0)).otherwise(e0 / s0 * (F.pow(e / e0, 1 - b) - 1) / (1 - b))
    return F.when(b.isNotNull(), power).otherwise(F.try_divide(e - e0, (s0 + F.col("s1")) / 2))


def _at_energy(e: Column) -> Column:
    linear = F.col("s0") + (F.col("s1") - F.col("s0")) * (e - F.col("e0")) / (F.col("e1") - F.col("e0"))
    return F.when(F.col("b").isNotNull(), F.col("s0") * F.pow(e / F.col("e0"), F.col("b"))).otherwise(linear)


def _bucket(x: Column) -> Column:
    return F.floor(F.log10(F.greatest(x.cast("double"), F.lit(SMALLEST))) * PER_DECADE).cast("int")


def _probed(probes: DataFrame, cells: DataFrame, x: str, lo: Column, hi: Column, inside) -> DataFrame:
    """probes left-joined with the cell that holds x, by curve and bucket."""
    spread = cells.withColumn("_bucket", F.explode(F.sequence(_bucket(F.least(lo, hi)), _bucket(F.greatest(lo, hi)))))
    c = spread.select(*[F.col(k).alias(f"_{k}") for k in CURVE], *[k for k in spread.columns if k not in CURVE])
    p = probes.withColumn("_probe", _bucket(F.col(x)))
    on = [F.col(k) == F.col(f"_{k}") for k in CURVE] + [F.col("_probe") == F.col("_bucket"), inside]
    return p.join(c, on, "left").drop("_probe", "_bucket", *[f"_{k}" for k in CURVE])


CELL = ["e0", "e1", "s0", "s1", "b", "r0", "r1", "last"]


def lookup_stopping_power(points: DataFrame, cells: DataFrame, with_range: bool = True, long_curves: bool = False) -> DataFrame:
    """points (curve columns, energy, …) with stopping_power and, if asked, csda_range; null outside of the grid.

    Probes meet the cells of their bucket. Curves of very many cells, or with most of the points, are merged with them in
    ranges of energy instead (`long_curves`); the rows are the same."""
    e = F.col("energy")
    inside = (e >= F.col("e0")) & ((e < F.col("e1")) | F.col("last") & (e == F.col("e1")))
    found = _merged(points, cells, "energy", "e0", inside) if long_curves else _probed(points, cells, "energy", F.col("e0"), F.col("e1"), inside)
    out = found.withColumn("stopping_power", _at_energy(e))
    if with_range:
        out = out.withColumn("csda_range", F.col("r0") + _part(e))
    return out.drop(*CELL, *([] if with_range else ["range_is_relative"]))


def cumulative_range(cells: DataFrame) -> DataFrame:
    """Curve columns, energy and csda_range at the upper end of every cell."""
    return cells.select(*CURVE, F.col("e1").alias("energy"), F.col("r1").alias("csda_range"), "range_is_relative")


def calculate_multi(points: DataFrame, programs: DataFrame, cells: DataFrame, most_programs: int = 1000) -> DataFrame:
    """The lookup for every program of a small table (program_id); a point that a program cannot answer has an error."""
    ids = [r.program_id for r in programs.select("program_id").distinct().limit(most_programs + 1).collect()]
    if len(ids) > most_programs:
        raise ValueError(f"more than {most_programs} programs")
    kind = programs.schema["program_id"].dataType
    every = points.drop("program_id").withColumn("program_id", F.explode(F.array(*map(F.lit, sorted(ids))).cast(T.ArrayType(kind))))
    out = lookup_stopping_power(every, cells)
    return out.withColumn("error", F.when(F.col("stopping_power").isNull(), "no value on this curve"))


def inverse_range(targets: DataFrame, cells: DataFrame, long_curves: bool = False) -> DataFrame:
    """targets (curve columns, value, …) with the energy whose range is value, or an error. long_curves as for
    lookup_stopping_power."""
    v = F.col("value")
    inside = (v >= F.col("r0")) & ((v < F.col("r1")) | F.col("last") & (v == F.col("r1")))
    e0, s0, b = F.col("e0"), F.col("s0"), F.col("b")
    x = (v - F.col("r0")) * s0 / e0
    power = F.when(F.abs(1 - b) < 1e-9, e0 * F.exp(x)).otherwise(e0 * F.pow(1 + x * (1 - b), 1 / (1 - b)))
    linear = e0 + (v - F.col("r0")) * (s0 + F.col("s1")) / 2
    out = _merged(targets, cells, "value", "r0", inside) if long_curves else _probed(targets, cells, "value", F.col("r0"), F.col("r1"), inside)
    out = out.withColumn("energy", F.when(b.isNotNull(), power).otherwise(linear)).drop(*CELL, "range_is_relative")
    return out.withColumn("error", F.when(F.col("energy").isNull(), "no energy has this range"))


def bragg_peak(curves: DataFrame) -> DataFrame:
    """Curve columns, peak_energy and peak_stopping_power; the least energy of equal maxima."""
    best = F.max(F.struct("stopping_power", (-F.col("energy")).alias("e")))
    return curves.groupBy(*CURVE).agg(best.alias("m")).select(*CURVE, (-F.col("m.e")).alias("peak_energy"), F.col("m.stopping_power").alias("peak_stopping_power"))


def inverse_stopping_power(targets: DataFrame, curves: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """targets (curve columns, key columns, value, side) with the outermost energy on the low (0) or high (1) side of the
    peak whose stopping power is value, or an error. key tells the targets apart. The cells are written, so that Spark knows their
    size: where they are few, targets stay where they are, and those dealt by key or value are grouped there as well."""
    sided = cells.join(bragg_peak(curves), CURVE).withColumn("cell_side", F.when(F.col("e0") >= F.col("peak_energy"), 1).otherwise(0)).drop("peak_energy", "peak_stopping_power")
    sided = saved(sided, "sided-cells")
    v, lo, hi = F.col("value"), F.least("s0", "s1"), F.greatest("s0", "s1")
    inside = (v >= lo) & (v <= hi) & (F.col("side") == F.col("cell_side"))
    out = _probed(targets, sided, "value", F.col("s0"), F.col("s1"), inside)
    flat = F.abs(F.coalesce("b", F.lit(0.0))) < 1e-12
    edge = F.when(F.col("side") == 1, F.col("e1")).otherwise(F.col("e0"))
    power = F.when(flat, edge).otherwise(F.col("e0") * F.pow(v / F.col("s0"), 1 / F.col("b")))
    linear = F.when(F.col("s0") == F.col("s1"), edge).otherwise(F.col("e0") + (v - F.col("s0")) * (F.col("e1") - F.col("e0")) / (F.col("s1") - F.col("s0")))
    out = out.withColumn("_e", F.when(F.col("e0").isNotNull(), F.when(F.col("b").isNotNull(), power).otherwise(linear)))
    best = F.when(F.first("side") == 1, F.max("_e")).otherwise(F.min("_e"))
    out = out.groupBy(*key, *CURVE, "value", "side").agg(best.alias("energy"))
    return out.withColumn("error", F.when(F.col("energy").isNull(), "no solution on this side"))


def energy_bounds(curves: DataFrame) -> DataFrame:
    """program_id, particle_id, min_energy, max_energy."""
    return curves.groupBy("program_id", "particle_id").agg(F.min("energy").alias("min_energy"), F.max("energy").alias("max_energy"))


def check_bounds(points: DataFrame, limits: DataFrame, leg: list[str]) -> DataFrame:
    """points with leg_error: an energy of the leg that is not finite or outside of its program and particle's bounds
    fails the whole leg and no other."""
    rows = points.join(limits, ["program_id", "particle_id"], "left")
    e = F.col("energy")
    bad = e.isNull() | F.isnan(e) | F.abs(e).isin(float("inf"))
    outside = F.coalesce((e < F.col("min_energy")) | (e > F.col("max_energy")), F.lit(True))
    own = F.when(bad, "energy is not a finite number").when(outside, F.concat(F.lit("energy "), e.cast("string"), F.lit(" is outside of the valid range")))
    failed = rows.select(*leg, own.alias("e")).filter("e is not null").groupBy(*leg).agg(F.min("e").alias("leg_error"))
    return points.join(failed.hint("merge"), leg, "left")


def entity_metadata(programs: DataFrame, particles: DataFrame, materials: DataFrame, curves: DataFrame) -> DataFrame:
    """A row for each (program, particle, material) that has a curve, with names, version, masses, density and bounds."""
    known = curves.select(*CURVE).distinct().join(energy_bounds(curves), ["program_id", "particle_id"])
    return known.join(programs, "program_id", "left").join(particles, "particle_id", "left").join(materials, "material_id", "left").withColumn("density", F.when(F.col("density") > 0, F.col("density")))
