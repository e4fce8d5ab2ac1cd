"""Validation, scoring, curves and requests on small fixtures; sources and sinks."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import curves as C, evaluate as E, extract as X, quality as Q, resolve as V
from tidemark.plans.queries import QUERIES
from tidemark.sources import io as S

GOOD = {"id": "a", "text": "t", "tags": ["x"], "expected": {"quantity": "csdaRange", "compareDim": "none", "particles": [{"match": "p"}], "materials": [{"match": "water"}], "energies": [{"value": 1, "unit": "MeV"}], "assumptions": [], "confidence": 0.5}}


def changed(path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return json.dumps(out)


CASES = [
    (json.dumps(GOOD), []),
    (changed(["expected", "quantity"], "bogus"), ["expected.quantity"]),
    (changed(["expected", "quantity"], 2), ["expected.quantity"]),
    (changed(["expected", "energies"], [{"value": "2", "unit": "kg"}, 7]), ["expected.energies[0].unit", "expected.energies[0].value", "expected.energies[1]"]),
    (changed(["expected", "energies"], {}), ["expected.energies"]),
    (changed(["expected", "particles"], [{"match": ""}, {"match": "p", "isotopeAssumed": 3}]), ["expected.particles[0].match", "expected.particles[1].isotopeAssumed"]),
    (changed(["expected", "energies"], [{"value": 1, "unit": "MeV", "perNucleonAssumed": "no"}]), ["expected.energies[0].perNucleonAssumed"]),
    (changed(["expected", "quantity"], "energyFromRange"), ["expected.target"]),
    (changed(["expected", "target"], {"value": 1, "unit": "cm"}), ["expected.target"]),
    (changed(["expected", "confidence"], 2), ["expected.confidence"]),
    (changed(["expected", "confidence"], "0.5"), ["expected.confidence"]),
    (changed(["expected", "assumptions"], [1]), ["expected.assumptions"]),
    (changed(["expected", "program"], 1), ["expected.program"]),
    (changed(["text"], " "), ["text"]),
    (changed(["audio"], None), []),
    (changed(["audio"], 1), ["audio"]),
    (changed(["tags"], []), ["tags"]),
    (changed(["id"], ""), ["id"]),
    ("[1]", [""]),
]


def test_violations(spark):
    lines = spark.createDataFrame([(k + 1, v) for k, (v, _) in enumerate(CASES)], "line_no long, value string")
    found = Q.violations(Q.data_lines(lines)).groupBy("record_idx").agg(F.sort_array(F.collect_list("path")).alias("p")).collect()
    got = {r.record_idx: r.p for r in found}
    assert [got.get(k, []) for k in range(len(CASES))] == [sorted(p) for _, p in CASES]
    rows = lambda df: sorted(map(tuple, df.select("record_idx", "line_no", "path", "message").collect()))
    assert rows(Q.line_violations(lines)) == rows(Q.violations(Q.data_lines(lines)))


def test_numbering_malformed_and_duplicates(spark, tmp_path):
    rows = ["# head", json.dumps(GOOD), "", "{bad", json.dumps(GOOD), "  // x", json.dumps(GOOD | {"id": 5})]
    (tmp_path / "f.jsonl").write_text("\n".join(rows))
    lines = S.read_numbered_lines(spark, str(tmp_path / "f.jsonl"))
    assert [r.line_no for r in Q.malformed_lines(lines).collect()] == [4]
    records = Q.data_lines(lines)
    assert {(r.line_no, r.record_idx) for r in records.collect()} == {(2, 0), (4, None), (5, 1), (7, 2)}
    assert [r.line_no for r in Q.duplicate_ids(Q.record_ids(records)).collect()] == [5]
    assert sorted(map(tuple, Q.line_ids(lines).collect()), key=repr) == sorted(map(tuple, Q.record_ids(records).collect()), key=repr)
    report = Q.validation_report(lines, spark.createDataFrame([("x",)], "tag string"), 1).first()
    assert (report["count"], report.errors, report.ok, report.passed) == (3, 3, False, False)
    own = S.read_labelled_jsonl(spark, str(tmp_path / "f.jsonl"), "id string, text string")
    assert own.filter("id is not null").count() == 3 and own.count() == 4


def test_bands_hold_all_rows(spark):
    rows = spark.createDataFrame([(c, True) for c in (1.0, 0.9, 0.8, 0.5, 0.0)], "confidence double, exact boolean")
    assert {r.label: r.total for r in E.calibration(rows).collect()} == {"[0.90, 1.00]": 2, "[0.80, 0.90)": 1, "[0.50, 0.80)": 1, "[0.00, 0.50)": 1}
    assert {r.total for r in E.calibration(rows.limit(0)).collect()} == {0}
    empty = E.coverage_summary(rows.withColumn("slot", F.lit(True)).limit(0)).first()
    assert empty.total == 0 and empty.slot_rate is None


@pytest.fixture
def as_dealt(spark):
    """Small partitions stay as they were dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def curves(spark):
    rows = []
    for m, b in ((1, -0.8), (2, 1.0), (3, -2.0)):
        rows += [(1, 1, m, float(e), 5.0 * e**b, None) for e in (1, 2, 4, 9, 30, 100)]
    rows += [(1, 1, 4, float(e), e * math.exp(-e / 10), 0.0) for e in range(1, 60)]
    rows += [(1, 1, 5, 1.0, 2.0, None), (1, 1, 5, 3.0, 4.0, None)]
    return spark.createDataFrame(rows, "program_id int, particle_id int, material_id int, energy double, stopping_power double, range0 double")


def test_power_laws_are_exact_and_invert(spark, curves):
    cells = C.curve_cells(curves).persist()
    points = spark.createDataFrame([(1, 1, m, e) for m in (1, 2, 3) for e in (1.0, 1.5, 9.0, 77.7, 100.0)], "program_id int, particle_id int, material_id int, energy double")
    found = C.lookup_stopping_power(points, cells)
    for r in found.collect():
        b = {1: -0.8, 2: 1.0, 3: -2.0}[r.material_id]
        whole = math.log(r.energy) / 5 if b == 1 else (r.energy ** (1 - b) - 1) / (5 * (1 - b))
        assert math.isclose(r.stopping_power, 5 * r.energy**b, rel_tol=1e-12) and math.isclose(r.csda_range, whole, rel_tol=1e-12, abs_tol=1e-15)
    back = C.inverse_range(found.select("program_id", "particle_id", "material_id", F.col("csda_range").alias("value"), F.col("energy").alias("was")), cells)
    assert all(math.isclose(r.energy, r.was, rel_tol=1e-9) for r in back.collect())


def test_outside_and_bad_points(spark, curves):
    points = spark.createDataFrame([(k, 1, 1, 1, e) for k, e in enumerate([0.5, 101.0, float("nan"), 100.0])], "leg int, program_id int, particle_id int, material_id int, energy double")
    found = {r.leg: r.stopping_power for r in C.lookup_stopping_power(points, C.curve_cells(curves), with_range=False).collect()}
    assert [found[k] is None for k in range(4)] == [True, True, True, False]
    told = {r.leg: r.leg_error for r in C.check_bounds(points, C.energy_bounds(curves), ["leg"]).collect()}
    assert [told[k] is None for k in range(4)] == [False, False, False, True]


def test_long_curves_are_merged_in_ranges(spark, as_dealt):
    import random

    rng = random.Random(4)
    long = [(1, 1, 1, 1 + k / 100, 5.0 * (1 + k / 100) ** -0.8, 0.5) for k in range(20_000)]
    some = [(1, 1, m, float(e), 3.0 * e**-0.5, None) for m in (2, 3) for e in (1, 2, 5, 9)]
    grid = spark.createDataFrame(long + some, "program_id int, particle_id int, material_id int, energy double, stopping_power double, range0 double").repartition(4)
    cells, split = C.curve_cells(grid).persist(), C.long_curve_cells(grid).persist()
    key = [*C.CURVE, "e0"]
    both = cells.join(split.select(*key, F.col("e1").alias("f1"), F.col("r0").alias("q0"), F.col("r1").alias("q1"), F.col("last").alias("l"), F.col("range_is_relative").alias("rel")), key, "full")
    assert both.count() == 20_005 and both.filter("not (e1 = f1 and last = l and range_is_relative = rel and abs(r0 - q0) <= 1e-9 * r1 and abs(r1 - q1) <= 1e-9 * r1) or l is null or last is null").isEmpty()
    asked = [(1, 1, 1, rng.choice([rng.uniform(0.5, 202), 1.0, 200.99, 50.0])) for _ in range(3000)] + [(1, 1, m, e) for m in (2, 3, 4, None) for e in (0.5, 1.0, 4.0, 9.0, 9.1, float("nan"), None)]
    points = spark.createDataFrame([(k, *r) for k, r in enumerate(asked)], "k int, program_id int, particle_id int, material_id int, energy double").repartition(3)
    of = lambda df: {r.k: (r.stopping_power, r.csda_range) for r in df.collect()}
    near = lambda x, y: (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12))
    one, two = of(C.lookup_stopping_power(points, cells)), of(C.lookup_stopping_power(points, split, long_curves=True))
    assert one.keys() == two.keys() and all(near(a, b) for k in one for a, b in zip(one[k], two[k], strict=True))
    targets = points.withColumn("value", F.col("energy") / 3).drop("energy")
    one, two = ({r.k: r.energy for r in C.inverse_range(targets, c, long_curves=x).collect()} for c, x in ((cells, False), (split, True)))
    assert one.keys() == two.keys() and all(near(one[k], two[k]) for k in one)
    parts = C._stretches(grid, *C.CURVE, "energy").groupBy("material_id", "_part").count().filter("material_id = 1").collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 12_000  # one curve, several tasks


def test_both_branches(spark, curves):
    peak = C.bragg_peak(curves).filter("material_id = 4").first()
    assert peak.peak_energy == 10.0
    t = spark.createDataFrame([(k, 1, 1, 4, v, s) for k, (v, s) in enumerate([(2.0, 0), (2.0, 1), (99.0, 1)])], "k int, program_id int, particle_id int, material_id int, value double, side int")
    found = {r.k: r for r in C.inverse_stopping_power(t, curves, C.curve_cells(curves), ["k"]).collect()}
    assert found[0].energy < 10 < found[1].energy and found[2].energy is None and found[2].error
    for k in (0, 1):
        assert math.isclose(found[k].energy * math.exp(-found[k].energy / 10), 2.0, rel_tol=2e-2)


def test_units(spark):
    rows = spark.createDataFrame([(100.0, "MeV/nucl", None, 20, 0.0, 100.0), (1200.0, "MeV", False, 12, 0.0, 100.0), (40.0, "MeV", None, 1, 0.0, 40.0), (240.0, "keV", False, 12, 0.0, 0.02), (10.0, "MeV/u", True, 12, 12.0, 10.0)], "v double, u string, f boolean, a int, m double, want double")
    assert rows.filter(F.abs(C.energy_to_mev_per_nucl(F.col("v"), F.col("u"), F.col("f"), F.col("a"), F.col("m")) - F.col("want")) > 1e-12).isEmpty()
    r = spark.range(1).select(C.range_target_to_areal(F.lit(10.0), F.lit("um"), F.lit(2.0)).alias("a"), C.range_target_to_areal(F.lit(1.0), F.lit("mm"), F.lit(None).cast("double")).alias("b"), C.stp_target_to_mass(F.lit(1.0), F.lit("keV/um"), F.lit(2.0)).alias("c")).first()
    assert math.isclose(r.a.value, 0.002) and r.b.error and r.c.value == 5.0


def test_sinks(spark, curves, tmp_path):
    catalogue = spark.createDataFrame([(1, "A_one"), (2, "b")], "id int, name string")
    S.write_dictionary(catalogue, spark.createDataFrame([("z", 1), ("a", 1)], "alias_key string, entity_id int"), str(tmp_path / "d"))
    found = {r.id: r.aliases for r in spark.read.json(str(tmp_path / "d")).collect()}
    assert found == {1: ["a", "z"], 2: []}
    S.write_results(curves.drop("range0"), str(tmp_path / "c"))
    own = S.read_curves(spark, str(tmp_path / "c"))
    assert "range0" in own.columns and own.count() == curves.count()
    assert {r.name for r in S.supported(own, catalogue, "material_id").collect()} == {"A One", "B"}
    assert [r.id for r in S.programs(catalogue, catalogue.filter("id = 2")).collect()] == [1]


def test_nested_results_are_grouped_as_they_lie(spark):
    from tidemark.operators import requests as R

    rows = [(r, "csdaRange", leg, "l", 1, 2, 3, "p", pos, 1.0 * pos, 2.0, 3.0, None) for r in range(20) for leg in range(2) for pos in range(3)]
    rows += [(20, "csdaRange", 0, "l", 1, 2, 3, "p", None, None, None, None, "bad leg"), (21, "csdaRange", None, None, None, None, None, None, None, None, None, None, "bad request")]
    schema = "request_id long, quantity string, leg int, label string, particle_id int, material_id int, program_id int, program_name string, pos int, energy double, stopping_power double, csda_range double, error string"
    nested = R.nest_results(spark.createDataFrame(rows, schema))
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    got = {r.request_id: r for r in nested.collect()}
    assert len(got) == 22 and [[p.pos for p in s.points] for s in got[3].series] == [[0, 1, 2]] * 2
    assert got[20].series[0].error == "bad leg" and got[20].series[0].points == [] and got[21].request_error == "bad request" and got[21].series is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_extracted_once(spark):
    seen = []

    def lengths(t):
        seen.append(sorted(r.text for r in t.collect()))
        return t.filter("text <> 'none'").select("id", F.length("text").alias("n"))

    q = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "abc"), (5, ""), (6, "none")], "id long, text string")
    rows = {r.id: r.n for r in X.each_text(q, lengths).collect()}
    assert seen == [["", "ab", "abc", "none"]]
    assert rows == {1: 2, 2: 2, 3: 0, 4: 3, 5: 0, 6: None}


def test_tables_of_a_row_for_each_id_are_not_broadcast(spark):
    """Repeated texts take so little room on disk that Spark would gather millions of rows in the driver."""
    t = spark.createDataFrame([(1, "range of 5 MeV protons in water"), (2, "how far will 3 MeV carbon ions travel in air")], "id long, text string")
    found = X.extract_distinct_intents(t, *X.seed_resolvers(spark))
    assert "BroadcastHashJoin [id" not in plan(found)
    assert {r.id: [m.match for m in r.intent.materials] for r in found.collect()} == {1: ["water"], 2: ["air"]}
    points = spark.createDataFrame([(1, 1, 1, 5.0), (2, 1, 1, 50.0)], "leg int, program_id int, particle_id int, energy double")
    limits = spark.createDataFrame([(1, 1, 1.0, 10.0)], "program_id int, particle_id int, min_energy double, max_energy double")
    checked = C.check_bounds(points, limits, ["leg"])
    assert "BroadcastHashJoin [leg" not in plan(checked)
    assert {r.leg: r.leg_error is None for r in checked.collect()} == {1: True, 2: False}
    phrases = spark.createDataFrame([("a",), ("b",), (None,)], "phrase string")
    resolved = spark.createDataFrame([("a", [1, 2])], "phrase string, v array<int>")
    wide = V.resolve_all(phrases, resolved, lookup_rows=0, heavy_share=1)
    assert "SortMergeJoin [phrase" in plan(wide)
    assert {r.phrase: r.v for r in wide.collect()} == {"a": [1, 2], "b": None, None: None}


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(1, '{"id": "a"}'), (2, "# note"), (3, '{"id": '), (4, '{"id": "a"}'), (5, '{"id": 7}')], "line_no long, value string")
    ids = Q.line_ids(lines)
    assert "parse_json" not in plan(Q.duplicate_ids(ids))
    assert [(r.line_no, r.record_idx, r.id) for r in ids.orderBy("line_no").collect()] == [(1, 0, "a"), (4, 1, "a"), (5, 2, None)]
    assert [r.line_no for r in Q.duplicate_ids(ids).collect()] == [4]


@pytest.mark.parametrize("name", ["programs", "material_mentions", "particle_mentions"])
def test_queries_match_patterns_in_distinct_texts(spark, name):
    """What is left to do for each row is a lookup by text; patterns were matched in every row, a file's rows in one task."""
    assert "regexp" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_inverse_targets_are_dealt_once(spark):
    """Targets were grouped, dealt to the cells and grouped again, each time as many to a task as a file's split held."""
    assert plan(QUERIES["inverse_branch"](spark, "/root/testdata/sf0.001")).count("Exchange hashpartitioning") <= 1
