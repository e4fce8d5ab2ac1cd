"""Reference values of normalization, resolution and extraction."""

import pytest
from pyspark.sql import functions as F

from tidemark import seed
from tidemark.functions import text as T
from tidemark.operators import dictionary as D, extract as X, resolve as V


@pytest.fixture(scope="module")
def resolvers(spark):
    return X.seed_resolvers(spark)


def test_normalize(spark):
    cases = {"  WATER ": "water", "Bone, Cortical (ICRP)": "bone cortical icrp", "carbon-13": "carbon 13", "TISSUE_EQUIVALENT_GAS": "tissue equivalent gas", "¹²C": "12c", "²⁰Ne": "20ne", "α": "α", "Café": "cafe", "": "", "ﬁne½": "fine1 2", "Ά Ёлка й": "α елка и"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.normalize_text(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == cases
    again = spark.createDataFrame([(v,) for v in cases.values()], "x string").filter(T.normalize_text(F.col("x")) != F.col("x"))
    assert again.isEmpty()


def test_every_code_point_decomposes(spark):
    import unicodedata

    less = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(x) <= 0x36F)
    points = [cp for cp in range(1, 0x110000) if unicodedata.category(chr(cp)) not in ("Cn", "Cs", "Co")]
    df = spark.createDataFrame([(cp, f"x{chr(cp)}y") for cp in points], "cp int, c string").repartition(4)
    rows = df.select("cp", F.lower(T.decompose(F.col("c"))).alias("folded"), T.normalize_text(F.col("c")).alias("norm")).collect()
    assert len(rows) == len(points) > 140_000
    assert [r.cp for r in rows if r.folded != less(f"x{chr(r.cp)}y").lower()] == []
    key = lambda s: " ".join("".join(x if unicodedata.category(x)[0] in "LN" else " " for x in s).split())
    other = [r.cp for r in rows if r.norm != key(less(f"x{chr(r.cp)}y").lower())]
    assert not [cp for cp in other if spark._jvm.java.lang.Character.isDefined(cp)]  # letters that the JVM does not know yet
    both = spark.createDataFrame([("각 Å ｶﾞ",), (unicodedata.normalize("NFD", "각 Å ｶﾞ"),), ("\ue000각 Å  ｶﾞ",)], "c string")
    assert both.select(T.normalize_text(F.col("c")).alias("k")).distinct().count() == 1


def test_spans_are_offsets_of_the_text(spark):
    text = "é 12 and 345\U0001F600 6"
    found = spark.createDataFrame([(text,)], "x string").select(T.match_spans(F.col("x"), "[0-9]+").alias("m")).first().m
    assert [(m.text, text[m.start : m.end]) for m in found] == [("12", "12"), ("345", "345"), ("6", "6")]


def test_dictionary_sizes_and_integrity(spark):
    materials, particles = D.material_dictionary(spark), D.particle_dictionary(spark)
    elements = seed.elements(spark)
    catalogue = D.build_catalogue(elements, seed.compounds(spark))
    assert (materials.count(), particles.count(), catalogue.count()) == (380, 267, 247)
    assert D.audit_dictionary(materials, catalogue).isEmpty()
    assert D.audit_dictionary(particles, D.build_particle_catalogue(elements)).isEmpty()
    assert D.export_dictionary(catalogue, materials).filter("size(aliases) = 0").count() == 10
    assert D.dictionary_drift(materials, D.material_dictionary(spark)).isEmpty()


def test_materials(spark, resolvers):
    expected = {**dict.fromkeys(["PMMA", "Lucite", "Perspex", "Plexiglas", "Plexiglass", "acrylic"], 223), **dict.fromkeys(["water", "liquid water", "water target", "watr", "a water"], 276), "water vapor": 277, "air": 104, "gold": 79, "Au": 79, "aluminum": 13, "aluminium absorber": 13, "graphite": 906, "glass": 169, "unobtainium": None, "": None, None: None}
    phrases = spark.createDataFrame([(k,) for k in expected], "phrase string")
    found = V.resolve_all(phrases, resolvers[1](phrases)).collect()
    assert {r.phrase: r.entity_id for r in found} == expected
    assert {r.phrase for r in found if r.match_kind == "fuzzy"} == {"watr", "a water"}


def test_particles(spark, resolvers):
    expected = {
        "protons": (1, 1, False), "alpha particle": (2, 4, False), "electron": (1001, 0, False), "carbon ions": (6, 12, True), "neon ion": (10, 20, True), "helium": (2, 4, True), "carbon-13 ions": (6, 13, False),
        "helium-3 ion": (2, 3, False), "13C": (6, 13, False), "C-13": (6, 13, False), "deuterons": (1, 2, False), "triton": (1, 3, False), "p": (1, 1, False), "P": (15, 31, True), "P ions": (15, 31, True), "protn": (1, 1, False), "phlogiston": (None, None, None), "carbon 999": (6, 999, False),
    }
    phrases = spark.createDataFrame([(k,) for k in expected], "phrase string")
    found = V.resolve_all(phrases, resolvers[0](phrases)).collect()
    assert {r.phrase: (r.entity_id, r.mass_number, r.isotope_assumed) for r in found} == expected
    assert {r.phrase: r.isotope for r in found}["carbon ions"] == "¹²C"


SENTENCES = [
    ("What is the stopping power of 40 MeV protons in PMMA?", "stoppingPower", "direct", "none", ["protons"], ["PMMA"], [(40.0, "MeV", None)], None, [], 0.97),
    ("range of 500 keV/u neon ions in air", "csdaRange", "direct", "none", ["neon ions"], ["air"], [(0.5, "MeV/u", True)], None, ["neon → ²⁰Ne"], 0.97),
    ("1.2 GeV per nucleon carbon ions range in water", "csdaRange", "direct", "none", ["carbon ions"], ["water"], [(1200.0, "MeV/nucl", True)], None, ["carbon → ¹²C"], 0.97),
    ("range of 1200 MeV carbon ions in water", "csdaRange", "direct", "none", ["carbon ions"], ["water"], [(1200.0, "MeV", False)], None, ["carbon → ¹²C", "1200 MeV taken as total → 100 MeV/nucl"], 0.97),
    ("10 MeV alpha range in gold", "csdaRange", "direct", "none", ["alpha"], ["gold"], [(10.0, "MeV", None)], None, [], 0.97),
    ("compare range of protons, helium, and carbon ions at 48 MeV in water", "csdaRange", "direct", "particle", ["protons", "helium", "carbon"], ["water"], [(48.0, "MeV", False)], None, ["helium → ⁴He", "carbon → ¹²C", "48 MeV taken as total → 12 MeV/nucl"], 0.97),
    ("stopping power of protons in water at 50, 100, and 150 MeV", "stoppingPower", "direct", "energy", ["protons"], ["water"], [(50.0, "MeV", None), (100.0, "MeV", None), (150.0, "MeV", None)], None, [], 0.97),
    ("compare PSTAR and MSTAR for 10 MeV protons in water", "csdaRange", "default", "program", ["protons"], ["water"], [(10.0, "MeV", None)], None, [], 0.5),
    ("what proton energy has a range of 10 cm in water?", "energyFromRange", "inverse", "none", ["proton"], ["water"], [], (10.0, "cm"), [], 0.9),
    ("Which energy gives 10 µm in graphite for protons", "energyFromRange", "inverse", "none", ["protons"], ["graphite"], [], (10.0, "um"), [], 0.9),
    ("1,200 MeV protons range in Al", "csdaRange", "direct", "energy", ["protons"], [], [(1.0, "MeV", None), (200.0, "MeV", None)], None, [], 0.4),
    ("240 keV carbon ions range in water", "csdaRange", "direct", "none", ["carbon ions"], ["water"], [(240.0, "keV", False)], None, ["carbon → ¹²C", "240 keV taken as total → 20 keV/nucl"], 0.97),
    (None, "csdaRange", "default", "none", [], [], [], None, [], 0.4),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_sentences(spark, resolvers, parts):
    q = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SENTENCES)], "id long, text string").repartition(parts)
    found = {r.id: r for r in X.extract_intents(q, *resolvers).collect()}
    for k, (_, quantity, source, dim, particles, materials, energies, target, notes, confidence) in enumerate(SENTENCES):
        r = found[k]
        i = r.intent
        told = (i.quantity, r.source, i.compare_dim, [p.match for p in i.particles], [m.match for m in i.materials], [tuple(e) for e in i.energies], i.target and tuple(i.target), i.assumptions, i.confidence)
        assert told == (quantity, source, dim, particles, materials, energies, target, notes, confidence), SENTENCES[k][0]


def test_plans_stay_in_the_engine(spark, resolvers):
    q = spark.createDataFrame([(1, "range of 5 MeV protons in water")], "id long, text string")
    plan = X.extract_intents(q, *resolvers)._jdf.queryExecution().toString()
    assert "Python" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_numbers_on_a_stream(spark, tmp_path):
    from tidemark.streaming.slots import stream_numbers

    spark.createDataFrame([(1, "stopping power of 5 MeV protons"), (2, None)], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    run = stream_numbers(stream).select("id", "quantity", F.size("_energies").alias("n")).writeStream.format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.id, r.quantity) for r in spark.table("slots").collect()} == {(1, "stoppingPower"), (2, "csdaRange")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("hot", [2000, 3])
def test_fuzzy_matches_brute_force(spark, hot):
    import random

    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abc ") for _ in range(n)).strip()
    aliases = sorted({letters(rng.randrange(2, 14)) for _ in range(120)} | {"family" + letters(5) for _ in range(40)})

    def changed(text):
        out = list(text)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(out) + 1)
            out[k : k + rng.randrange(2)] = rng.choice(["", "b", "x"])
        return "".join(out)

    phrases = sorted({changed(rng.choice(aliases)) for _ in range(300)} | {"ab", "family", ""})
    want = {}
    for p in phrases:
        close = [(distance(p, a), k) for k, a in enumerate(aliases)] if len(p) >= 3 else []
        if close := [x for x in close if x[0] <= (2 if len(p) >= 7 else 1)]:
            want[p] = min(close)[1]
    d = spark.createDataFrame([(a, k, k) for k, a in enumerate(aliases)], "alias_key string, entity_id int, ord long")
    keyed = spark.createDataFrame([(p, p, p) for p in phrases], "phrase string, norm string, stripped string")
    assert {r.phrase: r.entity_id for r in V.resolve_fuzzy(keyed, d, hot).collect()} == want


def test_a_family_of_aliases_meets_in_small_buckets(spark):
    """A segment that all aliases share is not joined on; what is has a bound that the family does not move."""
    for n in (500, 2000):
        family = spark.range(n).select(F.concat(F.lit("polymethyl"), F.lpad(F.conv(F.col("id") * 7919 % 46656, 10, 36), 4, "0")).alias("alias_key"))
        keys = family.select(F.explode(V.deletions(F.col("alias_key"), 2)).alias("key")).groupBy("key").count()
        assert keys.agg(F.max("count")).first()[0] <= 36 * 36
        segments = family.select(F.explode(V.alias_segments(F.col("alias_key"), 2)).alias("seg")).groupBy("seg").count()
        assert segments.agg(F.max("count")).first()[0] == n


def test_frequent_phrases_are_not_shuffled(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, "protons").when(F.col("id") % 20 == 0, F.concat(F.lit("x"), F.col("id"))).alias("phrase"))
    found = spark.createDataFrame([("protons", 1), ("x20", 2), ("x40", 3)], "phrase string, entity_id int")
    want = {(p, e): n for p, e, n in [("protons", 1, 3600), (None, None, 200), ("x20", 2, 1), ("x40", 3, 1)]}
    for lookup_rows in (100, 0):
        got = V.resolve_all(rows, found, lookup_rows=lookup_rows, heavy_share=100)
        counts = {(r.phrase, r.entity_id): r["count"] for r in got.filter("phrase is null or entity_id is not null").groupBy("phrase", "entity_id").count().collect()}
        assert counts == want and got.count() == 4000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 3  # what most rows have is looked up where the rows are


def test_ledger_resolves_phrases_once(spark, tmp_path):
    asked = []

    def resolver(phrases):
        asked.extend(r.phrase for r in phrases.collect())
        return phrases.filter("phrase like 'a%'").select("phrase", F.lit(7).alias("entity_id"), F.lit("exact").alias("match_kind"))

    of = lambda *xs: spark.createDataFrame([(x,) for x in xs], "phrase string")
    run = lambda version, *xs: sorted(r.phrase for r in V.resolve_with_ledger(of(*xs), resolver, str(tmp_path / "ledger"), version).collect())
    assert run("v1", "a", "b", "a", None) == ["a"] and sorted(asked) == ["a", "b"]
    assert run("v1", "b", "a2", "a") == ["a", "a2"] and sorted(asked) == ["a", "a2", "b"]
    assert run("v1", "b", "b") == [] and len(asked) == 3
    assert run("v2", "b") == [] and len(asked) == 4
    d = of("x", "y")
    assert V.dictionary_version(d) == V.dictionary_version(of("y", "x")) != V.dictionary_version(of("x", "y", "y"))


def test_rows_of_overlapping_spans_match_brute_force(spark):
    import random

    rng = random.Random(2)
    span = lambda far, most: (lambda s: (s, s + rng.randrange(most)))(rng.randrange(far))
    spans = [(k, *span(400, 30)) for k in (1, 2, None) for _ in range(150)] + [(3, 5, 9), (3, 5, 9), (1, 0, 400)]
    claims = [(k, *span(400, 12)) for k in (1, 2) for _ in range(25)] + [(4, 0, 9), (3, 9, 12), (None, 50, 50)]
    hit = lambda s: s[1] < s[2] and any(c[0] == s[0] and c[1] < c[2] and c[1] < s[2] and s[1] < c[2] for c in claims)
    frames = [spark.createDataFrame(x, "doc long, start int, end int") for x in (spans, claims)]
    for width in (7, 64, 4096):
        got = X.drop_overlapping_rows(*frames, ["doc"], width)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(s) for s in spans if not hit(s))


def test_longest_spans_first_match_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(60):
        starts = sorted(rng.sample(range(60), rng.randrange(25)))
        rows.append((k, [(s, s + 4 * n - 1, n) for s in starts for n in rng.sample([1, 2, 3], rng.randrange(4))]))
    kind = "struct<start:int,end:int,n:int>"
    df = spark.createDataFrame(rows, f"k int, c array<{kind}>")
    got = {r.k: [tuple(x) for x in r.c] for r in df.select("k", X.longest_first(F.col("c"), 3, kind).alias("c")).collect()}
    for k, spans in rows:
        taken = []
        for s in sorted(spans, key=lambda x: (-x[2], x[0])):
            if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
                taken.append(s)
        assert got[k] == sorted(taken), k


def test_plans_hold_the_folding_tables_once(spark):
    """A fuzzy lookup read its keys ten times, and each read had all tables of the decomposition several times."""
    table = T.decompositions()[1][:100]
    copies = lambda df: df._jdf.queryExecution().toString().count(table)
    phrases = spark.createDataFrame([("Ångströmm",), ("waterr",)], "phrase string")
    assert copies(phrases.select(T.normalize_text(F.col("phrase")).alias("k"))) <= 4  # parsed, analyzed, optimized, physical
    d = spark.createDataFrame([("angstrom", 1, 0), ("water", 2, 1)], "alias_key string, entity_id int, ord int")
    found = V.resolve_fuzzy(V.with_keys(phrases), d)
    assert copies(found) == 0
    assert {(r.phrase, r.entity_id) for r in found.collect()} == {("Ångströmm", 1), ("waterr", 2)}
