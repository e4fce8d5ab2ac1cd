"""Registered queries: each operator over whole tables, and the SQL that gives the same rows.

The tables have no physics sentences, so requests are made from `events`: the template that a row gets is also its gold
label. Curves come from `part`, probes from `lineitem`, scored predictions from `documents` and `labels`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import seed
from ..functions import text as T
from ..functions.tables import saved, shared_dir, spread
from ..operators import curves as C, dictionary as D, evaluate as E, extract as X, quality as Q, requests as R, resolve as V
from ..sources import io as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table whose texts are costly to work on."""
    return spread(table(spark, sf_dir, name), *keys)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- requests from events: these expressions are valid in Spark SQL and in the oracle's SQL
N = "(CAST(floor(value) AS BIGINT) + 1)"
MATERIAL = "CASE user_id % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'PMMA' WHEN 2 THEN 'air' ELSE 'graphite' END"
TEXT = f"""CASE event_type
 WHEN 'click' THEN concat('What is the stopping power of ', {N}, ' MeV protons in ', {MATERIAL}, '?')
 WHEN 'view' THEN concat('how far will ', {N}, ' MeV/nucl carbon ions travel in ', {MATERIAL})
 WHEN 'purchase' THEN concat('range of ', {N}, ' MeV carbon ions in ', {MATERIAL})
 WHEN 'signup' THEN concat('compare the range of protons, helium, and carbon ions at ', {N}, ' MeV in ', {MATERIAL})
 ELSE concat('what proton energy has a range of ', {N}, ' mm in ', {MATERIAL}, '?') END"""
REQUESTS = f"q AS (SELECT event_id AS id, {TEXT} AS text, {N} AS n, {MATERIAL} AS material, event_type, user_id, CASE user_id % 4 WHEN 0 THEN 276 WHEN 1 THEN 223 WHEN 2 THEN 104 ELSE 906 END AS material_id FROM events)"
SHORTEST = "regexp_replace(regexp_replace(CAST(CAST(round({0}, 6) AS DECIMAL(30,6)) AS VARCHAR), '0+$', ''), '\\.$', '')"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "events", "event_id").selectExpr("event_id AS id", f"{TEXT} AS text", f"{N} AS n", f"{MATERIAL} AS material", "event_type", "user_id")


# --- text columns
@query(r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


WORD_OF = "CASE p_partkey % 5 WHEN 0 THEN 'Ά Σίγμα ἀθῆναι' WHEN 1 THEN 'Ёлка й КИЇВ' WHEN 2 THEN 'Crème Brûlée Ångström' WHEN 3 THEN 'Ὕδωρ Ωμέγα' ELSE 'Йод Ў' END"
SYLLABLES = "list_reduce(list_transform(string_split(x, ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN concat(chr(4352 + (unicode(c) - 44032) // 588), chr(4449 + (unicode(c) - 44032) % 588 // 28), CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN chr(4519 + (unicode(c) - 44032) % 28) ELSE '' END) ELSE c END), lambda a, b: concat(a, b))"


@query(rf"""WITH t AS (SELECT p_partkey, strip_accents(concat(p_name, ' ', chr(CAST(44032 + p_partkey % 11172 AS INT)), chr(CAST(44032 + p_partkey * 7 % 11172 AS INT)), '-', {WORD_OF})) AS x FROM part)
SELECT p_partkey, trim(regexp_replace(lower({SYLLABLES}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm FROM t""")
def normalize_scripts(spark, sf_dir):
    """Greek, Cyrillic, accented Latin and all Hangul syllables."""

    def syllable(of: str) -> str:
        code = f"(44032 + {of} % 11172)"
        return f"decode(unhex(concat(hex(224 + {code} div 4096), hex(128 + {code} div 64 % 64), hex(128 + {code} % 64))), 'UTF-8')"

    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"concat(p_name, ' ', {syllable('p_partkey')}, {syllable('p_partkey * 7')}, '-', {WORD_OF}) AS text")
    return p.select("p_partkey", T.normalize_text(F.col("text")).alias("norm"))


PHRASE = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' beam targets' WHEN 1 THEN ' Ions' WHEN 2 THEN 's' ELSE ' gas' END)"
NOISY = "|".join(T.NOISE)


@query(f"""WITH b AS (SELECT p_partkey, regexp_replace(lower({PHRASE}), '( ({NOISY}))+$', '') AS s FROM part)
SELECT p_partkey, CASE WHEN length(s) > 3 AND s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, length(s) - 1) ELSE s END AS stripped FROM b""")
def noise_strip(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PHRASE} AS phrase")
    return p.select("p_partkey", T.strip_noise(T.normalize_text(F.col("phrase"))).alias("stripped"))


@query(rf"""SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array({PHRASE}, '[\s,]+'), lambda w: w <> '' AND NOT regexp_matches(lower(w), '^({NOISY})$')), ' ') AS core FROM part""")
def core_token(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PHRASE} AS phrase").select("p_partkey", T.core_token(F.col("phrase")).alias("core"))


@query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN '' ELSE concat(translate(CAST(user_id AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹'), upper(left(event_type, 1))) END AS label FROM events")
def isotope_label(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.isotope_label(F.when(F.col("user_id") % 7 == 0, 0).otherwise(F.col("user_id")), F.upper(F.left("event_type", F.lit(1)))).alias("label"))


@query(r"SELECT p_partkey, regexp_replace(upper(concat(p_brand, ' ', p_type)), '[^A-Z0-9]', '', 'g') AS name_key, regexp_replace(lower(concat(p_brand, ' ', p_type)), '\s+', '', 'g') AS unit_key FROM part")
def fold_keys(spark, sf_dir):
    c = F.concat_ws(" ", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.fold_name(c).alias("name_key"), T.fold_unit(c).alias("unit_key"))


def spans_sql(source: str, keys: str, pattern: str) -> str:
    """(keys, k, text, start, end) of all matches, from gaps and matches."""
    return rf"""s AS (SELECT {keys}, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM {source}),
k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM s),
spans AS (SELECT {keys}, k - 1 AS k, m[k] AS text, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS start FROM k)"""


@query(f"WITH {spans_sql('documents', 'doc_id', '[0-9]+')} SELECT doc_id, k, text, start, start + length(text) AS stop FROM spans")
def match_spans(spark, sf_dir):
    d = texts(spark, sf_dir, "documents", "doc_id").select("doc_id", F.posexplode(T.match_spans(F.col("text"), "[0-9]+")).alias("k", "m"))
    return d.select("doc_id", F.col("k").cast("long").alias("k"), "m.text", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("stop"))


@query(rf"""WITH {spans_sql('conversations', 'conv_id, turn', r'\p{L}[\p{L}0-9-]*')},
w AS (SELECT conv_id, turn, k, start, start + length(text) AS stop, lead(start + length(text), 1) OVER o AS stop2, lead(start + length(text), 2) OVER o AS stop3 FROM spans WINDOW o AS (PARTITION BY conv_id, turn ORDER BY k)),
g AS (SELECT conv_id, turn, 1 AS n, start, stop FROM w UNION ALL SELECT conv_id, turn, 2, start, stop2 FROM w WHERE stop2 IS NOT NULL UNION ALL SELECT conv_id, turn, 3, start, stop3 FROM w WHERE stop3 IS NOT NULL)
SELECT conv_id, turn, n, count(*) AS phrases, CAST(sum(stop - start) AS BIGINT) AS chars, CAST(sum(start) AS BIGINT) AS starts FROM g GROUP BY ALL""")
def token_ngrams(spark, sf_dir):
    c = texts(spark, sf_dir, "conversations", "conv_id", "turn").select("conv_id", "turn", "text", T.match_spans(F.col("text"), T.WORD).alias("tokens"))
    g = c.select("conv_id", "turn", F.explode(T.token_ngrams(F.col("text"), F.col("tokens"))).alias("g"))
    return g.groupBy("conv_id", "turn", "g.n").agg(F.count(F.lit(1)).alias("phrases"), F.sum(F.length("g.phrase")).alias("chars"), F.sum(F.col("g.start").cast("long")).alias("starts"))


# --- dictionaries
@query("SELECT p_partkey, lower(p_name) AS alias FROM part")
def base_alias(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")")).alias("name"))
    return D.derive_base_alias(p).select("p_partkey", "alias")


@query("SELECT concat(p_name, ' ', p_size) AS alias, min(p_brand) AS entity_id FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def drop_ambiguous(spark, sf_dir):
    return D.drop_ambiguous_alias(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("alias"), F.col("p_brand").alias("entity_id")))


@query("""WITH t AS (SELECT p_name AS alias, p_partkey AS entity_id, 0 AS tier, p_partkey AS seq FROM part UNION ALL
SELECT concat(p_name, ' ', p_size % 3), p_size, 1, p_partkey FROM part WHERE p_size > 25 UNION ALL SELECT p_name, 1000000 + p_partkey, 2, p_partkey FROM part WHERE p_size < 10),
g AS (SELECT alias AS alias_key, arg_max(entity_id, tier * 1000000000 + seq) AS entity_id, min(tier * 1000000000 + seq) AS f FROM t GROUP BY 1)
SELECT alias_key, entity_id, f // 1000000000 * 1099511627776 + f % 1000000000 AS ord FROM g""")
def dictionary_layers(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("seq", F.col("p_partkey"))
    one = p.select(F.col("p_name").alias("alias"), F.col("p_partkey").cast("long").alias("entity_id"), "seq")
    two = p.filter("p_size > 25").select(F.concat(F.upper("p_name"), F.lit(" - "), F.col("p_size") % 3).alias("alias"), F.col("p_size").cast("long").alias("entity_id"), "seq")
    three = p.filter("p_size < 10").select(F.col("p_name").alias("alias"), (1000000 + F.col("p_partkey")).cast("long").alias("entity_id"), "seq")
    return D.build_dictionary([one, two, three], ["entity_id"])


def part_dictionary(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()  # a few dozen names
    return names.select(F.col("p_name").alias("alias_key"), F.row_number().over(Window.orderBy("p_name")).alias("entity_id")).withColumn("ord", F.col("entity_id").cast("long"))


@query("SELECT p_brand AS name, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS aliases FROM part GROUP BY 1 UNION ALL SELECT 'none', ''")
def dictionary_export(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    brands = p.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct().unionByName(spark.createDataFrame([("none", "none")], "id string, name string"))
    return D.export_dictionary(brands, p.select(F.col("p_name").alias("alias_key"), F.col("p_brand").alias("entity_id")).distinct()).select("name", F.array_join("aliases", "|").alias("aliases"))


@query("""SELECT 'unknown_entity' AS problem, p_name AS alias_key, p_partkey AS entity_id FROM part WHERE p_partkey % 10 = 3 UNION ALL
SELECT 'not_normalized', concat(p_name, '!'), p_partkey FROM part WHERE p_partkey % 10 = 4 UNION ALL SELECT 'repeated_entity', NULL, p_partkey FROM part WHERE p_partkey % 10 = 5""")
def dictionary_audit(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.when(F.col("p_partkey") % 10 == 4, F.concat(F.col("p_name"), F.lit("!"))).otherwise(F.col("p_name"))
    ids = p.select(F.col("p_partkey").alias("id"))
    return D.audit_dictionary(p.select(key.alias("alias_key"), F.col("p_partkey").alias("entity_id")), ids.filter("id % 10 <> 3").unionByName(ids.filter("id % 10 = 5")))


@query("""SELECT p_partkey, p_name, 'stored' AS side FROM part WHERE p_partkey % 9 = 1 UNION ALL SELECT p_partkey, upper(p_name), 'rebuilt' FROM part WHERE p_partkey % 9 = 1""")
def dictionary_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return D.dictionary_drift(p, p.withColumn("p_name", F.when(F.col("p_partkey") % 9 == 1, F.upper("p_name")).otherwise(F.col("p_name"))))


# --- resolution
TYPO = """CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ions') WHEN 2 THEN concat(substr(p_name, 1, 1), substr(p_name, 3)) WHEN 3 THEN concat('x', p_name)
 WHEN 4 THEN upper(p_name) WHEN 5 THEN concat(p_name, 'qz targets') ELSE concat('qqq ', p_name) END"""
def resolved_sql(phrases: str) -> str:
    return f"""d AS (SELECT p_name AS alias_key, CAST(row_number() OVER (ORDER BY p_name) AS INT) AS entity_id FROM (SELECT DISTINCT p_name FROM part)),
ph AS ({phrases}), b AS (SELECT phrase, lower(phrase) AS norm, regexp_replace(lower(phrase), '( ({NOISY}))+$', '') AS s FROM ph),
k AS (SELECT phrase, norm, CASE WHEN length(s) > 3 AND s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, length(s) - 1) ELSE s END AS stripped FROM b),
e AS (SELECT k.*, d1.entity_id AS e1, d2.entity_id AS e2 FROM k LEFT JOIN d d1 ON norm = d1.alias_key LEFT JOIN d d2 ON stripped = d2.alias_key AND stripped <> norm),
f AS (SELECT phrase, arg_min(d.entity_id, levenshtein(stripped, alias_key) * 1000 + d.entity_id) AS e3 FROM e, d WHERE e1 IS NULL AND e2 IS NULL AND length(stripped) >= 3
 AND levenshtein(stripped, alias_key) <= CASE WHEN length(stripped) >= 7 THEN 2 ELSE 1 END GROUP BY 1),
r AS (SELECT e.phrase, coalesce(e1, e2, e3) AS entity_id, CASE WHEN e1 IS NOT NULL THEN 'exact' WHEN e2 IS NOT NULL THEN 'normalized' WHEN e3 IS NOT NULL THEN 'fuzzy' END AS match_kind FROM e LEFT JOIN f USING (phrase))"""


RESOLVED = resolved_sql(f"SELECT DISTINCT {TYPO} AS phrase FROM part")


def typos(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{TYPO} AS phrase")


@query(f"WITH {RESOLVED} SELECT p_partkey, p.phrase, entity_id, match_kind FROM (SELECT p_partkey, {TYPO} AS phrase FROM part) p LEFT JOIN r USING (phrase)")
def resolve_cascade(spark, sf_dir):
    d = saved(part_dictionary(spark, sf_dir), "dictionary")
    phrases = typos(spark, sf_dir)
    found = V.resolve_material(phrases, d, d.select(F.col("entity_id").alias("id"), F.col("alias_key").alias("name"), F.lit("part").alias("kind")))
    return V.resolve_all(phrases, found.select("phrase", "entity_id", "match_kind")).select("p_partkey", "phrase", "entity_id", "match_kind")


@query(f"WITH {resolved_sql(f'SELECT DISTINCT {TYPO} AS phrase FROM part UNION SELECT {PHRASE} FROM part')}, one AS (SELECT DISTINCT {TYPO} AS phrase FROM part) SELECT phrase, entity_id, match_kind, phrase IN (SELECT phrase FROM one) AS first_run FROM r WHERE entity_id IS NOT NULL")
def phrase_ledger(spark, sf_dir):
    """Two runs over one ledger: the second resolves only phrases that the first has not asked."""
    d = saved(part_dictionary(spark, sf_dir), "dictionary")
    catalogue = d.select(F.col("entity_id").alias("id"), F.col("alias_key").alias("name"), F.lit("part").alias("kind"))
    ledger, version = _place(spark, "ledger"), V.dictionary_version(d)
    asked = lambda p: V.resolve_material(p, d, catalogue).select("phrase", "entity_id", "match_kind")
    first = saved(V.resolve_with_ledger(typos(spark, sf_dir), asked, ledger, version).select("phrase").withColumn("first_run", F.lit(True)), "first-run")
    both = typos(spark, sf_dir).select("phrase").unionByName(table(spark, sf_dir, "part").selectExpr(f"{PHRASE} AS phrase"))
    found = V.resolve_with_ledger(both, asked, ledger, version)
    return found.join(first, "phrase", "left").select("phrase", "entity_id", "match_kind", F.coalesce("first_run", F.lit(False)).alias("first_run"))


def _tier(name: str):
    @query(f"WITH {RESOLVED} SELECT phrase, entity_id FROM r WHERE match_kind = '{name}'")
    def run(spark, sf_dir):
        d = saved(part_dictionary(spark, sf_dir), "dictionary")
        keyed = saved(V.with_keys(typos(spark, sf_dir).select("phrase").distinct()), "keyed")
        exact = V.resolve_exact(keyed, d)
        if name == "exact":
            return exact.select("phrase", "entity_id")
        rest = keyed.join(exact.select("phrase"), "phrase", "left_anti")
        stripped = V.resolve_normalized(rest, d)
        if name == "normalized":
            return stripped.select("phrase", "entity_id")
        return V.resolve_fuzzy(rest.join(stripped.select("phrase"), "phrase", "left_anti"), d).select("phrase", "entity_id")

    return run


for _name in ("exact", "normalized", "fuzzy"):
    QUERIES[f"resolve_{_name}"] = _tier(_name)
    ORACLE[f"resolve_{_name}"] = ORACLE.pop("run")
    QUERIES.pop("run")

PARTICLE = "CASE user_id % 9 WHEN 0 THEN 'P' WHEN 1 THEN 'p' WHEN 2 THEN 'carbon-13 ions' WHEN 3 THEN '13C' WHEN 4 THEN 'He 3' WHEN 5 THEN 'protn' WHEN 6 THEN 'neon ion' WHEN 7 THEN 'phlogiston' ELSE 'P ions' END"
PARTICLES = """p(phrase, entity_id, mass_number, isotope, isotope_assumed, match_kind) AS (VALUES ('P', 15, 31, '³¹P', true, 'exact'), ('p', 1, 1, '¹H', false, 'exact'), ('carbon-13 ions', 6, 13, '¹³C', false, 'isotope'),
('13C', 6, 13, '¹³C', false, 'isotope'), ('He 3', 2, 3, '³He', false, 'isotope'), ('protn', 1, 1, '¹H', false, 'fuzzy'), ('neon ion', 10, 20, '²⁰Ne', true, 'normalized'), ('P ions', 15, 31, '³¹P', true, 'exact'))"""


@query(f"WITH {PARTICLES} SELECT event_id, phrase, entity_id, mass_number, isotope, isotope_assumed, match_kind FROM (SELECT event_id, {PARTICLE} AS phrase FROM events) LEFT JOIN p USING (phrase)")
def resolve_particle(spark, sf_dir):
    phrases = table(spark, sf_dir, "events").selectExpr("event_id", f"{PARTICLE} AS phrase")
    found = X.seed_resolvers(spark)[0](phrases)
    return V.resolve_all(phrases, found).select("event_id", "phrase", "entity_id", "mass_number", "isotope", "isotope_assumed", "match_kind")


@query(f"WITH {PARTICLES} SELECT event_id, phrase, entity_id FROM (SELECT event_id, {PARTICLE} AS phrase FROM events) JOIN p USING (phrase) WHERE phrase IN ('P', 'P ions')")
def symbol_guard(spark, sf_dir):
    phrases = table(spark, sf_dir, "events").selectExpr("event_id", f"{PARTICLE} AS phrase")
    return V.resolve_symbol_guard(V.with_keys(phrases), seed.elements(spark)).select("event_id", "phrase", "entity_id")


@query(f"WITH {PARTICLES} SELECT event_id, phrase, entity_id, mass_number FROM (SELECT event_id, {PARTICLE} AS phrase FROM events) JOIN p USING (phrase) WHERE match_kind = 'isotope'")
def isotope_parse(spark, sf_dir):
    phrases = table(spark, sf_dir, "events").selectExpr("event_id", f"{PARTICLE} AS phrase")
    return V.resolve_isotope(V.with_keys(phrases), seed.elements(spark), seed.element_variants(spark)).select("event_id", "phrase", "entity_id", "mass_number")


@query("SELECT event_id, user_id % 4 AS entity_id, CASE user_id % 4 WHEN 1 THEN 'Hydrogen' WHEN 2 THEN 'Helium' WHEN 3 THEN 'Lithium' END AS name FROM events")
def entity_by_id(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("entity_id"))
    return V.lookup_entity(e, D.build_catalogue(seed.elements(spark), seed.compounds(spark))).select("event_id", "entity_id", "name")


# --- extraction
@query(f"""WITH {REQUESTS} SELECT id, CASE event_type WHEN 'click' THEN 'stoppingPower' WHEN 'error' THEN 'energyFromRange' ELSE 'csdaRange' END AS quantity,
CASE event_type WHEN 'view' THEN 'indirect' WHEN 'error' THEN 'inverse' ELSE 'direct' END AS source, CASE event_type WHEN 'view' THEN 'how far' END AS idiom FROM q""")
def classify(spark, sf_dir):
    return X.classify(requests(spark, sf_dir)).select("id", "quantity", "source", "idiom")


@query(f"WITH {REQUESTS} SELECT id, 0 AS pos, CAST(n AS DOUBLE) AS value, CASE event_type WHEN 'view' THEN 'MeV/nucl' ELSE 'MeV' END AS unit, event_type = 'view' AS per_nucleon FROM q WHERE event_type <> 'error'")
def measurements(spark, sf_dir):
    m = requests(spark, sf_dir).select("id", F.posexplode(X.extract_measurements(F.col("text"))).alias("pos", "e"))
    return m.select("id", "pos", "e.value", "e.unit", "e.per_nucleon")


SUFFIXED = "concat(user_id, ', and ', user_id + 1, CASE event_type WHEN 'click' THEN ' keV/u' WHEN 'view' THEN ' GeV per nucleon' WHEN 'error' THEN ' keV' ELSE ' MeV/nucl' END)"


@query("""SELECT event_id, k AS pos, CASE event_type WHEN 'click' THEN round((user_id + k) / 1000.0, 6) WHEN 'view' THEN (user_id + k) * 1000.0 ELSE CAST(user_id + k AS DOUBLE) END AS value,
CASE event_type WHEN 'click' THEN 'MeV/u' WHEN 'error' THEN 'keV' ELSE 'MeV/nucl' END AS unit FROM events, (VALUES (0), (1)) v(k)""")
def suffixed_units(spark, sf_dir):
    m = texts(spark, sf_dir, "events", "event_id").selectExpr("event_id", f"{SUFFIXED} AS text").select("event_id", F.posexplode(X.extract_measurements(F.col("text"))).alias("pos", "e"))
    return m.select("event_id", "pos", "e.value", "e.unit")


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id AS DOUBLE) END AS range_value, CASE event_type WHEN 'click' THEN 'g/cm2' WHEN 'view' THEN 'um' END AS range_unit,
CASE WHEN event_type NOT IN ('click', 'view') THEN CAST(user_id AS DOUBLE) END AS stp_value, CASE event_type WHEN 'purchase' THEN 'MeV cm2/g' WHEN 'signup' THEN 'MeV/cm' WHEN 'error' THEN 'keV/um' END AS stp_unit FROM events""")
def targets(spark, sf_dir):
    unit = "CASE event_type WHEN 'click' THEN ' g / cm^2' WHEN 'view' THEN ' microns' WHEN 'purchase' THEN ' MeV cm2/g' WHEN 'signup' THEN ' MeV per cm' ELSE ' keV/um' END"
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", f"concat('a target of ', user_id, {unit}, ' here') AS text")
    length = F.col("event_type").isin("click", "view")
    e = e.withColumn("r", F.when(length, X.extract_range_target(F.col("text")))).withColumn("s", F.when(~length, X.extract_stp_target(F.col("text"))))
    return e.select("event_id", F.col("r.value").alias("range_value"), F.col("r.unit").alias("range_unit"), F.col("s.value").alias("stp_value"), F.col("s.unit").alias("stp_unit"))


PARTICLE_GOLD = """g AS (SELECT id, 0 AS pos, CASE event_type WHEN 'click' THEN 'protons' WHEN 'error' THEN 'proton' WHEN 'signup' THEN 'protons' ELSE 'carbon ions' END AS match FROM q
UNION ALL SELECT id, 1, 'helium' FROM q WHERE event_type = 'signup' UNION ALL SELECT id, 2, 'carbon' FROM q WHERE event_type = 'signup')"""


@query(f"WITH {REQUESTS}, {PARTICLE_GOLD} SELECT id, pos, match, CASE left(match, 1) WHEN 'p' THEN 1 WHEN 'h' THEN 2 ELSE 6 END AS entity_id, CASE left(match, 1) WHEN 'p' THEN 1 WHEN 'h' THEN 4 ELSE 12 END AS mass_number, left(match, 1) <> 'p' AS isotope_assumed FROM g")
def particle_mentions(spark, sf_dir):
    m = X.particle_mentions(requests(spark, sf_dir).select("id", "text"), X.seed_resolvers(spark)[0]).select("id", F.posexplode("particles").alias("pos", "p"))
    return m.select("id", "pos", "p.match", "p.entity_id", "p.mass_number", "p.isotope_assumed")


@query(f"WITH {REQUESTS} SELECT id, CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS pos, material AS match, material_id AS entity_id, 'exact' AS match_kind FROM q UNION ALL SELECT id, 0, 'helium', 2, 'exact' FROM q WHERE event_type = 'signup'")
def material_mentions(spark, sf_dir):
    words = F.concat(T.bounds(T.match_spans(F.col("text"), X.NAMED_PARTICLE)), T.bounds(T.match_spans(F.col("text"), X.PARTICLE_HEAD)), T.bounds(T.match_spans(F.col("text"), X.ENERGY)), T.bounds(T.match_spans(F.col("text"), X.LENGTH_TARGET)))
    resolver = X.seed_resolvers(spark)[1]
    m = X.each_text(requests(spark, sf_dir), lambda t: X.material_mentions(t.select("id", "text", words.alias("claimed")), resolver)).select("id", F.posexplode("materials").alias("pos", "m"))
    return m.select("id", "pos", "m.match", "m.entity_id", "m.match_kind")


@query(f"WITH {spans_sql('documents', 'doc_id', '[0-9]+')} SELECT doc_id, k, start FROM spans s WHERE k % 2 = 1 AND NOT EXISTS (SELECT 1 FROM spans c WHERE c.doc_id = s.doc_id AND c.k % 2 = 0 AND c.start < s.start + length(s.text) + 40 AND s.start < c.start + length(c.text) + 40 AND c.k <> s.k)")
def drop_overlaps(spark, sf_dir):
    d = texts(spark, sf_dir, "documents", "doc_id").select("doc_id", T.match_spans(F.col("text"), "[0-9]+").alias("m"))
    wide = F.transform("m", lambda x, k: F.struct(k.alias("k"), x["start"].alias("start"), (x["end"] + 40).alias("end")))
    d = d.withColumn("w", wide).withColumn("s", X.drop_overlaps(F.filter("w", lambda s: s["k"] % 2 == 1), F.filter("w", lambda c: c["k"] % 2 == 0)))
    return d.select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.k").cast("long").alias("k"), F.col("s.start").cast("long").alias("start"))


WORDS_AND_NUMBERS = r"""w AS (SELECT doc_id, unnest(range(len(m))) AS k, unnest(m) AS text, unnest(list_transform(g[:len(m)], lambda x: length(x))) AS gap FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS m, regexp_split_to_array(text, '[A-Z][a-z]+') AS g FROM documents)),
words AS (SELECT doc_id, k, CAST(sum(gap + length(text)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop, length(text) AS n FROM w),
c AS (SELECT doc_id, unnest(range(len(m))) AS k, unnest(m) AS text, unnest(list_transform(g[:len(m)], lambda x: length(x))) AS gap FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m, regexp_split_to_array(text, '[0-9]+') AS g FROM documents)),
claims AS (SELECT doc_id, CAST(sum(gap + length(text)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop, length(text) AS n FROM c)"""


@query(f"WITH {WORDS_AND_NUMBERS} SELECT doc_id, stop - n AS start, stop FROM words w WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.doc_id = w.doc_id AND c.stop - c.n - 300 < w.stop AND w.stop - w.n < c.stop + 300)")
def drop_overlapping_rows(spark, sf_dir):
    """Capitalised words that are not within 300 characters of a number."""
    d = texts(spark, sf_dir, "documents", "doc_id")
    of = lambda pattern, wide: d.select("doc_id", F.explode(T.match_spans(F.col("text"), pattern)).alias("m")).select("doc_id", (F.col("m.start") - wide).cast("long").alias("start"), (F.col("m.end") + wide).cast("long").alias("end"))
    return X.drop_overlapping_rows(of("[A-Z][a-z]+", 0), of("[0-9]+", 300), ["doc_id"]).select("doc_id", "start", F.col("end").alias("stop"))


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'pstar|mstar' WHEN 1 THEN 'geant4' ELSE '' END AS programs, CASE WHEN user_id % 3 = 0 THEN 'program' ELSE 'energy' END AS compare_dim FROM events")
def programs(spark, sf_dir):
    e = texts(spark, sf_dir, "events", "event_id").selectExpr("event_id", "concat('10 and 20 MeV protons ', CASE user_id % 3 WHEN 0 THEN 'with PSTAR, MSTAR and pstar' WHEN 1 THEN 'in Geant4' ELSE 'with icru49' END) AS text").withColumnRenamed("event_id", "id")
    e = X.each_text(e, lambda t: t.select("id", X.program_mentions(F.col("text")).alias("p"), X.extract_measurements(F.col("text")).alias("e"))).withColumnRenamed("id", "event_id")
    none = F.array().cast("array<string>")
    return e.select("event_id", F.array_join("p", "|").alias("programs"), X.decide_compare_dim(F.col("p"), F.col("e"), none, none).alias("compare_dim"))


INTENT_GOLD = f"""SELECT id, CASE event_type WHEN 'click' THEN 'stoppingPower' WHEN 'error' THEN 'energyFromRange' ELSE 'csdaRange' END AS quantity, CASE event_type WHEN 'signup' THEN 'particle' ELSE 'none' END AS compare_dim,
CASE event_type WHEN 'signup' THEN 'protons|helium|carbon' WHEN 'click' THEN 'protons' WHEN 'error' THEN 'proton' ELSE 'carbon ions' END AS particles, material AS materials,
CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN concat(n, ' MeV/nucl true') WHEN 'click' THEN concat(n, ' MeV') ELSE concat(n, ' MeV false') END AS energies,
CASE event_type WHEN 'error' THEN concat(n, ' mm') END AS target,
CASE event_type WHEN 'view' THEN 'carbon → ¹²C' WHEN 'purchase' THEN concat('carbon → ¹²C|', n, ' MeV taken as total → ', {SHORTEST.format('n / 12.0')}, ' MeV/nucl')
 WHEN 'signup' THEN concat('helium → ⁴He|carbon → ¹²C|', n, ' MeV taken as total → ', {SHORTEST.format('n / 4.0')}, ' MeV/nucl') ELSE '' END AS assumptions,
CASE event_type WHEN 'view' THEN 0.82 WHEN 'error' THEN 0.9 ELSE 0.97 END AS confidence, false AS incomplete FROM q"""


@query(f"WITH {REQUESTS} {INTENT_GOLD.replace('0.82', '0.82::DOUBLE')}")
def intents(spark, sf_dir):
    i = X.extract_intents(requests(spark, sf_dir).select("id", "text"), *X.seed_resolvers(spark))
    energy = F.transform("intent.energies", lambda e: F.concat_ws(" ", T.number_text(e["value"]), e["unit"], e["per_nucleon"].cast("string")))
    target = F.when(F.col("intent.target").isNotNull(), F.concat_ws(" ", T.number_text(F.col("intent.target.value")), F.col("intent.target.unit")))
    return i.select("id", "intent.quantity", "intent.compare_dim", F.array_join("intent.particles.match", "|").alias("particles"), F.array_join("intent.materials.match", "|").alias("materials"), F.array_join(energy, "|").alias("energies"), target.alias("target"), F.array_join("intent.assumptions", "|").alias("assumptions"), "intent.confidence", "incomplete")


# --- validation: JSON lines from events, one defect in ten
GOOD = """{"id": "ID", "text": "TEXT", "tags": ["TAG"], "expected": {"quantity": "QUANTITY", "compareDim": "none", "particles": [{"match": "p"}], "materials": [{"match": "water"}], "energies": [{"value": 1.5, "unit": "UNIT"}], "assumptions": [], "confidence": CONF}}"""
VOCABULARY = ["direct", "indirect", "inverse", "unused"]


def labelled_lines(spark, sf_dir) -> DataFrame:
    e = texts(spark, sf_dir, "events", "event_id").withColumn("d", F.col("event_id") % 10)
    line = F.lit(GOOD)
    parts = {
        "ID": F.concat(F.lit("r"), F.floor(F.col("event_id") / 4).cast("string")),
        "TEXT": F.when(F.col("d") == 9, " ").otherwise("range"),
        "TAG": F.when(F.col("user_id") % 3 == 0, "direct").when(F.col("user_id") % 3 == 1, "indirect").otherwise("odd"),
        "QUANTITY": F.when(F.col("d") == 1, "bogus").when(F.col("d") == 8, "energyFromStp").otherwise("csdaRange"),
        "UNIT": F.when(F.col("d") == 3, "kg").otherwise("MeV"),
        "CONF": F.when(F.col("d") == 2, "2").when(F.col("d") == 4, '"0.5"').otherwise("0.5"),
    }
    for name, value in parts.items():
        line = F.replace(line, F.lit(name), value)
    line = F.when(F.col("d") == 5, F.left(line, F.lit(60))).when(F.col("d") == 6, "# note").when(F.col("d") == 7, "  ").otherwise(line)
    return e.select((F.col("event_id") + 1).alias("line_no"), line.alias("value"))


def vocabulary(spark) -> DataFrame:
    return spark.createDataFrame([(t,) for t in VOCABULARY], "tag string")


LINES = """l AS (SELECT event_id + 1 AS line_no, event_id % 10 AS d, CASE user_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' ELSE 'odd' END AS tag, concat('r', event_id // 4) AS id FROM events),
good AS (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS record_idx FROM l WHERE d NOT IN (5, 6, 7)),
bad AS (SELECT record_idx, line_no, CASE d WHEN 1 THEN 'expected.quantity' WHEN 2 THEN 'expected.confidence' WHEN 3 THEN 'expected.energies[0].unit' WHEN 4 THEN 'expected.confidence' WHEN 8 THEN 'expected.target' ELSE 'text' END AS path FROM good WHERE d IN (1, 2, 3, 4, 8, 9)),
dup AS (SELECT line_no, record_idx, id FROM good g WHERE line_no > (SELECT min(line_no) FROM good h WHERE h.id = g.id))"""


@query(f"WITH {LINES} SELECT record_idx, line_no, path FROM bad")
def violations(spark, sf_dir):
    return Q.line_violations(labelled_lines(spark, sf_dir)).select("record_idx", "line_no", "path")


@query(f"WITH {LINES} SELECT line_no FROM l WHERE d = 5")
def malformed(spark, sf_dir):
    return Q.malformed_lines(labelled_lines(spark, sf_dir)).select("line_no")


@query(f"WITH {LINES} SELECT line_no, record_idx, id FROM dup")
def duplicates(spark, sf_dir):
    return Q.duplicate_ids(Q.line_ids(labelled_lines(spark, sf_dir))).select("line_no", "record_idx", "id")


@query(f"WITH {LINES} SELECT record_idx, tag FROM good WHERE tag = 'odd'")
def unknown_tags(spark, sf_dir):
    return Q.unknown_tags(Q.record_tags(Q.data_lines(labelled_lines(spark, sf_dir))), vocabulary(spark))


@query(f"WITH {LINES} SELECT tag, count(*) AS n FROM good GROUP BY 1")
def tag_counts(spark, sf_dir):
    return Q.tag_counts(Q.record_tags(Q.data_lines(labelled_lines(spark, sf_dir))))


@query(f"WITH {LINES} SELECT t AS tag FROM (VALUES ('direct'), ('indirect'), ('inverse'), ('unused')) v(t) WHERE t NOT IN (SELECT tag FROM good)")
def missing_tags(spark, sf_dir):
    return Q.missing_categories(Q.record_tags(Q.data_lines(labelled_lines(spark, sf_dir))), vocabulary(spark))


@query(f"""WITH {LINES}, c AS (SELECT (SELECT count(*) FROM good) AS "count", (SELECT count(*) FROM bad) + (SELECT count(*) FROM dup) + (SELECT count(*) FROM l WHERE d = 5) + (SELECT count(*) FROM good WHERE tag = 'odd') AS errors)
SELECT "count", errors, errors = 0 AS ok, errors = 0 AND "count" >= 100 AS passed FROM c""")
def validation_report(spark, sf_dir):
    return Q.validation_report(labelled_lines(spark, sf_dir), vocabulary(spark))


# --- evaluation
SCORED = """s AS (SELECT d.doc_id, (length(text) > 1200) = (quality = 1) AS ok_quality, toxic = 0 AS ok_toxic, lang, source, least(1.0, n_chars / 4000.0) AS confidence FROM documents d JOIN labels USING (doc_id)),
e AS (SELECT *, ok_quality AS slot, ok_quality AND ok_toxic AS exact FROM s)"""


def scored(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("doc_id", ((F.length("text") > 1200) == (F.col("quality") == 1)).alias("ok_quality"), (F.col("toxic") == 0).alias("ok_toxic"), F.array("lang", "source").alias("tags"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("confidence"))
    return E.slot_exact_flags(d, ["quality"], ["toxic"])


@query(f"WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (slot) AS slot_matches, count(*) FILTER (exact) AS exact_matches, count(*) FILTER (slot) / count(*) AS slot_rate, count(*) FILTER (exact) / count(*) AS exact_rate FROM e")
def coverage(spark, sf_dir):
    return E.coverage_summary(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT 'quality' AS field, count(*) FILTER (NOT ok_quality) AS misses, count(*) FILTER (ok_quality) / count(*) AS accuracy FROM e UNION ALL SELECT 'toxic', count(*) FILTER (NOT ok_toxic), count(*) FILTER (ok_toxic) / count(*) FROM e")
def field_misses(spark, sf_dir):
    return E.field_misses(scored(spark, sf_dir), ["quality", "toxic"])


@query(f"WITH {SCORED} SELECT tag, count(*) AS total, count(*) FILTER (slot) AS slot, count(*) FILTER (exact) AS exact FROM (SELECT lang AS tag, slot, exact FROM e UNION ALL SELECT source, slot, exact FROM e) GROUP BY 1")
def tag_stats(spark, sf_dir):
    return E.tag_stats(scored(spark, sf_dir))


@query(f"WITH {SCORED}, b(label, lo, hi) AS (VALUES ('[0.90, 1.00]', 0.9::DOUBLE, 1.0001::DOUBLE), ('[0.80, 0.90)', 0.8, 0.9), ('[0.50, 0.80)', 0.5, 0.8), ('[0.00, 0.50)', 0.0, 0.5)) SELECT label, lo, hi, count(doc_id) AS total, count(*) FILTER (exact) AS exact FROM b LEFT JOIN e ON confidence >= lo AND confidence < hi GROUP BY ALL")
def calibration(spark, sf_dir):
    return E.calibration(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT doc_id, concat_ws('|', CASE WHEN NOT ok_quality THEN 'quality' END, CASE WHEN NOT ok_toxic THEN 'toxic' END) AS wrong FROM e WHERE NOT exact")
def misses(spark, sf_dir):
    return E.misses(scored(spark, sf_dir), ["quality", "toxic"]).select("doc_id", F.array_join("wrong", "|").alias("wrong"))


@query(f"WITH {SCORED} SELECT count(*) FILTER (slot) / count(*) AS slot_rate, 0.9::DOUBLE AS floor, count(*) FILTER (slot) / count(*) >= 0.9 AS passed FROM e")
def gate(spark, sf_dir):
    return E.coverage_gate(scored(spark, sf_dir), 0.9)


@query("SELECT event_id AS id, user_id % 5 <> 1 AS ok_particles, user_id % 5 <> 2 AS ok_materials, user_id % 5 <> 3 AS ok_energies, user_id % 5 <> 4 AS ok_assumptions, user_id % 5 IN (0, 4) AS slot, user_id % 5 = 0 AS exact FROM events")
def verdicts(spark, sf_dir):
    """Gold labels with one field changed in four of five rows, phrased differently where nothing is changed."""
    case = F.col("user_id") % 5

    def intent(particle, material, flag, note):
        energy = F.struct(F.col("value").alias("value"), F.lit("MeV").alias("unit"), flag.alias("per_nucleon"))
        return F.struct(F.lit("csdaRange").alias("quantity"), F.lit("none").alias("compare_dim"), F.array(F.struct(particle.alias("match"), F.lit(None).cast("string").alias("isotope_assumed"))).alias("particles"), F.array(F.struct(material.alias("match"))).alias("materials"), F.array(energy).alias("energies"), F.struct(F.lit(1.0).alias("value"), F.lit("g/cm2").alias("unit")).alias("target"), F.array(F.lit("b"), note).alias("assumptions"))

    none = F.lit(None).cast("boolean")
    gold = intent(F.lit("protons"), F.lit("water"), none, F.lit("a"))
    guess = intent(F.when(case == 1, "deuteron").otherwise("p"), F.when(case == 2, "air").otherwise("liquid water"), F.when(case == 3, False).otherwise(none), F.when(case == 4, "c").otherwise("a"))
    pairs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), guess.alias("predicted"), gold.alias("expected"))
    out = E.slot_exact_flags(E.field_verdicts(pairs, *X.seed_resolvers(spark)))
    return out.select("id", "ok_particles", "ok_materials", "ok_energies", "ok_assumptions", "slot", "exact")


# --- units and programs
@query("""WITH e AS (SELECT event_id, value, CASE event_type WHEN 'click' THEN 'MeV' WHEN 'view' THEN 'keV' WHEN 'purchase' THEN 'GeV' WHEN 'signup' THEN 'MeV/u' ELSE 'MeV/nucl' END AS unit, user_id % 2 = 0 AS p, user_id % 20 AS a FROM events),
f AS (SELECT *, CASE WHEN a > 0 THEN a ELSE 1 END AS d, CASE unit WHEN 'keV' THEN value / 1000 WHEN 'GeV' THEN value * 1000 ELSE value END AS mev FROM e)
SELECT event_id, round(CASE unit WHEN 'MeV/nucl' THEN value WHEN 'MeV/u' THEN value * CASE WHEN a > 0 THEN a + 0.01 ELSE d END / d ELSE CASE WHEN p THEN mev ELSE mev / d END END, 9) AS energy FROM f""")
def energy_units(spark, sf_dir):
    unit = "CASE event_type WHEN 'click' THEN 'MeV' WHEN 'view' THEN 'keV' WHEN 'purchase' THEN 'GeV' WHEN 'signup' THEN 'MeV/u' ELSE 'MeV/nucl' END"
    e = table(spark, sf_dir, "events").selectExpr("event_id", "value", f"{unit} AS unit", "user_id % 2 = 0 AS p", "user_id % 20 AS a")
    mass = F.when(F.col("a") > 0, F.col("a") + 0.01).otherwise(0.0)
    return e.select("event_id", F.round(C.energy_to_mev_per_nucl(F.col("value"), F.col("unit"), F.col("p"), F.col("a"), mass), 9).alias("energy"))


@query("""SELECT event_id, round(CASE WHEN event_type = 'click' THEN value WHEN user_id % 3 = 0 OR event_type = 'error' THEN NULL WHEN event_type = 'view' THEN value / 10 * (user_id % 3) WHEN event_type = 'purchase' THEN value * 100 * (user_id % 3) ELSE value / 10000 * (user_id % 3) END, 9) AS areal,
event_type <> 'click' AND (user_id % 3 = 0 OR event_type = 'error') AS failed FROM events""")
def range_units(spark, sf_dir):
    unit = "CASE event_type WHEN 'click' THEN 'g/cm2' WHEN 'view' THEN 'mm' WHEN 'purchase' THEN 'm' WHEN 'signup' THEN 'um' ELSE 'furlong' END"
    e = table(spark, sf_dir, "events").selectExpr("event_id", "value", f"{unit} AS unit", "nullif(CAST(user_id % 3 AS DOUBLE), 0) AS density")
    r = e.select("event_id", C.range_target_to_areal(F.col("value"), F.col("unit"), F.col("density")).alias("r"))
    return r.select("event_id", F.round("r.value", 9).alias("areal"), F.col("r.error").isNotNull().alias("failed"))


@query("""SELECT event_id, round(CASE WHEN event_type IN ('click', 'view') THEN value WHEN user_id % 3 = 0 THEN NULL WHEN event_type = 'purchase' THEN value / (user_id % 3) ELSE value * 10 / (user_id % 3) END, 9) AS mass_value,
event_type NOT IN ('click', 'view') AND user_id % 3 = 0 AS failed FROM events""")
def stp_units(spark, sf_dir):
    unit = "CASE event_type WHEN 'click' THEN 'MeV cm2/g' WHEN 'view' THEN 'parts' WHEN 'purchase' THEN 'MeV / cm' ELSE 'keV/um' END"
    e = table(spark, sf_dir, "events").selectExpr("event_id", "value", f"{unit} AS unit", "nullif(CAST(user_id % 3 AS DOUBLE), 0) AS density")
    r = e.select("event_id", C.stp_target_to_mass(F.col("value"), F.col("unit"), F.col("density")).alias("r"))
    return r.select("event_id", F.round("r.value", 9).alias("mass_value"), F.col("r.error").isNotNull().alias("failed"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 101 WHEN 'purchase' THEN 7 ELSE CASE user_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END END AS program_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'explicit' ELSE 'auto' END AS program_source FROM events""")
def choose_program(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_type WHEN 'click' THEN 'pstar' WHEN 'view' THEN 'Bethe-ext' WHEN 'purchase' THEN 'icru 49' WHEN 'signup' THEN 'srim' END AS program", "CAST(user_id % 4 AS INT) AS particle_id")
    return R.choose_program(e, seed.program_keys(spark), seed.programs_of(spark)).select("event_id", "program_id", "program_source")


# --- curves from part, probes from lineitem
CURVES = """c AS (SELECT CAST(substr(p_brand, 7) AS INT) AS m, CAST(p_size AS DOUBLE) AS e, avg(p_retailprice) AS s FROM part GROUP BY 1, 2),
k AS (SELECT m, e AS e0, lead(e) OVER w AS e1, s AS s0, lead(s) OVER w AS s1, lead(e, 2) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY m ORDER BY e)),
b AS (SELECT *, ln(s1 / s0) / ln(e1 / e0) AS b FROM k WHERE e1 IS NOT NULL), p AS (SELECT *, CASE WHEN abs(1 - b) < 1e-9 THEN e0 / s0 * ln(e1 / e0) ELSE e0 / s0 * (pow(e1 / e0, 1 - b) - 1) / (1 - b) END AS part FROM b),
cells AS (SELECT *, coalesce(sum(part) OVER (PARTITION BY m ORDER BY e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r0 FROM p),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(substr(p_brand, 7) AS INT) AS m, l_quantity + l_discount AS x FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def part_curves(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.expr("CAST(substr(p_brand, 7) AS INT)").alias("material_id"), F.col("p_size").cast("double").alias("energy")).agg(F.avg("p_retailprice").alias("stopping_power"))
    return p.select(F.lit(1).alias("program_id"), F.lit(1).alias("particle_id"), "material_id", "energy", "stopping_power", F.lit(None).cast("double").alias("range0"))


def probes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("CAST(substr(p_brand, 7) AS INT)").alias("material_id"))
    rows = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.lit(1).alias("program_id"), F.lit(1).alias("particle_id"), "material_id", (F.col("l_quantity") + F.col("l_discount")).alias("energy"))


@query("SELECT 1 AS program_id, 1 AS particle_id, CAST(min(p_size) AS DOUBLE) AS min_energy, CAST(max(p_size) AS DOUBLE) AS max_energy FROM part")
def bounds(spark, sf_dir):
    return C.energy_bounds(part_curves(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN max(bad) OVER (PARTITION BY l_orderkey) THEN 'failed' END AS state FROM (SELECT *, l_quantity + l_discount > (SELECT max(p_size) FROM part) OR l_quantity + l_discount < (SELECT min(p_size) FROM part) AS bad FROM lineitem JOIN part ON l_partkey = p_partkey)")
def leg_bounds(spark, sf_dir):
    out = C.check_bounds(probes(spark, sf_dir), C.energy_bounds(part_curves(spark, sf_dir)), ["l_orderkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("leg_error").isNotNull(), "failed").alias("state"))


@query(f"WITH {CURVES} SELECT l_orderkey, l_linenumber, l_partkey, round(x, 4) AS energy, round(s0 * pow(x / e0, b), 4) AS stopping_power FROM x LEFT JOIN cells c ON x.m = c.m AND x >= e0 AND (x < e1 OR last AND x = e1)")
def lookup(spark, sf_dir):
    out = C.lookup_stopping_power(probes(spark, sf_dir), C.curve_cells(part_curves(spark, sf_dir)), with_range=False)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("energy", 4).alias("energy"), F.round("stopping_power", 4).alias("stopping_power"))


@query(f"WITH {CURVES} SELECT m AS material_id, e1 AS energy, round(r0 + part, 9) AS csda_range FROM cells")
def cumulative(spark, sf_dir):
    return C.cumulative_range(C.curve_cells(part_curves(spark, sf_dir))).select("material_id", "energy", F.round("csda_range", 9).alias("csda_range"))


@query(f"WITH {CURVES} SELECT l_orderkey, l_linenumber, l_partkey, round(r0 + CASE WHEN abs(1 - b) < 1e-9 THEN e0 / s0 * ln(x / e0) ELSE e0 / s0 * (pow(x / e0, 1 - b) - 1) / (1 - b) END, 9) AS csda_range FROM x LEFT JOIN cells c ON x.m = c.m AND x >= e0 AND (x < e1 OR last AND x = e1)")
def lookup_range(spark, sf_dir):
    out = C.lookup_stopping_power(probes(spark, sf_dir), C.curve_cells(part_curves(spark, sf_dir)))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("csda_range", 9).alias("csda_range"))


@query(f"WITH {CURVES} SELECT l_orderkey, l_linenumber, l_partkey, round(r0 + CASE WHEN abs(1 - b) < 1e-9 THEN e0 / s0 * ln(x / e0) ELSE e0 / s0 * (pow(x / e0, 1 - b) - 1) / (1 - b) END, 9) AS csda_range FROM x LEFT JOIN cells c ON x.m = c.m AND x >= e0 AND (x < e1 OR last AND x = e1)")
def lookup_long(spark, sf_dir):
    """As lookup_range, with curves and probes merged in ranges of energy."""
    out = C.lookup_stopping_power(probes(spark, sf_dir), C.long_curve_cells(part_curves(spark, sf_dir)), long_curves=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("csda_range", 9).alias("csda_range"))


@query(f"WITH {CURVES}, v AS (SELECT *, g FROM x, (VALUES (1), (2), (3)) t(g)) SELECT l_orderkey, l_linenumber, l_partkey, g AS program_id, CASE WHEN g < 3 THEN round(g * s0 * pow(x / e0, b), 4) END AS stopping_power, g = 3 OR s0 IS NULL AS failed FROM v LEFT JOIN cells c ON v.m = c.m AND x >= e0 AND (x < e1 OR last AND x = e1)")
def multi(spark, sf_dir):
    one = part_curves(spark, sf_dir)
    both = one.unionByName(one.withColumn("program_id", F.lit(2)).withColumn("stopping_power", 2 * F.col("stopping_power")))
    out = C.calculate_multi(probes(spark, sf_dir), spark.createDataFrame([(1,), (2,), (3,)], "program_id int"), C.curve_cells(both))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "program_id", F.round("stopping_power", 4).alias("stopping_power"), F.col("error").isNotNull().alias("failed"))


@query(f"WITH {CURVES}, t AS (SELECT *, x * 0.0008 AS v FROM x) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN abs(1 - b) < 1e-9 THEN e0 * exp((v - r0) * s0 / e0) ELSE e0 * pow(1 + (v - r0) * s0 / e0 * (1 - b), 1 / (1 - b)) END, 6) AS energy FROM t LEFT JOIN cells c ON t.m = c.m AND v >= r0 AND (v < r0 + part OR last AND v = r0 + part)")
def inverse_range(spark, sf_dir):
    t = probes(spark, sf_dir).withColumn("value", F.col("energy") * 0.0008).drop("energy")
    return C.inverse_range(t, C.curve_cells(part_curves(spark, sf_dir))).select("l_orderkey", "l_linenumber", "l_partkey", F.round("energy", 6).alias("energy"))


@query(f"""WITH {CURVES}, pk AS (SELECT m, arg_max(e, s * 1000 - e / 1000) AS pe FROM c GROUP BY 1), t AS (SELECT DISTINCT l_partkey, m, 880 + x * 20 AS v, l_partkey % 2 AS side FROM x),
h AS (SELECT t.*, e0 * pow(v / s0, 1 / b) AS e FROM t JOIN pk USING (m) LEFT JOIN cells c ON t.m = c.m AND v >= least(s0, s1) AND v <= greatest(s0, s1) AND side = CASE WHEN e0 >= pe THEN 1 ELSE 0 END)
SELECT l_partkey, round(v, 6) AS value, side, round(CASE WHEN side = 1 THEN max(e) ELSE min(e) END, 6) AS energy FROM h GROUP BY l_partkey, v, side""")
def inverse_branch(spark, sf_dir):
    t = probes(spark, sf_dir).withColumn("value", 880 + F.col("energy") * 20).withColumn("side", F.col("l_partkey") % 2).drop("energy", "l_orderkey", "l_linenumber")
    # dealt by rows: few targets repeat, so a task's share decides its memory; equal ones become one row when they are solved
    t = t.repartition(max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // 500_000)), "l_partkey", "value")
    curves = part_curves(spark, sf_dir)
    out = C.inverse_stopping_power(t, curves, C.curve_cells(curves), ["l_partkey"])
    return out.select("l_partkey", F.round("value", 6).alias("value"), "side", F.round("energy", 6).alias("energy"))


@query(f"WITH {CURVES} SELECT m AS material_id, arg_max(e, s * 1000 - e / 1000) AS peak_energy, round(max(s), 6) AS peak_stopping_power FROM c GROUP BY 1")
def peak(spark, sf_dir):
    return C.bragg_peak(part_curves(spark, sf_dir)).select("material_id", "peak_energy", F.round("peak_stopping_power", 6).alias("peak_stopping_power"))


@query("SELECT CAST(substr(p_brand, 7) AS INT) AS material_id, 'one' AS program_name, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN CAST(CAST(substr(p_brand, 7) AS INT) AS DOUBLE) END AS density, (SELECT CAST(min(p_size) AS DOUBLE) FROM part) AS min_energy FROM part GROUP BY ALL")
def metadata(spark, sf_dir):
    curves = part_curves(spark, sf_dir)
    materials = curves.select("material_id").distinct().withColumn("density", F.when(F.col("material_id") % 2 == 0, F.col("material_id").cast("double")).otherwise(-1.0))
    programs_ = spark.createDataFrame([(1, "one")], "program_id int, program_name string")
    particles = spark.createDataFrame([(1, 1.008)], "particle_id int, atomic_mass double")
    return C.entity_metadata(programs_, particles, materials, curves).select("material_id", "program_name", "density", "min_energy")


# --- requests end to end: curves S = a E^-0.8, so ranges are E^1.8 / (1.8 a)
GRID = "SELECT DISTINCT CAST(p_size AS DOUBLE) * 12 AS e FROM part"


def power_curves(spark, sf_dir) -> DataFrame:
    grid = table(spark, sf_dir, "part").select((F.col("p_size").cast("double") * 12).alias("energy")).distinct()
    ids = [(g, p, m) for g in (1, 2, 4, 7) for p in (1, 2, 6) for m in (276, 223, 104, 906)]
    keys = spark.createDataFrame(ids, "program_id int, particle_id int, material_id int")
    a = (F.col("program_id") * 10 + F.col("particle_id") + F.col("material_id") / 100) * 1.0000371  # no value ends in a tie of rounding
    rows = grid.crossJoin(F.broadcast(keys))  # 50 energies, 48 curves
    return rows.select("program_id", "particle_id", "material_id", "energy", (a * F.pow("energy", F.lit(-0.8))).alias("stopping_power"), (F.pow("energy", F.lit(1.8)) / (1.8 * a)).alias("range0"))


def computed(spark, texts_: DataFrame, sf_dir) -> DataFrame:
    """The long result of distinct texts (id, text)."""
    resolvers = X.seed_resolvers(spark)
    i = X.extract_distinct_intents(texts_, *resolvers).select(F.col("id").alias("request_id"), "intent", "entities")
    particles = seed.elements(spark).select(F.col("z").alias("id"), F.col("default_mass_number").cast("double").alias("atomic_mass"))
    materials = spark.createDataFrame([(276, 1.0), (223, 1.2), (906, 1.7)], "id int, density double")
    return R.compute_requests(i, *resolvers, power_curves(spark, sf_dir), particles, materials, seed.program_keys(spark), seed.program_names(spark), seed.programs_of(spark))


def computed_rows(spark, sf_dir, q: DataFrame) -> DataFrame:
    """The long result of all requests (id, text): a result follows from the text, so each text is computed once."""

    def results(t: DataFrame) -> DataFrame:
        c = computed(spark, t, sf_dir)
        return c.groupBy(F.col("request_id").alias("id")).agg(F.collect_list(F.struct(*[k for k in c.columns if k != "request_id"])).alias("r"))

    return X.each_text(q, results).select(F.col("id").alias("request_id"), F.explode("r").alias("r")).select("request_id", "r.*")


COMPUTED = f"""{REQUESTS}, g AS (SELECT min(e) AS lo, max(e) AS hi FROM ({GRID})),
legs AS (SELECT id, 0 AS leg, event_type, n, material, material_id, 1 AS particle_id, CAST(n AS DOUBLE) AS e, 'Water (liquid)' AS label FROM q WHERE event_type IN ('click', 'error')
UNION ALL SELECT id, 0, event_type, n, material, material_id, 6, CASE event_type WHEN 'view' THEN n ELSE n / 12.0 END, '' FROM q WHERE event_type IN ('view', 'purchase')
UNION ALL SELECT id, k, event_type, n, material, material_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 6 END, n / CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 4.0 ELSE 12.0 END, '' FROM q, (VALUES (0), (1), (2)) v(k) WHERE event_type = 'signup'),
pr AS (SELECT *, CASE particle_id WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END AS program_id, CASE material_id WHEN 276 THEN 1.0 WHEN 223 THEN 1.2 WHEN 906 THEN 1.7 END AS density FROM legs),
ab AS (SELECT *, (program_id * 10 + particle_id + material_id / 100.0) * 1.0000371::DOUBLE AS a FROM pr),
iv AS (SELECT *, CASE WHEN event_type = 'error' THEN pow(1.8 * a * n / 10.0 * density, 1 / 1.8) ELSE e END AS energy FROM ab),
out AS (SELECT id AS request_id, leg, event_type, particle_id, material_id, program_id, energy, a, n, density, coalesce(energy < lo * (1 - 1e-12) OR energy > hi * (1 + 1e-12), true) AS failed FROM iv, g)"""


@query(f"""WITH {COMPUTED} SELECT request_id, leg, particle_id, material_id, program_id, CASE WHEN NOT failed THEN round(energy, 5) END AS energy,
CASE WHEN NOT failed AND event_type <> 'error' THEN round(a * pow(energy, -0.8), 5) END AS stopping_power, CASE WHEN NOT failed AND event_type <> 'click' THEN CASE WHEN event_type = 'error' THEN round(n / 10.0 * density, 5) ELSE round(pow(energy, 1.8) / (1.8 * a), 5) END END AS csda_range, failed FROM out""")
def compute_requests(spark, sf_dir):
    c = computed_rows(spark, sf_dir, requests(spark, sf_dir))
    rounded = [F.round(k, 5).alias(k) for k in ("energy", "stopping_power", "csda_range")]
    return c.select("request_id", "leg", "particle_id", "material_id", "program_id", *rounded, F.col("error").isNotNull().alias("failed"))


@query(f"WITH {COMPUTED} SELECT request_id, count(*) AS legs, count(*) FILTER (failed) AS failed_legs, count(*) FILTER (NOT failed) AS points FROM out GROUP BY 1")
def nest_results(spark, sf_dir):
    nested = X.each_text(requests(spark, sf_dir), lambda t: R.nest_results(computed(spark, t, sf_dir)).withColumnRenamed("request_id", "id"))
    nested = nested.filter("series is not null or request_error is not null").withColumnRenamed("id", "request_id")
    return nested.select("request_id", F.size("series").cast("long").alias("legs"), F.size(F.filter("series", lambda s: s["error"].isNotNull())).cast("long").alias("failed_legs"), F.aggregate("series", F.lit(0).cast("long"), lambda a, s: a + F.size(s["points"])).alias("points"))


@query("""SELECT id AS request_id, k AS leg, CASE user_id % 3 WHEN 0 THEN CASE k WHEN 0 THEN 'ASTAR' WHEN 1 THEN 'ICRU49' ELSE 'Bethe' END WHEN 1 THEN CASE k WHEN 0 THEN 'Water (liquid)' ELSE 'Gold' END ELSE CASE k WHEN 0 THEN '⁴He' ELSE '¹H' END END AS label,
CASE user_id % 3 WHEN 0 THEN 2 ELSE 1 END AS dropped_entities FROM (SELECT event_id AS id, user_id FROM events), (VALUES (0), (1), (2)) v(k) WHERE user_id % 3 = 0 OR k < 2""")
def fan_out(spark, sf_dir):
    dim = F.when(F.col("user_id") % 3 == 0, "program").when(F.col("user_id") % 3 == 1, "material").otherwise("particle")
    p = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("entity_id"), F.lit(n).alias("name"), F.lit(a).alias("mass_number"), F.lit(i).alias("isotope")) for k, (e, n, a, i) in enumerate([(2, "Helium", 4, "⁴He"), (1, "Hydrogen", 1, "¹H")])])
    m = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("entity_id"), F.lit(n).alias("name")) for k, (e, n) in enumerate([(276, "Water (liquid)"), (79, "Gold")])])
    i = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.struct(dim.alias("compare_dim"), F.lit(None).cast("string").alias("program")).alias("intent"), p.alias("particles"), m.alias("materials"))
    return R.fan_out(i, seed.program_keys(spark), seed.program_names(spark), seed.programs_of(spark)).select("request_id", "leg", "label", "dropped_entities")


@query("""SELECT event_id AS request_id, CASE user_id % 4 WHEN 0 THEN 'request has no particle' WHEN 1 THEN 'electrons are not supported' WHEN 2 THEN 'material not resolved' END AS request_error FROM events""")
def structural_errors(spark, sf_dir):
    case = F.col("user_id") % 4
    mention = lambda x: F.array(F.struct(F.lit(x).alias("match")))
    particles = F.when(case == 0, F.array().cast("array<struct<match:string>>")).otherwise(mention("p"))
    intent = F.struct(F.lit("csdaRange").alias("quantity"), F.lit("none").alias("compare_dim"), particles.alias("particles"), mention("w").alias("materials"), F.array(F.lit(1.0)).alias("energies"))
    one = lambda e: F.array(F.struct(F.lit(0).alias("k"), e.cast("int").alias("entity_id")))
    i = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), intent.alias("intent"), one(F.when(case == 1, seed.ELECTRON).otherwise(1)).alias("particles"), one(F.when(case == 2, F.lit(None)).otherwise(276)).alias("materials"))
    return R.structural_errors(i).select("request_id", "request_error")


# --- sources and sinks: what is written is read again
def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


def written_lines(spark, sf_dir) -> str:
    path = _place(spark, "lines")
    labelled_lines(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return path


@query(f"WITH {LINES} SELECT CASE WHEN d <> 5 THEN id END AS id, CASE WHEN d <> 5 THEN CASE d WHEN 9 THEN ' ' ELSE 'range' END END AS text, CASE WHEN d <> 5 THEN tag END AS tag, d = 5 AS malformed FROM l WHERE d NOT IN (6, 7)")
def labelled_jsonl(spark, sf_dir):
    r = S.read_labelled_jsonl(spark, written_lines(spark, sf_dir), "id string, text string, tags array<string>")
    return r.select("id", "text", F.get("tags", F.lit(0)).alias("tag"), F.col("_corrupt").isNotNull().alias("malformed"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS line_no, event_id % 10 = 6 AS note FROM events")
def numbered_lines(spark, sf_dir):
    return S.read_numbered_lines(spark, written_lines(spark, sf_dir)).select("line_no", (F.col("value") == "# note").alias("note"))


@query("SELECT DISTINCT p_brand AS entity_id, p_brand AS name, p_name AS alias FROM part")
def dictionary_json(spark, sf_dir):
    p, path = table(spark, sf_dir, "part"), _place(spark, "entities")
    S.write_dictionary(p.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct(), p.select(F.col("p_name").alias("alias_key"), F.col("p_brand").alias("entity_id")).distinct(), path)
    return S.read_dictionary_json(spark, path, multi_line=False).select("entity_id", "name", "alias")


@query("SELECT DISTINCT 1 AS program_id, 'one' AS program, CAST(substr(p_brand, 7) AS INT) AS id, concat('Water ', substr(p_brand, 7)) AS name FROM part")
def curve_listing(spark, sf_dir):
    path = _place(spark, "curves")
    part_curves(spark, sf_dir).drop("range0").write.parquet(path)
    curves = S.read_curves(spark, path)
    own = curves.select(F.col("material_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("WATER_"), F.col("id").cast("string")))
    names = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    listed = S.programs(names, spark.createDataFrame([(2,)], "id int")).select(F.col("id").alias("program_id"), F.col("name").alias("program"))
    return S.supported(curves, own, "material_id").join(listed, "program_id").select("program_id", "program", "id", "name")


@query("SELECT event_id, event_type, value FROM events")
def results_written(spark, sf_dir):
    path = _place(spark, "results")
    S.write_results(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, ["event_type"])
    return spark.read.schema("event_id long, event_type string, value double").parquet(path).select("event_id", "event_type", "value")


# --- the other kinds of requests
KINDS = f"""CASE event_type
 WHEN 'click' THEN concat('what proton energy gives a stopping power of ', {N}, ' MeV/cm in ', {MATERIAL}, '?')
 WHEN 'view' THEN concat('range of 5 MeV and ', {N}, ' MeV protons in ', {MATERIAL})
 WHEN 'purchase' THEN concat('range of ', {N}, ' MeV protons in water and gold')
 WHEN 'signup' THEN concat('range of ', {N}, ' MeV protons in ', {MATERIAL}, ' with PSTAR and MSTAR')
 ELSE concat('at what rate are ', {N}, ' MeV protons slowed down in ', {MATERIAL}) END"""


@query(f"""SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'energyFromStp' WHEN 'error' THEN 'stoppingPower' ELSE 'csdaRange' END AS quantity,
CASE event_type WHEN 'view' THEN 'energy' WHEN 'purchase' THEN 'material' WHEN 'signup' THEN 'program' ELSE 'none' END AS compare_dim, CASE event_type WHEN 'click' THEN 'inverse' WHEN 'error' THEN 'indirect' ELSE 'direct' END AS source,
CASE event_type WHEN 'error' THEN 'slowed down' END AS idiom, CASE event_type WHEN 'click' THEN concat({N}, ' MeV/cm') END AS target, CASE event_type WHEN 'purchase' THEN 'water|gold' ELSE {MATERIAL} END AS materials,
CASE event_type WHEN 'signup' THEN 'pstar|mstar' ELSE '' END AS programs FROM events""")
def intent_kinds(spark, sf_dir):
    q = texts(spark, sf_dir, "events", "event_id").selectExpr("event_id AS id", f"{KINDS} AS text")
    i = X.extract_intents(q, *X.seed_resolvers(spark))
    target = F.when(F.col("intent.target").isNotNull(), F.concat_ws(" ", T.number_text(F.col("intent.target.value")), F.col("intent.target.unit")))
    return i.select("id", "intent.quantity", "intent.compare_dim", "source", "idiom", target.alias("target"), F.array_join("intent.materials.match", "|").alias("materials"), F.array_join("programs", "|").alias("programs"))


ASKED = f"""CASE event_type
 WHEN 'click' THEN concat('what proton energy gives a stopping power of ', {N}, ' MeV/cm in ', {MATERIAL}, '?')
 WHEN 'view' THEN concat('range of 24 MeV and ', {N}, ' MeV protons in ', {MATERIAL})
 WHEN 'purchase' THEN concat('range of ', {N}, ' MeV protons in water and PMMA')
 WHEN 'signup' THEN concat('range of ', {N}, ' MeV protons in ', {MATERIAL}, ' with PSTAR and MSTAR')
 ELSE concat('at what rate are ', {N}, ' MeV protons slowed down in ', {MATERIAL}) END"""


@query(f"""WITH {REQUESTS}, g AS (SELECT min(e) AS lo, max(e) AS hi FROM ({GRID})),
legs AS (SELECT id, event_type, n, material_id, 0 AS leg, 2 AS program_id, CAST(n AS DOUBLE) AS e, n BETWEEN lo AND hi AS good FROM q, g WHERE event_type = 'error'
UNION ALL SELECT id, event_type, n, material_id, 0, 2, 24.0, n BETWEEN lo AND hi FROM q, g WHERE event_type = 'view' UNION ALL SELECT id, event_type, n, material_id, 0, 2, n, true FROM q, g WHERE event_type = 'view' AND n BETWEEN lo AND hi
UNION ALL SELECT id, event_type, n, CASE k WHEN 0 THEN 276 ELSE 223 END, k, 2, n, n BETWEEN lo AND hi FROM q, g, (VALUES (0), (1)) v(k) WHERE event_type = 'purchase'
UNION ALL SELECT id, event_type, n, material_id, k, CASE k WHEN 0 THEN 2 WHEN 1 THEN 7 ELSE 100 END, n, k < 2 AND n BETWEEN lo AND hi FROM q, g, (VALUES (0), (1), (2)) v(k) WHERE event_type = 'signup'
UNION ALL SELECT id, event_type, n, material_id, 0, 2, NULL, NULL FROM q WHERE event_type = 'click'),
ab AS (SELECT *, (program_id * 10 + 1 + material_id / 100.0) * 1.0000371::DOUBLE AS a, n / CASE material_id WHEN 276 THEN 1.0 WHEN 223 THEN 1.2 WHEN 906 THEN 1.7 END AS v FROM legs),
iv AS (SELECT *, CASE WHEN event_type = 'click' THEN pow(v / a, -1 / 0.8) ELSE e END AS energy FROM ab),
ok AS (SELECT *, CASE WHEN event_type = 'click' THEN coalesce(energy BETWEEN lo * (1 - 1e-12) AND hi * (1 + 1e-12), false) ELSE good END AS fine FROM iv, g)
SELECT id AS request_id, leg, program_id, material_id, CASE WHEN fine THEN round(energy, 5) END AS energy, CASE WHEN fine THEN round(CASE WHEN event_type = 'click' THEN v ELSE a * pow(energy, -0.8) END, 5) END AS stopping_power,
CASE WHEN fine AND event_type NOT IN ('click', 'error') THEN round(pow(energy, 1.8) / (1.8 * a), 5) END AS csda_range, NOT fine AS failed FROM ok""")
def compute_kinds(spark, sf_dir):
    """Inverse stopping power, and comparisons of energies, materials and programs, from text to numbers."""
    c = computed_rows(spark, sf_dir, texts(spark, sf_dir, "events", "event_id").selectExpr("event_id AS id", f"{ASKED} AS text"))
    rounded = [F.round(k, 5).alias(k) for k in ("energy", "stopping_power", "csda_range")]
    return c.select("request_id", "leg", "program_id", "material_id", *rounded, F.col("error").isNotNull().alias("failed"))
