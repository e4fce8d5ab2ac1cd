"""Entity resolution as joins: exact, normalized, isotope and fuzzy tiers over distinct phrases; first hit wins."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .. import seed
from ..functions.tables import saved
from ..functions.text import core_token, isotope_label, normalize_text, strip_noise


def with_keys(phrases: DataFrame) -> DataFrame:
    """phrase with norm (its key) and stripped (the key without noise words)."""
    return phrases.withColumn("norm", normalize_text(F.col("phrase"))).withColumn("stripped", strip_noise(F.col("norm")))


def resolve_by_key(keyed: DataFrame, dictionary: DataFrame, key: str, kind: str) -> DataFrame:
    """The rows whose key column is an alias, with the dictionary's values and match_kind."""
    own = dictionary.withColumnRenamed("alias_key", key).drop("ord")
    return keyed.filter(F.col(key) != "").join(own, key).withColumn("match_kind", F.lit(kind))


def resolve_exact(keyed: DataFrame, dictionary: DataFrame) -> DataFrame:
    return resolve_by_key(keyed, dictionary, "norm", "exact")


def resolve_normalized(keyed: DataFrame, dictionary: DataFrame) -> DataFrame:
    return resolve_by_key(keyed.filter("stripped <> norm"), dictionary, "stripped", "normalized")


def _cut(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of the i-th of `parts` nearly equal segments of n characters, the longer ones last."""
    base, rest = F.floor(n / parts).cast("int"), n % parts
    return i * base + F.greatest(F.lit(0), i - (parts - rest)), base + F.when(i >= parts - rest, 1).otherwise(0)


SEGMENT = "struct<most:int,n:int,i:int,part:string>"


def alias_segments(alias: Column, most: int) -> Column:
    """The most + 1 segments of an alias, of which `most` edits leave one whole."""
    n = F.length(alias)

    def one(i: Column) -> Column:
        start, length = _cut(n, F.lit(most + 1), i)
        return F.struct(F.lit(most).alias("most"), n.alias("n"), i.alias("i"), F.substring(alias, start + 1, length).alias("part"))

    return F.transform(F.sequence(F.lit(0), F.lit(most)), one).cast(f"array<{SEGMENT}>")


def segment_places(most: int) -> list[tuple[int, int, int]]:
    """(d, i, shift): where in a phrase segment i of an alias that is d longer may stand within `most` edits: those places
    where the edits before the segment and those after it can add up (Pass-Join's multi-match-aware selection, Li et al.
    2011)."""
    places = []
    for d in range(-most, most + 1):
        for i in range(most + 1):
            places += [(d, i, shift) for shift in range(max(-i, -d - (most - i)), min(i, -d + (most - i)) + 1)]
    return places


def phrase_segments(phrase: Column, most: int) -> Column:
    """The parts of a phrase that may be a segment of an alias within `most` edits."""
    size, steps = F.length(phrase), segment_places(most)

    def one(x: Column) -> Column:
        of = size + x["d"]
        start, length = _cut(of, F.lit(most + 1), x["i"])
        start = start + x["shift"]
        part = F.when((start >= 0) & (start + length <= size), F.substring(phrase, start + 1, length))
        return F.struct(F.lit(most).alias("most"), of.alias("n"), x["i"].alias("i"), part.alias("part"))

    every = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for d, i, shift in steps])
    return F.array_distinct(F.filter(F.transform(every, one), lambda x: x["part"].isNotNull())).cast(f"array<{SEGMENT}>")


def deletions(c: Column, most: int) -> Column:
    """All strings that c becomes when up to `most` characters are left out. Strings within `most` edits share one."""

    def without(x: Column) -> Column:
        return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.concat(F.left(x, k - 1), F.substr(x, k + 1)))).otherwise(F.array().cast("array<string>"))

    found = F.array(c)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, without))))
    return found


def resolve_fuzzy(keyed: DataFrame, dictionary: DataFrame, hot_segment: int = 2000) -> DataFrame:
    """The rows whose stripped key is within 1 edit (2 from 7 characters on, none below 3) of an alias: the nearest, of
    equals the one of the lowest ord.

    One edit: the strings that alias and phrase become without one character are joined; few aliases have one in common
    (at most length times alphabet). Two edits: an alias in three segments leaves one of them whole, so aliases and
    phrases are joined by segment, length and place. Aliases of a family may share a segment: of those segments that more than
    `hot_segment` aliases have, aliases and phrases are joined by what they become without up to two characters instead,
    so no bucket grows with the family. keyed is written once, since every branch reads it and a plan would hold what its keys come from as often."""
    value_cols = [c for c in dictionary.columns if c not in ("alias_key", "ord")]
    size, n = F.length("stripped"), F.length("alias_key")
    asked = saved(keyed.filter((F.col("norm") != "") & (size >= 3)), "asked")
    probe = asked.select("stripped").distinct()
    short, long = probe.filter(size < 7), probe.filter(size >= 7)
    aliases = dictionary.select("alias_key").distinct()
    by_key = lambda df, c, most: df.select(c, F.explode(deletions(F.col(c), most)).alias("key"))
    pairs = [by_key(short, "stripped", 1).join(by_key(aliases.filter(n.between(2, 7)), "alias_key", 1), "key").select("stripped", "alias_key")]
    segments = aliases.filter(n >= 5).select("alias_key", F.explode(alias_segments(F.col("alias_key"), 2)).alias("seg"))
    probes = long.select("stripped", F.explode(phrase_segments(F.col("stripped"), 2)).alias("seg"))
    hot = segments.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_segment).select("seg")
    if aliases.count() > hot_segment and not (hot := saved(hot, "hot-segments")).isEmpty():
        often = by_key(long.join(probes.join(hot, "seg", "left_semi").select("stripped").distinct(), "stripped", "left_semi"), "stripped", 2)
        family = by_key(aliases.join(segments.join(hot, "seg", "left_semi").select("alias_key").distinct(), "alias_key", "left_semi"), "alias_key", 2)
        pairs.append(often.join(family, "key").select("stripped", "alias_key"))
        segments, probes = (x.join(hot, "seg", "left_anti") for x in (segments, probes))
    pairs.append(probes.join(segments, "seg").select("stripped", "alias_key"))
    near = pairs[0]
    for p in pairs[1:]:
        near = near.unionByName(p)
    near = near.distinct().withColumn("distance", F.when(size >= 7, F.levenshtein("stripped", "alias_key", 2)).otherwise(F.levenshtein("stripped", "alias_key", 1))).filter("distance >= 0")
    best = near.join(dictionary, "alias_key").groupBy("stripped").agg(F.min_by(F.struct(*value_cols), F.struct("distance", "ord")).alias("v"))
    return asked.join(best, "stripped").select(*keyed.columns, "v.*", F.lit("fuzzy").alias("match_kind"))


def resolve_symbol_guard(keyed: DataFrame, elements: DataFrame) -> DataFrame:
    """The rows whose core word has a capital and is an element's symbol, case and all: the element's default isotope."""
    core = core_token(F.col("phrase"))
    own = elements.select(F.col("symbol").alias("core"), F.col("z").alias("entity_id"), F.col("default_mass_number").alias("mass_number"))
    hit = keyed.withColumn("core", core).filter((F.col("norm") != "") & (F.col("core") != F.lower("core"))).join(own, "core").drop("core")
    return hit.withColumn("assumed", F.lit(True)).withColumn("match_kind", F.lit("exact"))


def element_keys(elements: DataFrame, variants: DataFrame) -> DataFrame:
    """name_key, z: normalized symbols, names and variants; the first element has a key that several want."""
    names = elements.select("z", F.explode(F.array("symbol", "name")).alias("name"), F.lit(0).alias("o")).unionByName(variants.select("z", F.col("variant").alias("name"), F.lit(1).alias("o")))
    return names.groupBy(normalize_text(F.col("name")).alias("name_key")).agg(F.min_by("z", F.struct("o", "z")).alias("z"))


def resolve_isotope(keyed: DataFrame, elements: DataFrame, variants: DataFrame) -> DataFrame:
    """The rows that say an element and a mass number of 1 to 3 digits in either order; stripped key first, then norm."""
    found = resolve_isotope_parts(keyed, elements, variants).filter("iso is not null")
    return found.select(*keyed.columns, "iso.*", F.lit("isotope").alias("match_kind"))


def lookup_entity(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """found with the catalogue's columns of its entity_id; unknown entities get nulls."""
    return found.join(catalogue.withColumnRenamed("id", "entity_id"), "entity_id", "left")


def cascade(keyed: DataFrame, lookups: list[tuple[str, Column, DataFrame]], dictionary: DataFrame) -> DataFrame:
    """The first hit of each phrase: lookups (kind, key, table with the key first) in order, then the column iso if
    there is one, then the fuzzy tier for the rest.

    The equality tiers are left joins of one pass, which Spark broadcasts where the tables are small."""
    values = [c for c in dictionary.columns if c not in ("alias_key", "ord")]
    iso = [F.when(F.col("iso").isNotNull(), F.struct(F.col("iso.entity_id").alias("entity_id"), F.col("iso.mass_number").alias("mass_number"), F.col("iso.assumed").alias("assumed"), F.lit("isotope").alias("match_kind")))] if "iso" in keyed.columns else []
    rows = keyed
    for i, (kind, key, table) in enumerate(lookups):
        own = table.select(F.col(table.columns[0]).alias(f"_k{i}"), F.struct(*values, F.lit(kind).alias("match_kind")).alias(f"_v{i}"))
        rows = rows.withColumn(f"_k{i}", key).join(own, f"_k{i}", "left")
    rows = saved(rows.select(*keyed.columns, F.coalesce(*[f"_v{i}" for i in range(len(lookups))], *iso).alias("v")), "resolved")
    near = resolve_fuzzy(rows.filter("v is null").drop("v"), dictionary)
    return rows.filter("v is not null").select("phrase", "v.*").unionByName(near.select("phrase", *values, "match_kind"))


def resolve_isotope_parts(keyed: DataFrame, elements: DataFrame, variants: DataFrame) -> DataFrame:
    """keyed with iso, struct<entity_id, mass_number, assumed>, of a phrase that says an isotope, else null."""
    keys = element_keys(elements, variants)
    rows = keyed
    for c in ("stripped", "norm"):
        head, tail = (F.regexp_extract(c, r"^([a-z]+)\s*([0-9]{1,3})$", g) for g in (1, 2))
        first, second = (F.regexp_extract(c, r"^([0-9]{1,3})\s*([a-z]+)$", g) for g in (1, 2))
        mass = F.when(head != "", tail).otherwise(first).try_cast("int")
        own = keys.select(F.col("name_key").alias("_name"), F.col("z").alias("_z"))
        rows = rows.withColumn("_name", F.nullif(F.when(head != "", head).otherwise(second), F.lit(""))).withColumn("_mass", mass).join(own, "_name", "left")
        value = F.when(F.col("_z").isNotNull(), F.struct(F.col("_z").alias("entity_id"), F.col("_mass").alias("mass_number"), F.lit(False).alias("assumed")))
        rows = rows.withColumn(f"_iso_{c}", value).drop("_name", "_mass", "_z")
    return rows.withColumn("iso", F.coalesce("_iso_stripped", "_iso_norm")).drop("_iso_stripped", "_iso_norm")


def _distinct(phrases: DataFrame, phrase_col: str) -> DataFrame:
    return saved(with_keys(phrases.select(F.col(phrase_col).alias("phrase")).filter("phrase is not null").distinct()), "keyed")


def resolve_material(phrases: DataFrame, dictionary: DataFrame, catalogue: DataFrame, phrase_col: str = "phrase") -> DataFrame:
    """Distinct phrases that resolve: phrase, entity_id, name, kind, match_kind."""
    exact = dictionary.drop("ord")
    lookups = [("exact", F.col("norm"), exact), ("normalized", F.when(F.col("stripped") != F.col("norm"), F.col("stripped")), exact)]
    found = cascade(_distinct(phrases, phrase_col), lookups, dictionary)
    return lookup_entity(found, catalogue).filter("name is not null").select("phrase", "entity_id", "name", "kind", "match_kind")


def resolve_particle(phrases: DataFrame, dictionary: DataFrame, catalogue: DataFrame, elements: DataFrame, variants: DataFrame, phrase_col: str = "phrase", electron_id: int = seed.ELECTRON) -> DataFrame:
    """Distinct phrases that resolve: phrase, entity_id, symbol, name, mass_number, isotope, isotope_assumed, match_kind."""
    core = core_token(F.col("phrase"))
    symbols = elements.select("symbol", F.col("z").alias("entity_id"), F.col("default_mass_number").alias("mass_number"), F.lit(True).alias("assumed"))
    exact = dictionary.drop("ord")
    rows = resolve_isotope_parts(_distinct(phrases, phrase_col), elements, variants)
    lookups = [("exact", F.when(core != F.lower(core), core), symbols), ("exact", F.col("norm"), exact), ("normalized", F.when(F.col("stripped") != F.col("norm"), F.col("stripped")), exact)]
    found = lookup_entity(cascade(rows, lookups, dictionary), catalogue).filter("name is not null")
    label = isotope_label(F.col("mass_number"), F.col("symbol"), F.col("entity_id") == electron_id)
    return found.select("phrase", "entity_id", "symbol", "name", "mass_number", label.alias("isotope"), F.col("assumed").alias("isotope_assumed"), "match_kind")


#: Resolved phrases of so many rows and bytes at most are broadcast.
LOOKUP_ROWS, LOOKUP_BYTES = 200_000, 16 << 20
#: Beyond that, phrases that have more than one in so many rows are told apart.
HEAVY_SHARE = 1000


def resolve_all(phrases: DataFrame, resolved: DataFrame, phrase_col: str = "phrase", lookup_rows: int = LOOKUP_ROWS, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """phrases with the columns of resolved (distinct phrases); rows that did not resolve keep nulls.

    A table of resolved phrases within LOOKUP_ROWS and LOOKUP_BYTES, all columns counted, is broadcast, so rows stay where they are. Otherwise phrases
    with more than one in `heavy_share` of the rows, which are fewer than that, meet their own broadcast lookup and only
    the rest is shuffled and merged: a phrase that most rows have makes no slow task, and a table that takes little room on disk
    alone is not gathered by the driver. Null phrases meet nothing."""
    resolved = resolved.withColumnRenamed("phrase", phrase_col)
    if not hasattr(resolved, "saved_at"):
        resolved = saved(resolved, "resolved-phrases")
    rows, size = resolved.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if rows <= lookup_rows and size <= LOOKUP_BYTES:
        return phrases.join(F.broadcast(resolved), phrase_col, "left")
    counts = saved(phrases.filter(F.col(phrase_col).isNotNull()).groupBy(phrase_col).agg(F.count(F.lit(1)).alias("_n")), "phrase-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = F.broadcast(saved(counts.filter(F.col("_n") * heavy_share > total).select(phrase_col), "heavy-phrases"))  # fewer than heavy_share rows
    found = F.broadcast(saved(resolved.join(heavy, phrase_col, "left_semi"), "heavy-resolved"))
    often = phrases.join(heavy, phrase_col, "left_semi").join(found, phrase_col, "left")
    rest = phrases.join(heavy, phrase_col, "left_anti")
    none = rest.filter(F.col(phrase_col).isNull()).select(*phrases.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in resolved.schema.fields if f.name != phrase_col])
    return often.unionByName(rest.filter(F.col(phrase_col).isNotNull()).join(resolved.hint("merge"), phrase_col, "left")).unionByName(none)


def dictionary_version(*tables: DataFrame) -> str:
    """A digest of the rows of the tables, whatever their order: number, sum and exclusive or of the rows' hashes."""
    parts = []
    for t in tables:
        columns = sorted(t.columns)
        own = t.select(F.xxhash64(F.lit(",".join(columns)), *columns).alias("h"))
        r = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
        parts.append(f"{r.n}:{r.s}:{r.x}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]


def resolve_with_ledger(phrases: DataFrame, resolver, ledger: str, version: str, phrase_col: str = "phrase") -> DataFrame:
    """Distinct phrases that resolve, as resolver gives them. The ledger, a table (folder) by dictionary version, has every phrase that
    was ever asked, found or not; only phrases that it lacks for this version are resolved, and join it. One run writes at
    a time; a run that fails leaves the ledger as it was."""
    spark = phrases.sparkSession
    asked = saved(phrases.select(F.col(phrase_col).alias("phrase")).filter("phrase is not null").distinct(), "asked")
    place = f"{ledger.rstrip('/')}/version={version}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    known = spark.read.parquet(place) if files.exists(folder) else None
    fresh = asked if known is None else saved(asked.join(known.select("phrase"), "phrase", "left_anti"), "fresh")
    if known is None or not fresh.isEmpty():
        found = resolver(fresh)
        columns = [c for c in found.columns if c != "phrase"]
        fresh.join(found, "phrase", "left").select("phrase", *columns).write.mode("append").parquet(place)
        known = spark.read.parquet(place)
    return known.join(asked, "phrase", "left_semi").filter("match_kind is not null")
