"""Validation of labelled data: violations, duplicates, malformed lines, vocabulary and counts.

Records are JSON texts in a table (line_no, record_idx, value); types are read from VARIANT, so the string "2" is not
a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tables import saved
from ..functions.text import bound

# fixed values
QUANTITIES = ["stoppingPower", "csdaRange", "energyFromRange", "energyFromStp"]
COMPARE_DIMS = ["none", "material", "particle", "program", "energy"]
ENERGY_UNITS = ["MeV", "keV", "GeV", "MeV/nucl", "MeV/u"]
DATA_LINE = r"^\s*(//|#|$)"


def data_lines(lines: DataFrame) -> DataFrame:
    """The rows of (line_no, value) that carry a record, with json (null if malformed) and record_idx among the good ones.

    Line numbers order the records; they come with the source. Good lines are counted in blocks of 65536 lines first, so
    the running number needs no single sorted task, and what is counted is a flag for each line, without its text."""
    rows = lines.filter(~F.rlike("value", F.lit(DATA_LINE))).withColumn("json", F.try_parse_json(F.trim("value")))
    return rows.join(record_numbers(lines), "line_no", "left")


def record_numbers(lines: DataFrame) -> DataFrame:
    """line_no, record_idx of the good lines."""
    return numbered(saved(_parsed(lines).select("line_no"), "good-lines"))


def numbered(good: DataFrame) -> DataFrame:
    """good (line_no, …; a saved table of the good lines) with record_idx."""
    good = good.withColumn("_block", F.floor(F.col("line_no") / 65536))
    counts = good.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).select("_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("line_no")) - 1
    return good.withColumn("_inside", inside).join(before, "_block").withColumn("record_idx", F.col("_inside") + F.col("_before")).drop("_block", "_inside", "_before")


def malformed_lines(lines: DataFrame) -> DataFrame:
    """line_no, value of the data lines that are not JSON."""
    rows = lines.filter(~F.rlike("value", F.lit(DATA_LINE)))
    return rows.filter(F.try_parse_json(F.trim("value")).isNull()).select("line_no", "value")


# the shape that a record is shredded into: leaves keep their own type, what has another shape becomes null
MENTION = "struct<match:variant,isotopeAssumed:variant>"
INTENT = f"struct<quantity:variant,compareDim:variant,particles:array<{MENTION}>,materials:array<struct<match:variant>>,energies:array<struct<value:variant,unit:variant,perNucleonAssumed:variant>>,target:variant,program:variant,assumptions:array<variant>,confidence:variant>"
EXAMPLE = f"struct<id:variant,text:variant,audio:variant,tags:array<variant>,expected:{INTENT}>"
TARGET = "struct<value:variant,unit:variant>"
ISSUES = "array<struct<path:string,message:string>>"


def _leaf(v: Column) -> Column:
    """struct<kind, text>: type and text of a leaf; kind is null where there is nothing."""
    return F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"))


def _is(leaf: Column, kind: str) -> Column:
    return F.coalesce(leaf["kind"] == kind, F.lit(False))


def _is_number(leaf: Column) -> Column:
    return F.coalesce(leaf["kind"].isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | leaf["kind"].startswith("DECIMAL"), F.lit(False))


def _given(leaf: Column) -> Column:
    return leaf["kind"].isNotNull()


def _filled(leaf: Column) -> Column:
    return _is(leaf, "STRING") & (F.length(leaf["text"]) > 0)


def _among(leaf: Column, allowed: list[str]) -> Column:
    return _is(leaf, "STRING") & F.coalesce(leaf["text"].isin(*allowed), F.lit(False))


def _issue(bad: Column, path: Column | str, message: str) -> Column:
    where = F.lit(path) if isinstance(path, str) else path
    return F.when(bad, F.struct(where.alias("path"), F.lit(message).alias("message")))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _members(items: Column, *names: str) -> Column:
    """The members of an array of structs as structs of leaves, with whether they are objects; null if there is no array."""
    return F.transform(items, lambda x: F.struct(x.isNotNull().alias("object"), *[_leaf(x[n]).alias(n) for n in names]))


def _intent_leaves(i: Column) -> Column:
    target = F.try_variant_get(i["target"], "$", TARGET)
    return F.struct(
        _members(i["particles"], "match", "isotopeAssumed").alias("particles"), _members(i["materials"], "match").alias("materials"), _members(i["energies"], "value", "unit", "perNucleonAssumed").alias("energies"),
        F.transform(i["assumptions"], F.schema_of_variant).alias("assumptions"), bound(target, lambda t: F.struct(_leaf(t["value"]).alias("value"), _leaf(t["unit"]).alias("unit"))).alias("goal"),
        *[_leaf(i[n]).alias(n) for n in ("quantity", "compareDim", "target", "program", "confidence")],
    )


def _items(members: Column, path: str, checks) -> Column:
    """Issues of the members of an array; an issue of the array itself if it is none."""
    each = F.flatten(F.transform(members, lambda x, i: F.array_compact(F.array(*checks(x, F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")))))))
    return F.when(members.isNotNull(), F.coalesce(each, F.array().cast(ISSUES))).otherwise(F.array(F.struct(F.lit(path).alias("path"), F.lit("must be an array").alias("message"))))


def _intent_checks(v: Column) -> Column:
    """Issues of the leaves of an intent."""
    sub = lambda i, name: F.concat(i, F.lit(f".{name}"))

    def mention(x: Column, i: Column) -> list[Column]:
        return [_issue(~x["object"] | ~_filled(x["match"]), sub(i, "match"), "must be a non-empty string")]

    def particle(x: Column, i: Column) -> list[Column]:
        isotope = x["isotopeAssumed"]
        return [*mention(x, i), _issue(x["object"] & _filled(x["match"]) & _given(isotope) & ~_is(isotope, "STRING"), sub(i, "isotopeAssumed"), "must be a string when present")]

    def energy(x: Column, i: Column) -> list[Column]:
        flag = x["perNucleonAssumed"]
        return [
            _issue(~x["object"], i, "must be an object"),
            _issue(x["object"] & ~_is_number(x["value"]), sub(i, "value"), "must be a finite number"),
            _issue(x["object"] & ~_among(x["unit"], ENERGY_UNITS), sub(i, "unit"), "must be an allowed unit"),
            _issue(x["object"] & _given(flag) & ~_is(flag, "BOOLEAN"), sub(i, "perNucleonAssumed"), "must be a boolean when present"),
        ]

    target, program, confidence = v["target"], v["program"], v["confidence"]
    shaped = F.coalesce(target["kind"].startswith("OBJECT"), F.lit(False)) & _is_number(v["goal"]["value"]) & _filled(v["goal"]["unit"])
    strings = F.coalesce(F.forall(v["assumptions"], lambda k: F.coalesce(k == "STRING", F.lit(False))), F.lit(False))
    within = _is_number(confidence) & F.coalesce(confidence["text"].try_cast("double").between(0, 1), F.lit(False))
    single = F.array_compact(F.array(
        _issue(~_among(v["quantity"], QUANTITIES), "quantity", "must be an allowed class"),
        _issue(~_among(v["compareDim"], COMPARE_DIMS), "compareDim", "must be an allowed dimension"),
        _issue(_given(target) & ~shaped, "target", "must be a number and a unit when present"),
        _issue(_given(program) & ~_is(program, "STRING"), "program", "must be a string when present"),
        _issue(~strings, "assumptions", "must be an array of strings"),
        _issue(~within, "confidence", "must be a number in [0, 1]"),
    ))
    lists = F.concat(_items(v["particles"], "particles", particle), _items(v["materials"], "materials", mention), _items(v["energies"], "energies", energy))
    return F.concat(single, lists, target_issues(_among(v["quantity"], QUANTITIES[2:]), _given(target)))


NOT_AN_OBJECT = (("", "must be an object"),)


def _whole() -> Column:
    return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(m).alias("message")) for p, m in NOT_AN_OBJECT])


def intent_issues(v: Column) -> Column:
    """array<struct<path, message>> of everything wrong with an intent (variant). It is shredded once, each leaf read once."""
    own = bound(F.try_variant_get(v, "$", INTENT), lambda i: bound(_intent_leaves(i), _intent_checks))
    return F.when(_is_object(v), own).otherwise(_whole())


def target_issues(inverse: Column, given: Column) -> Column:
    """A target is needed for inverse classes and allowed for them only."""
    return F.array_compact(F.array(_issue(inverse & ~given, "target", "required for an inverse class"), _issue(~inverse & given, "target", "only allowed for inverse classes")))


def example_issues(v: Column) -> Column:
    """Issues of a whole record (variant): id, text, audio, tags and its expected intent. It is shredded once into a struct of leaves, on
    which all checks work."""

    def leaves(e: Column) -> Column:
        intent = F.when(e["expected"].isNotNull(), _intent_leaves(e["expected"]))
        return F.struct(*[_leaf(e[n]).alias(n) for n in ("id", "text", "audio")], F.size(e["tags"]).alias("tags"), intent.alias("intent"))

    def checks(x: Column) -> Column:
        own = F.array_compact(F.array(
            _issue(~_filled(x["id"]), "id", "must be a non-empty string"),
            _issue(~_is(x["text"], "STRING") | (F.trim(x["text"]["text"]) == ""), "text", "must be a non-empty string"),
            _issue(_given(x["audio"]) & ~x["audio"]["kind"].isin("VOID", "STRING"), "audio", "must be a string, null, or absent"),
            _issue(F.coalesce(x["tags"], F.lit(0)) <= 0, "tags", "must be a non-empty array"),
        ))
        inner = F.when(x["intent"].isNotNull(), _intent_checks(x["intent"])).otherwise(_whole())
        named = F.transform(inner, lambda i: F.struct(F.concat_ws(".", F.lit("expected"), F.nullif(i["path"], F.lit(""))).alias("path"), i["message"].alias("message")))
        return F.concat(own, named)

    own = bound(F.try_variant_get(v, "$", EXAMPLE), lambda e: bound(leaves(e), checks))
    return F.when(_is_object(v), own).otherwise(_whole())


def violations(records: DataFrame) -> DataFrame:
    """record_idx, line_no, path, message of the good lines of data_lines."""
    return records.filter("json is not null").select("record_idx", "line_no", F.explode(example_issues(F.col("json"))).alias("i")).select("record_idx", "line_no", "i.path", "i.message")


def _string(v: Column, path: str) -> Column:
    """The string at a path; null if something else is there."""
    own = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string"))


def _parsed(lines: DataFrame) -> DataFrame:
    """line_no, json of the good lines; the generated column is parsed once, one of a projection would be wherever it is named."""
    return lines.filter(~F.rlike("value", F.lit(DATA_LINE))).select("line_no", F.explode(F.array(F.try_parse_json(F.trim("value")))).alias("json")).filter("json is not null")


def line_violations(lines: DataFrame) -> DataFrame:
    """`violations` straight from lines (line_no, value). Lines are parsed once; what is numbered is the issues, not the texts."""
    found = saved(_parsed(lines).select("line_no", example_issues(F.col("json")).alias("i")), "issues")
    return numbered(found).select("record_idx", "line_no", F.explode("i").alias("i")).select("record_idx", "line_no", "i.path", "i.message")


def line_ids(lines: DataFrame) -> DataFrame:
    """`record_ids` straight from lines (line_no, value), which are parsed once; written, since who looks for repeated ids reads it twice."""
    found = saved(_parsed(lines).select("line_no", _string(F.col("json"), "$.id").alias("id")), "line-ids")
    return saved(numbered(found).select("line_no", "record_idx", "id"), "record-ids")


def record_tags(records: DataFrame) -> DataFrame:
    """record_idx, tag of all string tags."""
    tags = F.try_variant_get("json", "$.tags", "array<string>")
    return records.filter("json is not null").select("record_idx", F.explode(tags).alias("tag"))


def unknown_tags(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The rows (record_idx, tag) whose tag is not in vocabulary (tag)."""
    return tags.join(vocabulary, "tag", "left_anti").select("record_idx", "tag")


def duplicate_ids(records: DataFrame, id_col: str = "id", order_col: str = "line_no") -> DataFrame:
    """The second and later rows of every id; null ids are no duplicates.

    Repeated ids are found by a grouped minimum, so a hot id is not gathered in one task."""
    known = records.filter(F.col(id_col).isNotNull())
    first = known.groupBy(id_col).agg(F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return known.join(first, id_col).filter(F.col(order_col) > F.col("_first")).drop("_first")


def record_ids(records: DataFrame) -> DataFrame:
    """line_no, record_idx, id (null unless a string)."""
    return records.filter("json is not null").select("line_no", "record_idx", _string(F.col("json"), "$.id").alias("id"))


def validation_report(lines: DataFrame, vocabulary: DataFrame, min_count: int = 100) -> DataFrame:
    """One row: count, errors, ok (no errors), passed (ok and count at least min_count)."""
    json = F.col("json")
    rows = lines.filter(~F.rlike("value", F.lit(DATA_LINE))).select(F.try_parse_json(F.trim("value")).alias("json"))
    told = rows.select(json.isNotNull().alias("good"), F.when(json.isNotNull(), F.size(example_issues(json))).otherwise(1).alias("n"), F.try_variant_get(json, "$.tags", "array<string>").alias("tags"), _string(json, "$.id").alias("id"))
    told = saved(told, "validated")  # parsed once, read three times
    own = told.agg(F.count_if("good").alias("count"), F.sum("n").alias("errors"))
    tags = told.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("errors"))
    tags = tags.join(vocabulary, "tag", "left_anti").agg(F.sum("errors").alias("errors"))
    twice = told.filter("id is not null").groupBy("id").agg((F.count(F.lit(1)) - 1).alias("errors")).agg(F.sum("errors").alias("errors"))
    every = own.unionByName(tags, allowMissingColumns=True).unionByName(twice, allowMissingColumns=True)
    total = every.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    return total.withColumn("ok", F.col("errors") == 0).withColumn("passed", F.col("ok") & (F.col("count") >= min_count))


def tag_counts(tags: DataFrame) -> DataFrame:
    """tag, n."""
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def missing_categories(tags: DataFrame, required: DataFrame) -> DataFrame:
    """The required tags that no record has."""
    return required.join(tags.select("tag").distinct(), "tag", "left_anti")
