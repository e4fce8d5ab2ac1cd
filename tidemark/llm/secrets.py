"""Secret scans with an incremental blob ledger.

A text is a blob, named by its SHA-256. The ledger is a table of (blob, rule_version, spans): only blobs that it does
not have under the present rules are scanned, once each however many rows hold them, and findings are joined back
to all rows. Everything is DataFrame functions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .base import free_name, work_path
from .spans import SPAN, Rule, all_matches, masked

# fixed patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
BASE = [Rule("assign", ASSIGN, 2, lambda m, g: F.length(g) >= 6), Rule("access", ACCESS), Rule("hex", HEX)]
# a key's lines: headers, and at least 16 characters of key text with single dashes at most; line breaks may be spelled out
BREAKS = r"(?:\s|\\[nr])*+"
KEY_TEXT = r"[A-Za-z0-9+/=_](?:-?[A-Za-z0-9+/=_])"
PRIVATE_KEY = rf"-----BEGIN [A-Z ]*?PRIVATE KEY-----(?:{BREAKS}(?:[A-Za-z][A-Za-z-]*+:\x20[^\n\\]*+|{KEY_TEXT}{{15,}}+))*+(?:{BREAKS}(?:{KEY_TEXT}*+{BREAKS})?-----END [A-Z ]*?PRIVATE KEY-----)?"
ADDED = [
    # the marks with the lines of key text between them, however many; prose after a mark is none
    Rule("private_key", PRIVATE_KEY),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("prefixed", r"(?<![A-Za-z0-9_])(?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9-]{20,}+"),
]


def version_of(rules: list[Rule]) -> str:
    """Names a set of rules by what they match, so that findings of others in a ledger are not taken for theirs."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, getattr(r.keep, "__qualname__", "")) for r in rules]).encode()).hexdigest()[:16]


def _ledger(docs: DataFrame, path: str) -> DataFrame:
    """The rows of the ledger, none where it is not there yet. It holds places and kinds of findings, never their text."""
    schema = f"blob string, rule_version string, spans {SPAN}"
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def scan_unseen(docs: DataFrame, ledger: str, id_col: str, text_col: str, rules: list[Rule], rule_version: str) -> DataFrame:
    """Scans the blobs that the ledger lacks under this rule version, appends them and returns the ledger's rows of it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    seen = _ledger(docs, ledger).filter(F.col("rule_version") == rule_version).select("blob")
    first = rows.select("blob", "id").groupBy("blob").agg(F.min("id").alias("first")).join(seen, "blob", "left_anti")
    own = first.withColumnRenamed("blob", "b")
    held = rows.join(own, (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
    found = held.select("blob", F.lit(rule_version).alias("rule_version"), all_matches(F.col("text"), rules).alias("spans"))
    found.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    # scans that ran at the same time may both have added a blob
    return _ledger(docs, ledger).filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, rule_version: str | None = None) -> DataFrame:
    """doc_id, blob and spans (start, rank, end, kind; code points, end exclusive) of every row.

    ledger is the path of a table that earlier scans have left, or of a new one; the rules' version follows from the rules. A null text is the empty blob; repeated
    rows and equal texts are scanned once and all get the findings; an empty table gives no rows; very long texts are
    scanned whole. Spans come by start,
    then in the order of the rules. Other columns are ignored, whatever their names.
    """
    path, rules = ledger or work_path(docs.sparkSession, "ledger"), rules or BASE + ADDED
    findings = scan_unseen(docs, path, id_col, text_col, rules, rule_version or version_of(rules))
    blob = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), blob.alias("blob"))
    hit = findings.filter(F.size("spans") > 0).select("blob", "spans")
    return paths.join(hit, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret replaced by its kind in brackets.

    Other columns stay as they are, whatever their names; null texts stay null, repeated rows stay repeated, an empty table
    stays empty."""
    path = ledger or work_path(docs.sparkSession, "ledger")
    findings = scan_unseen(docs, path, id_col, text_col, BASE + ADDED, version_of(BASE + ADDED)).filter(F.size("spans") > 0)
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of, blob, spans = (free_name(docs, c) for c in ("_of", "_blob", "_spans"))
    hit = findings.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    found = docs.withColumn(of, F.sha2(text.cast("binary"), 256)).join(hit, F.col(of) == F.col(blob), "left")
    own = F.coalesce(spans, F.array().cast(SPAN))
    return found.withColumn(text_col, F.when(F.size(own) > 0, masked(text, own)).otherwise(F.col(text_col))).drop(of, blob, spans)
