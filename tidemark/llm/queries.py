"""The queries of the training-data operators: thin, over whole tables, digest columns derived from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import pii, secrets
from .chat import format_preferences
from .decontaminate import leaks
from .htmltext import extract
from .language import identify
from .media import media_columns
from .merkle import manifest
from .neardup import near_duplicates
from .packing import pack
from .spans import joined, of_kinds
from .suffixes import remove_repeats
from .warc import archive
from .whitening import whiten


def vocabulary() -> str:
    """The public byte-level BPE file; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_media_tar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def _digest(base: Column) -> Column:
    return F.sha2(joined(base).cast("binary"), 256)


def op3_secret_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    base = of_kinds(F.col("spans"), kinds)
    counts = [F.size(of_kinds(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, _digest(base).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def preference_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from conversations: each as it is, and with its last assistant turn answered as the next conversation's is."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l")).select("conv_id", F.col("l.turn").alias("at"), F.col("l.text").alias("answer"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("other"))
    worse = turns.join(last, "conv_id", "left").join(other, "conv_id", "left")
    swap = (F.col("role") == "assistant") & (F.col("turn") == F.col("at"))
    worse = worse.select("conv_id", "turn", "role", F.when(swap, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))
    return turns.withColumn("is_chosen", F.lit(True)).unionByName(worse.withColumn("is_chosen", F.lit(False)))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(preference_turns(spark, sf_dir), pair_col="conv_id").withColumnRenamed("pair_id", "conv_id")


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc_sharded_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(of_kinds(F.col("base"), [r.kind])).cast("long").alias(f"n_{r.kind}") for r in pii.BASE]
    return found.select("doc_id", *counts, _digest(F.col("base")).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_butterfly_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, a third of which are held against texts whose capitals were lost."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(table(spark, sf_dir, "documents"), {"text": F.when(hit, lowered).otherwise(F.col("text"))})


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_template_html_text, op2_media_tar_shards, op3_secret_blob_ledger, op4_preference_formatting, op5_latent_decontamination, op6_warc_sharded_writer, op7_cutting_stock_packing, op8_pii_boosting, op9_kneser_ney_language, op10_minhash_neardup, op11_butterfly_merkle_manifest, op12_embedding_whitening, op13_suffix_radix_dedup]
    return {f.__name__: f for f in own}


# (kind, pattern, group that is the span, group whose length counts, least length); what stands before a span is a group of its own
OP3_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 1, 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 1, 24),
    ("private_key", r"(-----BEGIN [A-Z ]*?PRIVATE KEY-----(?:(?:\s|\\[nr])*(?:[A-Za-z][A-Za-z-]*:\x20[^\n\\]*|[A-Za-z0-9+/=_](?:-?[A-Za-z0-9+/=_]){15,}))*(?:(?:\s|\\[nr])*(?:[A-Za-z0-9+/=_](?:-?[A-Za-z0-9+/=_])*(?:\s|\\[nr])*)?-----END [A-Z ]*?PRIVATE KEY-----)?)", 1, 1, 0),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, 1, 0),
    ("prefixed", r"(?:^|[^A-Za-z0-9_])((?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9-]{20,})", 1, 1, 0),
]


def _op3_sql() -> str:
    """Starts are running sums of the lengths of matches and of the gaps that a split leaves."""
    parts = []
    for rank, (kind, pattern, span, counted, least) in enumerate(OP3_RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"SELECT k, {rank} AS rank, '{kind}' AS kind, {least} AS least, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(c) AS c, unnest(gaps[:len(m)]) AS gap FROM (SELECT k, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {span}) AS g, regexp_extract_all(text, {p}, {counted}) AS c, string_split_regex(text, {p}) AS gaps FROM t)")
    return f"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), u AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY k, rank ORDER BY i) AS BIGINT) AS stop FROM u),
s AS (SELECT k, rank, stop - length(g) AS start, concat(kind, ':', stop - length(g), ':', stop) AS span FROM e WHERE length(c) >= least),
f AS (SELECT k, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY k)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN f USING (k)"""


OP3 = _op3_sql()

OP4 = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations), l AS (SELECT conv_id, max(turn) AS pos, arg_max(text, turn) AS answer FROM t WHERE role = 'assistant' GROUP BY 1),
p AS (SELECT c.conv_id, c.turn, c.role, c.text, pos, answer, coalesce(o.answer_, '') AS other FROM t c LEFT JOIN l USING (conv_id) LEFT JOIN (SELECT conv_id - 1 AS conv_id, answer AS answer_ FROM l) o USING (conv_id)),
r AS (SELECT conv_id, turn, turn = pos AS swapped, pos IS NULL OR answer = other OR turn < pos AS shared, answer, other, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS a, concat('<|', role, '|>', chr(10), CASE WHEN turn = pos THEN other ELSE text END, '<|end|>', chr(10)) AS b FROM p)
SELECT conv_id, CAST(count(*) FILTER (shared) AS INT) AS prompt_turns, coalesce(string_agg(a, '' ORDER BY turn) FILTER (shared), '') AS prompt, coalesce(string_agg(a, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
coalesce(string_agg(b, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected, coalesce(max(concat('14:', 22 + length(answer))) FILTER (swapped AND NOT shared), '') AS chosen_mask, coalesce(max(concat('14:', 22 + length(other))) FILTER (swapped AND NOT shared), '') AS rejected_mask FROM r GROUP BY 1"""

OP6 = """WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS g FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY g) AS last FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM m"""

OP10 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i+4]))) WHEN len(w) > 0 THEN [hash(w)] ELSE [] END AS s FROM w),
f AS (SELECT s, min(doc_id) AS first, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s HAVING len(s) > 0), u AS (SELECT first, n, unnest(s) AS h FROM f),
i AS (SELECT x.first AS a, y.first AS b, x.n AS na, y.n AS nb, count(*) AS k FROM u x JOIN u y ON x.h = y.h AND x.first <> y.first GROUP BY ALL),
links AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (na + nb - k)), reach(a, b) AS (SELECT first, first FROM f UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), c AS (SELECT a, min(b) AS root FROM reach GROUP BY 1),
o AS (SELECT doc_id, len(s.s) AS n_shingles, coalesce(root, doc_id) AS component_id FROM (SELECT doc_id, list_sort(s) AS s FROM s) s LEFT JOIN f ON f.s = s.s LEFT JOIN c ON c.a = f.first)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o"""


OP13 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents), w AS (SELECT doc_id, unnest(range(0, len(b) // 2 - 99)) AS i, b FROM d),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY substr(b, 2 * i + 1, 200) ORDER BY doc_id, i) > 1 AS again FROM w), g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE again),
h AS (SELECT doc_id, i, sum(CASE WHEN before + 100 >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g), s AS (SELECT doc_id, k, min(i) AS lo, max(i) + 100 AS hi FROM h GROUP BY 1, 2),
p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM s),
r AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans, max(hi) AS tail, string_agg(substr(b, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, len(b) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(concat(coalesce(kept, ''), substr(b, 2 * coalesce(tail, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""


def _op11_sql(depth: int = 8, group_depth: int = 4) -> str:
    """Trees of up to 8 ** depth rows a group and 8 ** group_depth groups, a level a table; a level of one node is the top."""
    value = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')"
    head = "concat(" + ", ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars")) + ", "
    parts = [
        "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t)",
        "d AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, crc)",
        f"l AS (SELECT doc_id, lang, sha256({head}{value('text')})) AS leaf, sha256({head}{value('(CASE WHEN hit THEN translate(text, ' + repr('ABCDEFGHIJKLMNOPQRSTUVWXYZ') + ', ' + repr('abcdefghijklmnopqrstuvwxyz') + ') ELSE text END)')})) AS f0 FROM d)",
        "t0 AS (SELECT lang AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS node FROM l)",
        "r0 AS (SELECT doc_id, lang, leaf, f0 AS f, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM l)",
    ]

    def climb(t: str, r: str, k: int, key: str) -> None:
        side = lambda rows: f"coalesce(string_agg(node, '') OVER (PARTITION BY k, p // 8 ORDER BY p ROWS BETWEEN {rows}), '')"
        parts.append(f"s{t}{k} AS (SELECT k, p, node, count(*) OVER (PARTITION BY k) AS n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS b FROM {t}{k})")
        parts.append(f"{t}{k + 1} AS (SELECT k, p // 8 AS p, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY p)) END AS node FROM s{t}{k} GROUP BY k, p // 8)")
        parts.append(f"{r}{k + 1} AS (SELECT r.* REPLACE (CASE WHEN n = 1 THEN f ELSE sha256(concat(a, f, b)) END AS f, concat(proof, a, b) AS proof, r.p // 8 AS p) FROM {r}{k} r JOIN s{t}{k} s ON s.k IS NOT DISTINCT FROM r.{key} AND s.p = r.p)")

    for k in range(depth):
        climb("t", "r", k, "lang")
    parts.append(f"g0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS p, node, k AS lang FROM t{depth})")
    parts.append(f"q0 AS (SELECT doc_id, r.lang, leaf, f, proof, g.p, 0 AS one, node AS subroot FROM r{depth} r JOIN g0 g ON g.lang IS NOT DISTINCT FROM r.lang)")
    for k in range(group_depth):
        climb("g", "q", k, "one")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = node AS verified FROM q{group_depth}, g{group_depth}"


OP11 = _op11_sql()


def oracle_sql() -> dict[str, str]:
    """The operators whose rows SQL expresses; tests/llm hold the others against brute force, round trips and held-out rows."""
    return {"op3_secret_blob_ledger": OP3, "op4_preference_formatting": OP4, "op6_warc_sharded_writer": OP6, "op10_minhash_neardup": OP10, "op11_butterfly_merkle_manifest": OP11, "op13_suffix_radix_dedup": OP13}
