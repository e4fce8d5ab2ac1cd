"""The pipeline's stages, each on its own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from tidemark.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(P.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * len(rows)
    junk = docs.limit(1).select((F.lit(-5)).cast("long").alias("doc_id"), F.lit("123 !").alias("text"), "lang", "source", "n_chars")
    # of one id and of none, rows are told apart by their texts
    odd = spark.createDataFrame([(None, "123 !"), (min(rows), "456 ?"), (None, None)], "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    judged = stages["language_id"](spark, docs.unionByName(odd).withColumn("_key", F.lit("x")), SF)
    assert judged.count() == kept.count() and judged.filter(f"doc_id = {min(rows)}").count() == 1 and judged.columns == [*docs.columns, "_key"]
    copy = docs.orderBy("doc_id").limit(1).withColumn("doc_id", F.lit(10**6).cast("long"))
    more = docs.unionByName(junk).unionByName(copy)
    assert stages["language_id"](spark, more, SF).filter("doc_id = -5").isEmpty()
    once = stages["minhash_near_dedup"](spark, more, SF)
    assert once.columns == docs.columns and once.filter(f"doc_id = {10**6}").isEmpty() and once.filter(f"doc_id = {min(rows)}").count() == 1
    leaked = table(spark, SF, "benchmark").limit(3).select((F.col("item_id") + 10**7).alias("doc_id"), F.concat(F.lit("x y z "), "text", F.lit(" w")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    nameless = leaked.withColumn("doc_id", F.lit(None).cast("long"))
    clean = stages["benchmark_decontamination"](spark, docs.unionByName(leaked).unionByName(nameless), SF)
    assert clean.filter("doc_id is null").isEmpty()
    assert clean.filter(f"doc_id >= {10**7}").isEmpty() and clean.count() >= 0.9 * len(rows)
    secret = copy.withColumn("text", F.lit("so password=hunter2hunter2 ends"))
    masked = stages["secret_scans"](spark, docs.unionByName(secret), SF)
    r = masked.filter(f"doc_id = {10**6}").first()
    assert r.text == "so [assign] ends" and r.n_chars == len(r.text) and masked.count() == len(rows) + 1
    packed = stages["packing"](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows)


def test_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.isEmpty() and (name == "packing" or out.columns == docs.columns)


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def brute_kept(rows, percent=80):
    """The (id, text) rows that near-dedup keeps, as a multiset: links by full sets, per component the least text of the least id."""
    import hashlib
    import itertools

    from test_operators import sets_of

    nodes = sorted({r for r in rows if r[0] is not None}, key=repr)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {n: sets_of(n[1]) for n in nodes}
    for a, b in itertools.combinations(nodes, 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            root[find(a)] = find(b)
    digest = lambda t: hashlib.sha256(b"-" if t is None else b":" + t.encode()).digest()
    least = {}
    for n in nodes:
        least.setdefault(find(n), []).append((n[0], digest(n[1]), n))
    return sorted([min(v)[2] for v in least.values()] + [r for r in rows if r[0] is None], key=repr)


def test_unlike_texts_of_one_id_stay(spark):
    import random

    from test_operators import prose

    rng = random.Random(8)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (4, c), (4, c), (5, None), (5, None), (6, ""), (None, a), (None, a), (7, c + " z"), (7, prose(rng, 9)), (1, a.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"), F.lit("x").alias("_key"))
    stage = dict(P.STAGES)["minhash_near_dedup"]
    out = stage(spark, df.repartition(3), SF)
    assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == brute_kept(rows)
    once = [(k, t) for k, (_, t) in enumerate(rows)]
    plain = spark.createDataFrame(once, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    assert sorted(((r.doc_id, r.text) for r in stage(spark, plain, SF).collect()), key=repr) == brute_kept(once)
