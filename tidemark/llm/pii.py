"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans; features of a candidate's format and context go to boosted
trees, and a threshold for each generator, calibrated on rows that the trees have not seen, decides which candidates are
redacted besides those of the base patterns, which always are. What the trees learn comes from checks of their own: an
account number's remainder, an address spelled out, a number that a base pattern confirms or that follows a word such
as phone. The trees are fitted by Spark ML on a bounded sample of candidates and are then written as one SQL expression.
No Python on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .base import forget, saved
from .spans import SPAN, Rule, all_matches, bare, told_matches


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_card(m: Column, _: Column) -> Column:
    return F.when(F.length(_digits(m)).between(14, 19), _luhn(m)).otherwise(F.lit(False))


def _is_ip(m: Column, _: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(9)).cast("int") <= 255))


# fixed patterns
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = [Rule("email", EMAIL), Rule("ip", IP, 0, _is_ip), Rule("card", CARD, 0, _is_card), Rule("phone", PHONE, 0, lambda m, g: F.length(_digits(m)).between(10, 15))]
GENERATORS = [
    Rule("mail_like", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++){0,20}+"),
    Rule("number_like", r"(?<![0-9])\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"),
    Rule("code_like", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}+"),
]
CANDIDATE = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean,right:boolean,x:array<double>>>"
FEATURES = 15
CUE = r"(?:tel|phone|fax|mobile|call)\W*$"


def _remainder(m: Column) -> Column:
    """The remainder by 97 of an account number whose first four characters go last, letters as 10 to 35."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97))


def _spelled(m: Column) -> Column:
    """An address with its spaces and words for signs undone."""
    return F.regexp_replace(F.regexp_replace(m, r"\x20?(?:\(at\)|\[at\]|@)\x20?", "@"), r"\x20?(?:\(dot\)|\[dot\])\x20?", ".")


def _right(s: Column) -> Column:
    """What a candidate's own check says, whatever the base patterns do."""
    m, before = s["text"], F.lower(s["before"])
    mail = F.rlike(_spelled(m), F.lit(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"))
    number = F.rlike(before, F.lit(CUE)) & F.length(_digits(m)).between(7, 15)
    return F.when(s["kind"] == "mail_like", mail).when(s["kind"] == "code_like", _remainder(m) == 1).otherwise(number)


def _features(s: Column) -> Column:
    """Format and context of a span as numbers."""
    m, before, after = s["text"], F.lower(s["before"]), s["after"]
    count = lambda pattern: F.length(F.regexp_replace(m, pattern, "")).cast("double")
    flag = lambda c: c.cast("double")
    return F.array(
        F.length(m).cast("double"), count("[^0-9]"), count("[^A-Z]"), count("[^a-z]"), count("[^.]"), count("[^ ()-]"),
        flag(F.startswith(m, F.lit("+"))), F.when(s["kind"] == "code_like", F.when(_remainder(m) == 1, 1.0).otherwise(0.0)).otherwise(flag(F.contains(m, F.lit("@")))), flag(_is_card(m, m)),
        F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        flag(F.rlike(before, F.lit(CUE))), flag(F.rlike(before, F.lit(r"(mail|contact|write)\W*$"))),
        flag(F.rlike(before, F.lit(r"(card|iban|account|visa)\W*$"))), flag(F.rlike(before, F.lit(r"[\p{L}\p{N}]$"))), flag(F.rlike(after, F.lit(r"[\p{L}\p{N}]"))),
    ).cast("array<double>")


def propose(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base (spans) and candidates, each with whether a base span has just its ends, whether it is right by that or by
    its own check, and its features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    found = rows.select("id", all_matches(F.col("text"), BASE).alias("base"), F.flatten(F.array(*[told_matches(F.col("text"), g, len(BASE) + k) for k, g in enumerate(GENERATORS)])).alias("more"))
    ends = F.map_from_arrays(F.array_distinct(F.transform("base", lambda b: b["start"].cast("long") * (1 << 31) + b["end"])), F.array_repeat(F.lit(True), F.size(F.array_distinct(F.transform("base", lambda b: b["start"].cast("long") * (1 << 31) + b["end"])))))
    found = found.withColumn("ends", F.when(F.size("more") > 0, ends))
    own = lambda s: F.coalesce(F.try_element_at("ends", s["start"].cast("long") * (1 << 31) + s["end"]), F.lit(False))
    told = F.transform("more", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], own(s).alias("base"), (own(s) | F.coalesce(_right(s), F.lit(False))).alias("right"), _features(s).alias("x")))
    return found.select("id", "base", F.when(F.size("more") > 0, told).otherwise(F.array().cast(CANDIDATE)).cast(CANDIDATE).alias("candidates"))


def _tree(node, x: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(int(split.featureIndex()))) <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def _fold(parts: int = 5) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(parts))


def fit(candidates: DataFrame, max_candidates: int, trees: int, depth: int):
    """Spark ML trees from about max_candidates exploded candidates at most, fold 0 left out; None if they show one class
    only."""
    candidates = candidates.filter(_fold() > 0)
    n = candidates.agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("p")).first()
    if not n.p or n.p == n.n:
        return None
    share = min(1.0, max_candidates / n.n)
    sample = candidates.filter(F.pmod(F.xxhash64("id", "start", "kind"), F.lit(1 << 30)) < int(share * (1 << 30)))
    flat = sample.select(F.col("right").cast("double").alias("label"), *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(FEATURES)])
    train = saved(VectorAssembler(inputCols=[f"x{k}" for k in range(FEATURES)], outputCol="features").transform(flat).select("label", "features"), "sample")
    labels = train.agg(F.min("label"), F.max("label")).first()
    model = None if labels[0] == labels[1] else GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(train)
    forget(train)
    return model


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9, max_candidates: int = 20_000, trees: int = 8, depth: int = 3) -> DataFrame:
    """doc_id, base and spans (base and added, by start, then in the order of the rules) of every row.

    Offsets are code points, ends exclusive. Candidates that are right by their own check are added, and of a generator's
    others those from the lowest score on at which, among the candidates of a fifth of the ids that the trees have not
    seen, `precision` of those of its kind at or over it and two more are right; where no score has that, no others are. Trees learn
    from about `max_candidates` candidates at most. Null and empty texts have no spans, an empty table gives no rows;
    repeated rows come back as often as they stand; very long texts take time in proportion. Other columns are ignored,
    whatever their names.
    """
    rows = saved(propose(docs, id_col, text_col), "candidates")
    flat = rows.select("id", F.explode("candidates").alias("c")).select("id", "c.start", "c.kind", "c.right", "c.x")
    model = fit(flat, max_candidates, trees, depth)
    limits: dict[str, float] = {}
    score = lambda x: F.lit(-1.0)
    if model is not None:

        def score(x: Column) -> Column:
            total = sum((F.lit(float(w)) * _tree(t._call_java("rootNode"), x) for t, w in zip(model.trees, model.treeWeights, strict=True)), F.lit(0.0))
            return F.round(1 / (1 + F.exp(-2 * total)), 3)

        scored = flat.filter(_fold() == 0).select("kind", "right", score(F.col("x")).alias("p")).groupBy("kind", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right")).collect()  # 1001 rows a generator at most
        for kind in {r.kind for r in scored}:
            n = right = 0
            for r in sorted((r for r in scored if r.kind == kind), key=lambda r: -r.p):
                n, right = n + r.n, right + r.right
                if right >= precision * (n + 2):  # two more wrong ones, so that a handful proves nothing
                    limits[kind] = r.p
    limit = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in limits.items()], F.lit(2.0))
    fresh = F.filter("candidates", lambda c: ~c["base"] & (c["right"] | (score(c["x"]) >= limit(c["kind"]))))
    spans = F.when(F.size("candidates") > 0, F.array_sort(F.concat("base", bare(fresh)))).otherwise(F.col("base"))
    return rows.select(F.col("id").alias("doc_id"), "base", spans.alias("spans"))
