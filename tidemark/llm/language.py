"""Language identification with interpolated Kneser-Ney character models.

Each language's model predicts every letter and the end of each word from the up to four characters before
it in the word. Counts, discounts and probabilities are grouped sums and joins on Spark over all n-grams of all training
rows, none left out (`Tables`). Up to `max_cells` numbers the tables are broadcast as sorted hash arrays (`Model`); beyond,
only the most frequent n-grams are, and words with others are joined to the tables.
Documents go to the language of lowest cross-entropy per character.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import forget, holding, mix, saved

ORDER = 5
_WORD = re.compile(r"[^\W\d_]+")
#: Distinct words of which a task keeps scores or counts at a time.
CACHE_WORDS = 100_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; numerals such as ½ are no letters. A word of over 64 letters stands as its successive
    parts of 64."""
    found = _WORD.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    if any(len(w) > 64 for w in found):
        found = [w[i : i + 64] for w in found for i in range(0, len(w), 64)]
    return found


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that predict each letter and the end of each word, as code points, and the word of each."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer((" " * (ORDER - 1) + (" " * ORDER).join(words) + " " * ORDER).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.repeat(np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]]), lengths + 1)
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    step = np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), lengths + 1)
    return codes[(at + step)[:, None] + np.arange(ORDER)], owner


def gram_counts(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, n over all rows; each task counts words before it counts n-grams."""

    def flush(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            words = list(own)
            windows, owner = _windows(words)
            weights = np.array([own[w] for w in words], np.float64)[owner]
            h = np.zeros(len(windows), np.uint64)
            for k in range(ORDER):
                h = mix(h * np.uint64(31) + windows[:, k].astype(np.uint64))
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights).astype(np.int64)
            text = windows[first].tobytes().decode("utf-32-le", "surrogatepass")
            grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
            for lo in range(0, len(grams), 20_000):
                part = grams[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[lo : lo + 20_000])], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lo in range(0, len(batch), 400):
                for text, lang in zip(*(c.to_pylist() for c in batch.slice(lo, 400).columns), strict=True):
                    if own := words_of(text):
                        counts.setdefault(lang, Counter()).update(own)
                if sum(map(len, counts.values())) > CACHE_WORDS:
                    yield from flush(counts)
                    counts = {}
        yield from flush(counts)

    found = train.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(run, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hashes(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, by order k - 1: the hash of its last k letters, and that of those without the last one."""
    grams, heads = np.empty((len(windows), ORDER), np.uint64), np.empty((len(windows), ORDER), np.uint64)
    gram, head = mix(windows[:, -1].astype(np.uint64) + np.uint64(1)), np.full(len(windows), np.uint64(0x5851F42D4C957F2D))
    grams[:, 0], heads[:, 0] = gram, head
    for k in range(1, ORDER):
        letter = windows[:, ORDER - 1 - k].astype(np.uint64) + np.uint64(1)
        gram, head = mix(gram * np.uint64(0xD6E8FEB86659FD93) + letter), mix(head * np.uint64(0xD6E8FEB86659FD93) + letter)
        grams[:, k], heads[:, k] = gram, head
    return grams, heads


G, C = [f"g{k}" for k in range(1, ORDER + 1)], [f"c{k}" for k in range(1, ORDER + 1)]


def _hash_columns(windows: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(x[:, k]).view(np.int64)) for x in _hashes(windows) for k in range(ORDER)]


def _longs(names: list[str]) -> str:
    return ", ".join(f"{c} long" for c in names)


class Tables:
    """The models of all languages as written tables: `grams[k]` (key, p) has the smoothed probability of each known
    n-gram of k letters in each language, `backs[k]` (key, back) the weight with which each known context hands on to
    order k - 1. Counts and discounts are taken by language and order over all n-grams; a language that does not know a
    context hands on all of it."""

    def __init__(self, counts: DataFrame):
        """counts: lang, gram, n."""
        self.langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # a row a language
        n_langs = len(self.langs)
        place = {k: i for i, k in enumerate(self.langs)}

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
                yield pa.RecordBatch.from_arrays([pa.array([place[x] for x in batch.column(0).to_pylist()], pa.int32()), batch.column(2), *_hash_columns(points)], names=["lang", "n", *G, *C])

        self.counts = {ORDER: saved(counts.select("lang", "gram", "n").mapInArrow(hashed, f"lang int, n long, {_longs(G + C)}"), f"counts-{ORDER}")}
        for k in range(ORDER - 1, 0, -1):  # below the highest order, an n-gram counts once for each letter before it
            self.counts[k] = saved(self.counts[k + 1].groupBy("lang", *G[:k], *C[:k]).agg(F.count(F.lit(1)).alias("n")), f"counts-{k}")
        self.size = self.counts[1].select("g1").distinct().count() + 1  # letters, and one for all unknown ones
        self.grams, self.backs = {}, {}
        for k in range(1, ORDER + 1):
            rows = self.counts[k]
            sizes = rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()  # a row a language
            discount = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, _discount(r.once, r.twice))]), F.col("lang"))
            of = Window.partitionBy("lang", C[k - 1])  # a context has no more n-grams than there are letters
            told = rows.withColumn("d", discount).withColumns({"total": F.sum("n").over(of), "types": F.count(F.lit(1)).over(of)})
            by_lang = lambda value, none: F.array(*[F.coalesce(F.max(F.when(F.col("lang") == i, value)), F.lit(none)) for i in range(n_langs)])
            self.backs[k] = saved(told.groupBy(F.col(C[k - 1]).alias("key")).agg(by_lang(F.col("d") * F.col("types") / F.col("total"), 1.0).alias("back")), f"backs-{k}")
            shares = told.groupBy(F.col(G[k - 1]).alias("key"), F.col(C[k - 1]).alias("head"), F.col(G[k - 2] if k > 1 else C[0]).alias("tail")).agg(by_lang((F.col("n") - F.col("d")) / F.col("total"), 0.0).alias("share"))
            shares = shares.join(self.backs[k].withColumnRenamed("key", "head"), "head")
            if k == 1:
                shares = shares.withColumn("lower", F.array_repeat(F.lit(1 / self.size), n_langs))
            else:
                shares = shares.join(self.grams[k - 1].select(F.col("key").alias("tail"), F.col("p").alias("lower")), "tail")
            p = F.zip_with("share", F.zip_with("back", "lower", lambda x, y: x * y), lambda x, y: x + y)
            self.grams[k] = saved(shares.select("key", p.alias("p")), f"grams-{k}")

    def cells(self) -> int:
        """Numbers that the model holds."""
        return sum(t.count() for t in [*self.grams.values(), *self.backs.values()]) * (len(self.langs) + 2)

    def word_logs(self, words: DataFrame) -> DataFrame:
        """word, logs: log-probabilities of distinct words in each language, by joins."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), 2000):
                    part = batch.column(0).slice(lo, 2000)
                    windows, owner = _windows(part.to_pylist())
                    yield pa.RecordBatch.from_arrays([part.take(pa.array(owner)), *_hash_columns(windows)], names=["word", *G, *C])

        windows = saved(words.mapInArrow(run, f"word string, {_longs(G + C)}"), "windows")
        rows = windows.select(*G, *C).distinct()
        for k in range(1, ORDER + 1):
            grams = self.grams[k].select(F.col("key").alias(G[k - 1]), F.col("p").alias(f"p{k}"))
            backs = self.backs[k].select(F.col("key").alias(C[k - 1]), F.col("back").alias(f"b{k}"))
            rows = rows.join(grams, G[k - 1], "left").join(backs, C[k - 1], "left")
        p = F.array_repeat(F.lit(1 / self.size), len(self.langs))
        for k in range(1, ORDER + 1):
            lower = F.zip_with(F.coalesce(f"b{k}", F.array_repeat(F.lit(1.0), len(self.langs))), p, lambda x, y: x * y)
            p = F.coalesce(f"p{k}", lower)
        known = rows.select(G[-1], F.transform(p, lambda x: F.log(x)).alias("logs"))
        sums = F.array(*[F.sum(F.get("logs", F.lit(i))) for i in range(len(self.langs))])
        return windows.select("word", G[-1]).join(known, G[-1]).groupBy("word").agg(sums.alias("logs"))

    def frequent(self, n: int) -> DataFrame:
        """key, p of the n most frequent n-grams of the highest order, ties by key."""
        often = self.counts[ORDER].groupBy(F.col(G[-1]).alias("key")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(n).select("key")
        return self.grams[ORDER].join(often, "key", "left_semi")

    def forget(self) -> None:
        forget(*self.counts.values(), *self.grams.values(), *self.backs.values())


def _discount(once: int, twice: int) -> float:
    """The discount of a language and order from its n-grams of count 1 and 2."""
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


def _sorted(rows: DataFrame, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a table (key, numbers) and the logarithms of its numbers."""
    found = rows.toArrow().combine_chunks()
    keys = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.log(found.column(1).combine_chunks().flatten().to_numpy()).astype(np.float32).reshape(-1, n_langs)[order]


class Model:
    """`Tables` as sorted hash arrays, for each order one of n-grams and one of contexts."""

    def __init__(self, tables: Tables):
        self.langs, self.size = tables.langs, tables.size
        self.grams, self.backs = [{k: _sorted(t, len(self.langs)) for k, t in x.items()} for x in (tables.grams, tables.backs)]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[1][at], table[0][at] == keys

    def _logs(self, k: int, grams: np.ndarray, heads: np.ndarray) -> np.ndarray:
        if not k:
            return np.full((len(grams), len(self.langs)), -np.log(self.size), np.float32)
        out, hit = self._find(self.grams[k], grams[:, k - 1])
        if len(miss := np.flatnonzero(~hit)):
            back, known = self._find(self.backs[k], heads[miss, k - 1])
            out[miss] = np.where(known[:, None], back, 0) + self._logs(k - 1, grams[miss], heads[miss])
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of words in all languages."""
        windows, owner = _windows(words)
        logs = self._logs(ORDER, *_hashes(windows))
        return np.add.reduceat(logs, np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]), axis=0)


def train_model(train: DataFrame, text_col: str, lang_col: str) -> Tables | None:
    """The models of all non-null languages of train, with all their n-grams; None without any."""
    counts = saved(gram_counts(train.filter(F.col(lang_col).isNotNull()), text_col, lang_col), "grams")
    model = None if counts.isEmpty() else Tables(counts)
    forget(counts)
    return model


def _joined_entropies(docs: DataFrame, id_cols: list[str], text_col: str, model: Tables, ready: int) -> DataFrame:
    """`cross_entropies` where only the model's `ready` most frequent n-grams are broadcast: words with others are joined."""
    n_langs = len(model.langs)
    shared = docs.sparkSession.sparkContext.broadcast(_sorted(model.frequent(ready), n_langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shared.value
        index: dict[str, int] = {}
        scores, whole = np.zeros((0, n_langs)), np.zeros(0, bool)
        for batch in batches:
            for lo in range(0, len(batch), 400):
                part = batch.slice(lo, 400)
                texts = [words_of(t) for t in part.column(len(id_cols) + 1).to_pylist()]
                if len(index) > CACHE_WORDS:
                    index, scores, whole = {}, scores[:0], whole[:0]
                if fresh := [w for w in {w for t in texts for w in t} if w not in index]:
                    index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
                    windows, owner = _windows(fresh)
                    own = _hashes(windows)[0][:, -1]
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
                    full = np.logical_and.reduceat(keys[at] == own, starts)
                    scores = np.concatenate([scores, np.where(full[:, None], np.add.reduceat(logs[at].astype(float), starts), 0)])
                    whole = np.concatenate([whole, full])
                numbers = part.column(len(id_cols)).to_pylist()
                place, chars, word, n, sums = [], [], [], [], []
                for r, words in enumerate(texts):
                    found = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    rest = Counter(words[i] for i in np.flatnonzero(~whole[found]))
                    place += [r] * (1 + len(rest))
                    chars += [sum(map(len, words)) + len(words)] * (1 + len(rest))
                    word += [f"#{numbers[r]}", *rest]  # no word, and not the same one for all rows
                    n += [0, *rest.values()]
                    sums += [scores[found].sum(axis=0), *[np.zeros(n_langs)] * len(rest)]
                ids = [part.column(k).take(pa.array(place, pa.int64())) for k in range(len(id_cols) + 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * n_langs), pa.array(np.concatenate(sums) if sums else np.zeros(0)))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(chars, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64()), lists], names=[*id_cols, "_row", "chars", "word", "n", "sums"])

    chosen = docs.select(*id_cols, F.monotonically_increasing_id().alias("_row"), F.col(text_col).cast("string"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    rows = saved(holding(chosen.mapInArrow(run, f"{ddl}, chars long, word string, n long, sums array<double>"), shared), "sums")
    logs = model.word_logs(rows.filter("n > 0").select("word").distinct())
    total = [F.sum(F.get("sums", F.lit(i)) + F.col("n") * F.coalesce(F.get("logs", F.lit(i)), F.lit(0.0))) for i in range(n_langs)]
    ce = F.array(*[-x / F.greatest(F.col("chars"), F.lit(1)) for x in total])
    return rows.join(logs, "word", "left").groupBy("_row", *id_cols, "chars").agg(ce.alias("ce")).select(*id_cols, "chars", "ce")


def cross_entropies(docs: DataFrame, id_cols: list[str], text_col: str, tables: Tables | None, max_cells: int) -> DataFrame:
    """The id columns, chars (letters and word ends predicted) and ce, the nats per character in each language."""
    if tables and tables.cells() > max_cells:
        return _joined_entropies(docs, id_cols, text_col, tables, max_cells // (2 * len(tables.langs) + 4))
    shared = docs.sparkSession.sparkContext.broadcast(Model(tables) if tables else None)  # within max_cells
    n_langs = len(tables.langs) if tables else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index, scores = shared.value, {}, np.zeros((0, n_langs + 1), np.float32)
        for batch in batches:
            for lo in range(0, len(batch), 400):
                part = batch.slice(lo, 400)
                texts = [words_of(t) for t in part.column(len(id_cols)).to_pylist()]
                lengths = np.array([len(t) for t in texts])
                flat = [w for t in texts for w in t]
                sums = np.zeros((len(texts), n_langs + 1))
                if flat and own:
                    if len(index) > CACHE_WORDS:
                        index, scores = {}, scores[:0]
                    if fresh := [w for w in set(flat) if w not in index]:
                        index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
                        scores = np.concatenate([scores, np.column_stack([own.score(fresh), np.array([len(w) + 1 for w in fresh], np.float32)])])
                    values = scores[np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))].astype(np.float64)
                    full = np.flatnonzero(lengths)
                    sums[full] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths[full])[:-1]]), axis=0)
                chars = sums[:, -1].astype(np.int64)
                ce = -sums[:, :-1] / np.maximum(chars, 1)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n_langs), pa.array(ce.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(id_cols))), pa.array(chars), lists], names=[*id_cols, "chars", "ce"])

    chosen = docs.select(*id_cols, F.col(text_col).cast("string"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return holding(chosen.mapInArrow(run, f"{ddl}, chars long, ce array<double>"), shared)


def _fitted(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (margin, right, wrong), lightly held to slope 20 and intercept 0."""
    x = np.array([b[0] for b in bins] + [0.0, 0.2])
    right, wrong = np.array([b[1] for b in bins] + [1.0, 1.0]), np.array([b[2] for b in bins] + [1.0, 0.02])
    a, b = 20.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = (right + wrong) * p * (1 - p)
        g = np.array([(right - (right + wrong) * p) @ x - 1e-3 * (a - 20), (right - (right + wrong) * p).sum() - 1e-3 * b])
        hess = np.array([[w @ x**2 + 1e-3, w @ x], [w @ x, w.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a + np.clip(step[0], -10, 10), b + np.clip(step[1], -3, 3)
    return max(a, 0.0), b


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_part: int = 2, parts: int = 4, max_cells: int = 16_000_000, slack: float = 1.25, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (and the columns `carry`) of every row.

    Rows whose crc32(id as text) mod `parts` is `held_out_part` are never learned from. Of the rest, those of the last
    other remainder calibrate, the others train. lang_pred is the language of lowest cross-entropy (ties: the first by
    name), `und` with score 0 if the text is null, empty or has no letter, or nothing could be learned. score is the
    calibrated probability from the margin to the second language. rejected marks `und` and texts whose cross-entropy
    is more than `slack` times the 99.9 % quantile of the calibration texts of their language. A null id is held out.
    Repeated rows come back as often as they stand; other columns are ignored, whatever their names.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))
    calibration = max(k for k in range(parts) if k != held_out_part)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), fold.cast("int").alias("fold"), *[F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)])
    model = train_model(rows.filter(~F.col("fold").isin(held_out_part, calibration)), "text", "lang")
    scored = saved(cross_entropies(rows, ["doc_id", "lang", "fold", *[f"carry{k}" for k in range(len(carry))]], "text", model, max_cells), "entropies")
    if model:
        model.forget()
    names = F.array(*map(F.lit, model.langs)) if model else F.array().cast("array<string>")
    best = F.array_min("ce")
    ranked = scored.withColumn("best", best).withColumn("pred", F.when(F.col("chars") > 0, F.get(names, F.array_position("ce", best).cast("int") - 1)))
    ranked = ranked.withColumn("margin", F.when(F.size("ce") > 1, F.get(F.array_sort("ce"), F.lit(1)) - F.col("best")).otherwise(F.lit(0.2)))
    known = ranked.filter((F.col("fold") == calibration) & F.col("lang").isNotNull() & F.col("pred").isNotNull())
    right: Column = F.col("lang") == F.col("pred")
    bins = known.groupBy(F.least(F.floor(F.col("margin") * 200), F.lit(400)).alias("bin")).agg(F.avg("margin").alias("x"), F.count_if(right).alias("right"), F.count_if(~right).alias("wrong")).collect()  # 401 rows at most
    a, b = _fitted([(r.x, r.right, r.wrong) for r in bins])
    limits = {r.pred: r.q for r in known.filter(right).groupBy("pred").agg(F.percentile_approx("best", 0.999, 10_000).alias("q")).collect()}  # a row a language
    limit = F.coalesce(*[F.when(F.col("pred") == k, F.lit(q * slack)) for k, q in limits.items()], F.lit(float("inf")))
    score = 1 / (1 + F.exp(-(F.lit(float(a)) * F.col("margin") + F.lit(float(b)))))
    none = F.col("pred").isNull()
    return ranked.select("doc_id", F.coalesce(F.col("fold") == held_out_part, F.lit(True)).alias("held_out"), F.coalesce("pred", F.lit("und")).alias("lang_pred"), F.when(none, 0.0).otherwise(score).alias("score"), (none | (F.col("best") > limit)).alias("rejected"), *[F.col(f"carry{k}").alias(c) for k, c in enumerate(carry)])
