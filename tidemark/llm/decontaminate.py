"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages. Passages are TF-IDF vectors over the words of the benchmark, with
document frequencies over all documents; a distributed randomised singular value decomposition gives a latent
space, in which every passage is compared with every passage of the benchmark items by cosine. Candidates are then decided on whole
texts: a longest common subsequence of words long enough, dense enough, and the item's answer (its last words) in it.

Large benchmarks are taken in blocks of at most `block_items` items and `block_words` words, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import NOT_ALNUM, forget, holding, mix, saved, string_parts, word_hashes, word_spans


class Items:
    """One block of benchmark items: sorted distinct word hashes, and each item as indexes into them; `pieces` are its
    passages of at most `passage` words, of about equal length, and `item_of` their items."""

    def __init__(self, ids: list[int], words: list[np.ndarray], passage: int):
        self.ids = np.array(ids, np.int64)
        self.vocabulary = np.unique(np.concatenate(words))
        self.words = [np.searchsorted(self.vocabulary, w) for w in words]
        cut = [np.array_split(w, -(-len(w) // passage)) for w in self.words]
        self.pieces = [p for c in cut for p in c]
        self.item_of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def words_of(texts: list[str]) -> list[np.ndarray]:
    found: list[np.ndarray] = []
    for lo, hi, data, offsets in string_parts(pc.utf8_lower(pa.array(texts, pa.string()))):
        starts, ends, row = word_spans(data, offsets, NOT_ALNUM)
        hashes = word_hashes(data, starts, ends)
        found += np.split(hashes, np.searchsorted(row, np.arange(1, hi - lo)))
    return found


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_items: int, block_words: int, passage: int) -> Iterator[Items]:
    """Items in blocks of at most block_items pieces; rows come to the driver one after the other and only one block is held."""
    ids: list[int] = []
    words: list[np.ndarray] = []
    size = pieces = 0
    rows = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).distinct()
    for item, text in rows.orderBy(*rows.columns).toLocalIterator():
        own = words_of([text])[0] if text else []
        if len(own):
            more = -(-len(own) // passage)
            if ids and (pieces + more > block_items or size + len(own) > block_words):
                yield Items(ids, words, passage)
                ids, words, size, pieces = [], [], 0, 0
            ids.append(item)
            words.append(own)
            size += len(own)
            pieces += more
    if ids:
        yield Items(ids, words, passage)


def hit_lists(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """id, hits: the benchmark words of each text as little-endian pairs of 32-bit word position and vocabulary index."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table_bits = 22
        quick = np.zeros(1 << table_bits, bool)
        quick[own.vocabulary >> np.uint64(64 - table_bits)] = True
        for batch in batches:
            for lo, hi, data, offsets in string_parts(pc.utf8_lower(batch.column(1))):
                starts, ends, row = word_spans(data, offsets, NOT_ALNUM)
                hashes = word_hashes(data, starts, ends)
                maybe = np.flatnonzero(quick[hashes >> np.uint64(64 - table_bits)])
                index = own.find(hashes[maybe])
                maybe, index = maybe[index >= 0], index[index >= 0]
                first = np.searchsorted(row, np.arange(hi - lo))
                pairs = np.column_stack([(maybe - first[row[maybe]]).astype("<u4"), index.astype("<u4")])
                cuts = np.searchsorted(row[maybe], np.arange(hi - lo + 1)) * 8
                raw = pairs.tobytes()
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(full)), pa.array([raw[cuts[i] : cuts[i + 1]] for i in full], pa.binary())], names=["id", "hits"])

    return holding(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, hits binary"), shared)


def _passages(lists: list[bytes], weight: np.ndarray, width: int, overlap: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and first position of each passage that has weighted words; passage, word and weight of each such word.
    Passages are `width` words long and begin every width / 2 words (every width words without overlap)."""
    hits = np.frombuffer(b"".join(lists), "<u4").reshape(-1, 2)
    rows = np.repeat(np.arange(len(lists)), np.array([len(x) // 8 for x in lists], np.int64))
    used = np.flatnonzero(weight[hits[:, 1]] > 0)
    hits, rows = hits[used].astype(np.int64), rows[used]
    pace = width // 2 if overlap else width
    step, word = hits[:, 0] // pace, hits[:, 1]
    key = (rows << 32) | step
    if overlap:
        again = np.flatnonzero(step > 0)
        key, word = np.concatenate([key, key[again] - 1]), np.concatenate([word, word[again]])
        order = np.argsort(key, kind="stable")
        key, word = key[order], word[order]
    distinct, owner = np.unique(key, return_inverse=True)
    return distinct >> 32, (distinct & 0xFFFFFFFF) * pace, owner, word, weight[word]


def _sums(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Row sums by ascending owner."""
    return np.add.reduceat(values, np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]), axis=0)


def _latent(basis: np.ndarray, owner: np.ndarray, word: np.ndarray, w: np.ndarray) -> Iterator[np.ndarray]:
    """Each latent coordinate of all passages; the basis has a row for each coordinate, which fits the nearest cache."""
    n = int(owner[-1]) + 1 if len(owner) else 0
    for row in basis:
        yield np.bincount(owner, row[word] * w, n)


def document_frequencies(hits: DataFrame, n_words: int) -> np.ndarray:
    """In how many documents each benchmark word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_words, np.int64)
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                n[np.unique(np.frombuffer(raw, "<u4")[1::2])] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["word", "n"])

    df = np.zeros(n_words)
    for r in hits.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # block_words rows at most
        df[r.word] = r.n
    return df


def weights(items: Items, df: np.ndarray, n_docs: int, rare_words: int, rare_share: float) -> np.ndarray:
    """Inverse document frequencies of the words in less than `rare_share` of the documents and of each piece's
    `rare_words` rarest ones, however frequent those are; 0 for the other words."""
    used = df < rare_share * n_docs
    for w in items.pieces:
        own = np.unique(w)
        used[own[np.argsort(df[own], kind="stable")[:rare_words]]] = True
    return np.where(used, np.log(1 + (n_docs + 1) / (df + 1)), 0.0)


def _normal(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=-1, keepdims=True), 1e-12)


def _piece_words(items: Items, idf: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, word and TF-IDF weight (counted) or IDF weight (once a word) of the pieces' words."""
    owner = np.repeat(np.arange(len(items.pieces)), [len(p) for p in items.pieces])
    word = np.concatenate(items.pieces)
    key, n = np.unique(owner * len(idf) + word, return_counts=True)
    owner, word = key // len(idf), key % len(idf)
    return owner, word, idf[word] * (n if counted else 1)


def _product(owner: np.ndarray, word: np.ndarray, w: np.ndarray, basis: np.ndarray, n_words: int) -> np.ndarray:
    """A'(A basis) of the rows of A that owner, word and weight give, each of length 1; the basis has a row a coordinate."""
    total = np.zeros((len(basis), n_words))
    if len(owner):
        w = w / np.maximum(np.sqrt(np.bincount(owner, w * w)), 1e-12)[owner]
        for k, latent in enumerate(_latent(basis, owner, word, w)):
            total[k] = np.bincount(word, latent[owner] * w, n_words)
    return total


def singular_vectors(hits: DataFrame, items: Items, idf: np.ndarray, rank: int, oversampling: int, power_steps: int, passage: int) -> np.ndarray:
    """A basis (vocabulary x rank) of the leading right singular space of the TF-IDF matrix of all passages and the
    benchmark items' passages.

    A sketch A'(A W) with random W of `oversampling` more columns is summed over tasks, orthonormalised on the driver
    (vocabulary x columns, bounded by the block), sharpened by `power_steps` more products and cut to `rank` by the
    singular values that the last of them shows, so the corpus is read power_steps + 1 times. The benchmark's passages together weigh as much as those of the corpus."""
    n_words, spark = len(idf), hits.sparkSession
    columns = min(rank + oversampling, n_words)
    own = _piece_words(items, idf, True)

    def product(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((np.ascontiguousarray(basis.T), idf.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, weight = shared.value
            total, rows = np.zeros((len(q), n_words)), 0
            for batch in batches:
                for lo in range(0, len(batch), 1000):
                    _, _, owner, word, w = _passages(batch.column(1).slice(lo, 1000).to_pylist(), weight, passage, False)
                    total += _product(owner, word, w, q, n_words)
                    rows += int(owner[-1]) + 1 if len(owner) else 0
            at = np.flatnonzero(total.any(axis=0))
            for lo in range(0, len(at), 500):
                part = np.ascontiguousarray(total[:, at[lo : lo + 500]].T).astype(np.float32)
                bounds = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 500]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(part.ravel()))], names=["word", "row"])
            if rows:  # the number of passages stands in a row of its own
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([[float(rows)]], pa.list_(pa.float32()))], names=["word", "row"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            rows = np.stack(table.column("row").to_numpy())
            return pa.table({"word": table.column("word")[:1], "row": pa.array([rows.sum(axis=0, dtype=float)], pa.list_(pa.float64()))})

        # a row a word and task, so a group is as large as the number of tasks
        parts = hits.mapInArrow(run, "word long, row array<float>").groupBy("word").applyInArrow(add, "word long, row array<double>")
        out, n_rows = np.zeros((n_words, columns)), 0.0
        for r in parts.toLocalIterator():  # vocabulary x columns numbers
            if r.word < 0:
                n_rows = r.row[0]
            else:
                out[r.word] = r.row
        shared.destroy()
        return out + max(1.0, n_rows) / len(items.pieces) * _product(*own, np.ascontiguousarray(basis.T), n_words).T

    seeds = mix(np.arange(n_words * columns, dtype=np.uint64) + np.uint64(1))
    basis = np.where(seeds & np.uint64(1), 1.0, -1.0).reshape(n_words, columns)
    basis = np.linalg.qr(product(basis))[0]
    for _ in range(power_steps):
        basis, held = np.linalg.qr(sharper := product(basis))[0], basis
        small = held.T @ sharper  # A'A in the basis before: its values say which directions lead
        turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
        leading = np.linalg.qr(sharper @ turn[:, :rank])[0]
    return leading if power_steps else basis[:, :rank]


def lcs(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence of a and b, and the first and last place in b of one that
    ends as early and from there begins as late as it can."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        up = np.where(b == a[i], table[i, :-1] + 1, 0)
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], up))
    n = int(table[-1, -1])
    i, j = len(a), int(np.argmax(table[-1] == n))
    first = last = j - 1
    while i and j and table[i, j]:
        if a[i - 1] == b[j - 1]:
            first = j - 1
            i, j = i - 1, j - 1
        elif table[i - 1, j] == table[i, j]:
            i -= 1
        else:
            j -= 1
    return n, first, last


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place of b the place from which on it is lost to matching (below 0: never). The longest common
    subsequence of a and b[s:e] is e - s less the places in [s, e) whose value is s or more (semi-local combing)."""
    m, n = len(a), len(b)
    rising = a[::-1]
    across, down = np.arange(m), m + np.arange(n)
    for d in range(m + n - 1):  # cells (i, j) of i + j = d, i falling
        lo, hi = max(0, d - n + 1), min(m - 1, d)
        k, j = slice(m - 1 - hi, m - lo), slice(d - hi, d - lo + 1)
        x, y = across[k].copy(), down[j]
        turn = (rising[k] == b[j]) | (x > y)
        across[k], down[j] = np.where(turn, y, x), np.where(turn, x, y)
    return down - m


def dense(a: np.ndarray, answer: np.ndarray, b: np.ndarray, at: np.ndarray, need: float, density: float, answer_need: float) -> int:
    """The most words of a that b[s:e] has in order, over all s and e where those are `need` or more and `density` or
    more of the extent by the word positions `at`, and b[s:e] has `answer_need` or more of answer; 0 without any."""
    n = len(b)
    lost, missed = _kernel(a, b), _kernel(answer, b)
    losses, misses = np.zeros(n, np.int64), np.zeros(n, np.int64)  # by e - 1, of places from s on
    first = [np.flatnonzero(x >= 0) for x in (lost, missed)]
    by_start = [dict(zip(x[f].tolist(), f.tolist(), strict=True)) for x, f in zip((lost, missed), first, strict=True)]
    best = 0
    for s in range(n - 1, -1, -1):
        if s in by_start[0]:
            losses[by_start[0][s] :] += 1
        if s in by_start[1]:
            misses[by_start[1][s] :] += 1
        to = int(np.searchsorted(at, at[s] + len(a) / density, "left"))
        size = np.arange(1, to - s + 1)
        common = size - losses[s:to]
        good = (common >= need) & (common >= density * (at[s:to] - at[s] + 1)) & (size - misses[s:to] >= answer_need)
        if good.any():
            best = max(best, int(common[good].max()))
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", passage: int = 64, rank: int = 128, oversampling: int = 16, power_steps: int = 1, cosine: float = 0.35, share: float = 0.7, density: float = 0.6, answer_words: int = 5, answer_share: float = 0.6, rare_words: int = 12, rare_share: float = 0.01, block_items: int = 20_000, block_words: int = 60_000) -> DataFrame:
    """doc_id, item_id, cosine, lcs_words, item_words, answer_found: one row for each document and item it leaks.

    A pair is a leak if a passage's latent cosine to one of the item's passages is `cosine` or more, its latent length at
    least half of that one's (items of 12 or fewer words meet passages of 12 words, those of 3 or fewer passages of 4), and,
    around that passage, some stretch
    of text has `share` or more of the item's words in order, those are at least `density` of it, and it holds
    `answer_share` or more of the item's last `answer_words` words; lcs_words is the most of any such stretch. Words are runs of letters and digits,
    lower-cased. Null and empty texts and items leak nothing; repeated rows give the pair once; empty tables give no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    found: list[DataFrame] = []
    for items in blocks_of(benchmark, item_col, item_text_col, block_items, block_words, passage):
        hits = saved(hit_lists(docs, items, id_col, text_col), "hits")
        n_docs = max(1, hits.count())
        df = document_frequencies(hits, len(items.vocabulary))
        idf = weights(items, df, n_docs, rare_words, rare_share)
        vectors = singular_vectors(hits, items, idf, rank, oversampling, power_steps, passage)
        pairs = _decided(hits, items, idf, vectors, passage, cosine, share, density, answer_words, answer_share)
        found.append(saved(pairs, "leaks"))
        forget(hits)
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_words long, item_words long, answer_found boolean")
    return reduce(DataFrame.unionByName, found)


def _decided(hits: DataFrame, items: Items, idf: np.ndarray, vectors: np.ndarray, passage: int, cosine: float, share: float, density: float, answer_words: int, answer_share: float) -> DataFrame:
    owner, word, w = _piece_words(items, idf, False)
    latent_items = np.stack([np.bincount(owner, row[word] * w, len(items.pieces)) for row in np.ascontiguousarray(vectors.T)], axis=1)
    shared = hits.sparkSession.sparkContext.broadcast((items, idf.astype(np.float32), np.ascontiguousarray(vectors.T), _normal(latent_items).T.astype(np.float32), np.linalg.norm(latent_items, axis=1).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight, v, targets, lengths = shared.value
        words = np.array([len(p) for p in own.pieces])
        classes = [(passage, words > 12), (12, (words > 3) & (words <= 12)), (4, words <= 3)]  # short pieces meet short passages
        widths = [(width, np.flatnonzero(own_class)) for width, own_class in classes if own_class.any()]
        for batch in batches:
            for lo in range(0, len(batch), 400):
                part = batch.slice(lo, 400)
                lists = part.column(1).to_pylist()
                best: dict[tuple[int, int], list] = {}
                for width, chosen in widths:
                    row, start, owner, word, w = _passages(lists, weight, width, True)
                    if not len(owner):
                        continue
                    # a passage shorter than half of a piece's vector cannot hold most of the piece
                    near = _sums(w * w, owner) >= (0.5 * lengths[chosen].min()) ** 2
                    if not near.any():
                        continue
                    row, start, used = row[near], start[near], near[owner]
                    owner, word, w = np.unique(owner[used], return_inverse=True)[1], word[used], w[used]
                    latent = np.stack(list(_latent(v, owner, word, w)), axis=1).astype(np.float32)
                    size = np.linalg.norm(latent, axis=1)
                    similar = _normal(latent) @ targets[:, chosen]
                    p, piece = np.nonzero((similar >= cosine) & (size[:, None] >= 0.5 * lengths[chosen][None, :]))
                    for pi, k, it in zip(p.tolist(), piece.tolist(), own.item_of[chosen[piece]].tolist(), strict=True):
                        best.setdefault((int(row[pi]), it), []).append((float(similar[pi, k]), int(start[pi])))
                out: list[tuple] = []
                for (r, it), places in best.items():
                    list_ = np.frombuffer(part.column(1)[r].as_py(), "<u4").reshape(-1, 2)
                    a = own.words[it]
                    answer, need = a[-answer_words:], share * len(a)
                    reach = int(len(a) / density) + 1  # no stretch is longer
                    places.sort(key=lambda x: x[1])
                    most, lo_at = 0, 0
                    while lo_at < len(places):
                        begin = end = places[lo_at][1]
                        while lo_at < len(places) and places[lo_at][1] <= begin + max(passage, reach // 2):
                            end = places[lo_at][1]
                            lo_at += 1
                        near = list_[(list_[:, 0] >= max(0, begin - reach)) & (list_[:, 0] < end + passage + reach)]
                        near = near[np.isin(near[:, 1], a)].astype(np.int64)
                        if np.isin(a, near[:, 1]).sum() < need:
                            continue
                        n, first, last = lcs(a, near[:, 1])
                        if n < need or n <= most:
                            continue
                        extent = int(near[last, 0]) - int(near[first, 0]) + 1
                        if not (n >= density * extent and lcs(answer, near[first : last + 1, 1])[0] >= answer_share * len(answer)):
                            n = dense(a, answer, near[:, 1], near[:, 0], need, density, answer_share * len(answer))
                        most = max(most, n)
                    if most:
                        out.append((r, it, max(c for c, _ in places), most, len(a), True))
                if out:
                    r, it, c, n, m, e = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(own.ids[list(it)]), pa.array(c, pa.float64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(e)], names=["doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_found"])

    pairs = hits.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs_words long, item_words long, answer_found boolean")
    # of two texts of one id, or two items of one id, the pair of the larger figures
    largest = F.max(F.struct("lcs_words", "item_words", "cosine", "answer_found")).alias("m")
    return holding(pairs.groupBy("doc_id", "item_id").agg(largest).select("doc_id", "item_id", "m.cosine", "m.lcs_words", "m.item_words", "m.answer_found"), shared)
