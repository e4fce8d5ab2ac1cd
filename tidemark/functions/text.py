"""String columns: folding, noise words, matches with offsets, word n-grams. All are SQL expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F


MARKS = "[\u0300-\u036f]"
HANGUL = ("\uac00", "\ud7a3")
#: Characters of several letters stand for a moment as private-use ones, which are no letters and so separate words anyway.
PRIVATE = ("\ue000", "\uf8ff")
LEADS, VOWELS, TAILS = ("".join(map(chr, range(lo, lo + n))) for lo, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


@cache
def decompositions() -> tuple[str, str, list[str]]:
    """Every code point with a compatibility decomposition, what one character takes its place, and what the private-use ones
    among those stand for. Hangul syllables are left to arithmetic; accents are left out."""
    ones, to, many = [], [], []
    for cp in range(0xA0, 0x30000):
        c = chr(cp)
        if HANGUL[0] <= c <= HANGUL[1] or 0x300 <= cp <= 0x36F or 0xD800 <= cp <= 0xDFFF:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if base != c:
            ones.append(c)
            to.append(base if len(base) == 1 else chr(ord(PRIVATE[0]) + len(many)))
            many += [base] * (len(base) != 1)
    return "".join(ones), "".join(to), many


def decompose(c: Column) -> Column:
    """c by compatibility decomposition (NFKD) without the accents U+0300 to U+036F; private-use characters become spaces.
    Each step is bound, so a plan holds the tables once and not once for each use."""
    ones, to, many = decompositions()
    spelled = F.split(F.lit("\n".join(many)), "\n", -1)  # a literal array
    private, syllable = "[" + "-".join(PRIVATE) + "]", "-".join(HANGUL)

    def spell(x: Column) -> Column:
        at = F.ascii(x) - ord(HANGUL[0])
        tail = at % 28
        parts = [F.substring(F.lit(LEADS), F.floor(at / 588).cast("int") + 1, F.lit(1)), F.substring(F.lit(VOWELS), F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)), F.when(tail > 0, F.substring(F.lit(TAILS), tail, F.lit(1))).otherwise("")]
        return F.when(x.between(*HANGUL), F.concat(*parts)).when(x.between(*PRIVATE), F.get(spelled, F.ascii(x) - ord(PRIVATE[0]))).otherwise(x)

    plain = bound(c, lambda x: F.when(F.rlike(x, F.lit(private)), F.regexp_replace(x, private, " ")).otherwise(x))
    whole = bound(F.translate(plain, ones, to), lambda x: F.when(F.rlike(x, F.lit(private[:-1] + syllable + "]")), F.array_join(F.transform(F.split(x, ""), spell), "")).otherwise(x))
    return F.regexp_replace(whole, MARKS, "")


# fixed values: words that say nothing about the entity, from the longest way to say them
NOISE = "ions ion nuclei nucleus particles particle beam beams projectile projectiles target targets gas absorber medium".split()
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def normalize_text(c: Column) -> Column:
    """Lower-case key without accents, of any script: characters stand in their compatibility decomposition (super- and
    subscript digits become digits, ligatures letters, Hangul syllables their parts), other runs than letters and digits
    become one space."""
    other = F.trim(F.regexp_replace(F.lower(decompose(c)), r"[^\p{L}\p{N}]+", " "))
    ascii_key = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when(F.octet_length(c) == F.char_length(c), ascii_key).otherwise(other)


def isotope_label(mass: Column, symbol: Column, electron: Column | None = None) -> Column:
    """12, C as ¹²C; empty for the electron and for mass numbers of 0 or less."""
    none = (mass <= 0) | (electron if electron is not None else F.lit(False))
    return F.when(none, "").otherwise(F.concat(F.translate(mass.cast("string"), "0123456789", SUPERSCRIPTS), symbol))


def strip_noise(c: Column, noise: list[str] | None = None) -> Column:
    """Without trailing noise words (one alone stays) and without one plural s of longer words."""
    words = "|".join(noise or NOISE)
    bare = F.regexp_replace(c, f"(?: (?:{words}))+$", "")
    plural = (F.length(bare) > 3) & bare.endswith("s") & ~bare.endswith("ss")
    return F.when(plural, F.left(bare, F.length(bare) - 1)).otherwise(bare)


def core_token(c: Column, noise: list[str] | None = None) -> Column:
    """The words other than noise, case kept."""
    return F.array_join(F.filter(F.split(c, r"[\s,]+"), lambda w: (w != "") & ~F.lower(w).isin(noise or NOISE)), " ")


def fold_name(c: Column) -> Column:
    """Upper case, A-Z and 0-9 only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def fold_unit(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def number_text(c: Column) -> Column:
    """A number in its shortest form: 7, 0.5, 1200."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(30,6)").cast("string"), r"0+$", ""), r"\.$", "")


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once; what a lambda uses is otherwise evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, kind: str, zero: Column, step, block: int = 128) -> Column:
    """array<kind>: what a left fold over an array gives on its way, in time about linear in its length.

    step(acc, x) returns the next acc and what x adds, an array<kind>. The fold goes by blocks: appending to one long array
    would copy it for every element."""
    none = F.array().cast(f"array<{kind}>")
    blocks = bound(items, lambda every: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(every) - 1) / block), F.lit(0)).cast("int")), lambda b: F.slice(every, b * block + 1, F.lit(block))))

    def inner(s: Column, x: Column) -> Column:
        acc, more = step(s["acc"], x)
        return F.struct(acc.alias("acc"), F.concat(s["out"], more.cast(f"array<{kind}>")).alias("out"))

    start = F.array(F.struct(zero.alias("acc"), none.alias("out")))
    folded = F.aggregate(blocks, start, lambda s, blk: F.array_append(s, F.aggregate(blk, F.struct(F.element_at(s, -1)["acc"].alias("acc"), none.alias("out")), inner)))
    return F.flatten(F.transform(folded, lambda s: s["out"]))


#: Characters that mark matches and their groups; Unicode keeps them out of texts.
MARK, PART = "\ufdd0", "\ufdd1"


def match_spans(text: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """array<struct<text,start,end,groups>> of all matches in reading order; offsets in characters, ends exclusive.

    The pattern must not match the empty string. Groups without a match are empty strings. One pass of the pattern marks
    matches and groups, so it runs once over a text, whatever the groups; time is about linear in text and matches. The
    noncharacters U+FDD0 and U+FDD1 come back as U+FFFD."""
    kind = "struct<text:string,start:int,end:int,groups:array<string>>"
    record = MARK + "$0" + "".join(f"{PART}${g}" for g in groups) + MARK
    clean = F.when(F.rlike(text, F.lit(f"[{MARK}{PART}]")), F.translate(text, MARK + PART, "\ufffd\ufffd")).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(record)), MARK, -1)  # gap, match, gap, match, ..., gap

    def rows(p: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(p) - 3, F.lit(2))
        return F.when(F.size(p) > 2, F.transform(places, lambda i: F.struct(F.length(F.get(p, i)).alias("gap"), F.split(F.get(p, i + 1), PART, -1).alias("m"))))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = (at + x["gap"]).cast("int")
        whole = F.get(x["m"], F.lit(0))
        end = (start + F.length(whole)).cast("int")
        return end, F.array(F.struct(whole.alias("text"), start.alias("start"), end.alias("end"), F.slice(x["m"], F.lit(2), F.lit(max(len(groups), 1))).alias("groups")))

    found = running(bound(pieces, rows), kind, F.lit(0), step)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{kind}>"))


WORD = r"\p{L}[\p{L}0-9-]*"


def token_ngrams(text: Column, tokens: Column, most: int = 3) -> Column:
    """array<struct<n,phrase,start,end>> of all windows of 1 to `most` of the tokens of match_spans(text, WORD); the phrase
    is the text's own slice, put together from tokens and the gaps between them."""
    kind = "array<struct<n:int,phrase:string,start:int,end:int>>"

    def windows(b: Column, n: int) -> Column:
        def one(x: Column) -> Column:
            parts = [x["t0"]["text"]]
            for k in range(1, n):
                parts += [x[f"s{k}"], x[f"t{k}"]["text"]]
            return F.struct(F.lit(n).alias("n"), F.concat(*parts).alias("phrase"), x["t0"]["start"].alias("start"), x[f"t{n - 1}"]["end"].alias("end"))

        many = F.greatest(F.size(b["tokens"]) - (n - 1), F.lit(0))
        own = lambda name, k: F.slice(b[name], F.lit(k + 1), many)
        zipped = F.arrays_zip(*[own("tokens", k).alias(f"t{k}") for k in range(n)], *[own("gaps", k).alias(f"s{k}") for k in range(1, n)])
        return F.transform(zipped, one).cast(kind)

    both = F.struct(tokens.alias("tokens"), F.split(text, WORD, -1).alias("gaps"))
    return bound(both, lambda b: F.flatten(F.array(*[windows(b, n) for n in range(1, most + 1)])))


def overlaps(span: Column, claimed: Column) -> Column:
    """span meets one of the claimed spans (half-open)."""
    return F.exists(claimed, lambda c: (span["start"] < c["end"]) & (c["start"] < span["end"]))


def bounds(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
