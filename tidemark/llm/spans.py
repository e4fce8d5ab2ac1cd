"""Spans of regular-expression matches as SQL columns: code-point offsets, no Python on the executors, time about linear in
text and matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions.text import bound, running

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: A span with its text, the characters before it and the one after it.
TOLD = "struct<start:int,rank:int,end:int,kind:string,text:string,before:string,after:string>"
CONTEXT = 24


@dataclass(frozen=True)
class Rule:
    """A kind of span: leftmost non-overlapping matches of `pattern`; those that fail `keep` are dropped.

    `keep` gets the match and, where `group` is over 0, that group of it."""

    kind: str
    pattern: str
    group: int = 0
    keep: object = None


def told_matches(text: Column, rule: Rule, rank: int) -> Column:
    """array<TOLD> of the rule's spans in the text in reading order; empty where there are none. before are up to
    CONTEXT characters since the match before.

    The gaps between matches are what a split by the same pattern leaves, so starts are running sums of lengths."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    both = F.struct(whole.alias("m"), part.alias("g"), F.split(text, rule.pattern, -1).alias("gaps"))
    zipped = bound(both, lambda b: F.arrays_zip(b["m"].alias("m"), b["g"].alias("g"), F.slice(b["gaps"], F.lit(1), F.size(b["m"])).alias("gap"), F.slice(b["gaps"], F.lit(2), F.size(b["m"])).alias("next")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = (at + F.length(x["gap"])).cast("int")
        end = (begin + F.length(x["m"])).cast("int")
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), x["m"].alias("text"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"))
        own = F.array(span).cast(f"array<{TOLD}>")
        return end, F.when(rule.keep(x["m"], x["g"]), own).otherwise(F.array().cast(f"array<{TOLD}>")) if rule.keep else own

    return F.when(F.rlike(text, F.lit(rule.pattern)), running(zipped, TOLD, F.lit(0), step)).otherwise(F.array().cast(f"array<{TOLD}>"))


def bare(spans: Column) -> Column:
    """The spans without what they say."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(SPAN)


def all_matches(text: Column, rules: list[Rule]) -> Column:
    """The spans of all rules by start, then in the order of the rules."""
    return F.array_sort(F.flatten(F.array(*[bare(told_matches(text, rule, k)) for k, rule in enumerate(rules)])))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def masked(text: Column, spans: Column, block: int = 128) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first by start names them all.

    The text is cut into pieces of `block` spans first, so that no span is looked up from the text's beginning."""
    kind = "struct<since:int,start:int,kind:string,till:int>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        till = F.greatest(at, s["end"])
        own = F.array(F.struct(at.alias("since"), s["start"].alias("start"), s["kind"].alias("kind"), till.alias("till")))
        return till, F.when(s["start"] >= at, own).otherwise(F.array().cast(f"array<{kind}>"))

    def rendered(b: Column) -> Column:
        first, last = F.get(b, F.lit(0))["since"], F.element_at(b, -1)["start"]
        piece = F.struct(b.alias("b"), first.alias("from"), F.substring(text, first + 1, last - first).alias("text"))
        return bound(piece, lambda p: F.array_join(F.transform(p["b"], lambda s: F.concat(F.substring(p["text"], s["since"] - p["from"] + 1, s["start"] - s["since"]), F.lit("["), s["kind"], F.lit("]"))), ""))

    def whole(pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / block).cast("int")), lambda k: rendered(F.slice(pieces, k * block + 1, F.lit(block))))
        return F.array_join(blocks, "")

    out = bound(running(spans, kind, F.lit(0), step), whole)
    return F.when(F.size(spans) > 0, F.concat(out, F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))).otherwise(text)
