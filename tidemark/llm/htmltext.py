"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its block elements, told apart by their way down the tree (tag, class and place among equal
siblings), and its blocks of text, told apart by their element and words. Tokens of a host with the same occurrence
vector over its pages form an equivalence class; a vector is held as a sum of page hashes, so classes come from grouped
sums and no vector is gathered. Classes whose tokens stand once a page, on half of the host's pages or more, and below
tokens of such classes, nest into the host's template. Text that is a template token itself, on three pages or more, is
constant and no part of any page's main text. What the template leaves open lies in slots, each the part of a template
element outside of the template elements below it. The slot with the most varying text outside of links is the main
one; `decide` says which others belong to it.

Tags such as article and class names such as sidebar are evidence among others: they weigh a slot's text. Elements that
are no text of the page at all (scripts, forms, nav, footer, aside and hidden ones) are left out beforehand.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import forget, saved

# fixed word lists
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript noembed noframes iframe textarea title xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("nav footer aside form button template svg head menu dialog select object canvas".split())
BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3".split())
#: Words of class names that speak of text.
STORY = frozenset("abstract article body closing conclusion content end ending entry excerpt intro introduction lead lede opening paragraph standfirst story subtitle summary".split())
#: What ends a sentence, and begins a line on rights.
SENTENCE = tuple(".!?\u2026\"\u201d\u00bb\u3002\uff01\uff1f\u0964\u061f")
RIGHTS = ("©", "(c) ", "(C) ")
FLOW = frozenset("address blockquote dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody td tfoot th thead tr ul".split())
#: Kinds of tokens.
TEXT, INSIDE, BOX, PAGE = range(4)
ROLES = frozenset("navigation banner contentinfo complementary search form".split())
#: Words of class names and ids that speak of boilerplate: the last part of a name, or with neutral parts only.
STRONG = frozenset("advert adverts advertisement advertising breadcrumb breadcrumbs comments cookies disqus footer masthead menu modal nav navbar navigation newsletter overlay pager pagination popup replies sidebar sponsored subscribe toolbar topbar".split())
WEAK = frozenset("ad ads aside banner comment consent cookie copyright disclaimer discussion feedback header legal login notice notices notification promo promotion reactions recommended related reply responses search share sharing signup social sponsor thoughts widget".split())
#: Those that are subjects of articles too: in an article they say nothing, and constant text goes by the template.
SUBJECTS = frozenset("copyright disclaimer discussion header legal search social".split())
NEUTRAL = frozenset("area bar block bottom box button buttons container form global icon icons inner item items left link links list outer page post posts reader readers right section site slot text the top unit wrap wrapper".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)?+|=)*+)>""")
_LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_PART = re.compile(r"[a-z]+")
#: Tokens of which a task holds sums at a time.
HELD_TOKENS = 200_000


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(8192)
def _label(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Tag and class without digits, whether class, id or role speak of boilerplate, whether they do so in an article,
    whether they speak of text, and whether the element is hidden."""
    own: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        own.setdefault(name.lower(), "".join(values).lower())
    marked = sure = own.get("role", "") in ROLES
    story = False
    for names in (own.get("class", ""), own.get("id", "")):
        parts = [_PART.findall(n) for n in names.split()]
        flat = [p for x in parts for p in x]
        sure |= any(x and x[-1] in STRONG for x in parts)
        story |= any(p in STORY for p in flat)
        if all(p in STRONG or p in WEAK or p in NEUTRAL for p in flat):
            marked |= any(p in STRONG or p in WEAK for p in flat)
            sure |= any((p in STRONG or p in WEAK) and p not in SUBJECTS for p in flat)
    hidden = "hidden" in own or own.get("aria-hidden") == "true"
    told = tag not in ("html", "body", "main", "article")
    return tag + "." + " ".join(re.sub(r"\d+", "", own.get("class", "")).split()), (marked or sure) and told, sure and told, story, hidden


class Node:
    """An open element: its token, whether its text is left out, and what is told of the text in it."""

    __slots__ = ("tag", "token", "parent", "dropped", "marked", "main", "children", "text", "links", "prose")

    def __init__(self, tag: str, token: int, parent: Node | None, dropped: bool, marked: bool):
        self.tag, self.token, self.parent, self.dropped, self.marked = tag, token, parent, dropped, marked
        self.main = tag in ("main", "article") or parent is not None and parent.main
        self.children: dict[str, int] = {}
        self.text = self.links = self.prose = 0


@lru_cache(65536)
def _below(parent: int, label: str, place: int) -> int:
    return _key(parent, label, place)


class Page:
    """The blocks (node, text) of a page in order and all its block elements, in one pass over the html by the rules of
    HTML for tags, attributes and raw text; unclosed and crossed elements are closed as those rules imply."""

    def __init__(self, html: str):
        root = Node("", 0, None, False, False)
        self.nodes, self.blocks = [root], []
        stack, pieces = [root], []
        opened: dict[str, int] = defaultdict(int)
        quiet = 0  # open inline elements in a hidden one
        linked = links = at = 0
        tag_at, last = _TAG, html.rfind(">")

        def ended() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(entities.unescape("".join(pieces)).split())
                pieces.clear()
                node = stack[-1]
                if text and not node.dropped:
                    self.blocks.append((node, text))
                    node.text += len(text)
                    node.links += len(text) if text.startswith(RIGHTS) else min(linked, len(text))
                    node.prose += node.tag in HEADINGS or node.tag == "p" and text.endswith(SENTENCE)
            linked = 0

        def closed() -> None:
            node = stack.pop()
            opened[node.tag] -= 1
            up = node.parent
            up.text, up.links, up.prose = up.text + node.text, up.links + node.links, up.prose + node.prose

        def say(end: int) -> None:
            nonlocal linked
            if end > at and not quiet:
                pieces.append(html[at:end])
                if links:
                    linked += end - at

        scan = 0
        while True:
            begin = html.find("<", scan)
            if begin < 0 or begin > last and not html.startswith("<!--", begin):
                break
            follows = html[begin + 1 : begin + 2]
            match = None
            if follows == "!" or follows == "?" or follows == "/" and not html[begin + 2 : begin + 3].isalpha():
                say(begin)
                end = html.find("-->", begin + 2) + 3 if html.startswith("<!--", begin) else html.find(">", begin) + 1
                at = scan = end if end > 2 else len(html)
                continue
            if follows.isalpha() or follows == "/":
                match = tag_at.match(html, begin)
                if match is None and tag_at is _TAG:
                    tag_at = _LOOSE_TAG
                    match = tag_at.match(html, begin)
            if match is None:
                scan = begin + 1
                continue
            say(begin)
            at = scan = match.end()
            tag, ending = match.group(1).lower(), follows == "/"
            if tag in RAW:
                if not ending:
                    ended()
                    close = _RAW_END[tag].search(html, at)
                    at = scan = close.start() if close else len(html)
                continue
            if tag in INLINE:
                if tag == "br" and not quiet:
                    pieces.append(" ")
                elif tag == "a":
                    links = 0 if ending else 1
                if tag not in VOID:
                    if quiet:
                        quiet += -1 if ending else 1
                    elif not ending and match.group(2) and _label(tag, match.group(2))[4]:
                        quiet = 1
                continue
            ended()
            quiet = links = 0
            if ending:
                if opened[tag] > 0:
                    while stack[-1].tag != tag:
                        closed()
                    closed()
                continue
            closes = IMPLIED.get(tag, ())
            if (tag in BLOCK_ENDS_P or closes) and stack[-1].tag == "p":
                closed()
            while stack[-1].tag in closes:
                closed()
            if tag in VOID:
                continue
            parent = stack[-1]
            label, marked, sure, story, hidden = _label(tag, match.group(2)) if match.group(2) else (tag + ".", False, False, False, False)
            marked = sure if parent.main else marked or tag == "header"
            place = parent.children.get(label, 0)
            parent.children[label] = place + 1
            if tag in IMPLIED or tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                place = 0  # rows of a slot
            node = Node(tag, _below(parent.token, label, place), parent, parent.dropped or hidden or tag in DROPPED, marked)
            node.prose += story
            self.nodes.append(node)
            if not match.group(0).endswith("/>"):
                stack.append(node)
                opened[tag] += 1
        say(len(html))
        ended()
        while len(stack) > 1:
            closed()

    def tokens(self) -> dict[int, tuple]:
        """token: (parent, marked, main, times, text, links, prose, kind) of all elements that are not left out and of
        all blocks of text."""
        out: dict[int, list] = {}
        for n in self.nodes:
            if not n.dropped:
                own = out.get(n.token)
                if own is None:
                    kind = PAGE if n.tag in ("", "html", "body") else INSIDE if n.tag in FLOW else BOX
                    out[n.token] = [n.parent.token if n.parent else -1, n.marked, n.main, 1, n.text, n.links, n.prose, kind]
                else:
                    own[3] += 1
                    own[4] += n.text
                    own[5] += n.links
                    own[6] += n.prose
        for n, text in self.blocks:
            own = out.setdefault(words_token(n, text), [n.token, False, n.main, 0, 0, 0, 0, TEXT])
            own[3] += 1
            own[4] += len(text)
        return out


def words_token(node: Node, text: str) -> int:
    return _key(node.token, text)


def decide(tokens: dict[int, tuple]) -> dict[int, bool]:
    """Of each node of a template, whether the text of its slot belongs to the main text.

    tokens: parent, marked, main, pages, text, links, prose, kind. Tokens whose parents are not in the template are no
    part of it. Text tokens are constant text, which is never kept, unless they are over three quarters of all text:
    such a host has copies of a page. A slot's varying text counts less links, a tenth below boilerplate names and twice
    within article or main; the most is the main slot, ties go to the smaller token. A main slot that is a paragraph,
    list or table stands for the element that holds it. With it go the slots below it that no boilerplate name marks
    and, outside of it, unmarked slots in the same article or main or, where there is none, those of no other article
    whose varying text is half outside of links and that have headings, paragraphs of sentences or a name that speaks of text, or an
    eighth of the main slot's text a page. Lines that begin with a copyright sign count as links."""
    valid: dict[int, tuple] = {}
    marks: dict[int, bool] = {}
    below: dict[int, list[int]] = defaultdict(list)
    for t, x in tokens.items():
        below[x[0]].append(t)
    todo = below[-1][:]
    while todo:
        t = todo.pop()
        valid[t] = tokens[t]
        marks[t] = tokens[t][1] or marks.get(tokens[t][0], False)
        todo += below[t]
    texts = {t: x for t, x in tokens.items() if x[7] == TEXT}
    for t in texts:
        valid.pop(t, None)
    if not valid:
        return {}
    constant: dict[int, int] = defaultdict(int)
    for x in texts.values():
        constant[x[0]] += x[4]
    copies = sum(constant.values()) * 4 > sum(valid[t][4] for t in below[-1] if t in valid) * 3
    if copies:
        constant.clear()
    own = {t: tuple(x[k] - sum(valid[c][k] for c in below[t] if c in valid) for k in (4, 5, 6)) for t, x in valid.items()}
    varying = {t: max(0, own[t][0] - constant[t]) for t in valid}
    plain = {t: max(0, varying[t] - own[t][1]) for t in valid}
    best = max(valid, key=lambda t: (plain[t] * (0.1 if marks[t] else 1) * (2 if valid[t][2] else 1), -t))
    most = plain[best]
    rows = max(1, valid[best][3])
    while valid[best][7] == INSIDE and valid[best][0] in valid:
        best = valid[best][0]
    line, region, t = set(), None, best  # the main slot with the nodes that it is in, and the outermost article of them
    while t != -1:
        line.add(t)
        region = t if valid[t][2] else region
        t = valid[t][0]
    keep: dict[int, bool] = {t: copies for t in texts}
    state: dict[int, tuple[bool, bool]] = {-1: (False, False)}
    for t, x in valid.items():  # parents first
        bad, inside = state[x[0]]
        inside = inside and (x[7] == INSIDE or valid[x[0]][7] != PAGE) or t in (best, region)
        state[t] = bad, inside = bad or x[1] and t not in line, inside
        ample = own[t][2] > 0 or plain[t] * rows >= 0.125 * most * max(1, x[3])
        other = region is None and not x[2] and 0 < varying[t] <= plain[t] * 2 and ample
        keep[t] = not bad and (inside or other)
    return keep


def chosen(page: Page, keep: dict[int, bool]) -> list[str] | None:
    """The blocks whose innermost template node is kept, less those below a boilerplate name of their own and constant
    ones; None where they are less than half of the text that is neither below such names nor in links. A page of which
    less than a quarter would be left without constant text is a copy of others and keeps it."""
    good: dict[Node, bool] = {}
    free: dict[Node, bool] = {}
    for n in page.nodes:  # parents first
        up = n.parent
        free[n] = not n.marked and (up is None or free[up])
        good[n] = keep[n.token] if n.token in keep else up is not None and good[up] and not n.marked
    varies = [keep.get(words_token(node, text), True) for node, text in page.blocks]
    kept = [(text, v) for (node, text), v in zip(page.blocks, varies, strict=True) if good[node]]
    whole, own = sum(len(text) for text, _ in kept), sum(len(text) for text, v in kept if v)
    copy = own * 4 < whole
    told = sum(len(text) for (node, text), v in zip(page.blocks, varies, strict=True) if free[node] and node.links * 2 <= node.text and (v or copy))
    if (whole if copy else own) * 2 < told:
        return None
    return [text for text, v in kept if v or copy]


def text_of(html: str | None, keep: dict[int, bool] | None) -> str:
    """The main text by the host's template; a page that it does not cover is a template of its own."""
    page = Page(html or "")
    found = chosen(page, keep) if keep else None
    if found is None:
        alone = decide({t: x for t, x in page.tokens().items() if x[3] == 1 and x[7] != TEXT})
        found = chosen(page, alone) or []
    return "\n\n".join(found)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


def tokens(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """host, token, parent, marked, main, vector, pages, once, text, links, prose, kind: a row for each token of a host.

    vector is the sum over pages of a hash of page and times, modulo 2^40; once counts the pages that have it just
    once."""
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("parent", pa.int64()), ("marked", pa.bool_()), ("main", pa.bool_()), *[(c, pa.int64()) for c in SUMS], ("kind", pa.int8())])

    def flush(sums: dict[tuple[str, int], list]) -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        for lo in range(0, len(keys), 20_000):
            part = keys[lo : lo + 20_000]
            columns = [[k[0] for k in part], [k[1] for k in part], *([sums[k][c] for k in part] for c in range(10))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for lo in range(0, len(batch), 200):
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                    host = host_of(url)
                    h = _key(page_id, url)
                    for token, (parent, marked, main, times, text, links, prose, kind) in Page(html or "").tokens().items():
                        own = sums.get((host, token))
                        if own is None:
                            own = sums[host, token] = [parent, marked, main, 0, 0, 0, 0, 0, 0, kind]
                        own[3] = (own[3] + h * (2 * times - 1)) % (1 << 40)
                        own[4] += 1
                        own[5] += times == 1
                        own[6] += text
                        own[7] += links
                        own[8] += prose
                if len(sums) > HELD_TOKENS:
                    yield from flush(sums)
        yield from flush(sums)

    rows = pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    ddl = "host string, token long, parent long, marked boolean, main boolean, " + ", ".join(f"{c} long" for c in SUMS) + ", kind byte"
    parts = rows.mapInArrow(run, ddl).groupBy("host", "token")
    return parts.agg(F.first("parent").alias("parent"), F.first("marked").alias("marked"), F.first("main").alias("main"), F.first("kind").alias("kind"), (F.sum("vector") % F.lit(1 << 40)).alias("vector"), *[F.sum(c).alias(c) for c in SUMS[1:]])


SUMS = ["vector", "pages", "once", "text", "links", "prose"]


def templates(found: DataFrame, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """host, nodes: array of (token, keep) of the host's template, from rows of `tokens`.

    Tokens that stand once on each page that has them, in classes of equal vectors with `share` of the host's pages or
    more (text tokens on three pages or more), make the template; a host has no more of them than pages have tokens / `share`."""
    size = found.filter("token = 0").select("host", F.col("pages").alias("most"))
    valid = found.filter("once = pages").join(size, "host").filter((F.col("pages") >= F.col("most") * share) & ((F.col("kind") != TEXT) | (F.col("pages") >= least_pages)))
    classes = valid.groupBy("host", "vector", "pages").agg(F.collect_list(F.struct("token", "parent", "marked", "main", "pages", "text", "links", "prose", "kind")).alias("members"))
    rows = classes.groupBy("host").agg(F.collect_list("members").alias("classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for classes in batch.column(1).to_pylist():
                keep = decide({m["token"]: (m["parent"], m["marked"], m["main"], m["pages"], m["text"], m["links"], m["prose"], m["kind"]) for c in classes for m in c})
                nodes.append([{"token": t, "keep": k} for t, k in sorted(keep.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.list_(pa.struct([("token", pa.int64()), ("keep", pa.bool_())])))], names=["host", "nodes"])

    return rows.mapInArrow(run, "host string, nodes array<struct<token:bigint,keep:boolean>>")


def main_text(pages: DataFrame, nodes_of: dict[str, dict[int, bool]] | None) -> DataFrame:
    """page_id, url, text, n_chars of pages (id, url, html and, where nodes_of is None, nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                lists = [c.to_pylist() for c in part.columns]
                if nodes_of is None:
                    keeps = [{n["token"]: n["keep"] for n in own or ()} for own in lists[3]]
                else:
                    keeps = [nodes_of.get(host_of(u)) for u in lists[1]]
                texts = [text_of(html, keep) for html, keep in zip(lists[2], keeps, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def with_hosts(rows: DataFrame) -> DataFrame:
    """rows (id, url, html) with host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["id", "url", "html", "host"])

    return rows.mapInArrow(run, "id long, url string, html string, host string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Blocks are trimmed, white space in them is one space, character references are decoded, blocks are joined by two
    line ends. Null, empty and text-free pages give empty text; pages without a host share the empty host; repeated
    rows count as pages of their own and come back as often as they stand; ties between slots go to the one of the
    smaller token; an empty table gives no rows. Very long pages take time in proportion. Other columns are ignored,
    whatever their names. Templates of up to `broadcast_nodes` nodes (about 50 MB) are broadcast; more are joined.
    """
    told = saved(tokens(pages, id_col, url_col, html_col), "tokens")
    found = saved(templates(told), "templates")
    forget(told)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    if (found.agg(F.sum(F.size("nodes"))).first()[0] or 0) <= broadcast_nodes:
        return main_text(rows, {r.host: {n.token: n.keep for n in r.nodes} for r in found.toLocalIterator()})
    return main_text(with_hosts(rows).join(found, "host", "left").select("id", "url", "html", "nodes"), None)
