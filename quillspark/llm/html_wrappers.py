"""HTML extraction by union-free regular expressions (wrappers) inferred per host.

A page becomes a stream of block tags and text slots; a group of tokens that follows itself becomes
a repeated group. Streams of one host are aligned one after the other with the wrapper so far:
tokens that only one of them has become optional, slots whose texts differ become variable. Slots
are then judged once, in the wrapper. Menus, forms, adverts, comments and the like go by their elements and by
what their classes, ids and roles say (NAMED). Where those only hint at it (HINTED), and on hosts without an article element, the
wrapper decides: blocks of links and blocks that say the same on all pages are the host's, and the
article is the innermost block that holds most of what varies. A page's text is what its slots aligned with the
kept slots hold. Nothing depends on how many pages a host has, but for one: a host's only page shows no differences,
so all of it counts as varying.

Equal streams of a host are combined where they are read; the rest are aligned in groups of about
FAN wrappers, level by level, so no host is in one task. Wrappers are broadcast if they take
BROADCAST_BYTES at most; else pages are joined with them by host.

Defined cases: a null or empty page, or one without text, has the empty text; a null url has the
empty host; broken markup (unclosed tags, quotes or comments) is read to the end; a very long page is read whole; of blocks
that tie for the article the first is taken; repeated rows are extracted alike; an empty table gives an empty result;
columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize
from quillspark.llm.url_filter import with_host_path

FAN, BROADCAST_BYTES = 16, 32 << 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s>/]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s>/]*+)([^>]*+)>?"
    r"|<[!?][^>]*+>?"
    r"|([^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr input link meta param source track".split())
#: Elements whose end may be left out; they are tokens but never hold others open.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option colgroup h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold the whole article, whatever their class says.
WHOLE = frozenset("html body main article".split())
ASIDE = frozenset("head title nav footer aside form button dialog menu fieldset".split())
#: Words of classes, ids and roles of the kinds of blocks that are never the article's.
NAMED = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav|navigation|navbar|menu|sidebar|footer|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|login|signin|signup|pagination|pager|toolbar|contentinfo|complementary|dialog)(?:[^a-z]|$)",
    re.I,
)
#: Words that an article's own blocks may have as well; the wrapper decides.
HINTED = re.compile(r"(?:^|[^a-z])(banner|side|rail|foot|alert|overlay|social|share|sharing|related|recommend\w*|respond|widget|search)(?:[^a-z]|$)", re.I)
HEADINGS = frozenset(f"<h{k}" for k in range(1, 7))


class Page:
    """The token stream of a page: symbols, and per slot its text and the characters of it in links."""

    def __init__(self, source: str):
        self.symbols: list[str] = []
        self.texts: list[str] = []
        self.links: list[int] = []
        buffer: list[str] = []
        linked = in_link = 0
        opened: dict[str, list[bool]] = {}  # inline elements by name: whether they are hidden and so symbols

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                self.symbols.append("#")
                self.texts.append(text)
                self.links.append(linked)
            linked = 0

        for m in TOKEN.finditer(source):
            text = m[8]
            if text is not None:
                text = html.unescape(text)
                buffer.append(text)
                if in_link:
                    linked += len(text.strip())
                continue
            name = (m[3] or m[6] or "").lower()
            if not name:
                if m[1]:  # a script or the like ends no word's block, but holds no text
                    buffer.append(" " if m[1].lower() in ("textarea", "select", "iframe", "object") else "")
                continue
            end = bool(m[2] if m[3] else m[5])
            attributes = (m[4] if m[3] else m[7]) or ""
            marks = "" if end or not attributes else marked(attributes, name in INLINE)
            if name in WHOLE and marks != "*":
                marks = ""
            if name in INLINE:
                if name == "a":
                    in_link = 0 if end else 1
                own = opened.setdefault(name, [])
                if not end and name not in VOID:
                    own.append(bool(marks))
                if not (own.pop() if end and own else marks):
                    continue
            if name == "br" or name in VOID:
                buffer.append(" ")
                continue
            flush()
            self.symbols.append(f"</{name}" if end else f"<{name}{marks}")
        flush()


def marked(attributes: str, inline: bool = False) -> str:
    """!: hidden, or a block named as something else than the article; ? and a word: perhaps; *: role=main.
    Inline elements are part of a block, whatever they are called."""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            return "!"
        if inline:
            continue
        if name == "aria-hidden" and value.lower() == "true":
            return "!"
        if name == "role" and value.lower() == "main":
            return "*"
        if name in ("class", "id", "role"):
            if NAMED.search(value):
                return "!"
            if HINTED.search(value):
                found = "?" + HINTED.search(value)[1].lower()
    return found


def parts(symbol: str) -> tuple[str, str]:
    """The name of a start tag's symbol, and its mark."""
    name = re.split("[!?*]", symbol[1:])[0]
    return name, symbol[len(name) + 1 : len(name) + 2]


def step(symbol: str) -> int:
    """How many elements a symbol opens, as far as they must be closed."""
    if symbol[0] != "<":
        return 0
    if symbol[1] == "/":
        return 0 if symbol[2:] in LOOSE else -1
    name, mark = parts(symbol)
    return 0 if name in LOOSE and not mark else 1


def whole(group: list[str]) -> bool:
    """The group closes what it opens, and nothing else."""
    depth = 0
    for s in group:
        depth += step(s)
        if depth < 0:
            return False
    return depth == 0


def folded(symbols: list[str]) -> tuple[list[str], list[bool], list[list[int]]]:
    """The stream with repeated groups, of any length, once: symbols, whether repeated, and the slots of each symbol."""
    out: list[str] = []
    again: list[bool] = []
    slots: list[list[int]] = []
    places: dict[str, list[int]] = {}  # of every symbol in out
    n = 0
    for s in symbols:
        out.append(s)
        again.append(False)
        slots.append([n] if s == "#" else [])
        n += s == "#"
        own = places.setdefault(s, [])
        own.append(len(out) - 1)
        k = len(own) - 2
        while k >= 0:
            size = len(out) - 1 - own[k]
            if 2 * size > len(out):
                break
            if out[-size] == out[-2 * size] and out[-1 - size // 2] == out[-1 - size - size // 2] and out[-size:] == out[-2 * size : -size] and whole(out[-size:]):
                for j in range(1, size + 1):
                    slots[-j - size] += slots[-j]
                    again[-j - size] = True
                    places[out[-j]].pop()
                del out[-size:], again[-size:], slots[-size:]
                k = len(own) - 2  # what is left may repeat what stands before it
            else:
                k -= 1
    return out, again, slots


# A wrapper is a list of [symbol, repeated, optional, pages, characters, characters in links, text].
# text: a hash while all pages agree, then 0.


def wrapper_of(page: Page) -> list[list]:
    symbols, again, slots = folded(page.symbols)
    out = []
    for s, r, own in zip(symbols, again, slots):
        chars, links, same = sum(len(page.texts[i]) for i in own), sum(page.links[i] for i in own), 0
        if own:
            same = xxhash.xxh64_intdigest("\n".join(page.texts[i] for i in own)) >> 1 or 1
        out.append([s, int(r), 0, 1, chars, links, same])
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of what both wrappers describe."""
    left, right = [x[0] for x in a], [x[0] for x in b]
    steps = [("equal", 0, len(a), 0, len(b))] if left == right else SequenceMatcher(None, left, right, autojunk=False).get_opcodes()
    out = []
    for step, i, j, k, m in steps:
        if step == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                out.append([x[0], x[1] | y[1], x[2] | y[2], x[3] + y[3], x[4] + y[4], x[5] + y[5], x[6] if x[6] == y[6] else 0])
        else:
            out += [[*x[:2], 1, *x[3:]] for x in a[i:j] + b[k:m]]
    return out


def rendered(wrapper: list[list]) -> str:
    """The wrapper as an expression: ( )+ around repeated groups, ( )? around optional ones."""
    parts = []
    for (optional, again), run in groupby(wrapper, key=lambda x: (x[2], x[1])):
        body = " ".join(re.split("[!?*]", x[0])[0] + ("" if x[0] == "#" and not x[6] else "=" if x[0] == "#" else ">") for x in run)
        parts.append(f"( {body} )" + "+" * again + "?" * optional if again or optional else body)
    return " ".join(parts)


class Blocks:
    """The elements of a wrapper in order of their start, 0 being the page; a block's parts follow it."""

    def __init__(self, wrapper: list[list]):
        self.parent, self.aside, self.article, self.hinted = [0], [False], [False], [False]
        self.owner: list[int] = []  # per symbol, the block that it stands in
        self.heading: list[bool] = []
        names, at, heading = [""], 0, False
        for x in wrapper:
            s = x[0]
            self.owner.append(at)
            self.heading.append(heading)
            if s == "#":
                continue
            if s[1] == "/":
                heading, up = False, at
                while up and names[up] != s[2:]:
                    up = self.parent[up]
                at = self.parent[up] if up else at
                continue
            name, mark = parts(s)
            heading = s[:3] in HEADINGS
            if name not in LOOSE or mark:
                names.append(name)
                self.parent.append(at)
                self.aside.append(self.aside[at] or mark == "!" or name in ASIDE or name == "header" and not self.article[at])
                self.article.append(self.article[at] or name in ("article", "main") or mark == "*")
                self.hinted.append(mark == "?")
                at = len(names) - 1
        last = list(range(len(names)))
        for b in range(len(names) - 1, 0, -1):
            last[self.parent[b]] = max(last[self.parent[b]], last[b])
        self.end = [b + 1 for b in last]  # the first block that is no part of it

    def sums(self, amounts: list[int]) -> list[int]:
        """Per block, of the amounts of the symbols in it and its parts."""
        out = [0] * len(self.parent)
        for b, n in zip(self.owner, amounts):
            out[b] += n
        for b in range(len(out) - 1, 0, -1):
            out[self.parent[b]] += out[b]
        return out


def kept(wrapper: list[list]) -> list[bool]:
    """Per symbol: a slot that belongs to the article."""
    blocks = Blocks(wrapper)
    slot = [x[0] == "#" for x in wrapper]
    # The host's own words: the same on all pages, where something else differs.
    differs = any(s and not x[6] for s, x in zip(slot, wrapper))
    same = [bool(s and differs and x[6] and not x[2]) for s, x in zip(slot, wrapper)]
    chars, links = blocks.sums([x[4] for x in wrapper]), blocks.sums([x[5] for x in wrapper])
    varying = blocks.sums([0 if c else x[4] for c, x in zip(same, wrapper)])
    aside = blocks.aside
    for b in range(1, len(aside)):
        off = blocks.hinted[b] and (not blocks.article[b] or 2 * links[b] >= chars[b] or not varying[b])
        aside[b] = aside[b] or aside[blocks.parent[b]] or off
    plain = [s and not aside[b] for s, b in zip(slot, blocks.owner)]
    article = [p and blocks.article[b] for p, b in zip(plain, blocks.owner)]
    if any(article):
        return article
    # No article element: the innermost block that holds over three quarters of what varies and isn't links.
    linked = [2 * x[5] > x[4] for x in wrapper]
    mine = blocks.sums([x[4] if p and not c and not f else 0 for x, p, c, f in zip(wrapper, plain, same, linked)])
    if not mine[0]:
        return plain
    at = max(b for b in range(len(mine)) if 4 * mine[b] > 3 * mine[0])  # such blocks are nested
    own = [p and at <= b < blocks.end[at] and not f and (h or not c) for p, b, c, f, h in zip(plain, blocks.owner, same, linked, blocks.heading)]
    first = own.index(True)
    # A title may stand above that block.
    return [o or k < first and p and h and not c and not f for k, (o, p, c, f, h) in enumerate(zip(own, plain, same, linked, blocks.heading))]


def extracted(page: Page, known: tuple[list[str], list[bool]] | None) -> str:
    """The page's text; known: the symbols of its host's wrapper, and which of them are kept."""
    symbols, _, slots = folded(page.symbols)

    def text(flags: list[bool]) -> str:
        chosen = sorted(i for own, f in zip(slots, flags) if f for i in own)
        return " ".join(page.texts[i] for i in chosen)

    if known and known[0] == symbols:
        found = text(known[1])
        if found:
            return found
    flags = own = kept(wrapper_of(page))
    if known and known[0] != symbols:
        flags = list(own)
        for i, j, n in SequenceMatcher(None, known[0], symbols, autojunk=False).get_matching_blocks():
            flags[j : j + n] = known[1][i : i + n]
    return text(flags) or text(own)


WRAPPERS = "host string, wrapper string"


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON): one row per host of pages(url, html)."""

    def streams(batches):
        for b in batches:
            found: dict[tuple[str, str], list[list]] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1)):
                w = wrapper_of(Page(source.as_py() or ""))
                key = (host, " ".join(x[0] for x in w))
                found[key] = aligned(found[key], w) if key in found else w
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], names=["host", "wrapper"])

    def rows(batches) -> Iterator[tuple[str, int, str]]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def groups(batches):
        for key, run in groupby(rows(batches), key=lambda r: r[:2]):
            out = None
            for _, _, w in run:
                out = aligned(out, json.loads(w)) if out else json.loads(w)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([json.dumps(out)], pa.string())], names=["host", "wrapper"])

    level = materialize(with_host_path(pages.select("url", "html")).select("host", "html").mapInArrow(streams, WRAPPERS), "streams")
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0]
        if most is None or most == 1:
            return level
        # The largest hosts are dealt out by a hash; a group has about FAN wrappers.
        dealt = level.join(sizes, "host").select("host", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN)).cast("int").alias("part"), "wrapper")
        dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper")
        level = materialize(dealt.mapInArrow(groups, WRAPPERS), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    wrappers = infer(pages)
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    rows = with_host_path(pages.select("page_id", "url", "html")).select("page_id", "url", "html", "host")
    shared = None
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
    else:
        rows = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "wrapper")
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        read: dict[str, tuple[list[str], list[bool]]] = {}
        for b in batches:
            texts = []
            for k, (source, host) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                known = shared.value.get(host) if shared else b.column(4)[k].as_py()
                if known is not None and known not in read:
                    if len(read) > 1000:
                        read.clear()
                    wrapper = json.loads(known)
                    read[known] = [x[0] for x in wrapper], kept(wrapper)
                texts.append(extracted(Page(source.as_py() or ""), read.get(known)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
