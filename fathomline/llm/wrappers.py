r"""Main text of web pages by union-free regular-expression inference.

A page becomes a stream of tags (with class) and text places.  Adjacent equal runs fold into a
repeated group `( )+`, so a page's stream is already a small expression.  Pages of one host are
aligned, two expressions at a time: a run that the other side repeats becomes a repeated group, what both have
stays, what only one has becomes an optional group `( )?`, and text places are slots.  The result is the host's
wrapper, an expression without unions that matches its pages.  Pages with equal expressions are aligned once; the
others of a host are merged in groups of about MERGED by hash, and so are their results, until one is left: no host's
pages meet in one task.

Every page is then matched with its host's wrapper (`bind`), which puts each text place into a slot: a position of the
expression, not a path, so that two lists with the same tags and classes are two slots.  Slots have figures over all
pages of the host: how many pages fill them, with how much text, whether it is always the same, and how much of it
stands in or beside links.  Slots under menus, headers, footers, sidebars, notices, adverts, forms and comments are no
content, by tag or by words of class and id.  Of the rest, an article or main part named by tag or class is the text.
Where no tag or class tells, the figures do: text that is the same on all pages is the template's, a container whose
blocks nearly all have links is a list of references, and the group that holds most of what is left is the article.
A page is read through its slots.  Only a page that fills no content slot is judged by itself; column `by_wrapper` tells.

Defined results: a null html is empty and gives an empty text; unclosed, crossed and cut-off tags are
read as browsers do in the main (a tag closes those opened within it; p, li, dt, dd, tr, td, th and
option close their like); repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import cut
from fathomline.llm.decontaminate import sized

MERGED = 32
#: Sequences of more items are aligned without their most frequent items, which are added as neighbours of the others.
QUICK_FROM = 2000
#: Items of a run that is looked for as a repetition.
LONGEST_GROUP = 12
BROADCAST_CHARS = 32_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>script|style|noscript|template|svg|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<[!?][^>]*>?|<(?P<close>/)?(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_LIKE = frozenset("p li dt dd tr td th option".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
DROPPED_TAGS = frozenset("head nav header footer aside form button select dialog menu label input option fieldset audio video canvas object".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar side aside ad ads advert adverts advertisement banner sponsor sponsored promo promotion "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "comment comments reply replies discussion disqus breadcrumb breadcrumbs pagination pager toolbar widget form toc skip".split()
)
MAIN_TAGS = frozenset({"article", "main"})
MAIN_WORDS = frozenset("article main post entry story".split())
#: Parts of an article's own class names that do not make its content something else.
HARMLESS_IN_MAIN = frozenset({"header"})

#: Pages of a host from which on a text that never changes is the template's.
TEMPLATE_FROM = 3
#: Share of a container's text in or beside links from which on it is a list of references.
REFERENCES = 0.8

Text = tuple[str, str, bool, int]  # path, text with a blank for each block edge, whether in a link, number of the block


def label(tag: str, rest: str) -> str:
    """Tag and the words of its class, id and role, as one path element."""
    words = sorted({w for m in NAMES.finditer(rest) for w in re.split(r"[^a-z]+", m[1].lower()) if w}) if rest else []
    return ".".join([tag, *words])


def read(html: str) -> tuple[list[str], list[Text]]:
    """The page's structural tokens ('#' and the path for text) and its text places in order."""
    stack: list[str] = []
    tokens: list[str] = []
    places: list[Text] = []
    edge, block = False, 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            tokens.append("/" + stack.pop())

    for m in TOKEN.finditer(html):
        if (text := m["text"]) is not None:
            blank = not text.strip()
            if not blank:
                tokens.append("#" + "/".join(stack))
            if not blank or places:
                value = unescape(text) if "&" in text else text
                block += edge
                places.append(("/".join(stack), (" " if edge else "") + value, any(s == "a" or s.startswith("a.") for s in stack), block))
                edge = False
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        edge = edge or tag in BLOCKS
        names = [s.partition(".")[0] for s in stack]
        if m["close"]:
            if tag in names:
                close(len(names) - 1 - names[::-1].index(tag))
            continue
        if tag in ENDS_PARAGRAPH and "p" in names:
            close(len(names) - 1 - names[::-1].index("p"))
        elif tag in CLOSES_LIKE and tag in names:
            at = len(names) - 1 - names[::-1].index(tag)
            if not set(names[at:]) & {"ul", "ol", "table", "dl"}:
                close(at)
        if tag not in VOID and not (m["rest"] or "").endswith("/"):
            stack.append(label(tag, m["rest"] or ""))
            tokens.append(stack[-1])
    close(0)
    return tokens, places


def fold(items: list) -> list:
    """Adjacent equal runs of items become one repeated group ["+", run]."""
    changed = True
    while changed:
        changed = False
        for size in range(1, LONGEST_GROUP + 1):
            out, k = [], 0
            while k < len(items):
                end = k + size
                if end + size > len(items) or items[k] != items[end] or items[k:end] != items[end : end + size]:
                    out.append(items[k])
                    k += 1
                    continue
                run = items[k:end]
                while items[end : end + size] == run:
                    end += size
                out.append(run[0] if size == 1 and isinstance(run[0], list) and run[0][0] == "+" else ["+", run])
                k, changed = end, True
            items = out
    return items


def _plain(item):
    while isinstance(item, list) and item[0] == "?" and len(item[1]) == 1:
        item = item[1][0]
    return item


def _key(item) -> str:
    item = _plain(item)
    return item if isinstance(item, str) else json.dumps(item)


def _optional(item) -> bool:
    return isinstance(item, list) and item[0] == "?"


def groups_of(items: list) -> list[list]:
    """The bodies of repeated groups of more than one item, longest first."""
    found = {json.dumps(body[1]): body[1] for x in items if isinstance(body := _plain(x), list) and body[0] == "+" and len(body[1]) > 1}
    return [found[k] for k in sorted(found, key=lambda k: (-len(found[k]), k))]


def repeat(items: list, groups: list[list]) -> list:
    """Items where a single run that is the body of one of the groups becomes a repeated group as well."""
    for body in groups:
        out, k, keys = [], 0, [_key(x) for x in body]
        names = [_key(x) for x in items]
        while k < len(items):
            run, end = items[k : k + len(body)], k + len(body)
            if names[k] == keys[0] and names[k:end] == keys and not any(map(_optional, run)):  # of optional items, some may be left out
                out.append(["+", body])
                k = end
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def merge(one: list, other: list) -> list:
    """An expression for what either matches: common items stay, others become optional or repeated groups."""
    if one == other:
        return one
    groups = groups_of([*one, *other])
    one, other = repeat(one, groups), repeat(other, groups)
    out: list = []
    matcher = SequenceMatcher(None, [_key(x) for x in one], [_key(x) for x in other], autojunk=max(len(one), len(other)) > QUICK_FROM)
    for how, a, b, c, d in matcher.get_opcodes():
        if how == "equal":
            out += [x if _optional(x) else y for x, y in zip(one[a:b], other[c:d], strict=True)]
            continue
        for part in (one[a:b], other[c:d]):
            out += [item if _optional(item) else ["?", [item]] for item in part]
    return out


class Wrapper:
    """An expression as an automaton: state j has read the expression up to its token j.

    Sets of states are the bits of an integer.  Single optional tokens are passed by a sum that carries through runs of
    them; longer optional groups and repetitions are jumps.
    """

    def __init__(self, text: str):
        self.tokens: list[str] = []
        self.skips = 0
        self.jumps: list[tuple[int, int]] = []
        self._add(json.loads(text))
        self.masks: dict[str, int] = defaultdict(int)
        for j, token in enumerate(self.tokens):
            self.masks[token] |= 1 << j
        self.sources, self.into = 0, defaultdict(list)
        for a, b in self.jumps:
            self.sources |= 1 << a
            self.into[b].append(a)
        self.slots = self._positions()

    def _add(self, items: list) -> None:
        for item in items:
            if isinstance(item, str):
                self.tokens.append(item)
                continue
            start = len(self.tokens)
            if item[0] == "+":  # between two places of its own, so that a repetition isn't one of its neighbour
                self.skips |= 1 << start
                self.tokens.append("")
                self._add(item[1])
                end = len(self.tokens)
                self.jumps.append((end, start + 1))
                self.skips |= 1 << end
                self.tokens.append("")
                continue
            self._add(item[1])
            end = len(self.tokens)
            if end == start + 1:
                self.skips |= 1 << start
            else:
                self.jumps.append((start, end))

    def _positions(self) -> dict[int, str]:
        """Slots by text token: its path, each element with the number of the open tag it stands for in the expression."""
        stack: list[tuple[str, int]] = []
        slots = {}
        for number, token in enumerate(self.tokens):
            if not token:
                continue
            if token[0] == "/":
                if (at := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == token[1:]), None)) is not None:
                    del stack[at:]
            elif token[0] != "#":
                stack.append((token, number))
            else:
                path, k = [], len(stack) - 1
                for element in reversed(token[1:].split("/")):
                    at = next((i for i in range(k, -1, -1) if stack[i][0] == element), None)
                    path.append(element if at is None else f"{element}.@{stack[at][1]}")
                    k = k if at is None else at - 1
                slots[number] = "/".join(reversed(path))
        return slots

    def _reach(self, states: int) -> int:
        """States and those that follow without a token."""
        before = 0
        while before != states:
            before = states
            states |= self.skips ^ (self.skips + (states & self.skips))
            if states & self.sources:
                for a, b in self.jumps:
                    if states >> a & 1:
                        states |= 1 << b
        return states

    def _came_from(self, at: int, states: int, matched: int) -> int:
        """The last token read on a way to state at: the nearest of matched, back through states without a token."""
        seen, ways = {at}, [at]
        for state in ways:
            if state and matched >> (state - 1) & 1:
                return state - 1
            more = [*([state - 1] if state and self.skips >> (state - 1) & 1 else []), *self.into[state]]
            ways += [m for m in more if states >> m & 1 and m not in seen and not seen.add(m)]
        raise AssertionError("a state that no token leads to")

    def match(self, tokens: list[str]) -> list[int] | None:
        """For each token of a page the number of the wrapper's token that it is; None if the wrapper doesn't match."""
        steps, matched = [self._reach(1)], []
        for token in tokens:
            matched.append(steps[-1] & self.masks.get(token, 0))
            if not matched[-1]:
                return None
            steps.append(self._reach(matched[-1] << 1))
        at, out = len(self.tokens), []
        if not steps[-1] >> at & 1:
            return None
        for states, last in zip(reversed(steps), reversed(matched), strict=False):
            at = self._came_from(at, states, last)
            out.append(at)
        return out[::-1]

    def bind(self, tokens: list[str]) -> list[str] | None:
        """The slot of every text of a page, or None if the wrapper doesn't match the page."""
        found = self.match(tokens)
        return None if found is None else [self.slots[j] for j, token in zip(found, tokens, strict=True) if token[0] == "#"]


def dropped(path: str) -> bool:
    """Whether a slot stands in a menu, advert, form or the like."""
    within = False
    for element in path.split("/"):
        tag, _, words = element.partition(".")
        names = set(words.split(".")) if words else set()
        bad = names & DROPPED_WORDS
        if within:
            bad -= HARMLESS_IN_MAIN
        if bad or (tag in DROPPED_TAGS and not (within and tag in HARMLESS_IN_MAIN)):
            return True
        within = within or tag in MAIN_TAGS
    return False


def main_prefix(path: str) -> str | None:
    """The path down to the first article or main part."""
    elements = path.split("/")
    for wanted in (lambda tag, words: tag == "article", lambda tag, words: tag == "main" or "main" in words, lambda tag, words: bool(words & MAIN_WORDS)):
        for k, element in enumerate(elements):
            tag, _, words = element.partition(".")
            if tag not in {"html", "body"} and wanted(tag, set(words.split("."))):
                return "/".join(elements[: k + 1])
    return None


def holder(path: str) -> str:
    """The container of a text's block: the block itself if it is a general one."""
    elements = path.split("/")
    while len(elements) > 1 and elements[-1].partition(".")[0] not in BLOCKS:
        elements.pop()
    return "/".join(elements if elements[-1].partition(".")[0] in {"div", "section", "td", "body"} else elements[:-1])


def container(slots: dict[str, int]) -> str:
    """Of the holders of slots (path to characters), the one that holds most, the deepest of equals."""
    held: dict[str, int] = defaultdict(int)
    for path, chars in slots.items():
        held[holder(path)] += chars
    return max(held, key=lambda p: (held[p], -len(p))) if held else ""


def slots_of(expression: list) -> set[str]:
    """Paths of the text slots of an expression, optional and repeated ones included."""
    found: set[str] = set()
    for item in expression:
        if isinstance(item, list):
            found |= slots_of(item[1])
        elif item.startswith("#"):
            found.add(item[1:])
    return found


def content(slots: dict[str, tuple[int, bool, int]]) -> list[str]:
    """The slots that hold the main text; slots: characters outside links, whether the text varies, and characters in or beside links, by path."""
    kept = [p for p in slots if not dropped(p)]
    mains = {p: m for p in kept if (m := main_prefix(p)) is not None}
    if articles := [p for p, m in mains.items() if m.rpartition("/")[2].partition(".")[0] == "article"]:
        return articles
    if mains:
        return list(mains)
    chars: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for p in kept:
        held = chars[holder(p)]
        held[:] = held[0] + max(slots[p][0], slots[p][2]), held[1] + slots[p][2]
    lists = {h for h, (every, linked) in chars.items() if linked and linked >= REFERENCES * every}
    telling = [p for p in kept if slots[p][1] and holder(p) not in lists] or [p for p in kept if slots[p][1]] or kept
    prefix = container({p: slots[p][0] for p in telling})
    # What never changes, and lists of references, are content only beside text that is.
    beside = {holder(p) for p in telling}
    return [p for p in kept if holder(p) in beside and (not prefix or p == prefix or p.startswith(prefix + "/"))]


def extract(html: str, wrapper: Wrapper | None, wanted: frozenset[str]) -> tuple[str, bool]:
    """The main text, and whether the host's wrapper tells it; wanted: the content slots of the wrapper."""
    tokens, places = read(html)
    slots = wrapper.bind(tokens) if wrapper is not None else None
    told = slots is not None and any(s in wanted for s in slots)
    if not told:
        own: dict[str, tuple[int, bool, int]] = {}
        for p, t, link, _ in places:
            own[p] = (own.get(p, (0, True, 0))[0] + (0 if link else len(t)), True, 0)
        slots, wanted = [p for p, t, _, _ in places if t.strip()], frozenset(content(own))
    pieces, gap, rest = [], False, iter(slots)
    for _, t, _, _ in places:
        blank = not t.strip()
        if blank or next(rest) not in wanted:
            gap = True
        else:
            pieces.append((" " if gap else "") + t)
            gap = False
    return " ".join("".join(pieces).split()), told


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def slot_figures(wrapper: Wrapper, html: str) -> Iterator[tuple[str, int, int, int]]:
    """slot, characters outside links, characters in or beside links, and digest of the text, of every slot that a page fills."""
    tokens, places = read(html)
    slots = wrapper.bind(tokens)
    if slots is None:
        return
    filled = [(t, link, block) for _, t, link, block in places if t.strip()]
    linked = {block for _, link, block in filled if link}
    found: dict[str, list] = defaultdict(lambda: [[], 0, 0])
    for slot, (text, link, block) in zip(slots, filled, strict=True):
        row = found[slot]
        row[0].append(text)
        row[1] += 0 if link else len(text)
        row[2] += len(text) if block in linked else 0
    for slot, (texts, chars, beside) in found.items():
        yield slot, chars, beside, _digest("".join(texts))


def _joined(pages: DataFrame, wrappers: DataFrame, url: str, names: dict[str, str]) -> DataFrame:
    """Pages with columns of their host's wrapper under new names; sent to the workers while it is small, and else joined by host."""
    key = f"host-{uuid.uuid4().hex}"
    told = wrappers.select(F.col("host").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
    size = wrappers.agg(F.sum(sum((F.length(c) for c in names), F.length("host")))).first()[0] or 0
    return pages.join(F.broadcast(told) if size <= BROADCAST_CHARS else told, host(pages[url]) == F.col(key), "left").drop(key)


def infer_expressions(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and wrapper (expression as JSON) of every host."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter((name, json.dumps(fold(read(page)[0]))) for name, page in zip(batch["host"], batch["html"], strict=True))
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["host", "value", "n"])

    given = pages.select(host(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    found = given.mapInPandas(parts, "host string, value string, n bigint")
    expressions = cut(found.groupBy("host", "value").agg(F.sum("n").alias("n")), "page-parts")

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "value"], ascending=[False, True])
        out = json.loads(frame["value"].iloc[0])
        for value in frame["value"].iloc[1:]:
            out = merge(out, json.loads(value))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "value": [json.dumps(out)], "n": [frame["n"].sum()]})

    while True:
        counts = cut(expressions.groupBy("host").agg(F.count(F.lit(1)).alias("of")), "hosts")
        if (counts.agg(F.max("of")).first()[0] or 1) == 1:
            break
        groups = F.ceil(F.col("of") / MERGED).alias("groups")
        dealt = expressions.join(sized(counts.select("host", groups), counts.count()), "host")
        dealt = dealt.withColumn("part", F.when(F.col("groups") > 1, F.pmod(F.xxhash64("value"), F.col("groups"))).otherwise(F.lit(0)))
        expressions = cut(dealt.groupBy("host", "part").applyInPandas(merged, "host string, value string, n bigint"), "expressions")
    return expressions.select("host", F.col("value").alias("wrapper"))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper (expression as JSON) and content (JSON list of its content slots) of every host."""
    expressions = infer_expressions(pages, url, html)

    def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, wrapper = None, None
        for batch in batches:
            rows_of: dict[tuple[str, str], list] = {}
            for (name, text), rows in batch.groupby(["host", "wrapper"]):
                if text != last:
                    last, wrapper = text, Wrapper(text)
                for page in rows["html"]:
                    for slot, chars, beside, same in slot_figures(wrapper, page):
                        row = rows_of.setdefault((name, slot), [0, 0, 0, same, same])
                        row[:] = row[0] + 1, row[1] + chars, row[2] + beside, min(row[3], same), max(row[4], same)
            yield pd.DataFrame([(*k, *v) for k, v in rows_of.items()], columns=["host", "slot", "n", "chars", "beside", "low", "high"])

    narrow = pages.select(F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    given = _joined(narrow, expressions, "url", {"wrapper": "wrapper"}).select(host(F.col("url")).alias("host"), "wrapper", "html")
    found = given.mapInPandas(figures, "host string, slot string, n bigint, chars bigint, beside bigint, low bigint, high bigint")
    sums = [F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("beside").alias("beside"), F.min("low").alias("low"), F.max("high").alias("high")]
    varies = (F.col("n") < TEMPLATE_FROM) | (F.col("low") != F.col("high"))
    row = F.struct("slot", "chars", varies.alias("varies"), "beside")
    slots = found.groupBy("host", "slot").agg(*sums).groupBy("host").agg(F.collect_list(row).alias("slots"))  # the slots of one expression

    @F.pandas_udf("string")
    def told(slots: pd.Series) -> pd.Series:
        lists = [content({r["slot"]: (r["chars"], r["varies"], r["beside"]) for r in (rows if rows is not None else [])}) for rows in slots]
        return pd.Series([json.dumps(sorted(found)) for found in lists], dtype=object)

    return expressions.join(slots, "host", "left").select("host", "wrapper", told("slots").alias("content"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text, the main text of every page, and by_wrapper; columns of these names are replaced."""
    own = uuid.uuid4().hex
    narrow = pages.select(pages[url].alias("url"), pages[html].alias("html"))
    wrappers = cut(infer_wrappers(narrow), "wrappers")

    @F.pandas_udf("text string, by_wrapper boolean")
    def main_text(htmls: pd.Series, expressions: pd.Series, contents: pd.Series) -> pd.DataFrame:
        ready = {e: Wrapper(e) for e in expressions.dropna().unique()}
        lists = {c: frozenset(json.loads(c)) for c in contents.dropna().unique()}
        told = zip(htmls, expressions, contents, strict=True)
        return pd.DataFrame([extract(h, ready.get(e), lists.get(c, frozenset())) for h, e, c in told], columns=["text", "by_wrapper"])

    joined = _joined(pages, wrappers, url, {"wrapper": f"wrapper-{own}", "content": f"content-{own}"})
    out = joined.withColumn(f"out-{own}", main_text(F.coalesce(pages[html], F.lit("")), F.col(f"wrapper-{own}"), F.col(f"content-{own}")))
    kept = [pages[c] for c in pages.columns if c not in {"text", "by_wrapper"}]
    return out.select(*kept, F.col(f"out-{own}.text").alias("text"), F.col(f"out-{own}.by_wrapper").alias("by_wrapper"))
