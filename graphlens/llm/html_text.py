"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text that lies in them. Each page votes for the generalised path (tags and
alphabetic class words, from the body down) of its best container; votes are summed up by host, and the paths with a
tenth of a host's votes or more win there, ten at most. Each page is then read again: its text is that of the containers
on the first winning path that it has, or of its own best container where it has none.

Left out within a container: menus, headers (but the headings of an article's header), footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments and hidden elements, told by tag, role, class and id.

Defined results: a null or empty page has an empty text; a page without a host (or a null url) is read by its own best
container; repeated rows vote and are returned each; columns besides ``page_id``, ``url`` and ``html`` are ignored;
an empty table gives no rows. A tag that never ends is text up to its next ``>``. ``br`` and cell borders are white space.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, staged

#: Part of a host's votes that a winning path has.
SHARE = 0.1
#: Hosts whose winning paths are broadcast (ten paths of at most 600 characters each); more are joined by shuffling.
HOSTS = 10_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp svg math template select object audio video canvas".split())
_CONTAINERS = {"article": 3.0, "main": 2.0, "section": 1.0, "div": 1.0, "td": 0.8, "center": 0.8, "body": 0.5}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table caption tbody thead tfoot tr ul".split()
) | _HEADINGS
_CELLS = frozenset(["td", "th"])
#: What a start tag closes, and where the search for it ends.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (_CELLS, frozenset(["tr", "table"])),
    "th": (_CELLS, frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SCOPE = frozenset(["td", "th", "table", "caption", "button", "body", "html"])
_P, _A, _TABLE, _IN_TABLES = frozenset(["p"]), frozenset(["a"]), frozenset(["table"]), frozenset("table caption thead tbody tfoot tr td th".split())

_NOISE_TAGS = frozenset("nav menu footer aside form button dialog search fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of classes and ids: of what is never part of an article, and of what is none unless an article lies in it.
_NOISE_WORDS = frozenset(
    "sidebar sidebars aside comment comments commentlist commentform disqus respond reply replies related recommended recommendations breadcrumb breadcrumbs crumbs menu menus submenu nav navbar "
    "navigation footer masthead topbar bottombar pagination pager share sharing sharebar cookie cookies consent gdpr newsletter subscribe subscription signup login ad ads advert adverts advertisement "
    "advertisements advertising advertorial adsense adslot adunit adsbygoogle taboola outbrain sponsor sponsored toc".split()
)
#: Elements whose ids are names within an article (often made from its headings) and tell nothing of what they are.
_NAMED = _HEADINGS | frozenset("article p li a span".split())
_NOISE_ENDINGS = ("nav", "menu", "sidebar", "comments", "advert")
_WRAPPER_WORDS = frozenset("promo promos promotion banner notice notices alert alerts widget widgets social popup modal overlay toolbar hidden teaser teasers".split())
_NEGATED = frozenset("no has with without non".split())
_GOOD_WORDS = frozenset("article post content entry story body text main blog page".split())
_ARTICLE_WORDS = frozenset("article post content entry story".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: A tag with its attributes (groups 1 to 3), or the beginning of a comment, a declaration or a tag that doesn't end.
_NEXT = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_LOOSE = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_TELLING = re.compile(r"(?<![\w-])(?:class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


def _class_words(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


def _general(names: str) -> str:
    """Class names without what varies from page to page: words with digits."""
    kept = [re.sub(r"[\W_]*[A-Za-z]*\d[A-Za-z\d]*", "", x).lower() for x in names.split()]
    return "".join("." + x for x in sorted(set(kept)) if x)


def _own_noise(tag: str, told: dict[str, str]) -> int:
    """0: none; 1: noise; 2: noise unless an article lies in it; 3: a header."""
    if tag in ("html", "body", "main"):
        return 0
    if tag in _NOISE_TAGS or told.get("role", "").lower() in _NOISE_ROLES or "hidden" in told or told.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(told.get("style", "")):
        return 2 if tag == "form" else 1
    words = _class_words(told.get("class", "") if tag in _NAMED else f"{told.get('class', '')} {told.get('id', '')}")
    real = [w for k, w in enumerate(words) if not (k and words[k - 1] in _NEGATED)]
    if any(w in _NOISE_WORDS or w.endswith(_NOISE_ENDINGS) for w in real):
        return 1
    if tag in ("header", "hgroup") or "header" in real:
        return 3
    return 2 if any(w in _WRAPPER_WORDS for w in real) else 0


@lru_cache(maxsize=10_000)
def _told(tag: str, attributes: str) -> tuple[int, str, float, bool]:
    """Of a start tag: its kind of noise, its part of a path ("" if it is no container), the factor of its score, and whether it is an article by tag or name."""
    told: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        told.setdefault(name.lower(), html.unescape("".join(values)))
    path, factor, article = "", _CONTAINERS.get(tag, 0.0), tag in ("article", "main")
    if factor:
        words = _class_words(f"{told.get('class', '')} {told.get('id', '')}")
        article = article or any(w in _ARTICLE_WORDS for w in words)
        path = f"{tag}{_general(told.get('class', ''))[:150]}"
        if told.get("itemprop", "").lower() == "articlebody":
            factor *= 3
        elif any(w in _GOOD_WORDS for w in words):
            factor *= 1.5
    return _own_noise(tag, told), path, factor, article


@lru_cache(maxsize=10_000)
def _ending(tag: str) -> tuple[frozenset, frozenset]:
    """What an end tag closes, and where the search for it ends."""
    own = frozenset([tag])
    return own, (_TABLE - own if tag in _IN_TABLES else _SCOPE if tag in _BLOCKS else _BLOCKS | _CELLS)


class Page:
    """Elements of a page in order of their start tags, and its pieces of text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.ends = ["html"], [-1], [0]
        self.own, self.paths, self.factors, self.articles = [0], ["html"], [0.4], [False]
        self.pieces: list[tuple[int, str | None, bool]] = []  # element, text (None: a border), within a link
        self.stack, self.open = [0], defaultdict(int, html=1)
        self._read(source)
        while self.stack:
            self._pop()
        self._settle()

    def _pop(self) -> None:
        at = self.stack.pop()
        tag = self.tags[at]
        self.ends[at] = len(self.tags)
        self.open[tag] -= 1
        if tag in _BLOCKS:
            self.pieces.append((at, None, False))

    def _close(self, names: frozenset, scope: frozenset) -> None:
        """Closes the nearest open element of ``names``, if none of ``scope`` lies between."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[k]]
            if tag in names:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in scope:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "html" or tag == "body" and self.open["body"]:
            return
        block = tag in _BLOCKS
        if tag == "br" or tag in _CELLS:
            self.pieces.append((self.stack[-1], " ", False))
        if block:
            if self.open["p"]:
                self._close(_P, _SCOPE)
            if tag in _HEADINGS and self.tags[self.stack[-1]] in _HEADINGS:
                self._pop()
        if tag in _CLOSES:
            names, scope = _CLOSES[tag]
            if any(self.open[x] for x in names):
                self._close(names, scope)
        if tag == "a":
            if "href" not in attributes.lower():  # a place, no link
                return
            if self.open["a"]:
                self._close(_A, _BLOCKS)
        parent, at = self.stack[-1], len(self.tags)
        if block:
            self.pieces.append((at, None, False))
        if tag in _VOID:
            return
        own, part, factor, article = _told(tag, attributes if attributes and _TELLING.search(attributes) else "")
        path = self.paths[parent]
        if part:
            if len(path) > 400:
                path = hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            path = f"{path}>{part}"
        self.tags.append(tag)
        self.parents.append(parent)
        self.ends.append(0)
        self.own.append(own)
        self.paths.append(path)
        self.factors.append(factor)
        self.articles.append(article)
        self.stack.append(at)
        self.open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append((self.stack[-1], " ", False))
        elif self.open[tag] and tag != "body" and tag != "html":
            if self.tags[self.stack[-1]] == tag:
                self._pop()
            else:
                self._close(*_ending(tag))

    def _read(self, source: str) -> None:
        at, n, search = 0, len(source), _NEXT.search
        while at < n:
            found = search(source, at)
            if not found:
                self._text(source[at:])
                return
            start = found.start()
            if start > at:
                self._text(source[at:start])
            name = found[2]
            if name:
                at, name = found.end(), name.lower()
                if found[1]:
                    self._end(name)
                elif name in _RAW:
                    end = _ENDS[name].search(source, at)
                    at = n if end is None else source.find(">", end.start()) + 1 or n
                else:
                    self._start(name, found[3])
                continue
            at, mark = start, found.group()
            if mark == "<!--":
                if source.startswith((">", "->"), at + 4):
                    at = source.index(">", at) + 1
                    continue
                end = source.find("-->", at + 4)
                at = n if end < 0 else end + 3
            elif mark == "<![CDATA[":
                end = source.find("]]>", at)
                self._text(source[at + 9 : n if end < 0 else end], plain=True)
                at = n if end < 0 else end + 3
            elif mark in ("<!", "<?"):
                end = source.find(">", at)
                at = n if end < 0 else end + 1
            elif search == _NEXT.search:  # a quote that never ends: from here on tags end at their first >
                search = _LOOSE.search
            else:
                self._text(source[at:])
                return

    def _text(self, raw: str, plain: bool = False) -> None:
        self.pieces.append((self.stack[-1], raw if plain or "&" not in raw else html.unescape(raw), self.open["a"] > 0))

    def _settle(self) -> None:
        """Noise of each element, its nearest container, and the containers' scores."""
        n = len(self.tags)
        marks = [k for k in range(n) if self.tags[k] in ("article", "main", "h1")]
        bodies = [k for k in marks if self.tags[k] != "h1"]
        holds = lambda places, k: (first := bisect_left(places, k)) < len(places) and places[first] < self.ends[k]
        self.noise, self.holder = [False] * n, [0] * n
        article = [False] * n
        header = [False] * n
        for k in range(n):
            up, own = self.parents[k], self.own[k]
            if up >= 0:
                self.noise[k], article[k], header[k] = self.noise[up], article[up], header[up]
            self.holder[k] = k if self.factors[k] else (self.holder[up] if up >= 0 else 0)
            if header[k] and self.tags[k] in _HEADINGS:
                self.noise[k] = header[k] = False
            if own == 1:
                self.noise[k], header[k] = True, False
            elif own == 2 and not holds(marks, k):
                self.noise[k], header[k] = True, False
            elif own == 3 and not self.noise[k] and not holds(bodies, k):
                self.noise[k], header[k] = True, article[k]
            article[k] = article[k] or self.articles[k]
        self.scores = [0.0] * n
        for k, text, link in self.pieces:
            if text is None or self.noise[k]:
                continue
            size = len(text) - text.count(" ")
            size = -size if link else size
            if size:
                self.scores[self.holder[k]] += size
        for k in range(n - 1, 0, -1):  # children come after their parents
            up = self.holder[self.parents[k]]
            if self.factors[k] and up != k:
                self.scores[up] += 0.7 * max(self.scores[k], 0.0)
        self.scores = [s * f for s, f in zip(self.scores, self.factors)]

    def best(self) -> int:
        """The container with the greatest score, the first of equal ones; -1 if none has any."""
        at = max(range(len(self.scores)), key=self.scores.__getitem__)
        return at if self.scores[at] > 0 else -1

    def text(self, containers: list[int]) -> str:
        """The blocks of the containers, which are in page order, without noise."""
        lines, line = [], []
        inside = [(a, self.ends[a]) for a in containers]
        at = 0
        for k, text, _ in self.pieces:
            while at < len(inside) and k >= inside[at][1]:
                at += 1
            if at == len(inside):
                break
            if k < inside[at][0]:
                continue
            if text is None:
                lines.append("".join(line))
                line = []
            elif not self.noise[k]:
                line.append(text)
        lines.append("".join(line))
        return "\n".join(x for x in (" ".join(x.split()) for x in lines) if x)

    def extract(self, winners: list[str]) -> str:
        own = self.best()
        if own < 0:
            return ""
        for path in winners:
            found = [k for k, p in enumerate(self.paths) if p == path and self.factors[k] and not self.noise[k]]
            outer, end = [], 0
            for k in found:
                if k >= end:
                    outer.append(k)
                    end = self.ends[k]
            text = self.text(outer)
            if text:
                return text
        return self.text([own])


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n: for how many of the host's pages the path leads to the best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source)
                own = page.best()
                if own >= 0:
                    found[host, page.paths[own]] += 1
            hosts, paths = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(found.values(), pa.int64())], ["host", "path", "n"])

    rows = pages.select(_host().alias("host"), F.col("html")).filter("host <> '' and html <> ''")
    return rows.mapInArrow(run, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the paths with a tenth of the host's votes or more, those with most votes first."""
    counted = staged(votes(pages), "path-votes")
    hosts = counted.groupBy("host").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("n"))
    rows = join_counted(counted.withColumnRenamed("n", "votes"), hosts, ["host"], counted.count())
    won = rows.filter(F.col("votes") >= SHARE * F.col("all"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "path")))
    return won.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, most_hosts: int = HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    winners = staged(winning_paths(pages), "paths")
    if winners.count() <= most_hosts:
        joined = rows.join(F.broadcast(winners), "host", "left")  # most_hosts rows of ten paths at most
    else:
        sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        known = staged(sizes.join(winners, "host", "left"), "host-paths")
        joined = join_counted(rows, known, ["host"], known.agg(F.sum("n")).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source).extract(paths or []) for source, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    out = joined.select("page_id", "url", "html", "paths")
    return out.mapInArrow(run, f"page_id {out.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
