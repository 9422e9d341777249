"""Main text of web pages by consensus of a host's pages.

Each page is read once as a tree of its structural elements; an element's generalised path is its chain of tags and
classes, with numbers made equal (its last step and a digest of the chain stand for it). A page scores its containers (text that is not in links, with a loss for each level
that the text lies deeper) and votes for the path of its best one, or of an article or main around it with further
text. Spark counts the votes by host and path. Every page
is then read again and its text is taken from the elements on its host's winning path; a page without such an element
uses its own best container. Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and comments
are left out of scores and texts alike.

Null and empty html has the empty text. A page whose URL names no host votes and reads with the others like it. Ties in
votes go to the larger score, then to the path. Repeated pages vote once each; an empty table gives no rows; extra
columns are ignored. Texts of any length are read whole, in one pass whatever their markup. Markup that never ends (a
tag, a comment, a script) holds the rest of the page, as in browsers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow

#: Elements whose whole content is not text of the page.
SKIPPED = frozenset("script style noscript template title textarea svg iframe".split())
#: Of these, the ones that hold the rest of a page if they are never closed.
RAW = frozenset("script style title textarea".split())
ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in SKIPPED}
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
IN_TAG = re.compile(r"[>=]\s*")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
STRUCTURE = frozenset("html head body main article section div nav header footer aside form ul ol dl table tr td blockquote figure fieldset menu dialog details center".split())
CONTAINERS = frozenset("body main article section div td center".split())
LEFT_OUT = frozenset("head nav header footer aside form menu dialog fieldset".split())
ALWAYS_OUT = LEFT_OUT - {"form", "fieldset"}
NUMBER = re.compile(r"\d+")
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label del".split())
#: Words of class, id or role names that mark what is not main text (fixed values).
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|complementary|consent|contentinfo|cookie|cookies|disqus|footer|header|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|related|replies|reply|respond|search|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Classes and ids of pages hold such words too (has-sidebar, no-comments), so that html, body and main are never left
#: out by name, and an article that lies in no other one only by a whole word for what is not the page's own.
UNNAMED = frozenset("html body main".split())
#: Compounds that tell what a page has or lacks beside the text: they say nothing about the element itself.
HAVING = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-]\S*", re.I)
FOREIGN = re.compile(r"(?:^|\s)(?:ad|ads|advert|adverts|advertisement|comment|comments|promo|related|replies|reply|sponsor|sponsored)(?:$|\s)", re.I)
DEPTH_LOSS = 0.9
#: Most hosts whose winners are broadcast (a host and a path each, some ten megabytes); salts of a host beyond that.
MOST_SENT, SALTS = 50_000, 16


def tag_end(html: str, at: int) -> int:
    """The place after the ``>`` that ends the tag; values in quotes may hold others. -1: there is none. A quote that is
    never closed is a character like others, so that a whole page is read in one pass."""
    while m := IN_TAG.search(html, at):
        if html[m.start()] == ">":
            return m.start() + 1
        at = m.end()
        if html[at : at + 1] in ('"', "'"):
            at = (html.find(html[at], at + 1) + 1) or at + 1
    return -1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", characters, ""), ("open", tag, attributes) and ("close", tag, ""), in one pass. Comments, declarations
    and the content of ``SKIPPED`` are left out."""
    at, unclosed = 0, set()
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            yield "text", html[at:], ""
            return
        if start > at:
            yield "text", html[at:start], ""
        after = html[start + 1 : start + 2]
        if after in ("!", "?"):
            mark = "-->" if html.startswith("<!--", start) else "]]>" if html.startswith("<![CDATA[", start) else ">"
            end = html.find(mark, start + 2)
            at = end + len(mark) if end >= 0 else len(html)
            continue
        closes = after == "/"
        name = TAG_NAME.match(html, start + 1 + closes)
        if not name:
            if not closes:
                yield "text", "<", ""
            at = start + 1 if not closes else (html.find(">", start) + 1) or len(html)
            continue
        end = tag_end(html, name.end())
        if end < 0:
            return
        tag, attributes = name.group().lower(), html[name.end() : end - 1]
        yield "close" if closes else "open", tag, attributes
        at = end
        if tag in SKIPPED and not closes and not (tag == "svg" and attributes.endswith("/")) and tag not in unclosed:
            if last := ENDS[tag].search(html, end):
                at = last.end()
            elif tag in RAW:
                return
            else:
                unclosed.add(tag)


class Page:
    """The structural elements of a page (parent, path, whether left out) and its text pieces in order. Element 0 stands
    for a page that writes no body. ``relaxed``: forms, side bars and names of classes leave nothing out."""

    def __init__(self, html: str, relaxed: bool = False) -> None:
        self.parent, self.path, self.out, self.tag, self.in_article = [-1], [""], [False], ["body"], [False]
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, in a link
        self.headed = False
        stack, link, held = [0], False, Counter()
        for kind, value, attributes in tokens(html):
            if kind == "text":
                self.pieces.append((stack[-1], value, link))
                continue
            if value == "a":
                link = kind == "open"
            if value not in INLINE:
                self.pieces.append((stack[-1], "\n", False))
            self.headed |= value in ("h1", "article", "main")
            if value not in STRUCTURE:
                continue
            if kind == "close":
                while held[value]:
                    held[top := self.tag[stack.pop()]] -= 1
                    if top == value:
                        break
            elif not attributes.endswith("/") or value in ("body", "html"):
                held[value] += 1
                self.enter(value, attributes, stack, relaxed)

    def enter(self, tag: str, attributes: str, stack: list[int], relaxed: bool) -> None:
        own: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(attributes):
            own.setdefault(name.lower(), next((x for x in values if x), ""))
        classes = own.get("class", "").split()
        above = stack[-1]
        self.parent.append(above)
        step = ".".join([tag, *sorted(NUMBER.sub("0", c) for c in classes)])
        self.path.append(f"{step}#{xxhash.xxh64_hexdigest(f'{self.path[above]}>{step}')}")
        names = HAVING.sub(" ", " ".join(own.get(x, "") for x in ("class", "id", "role")))
        marks = FOREIGN if tag == "article" and not self.in_article[above] else BOILERPLATE
        self.in_article.append(self.in_article[above] or tag == "article")
        by_name = not relaxed and tag not in UNNAMED and bool(marks.search(names))
        self.out.append(self.out[above] or tag in (ALWAYS_OUT if relaxed else LEFT_OUT) or by_name)
        self.tag.append(tag)
        stack.append(len(self.tag) - 1)

    def gathered(self, loss: float) -> list[float]:
        """Characters in each element, those in links against those outside, less ``loss`` for each level deeper. An
        element comes after the one that holds it, so one pass backwards adds all up."""
        size = [0.0] * len(self.tag)
        for node, text, linked in self.pieces:
            if not self.out[node]:
                size[node] += -len(text.strip()) if linked else len(text.strip())
        for node in range(len(size) - 1, 0, -1):
            size[self.parent[node]] += loss * size[node]
        return size

    def best(self) -> tuple[str, float] | None:
        """Path and score of the best container."""
        found = [(s, -i) for i, s in enumerate(self.gathered(DEPTH_LOSS)) if s > 0 and self.tag[i] in CONTAINERS]
        return (self.path[self.widened(-max(found)[1])], max(found)[0]) if found else None

    def widened(self, node: int) -> int:
        """The outermost article or main around the element that has further text, more of it outside links than in."""
        size = self.gathered(1.0)
        best, above = node, self.parent[node]
        while above > 0:
            if self.tag[above] in ("article", "main") and size[above] > size[best]:
                best = above
            above = self.parent[above]
        return best

    def text(self, path: str | None) -> str:
        """The text inside the elements on the path."""
        inside = [path == ""] * len(self.tag)
        for i in range(1, len(self.tag)):
            inside[i] = not self.out[i] and (inside[self.parent[i]] or self.path[i] == path)
        return " ".join(unescape("".join([t for node, t, _ in self.pieces if inside[node]])).split())


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score: the vote of each page that has a container."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if html and (best := Page(html).best()):
                    rows.append((host, *best))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["host", "path", "score"])

    return in_arrow(pages.select("host", "html"), step, "host string, path string, score double")


def host_of(url: str = "url") -> F.Column:
    """After the first ``://`` to the next of ``/?#``, A-Z lower-cased."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def main_text(html: str | None, winner: str | None) -> tuple[str, str | None]:
    """Text and path of a page: the host's path, else its own best one; a page with a heading, article or main whose
    every element is left out (a page inside one form) is read again with forms and names of classes let in."""
    if not html:
        return "", None
    page = Page(html)
    if winner is not None and (text := page.text(winner)):
        return text, winner
    best = page.best()
    if not best and page.headed:
        page = Page(html, relaxed=True)
        best = page.best()
    text = page.text(best[0]) if best else ""
    return text, best[0] if text else None


def extract(pages: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """page_id, url, text, n_chars, path (the one that was used)."""
    own = pages.select("page_id", "url", "html", host_of().alias("host"))
    counted = votes(own).groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.floor("score").cast("long")).alias("score"))
    winners = counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("winner"))
    winners = cut(winners, "winners")
    if winners.count() <= most_sent:
        joined = own.join(F.broadcast(winners), "host", "left")
    else:  # a host's pages are dealt to several tasks, its winner to each of them
        salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt")
        salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(winners.select("*", salts).hint("shuffle_hash"), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "winner")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = zip(*map(main_text, batch.column(2).to_pylist(), batch.column(3).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return in_arrow(joined, step, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, path string")
