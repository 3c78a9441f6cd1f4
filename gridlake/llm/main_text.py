"""Main text of web pages by tag-path ratios (operator 7).

A page is read into blocks of text, each with its root-to-leaf path of block elements.
Length and punctuation are added up per path and divided by the path's blocks. The two
ratios are smoothed over neighbouring blocks, fused to one number per path and compared to a
share of the best path's. Chosen paths give the article; headings, lists, quotes and the
like beside them in the same container belong to it too.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.arrow import by_bytes

#: Share of the best path's fused ratio that a content path needs.
THRESHOLD = 0.25
#: Paths inside an article or main element count so many times.
ARTICLE_PRIOR = 4.0
SMOOTHING = (0.2, 0.6, 0.2)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes svg math template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
             "s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = RAW | set("nav footer aside form button select option datalist dialog menu object canvas audio video "
                    "map head fieldset".split())
#: Elements that a new element of the key ends, up to the listed borders.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
TEXTUAL = re.compile(r"(h[1-6]|p|ul|ol|li|dl|dt|dd|blockquote|pre|table|caption|thead|tbody|tfoot|tr|td|th|figure|figcaption|section)$")
HEADING = re.compile(r"h[1-6]$")
#: Lists and tables of links are menus, unless they stand in an article or amid its text.
LISTED = set("ul ol dl li dt dd table caption thead tbody tfoot tr td th".split())
NOISE = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|menu\w*|nav\w*|breadcrumbs?|pagination|"
    r"pager|comments?|commentlist|disqus|replies|respond|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscri\w+|signup|login|search\w*|share|sharing|social|related|recommend\w*|widget\w*|toolbar|"
    r"footer|foot|masthead|copyright|legal|disclaimer|skip|hidden|tags?", re.I)
NOISE_TOKENS = {"side-bar", "sr-only", "byline-links"}
#: Class names with these parts tell how a page is laid out or filed, not what the element is.
STATES, STATE_ENDS, FILED = {"has", "no", "with", "without"}, {"open", "closed"}, {"tag", "category"}
LISTINGS = {"list", "cloud", "links"}
#: Words of sections that never wrap an article, however long they are.
FOREIGN = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|comments?|commentlist|disqus|replies|respond|cookie\w*|consent|gdpr|"
                     r"newsletter|subscri\w+|signup|login|share|sharing|related|recommend\w*|breadcrumbs?|pagination|pager", re.I)
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
PUNCTUATION = re.compile(r"[,.;:!?、。，！？；：…]")


@dataclass
class Element:
    tag: str
    label: str
    skipped: bool
    inline: bool
    in_article: bool
    heading_only: bool
    suspects: tuple[int, ...]
    host: tuple[str, int] | None


@dataclass
class Block:
    path: tuple[str, ...]
    in_article: bool
    suspects: tuple[int, ...] = ()
    #: Tag and number of the article, or else the main element, around the block.
    host: tuple[str, int] | None = None
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _is_noise(tag: str, names: dict[str, str]) -> bool:
    if tag in SKIPPED or "hidden" in names or names.get("aria-hidden", "").lower() == "true":
        return True
    if names.get("role", "").lower() in NOISE_ROLES:
        return True
    style = names.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def _noise_parts(names: dict[str, str]) -> list[str]:
    """Words of the class names and the id that tell of something else than the article."""
    found = []
    for token in (names.get("class", "") + " " + names.get("id", "")).lower().split():
        parts = re.split("[_-]+", token.strip("_-"))
        if STATES & set(parts) or parts[-1] in STATE_ENDS:
            continue
        if len(parts) > 1 and parts[0] in FILED and parts[1] not in LISTINGS:
            continue
        if any(t in token for t in NOISE_TOKENS):
            found.append(token)
        found += [p for p in parts if NOISE.fullmatch(p)]
    return found


class Reader:
    """Blocks of one page, in order, without those of skipped elements.

    An element of a noise class or id is a suspect; its blocks name it, for a wrapper of the
    article may carry such a class as well. The value tells if the class is a FOREIGN one.
    """

    def __init__(self) -> None:
        self.suspects: list[bool] = []
        self.hosts = 0
        self.stack: list[Element] = []
        self.blocks: list[Block] = []
        self.open: Block | None = None

    def read(self, page: str) -> list[Block]:
        at, end = 0, len(page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                break
            if lt > at:
                self.text(page[at:lt])
            following = page[lt + 1:lt + 2]
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 2)
                at = end if close < 0 else close + 3
            elif following in ("!", "?"):
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            elif following == "/":
                close = page.find(">", lt)
                if close < 0:
                    break
                self.end(page[lt + 2:close].strip().split(" ")[0].lower())
                at = close + 1
            elif following.isascii() and following.isalpha():
                m = TAG.match(page, lt)
                if not m:
                    break
                tag, at = m[1].lower(), m.end()
                if tag in RAW:
                    close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
                    if not close:
                        at = end
                    else:
                        stop = page.find(">", close.end())
                        at = end if stop < 0 else stop + 1
                else:
                    self.start(tag, m[2])
            else:
                self.text("<")
                at = lt + 1
        self.close_block()
        return self.blocks

    def start(self, tag: str, raw: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.text("\n")
            elif tag == "hr":
                self.close_block()
            return
        inline = tag in INLINE
        if not inline:
            self.close_block()
            self._end_implied(tag)
        elif tag == "a" and any(e.tag == "a" for e in self.stack):
            self._pop_inline("a")
        names = _attributes(raw) if raw.strip() else {}
        above = self.stack[-1] if self.stack else None
        article_body = names.get("itemprop") == "articleBody"
        # an article in another one is often a comment
        own = (tag in ("html", "body", "main") or article_body
               or tag == "article" and not any(e.tag == "article" for e in self.stack))
        suspects = above.suspects if above else ()
        noise = [] if own or not names else _noise_parts(names)
        if noise:
            suspects = (*suspects, len(self.suspects))
            self.suspects.append(any(FOREIGN.fullmatch(p) for p in noise))
        in_article = (bool(above and above.in_article) or tag in ("article", "main") or article_body) and not any(
            self.suspects[s] for s in suspects)
        host = above.host if above else None
        if in_article and (tag == "article" or host is None):
            self.hosts += 1
            host = (tag, self.hosts)
        skipped = bool(above and above.skipped) or _is_noise(tag, names)
        heading_only = bool(above and above.heading_only)
        if tag == "header":
            heading_only, skipped = in_article, skipped or not in_article
        first = names.get("class", "").split()[:1]
        self.stack.append(Element(tag, ".".join([tag, *first]), skipped, inline, in_article, heading_only, suspects, host))

    def _end_implied(self, tag: str) -> None:
        ended, borders = ENDED_BY.get(tag, (set(), set()))
        for i in range(len(self.stack) - 1, -1, -1):
            e = self.stack[i]
            if e.tag == "p" or e.tag in ended:
                del self.stack[i:]
                if e.tag != "p":
                    return
            elif e.tag in borders or not (e.inline or ended):
                return

    def _pop_inline(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                del self.stack[i]
                return
            if not self.stack[i].inline:
                return

    def end(self, tag: str) -> None:
        if tag in INLINE:
            self._pop_inline(tag)
            return
        self.close_block()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if tag == "p" and not self.stack[i].inline:
                return

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top and top.skipped:
            return
        if self.open is None:
            if not raw.strip():
                return
            path = tuple(e.label for e in self.stack if not e.inline)
            if top and top.heading_only and not any(HEADING.match(e.tag) for e in self.stack):
                return
            self.open = Block(path, bool(top and top.in_article), top.suspects if top else (), top.host if top else None)
        value = html.unescape(raw) if "&" in raw else raw
        self.open.parts.append(value)
        if any(e.tag == "a" for e in self.stack):
            self.open.link_chars += len(value.strip())

    def close_block(self) -> None:
        if self.open is not None:
            self.open.text = " ".join("".join(self.open.parts).split())
            if self.open.text:
                self.blocks.append(self.open)
            self.open = None


def path_ratios(blocks: list[Block]) -> dict[tuple[str, ...], float]:
    """The fused, smoothed ratio of every path."""
    length: dict = defaultdict(int)
    marks: dict = defaultdict(int)
    number: dict = defaultdict(int)
    for b in blocks:
        length[b.path] += max(0, len(b.text) - b.link_chars)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        number[b.path] += 1

    def smoothed(ratio: dict) -> dict:
        raw = [ratio[b.path] for b in blocks]
        padded = [raw[0], *raw, raw[-1]]
        total: dict = defaultdict(float)
        for i, b in enumerate(blocks):
            total[b.path] += sum(w * padded[i + k] for k, w in enumerate(SMOOTHING))
        return {p: total[p] / number[p] for p in number}

    text = smoothed({p: length[p] / number[p] for p in number})
    dots = smoothed({p: marks[p] / number[p] for p in number})
    prior = {b.path: ARTICLE_PRIOR if b.in_article else 1.0 for b in blocks}
    return {p: prior[p] * text[p] * (1 + dots[p]) for p in number}


def without_noise(blocks: list[Block], foreign: list[bool]) -> list[Block]:
    """Blocks that lie in no suspect but such as wrap the article.

    A suspect around blocks of the best path wraps the article if it holds half of the text
    that is not linked. FOREIGN ones take part only where the page has no other text.
    """
    def size(some: list[Block]) -> int:
        return sum(max(0, len(b.text) - b.link_chars) for b in some)

    rest = [b for b in blocks if not any(foreign[s] for s in b.suspects)]
    if size(rest):
        blocks = rest
    if not any(b.suspects for b in blocks):
        return blocks
    ratios = path_ratios(blocks)
    most, total = max(ratios.values()), size(blocks)
    around = {s for b in blocks if ratios[b.path] == most > 0 for s in b.suspects}
    wrap = {s for s in around if 2 * size([b for b in blocks if s in b.suspects]) >= total}
    return [b for b in blocks if wrap.issuperset(b.suspects)]


def main_text(page: str | None) -> str:
    reader = Reader()
    blocks = without_noise(reader.read(page), reader.suspects) if page else []
    if not blocks:
        return ""
    ratios = path_ratios(blocks)
    least = THRESHOLD * max(ratios.values())
    chosen = {p for p, r in ratios.items() if r >= least and r > 0}
    if any(b.in_article for b in blocks if b.path in chosen):
        chosen = {b.path for b in blocks if b.path in chosen and b.in_article}
    containers = {p[:-1] for p in chosen}

    def beside(path: tuple[str, ...]) -> bool:
        return any(path[:i] in containers and all(TEXTUAL.match(e.split(".")[0]) for e in path[i:])
                   for i in range(len(path)))

    places = [i for i, b in enumerate(blocks) if b.path in chosen]
    hosts = {blocks[i].host for i in places} - {None}

    def keeps(i: int, b: Block) -> bool:
        near = beside(b.path)
        if b.path in chosen:
            return True
        if not near and not (b.host in hosts and TEXTUAL.match(b.path[-1].split(".")[0])):
            return False
        listed = any(e.split(".")[0] in LISTED for e in b.path[-2:])
        if not listed or 2 * b.link_chars < len(b.text) or places[0] < i < places[-1]:
            return True
        # the border of main may hold menus, that of an article only its sources
        return b.host in hosts and (near or b.host[0] != "main")

    return "\n".join(b.text for i, b in enumerate(blocks) if keeps(i, b))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of html.

    A null or empty page, and one without content, has the empty text. Every row is read by
    itself, so repeated rows give equal results; columns text and n_chars of the input are
    replaced, all others are kept.
    """
    own = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    df = pages.select(*[F.col(f"`{c}`") for c in own], F.col(html_col).alias("text"), F.lit(0).cast("bigint").alias("n_chars"))

    def run(batches):
        for batch in by_bytes(batches):
            found = [main_text(p) for p in batch.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                batch.schema.names)

    return df.mapInArrow(run, df.schema)
