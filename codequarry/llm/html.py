"""Main text of web pages by removal of site templates.

Pages are parsed into elements. The first pass hashes the subtree of every block element and
counts, per host, the pages that hold it. A subtree found on many pages of its host is a template
and is deleted in the second pass, with it what by tag, role or class name is a menu, header,
footer, sidebar, notice, advert, form, script, style or reader comment. Paragraphs, headings,
quotes and list items inside the article are its own words and stay even if other pages repeat them.

Asides, menus and footers that hold
articles (teasers) go too unless they hold most of the page's text. Of what is left, the articles'
text is the page's if it is the larger part, else that of main; else all of it is.

The rest is given block by block. Null and empty html give empty text. Pages of any length are
read whole; broken markup is read as browsers do: a new block ends an open paragraph, an end tag
closes what is open inside its element, and what is never closed ends with the page. A url without
a host counts under the empty host. Repeated rows of a page are pages of their own.
"""

from __future__ import annotations

import html as html_module
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import BROADCAST_ROWS, map_batches
from codequarry.sources.storage import written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|title|select|object)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=raw)\s*+>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul center".split()
)
#: What ends with the next one of its kind.
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
LISTS = frozenset("ul ol menu dl table".split())
CELLS = frozenset("td th".split())
OWN_WORDS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption caption td th tr".split())
WHOLE = frozenset("html body article main".split())
DROPPED_TAGS = frozenset("head nav aside footer form menu button dialog fieldset".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split()
)
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice alert disclaimer sidebar sidenav widget widgets menu submenu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead topbar comment comments commentlist disqus reply replies respond discussion share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager skip toc".split()
)


class Element:
    __slots__ = ("tag", "parent", "names", "classes", "role", "parts", "article", "digest")

    def __init__(self, tag: str, parent: Element | None, attrs: str):
        self.tag, self.parent, self.names, self.classes, self.role = tag, parent, (), (), ""
        self.parts: list[bytes] = [tag.encode()]
        self.article, self.digest = False, 0
        if "=" in attrs:
            for name, *values in ATTRIBUTE.findall(attrs):
                value = html_module.unescape(max(values, key=len)).lower()
                if name.lower() == "role":
                    self.role = value
                else:
                    self.names += tuple(WORD.findall(value))
                    self.classes += tuple(value.split())
            self.parts.append(" ".join(self.names).encode())

    def close(self) -> None:
        data = b"\0".join(self.parts)
        self.digest = xxhash.xxh64_intdigest(data) - (1 << 63)
        self.parts = []
        if self.parent is not None:
            self.parent.parts.append(self.digest.to_bytes(8, "big", signed=True))

    def inside(self, tags: frozenset[str]) -> bool:
        up = self.parent
        while up is not None:
            if up.tag in tags:
                return True
            up = up.parent
        return False


ARTICLE = frozenset(["article", "main"])
#: Deleted even around articles: teasers of other pages.
ASIDES = frozenset("nav aside footer menu dialog".split())


class Page:
    """The blocks of a page: (text, innermost element)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, Element]] = []
        self.elements: list[Element] = []
        self.mass: dict[int, int] = {}
        self.here = Element("html", None, "")
        self.elements.append(self.here)
        self.text: list[str] = []
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._write(source[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if tag:
                self._tag(tag.lower(), m["end"] == "/", m["attrs"])
            elif m["raw"]:
                self._write(" ")
        self._write(source[at:])
        self._flush()
        while self.here is not None:
            self._up()

    def _write(self, text: str) -> None:
        self.text.append(html_module.unescape(text) if "&" in text else text)

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.blocks.append((text, self.here))
            self.here.parts.append(text.encode("utf-8", "surrogatepass"))

    def _up(self) -> None:
        self.here.close()
        self.here = self.here.parent

    def _find(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> Element | None:
        up = self.here
        while up is not None and up.tag not in stop:
            if up.tag in tags:
                return up
            up = up.parent
        return None

    def _tag(self, tag: str, ends: bool, attrs: str) -> None:
        if tag not in BLOCKS:
            named = not ends and tag not in VOID and "=" in attrs and any(n in DROPPED_NAMES for n in Element(tag, None, attrs).names)
            if tag == "hr":
                self._flush()
            elif tag == "br" or tag == "img":
                self.text.append(" ")
            elif named and not attrs.endswith("/"):
                self._flush()
                self.here = Element(tag, self.here, attrs)
                self.elements.append(self.here)
            elif ends and self.here.tag == tag:
                self._flush()
                self._up()
            return
        if tag in CELLS and not ends and self.here.tag == "tr" and self.text:
            self.text.append(" ")
        self._flush()
        if ends:
            found = self._find({tag}, frozenset())
            while found is not None and self.here is not found:
                self._up()
            if found is not None and found.parent is not None:
                self._up()
            return
        if tag in ("html", "body"):
            if tag == "body" and self.here.tag == "head":
                self._up()
            if self._find({tag}, frozenset()):
                return
        while self._find({"p"}, frozenset(("div", "section", "td", "li"))) and tag != "td":
            self._up()
        if tag in SIBLINGS:
            open_one = self._find(SIBLINGS[tag], LISTS if tag != "tr" else frozenset(["table"]))
            while open_one is not None and self.here is not open_one.parent:
                self._up()
        self.here = Element(tag, self.here, attrs)
        self.elements.append(self.here)
        if tag in ARTICLE:
            up = self.here.parent
            while up is not None and not up.article:
                up.article = True
                up = up.parent

    def lesser(self, e: Element) -> bool:
        """Whether an element holds no more than half of the page's text; an unclosed one may hold it all."""
        if not self.mass:
            for text, holder in self.blocks:
                up: Element | None = holder
                while up is not None:
                    self.mass[id(up)] = self.mass.get(id(up), 0) + len(text)
                    up = up.parent
        return 2 * self.mass.get(id(e), 0) <= self.mass.get(id(self.elements[0]), 0)

    def by_rule(self, e: Element) -> bool:
        """Whether tag, role or name alone say that this is not the article."""
        if e.tag in WHOLE:
            return e.tag == "article" and any(c in ("comment", "reply") for c in e.classes)
        if e.article and not (e.tag in ASIDES and self.lesser(e)):
            return False
        if e.tag in DROPPED_TAGS or e.role in DROPPED_ROLES or any(n in DROPPED_NAMES for n in e.names):
            return True
        return (e.tag == "header" or "header" in e.names) and not e.inside(ARTICLE)

    def candidates(self) -> set[int]:
        """Hashes of the subtrees that may be templates."""
        return {
            e.digest for e in self.elements
            if e.tag in BLOCKS and e.tag not in WHOLE and not e.article and not (e.tag in OWN_WORDS and e.inside(ARTICLE))
        }

    def main_text(self, templates: frozenset[int] | set[int]) -> str:
        """The blocks outside deleted subtrees; those of articles, or of main, if they are most of that text."""
        deleted: dict[int, bool] = {}
        kept: list[tuple[str, str]] = []

        def gone(e: Element | None) -> bool:
            if e is None:
                return False
            known = deleted.get(id(e))
            if known is None:
                template = e.digest in templates and e.tag not in WHOLE and not e.article and not (e.tag in OWN_WORDS and e.inside(ARTICLE))
                known = deleted[id(e)] = template or self.by_rule(e) or gone(e.parent)
            return known

        for text, e in self.blocks:
            if not gone(e):
                inside = next((t for t in ("article", "main") if e.tag == t or e.inside(frozenset([t]))), "")
                kept.append((text, inside))
        left = sum(len(t) for t, _ in kept)
        for scopes in (("article",), ("article", "main")):
            chosen = [t for t, s in kept if s in scopes]
            if 2 * sum(map(len, chosen)) > left:
                return "\n".join(chosen)
        return "\n".join(t for t, _ in kept)


def host(url):
    """The host of a url, lower-cased; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, share: float = 0.3, least: int = 5, many: int = 1000) -> DataFrame:
    """host, hash of the subtrees on ``least`` pages and ``share`` of the host's pages or more, or on ``many`` pages.

    Counts are summed in each task first, so a host with a third of all pages is no burden.
    """
    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def subtrees(b):
        return {"host": b["host"], "hash": [sorted(Page(h).candidates()) for h in b["html"]]}

    hashed = map_batches(rows, subtrees, "host string, hash array<bigint>")
    # one row more per page, with a null hash, counts the pages of the host
    counted = hashed.select("host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "hash")).alias("hash")).groupBy("host", "hash").count()
    counted = written(counted.filter((F.col("count") >= least) | F.col("hash").isNull()), "subtrees")
    sizes = counted.filter(F.col("hash").isNull()).select("host", F.col("count").alias("pages"))
    found = counted.filter(F.col("hash").isNotNull()).join(sizes, "host")
    return found.filter((F.col("count") >= F.col("pages") * share) | (F.col("count") >= many)).select("host", "hash")


def main_texts(pages: DataFrame, templates: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The templates of a host travel as one array: at most average-subtrees-per-page / share hashes,
    and those on many pages.
    They are broadcast while all of them are few (counted); else pages meet them in a join on the
    host and a salt, which spreads a large host over ``salts`` tasks.
    """
    templates = written(site_templates(pages) if templates is None else templates, "templates")
    per_host = templates.groupBy("host").agg(F.collect_list("hash").alias("templates"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    if templates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(per_host), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
        spread = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", salt).join(spread, ["host", "salt"], "left")

    def texts(b):
        text = [Page(h).main_text(frozenset(t or ())) for h, t in zip(b["html"], b["templates"])]
        return {"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]}

    rows = rows.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", "templates")
    return map_batches(rows, texts, "page_id bigint, url string, text string, n_chars bigint")
