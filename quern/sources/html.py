"""Pages out of HTML: links through seven channels, and the text of the body.

Built on the standard library's parser, as an Arrow UDF over whole pages.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import absolute_link, page_link

# Elements and classes that hold no content, attributes that hold links, and void elements.
NO_CONTENT = {"script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside", "form", "img", "video", "audio", "canvas", "picture", "figure", "source"}
NO_CONTENT_CLASSES = {"top-menu", "mainmenu", "sidebar", "footer", "footer-bg", "footer-area", "bottom-footer", "navbar", "dropdown-menu", "modal", "breadcrumbs", "social-icons", "quick-links", "marquee"}
NO_CONTENT_IDS = {"sidebar", "footer", "header"}
LINK_ATTRIBUTES = ("data-url", "data-href", "data-link", "data-target", "data-src")
# Classes of cards that show a person, of the parts of a card, and of an address in a page's footer.
CARD, CARD_NAME, CARD_ROLE = (re.compile(x, re.IGNORECASE) for x in ("(?:placement|faculty|team)-member|faculty-card", "name|title", "role|designation|post"))
ADDRESS = re.compile("footer-address-box", re.IGNORECASE)
#: Heading under which an address from the footer is kept.
CONTACT = "[Contact]"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ONCLICK = re.compile(r"(?:location\.href|window\.open|window\.location|href)\s*[=(]\s*['\"]([^'\"]+)['\"]", re.IGNORECASE)
_RELATIVE = re.compile(r"['\"(]([a-zA-Z0-9_\-./]+\.(?:php|html|htm)(?:\?[\w\-.?=&%]*)?)['\")]", re.IGNORECASE)

PAGE_SCHEMA = "url string, title string, content string, hash string, links array<struct<url:string,anchor:string>>, is_thin_hub boolean"


class _Page(HTMLParser):
    """Gathers text, title, headings and raw links in document order; tolerates what isn't closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.hidden = 0
        self.text: list[str] = []
        self.title: list[str] = []
        self.h1: list[str] = []
        self.anchors: list[tuple[str, list[str]]] = []
        self.open_anchors: list[list[str]] = []
        self.channels: dict[str, list[tuple[str, str]]] = {c: [] for c in ("area", "data", "form", "onclick")}
        self.has_body = False
        self.card: dict | None = None  # the card that is open: where its text begins, and its parts
        self.address_at: int | None = None
        self.address: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").lower().split())
        hide = tag in NO_CONTENT or bool(classes & NO_CONTENT_CLASSES) or a.get("id", "").lower() in NO_CONTENT_IDS
        self.has_body |= tag == "body"
        if tag == "a" and "href" in a:
            held: list[str] = []
            self.anchors.append((a["href"], held))
            self.open_anchors.append(held)
        elif tag in ("area", "link") and "href" in a:
            self.channels["area"].append((a["href"], ""))
        if tag == "form" and "action" in a:
            self.channels["form"].append((a["action"], ""))
        for name in LINK_ATTRIBUTES:
            if name in a:
                self.channels["data"].append((a[name], ""))
        for link in _ONCLICK.findall(a.get("onclick", "")):
            self.channels["onclick"].append((link, ""))
        if tag not in _VOID:
            self._open_box(a.get("class", ""))
            self.stack.append((tag, hide))
            self.hidden += hide
        elif tag == "br":
            self.text.append("\n")

    def _open_box(self, classes: str) -> None:
        depth = len(self.stack)
        if self.address_at is None and ADDRESS.search(classes):
            self.address_at = depth
        if self.card is None:
            if CARD.search(classes) and not self.hidden:
                self.card = {"depth": depth, "text": len(self.text), "parts": {}, "open": None}
        elif self.card["open"] is None:
            part = "name" if CARD_NAME.search(classes) else "role" if CARD_ROLE.search(classes) else None
            if part and part not in self.card["parts"]:
                self.card["parts"][part], self.card["open"] = [], (part, depth)

    def _close_box(self) -> None:
        """What ends with the element just taken from the stack."""
        depth = len(self.stack)
        if self.address_at == depth:
            self.address_at = -1  # the first address counts
        if self.card and self.card["open"] and self.card["open"][1] == depth:
            self.card["open"] = None
        if self.card and self.card["depth"] == depth:
            name, role = (" ".join("".join(self.card["parts"].get(x, [])).split()) for x in ("name", "role"))
            if name and role:
                del self.text[self.card["text"] :]
                self.text.append(f"\nMember: {name} | Role: {role}\n")
            self.card = None

    def handle_endtag(self, tag):
        if tag == "a" and self.open_anchors:
            self.open_anchors.pop()
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, hide = self.stack.pop()
            self.hidden -= hide
            self._close_box()
            if t == tag:
                break

    def handle_data(self, data):
        for held in self.open_anchors[-1:]:
            held.append(data)
        if self.address_at is not None and 0 <= self.address_at < len(self.stack):
            self.address.append(data)
        if self.card and self.card["open"]:
            self.card["parts"][self.card["open"][0]].append(data)
        tags = [t for t, _ in self.stack]
        if "title" in tags:
            self.title.append(data)
            return
        if "h1" in tags:
            self.h1.append(data)
        if not self.hidden and "head" not in tags:
            self.text.append(data)


def parse_page(url: str, html: str | None, allowed_hosts: tuple[str, ...] = ()) -> tuple:
    """Title, text, and distinct absolute references (the first anchor holds) of a page. Empty input gives an empty page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    found: dict[str, str] = {}

    def add(link: str, anchor: str = "") -> None:
        if (target := absolute_link(link, url)) is not None:
            found.setdefault(target, re.sub(r"\s+", " ", anchor).strip())

    for link, held in page.anchors:
        add(link, "".join(held))
    for channel in page.channels.values():
        for link, anchor in channel:
            add(link, anchor)
    if allowed_hosts:
        hosts = "|".join(re.escape(h) for h in allowed_hosts)
        for link in re.findall(rf"https?://(?:[a-zA-Z0-9.\-]+\.)?(?:{hosts})[^\s'\"<>]+", html or ""):
            add(link)
    for link in _RELATIVE.findall(html or ""):
        add(link)
    lines = [x.strip() for x in "\n".join(page.text).split("\n")]
    content = "\n".join(x for x in lines if len(x) > 1)
    address = [x.strip() for part in page.address for x in part.split("\n") if x.strip()]
    if address and CONTACT not in content:
        content = "\n".join([content, "", CONTACT, *address]).strip()
    title = " ".join("".join(page.h1).split()) or " ".join("".join(page.title).split())
    return title, content, list(found.items())


def pages_from_html(raw: DataFrame, allowed_hosts: tuple[str, ...] = ()) -> DataFrame:
    """Pages from ``url, html`` and, if there, ``status, content_type``: only HTML answered with 200 is taken.

    A null URL gives nothing. A page without text but with links is kept as a thin hub; one with neither isn't.
    """
    rows = raw.where("url is not null and html is not null")
    if "status" in raw.columns:
        rows = rows.where("status = 200")
    if "content_type" in raw.columns:
        rows = rows.where(F.lower("content_type").rlike("text/html|application/xhtml"))

    def run(batches):
        for b in batches:
            out = []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                title, content, links = parse_page(url, html, allowed_hosts)
                if content or links:
                    out.append((url, title, content, [{"url": u, "anchor": a} for u, a in links], not content))
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("url", pa.string()), ("anchor", pa.string())])), pa.bool_())
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["url", "title", "content", "links", "is_thin_hub"])

    parsed = rows.select("url", "html").mapInArrow(run, "url string, title string, content string, links array<struct<url:string,anchor:string>>, is_thin_hub boolean")
    # References that lead to pages, each page once.
    links = F.filter(F.transform("links", lambda x: F.struct(page_link(x["url"]).alias("url"), x["anchor"].alias("anchor"))), lambda x: x["url"].isNotNull())
    once = F.expr("filter(links, (x, i) -> array_position(links.url, x.url) = i + 1)")
    kept = parsed.withColumn("links", links).withColumn("links", once)
    return kept.where("content <> '' or size(links) > 0").select("url", "title", "content", F.md5("content").alias("hash"), "links", "is_thin_hub")


def link_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, anchor`` of all links."""
    return pages.select(F.col("url").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.url").alias("dst"), F.col("l.anchor").alias("anchor"))
