"""Pages parsed to documents, links and blocks.

The mark-up is read once, in Arrow batches, by the standard library's parser into a flat table of elements (no recursion, so any
depth can be read). What a page is follows from counts that the parse returns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from ampora.functions.address import address

MAX_TEXT = 250_000  # letters of a document's body, as archived
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# What holds a page's content, and what surrounds it.
CONTENT_TAGS, CONTENT_CLASSES, CONTENT_PARTS = {"article", "main"}, {"article-content", "article-body", "post-content", "entry-content", "detail-content", "news-content", "TRS_Editor", "content"}, ("article_content", "article-content")
FURNITURE_TAGS, FURNITURE_CLASSES = {"script", "style", "noscript", "svg", "nav", "footer", "form", "aside"}, {"nav", "navbar", "menu", "footer", "sidebar", "related", "recommend", "breadcrumb", "share", "advertisement", "cookie"}
# Where a page states its date, in order.
DATE_METAS = ("article:published_time", "publishdate", "date", "DC.date.issued")
_DATED = re.compile(r"20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}")
_ROUNDUP = re.compile(r"周报|双周报|月报|半月报|季报|盘点|汇总|集锦|一览|动态回顾|roundup|weekly|monthly|digest", re.I)
_EVENT = re.compile(r"中标|签约|签署|开工|并网|投产|投运|承建|总承包|groundbreaking|commissioned|awarded|signed")
_LIST_END = re.compile(r"(?:archive|category|news|press|media|projects?|search|list)", re.I)
_LIST_PATH = re.compile(r"(?:^|/)(?:archive|category|search|list|page)(?:/|$)", re.I)
_ARTICLE_TYPE = re.compile(r"Article|NewsArticle|Report|BlogPosting", re.I)
_SHELL = re.compile(r"enable javascript|javascript is required|id=[\"'](?:root|app|__next)[\"'][^>]*>\s*</div>", re.I)
_BLANK = re.compile(r"\s+")


def squash(text: str) -> str:
    return _BLANK.sub(" ", text).strip()


def date_in(text: str | None) -> str | None:
    """The first date with figures in ``text`` as YYYY-MM-DD, year first before day first; a year and month are its first day."""
    if not text:
        return None
    numbers = re.search(r"20\d\d[年./-]\d\d?(?:[月./-]\d\d?)?", text)
    if numbers:
        y, m, *d = re.findall(r"\d+", numbers[0])
        return f"{y}-{m:0>2}-{(d or ['01'])[0]:0>2}"
    numbers = re.search(r"(?<!\d)\d\d?[./-]\d\d?[./-]20\d\d(?!\d)", text)
    if numbers:
        d, m, y = re.findall(r"\d+", numbers[0])
        return f"{y}-{m:0>2}-{d:0>2}"
    return None


class _Reader(HTMLParser):
    """The elements of a page in order: tag, attributes, parent, and the span of the page's text that each covers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.spans: list[list[int]] = []
        self.pieces: list[tuple[int, str]] = []  # (element, text)
        self.open: list[int] = []
        self.length = 0

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parents.append(self.open[-1] if self.open else -1)
        self.spans.append([len(self.pieces), len(self.pieces)])
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[at]] == tag:
                for element in self.open[at:]:
                    self.spans[element][1] = len(self.pieces)
                del self.open[at:]
                break

    def handle_data(self, data):
        self.pieces.append((self.open[-1] if self.open else -1, data))

    def unknown_decl(self, data):  # <![CDATA[...]]>
        self.pieces.append((self.open[-1] if self.open else -1, data.removeprefix("CDATA[")))


class Page:
    """A parsed page; elements are numbers in the order of their start tags."""

    def __init__(self, html: str):
        self.html = html
        r = _Reader()
        try:
            r.feed(html)
            r.close()
        except (AssertionError, ValueError):  # broken declarations: what was read so far is the page
            pass
        for element in r.open:
            r.spans[element][1] = len(r.pieces)
        self.tags, self.attrs, self.parents, self.spans, self.pieces = r.tags, r.attrs, r.parents, r.spans, r.pieces
        n = len(self.tags)
        self.hidden = [False] * n  # inside furniture
        self.code = [False] * n  # inside script or style
        for i in range(n):
            p = self.parents[i]
            classes = set(self.attrs[i].get("class", "").split())
            own = self.tags[i] in FURNITURE_TAGS or self.attrs[i].get("aria-hidden") == "true" or bool(classes & FURNITURE_CLASSES)
            self.hidden[i] = own or (p >= 0 and self.hidden[p])
            self.code[i] = self.tags[i] in ("script", "style") or (p >= 0 and self.code[p])

    def text(self, element: int, clean: bool = False) -> str:
        """The text below an element, or the page's for -1; ``clean`` leaves furniture out. Scripts and styles count only within themselves."""
        a, b = self.spans[element] if element >= 0 else (0, len(self.pieces))
        inside_code = element >= 0 and self.code[element]
        keep = lambda e: e < 0 or not (self.hidden[e] if clean else self.code[e] and not inside_code)
        return "".join(t for e, t in self.pieces[a:b] if keep(e))

    def find(self, *tags: str) -> list[int]:
        return [i for i, t in enumerate(self.tags) if t in tags]

    def below(self, element: int, *tags: str) -> list[int]:
        """Elements of these tags within the element, furniture left out."""
        out = []
        inside = {element}
        for i in range(element + 1, len(self.tags)):
            if self.parents[i] not in inside:
                if self.parents[i] < element:
                    break
                continue
            inside.add(i)
            if self.tags[i] in tags and not self.hidden[i]:
                out.append(i)
        return out

    def meta(self, name: str) -> str:
        for i in self.find("meta"):
            if name in (self.attrs[i].get("property"), self.attrs[i].get("name")):
                return self.attrs[i].get("content", "")
        return ""

    def body(self) -> int:
        return next(iter(self.find("body")), -1)

    def containers(self) -> list[int]:
        """The elements that may hold the content, in order."""
        out = []
        for i, tag in enumerate(self.tags):
            a = self.attrs[i]
            names = a.get("class", "")
            if not self.hidden[i] and (tag in CONTENT_TAGS or a.get("role") == "main" or a.get("id") == "zoom" or set(names.split()) & CONTENT_CLASSES or any(p in names for p in CONTENT_PARTS)):
                out.append(i)
        return out

    def structured(self) -> dict:
        """What embedded JSON-LD says: whether an article, the longest body, the first headline, dates."""
        out = {"article": False, "body": "", "headline": "", "dates": []}
        for i in self.find("script"):
            if self.attrs[i].get("type") != "application/ld+json":
                continue
            try:
                stack = [json.loads(self.text(i))]
            except ValueError:
                continue
            while stack:
                x = stack.pop()
                if isinstance(x, list):
                    stack += x[::-1]
                elif isinstance(x, dict):
                    kinds = x.get("@type", "")
                    out["article"] |= any(_ARTICLE_TYPE.search(str(k)) for k in (kinds if isinstance(kinds, list) else [kinds]))
                    if isinstance(x.get("articleBody"), str) and len(x["articleBody"]) > len(out["body"]):
                        out["body"] = x["articleBody"]
                    if isinstance(x.get("headline"), str) and not out["headline"]:
                        out["headline"] = x["headline"]
                    out["dates"] += [v for k, v in x.items() if k.lower() in ("datepublished", "datecreated") and isinstance(v, str)]
                    stack += list(x.values())[::-1]
        return out

    def links(self, url: str) -> list[tuple[str, str, str | None]]:
        """``(address, label, date nearby)`` of every link, those of data stores in scripts too."""
        out = []
        for i in self.find("a"):
            if href := address(self.attrs[i].get("href", ""), url) if self.attrs[i].get("href") else "":
                label = squash(self.text(i))
                near, at = label, self.parents[i]
                while at >= 0:
                    if self.tags[at] in ("article", "li", "div"):
                        near = f"{label} {squash(self.text(at))}"
                        break
                    at = self.parents[at]
                out.append((href, label, date_in(near[:600]) or date_in(urlsplit(href).path)))
        for i in self.find("script"):
            if self.attrs[i].get("type") == "text/xml" and "href" in (inner := self.text(i)):
                out += Page(unescape(inner.replace("<![CDATA[", "").replace("]]>", ""))).links(url)
        return out


def clean_title(value: str) -> str:
    """A title without mark-up and entities written into it."""
    if re.search(r"<[a-zA-Z][\s\S]*?>|&[a-zA-Z#0-9]+;", value):
        value = Page(value).text(-1)
    return squash(value)


def parse(html: str, url: str) -> dict:
    """Title, body, dates, type and features of a page."""
    page = Page(html)
    body = page.body()
    plain = page.text(body)
    said = page.structured()
    dates = [m for m in map(page.meta, DATE_METAS) if m]
    dates += [page.attrs[i]["datetime"] for i in page.find("time") if page.attrs[i].get("datetime")][:1] + said["dates"]
    path = urlsplit(url).path
    if not dates:
        found = re.search(r"20\d{2}[/-]\d{1,2}[/-]\d{1,2}", path) or _DATED.search(plain)
        dates = [found[0]] if found else []
    candidates = list(dict.fromkeys(x for x in map(date_in, dates) if x))
    first = lambda tag: next((page.text(i).strip() for i in page.find(tag)), "")
    title = clean_title(said["headline"] or page.meta("og:title") or first("h1") or first("title") or url)
    best, top, method = body, None, "body-fallback"
    for i in page.containers():
        text = squash(page.text(i, clean=True))
        if len(text) < 120:
            continue
        links = sum(len(_BLANK.sub(" ", page.text(a, clean=True))) for a in page.below(i, "a"))
        score = len(text) + 180 * len(page.below(i, "p")) + 60 * len(page.below(i, "h1", "h2", "h3")) - 2.5 * links
        if top is None or score > top:
            best, top, method = i, score, "content-density"
    content = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", page.text(best, clean=True).replace("\xa0", " "))).strip()
    if len(said["body"]) > 0.7 * len(content):
        content, method = said["body"], "json-ld-articleBody"
    content = content[:MAX_TEXT]
    articles, links = len(page.find("article")), [i for i in page.find("a") if "href" in page.attrs[i]]
    dated = sum("datetime" in a or t == "time" for t, a in zip(page.tags, page.attrs)) + len(_DATED.findall(plain))
    segments = [s for s in path.split("/") if s]
    root = not segments
    listing_path = bool(segments and _LIST_END.fullmatch(segments[-1]) or _LIST_PATH.search(path))
    published = candidates[0] if candidates else None
    og = bool(re.search("article", page.meta("og:type"), re.I))
    paragraphs = len(page.below(best, "p")) if best >= 0 else len(page.find("p"))
    article = said["article"] or og or (articles == 1 and paragraphs >= 1 and (bool(published) or len(content) >= 500) and not root) or (bool(published) and len(content) >= 350 and dated < 8 and not root and not listing_path)
    listing = articles >= 3 or dated >= 8 or (listing_path and len(links) >= 12)
    roundup = not root and not listing_path and len(content) >= 800 and (bool(_ROUNDUP.search(title)) or (dated >= 8 and len(_EVENT.findall(content[:60_000])) >= 6))
    kind = "roundup" if roundup else "article" if article else "homepage" if root else "listing" if listing else "unknown"
    letters = len(squash(plain))
    prose = max((len(squash(page.text(i, clean=True))) for i in page.find("p", "h1", "h2", "h3") if not page.hidden[i]), default=0)
    held = any(len(squash(page.text(i, clean=True))) >= 120 for i in page.containers())
    return {
        "title": title,
        "published_at": published,
        "date_candidates": candidates,
        "date_evidence": dates[0] if dates else "",
        "page_type": kind,
        "method": method,
        "text": content,
        "links": len(links),
        "longest_prose": prose,
        "needs_render": letters < 500 or len(links) < 3 or bool(_SHELL.search(html)),
        "fake_thick": letters >= 2000 and not held and prose < 300,
    }


DOCUMENT = "title string, published_at string, date_candidates array<string>, date_evidence string, page_type string, method string, text string, links int, longest_prose int, needs_render boolean, fake_thick boolean"


def documents(pages: DataFrame, key: str = "raw_path") -> DataFrame:
    """The document of each page (``key``, url, html): its columns are ``DOCUMENT``.

    Null pages and addresses have no row; empty ones are documents without a body; broken mark-up gives what can be read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([parse(h, u) for h, u in zip(batch["html"], batch["url"])], columns=[c.split()[0] for c in DOCUMENT.split(", ")])
            yield out.assign(**{key: batch[key].to_numpy()})[[key, *out.columns]]

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "url", "html").where("html IS NOT NULL AND url IS NOT NULL").mapInPandas(run, f"{key} {kind}, {DOCUMENT}")


def links(pages: DataFrame, key: str = "raw_path") -> DataFrame:
    """``key, from_url, href, label, hint``: the links of each page with the date that stands nearby."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, u, *link) for k, u, h in zip(batch[key], batch["url"], batch["html"]) for link in Page(h).links(u)]
            yield pd.DataFrame(rows, columns=[key, "from_url", "href", "label", "hint"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "url", "html").where("html IS NOT NULL AND url IS NOT NULL").mapInPandas(run, f"{key} {kind}, from_url string, href string, label string, hint string")


_PREFIX = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- ", "blockquote": "> "}


def blocks(html: str) -> list[str]:
    """A page's headings, paragraphs, list items, quotes and code as Markdown blocks, neighbours that repeat each other once."""
    page = Page(html)
    root = next(iter([*page.find("article"), *page.find("main"), page.body()]))
    out: list[str] = []
    for i, tag in enumerate(page.tags):
        if tag not in ("h1", "h2", "h3", "h4", "p", "li", "blockquote", "pre") or (root >= 0 and not (root < i and page.spans[root][0] <= page.spans[i][0] and page.spans[i][1] <= page.spans[root][1])):
            continue
        text = squash(page.text(i))
        line = f"```\n{text}\n```" if tag == "pre" else _PREFIX.get(tag, "") + text
        if len(text) >= 2 and (not out or out[-1] != line):
            out.append(line)
    return out


def markdown(pages: DataFrame, key: str = "raw_path") -> DataFrame:
    """``key, place, block``: the blocks of each page in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, n, b) for k, h in zip(batch[key], batch["html"]) for n, b in enumerate(blocks(h))], columns=[key, "place", "block"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "html").where("html IS NOT NULL").mapInPandas(run, f"{key} {kind}, place int, block string")
