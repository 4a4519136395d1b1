"""HTML pages to structured rows: one Arrow pass that parses each page once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.text import OTHER_PIXELS, PIXELS, _simhash
from pagequarry.functions.urls import normalise

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template svg math".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_MIXED_MOST, _ANCHOR_MOST = 50, 500
_ROBOT_NAMES = ("robots", "googlebot")


class _Tree(HTMLParser):
    """An element tree of whatever HTML comes; unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES and self.open[-1].tag in _CLOSES[tag]:
            self.open.pop()
        node = ET.SubElement(self.open[-1], tag, {k: v if v is not None else "" for k, v in reversed(attrs)})
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        node = self.open[-1]
        if len(node):
            node[-1].tail = (node[-1].tail or "") + data
        else:
            node.text = (node.text or "") + data


def parse(html: str | None) -> ET.Element:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def text_of(node: ET.Element, hidden: frozenset[str] = frozenset(), separator: str = "") -> str:
    """All text below a node in order, without hidden elements."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in hidden or x is node:
            rest: list = [x.text] if x.text else []
            for child in x:
                rest.append(child)
                if child.tail:
                    rest.append(child.tail)
            stack.extend(reversed(rest))
    return separator.join(parts)


def _flat(text: str) -> str:
    return " ".join(text.split())


def _syllables(words: list[str]) -> int:
    total = 0
    for w in words:
        n = len(re.findall("[aeiouy]+", w))
        total += max(n - (1 if w.endswith("e") and n > 1 else 0), 1)
    return total


def link_type(url: str, base_host: str, cdn_hosts: tuple[str, ...] = ()) -> str:
    host = urlsplit(url).netloc.lower()
    return "internal" if host == base_host or host.endswith("." + base_host) or host in cdn_hosts else "external"


_META_CHARSET = re.compile(r"""<meta\s+charset=["']?([^"'>\s]+)""", re.I)
_META_CONTENT = re.compile(r"""<meta[^>]+content=["'][^"']*charset=([^"';\s]+)""", re.I)


def charset_of(body: bytes, content_type: str | None) -> str:
    """The encoding that the header names, else a meta tag in the first 4096 bytes, else UTF-8."""
    for part in (content_type or "").split(";"):
        name, _, value = part.strip().lower().partition("=")
        if name == "charset" and value.strip(" \"'"):
            return value.strip(" \"'")
    head = body[:4096].decode("ascii", errors="ignore")
    found = _META_CHARSET.search(head) or _META_CONTENT.search(head)
    return found.group(1) if found else "utf-8"


def decode_body(body: bytes | None, content_type: str | None = None) -> str | None:
    """A page's bytes as text; what can't be decoded becomes U+FFFD, an unknown encoding counts as UTF-8."""
    if body is None:
        return None
    try:
        return bytes(body).decode(charset_of(bytes(body), content_type), errors="replace")
    except LookupError:
        return bytes(body).decode("utf-8", errors="replace")


@F.pandas_udf(T.StringType())
def decoded(bodies: pd.Series, content_types: pd.Series) -> pd.Series:
    return pd.Series([decode_body(b, t if isinstance(t, str) else None) for b, t in zip(bodies, content_types, strict=True)], dtype=object)


def is_html_body(content_type: str | None, html: str | None, most: int = 10 * 2**20) -> bool:
    media = (content_type or "text/html").split(";")[0].strip().lower()
    return media in ("text/html", "application/xhtml+xml") and bool(html) and len(html) <= most


def page_row(html: str | None, url: str, content_type: str | None = None, status: int | None = 200, cdn_hosts: tuple[str, ...] = ()) -> dict:
    """Everything the audit reads from one page; a page that isn't HTML or is empty has no content and is not indexable."""
    row: dict = {n: None for n, _ in FIELDS}
    if not is_html_body(content_type, html):
        row |= {"is_indexable": False, "indexability_reason": "non_html" if not status or status < 300 else _status_reason(status), "links": [], "images": [], "word_count": None}
        return row
    root, base_host = parse(html), urlsplit(url).netloc.lower()
    nodes = list(root.iter())
    of = lambda *tags: [n for n in nodes if n.tag in tags]
    metas, rels = of("meta"), [(n, n.get("rel", "").lower().split()) for n in of("link")]

    titles = of("title")
    if titles:
        row["title"] = text_of(titles[0]).strip() or None
    row["title_count"] = len(titles)
    if row["title"]:
        row["title_length"] = len(row["title"])
        row["title_pixel_width"] = round(round(sum(PIXELS[ord(c) - 32] if 32 <= ord(c) <= 126 else OTHER_PIXELS for c in row["title"]), 6))
    named = lambda *names: [m for m in metas if m.get("name", "").lower() in names]
    descriptions = named("description")
    row["meta_desc_count"] = len(descriptions)
    if descriptions:
        row["meta_description"] = descriptions[0].get("content", "").strip() or None
        row["meta_desc_length"] = len(row["meta_description"] or "")
    robots = named(*_ROBOT_NAMES)
    row["robots_meta_tag_count"] = len(robots)
    row["robots_meta"] = list(dict.fromkeys(x.strip().lower() for m in robots for x in m.get("content", "").split(",") if x.strip()))
    row["viewport"] = next((m.get("content") for m in named("viewport") if m.get("content")), None)
    canonicals = [n for n, r in rels if "canonical" in r and n.get("href")]
    row["canonical_count"] = len(canonicals)
    row["canonical_url"] = normalise(canonicals[0].get("href"), url) if canonicals else None

    heads = of("h1", "h2", "h3", "h4", "h5", "h6")
    row["heading_sequence"] = [h.tag for h in heads]
    for level in ("h1", "h2"):
        row[level] = [t for t in (_flat(text_of(h)) for h in heads if h.tag == level) if t]

    links = []
    for n in nodes:
        if n.tag == "a" and n.get("href") is not None:
            target = normalise(n.get("href"), url)
            if target:
                links.append({"url": target, "anchor": _flat(text_of(n))[:_ANCHOR_MOST], "kind": link_type(target, base_host, cdn_hosts), "rel": n.get("rel", "").lower().split()})
    for n, where in [*((n, n.get("href")) for n, r in rels if "stylesheet" in r), *((n, n.get("src")) for n in of("script", "iframe"))]:
        target = normalise(where, url) if where else None
        if target:
            links.append({"url": target, "anchor": "", "kind": "resource", "rel": []})
    row["links"] = links
    row["images"] = [
        {"src": src, "alt": n.get("alt", ""), "width": n.get("width"), "height": n.get("height"), "srcset": n.get("srcset")}
        for n in of("img")
        for src in [normalise(n.get("src") or n.get("data-src"), url)]
        if src
    ]
    row["hreflang"] = [{"lang": n.get("hreflang"), "href": n.get("href")} for n, r in rels if "alternate" in r and n.get("hreflang") and n.get("href")]
    for rel in ("next", "prev"):
        some = [n.get("href") for n, r in rels if rel in r and n.get("href")]
        row[f"{rel}_count"], row[f"rel_{rel}"] = len(some), normalise(some[0], url) if some else None
    blocks = []
    for n in of("script"):
        if n.get("type", "").strip().lower() == "application/ld+json":
            try:
                blocks.append(json.dumps(json.loads(text_of(n)), ensure_ascii=False))
            except ValueError:
                continue
    row["json_ld"] = blocks
    row["og"] = [(m.get("property")[3:], m.get("content", "")) for m in metas if m.get("property", "").startswith("og:")]
    row["og"] = list(dict(row["og"]).items())

    mixed = []
    if url.startswith("https://"):
        wheres = [n.get("src", "") for n in of("img", "script", "iframe")] + [n.get("href", "") for n, r in rels if "stylesheet" in r]
        wheres += [x.split()[0] for n in of("img") for x in n.get("srcset", "").split(",") if x.strip()]
        mixed = [w for w in wheres if w.startswith("http://")][:_MIXED_MOST]
    row["mixed_content_urls"] = mixed

    body = next(iter(of("body")), None)
    text = text_of(body, _HIDDEN, " ") if body is not None else ""
    words = text.split()
    row["word_count"] = len(words)
    if words:
        flat = " ".join(words)
        row["text_ratio"] = round(len(flat) / max(len(html), 1), 4)
        if len(words) >= 30:
            sentences = max(sum(1 for p in re.split(r"[.!?]+\s+|\n", flat) if p.strip()), 1)
            per = len(words) / sentences
            row["avg_words_per_sentence"] = round(per, 1)
            row["readability_score"] = max(0.0, min(100.0, round(206.835 - 1.015 * per - 84.6 * _syllables([w.lower() for w in words]) / len(words), 1)))
        if len(words) >= 50:
            row["simhash"] = _simhash(flat)
    row["is_indexable"], row["indexability_reason"] = indexability(row["robots_meta"], status, row["canonical_url"], url)
    return row


def _status_reason(status: int | None) -> str:
    return "redirect" if status and status < 400 else "client_error" if status and status < 500 else "server_error"


def indexability(robots: list[str], status: int | None, canonical: str | None, url: str) -> tuple[bool, str | None]:
    """Whether a page can be indexed and, if not, the first reason: directive, status, another canonical address."""
    if "noindex" in robots:
        return False, "noindex"
    if "none" in robots:
        return False, "none"
    if status is not None and status >= 300:
        return False, _status_reason(status)
    if canonical and canonical.rstrip("/").lower() != url.rstrip("/").lower():
        return False, "canonicalized"
    return True, None


_LINKS = "array<struct<url:string,anchor:string,kind:string,rel:array<string>>>"
FIELDS = [
    ("title", "string"), ("title_count", "int"), ("title_length", "int"), ("title_pixel_width", "int"), ("meta_description", "string"), ("meta_desc_count", "int"), ("meta_desc_length", "int"),
    ("robots_meta", "array<string>"), ("robots_meta_tag_count", "int"), ("viewport", "string"), ("canonical_url", "string"), ("canonical_count", "int"), ("h1", "array<string>"), ("h2", "array<string>"),
    ("heading_sequence", "array<string>"), ("links", _LINKS), ("images", "array<struct<src:string,alt:string,width:string,height:string,srcset:string>>"), ("hreflang", "array<struct<lang:string,href:string>>"),
    ("rel_next", "string"), ("rel_prev", "string"), ("next_count", "int"), ("prev_count", "int"), ("json_ld", "array<string>"), ("og", "map<string,string>"), ("mixed_content_urls", "array<string>"),
    ("word_count", "int"), ("text_ratio", "double"), ("readability_score", "double"), ("avg_words_per_sentence", "double"), ("simhash", "bigint"), ("is_indexable", "boolean"), ("indexability_reason", "string"),
]


def extract(pages: DataFrame, url: str = "url", html: str = "html", content_type: str | None = None, status: str | None = None, cdn_hosts: tuple[str, ...] = ()) -> DataFrame:
    """url and every extracted field of stored HTML; nothing is shuffled and pages are read whole.

    Null or empty HTML gives a row without content.  Columns of ``pages``
    other than the named ones aren't read.
    """
    chosen = pages.select(F.col(url).alias("url"), F.col(html).alias("html"), (F.col(content_type) if content_type else F.lit("text/html")).alias("type"), (F.col(status) if status else F.lit(200)).cast("int").alias("status"))
    schema = ", ".join(["url string", *(f"{n} {t}" for n, t in FIELDS)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"url": r["url"]} | page_row(r["html"], r["url"] or "", r["type"], r["status"], cdn_hosts) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return chosen.mapInArrow(run, schema)


_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[^\]]+\])*)$")


def _matches(node: ET.Element, step: str) -> bool:
    m = _STEP.match(step)
    if not m or not step:
        raise ValueError(f"selector step {step!r}")
    if m.group(1) and m.group(1) != "*" and node.tag != m.group(1).lower():
        return False
    for x in re.findall(r"[#.][\w-]+|\[[^\]]+\]", m.group(2) or ""):
        if x[0] == "#" and node.get("id") != x[1:] or x[0] == "." and x[1:] not in node.get("class", "").split():
            return False
        if x[0] == "[":
            a = re.match(r"\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]$", x)
            if not a:
                raise ValueError(f"selector {x!r}")
            value, op, want = node.get(a.group(1)), a.group(2), a.group(3)
            if value is None or (op and not {"=": value == want, "~=": want in value.split(), "^=": value.startswith(want), "$=": value.endswith(want), "*=": want in value, "|=": value == want or value.startswith(want + "-")}[op]):
                return False
    return True


def css(root: ET.Element, selector: str) -> list[ET.Element]:
    """Elements by a subset of CSS: type, *, #id, .class, [attribute op value], descendant and child, comma."""
    parents = {c: p for p in root.iter() for c in p}
    found: dict[ET.Element, None] = {}
    for one in selector.split(","):
        steps = re.sub(r"\s*>\s*", " > ", one.strip()).split()

        def fits(node, i) -> bool:
            if not _matches(node, steps[i]):
                return False
            if i == 0:
                return True
            up = parents.get(node)
            if steps[i - 1] == ">":
                return up is not None and fits(up, i - 2)
            while up is not None:
                if fits(up, i - 1):
                    return True
                up = parents.get(up)
            return False

        for node in root.iter():
            if node is not root and fits(node, len(steps) - 1):
                found[node] = None
    order = {n: i for i, n in enumerate(root.iter())}
    return sorted(found, key=order.get)


def xpath(root: ET.Element, path: str) -> list:
    """Elements or texts by a subset of XPath: steps, positions and attribute tests as ElementTree knows them, a final @attribute or text()."""
    tail = re.search(r"/(@[\w:-]+|text\(\))$", path)
    inner = path[: tail.start()] if tail else path
    nodes = root.findall("." + inner if inner.startswith("/") else inner)
    if not tail:
        return nodes
    if tail.group(1) == "text()":
        return [n.text for n in nodes if n.text]
    return [n.get(tail.group(1)[1:]) for n in nodes if n.get(tail.group(1)[1:]) is not None]


def pick(root: ET.Element, html: str, method: str, selector: str, extract_type: str = "text", attribute: str = "") -> str | None:
    """The first match of one extractor as text; None for none and for a selector that can't be read."""
    try:
        if method == "regex":
            m = re.search(selector, html)
            return (m.group(1) if m.lastindex else m.group(0)) if m else None
        found = xpath(root, selector) if method == "xpath" else css(root, selector)
    except (ValueError, SyntaxError, KeyError, re.error):
        return None
    if extract_type == "count":
        return str(len(found))
    if not found:
        return None
    first = found[0]
    if isinstance(first, str):
        return first
    if extract_type == "attribute" and attribute:
        return first.get(attribute)
    if extract_type == "html":
        return ET.tostring(first, encoding="unicode", method="html").strip()
    return text_of(first).strip()


def custom_extractions(pages: DataFrame, extractors: list[dict], url: str = "url", html: str = "html") -> DataFrame:
    """url, extractor_id, value: one row per page and extractor (id, method, selector, extract_type, attribute_name) that found something."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for u, h in zip(batch["url"], batch["html"], strict=True):
                root = parse(h)
                for e in extractors:
                    value = pick(root, h or "", e.get("method", "css"), e["selector"], e.get("extract_type", "text"), e.get("attribute_name", ""))
                    if value is not None:
                        rows.append((u, str(e["id"]), value))
            yield pd.DataFrame(rows, columns=["url", "extractor_id", "value"], dtype=object)

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, extractor_id string, value string")


def custom_searches(pages: DataFrame, text: str, searches: list[dict], keep: list[str]) -> DataFrame:
    """keep, search_id, found, triggered: occurrences of each pattern (id, pattern, is_regex, case_sensitive, contains), counted without Python."""
    if any(not s["pattern"] for s in searches):
        raise ValueError("a search needs a pattern")
    rows = []
    for s in searches:
        body = F.coalesce(F.col(text), F.lit(""))
        if s.get("is_regex"):
            n = F.regexp_count(body, F.lit(s["pattern"] if s.get("case_sensitive") else f"(?i){s['pattern']}"))
        else:
            where, what = (body, F.lit(s["pattern"])) if s.get("case_sensitive") else (F.lower(body), F.lit(s["pattern"].lower()))
            n = ((F.length(where) - F.length(F.replace(where, what, F.lit("")))) / F.length(what)).cast("int")
        rows.append(F.struct(F.lit(str(s["id"])).alias("search_id"), n.alias("found"), ((n > 0) == F.lit(bool(s.get("contains", True)))).alias("triggered")))
    return pages.select(*keep, F.explode(F.array(*rows)).alias("x")).select(*keep, "x.*")
