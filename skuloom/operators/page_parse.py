"""Web pages to element rows: the one Python stage of the page jobs.

Each page becomes a long list of elements (meta, link, image, table row, script values, visible text).  All rules
run on that table as column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "page_id long, seq int, kind string, name string, value string, alt string, title string, context string, "
    "width int, height int"
)
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]

# Attributes that hold an image link; script words; key words of sizes and images.
IMAGE_ATTRS = ("src", "data-src", "data-original", "data-image", "data-zoom", "data-large")
CONTEXT_ATTRS = ("id", "class", "data-testid", "aria-label", "role")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SIZE_WORDS = ("dimension", "width", "height", "depth", "size")
IMAGE_KEYS = ("image", "media", "photo", "thumbnail", "gallery", "src", "url")
LINK_TEXT = re.compile(
    r"(?:https?:)?//[^\s\"'<>\\]+|/[A-Za-z0-9_./%~!$&()*+,;=:@-]+\.(?:jpe?g|png|webp|gif|bmp|avif)(?:\?[^\s\"'<>\\]*)?",
    re.IGNORECASE,
)
BACKGROUND = re.compile(r"url\((['\"]?)(.*?)\1\)", re.IGNORECASE)


def _number(value) -> int | None:
    found = re.search(r"\d+", value or "")
    return int(found.group(0)) if found else None


def _load(text: str):
    """JSON of a script, also when it is assigned to a variable."""
    for part in (text.strip(), text[text.find("{") : text.rfind("}") + 1]):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


def _leaves(node, key=""):
    """(key, text) of every string or number leaf."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, str(k))
    elif isinstance(node, list):
        for v in node:
            yield from _leaves(v, key)
    elif isinstance(node, (str, int, float)) and not isinstance(node, bool):
        yield key, node


def _product(node) -> dict:
    todo = node if isinstance(node, list) else [node]
    while todo:
        at, *todo = todo
        if isinstance(at, dict):
            if "product" in str(at.get("@type", "")).lower():
                return at
            todo += at.get("@graph", []) if isinstance(at.get("@graph"), list) else []
    return {}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.hold: dict[str, list] = {}
        self.label = ""
        self.cells: list[str] | None = None

    def add(self, kind, name="", value="", alt="", title="", context="", width=None, height=None):
        self.rows.append((kind, name, value, alt, title, context, width, height))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        own = " ".join(a[x] for x in CONTEXT_ATTRS if a.get(x)).lower()
        context = " ".join(x for x in [own, *[c for _, c in reversed(self.open[-3:])]] if x)
        if tag == "meta":
            self.add("meta", (a.get("property") or a.get("name") or "").lower(), a.get("content", ""))
        elif tag == "img":
            size = {"width": _number(a.get("width")), "height": _number(a.get("height"))}
            more = {"alt": a.get("alt", ""), "title": a.get("title", ""), "context": context}
            for attr in IMAGE_ATTRS:
                if a.get(attr):
                    self.add("image", "img", a[attr], **more, **size)
            self.srcset("img_srcset", a.get("srcset", ""), size["width"], size["height"], more)
        elif tag == "source":
            self.srcset("source_srcset", a.get("srcset", ""), None, None, {"context": context})
        elif tag == "link":
            self.add("link", "", a.get("href", ""))
        elif tag == "a":
            self.hold["a"] = [a.get("href", ""), ""]
        elif tag == "script":
            self.hold["script"] = [a.get("type", "").lower(), a.get("id", ""), ""]
        elif tag in ("dt", "dd", "title"):
            self.hold[tag] = [""]
        elif tag in ("td", "th"):
            self.hold["cell"] = [""]
        elif tag == "tr":
            self.cells = []
        if a.get("style"):
            for hit in BACKGROUND.finditer(a["style"]):
                self.add("image", "css_background", hit.group(2), context=context)
        if tag not in VOID:
            self.open.append((tag, own))

    def srcset(self, kind, srcset, width, height, more):
        for part in srcset.split(","):
            bits = part.split()
            if bits:
                wide = re.match(r"(\d+)w", bits[1], re.IGNORECASE) if len(bits) > 1 else None
                self.add("image", kind, bits[0], width=int(wide.group(1)) if wide else width, height=height, **more)

    def handle_data(self, data):
        inside = self.open[-1][0] if self.open else ""
        if inside == "script" and "script" in self.hold:
            self.hold["script"][2] += data
            return
        if inside in ("style", "template", "script"):
            return
        self.text.append(data)
        for key in ("a", "dt", "dd", "title", "cell"):
            if key in self.hold:
                self.hold[key][-1] += data

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break
        if tag == "a" and "a" in self.hold:
            href, label = self.hold.pop("a")
            self.add("link", label.strip(), href)
        elif tag == "script" and "script" in self.hold:
            self.script(*self.hold.pop("script"))
        elif tag == "title" and "title" in self.hold:
            self.add("title", "", self.hold.pop("title")[0].strip())
        elif tag == "dt" and "dt" in self.hold:
            self.label = self.hold.pop("dt")[0].strip().lower()
        elif tag == "dd" and "dd" in self.hold:
            self.add("dl", self.label, self.hold.pop("dd")[0].strip())
            self.label = ""
        elif tag in ("td", "th") and "cell" in self.hold and self.cells is not None:
            self.cells.append(self.hold.pop("cell")[0].strip())
        elif tag == "tr" and self.cells is not None:
            if len(self.cells) >= 2:
                self.add("table", self.cells[0].lower(), self.cells[1])
            self.cells = None

    def script(self, kind, ident, text):
        low, data = text.lower(), _load(text)
        source = (
            "next_data" if ident == "__NEXT_DATA__"
            else "shopify_json" if "shopify" in low
            else "json_ld" if kind == "application/ld+json"
            else "embedded_json"
        )
        image_source = "json_ld_image" if source == "json_ld" else source
        if data is not None:
            leaves = list(_leaves(data))
            sized = [f"{k}: {v}" for k, v in leaves if k]
            plain = [str(v) for _, v in leaves if isinstance(v, str)]
            self.add("script", source, "\n".join(sized + plain))
            for key, value in leaves:
                if isinstance(value, str) and any(w in key.lower() for w in IMAGE_KEYS):
                    self.add("image", image_source, value)
            if source == "json_ld":
                node = _product(data)
                brand = node.get("brand")
                brand = brand.get("name", "") if isinstance(brand, dict) else brand
                for name, value in (("name", node.get("name")), ("brand", brand), ("category", node.get("category"))):
                    if isinstance(value, str) and value.strip():
                        self.add("product", name, value.strip())
        elif any(w in low for w in SIZE_WORDS):
            self.add("script", source, text)
        if source != "json_ld" or any(w in low for w in ("image", "media", "gallery", "product")):
            for hit in LINK_TEXT.finditer(text.replace("\\/", "/")):
                self.add("image", image_source, hit.group(0))


def elements_of(html: str) -> list[tuple]:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.add("text", "", " ".join(t for t in page.text))
    return page.rows


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [
            (page_id, seq, *row)
            for page_id, html in zip(pdf["page_id"], pdf["html"])
            for seq, row in enumerate(elements_of(html))
        ]
        frame = pd.DataFrame(out, columns=FIELDS)
        yield frame.astype({"width": "Int64", "height": "Int64"})


def page_elements(pages: DataFrame) -> DataFrame:
    """(page_id, seq, kind, name, value, ...) of every page."""
    return pages.select("page_id", "html").mapInPandas(_pages, SCHEMA)
