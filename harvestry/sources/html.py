"""Pages as node tables: the one place where markup is parsed."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, if it is the innermost of its kind that is open.
IMPLIED = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Tags before which an open paragraph ends.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Tags that keep what is implied closed inside them from reaching out.
FENCES = frozenset("ul ol table dl select body html".split())
HEAD = frozenset("title meta link style script base".split())
NODE = "array<struct<node_id: int, end_id: int, parent_id: int, depth: int, tag: string, id: string, classes: array<string>, attrs: map<string, string>, path: string, tok_start: int, tok_len: int, html_start: int, html_len: int>>"
#: The attribute that holds the ``href`` of a link on the URL of its page.
RESOLVED = "@url"
#: Code points of markup whose nodes leave a task at a time.
FLUSH = 4 << 20


def resolved(base: str | None, href: str | None) -> str | None:
    """A reference on its base, without fragment and trailing slash; null if it can't be resolved."""
    href = (href or "").strip()
    try:
        return urldefrag(urljoin(base or "", href))[0].rstrip("/") if href else ""
    except ValueError:
        return None


def plain(text: str) -> str:
    """A text of the parsed page with entities that were written twice resolved too."""
    return unescape(text) if "&" in text else text


class _Nodes(HTMLParser):
    """Nodes in document order; ``end_id`` is one behind the last descendant, tokens are text outside scripts and styles.

    All entities are resolved, also those that were written twice. Links have their URL, and scripts of JSON-LD are kept.
    """

    def __init__(self, markup: str, url: str | None = None):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.nodes: list[dict] = []
        self.scripts: list[str] = []
        self.open: list[dict] = []
        self.tokens: list[str] = []
        self.lines = [0]
        at = markup.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = markup.find("\n", at + 1)
        self.size = len(markup)
        self.feed(markup)
        self.close()
        self._close_from(0, self.size)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _close_from(self, depth: int, at: int) -> None:
        for node in self.open[depth:]:
            if "_text" in node and node["tag"] == "script" and "application/ld+json" in dict(node["attrs"]).get("type", "").lower():
                self.scripts.append("".join(node["_text"]))
            node["end_id"], node["tok_len"], node["html_len"] = len(self.nodes), len(self.tokens) - node["tok_start"], at - node["html_start"]
        del self.open[depth:]

    def _close_implied(self, tag: str, at: int) -> None:
        closes = IMPLIED.get(tag, {"p"} if tag in BLOCKS else set())
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k]["tag"]
            if name in closes:
                self._close_from(k, at)
                if tag != "tr":
                    return
            elif name in FENCES or (name == "div" and tag not in ("li", "td", "tr")):
                return

    def _ensure_body(self, tag: str, at: int) -> None:
        if not self.nodes and tag != "html":
            self._push("html", [], at)
        if tag in ("html", "head", "body"):
            return
        names = [n["tag"] for n in self.open]
        if tag in HEAD and "body" not in names:
            if "head" not in names:
                self._push("head", [], at)
        elif "body" not in names:
            if "head" in names:
                self._close_from(names.index("head"), at)
            self._push("body", [], at)

    def _push(self, tag: str, attrs: list, at: int) -> None:
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, plain(v or ""))
        if tag == "a" and "href" in known and (url := resolved(self.url, known["href"])) is not None:
            known[RESOLVED] = url
        classes = known.get("class", "").split()
        label = tag + (f"#{known['id']}" if known.get("id") else "." + ".".join(classes[:2]) if classes else "")
        path = [*(self.open[-1]["_path"] if self.open else []), label] if tag != "html" else []
        node = {
            "node_id": len(self.nodes), "end_id": len(self.nodes) + 1, "parent_id": self.open[-1]["node_id"] if self.open else -1,
            "depth": len(self.open), "tag": tag, "id": known.get("id"), "classes": classes, "attrs": list(known.items()),
            "path": " > ".join(path[-6:]), "_path": path[-6:], "tok_start": len(self.tokens), "tok_len": 0, "html_start": at,
            "html_len": self.size - at
        }
        self.nodes.append(node)
        self.open.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._at()
        if tag in ("html", "body", "head") and any(n["tag"] == tag for n in self.nodes):
            return
        if tag == "body":
            names = [n["tag"] for n in self.open]
            if "head" in names:
                self._close_from(names.index("head"), at)
        self._close_implied(tag, at)
        self._ensure_body(tag, at)
        self._push(tag, attrs, at)
        if tag in VOID:
            self._close_from(len(self.open) - 1, at + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1]["tag"] == tag:
            self._close_from(len(self.open) - 1, self._at())

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                if tag not in ("html", "body"):
                    self._close_from(k, self._at() + len(tag) + 3)
                return

    def handle_data(self, data: str) -> None:
        inside = self.open[-1]["tag"] if self.open else ""
        if inside in ("script", "style"):
            self.open[-1].setdefault("_text", []).append(data)
            return
        if data.strip() and inside not in HEAD:
            self._ensure_body("#text", self._at())
        if self.open:
            self.tokens.append(plain(data))


def _parsed(markup: str | None, url: str | None = None) -> tuple[list[dict], list[str], list[str], str | None]:
    try:
        found = _Nodes(markup or "", url)
    except Exception as error:  # a page that can't be parsed is a row with an error, and the job goes on
        return [], [], [], f"{type(error).__name__}: {error}"
    return [{k: v for k, v in n.items() if k[0] != "_"} for n in found.nodes], found.tokens, found.scripts, None


def parse_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per page: the columns ``keep``, ``url``, ``html``, and ``nodes``, ``tokens``, ``scripts``, ``error``.

    Nodes are in document order, so that the subtree of a node is the slice from it to ``end_id``, and its text the
    tokens ``tok_start`` to ``tok_start + tok_len``. Missing ``html`` and ``body`` are added, void and implied ends are closed. A link's URL is its attribute
    ``RESOLVED``, ``scripts`` are the bodies of JSON-LD scripts. Null markup is a page without nodes; a page that fails has an ``error`` and no nodes.
    """
    names = ["url", "html", *keep]
    ints = ("node_id", "end_id", "parent_id", "depth")
    node = [(n, pa.int32()) for n in ints] + [
        ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
        ("path", pa.string())
    ]
    node += [(n, pa.int32()) for n in ("tok_start", "tok_len", "html_start", "html_len")]
    kinds = [pa.list_(pa.struct(node)), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, start, size = [], 0, 0
            for k, (url, markup) in enumerate(zip(batch.column("url"), batch.column("html"))):
                out.append(_parsed(markup.as_py(), url.as_py()))
                size += len(markup.as_py() or "")
                if size >= FLUSH or k == batch.num_rows - 1:
                    part = batch.slice(start, k + 1 - start)
                    more = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, "nodes", "tokens", "scripts", "error"])
                    out, start, size = [], k + 1, 0

    rows = pages.select(F.col("url").cast("string"), F.col("html").cast("string"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, nodes {NODE}, tokens array<string>, scripts array<string>, error string")


def node_table(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per node of :func:`parse_pages`, with the text of its subtree."""
    rows = parsed.select(*keep, "tokens", F.explode("nodes").alias("n"))
    return rows.select(*keep, "n.*", F.array_join(F.slice("tokens", F.col("n.tok_start") + 1, F.col("n.tok_len")), " ").alias("text"))
