"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: nodes are element paths (tags with their classes), and each node
collects how its children are presented and what they contain on all pages. A node whose presentation and content
hardly vary from page to page, by their normalized entropy, has low importance: it is the site's frame. All nodes with
text take part, menus and footers too, and importance judges first. Pages of equal nodes are one page to the tree, however
often a host repeats them. What entropy cannot see (comments and adverts that vary, frames of hosts with few pages) is
told by its tag, or by names that importance, links or place confirm.
"""

from __future__ import annotations

import html as entities
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from llm.common import stash

LEAST_IMPORTANCE = 0.2
LEAST_NODES = 8  # of one path on a host, before its entropy means anything
HINT_IMPORTANCE = 0.6  # below it a branch whose name says frame is one
BROADCAST_PATHS = 2_000_000  # judged paths of all hosts (8 bytes each) that are sent to all executors; beyond, joined by page

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+|\d+")
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul caption".split()
)
_GONE = frozenset(
    "head script style title textarea noscript iframe xmp noembed noframes template svg math nav footer aside form button "
    "select option dialog menu object embed audio video canvas map input label fieldset search".split()
)
#: Words in class, id or role that hint at what a branch is.
_FRAME = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar rail aside widget widgets cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup login register search form share sharing social "
    "comment comments disqus reply replies discussion related recommended recommendations trending popular pagination pager "
    "copyright toolbar complementary contentinfo skip".split()
)
#: Words of the list that sections of articles are named by too; they need a second word.
_TOPIC = frozenset("alert comment discussion form menu popular promotion rail register related reply search share sharing social subscription trending".split())
#: Words that may stand beside one of the list without changing what it says.
_BESIDE = frozenset(
    "area articles bar block bottom box buttons container content footer group icons inner items left link links list main media page "
    "pages panel posts primary right secondary section site slot stories thread top unit wrap wrapper".split()
)
_MAIN = frozenset(("article", "main"))
_PLACED = frozenset("div section table ul ol dl center details".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPE = frozenset("ul ol dl table div section article aside nav main body select td th".split())


_KEPT, _TREE, _TAG, _NAME = range(4)  # what removed a branch


def _hash(text: str) -> int:
    return xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _says(names: list[str]) -> int:
    """0 if no name hints at the frame, 1 if a part of one does, 2 if one says nothing else."""
    says = 0
    for name in names:
        parts = [p for p in _PART.findall(name) if not p.isdigit()]
        words = [p for p in parts if p in _FRAME]
        if words:
            plain = len(parts) == 1 and parts[0] not in _TOPIC
            says = max(says, 2 if plain or len(parts) > 1 and all(p in _FRAME or p in _BESIDE for p in parts) else 1)
    return says


class Page:
    """The nodes and text runs of one page. A path is a hash of the parent's path and the node's own name."""

    def __init__(self, source: str):
        self.parent, self.path, self.style = array("q", [-1]), array("q", [0]), array("q", [0])
        self.tag, self.says, self.hidden, self.holds_main, self.holds_title = [""], bytearray(1), bytearray(1), bytearray(1), bytearray(1)
        self.runs: list[tuple[int, int, str]] = []  # (block, node, text)
        self._places: dict[int, int] = {}
        self._read(source)
        for i in range(len(self.tag) - 1, 0, -1):
            up, tag = self.parent[i], self.tag[i]
            self.holds_main[up] |= self.holds_main[i] or tag in _MAIN
            self.holds_title[up] |= self.holds_title[i] or tag == "h1"

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        names, own, hidden = [], "", False
        if attributes.strip():
            for name, value in _NAMES.findall(attributes):
                value, name = value.strip("\"'").lower(), name.lower()
                if name == "style":
                    hidden |= "display:none" in value.replace(" ", "")
                elif name == "hidden" or name == "aria-hidden":
                    hidden |= name == "hidden" or value == "true"
                else:
                    names += value.split()
                    own += "." + value if name == "class" else ""
        number = ""
        if tag in _PLACED:  # containers differ by place, paragraphs and items do not
            key = _hash(f"{parent} {tag}{own}")
            number = self._places[key] = self._places.get(key, 0) + 1
        self.parent.append(parent)
        self.tag.append(sys.intern(tag))
        self.says.append(_says(names) if names else 0)
        self.path.append(_hash(f"{self.path[parent]} {tag}{own}{number}"))
        self.style.append(0)
        self.style[parent] = _hash(f"{self.style[parent]} {tag}{own}")
        self.hidden.append(hidden), self.holds_main.append(0), self.holds_title.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, block, at, opened = [0], 0, 0, Counter()

        def end_from(k: int) -> None:
            opened.subtract(self.tag[n] for n in stack[k:])
            del stack[k:]

        while True:
            m = _TOKEN.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                self.runs.append((block, stack[-1], entities.unescape(text) if "&" in text else text))
            if not m:
                return
            at, closing, tag = m.end(), m[1], (m[2] or "").lower()
            if not tag:
                continue
            if tag in _BLOCKS:
                block += 1
            if closing:
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if self.tag[stack[k]] == tag:
                        end_from(k)
                        break
                continue
            if tag == "br":
                self.runs.append((block, stack[-1], " "))
            if tag in _BLOCKS:  # an open paragraph ends where a block begins
                for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                    if self.tag[stack[k]] == "p":
                        end_from(k)
                        break
                    if self.tag[stack[k]] in _SCOPE:
                        break
            ends = _CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1) if ends else ():
                if self.tag[stack[k]] in ends:
                    end_from(k)
                elif self.tag[stack[k]] in _SCOPE:
                    break
            if tag in _RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in _VOID and (tag in _BLOCKS or tag in _GONE or m[3].strip()) and not (m[3].endswith("/") and tag not in _BLOCKS):
                stack.append(self._open(stack[-1], tag, m[3]))
                opened[tag] += 1

    def judged(self, low: frozenset[int] = frozenset(), hinted: frozenset[int] = frozenset()) -> bytearray:
        """Per node what removed it or a node above it: the tree (low paths), its tag, its confirmed names, or nothing.

        The page, nodes that hold an article or main part, and headlines are never removed but by their tag. Names are
        confirmed by low importance (hinted paths), by links that make up most of the branch, or, if they say nothing
        else, by place: the branch stands beside the text, holding less than half of it.
        """
        size, by = len(self.tag), bytearray(len(self.tag))
        within = bytearray(size)  # 1 in an article, 2 in another main part
        for i in range(1, size):
            up, tag = self.parent[i], self.tag[i]
            within[i] = within[up] or (1 if tag == "article" else 2 if tag == "main" else 0)
            own = tag in _GONE or self.hidden[i] or (tag == "header" and within[i] != 1)
            spared = self.holds_main[i] or tag in _MAIN or tag in ("html", "body", "h1")
            by[i] = by[up] or (_TREE if self.path[i] in low and not spared else _TAG if own else _KEPT)
        if not any(self.says):
            return by
        chars, linked = array("q", bytes(8 * size)), array("q", bytes(8 * size))
        for _, node, text in self.runs:
            if not by[node]:
                chars[node] += len(text.strip())
        for i in range(size - 1, 0, -1):
            linked[i] = chars[i] if self.tag[i] == "a" else linked[i]
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        whole = array("q", [chars[0]]) * size  # text of the article around a node
        for i in range(1, size):
            up, tag = self.parent[i], self.tag[i]
            whole[i] = chars[i] if tag == "article" and within[up] != 1 else whole[up]
            if by[up]:
                by[i] = by[up]
            elif not by[i] and self.says[i] and not (self.holds_main[i] or self.holds_title[i] or tag in _MAIN or tag in ("html", "body", "h1")):
                most = 2 * linked[i] > chars[i] if self.says[i] == 2 or not within[i] else 5 * linked[i] > 4 * chars[i]
                if self.path[i] in hinted or most or self.says[i] == 2 and 2 * chars[i] < whole[i]:
                    by[i] = _NAME
        return by

    def nodes(self) -> list[tuple[int, int, int]]:
        """(path, presentation, content) of all nodes that hold text; the content is a hash of their own and their children's."""
        content = [""] * len(self.tag)
        for _, node, text in self.runs:
            text = " ".join(text.split())
            if text:
                content[node] = f"{_hash(content[node] + text)} "
        for i in range(len(self.tag) - 1, 0, -1):
            if content[i]:
                content[self.parent[i]] = f"{_hash(content[self.parent[i]] + content[i])} "
        found = [i for i in range(1, len(self.tag)) if content[i]]
        return [(self.path[i], self.style[i], int(content[i])) for i in found]

    def told_apart_by(self) -> int:
        """Hash of the text outside the frame, as far as the page alone tells it; copies differ in adverts and dates of menus."""
        gone = self.judged()
        return _hash("\n".join(x for x in (" ".join(t.split()) for _, n, t in self.runs if not gone[n]) if x))

    def text(self, low: frozenset[int] = frozenset(), hinted: frozenset[int] = frozenset()) -> str:
        """Blocks of the article in page order, without the frame and branches of low importance."""
        gone = self.judged(low, hinted)
        inside = [False] * len(self.tag)
        for kind in ("article", "main"):
            for i in range(1, len(self.tag)):
                inside[i] = inside[self.parent[i]] or (self.tag[i] == kind and not gone[i])
            if any(inside[n] and not gone[n] and t.strip() for _, n, t in self.runs):
                break
        else:
            inside = [True] * len(self.tag)
        blocks: dict[int, list[str]] = {}
        for block, node, text in self.runs:
            if inside[node] and not gone[node]:
                blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(b for b in joined if b)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, page, nodes): what tells the page apart, and its nodes as longs of 8 bytes end to end."""
    for b in batches:
        rows = []
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            page = Page(source or "")
            nodes = np.array(page.nodes(), np.int64).tobytes()
            if nodes:
                rows.append((host, page.told_apart_by(), nodes))
        kinds = (pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "page", "nodes"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, page, path, style, content), one per node."""
    for b in batches:
        pages = [np.frombuffer(n, np.int64).reshape(-1, 3) for n in b.column(2).to_pylist()]
        row = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        nodes = np.concatenate([np.zeros((0, 3), np.int64), *pages])
        cols = [b.column(k).take(pa.array(row)) for k in (0, 1)] + [pa.array(nodes[:, k]) for k in range(3)]
        yield pa.RecordBatch.from_arrays(cols, names=["host", "page", "path", "style", "content"])


def style_tree(pages: DataFrame) -> DataFrame:
    """Rows (host, path, nodes, importance) of the merged trees of all hosts, over the different pages of each.

    A path that only one page has says nothing about the site; its importance is 1. The entropy of n nodes with values counted c is log n - sum(c log c) / n; divided by log n it is 1 if all differ
    and 0 if all are equal. Importance is the larger one of presentation and content.
    """
    merged = pages.where("host <> ''").select("host", "html").mapInArrow(_merged, "host string, page long, nodes binary")
    different = merged.groupBy("host", "page").agg(F.min("nodes").alias("nodes")).select("host", "page", "nodes")
    nodes = different.mapInArrow(_apart, "host string, page long, path long, style long, content long")
    one = [F.min("page").alias("least"), F.max("page").alias("most")]
    counted = stash(nodes.groupBy("host", "path", "style", "content").agg(F.count("*").alias("n"), *one), "tree")

    def entropy(value: str) -> DataFrame:
        each = counted.groupBy("host", "path", value).agg(F.sum("n").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
        whole = each.groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
        spread = F.when(F.col("least") < F.col("most"), 1 - F.col("s") / (F.col("n") * F.log(F.col("n").cast("double")))).otherwise(1.0)
        return whole.select("host", "path", F.col("n").alias("nodes"), spread.alias(value))

    return entropy("content").join(entropy("style").drop("nodes"), ["host", "path"]).select(
        "host", "path", "nodes", F.greatest("content", "style").alias("importance")
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low, hinted = ([frozenset(x or ()) for x in b.column(b.num_columns - k).to_pylist()] for k in (2, 1))
        texts = [Page(p or "").text(x, y) for p, x, y in zip(b.column(0).to_pylist(), low, hinted, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[1:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*b.schema.names[1:-2], "main_text", "main_chars"],
        )


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, key, path), one per different path of a page."""
    for b in batches:
        rows = [(h, k, p) for h, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True) for p in sorted(set(Page(s or "").path[1:]))]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "key", "path"])


def _with_judged(pages: DataFrame, frame: DataFrame) -> DataFrame:
    """``pages`` with the arrays ``low`` and ``hinted`` of judged paths: those of the host, or, where all hosts have too many
    for a broadcast, those that the page itself has."""
    per = [F.collect_set(F.when(F.col("low"), F.col("path"))).alias("low"), F.collect_set(F.when(~F.col("low"), F.col("path"))).alias("hinted")]
    if frame.count() <= BROADCAST_PATHS:
        return pages.join(F.broadcast(frame.groupBy("host").agg(*per)), "host", "left")
    keyed = pages.withColumn("key", F.xxhash64("html"))
    own = keyed.where("host <> ''").select("host", "key", "html").mapInArrow(_paths, "host string, key long, path long")
    judged = own.distinct().join(frame, ["host", "path"]).groupBy("host", "key").agg(*per)
    return keyed.join(judged, ["host", "key"], "left")


def main_text(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``df`` without its html column, with ``text`` and ``n_chars`` (replaced if present), one row per row.

    NULL or empty pages give empty texts. Pages without a host are read on their own. Pages of a host with equal
    text outside their frames weigh once. Paths that a host has seldom are never judged by entropy, nor are the article
    itself and its headline. An empty table gives an empty result; other columns stay.
    """
    cols = [c for c in df.columns if c not in (html, "text", "n_chars")]
    pages = df.select(F.col(f"`{html}`").alias("html"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], host_of(F.col(f"`{url}`")).alias("host"))
    tree = style_tree(pages.select("host", "html"))
    judged = tree.where((F.col("nodes") >= LEAST_NODES) & (F.col("importance") < HINT_IMPORTANCE))
    frame = stash(judged.select("host", "path", (F.col("importance") < LEAST_IMPORTANCE).alias("low")), "frame")
    joined = _with_judged(pages, frame)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    kept = [f"c{i}" for i in range(len(cols))]
    schema = ", ".join([*(f"c{i} {types[c]}" for i, c in enumerate(cols)), "main_text string", "main_chars long"])
    out = joined.select("html", *kept, "low", "hinted").mapInArrow(_texts, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))
