"""Operator 1: main text of web pages by wrappers inferred per host.

A page is a stream of block tags and text slots.  Wrappers are union-free regular expressions
over such streams: an element has a sequence of parts, each of which occurs once, optionally
(?), repeatedly (+) or both (*).  Inference starts from one page and aligns the next one with it,
and so on: equal neighbours fold into repeats, a part that only one side has becomes optional,
and differing strings turn a constant into a slot.  Each task first aligns its own pages of a
host, so a host adds at most one partial wrapper per task, whatever its number of pages; the
partial wrappers of a host are then aligned with each other.

The wrapper tells which slots are the article: those under <article> or <main>, or else under the
innermost element that holds most of the host's unlinked text; not those in navigation, header,
footer, aside, form, advert, notice, comment and the like, by tag or by parts of class names (weak
evidence: it does not count against an element that holds most of the host's text), nor slots whose
string is the same on all pages.

Null pages have empty text; broken markup is read leniently (open elements end with their
parents, stray end tags are ignored); a null or odd url is the host ""; repeated rows are
extracted each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm.common import BROADCAST_BYTES, table, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<code>script|style)\b[^>]*>.*?(?:</(?P=code)\s*>|\Z)"
    r"|<(?P<raw>noscript|template|svg|math|iframe|object|textarea|select|title)\b[^>]*>.*?</(?P=raw)\s*>"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends the open element of its own kind (and an open paragraph, if it is no inline tag).
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WITHIN = frozenset("ul ol dl table tbody thead article section div main body".split())
_OFF_TAGS = frozenset("head title nav footer aside form button menu dialog fieldset select textarea svg math iframe object noscript template".split())
#: Parts of a name (it is cut at hyphens and underscores) that tell what is no article: anywhere in the name,
#: or only where the name begins or ends with them.
_OFF_PARTS = frozenset(
    "ad ads advert adverts advertisement adsbygoogle sponsor sponsored sponsors promo promotion sidebar nav navbar navigation menu footer masthead cookie cookies consent gdpr "
    "comment comments commentlist reply replies disqus share sharing social newsletter subscribe signup breadcrumb breadcrumbs pagination pager popup modal overlay hidden".split()
)
_OFF_ENDS = frozenset("banner side header headbar topbar toolbar notice notification alert discussion respond related recommended recommendations login search widget widgets copyright legal disclaimer bar".split())
_STATES = frozenset("has with without no not is js".split())


def _off_name(name: str, inside: bool) -> bool:
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if not parts or parts[0] in _STATES:
        return False
    if any(x in _OFF_PARTS or x.startswith(("advert", "sponsor")) for x in parts):
        return True
    return not (inside and parts[-1] == "header") and (parts[0] in _OFF_ENDS or parts[-1] in _OFF_ENDS)


def _label(tag: str, attrs: str) -> str:
    names = []
    if attrs:
        for key, a, b, c in _NAMED.findall(attrs):
            value, key = (a or b or c).lower(), key.lower()
            if key in ("class", "id", "role"):
                names += re.findall(r"[a-z]+(?:[-_]+[a-z]+)*", value)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                names.append("hidden")
    return ".".join([tag, *sorted(set(names))])


#: Elements below this level count as part of the one at it.
DEPTH = 200


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of block elements, raw text, raw linked text) of each block of text, in page order."""
    out: list = []
    path: list[str] = []
    parts: list[str] = []
    linked, links, at, below = 0, 0, 0, 0

    def close():
        nonlocal linked
        if parts:
            text = "".join(parts)
            if text.strip():
                out.append((tuple(path), text, linked))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("br", "hr"):
            parts.append(" ")
            if tag == "hr":
                close()
        elif tag == "a":
            links = 0 if m["end"] else 1
        elif tag in _INLINE or tag in _VOID:
            continue
        elif m["end"] and below:
            below -= 1
            close()
        elif m["end"]:
            open_tags = [p.split(".")[0] for p in path]
            if tag in open_tags:
                close()
                del path[len(open_tags) - 1 - open_tags[::-1].index(tag) :]
                links = 0
            elif tag == "p":
                close()
        else:
            close()
            links = 0
            ends = _ENDS.get(tag, set()) | {"p"}
            for k in range(len(path) - 1, -1, -1):
                name = path[k].split(".")[0]
                if name in ends:
                    del path[k:]
                elif name in _WITHIN or name not in ends | {"p"}:
                    break
            if m["attr"].endswith("/") and tag not in ("p", "div"):
                continue
            if len(path) < DEPTH:
                path.append(_label(tag, m["attr"]))
            else:
                below += 1
    if at < len(page):
        parts.append(page[at:])
        if links:
            linked += len(page) - at
    close()
    return out


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


# A wrapper's element: [label, often, parts]; often is "", "?", "+" or "*".
# A slot: ["#", often, constant text or None, pages, characters, linked characters].


def _often(a: str, b: str) -> str:
    optional, many = "?" in a + b or "*" in a + b, "+" in a + b or "*" in a + b
    return "*" if optional and many else "?" if optional else "+" if many else ""


def _merge(a: list, b: list) -> list:
    often = _often(a[1], b[1])
    if a[0] == "#":
        return ["#", often, a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], a[5] + b[5]]
    return [a[0], often, align(a[2], b[2])]


def _fold(parts: list) -> list:
    """Equal neighbours become one repeated part."""
    out: list = []
    for p in parts:
        if out and out[-1][0] == p[0]:
            pages = out[-1][3] if p[0] == "#" else 0
            out[-1] = _merge(out[-1], p)
            out[-1][1] = "*" if "?" in out[-1][1] else "+" if out[-1][1] == "" else out[-1][1]
            if p[0] == "#":
                out[-1][3] = pages
        else:
            out.append(p)
    return out


def align(a: list, b: list) -> list:
    """Longest common sequence of labels; a part of one side only is optional."""
    if [p[0] for p in a] == [p[0] for p in b]:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], _often(a[i][1], "?"), *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], _often(b[j][1], "?"), *b[j][2:]])
            j += 1
    return _fold(out)


def wrapper_of(found: list[tuple[tuple[str, ...], str, int]]) -> list:
    """A page's own wrapper: its folded sequence of parts."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    for path, text, linked in found:
        keep = 0
        while keep < len(path) and keep + 1 < len(stack) and stack[keep + 1][0] == path[keep]:
            keep += 1
        # A new block in the same leaf element is a new occurrence of it.
        if keep == len(path) and keep and keep + 1 == len(stack):
            keep -= 1
        del stack[keep + 1 :]
        for label in path[keep:]:
            element: list = [label, "", []]
            stack[-1][1].append(element)
            stack.append((label, element[2]))
        said = clean(text)
        stack[-1][1].append(["#", "", said if len(said) <= 200 else None, 1, len(text), linked])

    def folded(parts: list) -> list:
        for p in parts:
            if p[0] != "#":
                p[2] = folded(p[2])
        return _fold(parts)

    return folded(root)


def regex_of(parts: list) -> str:
    """The wrapper as a readable expression."""
    said = []
    for p in parts:
        if p[0] == "#":
            said.append(("#text" if p[2] is None else json.dumps(p[2], ensure_ascii=False)) + p[1])
        else:
            said.append(f"<{p[0]}>({regex_of(p[2])}){p[1]}")
    return " ".join(said)


def _off(path: tuple[str, ...], kept: frozenset = frozenset()) -> bool:
    """Whether a tag or a name on the path says that this is no article.  The names of the page's
    body and of an outermost <article> or <main> say nothing; nor do those of the elements ``kept``."""
    inside = False
    for k, label in enumerate(path):
        tag, *names = label.split(".")
        outermost = tag in ("html", "body") or (tag in ("article", "main") and not inside)
        if "hidden" in names or tag in _OFF_TAGS or (tag == "header" and not inside):
            return True
        if not outermost and path[: k + 1] not in kept and any(_off_name(x, inside) for x in names):
            return True
        inside |= tag in ("article", "main")
    return False


def _holders(slots: list) -> frozenset:
    """Elements, not off by their tags, that hold most of the host's unlinked text."""
    weight: dict[tuple[str, ...], int] = {}
    for path, s in slots:
        for k in range(1, len(path) + 1):
            weight[path[:k]] = weight.get(path[:k], 0) + max(0, s[4] - 2 * s[5])
    total = sum(max(0, s[4] - 2 * s[5]) for _, s in slots)
    return frozenset(p for p, w in weight.items() if total and w * 10 >= total * 7)


def _slots(parts: list, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], list]]:
    for p in parts:
        if p[0] == "#":
            yield path, p
        else:
            yield from _slots(p[2], (*path, p[0]))


def article_paths(parts: list) -> list[str]:
    """Paths of the slots that hold the article."""
    slots = list(_slots(parts))
    kept = _holders([(path, s) for path, s in slots if not any(x.split(".")[0] in _OFF_TAGS for x in path)])
    live = [(path, s) for path, s in slots if not _off(path, kept)]
    main = [(path, s) for path, s in live if any(x.split(".")[0] in ("article", "main") or "main" in x.split(".")[1:] for x in path)]
    if not main:
        weight: dict[tuple[str, ...], int] = {}
        for path, s in live:
            for k in range(len(path) + 1):
                weight[path[:k]] = weight.get(path[:k], 0) + max(0, s[4] - 2 * s[5])
        total = weight.get((), 0)
        holder = max((p for p, w in weight.items() if w * 10 >= total * 7 and not (p and p[-1].split(".")[0] == "p")), key=lambda p: (len(p), weight[p]), default=())
        same = lambda s: s[2] is not None and s[3] >= 3
        main = [(path, s) for path, s in live if path[: len(holder)] == holder and 2 * s[5] <= s[4] and not same(s)]
    return sorted({"/".join(path) for path, _ in main})


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, expression, paths): one wrapper per host."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = wrapper_of(blocks(page))
                known[host] = align(known[host], own) if host in known else own
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())], ["host", "wrapper"])

    def whole(pdf):
        parts = None
        for w in sorted(pdf["wrapper"]):
            own = json.loads(w)
            parts = own if parts is None else align(parts, own)
        return pdf.iloc[:1][["host"]].assign(expression=regex_of(parts), paths=[article_paths(parts)])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(partial, "host string, wrapper string").groupBy("host").applyInPandas(whole, "host string, expression string, paths array<string>")


def main_text(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.  wrappers: of infer_wrappers, if known."""
    rules = written(infer_wrappers(pages, url_col, html_col) if wrappers is None else wrappers).select("host", "paths")
    size = rules.agg(F.sum(F.length("host") + F.length(F.array_join("paths", "/")))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                good = set(paths or ())
                texts.append("\n\n".join(t for path, raw, _ in blocks(page or "") if "/".join(path) in good and (t := clean(raw))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
