"""Main text of web pages by wrappers: union-free regular expressions per host.

A page becomes a stream of block tags and text slots.  The streams of a host are
aligned one after the other, parent by parent: children that both have stay,
children that only one has become optional groups, children that come again,
or in another order, become repeated groups, and texts are slots.  Every child
then stands once below its parent, so the expression of a host, such as
``<body> (<nav> (<ul> (<li> # </li>)+ </ul>) </nav>)? <article> ...``, has no
unions, is bounded by the vocabulary of the template (``MOST`` children of a
parent, then their class names are dropped) and matches every page of the host;
alignments can be made in any order and in parts.  Each slot has the number of
its pages, whether all texts of it are links, and each group whether its text is
one constant.

Slots are chosen from the expression, then each page is matched against it and
its text taken from the chosen slots.  A group is left out with all below it when

- its tag is that of a menu, header, footer, sidebar, dialog or form, or the
  first or last word of a class, id or role says so (inline elements too); a
  wrapper so named that is the only place of an article keeps that article;
- it is a container whose text is one constant on at least ``PAGES`` pages and
  half of those of its host, while other slots of the article vary: a template
  text such as share lines.

A page with text of its own in slots below an article or main element has the
text of those; another page that of the slots outside, without menus (slots of
links only).  So a host may mix both kinds of template.

Pages are parsed once.  Expressions are aligned per batch of pages, then per
(host, salt), then per host, so a host with a third of all pages is never in one
task.  All pages take part; none is sampled.

Defined results: null or empty html, or a page without main text, gives an
empty text; a null url is a host of its own; repeated rows give one row each;
unknown character references stay as they are; blocks nested deeper than
``DEPTH`` count to the block at that depth; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from urllib.parse import urlsplit
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, pieces, saved

# Fixed values of the HTML standard (groups of element names).
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())  # their content is no markup
SKIPPED = set("template svg canvas audio video object map select button noscript datalist".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "title"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol menu dl table body html div section article main nav aside form td th blockquote".split())
CONTAINERS = set("article aside blockquote center details div dl fieldset figure footer form header main nav ol section table ul".split())
ASIDE = set("nav header footer aside form head menu dialog search fieldset".split())
#: Words of class names: parts of a page that are never main text, and names that a wrapper of the article may have too.
NEVER = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus respond replies reply cookie cookies "
    "consent newsletter subscribe subscription share sharing social breadcrumb breadcrumbs pagination pager nav navbar navigation".split()
)
SOFT = set("aside sidebar footer masthead topbar menu banner notice notices alert popup modal overlay signup login related recommended widget toolbar promotion".split())
PLACES, WITHOUT = {"site", "page", "global", "top", "header"}, {"has", "no", "with", "without", "is", "hide", "show"}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE, _NAME, _WORD = re.compile(r"\s+"), re.compile(r"[A-Za-z][A-Za-z_-]{0,23}"), re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
SALTS, MOST, DEPTH, PAGES = 64, 64, 32, 5


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def flag(name: str, marks: list[str], inside: bool) -> str:
    """``!`` for what is never main text, ``~`` for a soft mark, else nothing; ``inside`` an article."""
    if name in ("html", "body"):
        return ""
    if name in ASIDE and not (name == "header" and inside):
        return "!"
    out = ""
    for token in marks:
        words = [w.lower() for w in _WORD.split(token) if w]
        if not words or words[0] in WITHOUT or name in ("article", "main") and len(words) > 1:
            continue
        if words[0] in NEVER or words[-1] in NEVER:
            return "!"
        if words[0] in SOFT or words[-1] in SOFT or "header" in (words[0], words[-1]) and words[0] in PLACES and not inside:
            out = "~"
    return out


class Reader:
    """A page as text slots in order: the path of blocks around each, its text, and whether it is a mere link."""

    def __init__(self, page: str) -> None:
        self.slots: list[tuple[str, str, bool]] = []
        self.names: list[str] = []
        self.labels: list[str] = []
        self.text: list[str] = []
        self.hidden: list[str] = []  # of marked inline elements
        self.linked = self.plain = self.link = self.inline = self.skipped = 0
        at = 0
        while m := _TOKEN.search(page, at):
            if m.start() > at:
                self._chars(page[at : m.start()])
            at = max(m.end(), at + 1)
            name = (m[1] or "").lower()
            if not name:
                continue
            if m[0].startswith("</"):
                self._close(name)
            elif name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                self._open(name, m[2])
        self._chars(page[at:])
        self._flush()

    def _chars(self, s: str) -> None:
        if self.skipped or not s:
            return
        if self.inline:
            self.hidden.append(s)
            return
        self.text.append(s)
        n = len(s.strip())
        self.linked += n * bool(self.link)
        self.plain += n * (not self.link)

    def _slot(self, parts: list[str], path: list[str], linked: bool) -> None:
        t = _SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()
        if t:
            self.slots.append(("/".join(path[:DEPTH]), t, linked))

    def _flush(self) -> None:
        if self.text:
            self._slot(self.text, [x for x in self.labels if x[0] != "\0"], self.linked > 0 and not self.plain)
            self.text, self.linked, self.plain = [], 0, 0

    def _pop(self) -> None:
        name, label = self.names.pop(), self.labels.pop()
        if label[0] == "\0":
            self.inline -= 1
            self.skipped -= name in SKIPPED
            if not self.inline:
                self._slot(self.hidden, [x for x in self.labels if x[0] != "\0"] + [label[1:]], False)
                self.hidden = []

    def _open(self, name: str, attrs: str) -> None:
        if name == "br":
            (self.hidden if self.inline else self.text).append(" ")
        if name == "a":
            self.link += 1
        block = name in BLOCKS
        if name in VOID and not block or attrs.endswith("/") and name in SKIPPED:
            return
        marks = [t for a in _ATTR.finditer(attrs) for t in (a[2] or a[3] or a[4] or "").split()]
        inside = "article" in self.names or "main" in self.names
        if not block:
            f = flag(name, marks, inside) if marks else ""
            if f or self.inline or name in SKIPPED:
                self.names.append(name)
                self.labels.append(f"\0{name}{f or '!'}")
                self.inline += 1
                self.skipped += name in SKIPPED
            return
        self._flush()
        while self.inline and self.names[-1] in ("button", "select", "datalist"):  # no block is inside a control: it was left open
            self._pop()
        if name in CLOSES_P and "p" in self.names:
            self._close("p")
        for k in range(len(self.names) - 1, -1, -1):
            if self.names[k] in SAME.get(name, ()):
                while len(self.names) > k:
                    self._pop()
                break
            if self.names[k] in SCOPES:
                break
        if name in VOID:
            return
        sign = next((t for t in marks if _NAME.fullmatch(t)), "") if name in CONTAINERS else ""
        self.link = 0
        self.names.append(name)
        self.labels.append(name + ("." + sign if sign else "") + flag(name, marks, inside))

    def _close(self, name: str) -> None:
        if name == "a":
            self.link = max(0, self.link - 1)
        block = name in BLOCKS
        if block:
            self._flush()
        elif not self.inline:
            return
        for k in range(len(self.names) - 1, -1, -1):
            if self.names[k] == name:
                while len(self.names) > k:
                    self._pop()
                break
            if not block and self.names[k] in BLOCKS:
                break


# An expression: {"n": pages, "kids": {parent: [[label, pages, repeated], ...]}, "slots": {path: [pages, all links]},
# "texts": {container: [pages, checksum of its text or None]}}.


def tag(label: str) -> str:
    return re.split(r"[.!~]", label, maxsplit=1)[0]


def of_page(slots: list[tuple[str, str, bool]]) -> dict:
    """The expression of one page."""
    kids: dict[str, dict] = {"": {}}
    ends: dict[str, str] = {}  # parent to its latest child
    texts: dict[str, int] = {}
    own: dict[str, bool] = {}
    before: list[str] = []
    for path, text, linked in slots:
        labels, parent = path.split("/") if path else [], ""
        fresh = labels == before  # the same leaf again
        for i, label in enumerate(labels):
            known = kids.setdefault(parent, {})
            if label not in known:
                known[label] = False
            elif ends.get(parent) != label or fresh and i == len(labels) - 1:
                known[label] = True
            ends[parent] = label
            parent = f"{parent}/{label}" if parent else label
            if tag(label) in CONTAINERS:
                texts[parent] = crc32(text.encode("utf-8", "surrogatepass"), texts.get(parent, 0))
        own[path] = own.get(path, True) and linked
        before = labels
    return {"n": 1, "kids": {p: [[k, 1, r] for k, r in v.items()] for p, v in kids.items()}, "slots": {p: [1, x] for p, x in own.items()}, "texts": {p: [1, c] for p, c in texts.items()}}


def align(a: list, b: list) -> list:
    """One child list that matches what ``a`` and what ``b`` match; a child in two places becomes a repeated group."""
    out: list = []
    at: dict[str, list] = {}

    def put(x: list, more: int, again: bool) -> None:
        old = at.get(x[0])
        if old is None:
            at[x[0]] = new = [x[0], x[1] + more, x[2] or again]
            out.append(new)
        else:
            old[1], old[2] = old[1] + x[1] + more, True

    for op, i1, i2, j1, j2 in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i1:i2], b[j1:j2], strict=True):
                put(x, y[1], y[2])
        else:
            for x in a[i1:i2] + b[j1:j2]:
                put(x, 0, False)
    return out


def merge(a: dict, b: dict) -> dict:
    """One expression that matches what ``a`` and what ``b`` match."""
    kids = {p: a["kids"][p] if p not in b["kids"] else b["kids"][p] if p not in a["kids"] else _same(a["kids"][p], b["kids"][p]) for p in [*a["kids"], *(p for p in b["kids"] if p not in a["kids"])]}
    slots, texts = dict(a["slots"]), dict(a["texts"])
    for p, (n, linked) in b["slots"].items():
        old = slots.get(p, [0, True])
        slots[p] = [old[0] + n, old[1] and linked]
    for p, (n, c) in b["texts"].items():
        old = texts.get(p, [0, c])
        texts[p] = [old[0] + n, c if c == old[1] else None]
    return bounded({"n": a["n"] + b["n"], "kids": kids, "slots": slots, "texts": texts})


def _same(a: list, b: list) -> list:
    if [x[0] for x in a] == [x[0] for x in b]:
        return [[x[0], x[1] + y[1], x[2] or y[2]] for x, y in zip(a, b, strict=True)]
    return align(a, b)


def plain(label: str) -> str:
    return tag(label) + (label[-1] if label[-1] in "!~" else "")


def bounded(e: dict) -> dict:
    """``e`` with the class names dropped of children whose parent has more than ``MOST``."""
    wide = {p for p, v in e["kids"].items() if len(v) > MOST and any("." in x[0] for x in v)}
    if not wide:
        return e
    out = {"n": e["n"], "kids": {}, "slots": {}, "texts": {}}
    for p, v in e["kids"].items():
        v = align([], [[plain(x[0]), x[1], x[2]] for x in v]) if p in wide else v
        q = general(p, wide)
        out["kids"][q] = align(out["kids"][q], v) if q in out["kids"] else v
    for p, (n, linked) in e["slots"].items():
        old = out["slots"].get(q := general(p, wide), [0, True])
        out["slots"][q] = [old[0] + n, old[1] and linked]
    for p, (n, _) in e["texts"].items():
        q = general(p, wide)
        out["texts"][q] = [out["texts"].get(q, [0])[0] + n, e["texts"][p][1] if q == p else None]
    return bounded(out)


def general(path: str, wide: set[str]) -> str:
    """The path with class names dropped below the parents in ``wide``."""
    out = ""
    for label in path.split("/") if path else ():
        label = plain(label) if out in wide else label
        out = f"{out}/{label}" if out else label
    return out


def expression(e: dict, parent: str = "", n: int | None = None) -> str:
    """The expression in words: ``?`` optional, ``+`` repeated, ``*`` both, ``#`` a text slot."""
    n = e["n"] if n is None else n
    parts = ["#"] if parent in e["slots"] else []
    for label, k, again in e["kids"].get(parent, ()):
        path = f"{parent}/{label}" if parent else label
        sign = {(True, True): "*", (True, False): "?", (False, True): "+", (False, False): ""}[k < n, again]
        body = f"<{label}> {expression(e, path, k)} </{tag(label)}>"
        parts.append(f"({body}){sign}" if sign else body)
    return " ".join(parts)


MAIN, RESCUED, FREE = "main ", "soft ", "free "


def chosen(e: dict) -> list[str]:
    """The slots that hold main text, each with its kind before it."""
    kinds: dict[str, str] = {}
    for path in e["slots"]:
        labels = path.split("/") if path else []
        region = next((i for i, x in enumerate(labels) if tag(x) in ("article", "main") and x[-1] not in "!~"), None)
        marks = [x[-1] for x in labels if x[-1] in "!~"]
        if not marks:
            kinds[path] = FREE if region is None else MAIN
        elif region is not None and "!" not in marks and all(x[-1] != "~" for x in labels[region:]):
            kinds[path] = RESCUED
    constant = [p for p, (n, c) in e["texts"].items() if c is not None and n >= PAGES and 2 * n >= e["n"] and tag(p.rsplit("/", 1)[-1]) not in ("article", "main")]
    constant = [p for p in constant if not any(x.startswith(p + "/") and tag(x.rsplit("/", 1)[-1]) == "h1" for x in kinds)]
    inside = lambda x: any(x == p or x.startswith(p + "/") for p in constant)
    for kind in (MAIN, RESCUED, FREE):
        some = [p for p, k in kinds.items() if k == kind]
        if kind == FREE and any(not e["slots"][p][1] for p in some):
            for p in [p for p in some if e["slots"][p][1]]:
                del kinds[p]
            some = [p for p in some if p in kinds]
        if not all(map(inside, some)):
            for p in some:
                if inside(p):
                    del kinds[p]
    return sorted(k + p for p, k in kinds.items())


def by_path(slots: list[str]) -> dict[str, str | None]:
    """The kinds of the chosen slots."""
    return {s[5:]: s[:5] for s in slots}


def text_of(paths: list[str], texts: list[str], kinds: dict[str, str | None]) -> str:
    """The main text of a page by the kinds of its host's slots; what no expression has is learnt as None."""
    found = []
    for p, t in zip(paths, texts, strict=True):
        if p not in kinds:
            kinds[p] = _loosest(p, kinds)
        k = kinds[p]
        if k:
            found.append((k, t))
    best = min((k for k, _ in found), key=(MAIN, RESCUED, FREE).index, default=None)
    return " ".join(t for k, t in found if k == best)


def _loosest(path: str, kinds: dict[str, str | None]) -> str | None:
    """The kind of the path as the expression has it, where class names were dropped from a level on."""
    labels = path.split("/") if path else []
    for i in range(len(labels)):
        k = kinds.get("/".join(labels[:i] + [plain(x) for x in labels[i:]]))
        if k:
            return k
    return None


_PARSED = "page_id long, url string, host string, paths array<string>, texts array<string>, links array<boolean>"
_EXPRESSION = "host string, salt long, e string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "html"):
        slots = [Reader(x).slots if x else [] for x in b.column("html").to_pylist()]
        hosts = pa.array([host(u) for u in b.column("url").to_pylist()], pa.string())
        lists = [pa.array([[s[i] for s in page] for page in slots], pa.list_(t)) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), hosts, *lists], ["page_id", "url", "host", "paths", "texts", "links"])


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The aligned expression of each host of a batch."""
    for b in batches:
        found: dict[str, dict] = {}
        for h, p, t, x in zip(*[b.column(c).to_pylist() for c in ("host", "paths", "texts", "links")], strict=True):
            e = of_page(list(zip(p, t, x, strict=True)))
            found[h] = merge(found[h], e) if h in found else e
        rows = [(h, crc32(json.dumps([h, e["n"], len(e["slots"]), sorted(e["texts"].items())]).encode()) % SALTS, json.dumps(e)) for h, e in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "salt", "e"])


def _wrap(part: pa.Table) -> pa.Table:
    """Aligns all expressions of a group."""
    whole = None
    for x in sorted(part.column("e").to_pylist()):
        e = json.loads(x)
        whole = e if whole is None else merge(whole, e)
    return pa.table({"host": part.column("host")[:1], "salt": pa.array([0], pa.int64()), "e": pa.array([json.dumps(whole)], pa.string())})


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        es = [json.loads(x) for x in b.column("e").to_pylist()]
        cols = [pa.array([expression(e) for e in es], pa.string()), pa.array([chosen(e) for e in es], pa.list_(pa.string())), pa.array([e["n"] for e in es], pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column("host"), *cols], ["host", "expression", "slots", "n_pages"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds: dict[str, dict] = {}
        texts = []
        for i, (h, p, t) in enumerate(zip(*[b.column(c).to_pylist() for c in ("host", "paths", "texts")], strict=True)):
            if h not in kinds:
                kinds[h] = by_path(b.column("slots")[i].as_py() or [])
            texts.append(text_of(p, t, kinds[h]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def parsed(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, host, and its slots in order: paths, texts, links."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_parse, _PARSED)


def wrappers(slots: DataFrame) -> DataFrame:
    """From parsed pages, per host: host, expression, slots (the chosen ones), n_pages."""
    part = slots.select("host", "paths", "texts", "links").mapInArrow(_expressions, _EXPRESSION)
    for keys in (["host", "salt"], ["host"]):
        part = part.groupBy(*keys).applyInArrow(_wrap, _EXPRESSION)
    return part.mapInArrow(_choose, "host string, expression string, slots array<string>, n_pages long")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    slots = saved(parsed(pages))
    known = saved(wrappers(slots)).select("host", "slots")
    out = joined(slots, known, "host").select("page_id", "url", "host", "paths", "texts", "slots").mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
