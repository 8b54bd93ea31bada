"""Main text of web pages, by removal of site templates.

Every page is parsed into elements, and each element's subtree (tag, class, text, children) is
hashed. Spark counts per host in how many pages with different content a subtree stands; those
in at least `least_pages`, and in `least_share` of the host's or in `MANY` whatever their share (a box of one section of a
large site), are the site's template, and each page first loses its template subtrees, whatever they are. In what is left, menus, headers, footers,
sidebars, notices, adverts, forms and scripts go by element, role and class, where a site has too few
pages to show a template or an element differs from page to page. Reader comments go by their names, always.

Then the article is chosen: the main element; or else article elements, if they hold at least
`ARTICLE_SHARE` of the characters that are left and, where there are several, the largest holds more than stands outside of all
(teasers next to a story do not); in either case with the first-level headings before it. Else it is what stands outside of
article elements. Class names do not hide an article that is longer than all else that is left, and what goes for its
class alone stays if nothing else does, unless it is named a menu, sidebar, footer or the like. A form goes, but for an
article within it, or paragraphs of `FORM_TEXT` characters where the whole page is one.

Pages of a host that repeat one article do not make it a template: a page's content is known by
that of its text blocks which stands in the fewest of the host's pages, so copies count as one
whatever the template around them, and a notice that is longer than the articles hides none of
them. Short blocks (dates, counters) do not tell content apart: under `OWN` letters and digits, or
a fiftieth of the page's longest block; a page of these alone is known by its longest, the first of equals. Text blocks
within an article (paragraphs, headings, lists' items) are never taken for a template, as a
passage that many articles quote is part of each of them.

Only hashes move: a row per page with those of its blocks and subtrees, the pages of each block
counted, then (host, subtree, content) per container element, summed before and after a shuffle. Templates are broadcast up to
`BROADCAST` hashes; beyond that, the subtrees of each page are joined to them one by one, so a host with any number of
pages and template subtrees is dealt to many tasks.

Defined results: a null or empty html has an empty text. A null url counts as a host of its own
name, and a null page_id is kept as it is. An empty table has an empty result. Broken markup is read as browsers do, roughly: unclosed elements end with their parents, in
time that grows with the page's length alone.
Repeated rows count once and come back repeated. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import arrow_batch, materialize, pick, settled, slices

BROADCAST = 1_000_000
MANY = 50
OWN, OWN_SHARE = 20, 0.02
ARTICLE_SHARE = 0.2
FORM_TEXT = 200
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# HTML's elements by kind, and words in classes and ids that name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption summary address tr tbody thead tfoot".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("head script style noscript template nav footer aside button select textarea iframe svg object canvas menu dialog input datalist audio video map math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NOISE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations pagination pager toolbar login "
    "search skip hidden outbrain taboola".split()
)
#: Such names never hold the article; those of NOISE may, if nothing else is left (a layout's class, say).
NEVER = frozenset("comment comments commentlist commentarea commentbox commentform commentsection discussion discussions talkback guestbook disqus respond reply replies ad ads adv advert adverts advertisement adsense sponsored cookie cookies consent gdpr popup newsletter outbrain taboola".split())
#: And neither do elements whose names end in these.
BARE = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar pagination pager login share sharing social".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
            "tbody": ("tr", "td", "th", "tbody", "thead", "tfoot"), "thead": ("tr", "td", "th", "tbody", "thead", "tfoot"), "tfoot": ("tr", "td", "th", "tbody", "thead", "tfoot")}
SCOPE = frozenset("table ul ol dl select html body article section div aside nav footer header main form".split())


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Element:
    """around: the block that it stands in, None for the page; drop: goes for what it is; gone: it or an element around it does; doubtful:
    so does its class or one around it; bare: and that names a menu or the like; header, form, main: within such; article: the outermost
    one that it is in (an article may be a main element)."""

    __slots__ = ("tag", "around", "drop", "gone", "doubtful", "bare", "header", "form", "article", "main", "parts", "key", "word")

    def __init__(self, tag: str, parent: Element | None, around: Element | None, word: str):
        self.tag, self.around, self.word = tag, around, word
        self.drop, self.key, self.parts = False, 0, []
        self.gone = self.doubtful = self.bare = self.main = self.header = self.form = False
        self.article: Element | None = None
        if parent:
            self.gone, self.doubtful, self.bare, self.main, self.header, self.form, self.article = parent.gone, parent.doubtful, parent.bare, parent.main, parent.header, parent.form, parent.article
        self.header |= tag == "header"


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        out.setdefault(m[1].lower(), entities.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


def _is_noise(element: Element, attrs: dict[str, str]) -> bool:
    """By tag, role or being hidden."""
    if element.tag in DROPPED or element.tag == "header" and not element.article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    return attrs.get("role", "").lower() in ROLES


def _names(element: Element, attrs: dict[str, str]) -> set[str]:
    """Words in class and id. Names like has-sidebar tell of what is next to the element."""
    return {w.lower() for n in _own_names(element, attrs) for w in (n, *WORDS.findall(n))}


def _own_names(element: Element, attrs: dict[str, str]) -> list[str]:
    if not attrs or element.tag in ("html", "body", "main"):
        return []
    return [n for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if not n.lower().startswith(("has-", "with-", "no-", "without-"))]


def _ends_bare(name: str) -> bool:
    return name.lower() in BARE or bool((found := WORDS.findall(name)) and found[-1].lower() in BARE)


class Page:
    """Elements and text blocks of one page."""

    def __init__(self, source: str):
        self.elements: list[Element] = []
        self.blocks: list[tuple[Element, str]] = []
        self._parse(source)

    def _parse(self, s: str) -> None:
        root = Element("", None, None, "")
        open_, now = [root], []
        held: list[list[str]] = []
        block_of = root
        # where elements of each tag, scopes and blocks stand in open_, so that none is looked for
        where: dict[str, list[int]] = {}
        scopes, blocks = [0], [0]

        def deepest(tag: str) -> int:
            """Of the open elements of a tag; 0 if there is none."""
            found = where.get(tag)
            return found[-1] if found else 0

        def flush() -> None:
            if held:  # within an inline element that goes
                now.clear()
            if now:
                text = " ".join(entities.unescape("".join(now)).split())
                now.clear()
                if text:
                    self.blocks.append((block_of, text))
                    block_of.parts.append(text)

        def close(depth: int) -> None:
            """Ends the elements above depth."""
            nonlocal block_of
            while len(open_) > depth:
                e = open_.pop()
                where[e.tag].pop()
                if e.tag in SCOPE:
                    scopes.pop()
                if e.tag in BLOCK:
                    flush()
                    blocks.pop()
                    block_of = open_[blocks[-1]]
                    if e.parts:
                        e.key = _hash("\0".join([e.tag, e.word, *e.parts]))
                        block_of.parts.append(str(e.key))
                elif e.drop:
                    now.clear()
                    now.extend(held.pop())

        at, n, find, last = 0, len(s), TOKEN.search, s.rfind(">") + 1
        while at < n:
            m = find(s, at, last)  # behind the last > there is no tag
            if m is None:
                rest = s.find("<!--", max(at, last))
                now.append(s[at:] if rest < 0 else s[at:rest])
                break
            if m.start() > at:
                now.append(s[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if s.startswith("<!--", m.start()) and not m[0].endswith(("-->", "--!>")) and m[0] != "<!-->":
                    break  # a comment that does not end
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                depth = deepest(tag)
                if depth and (tag in SCOPE or tag in BLOCK or depth > scopes[-1]):
                    close(depth)
                continue
            if open_[-1].tag == "head" and tag not in IN_HEAD:
                close(len(open_) - 1)
            if tag == "br":
                now.append(" ")
                continue
            if tag in ENDS_P:
                depth = deepest("p")
                if depth > scopes[-1]:
                    close(depth)
            for other in SIBLINGS.get(tag, ()):
                depth = deepest(other)
                if depth > scopes[-1]:
                    close(depth)
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            attrs = _attributes(m[3] or m[6]) if (m[3] or m[6] or "").strip(" \t\r\n/") else {}
            e = Element(tag, open_[-1], None if block_of is root else block_of, attrs.get("class", ""))
            outside = e.article is None
            e.main = e.main or tag == "main" or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
            if outside and (e.main or tag == "article" or attrs.get("role") == "article"):
                e.article = e
            e.form = e.form or tag == "form" or attrs.get("role") == "form"
            names = _names(e, attrs)
            if not outside:
                names.discard("discussion")  # a part of a paper, say
            # a piece of opinion may be called a comment
            e.drop = _is_noise(e, attrs) or bool(names & NEVER) and tag != "article"
            e.gone = e.gone or e.drop
            named = bool(names & (NOISE | NEVER))
            e.doubtful = e.doubtful or named
            e.bare = e.bare or named and (bool(names & NEVER) and tag != "article" or any(map(_ends_bare, _own_names(e, attrs))))
            e.drop = e.drop or named and tag not in BLOCK
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(s, at)
                if tag == "iframe" or tag in DROPPED or tag == "title":
                    pass
                else:
                    now.append(s[at : end.start()] if end else s[at:])
                at = end.end() if end else n
                continue
            if tag in BLOCK:
                flush()
                block_of = e
                self.elements.append(e)
                blocks.append(len(open_))
            elif e.drop:  # an inline element that goes: its text does not reach the block
                held.append(list(now))
                now.clear()
            if tag in SCOPE:
                scopes.append(len(open_))
            where.setdefault(tag, []).append(len(open_))
            open_.append(e)
        close(1)
        flush()

    def kept(self, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
        """Blocks of the article, in page order."""
        return self.reduced(template)[0]

    def reduced(self, template: frozenset[int] | set[int]) -> tuple[list[str], int]:
        """(blocks of the article, template subtrees that the page lost: the outermost ones). The template
        goes first. What goes for its class alone stays if nothing else is left."""
        known: dict[Element | None, bool] = {None: False}
        lost = 0
        for e in self.elements if template else ():  # in page order, so a parent's turn is before its children's
            inside = known[e.around]
            known[e] = inside or (e.key in template and self.candidate(e))
            lost += known[e] and not inside

        left = [(e, text) for e, text in self.blocks if not e.gone and not (e.header and e.tag not in HEADINGS) and not known.get(e)]
        left = self.outside_forms(left)
        clear = [b for b in left if not b[0].doubtful]
        named = [b for b in left if b[0].doubtful and not b[0].bare]
        articles = [b for b in named if b[0].article]
        if not any(e.article for e, _ in clear) and self.size(articles) > self.size(clear):
            return self.article_in(articles), lost
        return self.article_in(clear) or self.article_in(named), lost

    @staticmethod
    def size(left: list[tuple[Element, str]]) -> int:
        return sum(len(t) for _, t in left)

    @classmethod
    def outside_forms(cls, left: list[tuple[Element, str]]) -> list[tuple[Element, str]]:
        """Without forms, but for articles within them; a page that is a form keeps its text."""
        kept = [b for b in left if not b[0].form or b[0].article and b[0].article.form]
        return left if not kept and cls.size([b for b in left if b[0].tag in TEXT_BLOCK]) >= FORM_TEXT else kept

    @classmethod
    def article_in(cls, left: list[tuple[Element, str]]) -> list[str]:
        """A page's main element is its article; article elements are if they have the weight."""
        main = any(e.main for e, _ in left)
        inside = [e.main if main else e.article is not None for e, _ in left]
        if not any(inside):
            return [t for _, t in left]
        if not main:
            sizes: dict[Element, int] = {}
            for e, t in left:
                if e.article:
                    sizes[e.article] = sizes.get(e.article, 0) + len(t)
            total = cls.size(left)
            outside = total - sum(sizes.values())
            if total - outside < ARTICLE_SHARE * total or len(sizes) > 1 and outside > max(sizes.values()):
                return [t for (_, t), own in zip(left, inside, strict=True) if not own]
        first = inside.index(True)
        return [t for i, (e, t) in enumerate(left) if inside[i] or i < first and e.tag == "h1"]

    def candidate(self, e: Element) -> bool:
        return bool(e.key) and e.tag not in ("html", "body", "article", "main") and not (e.article is not None and e.tag in TEXT_BLOCK)

    def keys(self) -> set[int]:
        return {e.key for e in self.elements if self.candidate(e)}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def telling(kept: list[str]) -> dict[str, int]:
    """The blocks that tell a page's content from others', with their letters and digits: long enough
    ones, or else the longest."""
    sizes = {t: sum(map(str.isalnum, t)) for t in kept or [""]}
    most = max(sizes.values())
    return {t: n for t, n in sizes.items() if n >= max(OWN, OWN_SHARE * most)} or {max(kept or [""], key=len): most}


def templates(pages: DataFrame, least_pages: int = 3, least_share: float = 0.1) -> DataFrame:
    """host (a hash), key: subtrees that recur over a host's pages."""
    rows = pick(pages, "url", "html")
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.int64()), ("page", pa.int64()), ("blocks", longs), ("sizes", longs), ("keys", longs)])
        for batch in slices(batches, "html"):
            out: dict[tuple[int, int], tuple[list[int], ...]] = {}
            for url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = _place(url, source)
                if source and at not in out:
                    page = Page(source)
                    sizes = telling(page.kept())
                    out[at] = ([_signed(_hash(t)) for t in sizes], list(sizes.values()), [0, *map(_signed, page.keys())])
            yield arrow_batch([[h for h, _ in out], [p for _, p in out], *([v[k] for v in out.values()] for k in range(3))], schema)

    # a page that several rows repeat counts once
    found = rows.mapInArrow(run, "host long, page long, blocks array<long>, sizes array<long>, keys array<long>")
    found = materialize(found.groupBy("host", "page").agg(*(F.first(c).alias(c) for c in ("blocks", "sizes", "keys"))), "html-pages")
    blocks = found.select("host", "page", F.explode(F.arrays_zip("blocks", "sizes")).alias("b")).select("host", "page", F.col("b.blocks").alias("block"), F.col("b.sizes").alias("size"))
    spread = blocks.groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", -F.col("size"), "block"))["block"]
    content = blocks.join(spread, ["host", "block"]).groupBy("host", "page").agg(rarest.alias("content"))
    seen = found.join(content, ["host", "page"]).select("host", F.explode("keys").alias("key"), "content").distinct()
    counts = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.where((F.col("n") >= least_pages) | (F.col("key") == 0)), "html-counts")
    hosts = counts.where("key = 0").select("host", F.col("n").alias("pages"))
    return counts.where("key <> 0").join(hosts, "host").where((F.col("n") >= least_share * F.col("pages")) | (F.col("n") >= MANY)).select("host", "key")


def extract(pages: DataFrame, least_pages: int = 3, least_share: float = 0.1, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars, n_template (template subtrees that the page lost); a row per row of pages."""
    found = settled(pages.sparkSession, lambda: templates(pages, least_pages, least_share), "html-templates")
    rows = pick(pages, "page_id", "url", "html")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])

    def result(batch: pa.RecordBatch, found: list[tuple[str, int]]) -> pa.RecordBatch:
        fields = pa.schema([(n, batch.column(i).type) for i, n in enumerate(("page_id", "url"))] + [("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64())])
        return arrow_batch([batch.column(0), batch.column(1), [t for t, _ in found], [len(t) for t, _ in found], [n for _, n in found]], fields)

    if found.count() <= broadcast:
        # a size that has been looked at: some 100 MB in a worker at most
        held = pages.sparkSession.sparkContext.broadcast(_by_host(found))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "html"):
                own = held.value
                texts = [article_of(h, own.get(_signed(_hash(host_of(u))), frozenset())) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield result(batch, texts)

        return rows.mapInArrow(run, schema)

    # the template subtrees of each different page, found by a join of its own subtrees
    longs = pa.list_(pa.int64())

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.int64()), ("page", pa.int64()), ("keys", longs)])
        for batch in slices(batches, "html"):
            out = {_place(u, h): h for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) if h}
            yield arrow_batch([[at[0] for at in out], [at[1] for at in out], [[_signed(k) for k in Page(h).keys()] for h in out.values()]], schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [_place(u, h) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int64())], names=["page_id", "url", "html", "host", "page"])

    own = rows.mapInArrow(subtrees, "host long, page long, keys array<long>").groupBy("host", "page").agg(F.first("keys").alias("keys"))
    arrays = own.select("host", "page", F.explode("keys").alias("key")).join(found, ["host", "key"]).groupBy("host", "page").agg(F.collect_list("key").alias("keys"))
    placed = rows.mapInArrow(named, T.StructType([*rows.schema.fields, T.StructField("host", T.LongType()), T.StructField("page", T.LongType())]))
    joined = placed.join(arrays, ["host", "page"], "left").select("page_id", "url", "html", "keys")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [article_of(h, {k % (1 << 64) for k in keys or ()}) for h, keys in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield result(batch, texts)

    return joined.mapInArrow(run_joined, schema)


def _place(url: str | None, source: str | None) -> tuple[int, int]:
    """Hashes of a page's host and of its source."""
    return _signed(_hash(host_of(url))), _signed(_hash(source or ""))


def _by_host(found: DataFrame) -> dict[int, frozenset[int]]:
    out: dict[int, set[int]] = {}
    for host, key in found.collect():
        out.setdefault(host, set()).add(key % (1 << 64))
    return {h: frozenset(k) for h, k in out.items()}


def article_of(source: str | None, template: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """(text, template subtrees lost)."""
    if not source:
        return "", 0
    blocks, lost = Page(source).reduced(template)
    return "\n".join(blocks), lost


def text_of(source: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    return article_of(source, template)[0]
