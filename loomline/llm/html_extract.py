"""Main text of web pages: rules for what is no article, and removal of subtrees that recur on many pages of a host."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.spark_io import slices, stored

#: A subtree is template if it is on so many pages of its host, or of one design there, that differ in their text, and on this share
#: of them; inside an article, where lines that many pages share may be its own, on the greater share.
LEAST_PAGES, LEAST_SHARE, INSIDE_SHARE = 5, 0.5, 0.8

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li tbody td tfoot th thead tr".split()) | frozenset(["hr"])
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object embed applet audio video canvas svg math map dialog menu search noframes noembed xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = (
    "ad|ads|advert|adverts|advertisement|advertising|adsense|adslot|adbox|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|pop-up|modal|overlay|"
    "newsletter|subscribe|subscription|signup|sign-up|login|paywall|sidebar|side-bar|sidebars|rail|widget|widgets|related|recommended|recommendations|trending|popular|teaser|teasers|menu|menus|nav|navbar|navigation|topnav|"
    "breadcrumb|breadcrumbs|header|masthead|topbar|footer|copyright|comment|comments|commentlist|respond|reply|replies|disqus|discussion|share|sharing|social|follow|pagination|pager|toolbar|skip-link|skiplink|search|form|tagcloud|disclaimer"
)
#: Outside of articles: one of these words at the start or the end of a class or id, parted from the rest by a dash or underscore.
NAMED = re.compile(rf"(?:^|[\s_-])(?:{PARTS})(?=[\s_-]|$)|(?:^|\s)(?:{PARTS})\d*(?=\s|$)")
#: Inside of articles: a class or id of these words alone, since what an article is about may be part of a name there.
NAMED_WHOLE = re.compile(rf"(?:^|\s)(?:{PARTS})(?:[_-]++(?:{PARTS}))*(?:[_-]*\d+)?(?=\s|$)")
READERS = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies|respond|disqus|discussion)(?=[\s_-]|$)")

# An attribute as browsers read it: a quote opens a value only after an equals sign and runs to the next one like it,
# however long; one that never closes is a character like others. Every part is possessive, so a tag is read once.
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>][^\s>]*+|(?=>)"
_NAME = r"[^\s/>][^\s/>=]*+"
_OTHER = r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>|<(?P<tag>[a-zA-Z][^\s/>]*+)"
_LOST = r"|(?P<lost><(?:[!?]|/?[a-zA-Z]))"
_TOKEN = re.compile(rf"{_OTHER}(?P<attrs>(?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE}))?+)*+)>{_LOST}", re.S)
#: Without quotes, for the rest of a page once a tag has found no end outside of them.
_PLAIN = re.compile(rf"{_OTHER}(?P<attrs>[^>]*+)>{_LOST}", re.S)
_ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WANTED = re.compile(r"class|id\s*=|role|hidden|style", re.I)


class Page:
    """The elements of a page in the order they open, and the texts between tags."""

    def __init__(self, source: str | None):
        self.tags: list[str] = ["#page"]
        self.parents: list[int] = [-1]
        self.names: list[str] = [""]
        self.hidden: list[bool] = [False]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self.children: list[list[int | str]] = [[]]
        #: Where on the stack the open elements of a name are, and the open blocks.
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack, at, seek = [0], 0, 0
        search, last = _TOKEN.search, source.rfind(">") + 1
        while seek < last:
            m = search(source, seek)
            if not m:
                break
            if m["lost"]:
                search, seek = _PLAIN.search, m.start()
                continue
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            if tag := m["tag"]:
                tag = tag.lower()
                node = self._open(stack, tag, m["attrs"])
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    if tag not in DROPPED and end is not None:
                        self._text(node, source[at : end.start()])
                    at = end.end() if end else len(source)
                    self._cut(stack, len(stack) - 1)
            elif tag := m["end"]:
                self._close(stack, tag.lower())
            seek = at
        comment = source.find("<!--", at)
        if text := source[at:comment] if comment >= 0 else source[at:]:
            self._text(stack[-1], text)

    def _text(self, node: int, text: str) -> None:
        self.events.append((node, text))
        self.children[node].append(text)

    def _open(self, stack: list[int], tag: str, attrs: str) -> int:
        tags = self.tags
        if tag in CLOSES_P:
            self._imply(stack, ("p",), ("td", "th", "table", "button", "caption", "object"))
        elif tag == "li":
            self._imply(stack, ("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            self._imply(stack, ("dt", "dd"), ("dl",))
        elif tag == "tr":
            self._imply(stack, ("tr",), ("table",))
        elif tag in ("td", "th"):
            self._imply(stack, ("td", "th"), ("tr", "table"))
        elif tag == "option":
            self._imply(stack, ("option",), ("select",))
        node = len(tags)
        tags.append(tag)
        parent = stack[-1]
        self.parents.append(parent)
        names, hidden = "", False
        if attrs and _WANTED.search(attrs):
            found = {}
            for k, a, b, c in _ATTR.findall(attrs):
                found.setdefault(k.lower(), a or b or c)
            names = f"{found.get('class', '')} {found.get('id', '')}".lower().strip()
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or bool(ROLES & set(found.get("role", "").lower().split()))
        self.names.append(names)
        self.hidden.append(hidden)
        self.children.append([])
        self.children[parent].append(node)
        if tag in BLOCK:
            self.events.append((node, None))
        elif tag in ("br", "wbr"):
            self.events.append((parent, " " if tag == "br" else ""))
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                self.blocks.append(len(stack))
            stack.append(node)
        return node

    def _imply(self, stack: list[int], closed: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        depth = self._deepest(closed)
        if depth and depth > self._deepest(bounds):
            self._cut(stack, depth)

    def _deepest(self, tags: tuple[str, ...]) -> int:
        return max((held[-1] for t in tags if (held := self.depths.get(t))), default=0)

    def _close(self, stack: list[int], tag: str) -> None:
        depth = self._deepest((tag,))
        if depth and (tag in BLOCK or depth > self.blocks[-1]):
            self._cut(stack, depth)
        elif tag == "p":
            self.events.append((stack[-1], None))

    def _cut(self, stack: list[int], depth: int) -> None:
        for node in stack[depth:]:
            tag = self.tags[node]
            self.depths[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                self.events.append((node, None))
        del stack[depth:]

    def hashes(self) -> list[int | None]:
        """Hash of each element's name, texts and elements inside; None for one without text. Attributes don't count."""
        out: list[int | None] = [None] * len(self.tags)
        for node in range(len(self.tags) - 1, 0, -1):
            parts = []
            for c in self.children[node]:
                if isinstance(c, str):
                    if shown := " ".join(c.split()):
                        parts.append(shown)
                elif out[c] is not None:
                    parts.append(f"\x00{out[c]}")
            if parts:
                out[node] = xxhash.xxh64_intdigest("\x01".join((self.tags[node], *parts)).encode("utf-8", "surrogatepass")) - (1 << 63)
        return out

    def _holds(self, head: bool) -> list[bool]:
        """Whether an element is or holds an article or the main element or, if ``head``, a first-level heading."""
        wanted = ("main", "h1") if head else ("main",)
        out = [t in wanted or t == "article" and not READERS.search(n) for t, n in zip(self.tags, self.names)]
        for node in range(len(out) - 1, 0, -1):
            if out[node]:
                out[self.parents[node]] = True
        return out

    def kept(self, template: Iterable[int] = (), sure: Iterable[int] = ()) -> list[bool]:
        """Whether an element belongs to the main text by the rules and the host's template subtrees; ``sure`` are those that count inside an article."""
        template, sure = frozenset(template), frozenset(sure)
        hashes = self.hashes() if template else None
        main, holder = self._holds(True), self._holds(False)
        keep, article = [True], [False]
        for node in range(1, len(self.tags)):
            tag, names, parent = self.tags[node], self.names[node], self.parents[node]
            inside = article[parent] or tag in ("article", "main")
            article.append(inside)
            drop = not keep[parent] or tag in DROPPED or self.hidden[node]
            if not drop and names:
                drop = bool(READERS.search(names)) or not main[node] and bool((NAMED_WHOLE if inside else NAMED).search(names)) and tag not in HEADINGS
            if tag == "header" and not holder[node] and not (inside and main[node]):
                drop = True
            if not drop and hashes and hashes[node] in (sure if inside else template) and tag not in ("html", "body", "article", "main"):
                drop = True
            keep.append(not drop)
        return keep

    def _gather(self, keep: list[bool], only: list[bool] | None) -> str:
        blocks, line = [], []

        def end() -> None:
            if line:
                if shown := " ".join(_html.unescape("".join(line)).split()):
                    blocks.append(shown)
                line.clear()

        for node, text in self.events:
            if text is None:
                end()
            elif keep[node] and (only is None or only[node]):
                line.append(text)
        end()
        return "\n".join(blocks)

    def text(self, template: Iterable[int] = (), sure: Iterable[int] = ()) -> str:
        """Blocks of the articles; of the main element if there is none with text; else of the whole body."""
        keep = self.kept(template, sure)
        for wanted in ("article", "main"):
            if wanted in self.tags:
                only = [False] * len(self.tags)
                for node in range(1, len(self.tags)):
                    only[node] = only[self.parents[node]] or self.tags[node] == wanted
                if found := self._gather(keep, only):
                    return found
        return self._gather(keep, None)


def host_of(url_col: str):
    """Host of a URL in lower case, without port or user; an empty string if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def design_of(html: Column) -> Column:
    """A hash of the design of a page: which of HTML's sectioning elements it has, with their class names, digits left out."""
    parts = F.regexp_extract_all(html, F.lit(r"(?i)<(?:body|main|article|section|nav|aside|header|footer|form)(?=[\s/>])[^<>]*+"), F.lit(0))
    named = F.transform(parts, lambda x: F.lower(F.concat(F.regexp_extract(x, r"^<([a-zA-Z]+)", 1), F.lit(" "), F.regexp_replace(F.regexp_extract(x, r"(?i)\sclass\s*=\s*[\"']?([^\"'>]*)", 1), "[0-9]+", ""))))
    return F.xxhash64(F.sort_array(F.array_distinct(named)))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """Rows (host, design, template array<long>, sure array<long>): the hashes of subtrees that recur on many pages, and of those on more.

    Subtrees are counted on the pages of each host and design, and, in the rows without a design, on all pages of the
    host, so a block of one section of a large host is found as well as one that is everywhere. Pages with the same
    text count as one, so that copies of an article don't make it a template.
    """
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("design", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("subtree", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_html"):
            rows, texts, subtrees = [], [], []
            for row, source in enumerate(b.column("_html").to_pylist()):
                page = Page(source)
                found = {h for h in page.hashes() if h is not None}
                text = xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass")) - (1 << 63)
                rows += [row] * (len(found) + 1)
                texts += [text] * (len(found) + 1)
                subtrees += [None, *found]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("host").take(at), b.column("design").take(at), pa.array(texts, pa.int64()), pa.array(subtrees, pa.int64())], [f.name for f in schema.fields])

    html = F.col(html_col).cast("string")
    rows = pages.select(host_of(url_col).alias("host"), design_of(html).alias("design"), html.alias("_html")).where("host <> ''").mapInArrow(run, schema)
    by_design = stored(rows.distinct().groupBy("host", "design", "subtree").agg(F.count("*").alias("n")), "subtrees")
    by_host = by_design.groupBy("host", "subtree").agg(F.sum("n").alias("n")).select("host", F.lit(None).cast("long").alias("design"), "subtree", "n")
    counts = by_design.unionByName(by_host)
    whole = counts.where("subtree IS NULL").select("host", F.col("design").alias("_design"), F.col("n").alias("pages"))
    often = counts.where(F.col("subtree").isNotNull() & (F.col("n") >= least_pages)).join(whole.withColumnRenamed("host", "_host"), (F.col("host") == F.col("_host")) & F.col("design").eqNullSafe(F.col("_design"))).where(F.col("n") >= F.col("pages") * least_share)
    sure = F.when(F.col("n") >= F.col("pages") * inside_share, F.col("subtree"))
    return often.groupBy("host", "design").agg(F.sort_array(F.collect_list("subtree")).alias("template"), F.sort_array(F.collect_list(sure)).alias("sure"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """Rows (id_col, url, text, n_chars), one per row of ``pages``.

    The text is that of the article: its blocks in page order, one per line, references decoded and white space made
    one space. A null or empty page has an empty text; a page without a host has no template; repeated rows and null
    ids are kept; other columns are ignored. The templates are written to the shared folder and joined by host and
    design, so that Spark sees their size before it chooses how to join. At ``least_share`` a list is no longer than
    two average pages have subtrees.
    """
    known = stored(templates(pages, url_col, html_col, least_pages, least_share, inside_share), "templates")
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_html"):
            columns = (b.column(c).to_pylist() for c in ("_html", "template", "sure", "own_template", "own_sure"))
            found = [Page(source).text((*(template or ()), *(own or ())), (*(sure or ()), *(own_sure or ()))) for source, template, sure, own, own_sure in zip(*columns)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [f.name for f in schema.fields])

    html = F.col(html_col).cast("string")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"), host_of(url_col).alias("host"), design_of(F.coalesce(html, F.lit(""))).alias("design"))
    everywhere = known.where("design IS NULL").select("host", "template", "sure")
    own = known.where("design IS NOT NULL").select("host", "design", F.col("template").alias("own_template"), F.col("sure").alias("own_sure"))
    return rows.join(everywhere, "host", "left").join(own, ["host", "design"], "left").select("_id", "_url", "_html", "template", "sure", "own_template", "own_sure").mapInArrow(run, schema)
