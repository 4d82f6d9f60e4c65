"""Main text of web pages by a vote over each host's pages.

Every page scores its containers: a paragraph or heading counts for the container it lies in and half for the one
around that. The best one is widened to the containers around it that add prose or a headline. A container is known by
its path of tags and classes, with numbers left out. The path that wins most pages of a host is the host's; then every
page is read again and gives the text under its host's path, widened once more if the page's own best one lies there. A
page without that path gives the text of its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import cut_lineage

#: Hosts (a row of some 200 bytes each) up to which winning paths are broadcast; beyond, pages are dealt by host and salt.
BROADCAST_HOSTS = 50_000
SALTS = 64

# Names of HTML elements by what they do to text, and words that class names of page furniture consist of.
CONTAINERS = frozenset("article main section div td body blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "address aside dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head li nav "
    "ol option p pre summary table tbody tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form button select dialog menu noscript head object".split())
REMARKS = frozenset("comment comments disqus".split())
ADVERTS = frozenset("ad ads advert advertisement advertising promo sponsor sponsored".split())
FRAMES = frozenset(
    "banner breadcrumb breadcrumbs cookie cookies disclaimer footer modal nav navbar navigation newsletter notice notices pagination popup "
    "sidebar subscribe".split()
)
BESIDES = frozenset("header menu related replies reply share sharing social widget".split())
FURNITURE_WORDS = REMARKS | ADVERTS | FRAMES | BESIDES
# Words around these that speak of a state of the page, not of what an element is.
STATES = frozenset("has hide is no not show with without closed count disabled enabled off on open".split())
ROLES = frozenset("alert alertdialog complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Elements that no attribute makes furniture, that no class or id does, that hold text of their own, and that an id may.
PAGE = frozenset("html body".split())
WHOLE = PAGE | frozenset("main article".split())
TEXTUAL = HEADINGS | frozenset("p li dd dt td blockquote figcaption".split())
NAMED_BY_ID = frozenset("div section table ul ol dl details figure fieldset".split())
CLOSES_OWN_KIND = frozenset("li dt dd option tr td th p".split())

# A tag ends before the next "<" outside quotes, so that one without its ">" is told at once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|svg|iframe|template|math|canvas)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^<>\"']*+>))*+)>"
    r"|<[!?/][^<>]*+>"
    r"|<[!?/a-z][^<>]*+(?=<|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNDISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


@dataclass(slots=True)
class Block:
    """A run of text without a block element in it; ``container`` is the number of the innermost container's path."""

    text: str
    container: int
    linked: int
    heading: bool = False
    prose: bool = False
    named: int = -1


class Blocks(list):
    """The blocks of a page, and its paths of elements as a tree: of each path its parent, last step and next container out."""

    def __init__(self) -> None:
        super().__init__()
        self.parent: list[int] = []
        self.step: list[str] = []
        self.outer: list[int] = []  # the container a path's own elements lie in
        self.is_container: list[bool] = []
        self.child: dict[tuple[int, str], int] = {}

    def enter(self, parent: int, step: str, outer: int, container: bool) -> int:
        number = self.child.setdefault((parent, step), len(self.step))
        if number == len(self.step):
            self.parent.append(parent)
            self.step.append(step)
            self.outer.append(outer)
            self.is_container.append(container)
        return number

    def path(self, number: int) -> str:
        steps = []
        while number >= 0:
            steps.append(self.step[number])
            number = self.parent[number]
        return ">".join(reversed(steps))

    def find(self, path: str) -> int:
        """The number of a path, -1 if the page doesn't have it."""
        number = -1
        for step in path.split(">"):
            number = self.child.get((number, step), -2)
            if number < 0:
                return -1
        return number

    def within(self, number: int) -> list[bool]:
        """Of each path whether it is ``number`` or lies inside it; an outer path has the smaller number."""
        out = [False] * len(self.step)
        for i in range(number, len(out)):
            out[i] = i == number or (self.parent[i] >= 0 and out[self.parent[i]])
        return out

    def sums(self) -> list[list[int]]:
        """Of each container the blocks in it: how many, their length, and of unlinked ones length, headings' and prose's."""
        out = [[0] * 5 for _ in self.step]
        for b in self:
            if b.container >= 0:
                n, own, mine = len(b.text), 2 * b.linked <= len(b.text), out[b.container]
                for k, v in enumerate((1, n, n * own, n * (own and b.heading), n * (own and not b.heading and b.prose))):
                    mine[k] += v
        for i in range(len(out) - 1, -1, -1):
            if self.is_container[i] and self.outer[i] >= 0:
                outside = out[self.outer[i]]
                for k, v in enumerate(out[i]):
                    outside[k] += v
        return out


def _attributes(attributes: str) -> dict[str, str]:
    """Values by name; of an attribute given twice the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


@lru_cache(maxsize=65536)
def _step(tag: str, attributes: str) -> str:
    names = _attributes(attributes).get("class", "") if attributes else ""
    classes = sorted({re.sub(r"[\d>]+", "", c) for c in names.lower().split()} - {""})
    return ".".join([tag, *classes])


def _said_by(token: str) -> str | None:
    """What kind of furniture a class or id names: ``cookie-notice`` and ``ad-1`` say nothing else (*all*).

    ``comment-list`` and ``top-ad`` do so at one of their ends; ``no-sidebar`` and ``comments-open`` tell a state.
    """
    words = [w for w in re.split(r"[\W\d_]+", token.lower()) if w]
    if not words or words[0] in STATES or words[-1] in STATES:
        return None
    if FURNITURE_WORDS.issuperset(words):
        return "remark" if REMARKS & set(words) else "advert" if ADVERTS & set(words) else "all"
    for kind, known in (("remark", REMARKS), ("advert", ADVERTS), ("frame", FRAMES), ("beside", BESIDES)):
        if words[0] in known or words[-1] in known:
            return kind
    return None


@lru_cache(maxsize=65536)
def _furniture(tag: str, attributes: str, inside_article: bool) -> str | None:
    """*hard* if the element is furniture whatever it holds, or a kind that is judged by what it turns out to hold."""
    if tag in FURNITURE and not (tag == "header" and inside_article):
        return "hard"
    if tag in PAGE or not attributes.strip():
        return None
    given = _attributes(attributes)
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or _UNDISPLAYED.search(given.get("style", "")):
        return "hard"
    if tag in WHOLE:
        return None
    role = given.get("role", "").strip().lower()
    if role in ROLES:
        return "hard"
    kinds = {"beside"} if role == "banner" and not inside_article else set()
    for token in given.get("class", "").split() + (given.get("id", "").split() if tag in NAMED_BY_ID else []):
        kind = _said_by(token)
        if kind and not (inside_article and token.lower() == "header"):
            whole = FURNITURE_WORDS.issuperset(w for w in re.split(r"[\W\d_]+", token.lower()) if w)
            if tag not in TEXTUAL:
                kinds.add("hard" if whole else kind)
            elif whole:
                kinds.add(kind if kind in ("remark", "advert") else "text")
    return next((k for k in ("hard", "remark", "advert", "frame", "beside", "text") if k in kinds), None)


@dataclass(slots=True)
class Named:
    """An element whose name may make it furniture, and what it holds."""

    kind: str
    around: int
    core: bool = False
    size: int = 0
    linked: int = 0
    prose: int = 0
    heading: bool = False


def _judge(found: Blocks, named: list[Named]) -> None:
    """Take out the blocks of named elements that are furniture.

    None is that holds an article, a main element or a first-level heading. Comments and adverts are, other frames of the
    page if they hold no more than half of its prose, and the rest if they are mostly links or neither prose nor headings.
    """
    total = sum(len(b.text) for b in found if b.prose)
    for b in found:
        if b.named >= 0:
            own = named[b.named]
            own.size += len(b.text)
            own.linked += b.linked
            own.prose += len(b.text) * (b.prose and 2 * b.linked <= len(b.text))
            own.heading |= b.heading
    for own in reversed(named):
        if own.around >= 0:
            outside = named[own.around]
            outside.core |= own.core
            outside.size, outside.linked, outside.prose = outside.size + own.size, outside.linked + own.linked, outside.prose + own.prose
            outside.heading |= own.heading
    gone = []
    for own in named:
        links = 2 * own.linked > own.size
        furniture = {
            "remark": True,
            "advert": True,
            "frame": 2 * own.prose <= total,
            "beside": links or not (own.prose or own.heading),
            "text": links or not own.prose,
        }[own.kind]
        gone.append((furniture and not own.core) or (own.around >= 0 and gone[own.around]))
    found[:] = [b for b in found if b.named < 0 or not gone[b.named]]


def blocks(page: str) -> Blocks:
    """The text blocks of a page in its order, without furniture and without markup, in one walk over it."""
    out = Blocks()
    stack: list[tuple[str, int, int, bool, int]] = []  # tag, path, innermost container, hard furniture, named element
    opened: dict[str, int] = {}
    named: list[Named] = []
    parts: list[str] = []
    at = linked = headings = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text and not (stack and stack[-1][3]):
            out.append(Block(text, stack[-1][2] if stack else -1, linked, headings > 0, _prose(text), stack[-1][4] if stack else -1))
        linked = 0

    def pop() -> None:
        nonlocal headings
        tag = stack.pop()[0]
        opened[tag] -= 1
        headings -= tag in HEADINGS

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            raw = page[at : token.start()]
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if opened.get("a"):
                linked += len(raw)
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if token[2]:
            if opened.get(tag):
                if tag in BLOCKS:
                    flush()
                while stack[-1][0] != tag:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    pop()
                pop()
            continue
        if tag in BLOCKS:
            flush()
            if opened.get("p"):
                while stack[-1][0] != "p":
                    pop()
                pop()
            elif tag in CLOSES_OWN_KIND and stack and stack[-1][0] == tag:
                pop()
        elif tag == "br":
            parts.append(" ")
        attributes = token[4] or ""
        if tag in VOID or attributes.endswith("/"):
            continue
        _, above, container, hard, name = stack[-1] if stack else ("", -1, -1, False, -1)
        number = out.enter(above, _step(tag, attributes), container, tag in CONTAINERS)
        kind = None if hard else _furniture(tag, attributes, bool(opened.get("article")))
        if kind and kind != "hard":
            named.append(Named(kind, name))
            name = len(named) - 1
        if name >= 0 and tag in ("article", "main", "h1"):
            named[name].core = True
        stack.append((tag, number, number if tag in CONTAINERS else container, hard or kind == "hard", name))
        opened[tag] = opened.get(tag, 0) + 1
        headings += tag in HEADINGS
    parts.append(html.unescape(page[at:]))
    flush()
    if named:
        _judge(out, named)
    return out


def _best(found: Blocks) -> tuple[int, float]:
    """Number and score of the path of the container with the most text of its own, the first of equals; -1 without any."""
    scores: dict[int, float] = {}
    for block in found:
        weight, number = len(block.text) - 2 * block.linked, block.container
        for share in (1.0, 0.5):
            if number >= 0:
                scores[number] = scores.get(number, 0.0) + share * weight
                number = found.outer[number]
    if not scores:
        return -1, 0.0
    top = max(scores.values())
    return min(n for n, s in scores.items() if s == top), top


def best_container(found: Blocks) -> tuple[str, float]:
    """Path and score of the container with the most text of its own; the empty path without containers."""
    number, score = _best(found)
    return found.path(number), score


def _prose(text: str) -> bool:
    """Whether a block is running text: ten words, a sentence of five, or thirty characters of a script without blanks."""
    words = text.count(" ") + 1
    if words >= 10 or (words >= 5 and text.rstrip("\"'\u201d\u00bb)").endswith((".", "!", "?", "\u2026"))):
        return True
    return not text.isascii() and sum(c >= "\u0e00" and c.isalpha() for c in text) >= 30


def _widened(found: Blocks, number: int) -> int:
    """The outermost container around a path to which the page's matter reaches; the same path if it holds all of that.

    What lies in an outer container besides must be mostly no links, and prose or headings, unless that is an article or
    main element.
    """
    if number < 0:
        return number
    sums, outer = found.sums(), found.outer[number]
    if not sums[number][0]:
        return number
    while outer >= 0:
        count, size, own, heading, prose = (a - b for a, b in zip(sums[outer], sums[number]))
        whole = found.step[outer].partition(".")[0] in ("article", "main")
        if count and 2 * own >= size and (whole or 2 * prose >= size - heading):
            number = outer
        outer = found.outer[outer]
    return number


def main_container(found: Blocks) -> tuple[str, float]:
    """The path of the page's best container, widened, and the score of that container."""
    number, score = _best(found)
    return found.path(_widened(found, number)), score


def text_under(found: Blocks, path: str | None) -> str:
    """The blocks under ``path``, or under the page's own container if it has none there, one to a line.

    If the page's best container lies under ``path``, that is widened on this page too.
    """
    own = _best(found)[0]
    number = found.find(path) if path else -1
    if number < 0 or not found.sums()[number][0]:
        number = own
    if number >= 0 and (found.within(number)[own] or found.within(own)[number]):
        number = _widened(found, number)
    inside = found.within(number) if number >= 0 else []
    return "\n".join(b.text for b in found if number < 0 or (b.container >= 0 and inside[b.container]))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [main_container(blocks(page)) if page else ("", 0.0) for page in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], names=["host", "path", "score"]
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        texts = [text_under(blocks(page), path) if page else "" for page, path in zip(pages, paths)]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["_row", "text"])


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``path`` and ``votes`` of the winning path of every host; ties go to the higher score, then the path."""
    rows = pages.filter(F.col(html_col).isNotNull()).select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string, score double").filter("path <> ''")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    first = F.max_by(F.struct("path", "votes"), F.struct("votes", "score", "path"))
    return sums.groupBy("host").agg(first.alias("w")).select("host", "w.path", "w.votes")


def extract_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: Sequence[str] | None = None, broadcast_hosts: int = BROADCAST_HOSTS
) -> DataFrame:
    """``pages``, all columns (or those of ``keep``), with ``text``, the main text, added or replaced; every row gives one row.

    Blocks stand in page order, one to a line; white space inside a block is one blank; character references are
    decoded. Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, by
    element and by class or id, if that is all the name says (``ad-1`` and ``cookie-notice``, not ``no-sidebar``). A class
    or id makes no ``main`` or ``article`` furniture. Null and empty pages give the empty string, as do pages of nothing but furniture. Pages
    without a host (null or odd URLs) vote among themselves. A page that is cut off ends where it ends.
    """
    paths = host_paths(pages, url_col, html_col).select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    paths = cut_lineage(paths)
    few = paths.count() <= broadcast_hosts
    kept = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    rows = pages.select(F.struct(*kept).alias("_row"), url_host(F.col(url_col)).alias("_h"), F.col(html_col).alias("_html"))
    if few:
        joined = rows.join(F.broadcast(paths), F.col("_h") == F.col("_host"), "left")
    else:
        salted = paths.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (F.col("_h") == F.col("_host")) & (F.col("_salt") == F.col("_s")), "left")
    schema = T.StructType([rows.schema["_row"], T.StructField("text", T.StringType())])
    return joined.select("_row", "_html", "_path").mapInArrow(_texts, schema).select("_row.*", "text")
