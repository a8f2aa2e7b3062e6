"""Main text of HTML pages by a maximum-scoring subsequence of words and tags.

Words score one, tags lose what labelled pages say of them: a page that marks its article teaches how much more often a tag
stands outside of articles. One linear scan finds the contiguous region of the highest sum; the text is that of the element
around it, without elements that are not part of it. Which these are is a score too: of the names of elements and the parts of
their class names, ids and roles, those go that labelled pages have outside of their articles, and a list of usual names
stands for as many labelled elements as USUAL says. An element of words in a row (its words and tags sum to PROSE or more) is judged
by how such elements stand, so a list of links marked `related` goes and a section of text marked so stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, sliced, table, texts

#: Weights are counted on about so many pages at most.
LABELLED_PAGES = 2000
WORD, DROPPED_WORD, TAG = 1.0, -1.0, -2.0
LIGHTEST, HEAVIEST = -0.2, -8.0

#: Elements whose content is not text.
RAW = ("script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "title", "textarea", "select", "video", "audio")
#: Elements that are not part of an article.
DROPPED = frozenset(("nav", "aside", "footer", "form", "button", "menu", "dialog", "fieldset", "label", "header"))
CONTAINERS = frozenset(("html", "body", "div", "article", "main", "section", "table", "td", "center", "blockquote", "ul", "ol", "dl", "figure", "details"))
BLOCKS = CONTAINERS | DROPPED | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th caption thead tbody tfoot pre hr figcaption summary address hgroup legend option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class names and ids that usually mark what is not part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted recommended related replies reply respond share sharing shares sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Those that do so for whole texts too.
PROSE_MARKS = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr modal nav navigation newsletter paywall popup promo promoted replies reply respond sidebar sponsor sponsored".split())
#: An element whose words and tags sum to this or more is a text.
PROSE = 25.0
#: A usual mark counts as so many labelled elements outside of articles.
USUAL = 20
#: Elements go from this log of the odds on.
ODDS = 3.0
#: Elements that end others: the ended ones, and where the search for them ends.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{name: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for name in ("thead", "tbody", "tfoot")},
}
#: An open paragraph is ended by any block but these, up to the nearest of those after them.
IN_PARAGRAPH = frozenset(("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend", "option", "html", "body"))
HOLDS_PARAGRAPH = {"td", "th", "caption", "table", "button"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S | re.I
)
_OPEN = re.compile("<!--|<(?:" + "|".join(RAW) + r")(?=[\s/>])", re.I)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PARTS = re.compile(r"[^a-z]+")


def marks(attrs: str) -> frozenset[str]:
    """The parts of an element's class names, ids and roles."""
    return frozenset(part for m in _MARK.finditer(attrs) for part in _PARTS.split((m[1] or m[2] or m[3] or "").lower()) if part) if attrs else frozenset()


@dataclass(frozen=True)
class Model:
    """What labelled pages teach: weights of tags, and for names and marks, of texts or not, the log odds to stand outside."""

    tags: Mapping[str, float]
    odds: Mapping[tuple[str, bool], float] = field(default_factory=dict)

    def outside(self, name: str, parts: frozenset[str], prose: bool) -> bool:
        """Whether an element is not part of an article."""
        if name in DROPPED:
            return True
        return any(self.odds.get((part, prose), usual(part, prose)) >= ODDS for part in parts)


def usual(part: str, prose: bool, outside: int = 0, inside: int = 0) -> float:
    """Log odds of a mark to stand outside, the list's word for it included. A list of links inside of an article is no word
    against that, since articles do hold what is not part of them."""
    known = part in (PROSE_MARKS if prose else MARKS)
    return log((outside + USUAL * known + 0.5) / ((inside if prose or not known else 0) + 0.5))


def _unclosed(m: re.Match) -> bool:
    """Whether a comment or a raw element has no end."""
    if m["raw"]:
        return not re.search(r"</" + m["raw"] + r"\s*>\Z", m[0], re.I)
    return m[0].startswith("<!--") and not m[0].endswith("-->")


class Page:
    """The text runs of a page with their blocks and elements, and the scores of its words and tags in order."""

    def __init__(self, html: str, model: Model | Mapping[str, float]):
        if not isinstance(model, Model):
            model = Model(model)
        self.parent, self.name = [-1], [""]  # of the containers
        self.runs: list[tuple[str, int, int, int]] = []  # text, block, container, nearest element that may be dropped or -1
        self.scores: list[tuple[float, int]] = []  # score, index of the run or -1
        self.tags: list[tuple[str, int]] = []  # name, container
        self.own: list[list] = []  # of elements that may be dropped: name, marks, the one around, own and nearest container, hidden, first and last score
        stack: list[tuple[str, int, int]] = []  # name, container, element that may be dropped or -1
        block = container = 0
        near = -1
        begin = 0
        last = html.rfind(">") + 1  # what follows holds no tag

        def text(s: str) -> None:
            if not s:
                return
            n = len(s.split())
            self.runs.append((s, block, container, near))
            if n:
                self.scores.append((WORD * n, len(self.runs) - 1))

        def close(at: int) -> None:
            nonlocal container, near
            for _, own, element in reversed(stack[at:]):
                if own >= 0:
                    container = self.parent[own]
                if element >= 0:
                    self.own[element][7] = len(self.scores)
                    near = self.own[element][2]
            del stack[at:]

        def ended(names: set[str], until: set[str]) -> None:
            """Closes the outermost of some open elements within the nearest of others."""
            found = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    found = k
                elif stack[k][0] in until:
                    break
            if found is not None:
                close(found)

        for m in _TOKEN.finditer(html, 0, last):
            text(html[begin : m.start()])
            begin = m.end()
            name = m["name"]
            if name is None:
                if begin == last and _unclosed(m):  # it goes on to the end of the page
                    begin = len(html)
                continue
            name = name.lower()
            self.tags.append((name, container))
            if name == "br":
                self.runs.append((" ", block, container, near))
            if name in BLOCKS:
                block += 1
            if m["end"]:
                self.scores.append((model.tags.get(name, TAG), -1))
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if at is not None:
                    close(at)
                continue
            if name in IMPLIED:
                ended(*IMPLIED[name])
            if name in BLOCKS and name not in IN_PARAGRAPH:
                ended({"p"}, HOLDS_PARAGRAPH)
            self.scores.append((model.tags.get(name, TAG), -1))
            if name in VOID:
                continue
            parts = marks(m["attrs"]) if name not in ("html", "body") else frozenset()
            hidden = bool(m["attrs"]) and name not in ("html", "body") and _HIDDEN.search(m["attrs"]) is not None
            element = own = -1
            if name in CONTAINERS or name in DROPPED:
                own = len(self.parent)
                self.parent.append(container)
                self.name.append(name)
                container = own
            if parts or hidden or name in DROPPED:
                element = len(self.own)
                self.own.append([name, parts, near, own, container, hidden, len(self.scores), -1])
                near = element
            if own >= 0 or element >= 0 or name in BLOCKS:
                stack.append((name, own, element))
        text(_OPEN.split(html[begin:], maxsplit=1)[0])
        close(0)
        self._drop(model)

    def _drop(self, model: Model) -> None:
        """The elements that go, those around each run, and the scores of words in them."""
        sums = [0.0]
        for score, _ in self.scores:
            sums.append(sums[-1] + score)
        self.prose = [sums[end] - sums[first] >= PROSE for *_, first, end in self.own]
        around: list[tuple[int, ...]] = []
        for k, (name, parts, above, _, _, hidden, _, _) in enumerate(self.own):
            before = around[above] if above >= 0 else ()
            around.append((*before, k) if hidden or model.outside(name, parts, self.prose[k]) else before)
        self.runs = [(s, block, container, around[near] if near >= 0 else ()) for s, block, container, near in self.runs]
        self.scores = [(score * DROPPED_WORD if run >= 0 and self.runs[run][3] else score, run) for score, run in self.scores]

    def region(self) -> tuple[int, int] | None:
        """The first and last run of the contiguous region with the highest sum; None without a word that counts."""
        best, found, total, start = 0.0, None, 0.0, None
        for score, run in self.scores:
            if run >= 0 and start is None:
                start, total = run, 0.0
            if start is None:
                continue
            total += score
            if total <= 0:
                start = None
            elif run >= 0 and total > best:
                best, found = total, (start, run)
        return found

    def path(self, container: int) -> list[int]:
        out = []
        while container >= 0:
            out.append(container)
            container = self.parent[container]
        return out

    def main_text(self) -> str:
        """The text of the element around the best region; of the region itself where that is the whole body."""
        found = self.region()
        if found is None:
            return ""
        first, last = found
        inside = [r for r in self.runs[first : last + 1] if r[0].strip() and not r[3]] or self.runs[first : last + 1]
        common = self.path(inside[0][2])
        for run in inside[1:]:
            own = set(self.path(run[2]))
            common = [c for c in common if c in own]
        root = next((c for c in common if self.name[c] in ("article", "main")), common[0])
        around = set(inside[0][3]).intersection(*(r[3] for r in inside))  # what is dropped around all of the region is not
        if self.name[root] in ("", "html", "body"):
            low, high = self.runs[first][1], self.runs[last][1]
            taken = [r for r in self.runs if low <= r[1] <= high]
        else:
            inner = {root}
            for c in range(root + 1, len(self.parent)):
                if self.parent[c] in inner:
                    inner.add(c)
            taken = [r for r in self.runs if r[2] in inner]
        blocks: dict[int, list[str]] = {}
        for s, block, _, drops in taken:
            if around.issuperset(drops):
                blocks.setdefault(block, []).append(unescape(s))
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n\n".join(b for b in joined if b)


def tag_counts(html: str) -> Counter:
    """(kind, name, inside) of tags, marks and words inside and outside of the article of a page that marks one.

    Kinds are tag, word, list and text; the last two are of elements with a name or mark, by their content, but for those
    around the article.
    """
    page = Page(html, {})
    own = [c for c, name in enumerate(page.name) if name == "article"] or [c for c, name in enumerate(page.name) if name == "main"]
    out: Counter = Counter()
    if len(own) != 1:
        return out
    known: dict[int, bool] = {}

    def inside(container: int) -> bool:
        return known.setdefault(container, own[0] in page.path(container))

    for name, container in page.tags:
        if name in BLOCKS or name in VOID or name in _INLINE:
            out["tag", name, inside(container)] += 1
    for s, _, container, _ in page.runs:
        out["word", "", inside(container)] += len(s.split())
    over = set(page.path(own[0]))
    for (_, parts, _, container, nearest, hidden, _, _), prose in zip(page.own, page.prose):
        if not hidden and container not in over:
            for part in parts:
                out["text" if prose else "list", part, inside(nearest)] += 1
    return out


_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = LABELLED_PAGES) -> Model:
    """Weights and odds from pages that mark their article; of more than `most` pages, those whose hash of the id is below the share.

    What reaches the driver is a count for every tag, and for every mark that some pages share.
    """
    total = pages.count()
    chance = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1_000_003)) / F.lit(1_000_003.0)
    taken = pages.where(chance < min(1.0, most / max(1, total))).select(F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for html in texts(batch, "html"):
                if html:
                    counts.update(tag_counts(html))
        if counts:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in counts]) for c in range(3)), pa.array(counts.values(), pa.int64())], names=["kind", "name", "inside", "n"])

    counted = taken.mapInArrow(run, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    counts = {(r["kind"], r["name"], r["inside"]): r["n"] for r in counted.where("kind in ('tag', 'word') or n >= 3").collect()}
    words = counts.get(("word", "", True), 0) + 1, counts.get(("word", "", False), 0) + 1
    tags, odds = {}, {}
    for kind, name in sorted({k[:2] for k in counts}):
        inside, outside = (counts.get((kind, name, side), 0) for side in (True, False))
        if kind == "tag":
            # How many words more outside a tag of this kind weighs than inside: the log of its odds against those of words.
            share = (outside + 1) / words[1] / ((inside + 1) / words[0])
            tags[name] = max(HEAVIEST, min(LIGHTEST, TAG - log(share)))
        elif kind != "word":
            odds[name, kind == "text"] = usual(name, kind == "text", outside, inside)
    return Model(tags, odds)


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of columns of these names; the html is not carried on.

    A null or empty page, or one without a word that counts, has an empty text. Pages are read whole, broken markup
    included: what is not closed ends with what is around it, or where its next sibling begins. Repeated rows are read each;
    an empty table gives no rows.
    """
    from pyspark.sql import types as T

    (name,) = fresh(pages, "_html")
    keep = pages.select(*[pages[c] for c in pages.columns if c not in ("text", "n_chars", html_col)], pages[html_col].alias(name))
    fields = [f for f in keep.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [Page(h, model).main_text() if h else "" for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return keep.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), fit(pages))
