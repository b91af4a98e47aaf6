"""Main text of web pages, by containers on which the pages of a host agree.

1. Each page is read into elements and blocks of text (end tags may be missing). Page furniture goes by
   element, role and class: menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts.
   The containers that are left are scored by their text, text of links counting against it, and the page
   votes for one: its article, its main element, or the innermost container that holds nearly all.
2. Spark sums the votes by host and generalised path (`body>div.post-#>article`: tags and classes, digits
   as one sign). Paths with SHARE of a host's votes win.
3. Each page is read once more and takes the winning path with most votes that it has; its own choice if
   that is a winning path within this one, or if it has none. The text is all blocks of the elements on it.

Votes are summed before the shuffle, so a host of a third of all pages is a few rows. Winners are at most
1 / SHARE paths a host and are broadcast up to MAX_BROADCAST bytes; beyond that pages are joined by host,
hosts with many pages dealt out by a salt.

Defined cases: null and empty html, and pages without main text, give an empty text; a null url, or one
without a host, takes part in no vote and the page keeps its own choice; repeated rows are extracted one
by one, each with a vote; an empty table gives an empty result. Other input columns are not carried.
References are decoded as browsers do; white space (as Unicode has it) within a block is one space and a
line break is white space; cut-off tags at the end of a page are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_id, written
from .urlfilter import host_of

#: A path wins with 1 / SHARE of its host's votes.
SHARE = 20
#: Bytes of winning paths that are broadcast; hosts with 1 / HOT of all pages are dealt out by SALTS beyond.
MAX_BROADCAST, HOT, SALTS = 16 << 20, 64, 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is main text.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section main article center td table tbody tr details fieldset form".split())
#: What a start tag ends, and the elements beyond which it ends nothing.
ENDS = {x: ({"p"}, {"td", "th", "caption", "table", "button", "object"}) for x in BLOCK - set("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())}
ENDS |= {"li": ({"li"}, {"ul", "ol", "menu", "table"}), "dd": ({"dd", "dt"}, {"dl", "table"}), "dt": ({"dd", "dt"}, {"dl", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
ENDS |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}

#: Page furniture by element, by role, and by the first or last word of a class or id.
FURNITURE = frozenset("nav footer aside form head dialog menu search button select datalist template noscript svg math canvas object audio video map legend label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip status".split())
NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs header masthead topbar footer bottombar sidebar sidebars aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored "
    "promo promos promotion banner banners cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations teaser teasers widget widgets toolbar pagination pager comment comments commentlist disqus respond reply replies discussion form forms search skip copyright".split()
)
PREFIXES = frozenset("has with no without is show hide hidden enable".split())
KEEP, DROP, ONLY_HEADINGS = range(3)

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|["'=])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
CONTENT = re.compile(r"<(?:article|main|h1)[\s>]", re.I)
END_OF_FORM = re.compile(r"</form", re.I)
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in RAW}


@lru_cache(1 << 14)
def is_furniture(name: str) -> bool:
    """Whether a class or id names page furniture: by its first or last word ("main-nav", "adBox")."""
    words = [w.lower() for w in WORD.findall(name)]
    return bool(words) and words[0] not in PREFIXES and (words[0] in NAMES or words[-1] in NAMES)


@lru_cache(1 << 14)
def generalised(tag: str, classes: str) -> str:
    """A step of a path: the tag and its classes; digits, and what could not stand in a path, as one sign."""
    return ".".join([tag, *(re.sub(r"[^A-Za-z_-]+", "#", c) for c in classes.split())])


class Page:
    """Elements and text blocks of a page. Of each element: its parent, tag, path (a number) and score."""

    def __init__(self, html: str):
        self.parent, self.tags, self.path, self.state = [0], ["#root"], [0], [KEEP]
        self.steps: dict[tuple[int, str], int] = {}
        self.names: list[tuple[int, str]] = [(0, "")]
        self.main: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters within links
        self._read(html)

    def _read(self, html: str) -> None:
        stack, open_ = [0], Counter()
        parts: list[str] = []
        linked = at = 0
        content = ends = None

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((next(x for x in reversed(stack) if self.tags[x] in BLOCK or not x), text, linked))
                parts, linked = [], 0

        def text(to: int) -> None:
            nonlocal linked
            if to > at and self.state[stack[-1]] == KEEP:
                found = html[at:to]
                found = unescape(found) if "&" in found else found
                parts.append(found)
                if open_["a"]:
                    linked += len(found.strip())

        def close(to: int) -> None:
            for x in stack[to:]:
                open_[self.tags[x]] -= 1
            del stack[to:]

        position = 0
        while True:
            found = TOKEN.search(html, position)
            if not found:
                break
            text(found.start())
            at = position = found.end()
            tag = found[2]
            if tag is None or found.end() == len(html) and html[-1] != ">":
                continue
            tag = tag.lower()
            block = tag in BLOCK
            if found[1]:
                if open_[tag]:
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[i]] == tag:
                            if block:
                                flush()
                            close(i)
                            break
                        if not block and self.tags[stack[i]] in BLOCK:
                            break
                elif block:
                    flush()
                continue
            if block:
                flush()
            elif tag == "br":
                parts.append(" ")
            if tag in ENDS or tag == "a":
                closing, walls = ENDS.get(tag, ({"a"}, BLOCK))
                if any(open_[x] for x in closing):
                    cut = 0
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[i]] in walls:
                            break
                        if self.tags[stack[i]] in closing:
                            cut = i
                            if tag not in ("tr", "tbody", "thead", "tfoot"):
                                break
                    if cut:
                        close(cut)
            if tag in VOID:
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(html, position)
                position = at = end.start() if end else len(html)
                if end:  # the end tag itself
                    position = at = html.find(">", position) + 1 or len(html)
                continue
            attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(found[3])} if found[3].strip() else {}
            if found[3].endswith("/") and (open_["svg"] or open_["math"]):
                continue
            if tag == "form" and content is None:
                content, ends = ([m.start() for m in x.finditer(html)] for x in (CONTENT, END_OF_FORM))
            around = False
            if tag == "form":
                i = bisect_left(content, at)
                j = bisect_left(ends, at)
                around = i < len(content) and (j == len(ends) or content[i] < ends[j])
            self._add(tag, attributes, stack[-1], block, around, bool(open_["article"]))
            stack.append(len(self.tags) - 1)
            open_[tag] += 1
        text(len(html))
        flush()

    def _add(self, tag: str, attributes: dict[str, str], parent: int, block: bool, around: bool, within: bool) -> None:
        """around: a form around the page's content; within: within an article."""
        state = self.state[parent]
        if state == ONLY_HEADINGS:
            state = KEEP if tag in HEADINGS else ONLY_HEADINGS
        if state != DROP and attributes and tag not in ("html", "body"):
            names = attributes.get("class", "").split() + attributes.get("id", "").split()
            if tag in ("article", "main"):
                names = [x for x in names if WORD.findall(x)[:1] == ["comment"]]
            if "hidden" in attributes or attributes.get("role", "").lower() in ROLES or any(map(is_furniture, names)):
                state = DROP
                if within and any(WORD.findall(x)[-1:] == ["header"] for x in names):
                    state = ONLY_HEADINGS
        if state != DROP:
            if tag == "header":
                state = ONLY_HEADINGS if within else DROP
            elif tag in FURNITURE and not around:
                state = DROP
        self.parent.append(parent)
        self.tags.append(tag)
        self.state.append(state)
        path = self.path[parent]
        if block:
            step = (path, generalised(tag, attributes.get("class", "")))
            path = self.steps.get(step)
            if path is None:
                path = self.steps[step] = len(self.names)
                self.names.append(step)
        self.path.append(path)
        if state == KEEP and (tag == "main" or attributes.get("role", "").lower() == "main"):
            self.main.append(len(self.tags) - 1)

    def path_text(self, path: int) -> str:
        steps = []
        while path:
            path, step = self.names[path]
            steps.append(step)
        return ">".join(reversed(steps))

    def find_path(self, path: str) -> int | None:
        at = 0
        for step in path.split(">"):
            at = self.steps.get((at, step))
            if at is None:
                return None
        return at

    def choice(self) -> tuple[int, int]:
        """The path that the page is for, and its score; path 0 is the whole page."""
        n = len(self.tags)
        score, heading = [0] * n, [False] * n
        for x, text, linked in self.blocks:
            score[x] += max(0, len(text) - 2 * linked)
            if self.tags[x] == "h1":
                heading[self.parent[x]] = True
        children: dict[int, int] = {}
        for x in range(n - 1, 0, -1):
            p = self.parent[x]
            score[p] += score[x]
            if self.tags[x] in CONTAINERS and self.state[x] == KEEP and score[x] >= score[children.get(p, x)]:
                children[p] = x
        whole = score[0]
        by_path: Counter[int] = Counter()
        inside = [False] * n
        for x in range(1, n):
            inside[x] = inside[self.parent[x]]
            if self.tags[x] == "article" and self.state[x] == KEEP:
                if not inside[x]:
                    by_path[self.path[x]] += score[x]
                inside[x] = True
        best = max(by_path.items(), key=lambda i: (i[1], -i[0]), default=(0, 0))
        if best[1] and 4 * best[1] >= whole:
            return best
        at = max(self.main, key=lambda x: (score[x], -x), default=0)
        at = at if 4 * score[at] >= whole and score[at] else 0
        while at in children and 5 * score[children[at]] >= 4 * score[at] > 0 and not heading[at]:
            at = children[at]
        return self.path[at], score[at]

    def text(self, path: int) -> str:
        """All blocks of the elements on a path, in page order."""
        on = [False] * len(self.tags)
        on[0] = path == 0
        for x in range(1, len(on)):
            on[x] = on[self.parent[x]] or self.path[x] == path and self.state[x] == KEEP
        return "\n".join(t for x, t, _ in self.blocks if on[x])


def main_text(html: str | None, winners: list[str] | None) -> tuple[str, str]:
    """The text and the path that it was taken from."""
    page = Page(html or "")
    own, _ = page.choice()
    name = page.path_text(own)
    for winner in winners or ():
        if name in winners and name.startswith(f"{winner}>"):
            break
        path = page.find_path(winner)
        if path is not None and (text := page.text(path)):
            return text, winner
    return page.text(own), name


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page that has a host and main text: its choice, and a vote that grows with its text."""
    for batch in slices(batches, "html"):
        hosts, paths, votes = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if host and html:
                page = Page(html)
                path, score = page.choice()
                if score:
                    hosts.append(host)
                    paths.append(page.path_text(path))
                    votes.append(score.bit_length())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], ["host", "path", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = [main_text(html, winners) for html, winners in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())], ["id", "url", "text", "n_chars", "container"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, winners (paths, most votes first) and pages (voters) of every host. pages: host, html."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.count("*").alias("pages"))
    votes = written(votes, "votes")
    totals = votes.groupBy("host").agg(F.sum("votes").alias("all"), F.sum("pages").alias("host_pages"))
    best = votes.join(totals, "host").filter(SHARE * F.col("votes") >= F.col("all"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path")))
    return best.groupBy("host").agg(F.transform(ordered, lambda x: x.path).alias("winners"), F.first("host_pages").alias("pages"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars and container (the path that the text was taken from) of every page."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    paths = written(host_paths(own), "paths")
    size, voters = paths.agg(F.sum(F.octet_length("host") + F.octet_length(F.concat_ws(">", "winners"))), F.sum("pages")).first()
    if (size or 0) <= MAX_BROADCAST:
        joined = own.join(F.broadcast(paths.drop("pages")), "host", "left")
    else:
        hot = [r.host for r in paths.filter(HOT * F.col("pages") >= voters).select("host").collect()]  # HOT hosts at the most
        is_hot = F.col("host").isin(hot) if hot else F.lit(False)
        salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        salt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
        joined = own.withColumn("salt", salt).join(paths.select("host", "winners", F.explode(salts).alias("salt")), ["host", "salt"], "left")
    found = joined.select("id", "url", "html", "winners").mapInArrow(_texts, with_id(pages, id_col, "url string, text string, n_chars long, container string"))
    return found.withColumnRenamed("id", id_col)
