"""HTML extraction by consensus of a host's pages.

Every page's containers are scored (letters in blocks of text, less those in links and in parts that are not article);
the page votes for the path of its best container, generalised to tags and first classes without digits. Votes are
counted by host in Spark, and all pages are read again with their host's winning path; a page without it, or with
almost nothing in it, takes its own best container. A best container inside an article stands for the whole article, and
like-named ones side by side for the container that holds them all.

A page is read in one pass whose work is in proportion to its length, whatever its tags: no place is searched for an end
that is known to be missing, elements lie DEEPEST deep at most (as in browsers; deeper ones become siblings), and paths
are numbers until one has won.

Votes are summed before they are dealt out, so a host with many pages is no larger than its few paths. The winners, a row
a host, are counted: up to MOST_BROADCAST they are broadcast and the pages stay where they are, beyond that both sides
meet on host and a salt.

Defined cases: null and empty html give an empty text; a null url is a host of its own; open, unknown and crossed tags
are read as browsers would, roughly; a tag, comment or script without its end runs to the end of the page, as in browsers;
an element that browsers do not show but whose tag is never closed hides what is inside it only up to the end of its
parent; repeated pages vote each; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, small, table

# Elements by what they mean for the text.
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select button canvas audio video head".split())
NEVER = RAW | frozenset("nav footer aside dialog menu".split())
CONTAINERS = frozenset("article main section div body td".split())
#: What of RAW holds tags, and so may lack its end without taking the rest of the page with it.
SHOWN, FOREIGN, UNSEEN = frozenset("button object".split()), frozenset("svg math".split()), frozenset("noscript template select canvas audio video".split())
IN_HEAD = frozenset("base link meta title script style noscript template".split())
CLOSES_P = BLOCKS - {"br"}
INLINE = frozenset("a b i em strong span".split())
#: What ends the one before it of its kind, and what such a one lies in.
ENDS_LIKE, HOLDERS = frozenset("li td tr dt dd option".split()), frozenset("ul ol table dl select menu tbody tr".split())
HOLDS_HTML = re.compile("<(?:foreignobject|desc|title|annotation-xml)", re.IGNORECASE)
#: Class and id words of what is not article.
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscri\w*|signup|login|menu|nav\w*|breadcrumbs?|side-?bar|widget|footer|masthead|toolbar|share|sharing|social|related|recommend\w*|more-stories|comments?|disqus|replies|respond|pagination|pager|skip-link|byline-tools|copyright|legal)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Words for what readers wrote: such a part is no article, however long it is.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?:$|[\s_-])", re.IGNORECASE)
#: Classes that tell how a page looks, not what a part of it is.
STATES = re.compile(r"(?<![\w-])(?:has|no|with|without|is|show|hide)-[\w-]+|[\w-]*-(?:no|has|with)-[\w-]+|[\w-]+-(?:open|opened|closed|active|enabled|disabled|visible|collapsed|expanded|less)(?![\w-])", re.IGNORECASE)
#: What is typed or picked in a form; a form around a page is hidden by these alone.
CONTROLS = frozenset("label legend datalist output meter progress".split())
#: Why a part is left out: by its class, id or place; by an attribute; by what it is.
BY_NAME, BY_ATTRIBUTE, BY_TAG = 1, 2, 3
#: The longest article or main element leads if it has this share of the unlinked letters.
LEADS = 0.2
#: A start tag to its end, quoted values whole; where a quote is never closed, to the first ">".
OPEN = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>""")
OPEN_BARE = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
SPACE = re.compile(r"\s+")
DEEPEST = 512
#: Words that say so only outside an article, where they stand over its title.
HEADER = re.compile(r"(?:^|[\s_-])(?:header|banner)(?:$|[\s_-])", re.IGNORECASE)
#: A container with fewer letters than this share of the page's best one is not taken for the article.
LEAST_SHARE = 0.08


class Node:
    __slots__ = ("tag", "path", "parent", "hidden", "linked", "depth", "weight", "within", "why", "never", "readers")

    def __init__(self, tag: str, path: int, parent: Node | None, why: int, linked: bool, readers: bool = False):
        self.tag, self.path, self.parent, self.hidden, self.linked = tag, path, parent, False, linked
        #: Why it is left out itself (0: it is not); whether it or what it lies in is by its tag, and what readers wrote.
        self.why, self.never = why, why == BY_TAG or bool(parent and parent.never)
        self.readers = readers or bool(parent and parent.readers)
        self.depth = parent.depth + 1 if parent else 0
        #: The nearest article, or else the nearest main, that it is or lies in.
        self.within = self if tag == "article" or tag == "main" and not (parent.within and parent.within.tag == "article") else parent.within if parent else None
        self.weight = 0


class Paths:
    """Paths as numbers; a path is its parent's and a step."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(-1, "")]

    def below(self, path: int, step: str) -> int:
        if (path, step) not in self.numbers:
            self.numbers[path, step] = len(self.steps)
            self.steps.append((path, step))
        return self.numbers[path, step]

    def name(self, path: int) -> str:
        out = []
        while path > 0:
            path, step = self.steps[path]
            out.append(step)
        return "".join(f"/{s}" for s in reversed(out))

    def find(self, name: str) -> int | None:
        path = 0
        for step in name.split("/")[1:]:
            path = self.numbers.get((path, step), -1)
            if path < 0:
                return None
        return path


def step_of(tag: str, attrs: dict[str, str]) -> str:
    """A tag and the first class that is no number or hash."""
    for c in attrs.get("class", "").split():
        if c := re.sub(r"[\d/]+", "", c).strip("-_").lower():
            return f"{tag}.{c}"
    return tag


class Page:
    """The elements of a page, and its text as (element, text, starts a new block)."""

    def __init__(self, page: str):
        self.page, self.last, self.strict = page, page.rfind(">"), True
        self.ends: dict[str, list[tuple[int, int]]] = {}
        self.blocks: list[int] | None = None
        self.paths = Paths()
        self.root = self.here = Node("", 0, None, 0, False)
        self.nodes, self.runs, self.fresh = [self.root], [], True
        at = 0
        while at < len(page):
            tag = self.next_tag(at)
            self._text(at, tag[0] if tag else len(page))
            if not tag:
                break
            _, at, closes, name, attrs = tag
            if closes:
                self._close(name)
            elif name:
                at = self._open(name, attrs, at)
        self._hide()

    def _hide(self) -> None:
        """What is left out, now that all of the page is known. A part that only its name leaves out stays if it holds the
        longest article, or, where no article leads, over half of the unlinked letters. If nothing is left, only tags and
        names leave parts out; if still nothing is, only tags."""
        letters: dict[int, int] = {}
        for n in reversed(self.nodes):  # children come after their parents
            letters[id(n)] = letters.get(id(n), 0) + (0 if n.linked or n.never or n.readers else n.weight)
            if n.parent is not None:
                letters[id(n.parent)] = letters.get(id(n.parent), 0) + letters[id(n)]
        every = letters[id(self.root)]
        leading = max((n for n in self.nodes if n.tag in ("article", "main")), key=lambda n: letters[id(n)], default=None)
        keep: set[int] = set()
        if leading is not None and letters[id(leading)] >= LEADS * every:
            n = leading
            while n is not None:
                keep.add(id(n))
                n = n.parent
        else:
            keep = {id(n) for n in self.nodes if 2 * letters[id(n)] > every}
        weights = [n.weight for n in self.nodes]
        for reasons in ((BY_NAME, BY_ATTRIBUTE, BY_TAG), (BY_NAME, BY_TAG), (BY_TAG,)):
            for n, weight in zip(self.nodes, weights, strict=True):
                named = n.why == BY_NAME and not (id(n) in keep and letters[id(n)])
                n.hidden = bool(n.parent and n.parent.hidden) or n.why in reasons and (n.why != BY_NAME or named)
                n.weight = 0 if n.hidden else weight
            if any(n.weight for n in self.nodes):
                break
        runs, fresh = [], False
        for node, text, starts in self.runs:
            fresh = fresh or starts
            if not node.hidden:
                if runs or text.strip():
                    runs.append((node, text, fresh))
                fresh = False
        self.runs = runs

    def next_tag(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closes, name, attributes) of what next is no text; comments and the like have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            c = page[at + 1 : at + 2]
            if c in ("!", "?") and c:
                if page.startswith("<!--", at):
                    end = page.find("-->", at + 4) + 3
                    end = at + 5 if page.startswith("<!-->", at) else end if end >= 3 else len(page)
                else:
                    end = page.find(">", at) + 1 if at < self.last else len(page)
                return at, end, False, "", ""
            letter = page[at + 2 : at + 3] if c == "/" else c
            if not (letter.isascii() and letter.isalpha()):
                at += 1
            elif at > self.last:  # a tag without an end
                return at, len(page), False, "", ""
            elif c == "/":
                end = page.find(">", at) + 1
                return at, end, True, re.split(r"[\s/>]", page[at + 2 : end], maxsplit=1)[0].lower(), ""
            else:
                m = OPEN.match(page, at) if self.strict else None
                if not m:  # no end but inside quotes: from here on quotes mean nothing
                    self.strict = False
                    m = OPEN_BARE.match(page, at)
                return at, m.end(), False, m[1].lower(), m[2]
        return None

    def _text(self, at: int, stop: int) -> None:
        if stop <= at or self.here.never:
            return
        text = self.page[at:stop]
        if text.strip():
            self.runs.append((self.here, text, self.fresh))
            self.fresh = False
            self.here.weight += len(text) - text.count(" ")
        elif self.runs and not self.fresh:
            self.runs.append((self.here, " ", False))

    def _close(self, tag: str) -> None:
        n = self.here
        while n is not self.root and n.tag != tag:
            if tag in INLINE and n.tag in BLOCKS:
                return
            n = n.parent
        if n is not self.root:
            self.fresh = self.fresh or tag in BLOCKS
            self.here = n.parent
        elif tag == "p":
            self.fresh = True

    def _open(self, tag: str, written: str, at: int) -> int:
        """Takes a start tag in, and returns where to go on."""
        self.fresh = self.fresh or tag in BLOCKS
        if tag in VOID:
            return at
        empty = written.rstrip().endswith("/")
        if tag in RAW and not empty:
            if (end := self._end_of(tag, at)) is not None:
                return end
            if tag == "head":
                return self._head_end(at)
            if tag in FOREIGN:
                return self._next_block(at)
            if tag not in SHOWN | UNSEEN:
                return len(self.page)
            if tag in SHOWN:
                return at
        if tag in CLOSES_P:  # an open paragraph ends where a block begins
            self._up_to("p", BLOCKS)
        if tag in ENDS_LIKE:
            self._up_to(tag, HOLDERS)
        attrs = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(written)} if written.strip() else {}
        if tag == "a" and self.here.linked and self.here.tag == "a":  # links do not nest
            self.here = self.here.parent
        here = self.here
        named = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}"
        why = BY_TAG if tag in NEVER or tag in CONTROLS else BY_ATTRIBUTE if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() else 0
        said = STATES.sub(" ", named)
        readers = tag not in ("html", "body", "article", "main") and bool(READERS.search(said))
        if not why and ((tag == "header" or HEADER.search(said)) and here.within is None or tag == "form" or tag not in ("html", "body", "article", "main") and NOT_ARTICLE.search(said)):
            why = BY_NAME
        if empty and tag not in BLOCKS:
            return at
        parent = here if here.depth < DEEPEST else here.parent
        path = self.paths.below(parent.path, step_of(tag, attrs)) if tag in BLOCKS else parent.path
        self.here = Node(tag, path, parent, why, parent.linked or tag == "a" and "href" in attrs, readers)
        self.nodes.append(self.here)
        return at

    def _up_to(self, tag: str, stop: frozenset) -> None:
        """Ends the nearest open element of that tag, if none of stop is between."""
        n = self.here
        while n is not self.root:
            if n.tag == tag:
                self.here = n.parent
                return
            if n.tag in stop:
                return
            n = n.parent

    def _end_of(self, tag: str, at: int) -> int | None:
        """Behind the end tag of an element of RAW, if it is its own: a button or select ends where the next begins, a
        drawing where a block does."""
        if tag not in self.ends:
            self.ends[tag] = [(m.start(), m.end()) for m in re.finditer(rf"</{re.escape(tag)}(?:[\s/][^>]*)?>", self.page, re.IGNORECASE)]
        k = bisect_left(self.ends[tag], (at, 0))
        if k == len(self.ends[tag]):
            return None
        start, end = self.ends[tag][k]
        if tag in ("button", "select"):
            if tag + "<" not in self.ends:
                self.ends[tag + "<"] = [(m.start(), 0) for m in re.finditer(rf"<{tag}[\s>]", self.page, re.IGNORECASE)]
            if bisect_left(self.ends[tag + "<"], (at, 0)) < bisect_left(self.ends[tag + "<"], (start, 0)):
                return None
        if tag in FOREIGN and self._next_block(at) < start and not HOLDS_HTML.search(self.page, at, start):
            return None
        return end

    def _next_block(self, at: int) -> int:
        if self.blocks is None:
            self.blocks = [m.start() for m in re.finditer(r"</?([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])", self.page) if m[1].lower() in BLOCKS]
        k = bisect_left(self.blocks, at)
        return self.blocks[k] if k < len(self.blocks) else len(self.page)

    def _head_end(self, at: int) -> int:
        """Where the body begins in a page that does not end its head: at text, or a tag that no head holds."""
        while tag := self.next_tag(at):
            start, end, closes, name, written = tag
            if self.page[at:start].strip():
                return at
            if name and name not in IN_HEAD:
                return start
            at = end
            if name in RAW and not closes and not written.rstrip().endswith("/"):
                at = self._end_of(name, at) or len(self.page)
        return at

    def scores(self) -> dict[int, float]:
        """By path of a container: letters of text that are not links, its own and, at a loss with each step, those below."""
        passed: dict[int, float] = {}
        whole: dict[int, float] = {}
        out: dict[int, float] = {}
        for n in reversed(self.nodes):  # children come before their parents
            gain = 0.0 if n.hidden else n.weight * (-1 if n.linked else 1)
            k = id(n)
            near, all_of = gain + passed.pop(k, 0.0), gain + whole.pop(k, 0.0)
            seen = k in out  # something below has text
            if n.weight and not n.hidden or seen:
                out.pop(k, None)
                if n.parent is not None:
                    out[id(n.parent)] = 0.0
                if n.tag in CONTAINERS or n.parent is None:  # the page itself, for pages without a body
                    key = -1 - n.path
                    out[key] = out.get(key, 0.0) + near + (0.2 * all_of if n.tag in ("article", "main") else 0.0)
                    near *= 0.9
            if n.parent is not None:
                passed[id(n.parent)] = passed.get(id(n.parent), 0.0) + near
                whole[id(n.parent)] = whole.get(id(n.parent), 0.0) + all_of
        return {-1 - k: v for k, v in out.items() if k < 0}

    def best(self, found: dict[int, float]) -> int:
        """The path that scores best, or of what holds it: the article that all its elements are in, or their common
        container where they stand side by side."""
        path = min(found, key=lambda p: (-found[p], self.paths.name(p)))
        held = [n for n in self.nodes if n.path == path and n.tag in CONTAINERS and not n.hidden]
        around = {id(n.within): n.within for n in held}
        if len(around) == 1 and (one := next(iter(around.values()))) is not None:
            return one.path
        parents = {id(n.parent): n.parent for n in held if n.parent is not None}
        if len(held) > 1 and len(parents) == 1:
            up = next(iter(parents.values()))
            if up.tag in CONTAINERS and up.tag != "body":
                return up.path
        return path


def host_of(url: str | None) -> str | None:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else None


def vote(html: str | None) -> tuple[str, float] | None:
    """The path of the page's best container, and its score."""
    if not html:
        return None
    page = Page(html)
    found = page.scores()
    if not found:
        return None
    path = page.best(found)
    return page.paths.name(path), found.get(path, 0.0)


def extract(html: str | None, path: str | None) -> str:
    """The blocks of the elements at path, in page order; of the page's best container where path has next to nothing."""
    if not html:
        return ""
    page = Page(html)
    found = page.scores()
    if not found:
        return ""
    at = page.paths.find(path) if path is not None else None
    if at is None or found.get(at, 0.0) < LEAST_SHARE * max(found.values()):
        at = page.best(found)
    blocks: list[list[str]] = []
    inside: set[int] = set()
    for n in page.nodes:  # parents come before their children
        if n.path == at or n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
    fresh = True
    for node, text, starts in page.runs:
        fresh = fresh or starts
        if id(node) in inside:
            if fresh:
                blocks.append([])
                fresh = False
            blocks[-1].append(text)
        else:
            fresh = True
    lines = (SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def winners(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with most votes of the host's pages; score, then name, break ties."""

    def run(batches):
        for batch in small(batches):
            rows = [(host_of(u), *v) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (v := vote(h))]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array([round(x) for x in cols[2]], pa.int64())], names=["host", "path", "score"])

    votes = pages.select(url, html).mapInArrow(run, "host string, path string, score long")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


#: So many hosts are broadcast, a path each; more meet their pages by host and salt.
MOST_BROADCAST = 50_000
SALTS = 32


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.lower(F.regexp_extract(F.col(url), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    won = cut(winners(pages, url, html), "host-paths").select(F.coalesce("host", F.lit("")).alias("_host"), "path")
    won = won.groupBy("_host").agg(F.min("path").alias("path"))  # an empty host and none are one
    held = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("_host", F.coalesce(host, F.lit(""))).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def run(batches):
        for batch in small(batches):
            texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if won.count() <= most_broadcast:
        joined = held.join(F.broadcast(won), "_host", "left").select("page_id", "url", "html", "path")
    else:
        salted = won.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = held.join(salted, ["_host", "_salt"], "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
