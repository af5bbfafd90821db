"""Main text of web pages by site style trees.

Each page is parsed once into blocks of text and element nodes. The trees of all pages of a host are merged by path:
tag, class names and, for containers, the place among equal siblings. A node of the merged tree has

- presentation importance: the entropy of its styles, that is of the sequences of its children,
- content importance: the entropy of the contents of its leaves (what all pages repeat has none),
- the share of the page's text, but repeated and linked text, against its largest sibling, and how much is links,
- a sign of its markup: article and main speak for it, names of menus, adverts and so on against it.

They are added with weights to what the node inherits from its parent; what comes out negative goes. So
markup is one sign among others: an unnamed menu goes by its links, an unnamed notice by its repetition, and a
paragraph whose class only resembles a noise word stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import columns, is_small, map_batches, materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|object|canvas|audio|video|select|textarea|button|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Elements without content, inline elements, those that end an open paragraph's text, and what is never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover mstyle semantics annotation svg g path text tspan".split()
)
CONTAINERS = frozenset("div section table tbody tr td ul ol dl center main article aside nav".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer"
    " comment comments disqus discussion reply replies respond notice cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search share"
    " sharing social related recommended recommendations widget toolbar pagination pager skip copyright legal disclaimer contentinfo complementary alert".split()
)
#: Words of names that say nothing of the content.
SHAPE_WORDS = frozenset("top bottom left right main page site list item items box block area wrap wrapper container inner outer section links link buttons button bar form row col column group panel 0 posts articles stories unit slot".split())
SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
#: Weights of markup, links, share of text, repetition and variety of styles, and the pages from which a host's repetition says anything.
SIGN, LINKS, MASS, REPEATED, STYLES, PAGES = 1.5, 2.0, 1.0, 1.5, 0.5, 4
#: Levels of the tree: what lies deeper belongs to the branch of its ancestor there, text and all.
DEPTH = 64
#: Share of what its largest sibling says that speaks neither for nor against a node.
SMALL = 0.2


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].split(":")[0]


def sign_of(tag: str, words: set[str], in_main: bool) -> float:
    """What tag and names say: 1 for the main text, -1 against it; names that are only partly noise count in part."""
    telling = words - SHAPE_WORDS
    noise = len(telling & NOISE_WORDS) / len(telling) if telling and tag not in ("html", "body") else 0.0
    if noise:
        return -noise
    return 1.0 if tag in MAIN_TAGS else -1.0 if tag in NOISE_TAGS and not (tag == "header" and in_main) else 0.0


class Page:
    """Blocks, styles and nodes of a page; ``feed`` reads it in linear time and forgives what browsers forgive."""

    def __init__(self, text: str):
        self.blocks: list[dict] = []
        self.children: dict[str, list[str]] = {}
        self.signs: dict[str, float] = {}
        self.stack: list[tuple[str, str, int, bool, bool, bool, dict]] = [("", "", 0, False, False, False, {})]  # tag, path, depth, hidden, in main text, in a link, children by name
        self.places: dict[str, list[int]] = {}  # where each open tag stands in the stack
        self.text: list[str] = []
        self.linked = 0
        self.feed(text)

    def flush(self) -> None:
        if self.text:
            words, linked = " ".join("".join(self.text).split()), self.linked
            self.text.clear()
            self.linked = 0
            if words:
                self.blocks.append({"path": self.stack[-1][1], "text": words, "links": min(linked, len(words))})

    def say(self, text: str) -> None:
        if text and not self.stack[-1][3]:
            text = html.unescape(text)
            self.text.append(text)
            if self.stack[-1][5]:
                self.linked += len(text.strip())

    def find(self, tag: str) -> int:
        """Place of the last open ``tag``, 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()

    def feed(self, page: str) -> None:
        at = 0
        for m in TOKEN.finditer(page):
            self.say(page[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                if m[0].startswith("<![CDATA[") and not self.stack[-1][3]:
                    self.text.append(m[0][9:].removesuffix("]]>"))
            elif (tag := tag.lower()) in ("br", "hr"):
                self.text.append(" ")
            elif tag not in VOID:
                if tag not in INLINE:
                    self.flush()
                if m[2]:
                    opened = self.find(tag)
                    if opened:
                        self.close(opened)
                else:
                    self.open(tag, m[4])
        self.say(page[at:])
        self.flush()

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            for c in ("p",) if tag != "li" else ("p", "li"):
                opened = self.find(c)
                if opened and max(map(self.find, ("table", "ul", "ol", "article"))) < opened:
                    self.close(opened)
        _, path, depth, hidden, main, linked, named = self.stack[-1]
        name, words = tag, set()
        if attributes:
            words = {re.sub(r"[0-9]+", "0", w.lower()).replace("/", "|") for found in NAMED.findall(attributes) for w in SPLIT.split("".join(found)) if w}
            name = ".".join([tag, *sorted(words)])
            hidden = hidden or bool(HIDDEN.search(attributes))
        hidden = hidden or tag == "head"
        if tag not in INLINE:
            nth = named[name] = named.get(name, -1) + 1
            whole = f"{name}~{nth}" if nth and tag in CONTAINERS else name
            if not hidden and depth < DEPTH:
                kids = self.children.setdefault(path, [])
                if not kids or kids[-1] != name:
                    kids.append(name)
            depth += 1
            if depth <= DEPTH:
                path = f"{path}/{whole}"
                sign = self.signs[path] = sign_of(tag, words, main)
                main = (main or tag in MAIN_TAGS) and sign >= 0
        if not attributes.endswith("/") or tag not in INLINE:
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, path, depth, hidden, main, linked or tag == "a", named if tag in INLINE else {}))

    def nodes(self) -> list[dict]:
        """Each node that has text under it: its characters, those in links, its share of the page, its sign."""
        chars: dict[str, list[int]] = {}
        for b in self.blocks:
            path = b["path"]
            while path:
                sums = chars.setdefault(path, [0, 0])
                sums[0] += len(b["text"])
                sums[1] += b["links"]
                path = path.rpartition("/")[0]
        total = max(1, sum(len(b["text"]) for b in self.blocks))
        return [{"path": p, "chars": c, "links": n, "share": c / total, "sign": self.signs.get(p, 0.0)} for p, (c, n) in chars.items()]

    def styles(self) -> list[dict]:
        return [{"path": p, "style": ",".join(c)} for p, c in self.children.items()]


PARSED = (
    "page_id long, url string, host string, blocks array<struct<path:string,text:string,links:long>>, styles array<struct<path:string,style:string>>,"
    " nodes array<struct<path:string,chars:long,links:long,share:double,sign:double>>"
)


def parse_pages(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            parsed = [Page(h or "") for h in b["html"]]
            yield {"page_id": b["page_id"], "url": b["url"], "host": list(map(host_of, b["url"])), "blocks": [p.blocks for p in parsed], "styles": [p.styles() for p in parsed], "nodes": [p.nodes() for p in parsed]}

    return map_batches(columns(pages, page_id="long", url="string", html="string"), run, PARSED, 200)


def style_tree(parsed: DataFrame, least_pages: int = PAGES) -> DataFrame:
    """``host, path, sign, rest`` of every node of each host's merged tree: what its markup says and all other evidence.

    All are sums per host and path with partial sums before each shuffle, so a host or path that holds a third of all
    pages needs no task of its own. Entropies are 1 - sum(c log c) / (n log n) for counts c of n. Repetition and links
    of a branch are those of its best leaf: a branch is not blamed for a part of it.
    """
    entropy = lambda n, clogc: F.when(F.col(n) > 1, 1 - F.col(clogc) / F.col(n) / F.log(n)).otherwise(1.0)
    counted = lambda df, what: df.groupBy("host", "path", what).agg(F.count("*").alias("c")).groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    contents = parsed.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b.path.alias("path"), F.xxhash64(b.text).alias("content"))))).alias("b")).select("host", "b.path", "b.content")
    new = counted(contents, "content").select("host", "path", entropy("n", "clogc").alias("new"))
    linked = parsed.select("host", F.explode("blocks").alias("b")).groupBy("host", "b.path").agg((F.sum("b.links") / F.sum(F.length("b.text"))).alias("linked"))
    best = new.join(linked, ["host", "path"]).where("path <> ''").select("host", "new", "linked", F.explode(_lines()).alias("path")).groupBy("host", "path").agg(F.max("new").alias("new"), F.min("linked").alias("linked"))
    styles = counted(parsed.select("host", F.explode("styles").alias("s")).select("host", "s.path", "s.style"), "style").select("host", "path", F.when(F.col("n") > 1, entropy("n", "clogc")).otherwise(0.0).alias("styles"))
    nodes = parsed.select("host", F.explode("nodes").alias("x")).select("host", "x.*").groupBy("host", "path").agg(F.count("*").alias("pages"), F.avg("share").alias("share"), F.avg("sign").alias("sign"))
    nodes = nodes.join(best, ["host", "path"]).join(styles, ["host", "path"], "left").withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    nodes = nodes.withColumn("repeated", F.when(F.col("pages") >= least_pages, 1 - F.col("new")).otherwise(0.0)).withColumn("said", F.col("share") * (1 - F.col("repeated")) * (1 - F.col("linked")))
    family = nodes.groupBy("host", "parent").agg(F.max("said").alias("largest"), F.count("*").alias("siblings"))
    mass = F.when((F.col("siblings") > 1) & (F.col("largest") > 0), F.col("said") / F.col("largest") - SMALL).otherwise(0.0)
    rest = MASS * mass - LINKS * F.greatest(F.lit(0.0), F.col("linked") - 0.5) - REPEATED * F.col("repeated") + STYLES * F.coalesce("styles", F.lit(0.0))
    return nodes.join(family, ["host", "parent"]).select("host", "path", (SIGN * F.col("sign")).alias("sign"), rest.alias("rest"))


def _lines() -> Column:
    """The path and all paths above it, from the top."""
    parts = F.split("path", "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def low_branches(tree: DataFrame) -> DataFrame:
    """``host, path`` of nodes whose importance is negative: what they inherit (-1 to 1) and their own evidence.

    In a branch that goes, only markup speaks for a part of it.
    """
    ancestors = tree.select("host", F.col("path").alias("leaf"), F.posexplode(_lines()).alias("depth", "path")).join(tree, ["host", "path"])
    lines = ancestors.groupBy("host", F.col("leaf").alias("path")).agg(F.array_sort(F.collect_list(F.struct("depth", "sign", "rest"))).alias("line"))
    step = lambda i, x: F.when(i < 0, F.greatest(i, F.lit(-1.0)) + x.sign + F.least(F.lit(0.0), x.rest)).otherwise(F.least(i, F.lit(1.0)) + x.sign + x.rest)
    return lines.where(F.aggregate("line", F.lit(0.0), step) < 0).select("host", "path")


def extract(pages: DataFrame, least_pages: int = PAGES, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A page has the blocks of the branches that its host's tree keeps, in their order. A null or empty page has an empty
    text; nulls and repeated rows stay as rows (and count as pages of their host); an empty table gives no rows, and
    other columns are not read.
    """
    parsed = materialize(parse_pages(pages).withColumn("uid", F.monotonically_increasing_id()), "parsed")
    low = materialize(low_branches(style_tree(parsed, least_pages)), "low_branches")
    if is_small(low, broadcast_rows):
        joined = parsed.join(F.broadcast(low.groupBy("host").agg(F.collect_list("path").alias("low"))), "host", "left")
        kept = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("low", F.array()), b.path))
        texts = joined.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b.text), " ").alias("text"))
    else:  # many branches: blocks meet them one by one, hot hosts in salted parts
        blocks = parsed.select("uid", "host", F.posexplode("blocks").alias("at", "b")).select("uid", "host", "at", "b.path", "b.text", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"))
        dealt = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        kept = blocks.join(dealt, ["host", "path", "salt"], "left_anti").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("kept"))
        texts = parsed.join(kept, "uid", "left").select("page_id", "url", F.array_join(F.transform(F.coalesce("kept", F.array().cast("array<struct<at:int,text:string>>")), lambda b: b.text), " ").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
