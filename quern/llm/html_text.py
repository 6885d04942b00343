"""Main text of HTML pages: site template removal.

Every page is parsed into a light tree. Each element's subtree is hashed by its tag names, class names and text; a
page sends the hashes that it holds, once each, and Spark counts on how many pages of a host with different articles a
subtree occurs (pages of the same article count once, so an article's own text never recurs). Subtrees on at least
`MIN_PAGES` of them are the host's template and are deleted from its pages where they stand outside the main content
(article or main). Inside it only plain boxes (div, section, aside ...) on `MIN_SHARE` of the host's pages, and `MIN_INSIDE` of
them, are deleted: paragraphs, headings, tables, lists and figures stay even if articles share them. So it is on pages
that mark no main content, but for tables and lists, which may be menus there.

What counts can't see is left out by what HTML itself defines: nav, header, footer (but a quotation's own), aside, form, script,
style and the like; hidden elements and the roles of navigation, banners, forms and so on. Reader comments differ from page to page, so
their boxes are known by class or id.

The column `rule` tells what gave the text: `template` where the template and HTML's elements have left the article and nothing else;
`article` where more was left, as on hosts of too few pages to count, and the element that the page marks as its main content was
taken; `page` where no such element is marked.

Defined results: null or empty html and pages with nothing left give an empty text; pages without a host are counted
as one host; unclosed and misnested tags are closed as browsers close them; a tag, comment or script that never ends
reaches to the page's end; a quote that never ends is an ordinary character; a null page_id is kept; repeated rows get a
row each. Pages take time in proportion to their length, whatever is in them. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator, Set

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Recent, Scratch, encoded, if_small, partitions, small_batches, state, written
from quern.llm.urls import host_of

MIN_PAGES, MIN_SHARE, MIN_INSIDE = 3, 0.1, 5
BROADCAST_DIGESTS, BROADCAST_HOSTS, PER_SALT = 400_000, 100_000, 20_000
#: A tag with attributes in order, without a way back; whatever it doesn't match goes to _odd_tag.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+)\s*+(/?+)>""")
_ATTRIBUTE = re.compile(r"""\s++([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?+""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_START, _BLANKS, _NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"<(/?)([a-zA-Z][^\s/>]*+)", r"[\s/]*+", r"=?[^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
_RAW = frozenset("script style textarea title noscript iframe xmp template svg noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav header footer aside form button select option input dialog menu head fieldset".split()) | _RAW - {"xmp"}
_BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre address "
    "figure figcaption xmp hr nav header footer aside form fieldset details summary center hgroup search menu dialog".split()
)
_CONTAINER = frozenset("div section aside ul ol dl table details figure center nav header footer form menu".split())
#: Boxes that may be template inside an article; inside main, what may stand beside its articles.
_BOX = _CONTAINER - frozenset("ul ol dl table details figure".split())
_BESIDE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure dl address hgroup".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_COMMENT_BOX = frozenset("div section article aside ol ul dl table details form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
#: Tags that end an open p, and for each tag the open ones it ends itself.
_ENDS_P = _BLOCK - {"html", "body", "li", "td", "th", "tr", "dt", "dd", "thead", "tbody", "tfoot", "caption"}
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tbody", "tr", "td", "th")}
_SCOPE = frozenset("html body table ul ol dl td th article main section div".split())
_FORMAT = frozenset("a b i em strong span u s small big font tt code sub sup mark abbr cite q kbd var time ins del".split())
_WHITE = re.compile(r"\s+")


class Node:
    """An element. off: by its attributes it is no main content."""

    __slots__ = ("tag", "marks", "off", "kids", "digest")

    def __init__(self, tag: str, marks: str = "", off: bool = False):
        self.tag, self.marks, self.off, self.kids, self.digest = tag, marks, off, [], None


def _marked(attributes: Iterable[tuple[str, str]]) -> tuple[str, bool, bool]:
    """Class names, id and role as one string; whether they say that it is no main content; whether, if it is a box, of comments."""
    found, off, comments = [], False, False
    for name, value in attributes:
        name, value = name.lower(), html.unescape(value).lower()
        if name in ("class", "id"):
            found.append(value)
            comments = comments or any(piece in _COMMENTS for word in value.split() for piece in re.split(r"[-_]+", word))
        elif name == "role":
            found.append(value)
            off = off or value in _ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            off = True
    return " ".join(found), off, comments


def _marks(attributes: str) -> tuple[str, bool, bool]:
    if "marks" not in state():
        state()["marks"] = Recent(lambda text: _marked((name, a or b or c) for name, a, b, c in _ATTRIBUTE.findall(text)), 4096)
    return state()["marks"][attributes]


def _odd_tag(text: str, at: int, last: dict[str, int]) -> tuple[list[tuple[str, str]], int]:
    """Attributes and end of a tag whose name ends at `at`, of any form, read once from left to right as browsers do."""
    found: list[tuple[str, str]] = []
    while True:
        at = _BLANKS.match(text, at).end()
        if at > last[">"]:
            return found, len(text)
        if text[at] == ">":
            return found, at + 1
        name = _NAME.match(text, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(text, at):
            at = equals.end()
            quote = text[at : at + 1]
            if quote and quote in "\"'" and at < last[quote]:
                end = text.index(quote, at + 1)
                value, at = text[at + 1 : end], end + 1
            else:
                bare = _BARE.match(text, at)
                value, at = bare[0], bare.end()
        found.append((name[0], value))


class _Open:
    """The stack of open elements, with the places of each tag, of scopes and of blocks in it."""

    def __init__(self, root: Node):
        self.stack, self.of, self.scopes, self.blocks = [root], {}, [], []

    def push(self, node: Node) -> None:
        at, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.of.setdefault(tag, []).append(at)
        if tag in _SCOPE:
            self.scopes.append(at)
        if tag in _BLOCK:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.of[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def innermost(self, *tags: str) -> int:
        return max((places[-1] for tag in tags if (places := self.of.get(tag))), default=0)

    def end(self, tags: tuple[str, ...]) -> None:
        """Closes the innermost open element of these tags, if no other scope lies inside it."""
        at = self.innermost(*tags)
        if at and not (self.scopes and self.scopes[-1] > at):
            self.cut(at)

    def close(self, tag: str) -> None:
        """What an end tag does."""
        at = self.innermost(tag)
        barrier = self.blocks if tag in _FORMAT else self.scopes if tag == "p" else []
        if at and not (barrier and barrier[-1] > at):
            self.cut(at)


def parse(text: str) -> Node:
    """Tree of a page. Texts are str kids, decoded; elements that are never main content hold their text for the hash only."""
    root = Node("html")
    held, at, n = _Open(root), 0, len(text)
    stack = held.stack
    last = {c: text.rfind(c) for c in ">\"'"}
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            stack[-1].kids.append(html.unescape(text[at:]))
            break
        if lt > at:
            stack[-1].kids.append(html.unescape(text[at:lt]))
        m = _TAG.match(text, lt) if lt < last[">"] else None
        if m:
            closing, tag, at = m[1], m[2].lower(), m.end()
        else:
            m = _START.match(text, lt)
            if m is None:
                at = _other(text, lt, last, stack[-1])
                continue
            closing, tag = m[1], m[2].lower()
            attributes, at = _odd_tag(text, m.end(), last)
            m = None
        if closing:
            held.close(tag)
            continue
        if tag in ("html", "body") and len(stack) > 1 or tag == "html":
            continue
        if tag in _ENDS_P:
            held.end(("p",))
        if tag in _ENDS:
            held.end(_ENDS[tag])
        if m is None:
            words, off, comments = _marked(attributes)
        else:
            words, off, comments = _marks(m[3]) if m[3] and _TELLING.search(m[3]) else ("", False, False)
        node = Node(tag, words, tag != "body" and (off or comments and tag in _COMMENT_BOX))
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = _RAW_END[tag].search(text, at)
            node.kids.append(text[at : end.start() if end else n])
            at = text.find(">", end.end()) + 1 if end and end.end() <= last[">"] else n
        elif tag not in _VOID and not (m and m[4] and tag == "path"):
            held.push(node)
    return root


def _other(text: str, at: int, last: dict[str, int], node: Node) -> int:
    """Where a comment, declaration or lone < at `at` ends; a lone < and the text of CDATA go to `node`."""
    if text.startswith("<!--", at):
        end = text.find("-->", at + 2)
        return end + 3 if end >= 0 else len(text)
    if text.startswith("<![CDATA[", at):
        end = text.find("]]>", at)
        node.kids.append(text[at + 9 : end if end >= 0 else len(text)])
        return end + 3 if end >= 0 else len(text)
    if text[at + 1 : at + 2] in ("!", "?", "/"):
        return text.index(">", at) + 1 if at < last[">"] else len(text)
    node.kids.append("<")
    return at + 1


def _may_be_template(node: Node, inside: bool) -> bool:
    return node.tag not in ("html", "body", "article", "main") and node.tag in (_BOX if inside else _BLOCK)


def hashed(root: Node, out: list[int]) -> int:
    """Gives each element the digest of its subtree, gathers those that may be template; returns what tells the page's article
    from others: the digest of its main content if it marks one, else of all of it. Trees may be of any depth."""
    order, todo, mains = [], [(root, False)], []
    while todo:
        node, inside = todo.pop()
        if node.tag in ("article", "main") and not node.off and not inside:
            mains.append(node)
            inside = True
        order.append((node, inside))
        todo += [(kid, inside) for kid in node.kids if not isinstance(kid, str)]
    for node, inside in reversed(order):  # kids before their parents
        h = hashlib.blake2b(encoded(f"{node.tag}\0{int(node.off)}\0{node.marks}\0"), digest_size=8)
        for kid in node.kids:
            if isinstance(kid, str):
                said = _WHITE.sub(" ", kid).strip()
                if said:
                    h.update(b"t" + encoded(said))
            else:
                h.update(b"e" + kid.digest.to_bytes(8, "little", signed=True))
        node.digest = int.from_bytes(h.digest(), "little", signed=True)
        if _may_be_template(node, inside):
            out.append(node.digest)
    if not mains:
        return root.digest
    whole = hashlib.blake2b(b"".join(m.digest.to_bytes(8, "little", signed=True) for m in mains), digest_size=8)
    return int.from_bytes(whole.digest(), "little", signed=True)


def delete(root: Node, template: Set[int], broad: Set[int]) -> int:
    """Deletes template subtrees from a hashed tree and returns how many. `broad`: those that recur enough for the inside of an article and
    for pages that mark none."""
    if not template:
        return 0
    todo, marked = [root], False
    while todo and not marked:
        node = todo.pop()
        marked = node.tag in ("article", "main") and not node.off
        todo += [kid for kid in node.kids if not isinstance(kid, str)]
    deleted, walk = 0, [(root, False)]
    while walk:
        node, inside = walk.pop()
        inside = inside or node.tag in ("article", "main") and not node.off
        known = template if marked and not inside else broad
        for k, kid in enumerate(node.kids):
            if isinstance(kid, str):
                continue
            if kid.digest in known and _may_be_template(kid, inside) and (marked or kid.tag in _CONTAINER):
                node.kids[k] = Node(kid.tag, off=True)  # a block still parts what stands around it
                deleted += 1
            else:
                walk.append((kid, inside))
    return deleted


def main_content(root: Node) -> list[Node]:
    """What the page marks as its main content: all articles, with the paragraphs and headings beside them in a main; else main."""

    def seek(top: Node, tags: tuple[str, ...]) -> list[Node]:
        found, todo = [], [top]
        while todo:
            node = todo.pop()
            if node is not top and (node.off or node.tag in _DROP):
                continue
            if node is not top and node.tag in tags:
                found.append(node)
            else:
                todo += [kid for kid in reversed(node.kids) if not isinstance(kid, str)]
        return found

    articles = seek(root, ("article",))
    if not articles:
        return seek(root, ("main",))
    out: list[Node] = []
    for node in seek(root, ("main", "article")):
        if node.tag == "article":
            out.append(node)
        elif not seek(node, ("article",)):
            continue  # a main beside the articles
        else:
            for kid in node.kids:
                if not isinstance(kid, str) and not kid.off and kid.tag not in _DROP:
                    out += [kid] if kid.tag == "article" or kid.tag in _BESIDE else seek(kid, ("article",))
    return out


def blocks(root: Node, found: list[Node] | None = None) -> list[str]:
    """Texts of the blocks of `found`, or of what the page marks as its main content, or of all of it; in page order."""
    found = main_content(root) if found is None else found
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        said = _WHITE.sub(" ", "".join(part)).strip()
        part.clear()
        if said:
            out.append(said)

    def walk(top: Node) -> None:
        todo = [(top, iter(top.kids))]
        if top.tag in _BLOCK:
            flush()
        while todo:
            node, kids = todo[-1]
            kid = next(kids, None)
            if kid is None:
                todo.pop()
                if node.tag in _BLOCK:
                    flush()
            elif isinstance(kid, str):
                part.append(kid)
            elif kid.tag == "br":
                part.append(" ")
            elif not kid.off and (kid.tag not in _DROP or (kid.tag, node.tag) in (("header", "article"), ("footer", "blockquote"))):
                if kid.tag in _BLOCK:
                    flush()
                todo.append((kid, iter(kid.kids)))
            elif kid.tag in _BLOCK:
                flush()

    for node in found or [root]:
        walk(node)
    flush()
    return out


def main_text(text: str | None, template: Set[int] = frozenset(), broad: Set[int] = frozenset()) -> tuple[str, int, str]:
    """The main text of a page, how many template subtrees were deleted from it, and what gave the text."""
    root = parse(text or "")
    if template:
        hashed(root, [])
    deleted = delete(root, template, broad)
    found, left = main_content(root), blocks(root, [])
    if not found:
        return "\n\n".join(left), deleted, "page"
    own = blocks(root, found)
    return "\n\n".join(own), deleted, "template" if own == left else "article"


def template_counts(rows: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, digest, broad of all templates. `rows`: host, html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hosts, own, found = [], [], []
            for host, text in zip(pdf["host"], pdf["html"]):
                held: list[int] = []
                article = hashed(parse(text or ""), held)
                for digest in {*held, 0}:
                    hosts.append(host)
                    own.append(article)
                    found.append(digest)
            yield pd.DataFrame({"host": hosts, "page": np.array(own, np.int64), "digest": np.array(found, np.int64)})

    seen = rows.select("host", "html").mapInPandas(run, "host string, page long, digest long")
    counted = seen.distinct().groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages")).where((F.col("pages") >= min_pages) | (F.col("digest") == 0))
    counted = scratch.written(counted, "subtrees")
    of = counted.where("digest = 0").select("host", F.col("pages").alias("of"))
    often = counted.where("digest <> 0")
    small = if_small(of, BROADCAST_HOSTS)
    if small is None:  # a host's templates are dealt over salts
        salt = F.pmod(F.col("digest"), F.lit(64))
        joined = often.withColumn("salt", salt).join(of.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).hint("merge"), ["host", "salt"])
    else:
        joined = often.join(small, "host")
    return scratch.written(joined.select("host", "digest", ((F.col("pages") >= min_share * F.col("of")) & (F.col("pages") >= MIN_INSIDE)).alias("broad")), "templates")


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, text, n_chars, n_deleted (template subtrees), rule of every row of `pages` (page_id, url, html).

    Templates of at most `most` digests in all are broadcast, so that no page is shuffled. Beyond, pages meet their host's
    templates in a sorted stream; hosts of more than PER_SALT pages are dealt over salts, so that no task gets all of them.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    scratch = Scratch()
    template = template_counts(rows, scratch, min_pages, min_share)
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long, n_deleted int, rule string"

    def frame(pdf: pd.DataFrame, out: list[tuple[str, int, str]]) -> pd.DataFrame:
        own = pdf[["page_id", "url"]].assign(text=[t for t, _, _ in out], n_chars=np.array([len(t) for t, _, _ in out], np.int64))
        return own.assign(n_deleted=np.array([d for _, d, _ in out], np.int32), rule=[r for _, _, r in out])

    if template.limit(most + 1).count() <= most:
        sets: dict[str, tuple[set, set]] = {}
        for r in template.toArrow().to_pylist():
            every, broad = sets.setdefault(r["host"], (set(), set()))
            every.add(r["digest"])
            if r["broad"]:
                broad.add(r["digest"])
        held = spark.sparkContext.broadcast(sets)
        scratch.discard()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            none: tuple[set, set] = (set(), set())
            for pdf in batches:
                yield frame(pdf, [main_text(text, *held.value.get(host, none)) for text, host in zip(pdf["html"], pdf["host"])])

        return rows.mapInPandas(run, schema)

    template = written(template, "templates")
    scratch.discard()
    big = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_SALT).select("host", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts"))
    big = written(big, "big-hosts")
    small = if_small(big, BROADCAST_HOSTS)
    salts = F.coalesce("salts", F.lit(1))
    spread = lambda df: df.join(big.hint("merge") if small is None else small, "host", "left").withColumn("salts", salts)
    lost = [F.lit(None).cast(t).alias(c) for c, t in (("page_id", kind), ("url", "string"), ("html", "string"))]
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    known = spread(template).select("host", every, F.lit(0).alias("order"), "broad", "digest", *lost)
    own = spread(rows).select("host", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("order"), F.lit(False).alias("broad"), F.lit(None).cast("long").alias("digest"), "page_id", "url", "html")
    ordered = known.unionByName(own).repartition(partitions(spark), "host", "salt").sortWithinPartitions("host", "salt", "order")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, t, b = None, set(), set()
        for pdf in batches:
            at, out = [], []
            for k, (host, salt, order, broad, digest, text) in enumerate(zip(pdf["host"], pdf["salt"], pdf["order"], pdf["broad"], pdf["digest"], pdf["html"])):
                if (host, salt) != key:
                    key, t, b = (host, salt), set(), set()
                if order == 0:
                    t.add(int(digest))
                    if broad:
                        b.add(int(digest))
                else:
                    at.append(k)
                    out.append(main_text(text, t, b))
            yield frame(pdf.iloc[at].astype({"page_id": "Int64"} if kind in ("int", "bigint", "smallint", "tinyint") else {}), out)

    return ordered.withColumn("digest", F.coalesce("digest", F.lit(0))).mapInPandas(stream, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
