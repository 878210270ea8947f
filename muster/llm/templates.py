"""Main text of web pages by removal of what their site repeats.

1. Each page is parsed and every element's subtree hashed: tag, names, text and the hashes of its children.
2. Spark counts, for each host and hash, in how many different surroundings (hashes of the parent) the subtree stands. A subtree that is repeated because
   the whole page is repeated stands in one; a menu, an advert or a footer stands in as many as there are pages. Subtrees of at least LEAST
   surroundings and SHARE of the host's pages are the host's template; those of FIRM of its pages firmly so.
3. Pages are parsed again with the template of their host. Template subtrees go, and so do those that their tag, role or name declares to be something
   else than the article. Prose of an article itself (paragraphs, headings, quotations, lists without links) is kept however often it recurs: a common
   sentence is no template. Where a page does not tell where its article is, a single block goes only with the firm template, for sentences recur more than structures do.

A host's template has at most (subtrees of a page) / SHARE hashes. All templates are broadcast while they are under BROADCAST_BYTES, and joined beyond it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, trimmed

LEAST, SHARE, FIRM = 4, 0.01, 0.3
BROADCAST_BYTES = 32 << 20

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: These stand within a line too, whatever they hold.
FLOWING = INLINE | frozenset("script style template noscript svg math iframe textarea select button input canvas object audio video label".split())
#: Elements of which an open one of these ends where another begins, up to the elements that hold them.
SIBLINGS = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("option", "optgroup"), (("option",), ("select", "datalist"))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(("tr",), (("td", "th", "tr"), ("table",))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",))),
}
#: End tags look no further than these.
SCOPE = frozenset("html table td th caption template object".split())
#: Never the article.
OTHER_TAGS = frozenset("head nav footer aside form button select input dialog menu script style noscript template iframe svg math canvas audio video object embed noembed noframes title textarea".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in a class or id by which pages name what is not the article.
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus reply replies respond pagination pager skip widget widgets search copyright".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*+>|</?[A-Za-z][^>]*>|<[!?/][^>]*>""", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|aria-hidden|hidden|itemprop)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
ENDS = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I) for name in RAW}


class Element:
    """An element with its children: elements, texts as they are in a page, and None for a break."""

    __slots__ = ("tag", "names", "role", "hidden", "children", "digest", "main")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.digest, self.main = tag, [], 0, tag in ("article", "main")
        self.names, self.role, self.hidden = "", "", False
        if attributes:
            for name, *value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), unescape("".join(value)).lower()
                if name in ("class", "id"):
                    self.names += f" {value}"
                elif name == "role":
                    self.role = value.strip()
                    self.main = self.main or self.role in ("main", "article")
                elif name == "itemprop":
                    self.main = self.main or "articlebody" in value.split()
                elif name == "style":
                    self.hidden = self.hidden or "display:none" in value.replace(" ", "")
                else:
                    self.hidden = self.hidden or name == "hidden" or value.strip() == "true"


def parse(html: str) -> Element:
    """The tree of a page. Every tag is read as browsers do in ordinary cases: void and raw elements, end tags left out or out of place."""
    root = Element("html")
    stack, at = [root], 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            done = stack.pop()
            stack[-1].children.append(done)
            stack[-1].main = stack[-1].main or done.main

    def text(begin: int, end: int) -> None:
        if end > begin:
            stack[-1].children.append(unescape(html[begin:end]))

    begin, size = 0, len(html)
    while True:
        found = TOKEN.search(html, at)
        if found is None:
            break
        token = found.group()
        at = found.end()
        text(begin, found.start())
        begin = at
        name = NAME.match(token)
        if name is None:  # a comment or declaration
            continue
        tag = name.group(1).lower()
        if token[1] == "/":
            floor = None
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].tag
                if open_tag == tag:
                    floor = k
                    break
                if tag in INLINE and open_tag not in INLINE or tag == "p" and open_tag not in INLINE or open_tag in SCOPE and tag not in ("table", "html", "body", "tr", "tbody", "thead", "tfoot"):
                    break
            if floor is not None:
                close(floor)
            elif tag not in INLINE:
                stack[-1].children.append(None)
            continue
        if tag in ("html", "body"):
            continue
        if tag in SIBLINGS:
            ended, within = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in within:
                    break
                if stack[k].tag in ended:
                    close(k)
                    if tag in ("li", "dt", "dd", "option", "optgroup", "td", "th"):
                        break
        if tag not in FLOWING:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in FLOWING:
                    break
        attributes = token[name.end() : -1]
        if tag in VOID:
            stack[-1].children.append(" " if tag == "br" else None if tag == "hr" else "")
            continue
        element = Element(tag, attributes if "=" in attributes or "hidden" in attributes.lower() else "")
        if tag in RAW:
            end = ENDS[tag].search(html, at)
            at = begin = end.end() if end else size
            stack[-1].children.append(element)
            continue
        stack.append(element)
    text(begin, size)
    close(1)
    return root


def walk(root: Element):
    """(element, parent) of all elements, children before parents, without recursion."""
    order, stack = [], [(root, None)]
    while stack:
        element, parent = stack.pop()
        order.append((element, parent))
        stack += [(x, element) for x in element.children if isinstance(x, Element)]
    return reversed(order)


def label(root: Element) -> None:
    """Gives each element the hash of its subtree; 0 to those without text."""
    for element, _ in walk(root):
        parts, some = [f"{element.tag}\0{' '.join(sorted(set(WORD.findall(element.names))))}"], False
        run: list[str] = []
        for child in element.children:
            if isinstance(child, str):
                run.append(child)
            else:
                words = "".join(run).split()
                if words:
                    parts.append(" ".join(words))
                    some = True
                run = []
                if child is not None and child.digest:
                    parts.append(f"\1{child.digest}")
                    some = True
        words = "".join(run).split()
        if words:
            parts.append(" ".join(words))
            some = True
        element.digest = xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63) if some else 0


def subtrees(root: Element) -> set[tuple[int, int]]:
    """(hash, hash of the parent) of the subtrees that may be a template's: all but inline ones and those without text."""
    return {(e.digest, p.digest) for e, p in walk(root) if p is not None and e.digest and e.tag not in INLINE}


def declared(element: Element, inside: bool) -> bool:
    """Whether an element says by tag, role or name that it is not the article; inside: it is within one."""
    tag = element.tag
    if tag in OTHER_TAGS or element.hidden or element.role in OTHER_ROLES:
        return True
    if tag == "header" and not inside:
        return True
    if element.names:
        words = set(WORD.findall(element.names))
        return bool(words & OTHER_NAMES) or not inside and "header" in words
    return False


def scopes(root: Element) -> list[Element]:
    """The elements that hold the article: <main>, or else the outermost articles, that are not within other parts; or else the page."""
    found: dict[str, list[Element]] = {"main": [], "article": []}
    stack = [root]
    while stack:
        element = stack.pop()
        if element is not root and declared(element, False) and not (element.main and element.tag not in OTHER_TAGS and element.tag not in ("article", "main")):
            continue
        if element.tag == "main" or element.role == "main":
            found["main"].append(element)
        elif element.main and (element.tag == "article" or not any(isinstance(x, Element) and x.main for x in element.children)) and element is not root:
            found["article"].append(element)
            continue
        stack += [x for x in reversed(element.children) if isinstance(x, Element)]
    return found["main"][:1] or found["article"] or [root]


def links_only(element: Element) -> bool:
    """Whether most of an element's text is in links."""
    linked = total = 0
    stack = [(element, element.tag == "a")]
    while stack:
        now, in_link = stack.pop()
        for child in now.children:
            if isinstance(child, str):
                n = len("".join(child.split()))
                total += n
                linked += n * in_link
            elif child is not None:
                stack.append((child, in_link or child.tag == "a"))
    return 2 * linked > total


def single(element: Element) -> bool:
    """Whether an element is one block: it holds no element but inline ones."""
    return all(child is None or isinstance(child, str) or child.tag in FLOWING for child in element.children)


def recurs(element: Element, template: set[int], firm: set[int], whole_page: bool) -> bool:
    """Whether a subtree is its site's and not its page's."""
    if element.main or element.digest not in template:
        return False
    if whole_page:
        return element.digest in firm or not single(element) and element.tag not in PROSE or links_only(element)
    return element.tag not in PROSE or links_only(element)


def blocks(scope: Element, template: set[int], firm: set[int], whole_page: bool) -> list[str]:
    """Texts of a scope's blocks in page order, without template subtrees and other parts."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        words = "".join(run).split()
        if words:
            out.append(" ".join(words))
        run.clear()

    stack: list = [scope]
    while stack:
        now = stack.pop()
        if isinstance(now, str):
            run.append(now)
        elif now is None:
            end()
        elif now is not scope and not (now.main and now.tag not in OTHER_TAGS and not declared_part(now)) and declared(now, not whole_page):
            if now.tag not in FLOWING:
                end()
        elif now is not scope and recurs(now, template, firm, whole_page):
            end()
        elif now.tag in FLOWING:
            stack += reversed(now.children)
        else:
            stack.append(None)
            stack += reversed(now.children)
            end()
    end()
    return out


def declared_part(element: Element) -> bool:
    """An article that is itself another part, such as a reader's comment."""
    return element.tag in ("article", "main") and declared(element, True)


def main_text(html: str | None, template: set[int] = frozenset(), firm: set[int] = frozenset()) -> str:
    """The article of a page: its blocks joined by two line ends."""
    if not html:
        return ""
    root = parse(html)
    label(root)
    held = scopes(root)
    return "\n\n".join(x for scope in held for x in blocks(scope, template, firm, scope is root))


def _hashes(batches):
    for batch in batches:
        for part in slices(batch):
            hosts, digests, parents = [], [], []
            for host, html in zip(part.column("host").to_pylist(), part.column("text").to_pylist(), strict=True):
                if html:
                    root = parse(html)
                    label(root)
                    found = subtrees(root)
                    hosts += [host] * len(found)
                    digests += [x[0] for x in found]
                    parents += [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(parents, pa.int64())], ["host", "digest", "parent"])


def _texts(batches):
    known: dict[str, tuple] = {}  # of a few hosts
    for batch in batches:
        for part in slices(batch):
            out = []
            for html, host, template, firm in zip(part.column("text"), part.column("host").to_pylist(), part.column("template"), part.column("firm"), strict=True):
                if host not in known:
                    if len(known) == 256:
                        known.clear()
                    known[host] = frozenset(template.as_py() or ()), frozenset(firm.as_py() or ())
                out.append(main_text(html.as_py(), *known[host]))
            kept = [c for c in part.schema.names if c not in ("text", "host", "template", "firm")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.string())], [*kept, "text"])


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, scratch: Scratch, least: int = LEAST, share: float = SHARE, firm: float = FIRM) -> DataFrame:
    """host, template, firm: the hashes of each host's template subtrees, and of those of its firm template, for pages (host, text)."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    found = pages.select("host", "text").mapInArrow(trimmed(_hashes), "host string, digest long, parent long").distinct()
    counted = found.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    recurring = scratch.write(counted, "recurring").join(hosts, "host").where(F.col("n") >= share * F.col("pages"))
    lists = [F.array_sort(F.collect_list(x)).alias(name) for name, x in (("template", F.col("digest")), ("firm", F.when(F.col("n") >= firm * F.col("pages"), F.col("digest"))))]
    return scratch.write(recurring.groupBy("host").agg(*lists), "templates")


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html): the main text of each row.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by two line ends. A null or empty page, and one without an
    article, has an empty text. Rows without a host are taken for one site. Repeated rows are rows like others; extra columns are not read; an empty table gives
    no rows. Pages are read whole, one at a time in each task.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("text"))
    known = templates(rows, scratch, least, share)
    size = known.agg(F.sum((F.size("template") + F.size("firm")) * 8 + F.octet_length("host"))).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")
    kind = dict(pages.dtypes)["page_id"]
    texts = joined.mapInArrow(trimmed(_texts), f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
