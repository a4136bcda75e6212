"""Main text of web pages: site template removal, then structural rules.

Every element subtree of a page is hashed (tag, attributes that name its part of the page, and all it holds). Spark
counts, for each host, on how many different pages a subtree occurs; those on many of a host's pages are template and
go, with all they hold, inside the main element as well. The article itself is no template: main elements are not
counted, what they hold counts once for all pages of the same headline (of an equal main element, if pages have none), and only together with its place there (the
elements around it, and whether it is among the first or last of their children), what repeats the page's title or first
heading is article on that page, plain paragraphs are never template, and an article of which hardly anything would remain
stays whole. Rules remove the parts that need no second page to be known: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments of readers, by tag, role and the words of class and id.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.session import broadcast_small, cut, delete_path, shared_dir, text_batches

#: Elements without content, ones whose content is no markup, and ones that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead title tr ul xmp".split()
)
#: Elements that never belong to the main text.
DROPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea input iframe object embed svg canvas dialog menu noframes noembed audio video title meta link base map label fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of class and id that name such parts.
PART = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|adslot|adbox|banner|sponsor|sponsored|promo|promotion|popup|popover|modal|overlay|cookie|cookies|consent|gdpr|notice|notices|alert|nav|navbar|navigation|navi|menu|menubar|topmenu|submenu|breadcrumb|breadcrumbs|crumbs|sidebar|sidenav|aside|rail|widget|widgets|related|recommended|recommendations|trending|popular|footer|foot|masthead|topbar|header|comment|comments|commentlist|reply|replies|respond|disqus|discussion|share|sharing|social|follow|subscribe|subscription|newsletter|signup|login|register|search|searchbox|form|pagination|pager|toolbar|skip|copyright|legal|disclaimer|tags|taglist|toc|paywall)(?:$|[^a-z])"
)
MAIN_PART = re.compile(r"(?:^|[^a-z])(?:article|articlebody|main|content|maincontent|post|postbody|entry|story|body|text)(?:$|[^a-z])")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that a start of one of these closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
CLOSES_P = BLOCK - {"br", "button", "caption", "option", "optgroup", "legend", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "select", "title"}
SCOPE = frozenset("table td th ul ol dl article section div main body html nav aside header footer blockquote form button".split())
SPACE = re.compile(r"\s+")

#: A subtree is template if it occurs on MIN_PAGES pages of a host at least, and on the square root of their number if it
#: is a part of a page (one of WHOLE) with MIN_INNER_CHARS characters; others, as words within a line, on SHARE of them.
MIN_PAGES, SHARE = 5, 0.5
WHOLE = frozenset("address aside blockquote center details dialog dir div dl fieldset figure footer form header hgroup menu nav ol p pre section table ul".split())
#: Template subtrees hold so many characters at least: single words recur by chance.
MIN_CHARS = 3


#: Inside a main element only these, and elements with a class or id, are parts that may be template: sentences that articles have in
#: common stand in plain paragraphs, list items and cells, and stay.
BOXES = frozenset("address aside center details div dl fieldset figure footer form header hgroup menu nav section".split())
#: Inside a main element templates hold so many; of a main element's text so large a part remains, or all of it stays.
MIN_INNER_CHARS, MIN_REMAINS = 8, 0.1


#: Template subtrees of all hosts (8 bytes each) up to which their lists are broadcast; beyond, each CHUNK_PAGES pages of a host
#: are dealt out together with its list.
MAX_LISTED, CHUNK_PAGES = 500_000, 1000


class Node:
    __slots__ = ("tag", "names", "role", "kids", "hash", "chars", "key")

    def __init__(self, tag: str, names: str = "", role: str = ""):
        self.tag, self.names, self.role = tag, names, role
        self.kids: list = []
        self.hash = self.key = 0
        self.chars = 0


def parse(page: str) -> Node:
    """A forgiving tree: unclosed elements end with their parent, stray ends are ignored, nothing raises."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in CLOSES or tag in CLOSES_P:
            ends = CLOSES.get(tag, ()) or ()
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in SCOPE | {"tr", "tbody"} - set(ends):
                if stack[i].tag in ends or (stack[i].tag == "p" and tag in CLOSES_P):
                    del stack[i:]
                    break
                i -= 1
            else:
                if i > 0 and stack[i].tag in ends:
                    del stack[i:]
        names = role = ""
        hidden = False
        if m[3]:
            for k, a, b, c in ATTR.findall(m[3]):
                k = k.lower()
                if k in ("class", "id"):
                    names += " " + html.unescape(a or b or c).lower()
                elif k == "role":
                    role = (a or b or c).lower()
                elif k == "hidden" or (k == "aria-hidden" and (a or b or c) == "true") or (k == "style" and "display:none" in (a or b or c).replace(" ", "").lower()):
                    hidden = True
        node = Node("template" if hidden else tag, names.strip(), role)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
            node.kids.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else n
        elif tag not in VOID:
            stack.append(node)
    return root


def digest(root: Node) -> None:
    """Hashes and character counts of every subtree, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    for node in reversed(order):
        parts, chars = [node.tag, node.names, node.role], 0
        for k in node.kids:
            if isinstance(k, Node):
                parts.append(f"<{k.hash:x}>")
                chars += k.chars
            else:
                text = SPACE.sub(" ", k).strip()
                parts.append(text)
                chars += len(text)
        node.hash, node.chars = xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")), chars
        node.key = node.hash


def place(main: Node) -> None:
    """What elements inside a main element are known by: their hash and their place, which is that of their parent, its tag and
    names, and whether they are first, second, last, last but one or in between."""
    todo = [(main, 0)]
    while todo:
        node, above = todo.pop()
        kids = [k for k in node.kids if isinstance(k, Node)]
        for i, k in enumerate(kids):
            at = i if i < 2 else max(i - len(kids), -3)
            own = xxhash.xxh3_64_intdigest(f"{above:x}/{node.tag}/{node.names}/{at}".encode("utf-8", "surrogatepass"))
            k.key = xxhash.xxh3_64_intdigest(f"{k.hash:x}@{own:x}")
            todo.append((k, own))


def text_of(node: Node) -> str:
    """All text below node, runs of white space as one space."""
    parts, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
        else:
            todo += reversed(item.kids)
    return SPACE.sub(" ", " ".join(parts)).strip()


def headline(root: Node) -> frozenset[str]:
    """The page's title, the parts of it around bars and dashes, and its first heading, in small letters without an end mark."""
    found, todo = {}, [root]
    while todo:
        node = todo.pop()
        if node.tag in ("title", "h1") and node.tag not in found:
            found[node.tag] = text_of(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    parts = [*found.values(), *re.split(r"\s+[-|\u2013\u2014\u00b7:]\s+", found.get("title", ""))]
    return frozenset(_bare(x) for x in parts if _bare(x))


def _bare(text: str) -> str:
    return text.casefold().rstrip(".!?:\u2026 ")


def is_part(node: Node) -> bool:
    """Whether the element is some part of the page other than its main text, by tag, role or name."""
    if node.tag in ("article", "main", "body", "html") or node.role == "main":
        return False
    if node.tag in DROPPED or node.role in ROLES:
        return True
    return bool(node.names) and PART.search(node.names) is not None and not (node.tag not in ("ul", "ol", "p", "span") and _mostly_main(node))


def _mostly_main(node: Node) -> bool:
    """A wrapper named after some part that holds the article itself."""
    return any(isinstance(k, Node) and (k.tag in ("article", "main") or k.role == "main") for k in node.kids)


def _is_heading(node: Node) -> bool:
    """The head of an article, as opposed to a site's."""
    return (node.tag == "header" or "header" in node.names) and node.tag not in DROPPED - {"header"} and not PART.search(re.sub(r"[a-z]*header", " ", node.names))


def main_nodes(root: Node) -> list[Node]:
    """The outermost article or main elements outside other parts of the page; the largest <main>, if there is one."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root and (node.tag in ("article", "main") or node.role == "main"):
            if node.tag == "article" and PART.search(node.names or "") and not MAIN_PART.search(node.names):
                continue
            found.append(node)
            continue
        if node is not root and is_part(node):
            continue
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return [n for n in found if n.chars]


def blocks(node: Node, template: frozenset | set = frozenset(), inside: bool = False, said: frozenset[str] = frozenset()) -> list[str]:
    """Texts of the blocks under node in page order: white space within a block is one space, empty blocks go. What repeats the
    page's headline (said) is no template."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list = [(node, False)]
    while todo:
        item, done = todo.pop()
        if isinstance(item, str):
            run.append(item)
            continue
        if done:
            flush()
            continue
        if item is not node and (is_part(item) and not (inside and _is_heading(item)) or item.key in template and not (said and _bare(text_of(item)) in said)):
            if item.tag in BLOCK or item.tag == "template":
                flush()
            continue
        if item.tag in BLOCK:
            flush()
            todo.append((item, True))
        todo += [(k, False) for k in reversed(item.kids)]
    flush()
    return out


def main_blocks(node: Node, template: frozenset | set, said: frozenset[str] = frozenset()) -> list[str]:
    """Blocks of a main element without template, or all if that is nearly all: copies of an article that differ little."""
    all_of_it = blocks(node, inside=True)
    left = blocks(node, template, inside=True, said=said) if template else all_of_it
    return left if sum(map(len, left)) >= MIN_REMAINS * sum(map(len, all_of_it)) else all_of_it


def main_text(root: Node, template: frozenset | set = frozenset()) -> str:
    mains = main_nodes(root)
    said = headline(root) if template else frozenset()
    if mains:
        if template:
            for m in mains:
                place(m)
        return " ".join(x for m in mains for x in main_blocks(m, template, said))
    return " ".join(blocks(root, template, said=said))


def subtrees(root: Node) -> set[tuple[int, int, bool]]:
    """Hashes of the subtrees that hold text, each with that of what it is found in (the page or, inside a main
    element, the page's headline, else the element) and whether it is a whole part of the page. Main elements are left out, and what rules remove inside them anyway."""
    mains = main_nodes(root)
    for m in mains:
        place(m)
    said = headline(root)
    titled = xxhash.xxh3_64_intdigest("\x1f".join(sorted(said)).encode("utf-8", "surrogatepass")) if said else None
    longest = max(map(len, said), default=0) + 4  # with end marks
    found: set[tuple[int, int, bool]] = set()
    keep = {id(n) for n in mains}
    todo: list = [(k, root.hash, MIN_CHARS, False) for k in root.kids]
    while todo:
        node, within, least, inside = todo.pop()
        if not isinstance(node, Node):
            continue
        if id(node) in keep:
            todo += [(k, node.hash if titled is None else titled, MIN_INNER_CHARS, True) for k in node.kids]
            continue
        if inside and is_part(node) and not _is_heading(node):
            continue
        if node.chars >= least and node.tag not in ("html", "body") and (not inside or node.tag in BOXES or node.names) and not (node.chars <= longest and _bare(text_of(node)) in said):
            found.add((node.key, within, node.tag in WHOLE and node.chars >= MIN_INNER_CHARS))
        todo += [(k, within, least, inside) for k in node.kids]
    return found


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, most_listed: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars.

    Null html counts as empty: no text. Pages of any length are read whole. Pages without a host (null or odd urls) share one
    host of no name. Pages that repeat an id are pages of their own; pages with equal html count once for the templates.
    Ties: a subtree on exactly the least number of pages is template. Other columns are not read, whatever their names. No
    rows give no rows.
    """
    spark = pages.sparkSession
    most_listed = MAX_LISTED if most_listed is None else most_listed
    text_batches(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, places, wholes = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = parse(page.as_py() or "")
                digest(root)
                hs = [*subtrees(root), (None, root.hash, True)]
                found += [h if h is None or h < 2**63 else h - 2**64 for h, _, _ in hs]
                places += [w if w < 2**63 else w - 2**64 for _, w, _ in hs]
                wholes += [x for _, _, x in hs]
                hosts += [host] * len(hs)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(places, pa.int64()), pa.array(wholes, pa.bool_())], names=["host", "h", "place", "whole"])

    # A row for each subtree of a page and one (null) for the page itself; equal pages or main elements count once.
    places = rows.select("host", "html").mapInArrow(hashes, "host string, h long, place long, whole boolean").distinct()
    counts = places.groupBy("host", "h", "whole").count().where((F.col("count") >= min_pages) | F.col("h").isNull())
    path = f"{shared_dir(spark)}/subtrees-{uuid.uuid4().hex}"
    counts.write.parquet(path)
    counts = spark.read.parquet(path)
    totals = counts.where("h IS NULL").select("host", F.col("count").alias("pages"))
    template = counts.where("h IS NOT NULL").join(totals, "host").where(F.col("count") >= F.when(F.col("whole"), F.least(F.sqrt("pages"), share * F.col("pages"))).otherwise(share * F.col("pages")))
    # At most the square root of its pages' number can pass at a page position, so a host's list grows slowly with them.
    lists = cut(template.groupBy("host").agg(F.collect_list("h").alias("template")))
    listed = lists.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    id_type = pages.schema[id_col].dataType.simpleString()
    schema = f"page_id {id_type}, url string, text string, n_chars long"
    if listed <= most_listed:  # sent to each worker once
        delete_path(spark, path)
        known = spark.sparkContext.broadcast({r["host"]: frozenset(h % 2**64 for h in r["template"]) for r in lists.collect()})

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [_extracted(page.as_py(), known.value.get(host, frozenset())) for page, host in zip(batch.column(2), batch.column(3).to_pylist())]
                yield _answer(batch, texts)

        return rows.select("page_id", "url", "html", "host").mapInArrow(extract, schema)

    # A host's pages in chunks; each chunk has the host's list once, before its pages.
    chunks = F.ceil(F.col("pages") / CHUNK_PAGES).cast("int")
    spread = totals.select("host", chunks.alias("_chunks"))
    lists = lists.join(spread, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "template")
    dealt = rows.join(broadcast_small(cut(spread)), "host").withColumn("_chunk", F.pmod(F.xxhash64("html", "url"), F.col("_chunks")).cast("int"))
    both = dealt.select("page_id", "url", "html", "host", "_chunk", F.lit(None).cast("array<long>").alias("template"), F.lit(1).alias("_page"))
    both = both.unionByName(lists.select(F.lit(None).cast(id_type).alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "_chunk", "template", F.lit(0).alias("_page")))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, frozenset())
        for batch in batches:
            keep, texts = [], []
            for i, (host, chunk, is_page) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 6)))):
                if not is_page:
                    held = ((host, chunk), frozenset(h % 2**64 for h in batch.column(5)[i].as_py()))
                    continue
                keep.append(i)
                texts.append(_extracted(batch.column(2)[i].as_py(), held[1] if held[0] == (host, chunk) else frozenset()))
            yield _answer(batch.take(pa.array(keep, pa.int64())), texts)

    return both.repartition("host", "_chunk").sortWithinPartitions("host", "_chunk", "_page").mapInArrow(follow, schema)


def _extracted(page: str | None, template: frozenset) -> str:
    root = parse(page or "")
    digest(root)
    return main_text(root, template)


def _answer(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
