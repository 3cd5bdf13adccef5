"""HTML extraction by site template removal.

A page is cut into a tree of block elements, and subtrees have digests. Spark counts, for each host, in how many different articles a digest occurs; subtrees that recur
across many of a host's articles are its template and are deleted. Outside an article a subtree is known by its structure (menus, adverts and teasers differ in their
words), inside one by its words too. What a class, id or role calls furniture is deleted where elements of that name recur in a host's articles.

Only elements that the HTML standard itself takes out of the text (scripts, form fields, navigation, asides, footers, hidden ones) go without counts. A host with too few articles to count
is counted with the others of its domain that have too few, or with all such hosts of the table; what names call furniture goes on these pages too, since a name of one
small host can't recur, and where such a page has an article (or main) the text is what is left of that.
"""

from __future__ import annotations

import html as entities
import re
from functools import partial

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, stored, trimmed
from .urlfilter import host as host_of

# Element classes of the HTML standard.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "svg", "object", "canvas", "audio", "video", "select", "datalist"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "button", "dialog", "menu", "textarea", "input", "title"}
#: What belongs to a form's fields, if it stands in a form.
FIELDS = {"label", "legend", "output", "progress", "meter"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption", "summary", "tr", "table", "ul", "ol", "dl", "figure", "tbody", "thead", "tfoot"}
BLOCKS = TEXT_BLOCKS | {"html", "body", "div", "article", "main", "section", "header", "footer", "nav", "aside", "form", "hr", "address", "details", "fieldset", "center", "dialog", "menu", "hgroup", "search", "title", "head"}
#: Blocks of text that recur as a whole where they are a notice; headings, entries and cells recur in different articles.
PASSAGES = {"p", "ul", "ol", "dl", "table", "figure", "blockquote", "pre"}
CLOSES_P = BLOCKS - {"html", "body", "title", "head"}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: Elements that their class or role can mark as furniture, and those that an id can mark: a heading, paragraph or section with an anchor is text.
CONTAINERS = (BLOCKS - TEXT_BLOCKS - {"html", "body", "article", "main", "title", "head", "hr"}) | {"ul", "ol", "dl", "table", "figure"}
BY_ID = {"div", "ul", "ol"}
#: What a form holds if it is wrapped round a page and not a form of its own.
HOLDS_PAGE = {"article", "main", "h1"}


def _named(words: str) -> re.Pattern:
    """Names that consist of these words alone, between white space."""
    return re.compile(rf"(?<!\S)(?:(?:{words})(?:[_-](?!\s|$)|(?!\S)))+(?!\S)", re.I)


# Words of class, id and role that name furniture of a page; a name of several words is furniture if all of them are. Inside an article only those that no text is called by.
INSIDE_WORDS = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|cookie-?notice|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|footer|masthead|site-?header|page-?header|topbar|"
    r"comments?|comment-?list|replies|disqus|respond|share|sharing|newsletter|subscribe|signup|login|toolbar|pagination|pager|skip-?link|complementary|contentinfo|paywall"
)
INSIDE_FURNITURE = _named(INSIDE_WORDS)
FURNITURE = _named(INSIDE_WORDS + r"|banner|notices?|alert|side|rail|responses|discussion|social|related|recommend\w*|posts?|search|copyright|legal")

# A name whose last word says reader comments, whatever words stand before it, unless they tell a state of the page.
COMMENTS = re.compile(r"(?<!\S)(?!(?:has|have|with|no|without|show|hide|allow|enable|open|close)[a-z]*[_-])(?:[a-z0-9]+[_-])*(?:comments?|comment-?(?:list|area|section|thread|box|form)|replies|respond|disqus(?:[_-]thread)?)(?!\S)", re.I)

# As the HTML standard reads a tag: attributes one after another, each a name and perhaps a value in quotes or up to white space or ">"; quotes elsewhere are letters like others.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)?+)"
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{re.sub(r'[(](?![?])', '(?:', _VALUE)})?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+", re.S)
#: Attributes that decide; pages without them in a tag skip the reading of its attributes.
_DECIDES = re.compile(r"class|id|role|hidden|style", re.I)
_END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW | {"textarea", "title"}}


class Node:
    """An element: its children are text runs and nodes, in page order."""

    __slots__ = ("tag", "marks", "children", "gone", "inside", "named", "holds")

    def __init__(self, tag: str, marks: str = "", gone: bool = False, inside: bool = False, named: bool = False):
        self.tag, self.marks, self.gone, self.inside, self.named, self.children = tag, marks, gone, inside, named, []
        self.holds = False  # an article or main


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag's source after its name, by lower-case name; of repeated ones the first counts. Character references in values are decoded."""
    if not _DECIDES.search(source):
        return {}
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return found


def parse(page: str) -> list[Node]:
    """All elements of the page in page order, the root first; stray and missing end tags are handled as browsers do for the common cases.

    An element is ``inside`` if it or one above it is an article or main, and ``named`` if its class, id or role calls it furniture. The page's header is gone; one inside
    holds the article's own heading and stays. A form is gone unless it is wrapped round an article, main or first-level heading; then its fields alone are.
    """
    root = Node("#root")
    nodes, forms, wrapping = [root], [], set()
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS - {"p"}:
                    break  # the end tag of an inline element doesn't close blocks
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in CLOSES_SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("dt", "dd") and stack[i].tag in ("dt", "dd")) or (tag in ("td", "th") and stack[i].tag in ("td", "th")):
                    del stack[i:]
                    break
                if stack[i].tag in CLOSES_SAME[tag]:
                    break
        if tag == "body":  # a body without the end of its head
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "head":
                    del stack[i:]
                    break
        marks, gone, named = "", tag in DROPPED or tag in FIELDS and any(above.tag == "form" for above in stack), False
        inside = stack[-1].inside or tag in ("article", "main")
        if m.group(3):
            found = attributes(m.group(3))
            if found:
                marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
                hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
                names = " ".join(found.get(k, "") for k in (("class", "role", "id") if tag in BY_ID else ("class", "role")))
                gone = gone or bool(hidden)
                named = tag in CONTAINERS and ((INSIDE_FURNITURE if inside else FURNITURE).search(names) is not None or any(COMMENTS.search(found.get(k, "")) for k in ("class", "id")))
        node = Node(tag, marks, gone or (tag == "header" and not inside), inside, named)
        if tag == "form":
            forms.append(node)
        nodes.append(node)
        stack[-1].children.append(node)
        if tag in ("article", "main"):
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if tag in HOLDS_PAGE and not gone:
            wrapping.update(id(above) for above in stack if above.tag == "form")
        if tag in VOID:
            continue
        if tag in _END_OF:
            end = _END_OF[tag].search(page, at)
            if tag == "textarea" or tag == "title":
                node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        stack.append(node)
    for form in forms:
        form.gone = form.gone or id(form) not in wrapping
    return nodes


def candidates(nodes: list[Node]) -> list[tuple[int, bool, Node]]:
    """Subtrees that a template can consist of: (digest, loose, node). Blocks outside article and main, and inside them containers and whole passages but never headings, entries or cells.

    A digest covers tag, class and the digests of the children. Where a page has an article, what lies outside is known by its structure alone, with like neighbours
    taken as one; inside it, and on pages without one, by its texts as well. Named furniture has a second digest, of its name. Structure and names are ``loose``: elements share them that
    don't share a word. Children come first, so a page costs its size.
    """
    whole = not any(n.inside for n in nodes)
    digests: dict[int, int] = {}
    out = []
    for node in reversed(nodes):
        with_text = whole or node.inside
        parts: list[str] = []
        for c in node.children:
            part = " ".join(c.split()) if isinstance(c, str) and with_text else "" if isinstance(c, str) else str(digests[id(c)])
            if part and (with_text or not parts or parts[-1] != part):
                parts.append(part)
        digests[id(node)] = digest = xxhash.xxh3_64_intdigest("\0".join([node.tag, node.marks, *parts])) - (1 << 63)
        if node.gone or node.holds:
            continue
        if node.named:
            out.append((xxhash.xxh3_64_intdigest("\0".join(["named", node.tag, node.marks])) - (1 << 63), True, node))
        if node.tag in BLOCKS and node.tag not in ("html", "body", "head", "title", "article", "main") and not (node.inside and node.tag in TEXT_BLOCKS - PASSAGES):
            out.append((digest, not with_text, node))
    return out


def _children(node: Node) -> list[Node]:
    return [c for c in reversed(node.children) if isinstance(c, Node) and not c.gone]


def articles_of(root: Node) -> list[Node]:
    """All articles of a page but those inside one another, or its first main, or the page."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "article":
            found.append(node)
        else:
            stack.extend(_children(node))
    stack = [] if found else [root]
    while stack:
        node = stack.pop()
        if node.tag == "main":
            return [node]
        stack.extend(_children(node))
    return found or [root]


def main_text(*starts: Node) -> str:
    """Blocks that are left in these subtrees, in page order, one a line."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    for start in starts:
        work: list = [start]
        while work:
            x = work.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(x)
            elif x.gone:
                if x.tag in BLOCKS:
                    close()
            elif x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCKS:
                close()
                work.append(None)
                work.extend(reversed(x.children))
            else:
                work.extend(reversed(x.children))
        close()
    return "\n".join(blocks)


def text_left(nodes: list[Node], template: set[int], by_name: bool) -> str:
    """Main text of a page without its template. Outside the articles of a page that has any, named furniture goes with it, and where names decide it goes everywhere and the text is that of the articles."""
    for d, _, node in candidates(nodes) if template else ():
        node.gone = node.gone or d in template
    outside = any(node.holds for node in nodes)
    for node in nodes:
        node.gone = node.gone or (node.named and not node.holds and (by_name or (outside and not node.inside)))
    return main_text(*articles_of(nodes[0]) if by_name else nodes[:1])


def lone_text(nodes: list[Node]) -> str:
    """Main text of a page that nothing can be counted for: names decide, and an article (or main) is all of the text."""
    return text_left(nodes, set(), True)


def _article(nodes: list[Node], page: str) -> int:
    """Digest of what tells one article of a host from another: the first headings inside article and main, or else the text there; on a page without
    them its title and first headings. A heading of the page's header or of other furniture (a logo) doesn't count."""
    shown, stack = [], [nodes[0]]
    while stack:
        node = stack.pop()
        shown.append(node)
        stack.extend(_children(node))
    inside = any(n.inside for n in shown)
    parts = [main_text(n) for n in shown if n.tag == "h1" and (n.inside or not inside)]
    if not inside:
        parts += [" ".join("".join(c for c in n.children if isinstance(c, str)).split()) for n in nodes if n.tag == "title"][:1]
    if not any(parts):
        parts = [main_text(*articles_of(nodes[0])) or page]
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


@trimmed
def _subtrees(batches):
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"], batch["html"]):
            nodes = parse(page)
            heading = _article(nodes, page)
            rows.extend((host, d, loose, heading) for d, loose in {(d, loose) for d, loose, _ in candidates(nodes)})
            rows.append((host, None, False, heading))
        yield pd.DataFrame({"host": [r[0] for r in rows], "digest": pd.array([r[1] for r in rows], "Int64"), "loose": [r[2] for r in rows], "heading": [r[3] for r in rows]})


@trimmed
def _extracted(batches, others: list[str]):
    for batch in batches:
        texts = []
        for page, template, by_name in zip(batch["html"], batch["template"], batch["by_name"]):
            texts.append(text_left(parse(page), set(map(int, template)), bool(by_name)))
        yield batch[others].assign(text=texts, n_chars=[len(t) for t in texts])


def domain_of(host: F.Column) -> F.Column:
    """The last two labels of a host, or all of it: an approximation of the domain that is registered, wider under suffixes like ``co.uk``."""
    return F.substring_index(host, ".", -2)


def _counted(seen: DataFrame, site: str, least_articles: int) -> DataFrame:
    """site, digest, loose, articles: in how many articles of a site a digest occurs, or how many there are (digest null); what is too rare for a template is left out."""
    return seen.groupBy(site, "digest", "loose").agg(F.count("*").alias("articles")).where((F.col("articles") >= least_articles) | F.col("digest").isNull())


def _listed(counts: DataFrame, site: str, share: float, loose_share: float, least_articles: int) -> DataFrame:
    """(site, template) for every site of at least that many articles."""
    totals = counts.where("digest is null").where(F.col("articles") >= least_articles).select(site, F.col("articles").alias("total"))
    common = counts.where("digest is not null").join(totals, site).where(F.col("articles") >= F.when(F.col("loose"), loose_share).otherwise(share) * F.col("total"))
    listed = common.groupBy(site).agg(F.array_sort(F.collect_set("digest")).alias("template"))
    return totals.select(site).join(listed, site, "left").select(site, F.coalesce("template", F.array().cast("array<long>")).alias("template"))


def site_templates(pages: DataFrame, share: float = 0.5, loose_share: float = 0.02, least_articles: int = 5) -> DataFrame:
    """(host, template, by_name), a row for each host: digests of the subtrees that occur in ``share`` of a site's different articles (``loose_share`` for those by structure or name), and in ``least_articles`` at least.

    ``pages`` has host and html. Counts are of distinct articles by their headings, so copies of one article are one article. A host of fewer than ``least_articles`` articles is counted as a
    part of its domain, with the other such hosts there; if they have too few articles together, as a part of the whole table, with all hosts of such domains. Its ``by_name`` is true.
    A digest needs that share of the articles, so a site has no more of them than an article has subtrees, divided by the share.
    """
    seen = stored(pages.select("host", "html").mapInPandas(_subtrees, "host string, digest long, loose boolean, heading long").distinct())
    counts = cut(_counted(seen, "host", least_articles))
    own = _listed(counts, "host", share, loose_share, least_articles).withColumn("by_name", F.lit(False))
    small = counts.where("digest is null").where(F.col("articles") < least_articles).select("host", domain_of(F.col("host")).alias("domain"))
    apart = seen.join(small, "host").select("domain", "digest", "loose", "heading").distinct()
    wider = cut(_counted(apart, "domain", least_articles))
    of_domain = _listed(wider, "domain", share, loose_share, least_articles)
    rest = wider.where("digest is null").where(F.col("articles") < least_articles).select("domain")
    everywhere = apart.join(rest, "domain").select("digest", "loose", "heading").distinct().withColumn("site", F.lit("*"))
    of_all = _listed(_counted(everywhere, "site", least_articles), "site", share, loose_share, least_articles).select(F.col("template").alias("last"))
    # the last table is one row or none
    given = small.join(of_domain, "domain", "left").join(F.broadcast(of_all), F.col("template").isNull(), "left")
    return own.unionByName(given.select("host", F.coalesce("template", "last", F.array().cast("array<long>")).alias("template"), F.lit(True).alias("by_name")))


def extract_main_text(pages: DataFrame, share: float = 0.5, loose_share: float = 0.02, least_articles: int = 5) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html): page_id, url, text (blocks joined by newlines, empty if none), n_chars (its code points).

    Null html counts as empty and gives an empty text; a null url has the empty host. Repeated rows are kept and get equal texts. Extra columns are ignored; an empty table gives no rows. Whole
    pages are read and no page is dropped. Templates (a row for each host) are broadcast up to a measured size and joined by shuffle beyond it.
    """
    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    templates = cut(site_templates(rows, share, loose_share, least_articles))
    size = templates.agg(F.sum(F.size("template") * 8 + F.octet_length("host") + 32)).first()[0] or 0
    joined = rows.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left")
    joined = joined.select("page_id", "url", "html", F.coalesce("template", F.array().cast("array<long>")).alias("template"), F.coalesce("by_name", F.lit(True)).alias("by_name"))
    return joined.mapInPandas(partial(_extracted, others=["page_id", "url"]), f"page_id {kinds['page_id']}, url string, text string, n_chars long")
