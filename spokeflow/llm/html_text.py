"""Main text of web pages by tree scoring.

A page is parsed into a tree of elements (implied end tags, void elements and raw text as HTML has them). What
is never article text is pruned: scripts, styles, menus, forms, asides, footers, page headers, hidden elements
and those whose role says so, or one of whose classes, or whose id, says as a whole nothing but advert, notice, comments,
side bar and the like (`STRONG` words alone, others with a word of `PARTS`). A name with other words in it (`related-work`),
or one word that may as well be a heading (`related`, `tags`, the id `discussion`), prunes only what is made of links; else it
lowers the score. Such a block goes by its structure too: made of alike entries with an author or a date each it is readers' comments,
and where one word of its name is decisive (`promo-card`, `user-comments`) it goes if it is the smaller part of its article and its id is not
made of its heading's words. A form that holds an article, a main or a first heading wraps the page and is no form.

Each paragraph then passes points, one plus its commas plus one for each hundred characters up to three, to its parent in
full, to its grandparent by half and to further ancestors by a third of what the one below got. An ancestor's points are
discounted by its link density; names and tags that suggest an article weigh in. The best container is kept, with siblings
that score a fifth of it or read like paragraphs, the ones of the same form between and right behind them, and headings beside an article that has no first heading itself. Nothing is
cut from what is kept; only where the page itself is the best container are its boxes made of links left out.

White space is what Unicode calls so, no-break spaces included.

Defined cases: null and empty pages have an empty text; a page without a scored paragraph gives the blocks of
its `article`, `main` or body; of containers that score alike the first in the page is the best; a page cut off in the middle
is closed where it ends and an unfinished tag is dropped; pages of any length and depth are read whole, in time linear in
them; repeated rows are extracted each; an empty table gives no rows. Only the three named columns are read, so others may
have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.llm.bpe import small_batches
from spokeflow.plans.lineage import bounded_batches

# Element sets of the HTML standard and words that name parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption dd dt li tbody td tfoot th thead tr body html".split())
PRUNED = frozenset(
    "script style title noscript template nav footer aside form button select option textarea input label fieldset iframe"
    " object embed svg canvas audio video dialog menu head noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner cookie"
    " cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist disqus respond reply replies discussion sidebar rail aside widget widgets related recommended"
    " recommendations trending popular share sharing social breadcrumb breadcrumbs pagination pager menu nav navbar navigation"
    " footer masthead header topbar toolbar skip outbrain taboola tags taglist hidden alert disclaimer".split()
)
#: Words that go with those in names of parts.
PARTS = frozenset(
    "area areas bar bars block blocks box boxes btn btns button buttons container count counter feed form frame group icon icons inner item items"
    " link links list lists module outer panel post posts row section slot slots stories story text toggle top bottom left right unit units wrap wrapper"
    " site page main global article articles content".split()
)
#: Words that say so alone, as a class and as an id; other UNLIKELY words alone may as well be the article's own.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos cookie cookies consent gdpr"
    " notice notices newsletter subscribe subscription signup login paywall popup modal comment comments commentlist disqus sidebar"
    " breadcrumb breadcrumbs pagination pager nav navbar navigation menu footer masthead topbar toolbar outbrain taboola taglist".split()
)
#: As an id, a word alone is more often a heading's.
PLAIN = frozenset("comments commentlist disqus sidebar widgets navbar nav breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer taglist adsense adslot outbrain taboola ads gdpr paywall popup".split())
AMBIGUOUS = frozenset("header discussion notice notices alert disclaimer popular overlay aside rail skip response reply respond".split())
#: Words that tell adverts and readers' comments in any name, if the block's form doesn't speak against it; an `ad` with sizes beside it too.
DECISIVE = frozenset("ads adsense adslot advert adverts advertisement sponsored promo promos newsletter comments commentlist disqus outbrain taboola".split())
BESIDE_AD = frozenset("x px google gpt dfp mpu banner".split())
#: Words of what stands with each comment.
BYLINE = frozenset("author avatar byline commenter date name posted reply time timestamp user username".split())
LIKELY = frozenset("article body content entry main post story text page blog".split())
KEEP_NAMED = frozenset("article main body html h1 h2 h3 h4 h5 h6".split())
SCOPES = {"li": ("li", {"ul", "ol", "menu"}), "dd": ("dd dt", {"dl"}), "dt": ("dd dt", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?P<close>>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []


def parse(html: str) -> Node:
    """The tree of a page; text is decoded."""
    root = Node("html", {}, None)
    stack, places = [root], {"html": [0]}  # open elements, and where those of a tag stand
    at = 0

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def shut(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    def close(tags, stop) -> None:
        """Close the nearest of `tags`, unless one of `stop` is nearer."""
        found = nearest(tags)
        if found > max(0, nearest(stop)):
            shut(found)

    size = len(html)
    while m := _TOKEN.search(html, at):
        if at < m.start():
            stack[-1].kids.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            stack[-1].kids.append(m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br", {}, stack[-1]))
            elif tag not in ("html", "body"):
                close((tag,), {"td", "th", "table"} - {tag} if tag not in ("tr", "tbody", "thead", "tfoot") else {"table"})
        elif m["tag"]:
            if not m["close"]:
                break
            tag = m["tag"].lower()
            attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
            if tag in ("html", "body"):
                if tag == "body" and stack[-1].tag == "head":
                    shut(len(stack) - 1)
                continue
            if tag in CLOSES_P:
                close(("p",), ("td", "th", "li", "div", "section", "article", "blockquote", "button"))
            if tag in SCOPES:
                own, stop = SCOPES[tag]
                close(own.split(), stop)
                if tag == "tr":
                    close(("tr",), ("table",))
            if tag in BLOCK and stack[-1].tag == "head":
                shut(len(stack) - 1)
            new = Node(tag, attrs, stack[-1])
            stack[-1].kids.append(new)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
            elif tag not in VOID:
                places.setdefault(tag, []).append(len(stack))
                stack.append(new)
        if at >= size:
            break
    else:
        if at < size:
            stack[-1].kids.append(unescape(html[at:]))
    return root


def _unwanted(n: Node, in_article: bool, wrapping: set[int]) -> bool:
    if n.tag in PRUNED:
        return not (n.tag == "form" and id(n) in wrapping)
    a = n.attrs
    if n.tag == "header" and not in_article:
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDE.search(a.get("style", "").lower()):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if n.tag in KEEP_NAMED:
        return False
    classes = [set(_NAME.findall(x)) for x in a.get("class", "").lower().split()]
    single = sum(len(x) == 1 and x <= UNLIKELY for x in classes)
    return single > 1 or any(_says_part(x, False) for x in classes) or _says_part(set(_NAME.findall(a.get("id", "").lower())), True)


def _says_part(words: set[str], is_id: bool) -> bool:
    """Whether a whole name says that the element is no article text."""
    told = words & UNLIKELY
    if not told or words - UNLIKELY - PARTS:
        return False
    if len(words) > 1:
        return not told <= AMBIGUOUS and not words & {"article", "content", "main", "text"} or bool(told & {"ad", "ads", "comment", "comments", "sidebar", "related"})
    return told <= PLAIN if is_id else told <= STRONG


def _names(n: Node) -> set[str]:
    return set(_NAME.findall(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower())) if n.attrs else set()


def _doubtful(n: Node) -> bool:
    return n.tag not in KEEP_NAMED and bool(_names(n) & UNLIKELY)


def _wrapping(root: Node) -> set[int]:
    """Forms that hold an article, a main or a first heading."""
    out: set[int] = set()
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        n, form = stack.pop()
        if form is not None and n.tag in ("article", "main", "h1"):
            out.add(id(form))
        if n.tag == "form" and form is None:
            form = n
        stack += [(k, form) for k in n.kids if not isinstance(k, str)]
    return out


def prune(root: Node) -> None:
    stack, doubtful, wrapping = [(root, False)], [], _wrapping(root)
    while stack:
        n, inside = stack.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not _unwanted(k, inside or n.tag == "article", wrapping)]
        more = [k for k in n.kids if not isinstance(k, str)]
        doubtful += [k for k in more if _doubtful(k)]
        stack += [(k, inside or n.tag == "article") for k in more]
    if not doubtful:
        return
    size = _measures(root)
    gone, parents = set(), {}
    for n in doubtful:
        chars, links, count = size[id(n)]
        around = n.up
        while around.up is not None and around.tag not in ("article", "main"):
            around = around.up
        most = 0.5 if around.up is None else 0.8  # inside an article a list may hold links and words
        linked = count >= 2 and links > most * chars or count and links == chars
        foreign = _decisive(n) and chars <= MINOR * size[id(around)][0] and not _slug(n)
        if linked or foreign or _thread(n):
            gone.add(id(n))
            parents[id(n.up)] = n.up
    for n in parents.values():
        n.kids = [k for k in n.kids if id(k) not in gone]


MINOR = 0.4  # share of its article that an advert or the comments may take to be seen by their name


def _decisive(n: Node) -> bool:
    for name in (*n.attrs.get("class", "").lower().split(), n.attrs.get("id", "").lower()):
        words = set(_NAME.findall(name))
        if words & DECISIVE or "ad" in words and words - {"ad"} and words <= {"ad"} | BESIDE_AD | PARTS | UNLIKELY:
            return True
    return False


def _slug(n: Node) -> bool:
    """Whether the id is made of the words of the block's first heading, as generated anchors are."""
    own = set(_NAME.findall(n.attrs.get("id", "").lower()))
    first = next((k for k in _every(n) if k.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), None)
    return bool(own) and first is not None and not n.attrs.get("class") and own <= set(_NAME.findall(" ".join(k if isinstance(k, str) else _inline(k) for k in first.kids).lower()))


def _thread(n: Node) -> bool:
    """Whether a block is made of two or more alike entries with an author or a date each, as comments are."""
    rows = n
    while len(only := [k for k in rows.kids if not isinstance(k, str) and k.tag in BLOCK and k.tag not in KEEP_NAMED]) == 1:
        rows = only[0]
    alike: dict[tuple[str, str], int] = {}
    for k in only:
        if any(x.tag in ("time", "cite") or x is not k and _names(x) & BYLINE for x in _every(k)):
            at = (k.tag, k.attrs.get("class", ""))
            alike[at] = alike.get(at, 0) + 1
    return max(alike.values(), default=0) >= 2


def _measures(root: Node) -> dict[int, tuple[int, int, int]]:
    """For every node: characters of text, of them in links, and links."""
    out: dict[int, tuple[int, int, int]] = {}
    stack = [(root, False)]
    while stack:
        n, done = stack.pop()
        if not done:
            stack.append((n, True))
            stack += [(k, False) for k in n.kids if not isinstance(k, str)]
            continue
        chars = links = count = 0
        for k in n.kids:
            if isinstance(k, str):
                chars += len("".join(k.split()))
            else:
                c, a, l = out[id(k)]
                chars, links, count = chars + c, links + a, count + l
        if n.tag == "a" and "href" in n.attrs:
            links, count = chars, count + 1
        out[id(n)] = chars, links, count
    return out


def _paragraphs(root: Node) -> Iterator[tuple[Node, str]]:
    """Elements that hold text of their own, beside inline elements."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag in BLOCK:
            own = [k if isinstance(k, str) else _inline(k) for k in n.kids if isinstance(k, str) or k.tag not in BLOCK]
            said = " ".join("".join(own).split())
            if said:
                yield n, said
        stack += [k for k in n.kids if not isinstance(k, str)]


def _inline(n: Node) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif x.tag not in BLOCK:
            stack += reversed(x.kids)
    return "".join(out)


def _bonus(n: Node) -> float:
    names = _names(n)
    tags = {"article": 30.0, "main": 20.0, "section": 3.0, "div": 3.0, "td": 1.0, "li": -3.0, "ul": -3.0, "ol": -3.0, "blockquote": 1.0, "h1": -5.0}
    return tags.get(n.tag, 0.0) + (10.0 if names & LIKELY else 0.0) - (15.0 if _doubtful(n) else 0.0) + (10.0 if n.attrs.get("role") == "main" or n.attrs.get("itemprop") == "articleBody" else 0.0)


def _scores(root: Node, density) -> dict[int, tuple[Node, float]]:
    """Nodes that paragraphs pass points to, in page order, with their points before the discount."""
    own: dict[int, float] = {}
    for n, said in _paragraphs(root):
        if len(said) < 25 or n.tag in ("html", "figcaption", "caption", "summary"):
            continue
        points = (1 + sum(map(said.count, ",،、，")) + min(len(said) / 100, 3)) * (1 - density(n))
        holder = n if n.tag in ("article", "main", "section", "div", "td") else n.up
        if holder is not None:
            own[id(holder)] = own.get(id(holder), 0.0) + points
    order = list(_every(root))
    half: dict[int, float] = {}
    rest: dict[int, float] = {}
    for n in reversed(order):  # children before their parents
        passed = own.get(id(n), 0.0)
        further = half.get(id(n), 0.0) + rest.get(id(n), 0.0)
        if n.up is not None and (id(n) in own or id(n) in half or id(n) in rest):
            half[id(n.up)] = half.get(id(n.up), 0.0) + passed / 2
            rest[id(n.up)] = rest.get(id(n.up), 0.0) + further / 3
    return {id(n): (n, _bonus(n) + own.get(id(n), 0.0) + half.get(id(n), 0.0) + rest.get(id(n), 0.0)) for n in order if id(n) in own or id(n) in half or id(n) in rest}


def main_nodes(root: Node) -> list[Node]:
    """The best container of a pruned page with the siblings that belong to it, in page order."""
    size = _measures(root)
    density = lambda n: size[id(n)][1] / size[id(n)][0] if size[id(n)][0] else 0.0
    scored = _scores(root, density)
    final = {i: points * (1 - density(n)) for i, (n, points) in scored.items()}
    if not final:
        for tag in ("article", "main"):
            if found := [n for n in _every(root) if n.tag == tag and size[id(n)][0]]:
                return [max(found, key=lambda n: size[id(n)][0])]
        return [root]
    real = [i for i in final if scored[i][0].tag != "html"]
    best = scored[max(real or final, key=lambda i: final[i])][0]
    # an element that the page itself marks as the article takes in its own parts
    up = best
    while up.up is not None:
        up = up.up
        if up.tag in ("article", "main") and final.get(id(up), 0) > 0:
            best = up
            if up.tag == "article":
                break
    if best.up is None:
        return [best]
    top, out = final.get(id(best), 0.0), []
    marked = best.tag == "article"
    headed = marked and any(n.tag == "h1" for n in _every(best))
    for k in best.up.kids:
        if isinstance(k, str):
            continue
        said = size[id(k)][0]
        long_text = k.tag in ("p", "pre", "blockquote") and (said > 80 and density(k) < 0.25 or 0 < said and density(k) == 0 and not marked)
        if marked:  # beside an article stand other articles, its headline, and paragraphs
            belongs = k.tag == "article" and final.get(id(k), 0) >= max(10, 0.5 * top) or long_text
        else:
            belongs = final.get(id(k), 0) >= max(10, 0.2 * top) or long_text
        if k is best or belongs or (k.tag in ("h1", "h2", "h3", "hgroup") and density(k) < 0.5 and not headed):
            out.append(k)
    return _with_like(best, out, size) if not marked else out


def _with_like(best: Node, kept: list[Node], size: dict[int, tuple[int, int, int]]) -> list[Node]:
    """Kept siblings and, where two or more of one form are kept, those of that form that stand between them or right behind the last."""
    form = lambda n: (n.tag, n.attrs.get("class", ""))
    plain = lambda n: size[id(n)][0] > 0 and size[id(n)][1] < 0.25 * size[id(n)][0] and not _doubtful(n)
    if sum(form(k) == form(best) for k in kept) < 2:
        return kept
    held = {id(k) for k in kept}
    every = [k for k in best.up.kids if not isinstance(k, str)]
    like = [i for i, k in enumerate(every) if id(k) in held and form(k) == form(best)]
    for i in range(like[0], len(every)):
        if i > like[-1] and not (form(every[i]) == form(best) and plain(every[i])):
            break
        if form(every[i]) == form(best) and plain(every[i]):
            held.add(id(every[i]))
    return [k for k in every if id(k) in held]


def _every(root: Node) -> Iterator[Node]:
    """All elements in page order."""
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in reversed(n.kids) if not isinstance(k, str)]


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of blocks in page order; of a whole page without its boxes made of links."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        said = " ".join("".join(run).split())
        run.clear()
        if said:
            out.append(said)

    for top in nodes:
        size = _measures(top) if top.up is None else {}
        stack: list[Node | str | None] = [top]
        while stack:
            n = stack.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                run.append(n)
            elif n.tag == "br":
                run.append(" ")
            else:
                if n.tag in BLOCK:
                    chars, links, count = size.get(id(n), (0, 0, 0))
                    if n is not top and n.tag in ("ul", "ol", "div", "section", "table", "dl") and count >= 3 and links > 0.5 * chars:
                        flush()
                        continue
                    flush()
                    stack.append(None)
                stack += reversed(n.kids)
        flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return "\n\n".join(blocks(main_nodes(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 2, 8 << 20):
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["_id", "_url", "text", "n_chars"],
                )

    bounded_batches(pages.sparkSession)
    kinds = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    out = rows.mapInArrow(run, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
