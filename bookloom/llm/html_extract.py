r"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, by path from the root with class names, and its text
blocks, by path and content. Tokens of a host that occur in the same pages equally
often have the same occurrence vector and form an equivalence class. Vectors are never
gathered: a token's vector is known by an order-free fingerprint of its (page, count)
pairs, so a host may hold any share of the pages. Pages whose slots hold the same texts
are copies and count as one; pages without tokens do not count. A class is valid if it
stands in ``least_pages`` pages at least and in half of the host's, and is ordered and nested: on
each page its tokens follow one another in the same turns, and all in one gap between the tokens that
stand once in every page. Tokens that do not are taken out of their class and are no template
(gaps are not judged on hosts where those once-a-page tokens change places themselves).

The valid classes of a host nest into its template: a text token belongs to it

* if it is in the root class, which stands in each page of the host, or
* if the element around it is in the template, and on the page at hand that element's
  path holds nothing but texts of valid classes. Where it also holds other texts, the
  path is a list of data, and what happens to recur there is data as well.

Text in the template is markup's; what remains are slots. Which slots are the main text is
decided by priors: menus, headers, footers, sidebars, notices, adverts, forms, comments
and the like are not, by tag, role, or a word that a class or id is or ends with. If a
page has an article (or main) element, the slots inside are its text; else all those in
the smallest container (body, div or section, never a paragraph, list or table) around
every slot, whatever their shares of the text. Only labels do not widen it: text of three
words and 24 characters at most in no text element. A box around an article that merely
has such a word somewhere in its names is a layout's and hides nothing.

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by \n. Nothing else is dropped or cut. Cases: null
or empty html gives an empty text; pages without url share a host; repeated rows are
rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import attach, settle

# Elements of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object".split())
DROPPED_TAGS = frozenset(
    "head nav header footer aside form button select textarea dialog menu script style noscript template iframe svg"
    " math object label input".split()
)
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead ad ads advert adverts"
    " advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup"
    " modal newsletter subscribe signup login comment comments disqus respond reply replies social share"
    " sharing related recommended widget toolbar pagination pager copyright complementary contentinfo".split()
)
#: What a box is called besides what it is for, at the end of a name.
GENERIC = frozenset(
    "area article articles bar block body box button buttons card col column container content form group inner item items"
    " link links list outer panel post posts row section slot stories text title unit wrap wrapper".split()
)
#: Roles of boxes that hold no main text, besides the words above.
DROPPED_ROLES = frozenset("search form dialog alertdialog tooltip".split())
#: A name that holds one of these before its last word tells what a box has or does, not what it is.
STATES = frozenset("has have with no without is not show hide hidden".split())
MAIN_WORDS = frozenset("main articlebody".split())
#: A start tag of these ends an open one of the second kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^a-z]+")
#: Elements of text, and those that can hold a page's main text.
TEXT = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
CONTAINERS = frozenset("html body div section center".split())
#: Stands once in every page with tokens, to count these.
_PAGE = 0
#: Bare text of fewer characters, and of three words at most, is a label.
_LABEL = 25


def _hash(parent: int, name: str) -> int:
    value = xxhash.xxh64_intdigest(name, parent & 0xFFFFFFFF) ^ (parent & 0xFFFFFFFFFFFFFFFF)
    return value if value < 1 << 63 else value - (1 << 64)


def _says_dropped(names: str) -> tuple[bool, bool]:
    """Whether one of these names is or ends with a dropped word, generic ones aside; whether one has such a word anywhere."""
    ends = anywhere = False
    for name in names.split():
        words = [w for w in _WORD.split(name) if w]
        if words and STATES.isdisjoint(words[:-1]):
            anywhere = anywhere or not DROPPED_WORDS.isdisjoint(words)
            while len(words) > 1 and words[-1] in GENERIC:
                words.pop()
            ends = ends or words[-1] in DROPPED_WORDS
    return ends, anywhere


class Node:
    """``dropped``: no main text; ``doubtful``: none, unless in an article inside."""

    __slots__ = ("doubtful", "dropped", "main", "name", "parent", "path")

    def __init__(self, name: str, parent: Node | None, attributes: str):
        self.name, self.parent = name, parent
        names, label, dropped_role = "", name, False
        if attributes and "=" in attributes:
            for kind, *values in _NAMES.findall(attributes):
                value = "".join(values).lower()
                names = f"{names} {value}"
                if kind.lower() == "class":
                    label = f"{name}.{value}"
                dropped_role = dropped_role or kind.lower() == "role" and value in DROPPED_ROLES
        self.path = _hash(parent.path if parent else 0, label)
        inside = parent is not None and parent.main
        own = name in ("article", "main") or not MAIN_WORDS.isdisjoint(_WORD.split(names))
        self.main = inside or own
        ends, anywhere = _says_dropped(names) if names and name not in ("html", "body") else (False, False)
        if own and not inside:
            ends = anywhere = False
        self.dropped = ends or dropped_role or name in DROPPED_TAGS and not (name == "header" and inside)
        self.doubtful = anywhere and not inside
        if parent is not None:
            self.dropped = self.dropped or parent.dropped
            self.doubtful = self.doubtful or parent.doubtful and not own


class Page:
    """A page's blocks, (node, text) in order, and how often each element path occurs."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Node, str]] = []
        self.order: list[tuple[Node, str | None]] = []  # elements and blocks as they begin
        self.paths: Counter = Counter()
        self._node: Node | None = Node("", None, "")
        self._open: list[Node] = [self._node]
        self._text: list[str] = []
        at, n = 0, len(source)
        raw_until = None
        for m in _MARKUP.finditer(source):
            if raw_until is not None:
                if not (m[1] and m[2] and m[2].lower() == raw_until):
                    continue
                raw_until, at = None, m.start()
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
            elif tag == "br":
                self._text.append(" ")
            elif self._start(tag, m[3]):
                raw_until = tag
        if at < n and raw_until is None:
            self._text.append(source[at:])
        self._flush()

    def _start(self, tag: str, attributes: str) -> bool:
        closed = CLOSES.get(tag, ())
        if tag in BLOCKS:
            self._flush()
            closed = (*closed, "p") if tag not in ("option", "optgroup") else closed
        for k in range(len(self._open) - 1, 0, -1):
            name = self._open[k].name
            if name in closed:
                del self._open[k:]
                break
            if name in BLOCKS and name not in ("p",):
                break
        node = Node(tag, self._open[-1], attributes)
        self.paths[node.path] += 1
        self.order.append((node, None))
        if tag in VOID or attributes.endswith("/"):
            return False
        self._open.append(node)
        return tag in RAW

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].name == tag:
                del self._open[k:]
                return

    def _flush(self) -> None:
        if not self._text:
            return
        parts = [html_module.unescape(t) if "&" in t else t for t in self._text]
        self._text = []
        text = " ".join("".join(parts).split())
        if text:
            node = self._open[-1]
            while node.parent is not None and node.name not in BLOCKS:
                if node.dropped or node.doubtful:
                    break
                node = node.parent
            self.blocks.append((node, text))
            self.order.append((node, text))

    def slots(self) -> list[tuple[Node, str]]:
        return [b for b in self.blocks if not b[0].dropped and not b[0].doubtful]


def text_token(node: Node, text: str) -> int:
    return _hash(node.path, "\0" + text)


def tokens(page: Page) -> Counter:
    """Occurrences of the page's element paths and, inside its slots, text blocks."""
    out = Counter(page.paths)
    for node, text in page.slots():
        out[text_token(node, text)] += 1
    return out


def places(page: Page, classes: dict[int, int], sizes: Counter, anchors: set[int]) -> dict[int, tuple[int, int, int, int]]:
    """Of the page's tokens in classes: least and greatest turn among its class's, least and greatest number of anchors before it.

    Pages that hold a class in part or unevenly (copies that differ outside their slots) tell nothing of it.
    """
    sequence = [n.path if t is None else text_token(n, t) for n, t in page.order if t is None or not n.dropped and not n.doubtful]
    times = Counter(t for t in sequence if t in classes)
    here: dict[int, list[int]] = {}
    for token, n in times.items():
        here.setdefault(classes[token], []).append(n)
    even = {c for c, n in here.items() if len(n) == sizes[c] and min(n) == max(n)}
    whole = all(times[a] == 1 for a in anchors)
    turns, before, out = Counter(), 0, {}
    for token in sequence:
        own = classes.get(token)
        if own is None:
            continue
        turn = turns[own] % sizes[own] if own in even else None
        turns[own] += 1
        gap = before if whole and token not in anchors else None
        before += token in anchors
        out[token] = _wider(out.get(token), (turn, turn, gap, gap))
    return out


def _wider(a: tuple | None, b: tuple) -> tuple:
    """The least and greatest of both; None tells nothing."""
    if a is None:
        return b
    return tuple(y if x is None else x if y is None else (min, max)[k % 2](x, y) for k, (x, y) in enumerate(zip(a, b)))


def data_slots(page: Page, template: set[int], root: set[int]) -> list[tuple[Node, str]]:
    """The page's slots that are not text of its host's template."""
    slots = page.slots()
    if not template:
        return slots
    lists = {n.path for n, t in slots if n.path not in template or text_token(n, t) not in template}
    return [(n, t) for n, t in slots if text_token(n, t) not in root and n.path in lists]


def main_text(page: Page, template: set[int], root: set[int] = frozenset()) -> str:
    """The page's main text, given the tokens of its host's template and those of them that all pages have."""
    data = data_slots(page, template, root)
    inside = [b for b in data if b[0].main]
    if inside or any(b[0].main for b in page.slots()):
        return "\n".join(t for _, t in inside)
    return "\n".join(t for _, t in _contained(data))


def _above(node: Node | None) -> list[Node]:
    """The node and the elements around it, outermost first."""
    chain = []
    while node is not None:
        chain.append(node)
        node = node.parent
    return chain[::-1]


def _contained(slots: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """The slots inside the smallest container around all of them but labels."""
    chains = [
        chain for chain, text in ((_above(n), t) for n, t in slots)
        if len(text) >= _LABEL or len(text.split()) > 3 or any(n.name in TEXT for n in chain)
    ]
    if not chains:
        return slots
    common = chains[0]
    for chain in chains[1:]:
        k = 0
        while k < min(len(common), len(chain)) and common[k] is chain[k]:
            k += 1
        common = common[:k]
    if all(len(chain) == len(common) for chain in chains) and len(common) > 1:
        common = common[:-1]  # a leaf
    while len(common) > 1 and common[-1].name not in CONTAINERS:
        common = common[:-1]
    k = len(common) - 1
    return [b for b in slots if (chain := _above(b[0])) and len(chain) > k and chain[k] is common[k]]


def host_of(url) -> object:
    """The host of a url column, in lower case, without user and port; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(rest)


def _page_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's tokens with a mark of the page's texts and their number, and _PAGE once if it has any."""
    for batch in batches:
        hosts, found, marks, uses = [], [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(source)
            counts = tokens(page)
            # Copies of a page have the same marks, so they count as one.
            texts = sorted(Counter(t for _, t in page.slots()).items())
            own = xxhash.xxh64_intdigest(repr(texts))
            if counts:
                counts[_PAGE] = 1
            for token, n in counts.items():
                hosts.append(host)
                found.append(token)
                marks.append(_hash(own, f"{own} {n}"))
                uses.append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(marks, pa.int64()), pa.array(uses, pa.int64())],
            names=["host", "token", "mark", "uses"],
        )


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def _valid(pages: DataFrame, sizes: DataFrame, least_pages: int) -> DataFrame:
    """host, pages (different ones with tokens), token, class, class_pages, uses of each token in a valid class."""
    found = _hosted(pages).mapInArrow(_page_tokens, "host string, token long, mark long, uses long")
    found = found.groupBy("host", "token", "mark").agg(F.max("uses").alias("uses"))
    found = found.groupBy("host", "token").agg(
        F.expr("bit_xor(mark)").alias("class"), F.count(F.lit(1)).alias("class_pages"), F.sum("uses").alias("uses")
    )
    found = settle(found.filter(F.col("class_pages") >= least_pages))
    counts = found.filter(F.col("token") == _PAGE).select("host", F.col("class_pages").alias("pages"))
    counts = settle(sizes.join(counts, "host"))
    rows = attach(found.filter(F.col("token") != _PAGE), counts, "host", "rows", how="inner").drop("rows")
    return rows.filter(F.col("class_pages") * 2 >= F.col("pages"))


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple = (None, {}, Counter(), set())
    for batch in batches:
        out: dict[tuple, tuple] = {}
        for r, (host, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if host != known[0]:
                candidates = batch.column(2)[r].as_py() or ()
                classes = {c["token"]: c["id"] for c in candidates}
                known = host, classes, Counter(classes.values()), {c["token"] for c in candidates if c["anchor"]}
            for token, found in places(Page(source), *known[1:]).items():
                out[host, token] = _wider(out.get((host, token)), found)
        rows = [(*key, *found) for key, found in out.items()]
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "token", *_RANGE])


_RANGE = ("first_turn", "last_turn", "first_gap", "last_gap")


def _ordered_nested(pages: DataFrame, sizes: DataFrame, valid: DataFrame) -> DataFrame:
    """The tokens of ``valid`` (settled) without those that break their class's order or its nesting."""
    whole = F.col("class_pages") == F.col("pages")
    fact = F.struct("token", F.xxhash64("class", "class_pages", "uses").alias("id"), (whole & (F.col("uses") == F.col("pages"))).alias("anchor"))
    candidates = settle(sizes.join(valid.groupBy("host").agg(F.collect_list(fact).alias("candidates")), "host", "left"))
    rows = attach(_hosted(pages), candidates, "host", "rows", twice=True).select("host", "html", "candidates")
    found = rows.mapInArrow(_places, f"host string, token long, {', '.join(f'{c} long' for c in _RANGE)}")
    found = found.groupBy("host", "token").agg(*((F.min if c.startswith("first") else F.max)(c).alias(c) for c in _RANGE))
    found = settle(valid.join(found, ["host", "token"], "left").withColumn("moves", F.expr("coalesce(first_turn < last_turn, false)")))
    loose = found.groupBy("host").agg(F.bool_or(F.col("moves") & whole & (F.col("uses") == F.col("pages"))).alias("loose"))
    found = found.join(loose, "host")
    return found.filter("not moves and (loose or coalesce(first_gap = last_gap, true))").select(*valid.columns)


def _sizes(pages: DataFrame) -> DataFrame:
    """host, rows: how many rows of pages each host has."""
    return pages.select(host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("rows"))


def host_templates(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """host, pages (different ones with tokens), class (fingerprint), class_pages, uses, tokens: the valid classes of each host."""
    valid = _valid(pages, settle(_sizes(pages)), least_pages)
    return valid.groupBy("host", "pages", "class", "class_pages", "uses").agg(F.collect_list("token").alias("tokens"))


def extract(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    sizes = settle(_sizes(pages))
    of_root = F.when(F.col("class_pages") == F.col("pages"), F.col("token"))
    # A token of half of a host's pages: not many more of them than a page has tokens.
    valid = _ordered_nested(pages, sizes, settle(_valid(pages, sizes, least_pages))).groupBy("host").agg(
        F.collect_list("token").alias("template"), F.collect_list(of_root).alias("root")
    )
    templates = settle(sizes.join(valid, "host", "left").select(F.col("host").alias("_host"), "rows", "template", "root"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host_of(F.col("url")).alias("_host"),
    )
    joined = attach(rows, templates, "_host", "rows", twice=True).select("page_id", "url", "html", "_host", "template", "root")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, set(), set())
        for batch in batches:
            texts = []
            for source, host, *sets in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                if host != known[0]:
                    known = host, *(set(x.as_py() or ()) for x in sets)
                texts.append(main_text(Page(source), *known[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
