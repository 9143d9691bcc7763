"""HTML extraction by wrapper induction (operator 2).

A host's wrapper is learned from a few of its pages: their DOM trees are aligned by simple tree
matching; nodes whose text stays the same are template, nodes whose text varies are slots. An
<article> with most of the running text is the article; without one it is all that is neither noise
nor template. The wrapper is then applied to every page.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, saved, table, tune
from .urls import host_of

#: Pages per host that a wrapper is learned from, and the longest that are taken for it if others exist.
LEARN, LONGEST = 6, 60_000
#: Hosts whose wrappers may be broadcast.
HOSTS = 4000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag closes an open element of these kinds, if no element of the last kinds lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
P_ENDS = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
NOISE = frozenset("nav header footer aside form script style noscript template iframe svg canvas object button select textarea input dialog menu head title label option".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar"
    " footer foot comment comments commentlist disqus reply replies respond discussion share sharing social related recommended"
    " newsletter subscribe subscription signup login search form pagination pager toolbar skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: What holds the article is never noise by its class.
KEPT = frozenset("html body main article".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt figcaption".split())

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
#: Words of readers' remarks: what is named so is noise however much text it holds.
REMARKS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Share of a page's running text that makes an element more than noise, whatever its class.
MOST = 0.5
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    """An element: its tag, its class and id words, and its texts and elements in order."""

    __slots__ = ("tag", "words", "hidden", "inside", "most")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.words, self.hidden, self.inside, self.most = tag, (), False, [], False
        if attributes.strip():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            self.words = tuple(w.lower() for w in re.findall(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])", names)) if names.strip() else ()
            style = found.get("style", "").replace(" ", "").lower()
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or found.get("role") in ROLES

    @property
    def elements(self) -> list[Node]:
        return [x for x in self.inside if isinstance(x, Node)]

    @property
    def name(self) -> str:
        return ".".join([self.tag, *self.words])

    @property
    def noise(self) -> bool:
        named = self.tag not in KEPT and not NOISE_WORDS.isdisjoint(self.words)
        return self.tag in NOISE or self.hidden or (named and (not self.most or not REMARKS.isdisjoint(self.words)))


class Tags:
    """Where the tags of a text end: at the first `>` outside quotes. Every quote and bracket is looked at a
    bounded number of times, whatever is left open."""

    def __init__(self, text: str):
        self.text, self.dead, self.known = text, set(), (0, -1)
        self.last = text.rfind(">")

    def _special(self, at: int) -> int:
        """The next quote or closing bracket, or -1."""
        begin, end = self.known
        if not begin <= at <= end:
            m = SPECIAL.search(self.text, at)
            self.known = (at, m.start() if m else len(self.text))
        end = self.known[1]
        return end if end < len(self.text) else -1

    def end(self, at: int) -> int:
        """The place of the bracket that closes a tag whose attributes begin at `at`, or -1."""
        if at > self.last:
            return -1
        passed = []
        i = self._special(at)
        while i >= 0 and i not in self.dead:
            if self.text[i] == ">":
                return i
            passed.append(i)
            closing = self.text.find(self.text[i], i + 1)
            if closing < 0:
                break
            m = SPECIAL.search(self.text, closing + 1)
            i = m.start() if m else -1
        self.dead.update(passed)
        return -1


def parse(text: str) -> Node:
    """A tree of any text; elements that aren't closed end with what holds them. The time is in proportion
    to the text's length, also for tags, quotes and comments that are never closed."""
    root = Node("#")
    stack, at, n = [root], 0, len(text)
    tags, open_ = Tags(text), Counter()
    while at < n:
        begin = text.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            stack[-1].inside.append(entities.unescape(text[at:begin]))
            at = begin
            continue
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if text[at + 1 : at + 2] in ("!", "?") and at < tags.last:
            at = text.find(">", at) + 1
            continue
        m = OPEN.match(text, at)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            stack[-1].inside.append("<")
            at += 1
            continue
        tag, attributes, at = m[2].lower(), text[m.end() : end], end + 1
        if m[1]:
            if open_[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                _cut(stack, open_, i)
            continue
        if tag in P_ENDS:
            _close(stack, open_, ("p",), ("div", "article", "section", "td", "th", "li", "body", "main", "blockquote"))
        if tag in CLOSES:
            _close(stack, open_, CLOSES[tag], FENCE[tag])
        node = Node(tag, attributes)
        stack[-1].inside.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            open_[tag] += 1
    _weigh(root)
    return root


def _cut(stack: list[Node], open_: Counter, i: int) -> None:
    for x in stack[i:]:
        open_[x.tag] -= 1
    del stack[i:]


def _weigh(root: Node) -> None:
    """Marks the elements that hold most of the page's running text."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag not in NOISE and not x.hidden:
            order.append(x)
            todo += x.elements
    held: dict[int, int] = {}
    for x in reversed(order):
        held[id(x)] = sum(len(y.strip()) if isinstance(y, str) else held.get(id(y), 0) for y in x.inside)
    for x in order:
        x.most = held[id(x)] > MOST * held[id(root)]


def _close(stack: list[Node], open_: Counter, kinds: tuple[str, ...], fence: tuple[str, ...]) -> None:
    if not any(open_[k] for k in kinds):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in kinds:
            _cut(stack, open_, i)
            return
        if stack[i].tag in fence:
            return


def own_text(node: Node) -> str:
    """Text of a node and its inline elements, not of blocks in it."""
    parts: list[str] = []
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is node or x.tag not in BLOCK:
            todo += reversed(x.inside)
    return " ".join("".join(parts).split())


class Folded:
    """A template node: elements of equal name in a row are one, marked as repeated."""

    __slots__ = ("name", "tag", "noise", "texts", "repeated", "children", "links")

    def __init__(self, nodes: list[Node], depth: int = 0):
        first = nodes[0]
        self.name, self.tag, self.noise, self.repeated = first.name, first.tag, first.noise, len(nodes) > 1
        self.texts = ["\n".join(own_text(x) for x in nodes)]
        self.links = sum(len(own_text(y)) for x in nodes for y in x.elements if y.tag == "a")
        inner = [y for x in nodes for y in x.elements if y.tag in BLOCK] if depth < 40 else []
        runs: list[list[Node]] = []
        for y in inner:
            if runs and runs[-1][0].name == y.name:
                runs[-1].append(y)
            else:
                runs.append([y])
        self.children = [Folded(r, depth + 1) for r in runs]

    @property
    def fixed(self) -> bool:
        return len(self.texts) > 1 and len(set(self.texts)) == 1

    @property
    def varies(self) -> bool:
        """Whether slot text outside noise lies in or below the node."""
        return not self.noise and ((not self.fixed and any(self.texts)) or any(c.varies for c in self.children))


def tree_match(a: Folded, b: Folded) -> tuple[int, list[tuple[Folded, Folded]]]:
    """Simple tree matching: the most nodes of two ordered trees that pair up, and the pairs."""
    if a.name != b.name:
        return 0, []
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    inner: dict[tuple[int, int], tuple[int, list[tuple[Folded, Folded]]]] = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            w = inner[i, j] = tree_match(a.children[i - 1], b.children[j - 1])
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[0])
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += inner[i, j][1]
            i, j = i - 1, j - 1
    return best[m][n] + 1, pairs


def learn_wrapper(pages: list[str]) -> dict:
    """{"region": path or null, "constant": [[path, text], ...]} from pages of one host.

    The first page's tree is the template; the others are aligned with it. A path is the names from
    the root down, separated by blanks. Without an article the region is the whole page, so that
    nothing but noise and constant texts is left out, also where a page has what the learned ones
    lack. Paragraphs that stay the same are constant then outside the lowest node that holds all
    slot text.
    """
    trees = [Folded([parse(p)]) for p in pages]
    base = trees[0]
    for other in trees[1:]:
        for x, y in tree_match(base, other)[1]:
            x.texts.append(y.texts[0])
            x.repeated |= y.repeated
            x.links += y.links
    constant: list[list[str]] = []

    def mass(node: Folded, path: str) -> int:
        """Characters of running text in slots below a node, without links and noise."""
        if node.noise:
            return 0
        texts = node.texts
        if node.fixed and not node.repeated:
            if texts[0] and node.tag not in PARAGRAPHS:
                constant.append([path, texts[0]])
            own = 0
        else:
            own = max(0, sum(map(len, texts)) - node.links)
        return own + sum(mass(c, f"{path} {c.name}") for c in node.children)

    region, node, path = None, base, base.name
    total = mass(base, path)
    while total and node.children:
        child, most = max(((c, mass(c, f"{path} {c.name}")) for c in node.children), key=lambda x: x[1])
        if child.tag in PARAGRAPHS or child.repeated or most < 0.6 * total:
            break
        node, path = child, f"{path} {child.name}"
        region = path
        if child.tag == "article":
            break

    def template(node: Folded, path: str, stop: Folded | None = None) -> None:
        """Takes what stays the same in and below a node, but not in `stop`, as constant."""
        if node is stop or node.noise:
            return
        if node.fixed:
            constant.extend([path, line] for line in node.texts[0].split("\n") if line)
        for c in node.children:
            template(c, f"{path} {c.name}", stop)

    if node.tag != "article":
        low = base
        while (low.fixed or not any(low.texts)) and len(inner := [c for c in low.children if c.varies]) == 1 and not inner[0].repeated:
            low = inner[0]
        if base.varies:
            region = base.name
            template(base, base.name, low)
    known, todo = set(map(tuple, constant)), [(base, base.name)]
    while todo:  # a constant text's blocks are constant with it, unless slots lie among them
        x, path = todo.pop()
        inner = [(c, f"{path} {c.name}") for c in x.children]
        if (path, x.texts[0]) in known and not any(c.varies for c, _ in inner):
            for c, of in inner:
                template(c, of)
        todo += inner
    return {"region": region, "constant": sorted({(a, b) for a, b in map(tuple, constant)})}


def find_region(root: Node, path: str | None) -> Node:
    """The node at the wrapper's path; else the only article or main, the body, or the root."""
    if path:
        here, names = [root], path.split(" ")[1:]
        for name in names:
            here = [c for x in here for c in x.elements if c.name == name]
        if len(here) == 1:
            return here[0]
    found: dict[str, list[Node]] = {}
    todo = [root]
    while todo:
        x = todo.pop()
        found.setdefault(x.tag, []).append(x)
        if not x.noise or x is root:
            todo += x.elements
    for tag in ("article", "main", "body"):
        if len(found.get(tag, [])) == 1:
            return found[tag][0]
    return root


def blocks_in(node: Node, path: str) -> list[tuple[Node, str]]:
    """The outermost blocks in a node with their paths, in order; own_text has the rest of it."""
    out: list[tuple[Node, str]] = []
    todo = [(y, f"{path} {y.name}") for y in reversed(node.elements)]
    while todo:
        x, at = todo.pop()
        if x.tag in BLOCK:
            out.append((x, at))
        elif not x.noise:
            todo += [(y, f"{at} {y.name}") for y in reversed(x.elements)]
    return out


def extract(text: str | None, wrapper: dict | None) -> str:
    """The article's blocks, one to a line."""
    if not text:
        return ""
    wrapper = wrapper or {}
    root = parse(text)
    region = find_region(root, wrapper.get("region"))
    constant = {tuple(x) for x in wrapper.get("constant", ())}
    blocks: list[list[str]] = [[]]
    start = wrapper.get("region") or ""
    # Steps: a node to enter with its path, a text, or None where a block ends.
    todo: list = [(region, start)]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        else:
            node, path = x
            if node is not region and node.noise:
                blocks[-1].append(" ")
                continue
            edge = node.tag in BLOCK
            inside = [y if isinstance(y, str) else (y, f"{path} {y.name}") for y in reversed(node.inside)]
            if constant and node is not region and (path, own_text(node)) in constant:
                blocks[-1].append(" ")
                inside = blocks_in(node, path)[::-1]
            if node.tag == "br":
                blocks[-1].append(" ")
            if edge:
                blocks.append([])
                todo.append(None)
            todo += inside
    return "\n".join(line for b in blocks if (line := " ".join("".join(b).split())))


def wrappers_of(pages: DataFrame) -> DataFrame:
    """(host, wrapper): learned from at most LEARN pages per host, chosen by hash of page_id.

    The pages are chosen by an aggregation with LEARN slots per host, shorter pages first, so a hot
    host costs no more than another.
    """
    tune(pages.sparkSession, 256)
    p = pages.where("html IS NOT NULL").select("page_id", host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    rank = F.struct((F.length("html") > LONGEST).alias("long"), F.xxhash64("page_id").alias("h"), "page_id")
    slots = p.groupBy("host", F.pmod(F.xxhash64("page_id", F.lit(5)), F.lit(LEARN)).alias("slot")).agg(F.min(rank).alias("r"))
    chosen = saved(slots.select(F.col("host").alias("of"), F.col("r.page_id").alias("page_id")), "wrapper-pages")
    rows = p.join(checked_broadcast(chosen), "page_id").where(F.col("host") == F.col("of")).select("host", "page_id", "html")

    def learn(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("page_id").to_pylist(), group.column("html").to_pylist(), strict=True))[:LEARN]
        return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([json.dumps(learn_wrapper([h for _, h in rows]))])})

    return saved(rows.groupBy("host").applyInArrow(learn, "host string, wrapper string"), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null, empty and tag-only html gives an empty text. Null urls and urls without a host share one
    wrapper. Rows that repeat a page_id are each extracted; other columns are ignored.
    """
    learned = wrappers_of(pages)
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    p = p.withColumn("host", host_of(F.col("url"))).join(checked_broadcast(learned, HOSTS), "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            out = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[wrapper] = json.loads(wrapper)
                out.append(extract(page, known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    tune(pages.sparkSession, 1000)
    kind = dict(pages.dtypes)["page_id"]
    return p.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
