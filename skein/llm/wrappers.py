"""HTML extraction by wrapper induction."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import host
from .store import settle, small

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|([^<]+|<)", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What an opening tag closes, up to the nearest of the tags after it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
} | dict.fromkeys(BLOCK, ({"p"}, BLOCK - {"p"}))
DEEPEST = 200
#: A slot in which one value has more than this part of the pages doesn't tell copies of an article.
CONSTANT = 0.9
#: From this part of recurring values on, a template slot goes with all of its texts.
WHOLE = 0.9


class Node:
    """An element, or a text (tag '' and no children)."""

    __slots__ = ("tag", "text", "children", "weight", "key")

    def __init__(self, tag: str, text: str = ""):
        self.tag, self.text, self.children = tag, text, []


def parse(html: str) -> Node:
    """The tree of elements and texts; blanks are folded, blank texts, comments, scripts and styles left out.

    Missing end tags are supplied, stray ones ignored; elements more than DEEPEST deep stand beside their parents.
    """
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        if m is None:
            break
        at = m.end()
        text, tag = m[4], m[2]
        if text is not None:
            if not text.isspace():
                above = stack[-1].children
                text = " ".join((unescape(text) if "&" in text else text).split())
                if above and above[-1].tag == "":
                    above[-1].text += text
                elif text:
                    above.append(Node("", text))
        elif tag is not None:
            tag = tag.lower()
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            if tag in CLOSES:
                closed, until = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closed:
                        del stack[i:]
                        break
                    if stack[i].tag in until:
                        break
            node = Node(tag)
            stack[-1].children.append(node)
            if tag not in VOID and not m[3].endswith("/") and len(stack) < DEEPEST:
                stack.append(node)
    weigh(root)
    return root


def weigh(node: Node) -> None:
    """weight: of matching the node with its equal; key: equal for equal subtrees."""
    if node.tag == "":
        node.weight, node.key = 2, hash(node.text)
        return
    for child in node.children:
        weigh(child)
    node.weight = 1 + sum(c.weight for c in node.children)
    node.key = hash((node.tag, *(c.key for c in node.children)))


def match(a: Node, b: Node, kept: dict) -> int:
    """Simple tree matching: the most that an order-preserving mapping of two trees scores, roots on each other.

    A pair of elements of one tag counts 1, a pair of texts 1, of equal texts 2. kept: the tables of the pairs that needed one.
    """
    if a.tag != b.tag:
        return 0
    if a.tag == "":
        return 2 if a.text == b.text else 1
    if a.key == b.key:
        return a.weight
    x, y = a.children, b.children
    if len(x) == 1 and len(y) == 1 and x[0].tag == y[0].tag == "":
        return 2  # keys differ, so the texts do
    row = [0] * (len(y) + 1)
    table = [row]
    for c in x:
        left, new = 0, [0]
        for j, d in enumerate(y):
            best = row[j + 1]
            if left > best:
                best = left
            if c.tag == d.tag:
                both = row[j] + match(c, d, kept)
                if both > best:
                    best = both
            new.append(best)
            left = best
        table.append(new)
        row = new
    kept[id(a), id(b)] = table
    return 1 + row[-1]


def align(a: Node, b: Node, kept: dict, pairs: dict) -> None:
    """Add to pairs, by id, which node of a each node of b is mapped to in the best mapping; of equal ones the last pairs."""
    pairs[id(b)] = a
    x, y = a.children, b.children
    table = kept.get((id(a), id(b)))
    if table is None:  # equal subtrees, or one text each
        for c, d in zip(x, y):
            align(c, d, kept, pairs)
        return
    i, j = len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            align(x[i], y[j], kept, pairs)


def texts(node: Node):
    """The texts of a tree in order, without those of the head."""
    if node.tag == "":
        yield node
    elif node.tag != "head":
        for child in node.children:
            yield from texts(child)


def paths(root: Node) -> tuple[int, int]:
    """Number of distinct tag paths, and of nodes."""
    seen, n, todo = set(), 0, [(root, ())]
    while todo:
        node, above = todo.pop()
        here = hash((above, node.tag))
        seen.add(here)
        n += 1
        todo.extend((c, here) for c in node.children)
    return len(seen), n


def _read(pages: DataFrame) -> DataFrame:
    return pages.where("page_id is not null").select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


def references(pages: DataFrame) -> DataFrame:
    """(host, reference): of each host the html with the most distinct tag paths; ties: the fewest nodes, the least page_id, the least html."""

    def run(batches):
        for batch in batches:
            found = [paths(parse(h)) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("mark"), pa.array([-p for p, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())],
                ["page_id", "host", "mark", "p", "n"],
            )

    sized = pages.select("page_id", "host", "html", F.xxhash64("html").alias("mark")).mapInArrow(run, "page_id bigint, host string, mark bigint, p int, n int")
    best = settle(sized.groupBy("host").agg(F.min(F.struct("p", "n", "page_id", "mark")).alias("best")).select("host", "best.page_id", "best.mark"))
    chosen = pages.withColumn("mark", F.xxhash64("html")).join(small(best), ["host", "page_id", "mark"]).groupBy("host").agg(F.min("html").alias("reference"))
    return settle(chosen)


def aligned(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page_id, url, host, mark, nodes): the texts of each page with the number of the reference's text that each is mapped to, -1 if to none."""

    def run(batches):
        trees: dict[str, tuple[Node, dict]] = {}
        for batch in batches:
            nodes = []
            for html, reference in zip(batch.column("html").to_pylist(), batch.column("reference").to_pylist()):
                if reference not in trees:
                    if len(trees) > 500:
                        trees.clear()
                    tree = parse(reference)
                    trees[reference] = tree, {id(x): i for i, x in enumerate(texts(tree))}
                tree, slot = trees[reference]
                page, kept, pairs = parse(html), {}, {}
                match(tree, page, kept)
                align(tree, page, kept, pairs)
                nodes.append([{"slot": slot.get(id(pairs.get(id(t))), -1), "text": t.text} for t in texts(page)])
            kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host", "mark")), pa.array(nodes, kind)], ["page_id", "url", "host", "mark", "nodes"]
            )

    both = pages.withColumn("mark", F.xxhash64("html")).join(small(chosen), "host")
    return settle(
        both.select("page_id", "url", "host", "mark", "html", "reference").mapInArrow(
            run, "page_id bigint, url string, host string, mark bigint, nodes array<struct<slot: int, text: string>>"
        )
    )


def extract(pages: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """(page_id, url, host, content, n_template, n_content) for every row of pages that has a page_id.

    Every page's DOM tree is aligned by simple tree matching with a reference page of its host (see references). A text of the
    reference is a slot; the texts mapped to it are its values. A slot is template if it has values on at least `least`
    distinct pages and at least the part `share` of them have a value that another page has there too: nodes that stay
    constant, or rotate among few values. In it only the texts that recur go, and a value that one page has stays, unless at
    least the part WHOLE recurs: then all go. Other slots vary, and their texts are content, as are texts that are mapped to none. `content` joins the content with line breaks; the counts are numbers of texts.

    Equal pages count once when slots are judged, and so do pages that share their longest text outside constant slots, so
    copies of an article beside other ads don't make a template. A host of fewer than `least` pages is all
    content. Null and empty html gives empty content; a null or relative url has the host ''. Repeated rows each have
    a row. Ties (a share just reached) are template. An empty table gives no row. Long pages are read whole. Only page_id, url and html are read.
    """
    read = _read(pages)
    found = aligned(read, references(read))
    value = (
        found.select(F.xxhash64("host").alias("host"), "mark", F.explode("nodes").alias("x")).where("x.slot >= 0")
        .select("host", "x.slot", F.xxhash64("x.text").alias("h"), "mark", F.length("x.text").alias("size")).distinct()
    )
    varying = (
        value.groupBy("host", "slot", "h").agg(F.count("*").alias("n")).groupBy("host", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        .where(F.col("most") <= CONSTANT * F.col("n")).select("host", "slot")
    )
    body = value.join(varying, ["host", "slot"]).groupBy("host", "mark").agg(F.max(F.struct("size", "h")).alias("body")).select("host", "mark", "body.h")
    body = body.withColumnRenamed("h", "body")
    told = value.join(body, ["host", "mark"], "left").select("host", "slot", "h", F.coalesce("body", "mark").alias("body")).distinct()
    seen = settle(told.groupBy("host", "slot", "h").agg(F.count("*").alias("n")))
    slots = (
        seen.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"))
        .where((F.col("n") >= least) & (F.col("again") >= share * F.col("n")))
        .select("host", "slot", (F.col("again") >= WHOLE * F.col("n")).alias("whole"))
    )
    gone = seen.where("n > 1").join(slots, ["host", "slot"]).groupBy(F.col("host").alias("__host")).agg(
        F.collect_set(F.when(F.col("whole"), F.col("slot"))).alias("__slots"), F.collect_set(F.when(~F.col("whole"), F.struct("slot", "h"))).alias("__gone")
    )
    judged = found.join(small(settle(gone)), F.xxhash64("host") == F.col("__host"), "left")
    drop = lambda x: F.array_contains("__slots", x.slot) | F.array_contains("__gone", F.struct(x.slot.alias("slot"), F.xxhash64(x.text).alias("h")))
    kept = F.filter("nodes", lambda x: F.col("__host").isNull() | ~drop(x))
    return judged.withColumn("kept", kept).select(
        "page_id", "url", "host", F.array_join(F.transform("kept", lambda x: x.text), "\n").alias("content"),
        (F.size("nodes") - F.size("kept")).alias("n_template"), F.size("kept").alias("n_content"),
    )
