import random
from functools import lru_cache

from skein.llm import wrappers
from skein.llm.wrappers import Node, align, match, parse, texts, weigh


def tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return Node("", rng.choice(["x", "y", "z"]))
    node = Node(rng.choice("abp"))
    node.children = [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return node


def plain(a, b):
    """Simple tree matching without shortcuts."""
    if a.tag != b.tag:
        return 0
    if not a.tag:
        return 2 if a.text == b.text else 1
    x, y = a.children, b.children

    @lru_cache(None)
    def most(i, j):
        if not i or not j:
            return 0
        return max(most(i - 1, j), most(i, j - 1), most(i - 1, j - 1) + plain(x[i - 1], y[j - 1]))

    return 1 + most(len(x), len(y))


def test_matching_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = Node("r"), Node("r")
        a.children, b.children = [[tree(rng) for _ in range(rng.randrange(5))] for _ in range(2)]
        weigh(a), weigh(b)
        kept, pairs = {}, {}
        value = match(a, b, kept)
        assert value == plain(a, b)
        align(a, b, kept, pairs)
        node = {}
        todo = [b]
        while todo:
            n = todo.pop()
            node[id(n)] = n
            todo += n.children
        assert sum((1 if node[k].tag or node[k].text != v.text else 2) for k, v in pairs.items()) == value
        assert len({id(v) for v in pairs.values()}) == len(pairs) and all(node[k].tag == v.tag for k, v in pairs.items())


def test_parsing():
    show = lambda html: [t.text for t in texts(parse(html))]
    assert show('<!DOCTYPE html><head><title>t</title></head><script>var t="</p>";x<y</script><p>a&amp;b<p><b>c<br>d<!-- no --> e') == ["a&b", "c", "de"]
    assert show("") == [] == show("<") == show("<!-- open") or show("<") == ["<"]
    assert show("<ul><li>1<li>2</ul></div>3<style>") == ["1", "2", "3"]
    assert show("<p>x</p>" * 3) == ["x"] * 3 and show("<div>" * 5000 + "deep") == ["deep"]
    p = parse("<p>one<p>two<ul><li>a<li>b</ul>")
    assert [c.tag for c in p.children] == ["p", "p", "ul"] and [c.tag for c in p.children[2].children] == ["li", "li"]


def page(nav, body, foot="same"):
    return f"<html><head><title>t</title></head><body><nav><ul>{''.join(f'<li><a>{n}</a></li>' for n in nav)}</ul></nav><article>{''.join(f'<p>{b}</p>' for b in body)}</article><footer>{foot}</footer></body></html>"


def pages(spark):
    rng = random.Random(6)
    rows = []
    for i in range(12):
        rows.append((i, f"http://one.com/{i}", page(["home", "news"], [f"text {i} {j}" for j in range(rng.randrange(1, 5))], "© one"), "x", 0))
    for i in range(20, 40):  # the menu rotates between two
        rows.append((i, f"http://two.com/{i}", page([["up", "left"], ["down", "right"]][i % 2], [f"body {i}"], "end"), "x", 0))
    rows += [(50, "http://few.com/1", page(["a"], ["b"]), "x", 0), (51, "http://few.com/2", page(["a"], ["c"]), "x", 0)]
    rows += [(60 + i, "http://copies.com/1", page(["a"], ["same text"]), "x", 0) for i in range(5)]
    rows += [(70, "http://one.com/70", None, "x", 0), (71, "http://one.com/71", "", "x", 0), (72, None, "<p>lonely", "x", 0), (None, "http://one.com", "x", "x", 0), (0, *rows[0][1:])]
    rows += [(80, "http://one.com/80", page(["home", "news"], ["p " * 40_000]), "x", 0)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, mark string, slot int")


def test_templates_go_and_content_stays(spark):
    found = wrappers.extract(pages(spark)).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == pages(spark).where("page_id is not null").count()
    for i in range(12):
        assert all(line.startswith(f"text {i} ") for line in by[i].content.split("\n")) and by[i].n_template == 3
    for i in range(20, 40):
        assert by[i].content == f"body {i}" and by[i].n_template == 3
    assert by[50].content == "a\nb\nsame" and by[50].n_template == 0
    assert by[60].content == "a\nsame text\nsame"
    assert by[70].content == "" == by[71].content and by[72].content == "lonely" and by[72].host == ""
    assert len(by[80].content) > 79_000


def test_slots_equal_brute_force(spark):
    frame = pages(spark)
    rows = sorted({(r.page_id, r.url, r.html or "") for r in frame.collect() if r.page_id is not None}, key=str)
    mine = [(i, h) for i, u, h in rows if u and "//one.com" in u]
    sized = {h: wrappers.paths(parse(h)) for _, h in mine}
    reference = parse(min(mine, key=lambda r: (-sized[r[1]][0], sized[r[1]][1], r[0]))[1])
    slot = {id(t): n for n, t in enumerate(texts(reference))}
    seen = {}
    for html in {h for _, h in mine}:
        p, kept, pairs = parse(html), {}, {}
        match(reference, p, kept)
        align(reference, p, kept, pairs)
        for t in texts(p):
            if id(t) in pairs:
                seen.setdefault(slot[id(pairs[id(t)])], []).append(t.text)
    template = {s for s, v in seen.items() if len(v) >= 3 and sum(v.count(x) > 1 for x in v) >= 0.5 * len(v)}
    found = {r.page_id: r for r in wrappers.extract(frame).collect()}
    for i, html in mine:
        p, kept, pairs = parse(html), {}, {}
        match(reference, p, kept)
        align(reference, p, kept, pairs)
        want = [t.text for t in texts(p) if slot.get(id(pairs.get(id(t))), -1) not in template]
        assert found[i].content == "\n".join(want)


def test_no_pages(spark):
    assert wrappers.extract(pages(spark).limit(0)).count() == 0


def test_copies_of_an_article_beside_other_ads_stay(spark):
    """Half of a host's pages carry one article beside different ads; neither it nor the unique articles go."""
    story = ["the same heading", "the same long story, told on half of the pages of the host"]
    rows = []
    for host, n in (("four", 4), ("hot", 40)):
        for i in range(n):
            body = story if i % 2 else [f"heading {i}", f"an article that only page {i} of the host has, as long as a story"]
            rows.append((len(rows), f"http://{host}.com/{i}", page(["home", "news"], body, "end").replace("<article>", f"<aside>ad {i}</aside><article>")))
    found = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    for r in found:
        i = int(r.url.rpartition("/")[2])
        want = story if i % 2 else [f"heading {i}", f"an article that only page {i} of the host has, as long as a story"]
        assert r.content == "\n".join([f"ad {i}", *want]) and r.n_template == 3
