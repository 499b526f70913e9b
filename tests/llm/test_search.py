import numpy as np
import pytest

from skein.llm import links, topk
from tests.oracle import SMALL, same


def exact(rows, k):
    """Top k by exact integer arithmetic."""
    q = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, float)
        u = [int(x) for x in np.rint(v / np.sqrt((v * v).sum()) * 2**26)]
        q[i] = min(q[i], u) if i in q else u
    out = set()
    for i, u in q.items():
        s = sorted((-sum(a * b for a, b in zip(u, w)), j) for j, w in q.items() if j != i and len(w) == len(u))
        out |= {(i, r + 1, j, -d / 2**52) for r, (d, j) in enumerate(s[:k])}
    return out


SCHEMA = "vec_id bigint, embedding array<float>, rank string, dim int, b string"


@pytest.mark.parametrize("block", [7, 1000])
def test_topk_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).tolist()) for i in range(60)]  # many ties and copies
    rows += [(100 + i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(4)]  # fewer than k of their length
    rows += [(None, [1, 2, 3, 4]), (200, None), (201, []), (202, [0, 0, 0, 0]), (203, [1.0, None, 2, 3]), (204, [float("nan"), 1, 2, 3]), (205, [float("inf"), 1, 2, 3])]
    rows += [rows[0], (5, [1, 2, 0, 1])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x", 0, "y") for i, v in rows], SCHEMA)
    found = {tuple(r) for r in topk.neighbours(df, 5, block=block, every=1).collect()}
    assert found == exact(rows, 5)
    some = {tuple(r) for r in topk.neighbours(df, 5, block=block).collect()}  # queries are one in 20, neighbours are all
    assert some == {r for r in found if r[0] % 20 == 0} and {r[0] for r in some} == {0, 20, 40, 100} and any(r[2] % 20 for r in some)


def test_topk_of_many_equal_scores_and_of_none(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame([(i, v, "x", 0, "y") for i, v in rows], SCHEMA)
    assert {tuple(r) for r in topk.neighbours(df, 3, block=50, every=1).collect()} == exact(rows, 3)
    assert topk.neighbours(df.limit(0)).count() == 0 == topk.neighbours(df.limit(1)).count()


def test_topk_over_the_whole_table(spark):
    same(topk.neighbours(spark.read.parquet(f"{SMALL}/embeddings.parquet")), topk.oracle())


PAGES = [
    (1, "https://a.org/x", '<a href="http://b.com/1">b</a> <a class="k" href=\'//c.com\'>c</a> <a href="/local">l</a>', "x"),
    (2, "http://A.org:80/y", '<A HREF=http://b.com/2>b</A><a href="http://b.com/3">again</a>', "x"),
    (3, "http://b.com/", '<a href="http://spam-farm.example.com/">s</a>', "x"), (3, "http://b.com/", '<a href="http://spam-farm.example.com/">s</a>', "x"),
    (4, "http://user@d.net?q", '<a href="http://b.com">b</a><a href="http://www.spam-farm.example.com/">w</a>', "x"),
    (5, "http://spam-farm.example.com/", '<a href="http://a.org">a</a>', "x"), (6, None, '<a href="http://a.org">a</a>', "x"), (7, "/relative", None, "x"),
    (None, "http://e.org", '<a href="http://a.org">a</a>', "x"), (8, "http://e.org", "", None),
]


def test_links_spread_trust_and_distrust(spark):
    edges = {("a.org", "b.com"): 2, ("a.org", "c.com"): 1, ("b.com", "spam-farm.example.com"): 1, ("d.net", "b.com"): 1, ("d.net", "www.spam-farm.example.com"): 1, ("spam-farm.example.com", "a.org"): 1}
    hosts = sorted({h for e in edges for h in e} | {"e.org"})
    bad = {h for h in hosts if "spam-farm" in h}

    def rank(links_, seeds):
        out = {h: sum(w for (a, _), w in links_.items() if a == h) for h in hosts}
        r = {h: float(h in seeds) for h in hosts}
        for _ in range(links.ROUNDS):
            r = {h: 0.15 * (h in seeds) + 0.85 * sum(r[a] * w / out[a] for (a, b), w in links_.items() if b == h) for h in hosts}
        return r

    t, d = rank(edges, {"a.org", "e.org"}), rank({(b, a): w for (a, b), w in edges.items()}, bad)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, host string")
    found = links.judge(pages).collect()
    assert sorted(r.page_id for r in found) == [1, 2, 3, 3, 4, 5, 6, 7, 8]
    for r in found:
        if not r.host:
            assert (r.trust, r.distrust, r.keep) == (0, 0, True)
            continue
        assert (r.trust, r.distrust) == pytest.approx((t[r.host], d[r.host]), abs=1e-8)
        assert r.keep == (r.host not in bad and d[r.host] <= 0.5 * (t[r.host] + d[r.host]))
    assert {r.page_id for r in found if not r.keep} == {3, 4, 5} or {r.page_id for r in found if not r.keep} == {4, 5}


def test_links_equal_their_sql(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, host string").select("page_id", "url", "html").dropDuplicates()
    pages.where("page_id is not null").toPandas().to_parquet(tmp_path / "pages.parquet")
    same(links.judge(spark.read.parquet(str(tmp_path / "pages.parquet"))), links.oracle(), str(tmp_path))
    same(links.judge(spark.read.parquet(f"{SMALL}/pages.parquet")), links.oracle())
    assert links.judge(pages.limit(0)).count() == 0
