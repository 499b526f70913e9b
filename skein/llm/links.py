"""URL filters by propagation of trust and distrust over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle, small

HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
TRUSTED = r"\.org$"
BLOCKED = r"(^|\.)(spam-farm|cheap-pills|casino-win|ads-track|free-bets|adult-x)\."
ROUNDS, DAMPING, THRESHOLD = 20, 0.85, 0.5


def host(url: Column) -> Column:
    """The host of an absolute URL in lower case; '' for others and null."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): how many pages of host src link to another host dst."""
    link = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), host))).alias("dst")
    found = pages.select("page_id", host(F.col("url")).alias("src"), link).where("src <> '' and dst <> '' and src <> dst").distinct()
    return found.groupBy("src", "dst").agg(F.count("*").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(kind, host, r): personalised PageRank of each kind from its seeds (kind, host, s) along its edges (kind, a, b, w).

    r = (1 - damping) s + damping * (w-weighted mean of what the neighbours pass on), `rounds` times from r = s. A host that passes
    on nothing keeps nothing for others; hosts that nothing reaches are absent.
    """
    rank = seeds.withColumnRenamed("s", "r")
    base = seeds.select("kind", "host", ((1 - damping) * F.col("s")).alias("r"))
    if edges.isEmpty():
        return base
    for i in range(rounds):
        passed = edges.join(rank.withColumnRenamed("host", "a"), ["kind", "a"]).select("kind", F.col("b").alias("host"), (damping * F.col("r") * F.col("w")).alias("r"))
        rank = base.union(passed).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % 4 == 3:  # short plans
            rank = settle(rank)
    return rank


def judge(
    pages: DataFrame, trusted: str = TRUSTED, blocked: str = BLOCKED, threshold: float = THRESHOLD, rounds: int = ROUNDS, damping: float = DAMPING
) -> DataFrame:
    """(page_id, host, trust, distrust, keep) for every row of pages that has a page_id.

    Hosts are joined by their pages' links to other hosts. Trust is personalised PageRank along the links from the
    hosts that match the pattern `trusted` (and not `blocked`); distrust runs against the links from those that match `blocked`: who links to
    a blocked host is distrusted. Both are in units of one seed and rounded to nine digits. A host goes if it is blocked,
    or if distrust / (trust + distrust) exceeds `threshold`; a tie stays, and so does a host that neither reaches.

    A null or relative url has the host '', which has no links and stays. Null and empty html has no links. Repeated
    rows each have a row but link once. Without pages, links or seeds of a kind nothing of it spreads. Only page_id,
    url and html are read.
    """
    read = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = settle(host_edges(read))
    total = lambda side: links.groupBy(side).agg(F.sum("w").alias("sum"))
    edges = settle(
        links.join(total("src"), "src").select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") / F.col("sum")).alias("w"))
        .union(links.join(total("dst"), "dst").select(F.lit("d"), F.col("dst"), F.col("src"), F.col("w") / F.col("sum")))
    )
    hosts = settle(read.select(host(F.col("url")).alias("host")).union(links.select("dst")).where("host <> ''").distinct())
    bad = F.col("host").rlike(blocked)
    seeds = hosts.where(bad).select(F.lit("d").alias("kind"), "host").union(hosts.where(~bad & F.col("host").rlike(trusted)).select(F.lit("t"), "host"))
    rank = propagate(edges, settle(seeds.withColumn("s", F.lit(1.0))), rounds, damping)
    one = lambda k: F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)), 9)
    judged = settle(rank.groupBy("host").agg(one("t").alias("trust"), one("d").alias("distrust")))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return (
        read.select("page_id", host(F.col("url")).alias("host"))
        .join(small(judged), "host", "left")
        .select("page_id", "host", zero("trust"), zero("distrust"))
        .withColumn("keep", ~bad & (F.col("distrust") <= threshold * (F.col("trust") + F.col("distrust"))))
    )


def oracle() -> str:
    of = lambda url: f"coalesce(lower(regexp_extract({url}, '{HOST}', 1)), '')"
    quoted = LINK.replace("'", "''")
    steps = "".join(
        f""",
r{i + 1} AS (SELECT kind, host, sum(r) AS r FROM (
  SELECT kind, host, {1 - DAMPING!r}::DOUBLE * s AS r FROM r0
  UNION ALL SELECT kind, b, {DAMPING}::DOUBLE * r * w FROM e JOIN r{i} USING (kind) WHERE a = host) GROUP BY kind, host)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH p AS (SELECT page_id, {of("url")} AS host, html FROM pages WHERE page_id IS NOT NULL),
l AS (SELECT src, dst, count(*) AS w FROM (
  SELECT DISTINCT page_id, host AS src, {of("u")} AS dst FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '{quoted}', 1)) AS u FROM p))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
e AS (SELECT 't' AS kind, src AS a, dst AS b, w / sum(w) OVER (PARTITION BY src) AS w FROM l
  UNION ALL SELECT 'd', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM l),
h AS (SELECT host, regexp_matches(host, '{BLOCKED}') AS bad FROM (SELECT host FROM p UNION SELECT dst FROM l) WHERE host <> ''),
r0 AS (SELECT *, 1.0::DOUBLE AS s, s AS r FROM (
  SELECT 'd' AS kind, host FROM h WHERE bad UNION ALL SELECT 't', host FROM h WHERE NOT bad AND regexp_matches(host, '{TRUSTED}'))){steps},
j AS (SELECT page_id, p.host, round(coalesce(sum(r) FILTER (kind = 't'), 0), 9) AS trust, round(coalesce(sum(r) FILTER (kind = 'd'), 0), 9) AS distrust
  FROM (SELECT page_id, host, row_number() OVER () AS row FROM p) p LEFT JOIN r{ROUNDS} r ON r.host = p.host GROUP BY row, page_id, p.host)
SELECT *, NOT regexp_matches(host, '{BLOCKED}') AND distrust <= {THRESHOLD} * (trust + distrust) AS keep FROM j"""
