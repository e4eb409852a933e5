"""URL filters by propagation over the host graph.

An edge joins the host of a page to each other host that the page links to, weighted by links. Trust is personalised PageRank from trusted
hosts along the edges; distrust the same from blocked hosts against them, so that it reaches those who link to the blocked. A rank's
share of a host without (in)coming edges to follow returns to the seeds. Both walk in one join of edges and ranks an iteration;
scores are ranks times the number of hosts, so that 1 is the average, and each host is judged by thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenloom.llm.common import cut, heavy_join, release

DAMPING, ITERATIONS, EVERY = 0.85, 20, 5
#: Scores from which a host counts as blocked or as trusted.
BLOCK_AT, TRUST_AT = 1.0, 1.0
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)"
HREF = r"""href\s*=\s*["']([^"']*)["']"""


def host_of(url) -> F.Column:
    """The host of a URL that names one, in small letters; otherwise null."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def edges_of(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links from one host's pages to another host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href")).where(F.col("src").isNotNull() & F.col("href").contains("//"))
    return links.select("src", host_of(F.trim("href")).alias("dst")).where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def target_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): a host graph for pages whose links are all relative, such as the synthetic ones: hosts that share a link's target.

    The target belongs to the host with the most links to it, the least of those with as many; every other host that has it counts as
    linking there, with its number of links. So a target that all hosts share makes one edge a host, not one a pair of hosts.
    """
    links = pages.select(host_of(F.col("url").cast("string")).alias("src"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(HREF), F.lit(1))).alias("href")).where(F.col("src").isNotNull() & F.col("href").startswith("/") & ~F.col("href").startswith("//"))
    shared = links.groupBy("src", "href").agg(F.count("*").alias("n"))
    owners = shared.groupBy("href").agg(F.count("*").alias("hosts"), F.min(F.struct((-F.col("n")).alias("n"), "src"))["src"].alias("dst")).where("hosts > 1")
    return shared.join(owners, "href").where("src <> dst").groupBy("src", "dst").agg(F.sum("n").cast("double").alias("w"))


def _under(host, domains: Sequence[str]) -> F.Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def judge(pages: DataFrame, trusted: Sequence[str] = (), blocked: Sequence[str] = (), iterations: int = ITERATIONS, damping: float = DAMPING, block_at: float = BLOCK_AT, trust_at: float = TRUST_AT, more_edges: DataFrame | None = None) -> DataFrame:
    """(host, pages, trust, distrust, verdict) of every host that has a page or is linked to.

    Seeds are domains: a host is one if it equals a domain or lies under it. A host at `block_at` distrust or more is "blocked", else at `trust_at`
    trust or more "trusted", else "unknown"; at the threshold counts as reached. A page with a null or hostless URL belongs to no
    host; null or empty html has no links; links without a host stay on their host and are no edges. Repeated rows count again, as
    pages and as weights. Texts are read whole. more_edges: (src, dst, w) that count beside the links between hosts. Other columns are ignored. Without seeds of a kind that score is 0. An empty table gives an empty result.
    """
    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = edges_of(rows)
    if more_edges is not None:
        edges = edges.unionByName(more_edges.select("src", "dst", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    edges = cut(edges)
    counts = rows.select(host_of(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("pages"))
    linked = edges.select(F.col("dst").alias("host"), F.lit(0).cast("bigint").alias("pages")).unionByName(edges.select(F.col("src").alias("host"), F.lit(0).cast("bigint").alias("pages")))
    hosts = counts.unionByName(linked).groupBy("host").agg(F.sum("pages").alias("pages"))
    out_w, in_w = edges.groupBy(F.col("src").alias("host")).agg(F.sum("w").alias("out_w")), edges.groupBy(F.col("dst").alias("host")).agg(F.sum("w").alias("in_w"))
    marked = hosts.withColumns({"t": _under(F.col("host"), trusted).cast("double"), "b": _under(F.col("host"), blocked).cast("double")})
    base = cut(marked.join(out_w, "host", "left").join(in_w, "host", "left"))
    n, seeds_t, seeds_b = base.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    base = base.withColumns({"t": F.col("t") / max(seeds_t, 1.0), "b": F.col("b") / max(seeds_b, 1.0)})
    ranks = base.select("host", "t", "b", "out_w", "in_w", "pages", F.col("t").alias("trust"), F.col("b").alias("distrust"))
    has_edges = not edges.isEmpty()
    if has_edges:  # once for either direction
        ways = cut(edges.select("src", F.col("dst").alias("host"), "w", F.lit(True).alias("ahead")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("host"), "w", F.lit(False).alias("ahead"))))
    for i in range(iterations if has_edges else 0):
        lost_t, lost_b = ranks.agg(F.coalesce(F.sum(F.when(F.col("out_w").isNull(), F.col("trust"))), F.lit(0.0)).alias("lost_t"), F.coalesce(F.sum(F.when(F.col("in_w").isNull(), F.col("distrust"))), F.lit(0.0)).alias("lost_b")).first()
        here = ranks.select(F.col("host").alias("src"), (F.col("trust") / F.col("out_w")).alias("rt"), (F.col("distrust") / F.col("in_w")).alias("rb"))
        got = ways.join(here, "src").groupBy("host").agg(F.sum(F.when(F.col("ahead"), F.col("rt") * F.col("w"))).alias("ct"), F.sum(F.when(~F.col("ahead"), F.col("rb") * F.col("w"))).alias("cb"))
        step = lambda seed, c, lost: (1 - damping) * F.col(seed) + damping * (F.coalesce(F.col(c), F.lit(0.0)) + lost * F.col(seed))
        ranks = cut(ranks.join(got, "host", "left").select("host", "t", "b", "out_w", "in_w", "pages", step("t", "ct", lost_t).alias("trust"), step("b", "cb", lost_b).alias("distrust")))
        if (i + 1) % EVERY == 0:
            release(ranks.sparkSession)
    trust, distrust = F.round(F.col("trust") * n, 6), F.round(F.col("distrust") * n, 6)
    verdict = F.when((F.col("b") > 0) | (distrust >= block_at), "blocked").when(trust >= trust_at, "trusted").otherwise("unknown")
    return ranks.select("host", "pages", trust.alias("trust"), distrust.alias("distrust"), verdict.alias("verdict"))


def filtered(pages: DataFrame, trusted: Sequence[str], blocked: Sequence[str], more_edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, trust, distrust, verdict) of every row of pages, as judge() has its host.

    A page without a host has null scores and the verdict "unknown". A null page_id stays null; repeated rows give a row each. A host with very many
    pages goes to them by broadcast. Other columns but url and html are ignored. An empty table gives an empty result.
    """
    verdicts = cut(judge(pages, trusted, blocked, more_edges=more_edges))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"))
    known = heavy_join(rows.where("host is not null"), verdicts, ["host"], "pages").select("page_id", "host", "trust", "distrust", "verdict")
    none = rows.where("host is null").select("page_id", "host", F.lit(None).cast("double").alias("trust"), F.lit(None).cast("double").alias("distrust"), F.lit("unknown").alias("verdict"))
    return known.unionByName(none)
