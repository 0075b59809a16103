"""URL filter: host rules, then link-graph propagation for what no rule judges.

Rules name a host and a path prefix; a rule fits its host and all subdomains
when the url's path starts with the rule's, and the longest (host, then path)
wins.  Urls without a fitting rule get their host's verdict, from two
personalised PageRanks over host edges:

* trust flows along edges from hosts whose pages the rules allow,
* distrust flows along reversed edges from hosts whose pages the rules block.

A host's seed weight is the share of its pages that rules allow (or block), so
a rule on one section of a host does not condemn the rest of it.  A host is
blocked when its distrust exceeds its trust by more than ``margin`` (both on
the scale of one fully seeded host).

Edges: hyperlinks (absolute or protocol-relative href / src) between different
hosts, weighted by the number of pages that link, and the ties of the host
hierarchy (a host and its parent domain, both ways, weight 1), down to two
labels.  Edges, ranks and seeds stay in Spark; an iteration is one join on the
source host and one pre-aggregated sum, ``ROUNDS_PER_WRITE`` of them a job whose
ranks are written to the shared checkpoint folder.  It goes on until no score can
still move by ``TOLERANCE``; ``iterations`` stops after a number of rounds.

Defined cases: a null url, or one without ``://``, has empty host and path and
is allowed (no host, no evidence); null html has no links; repeated rows count
as pages of their own for seeds, once per distinct page_id and link for edges;
empty tables give empty results; input columns named like a result column give
way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrad.llm import text as X
from cellgrad.session import materialize

# The production rule list (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DAMPING = 0.85
ROUNDS_PER_WRITE = 4
# How far a score may be from the converged one (1: a fully seeded host).
TOLERANCE = 1e-5
MARGIN = 0.5
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased.
    Path: then up to ? # or the end.  Both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    tail = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = X.lower_ascii(F.regexp_extract(tail, r"\A([^/?#]*)", 1))
    path = F.regexp_extract(tail, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The winning rule as ``host + path``, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES,
           url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict ``_verdict``."""
    held = X.Held(pages)
    host, path = host_path(held(url_col))
    df = held.df.withColumn("_host", host).withColumn("_path", path)
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    return df.select(*held.back({}, {"host": F.col("_host"), "path": F.col("_path"), "rule": name,
                                     "_verdict": verdict}))


def host_edges(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(src, dst, weight): links between hosts and host-hierarchy ties."""
    links = (pages.where(F.col("host") != "")
             .select("host", id_col, F.explode(F.array_distinct(
                 F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1))).alias("_to"))
             .select("host", F.col(id_col).alias("_page"),
                     X.lower_ascii(F.regexp_replace("_to", r"\A.*@|:\d+\z", "")).alias("_to"))
             .where((F.col("_to") != "") & (F.col("_to") != F.col("host"))).distinct()
             .groupBy("host", "_to").agg(F.count("*").cast("double").alias("_n"))
             .select(F.col("host").alias("src"), F.col("_to").alias("dst"), F.col("_n").alias("weight")))
    hosts = pages.select("host").where(F.col("host") != "").distinct()
    ends = hosts.unionByName(links.select(F.col("dst").alias("host"))).distinct()
    # a.b.c.d -> b.c.d -> c.d: every proper suffix of two labels or more.
    labels = F.split("host", r"\.")
    chain = ends.select(F.explode(F.when(F.size(labels) > 2, F.transform(
        F.sequence(F.lit(1), F.size(labels) - 2),
        lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("src"),
                           F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("dst"))))).alias("e"))
    ties = chain.select("e.src", "e.dst").distinct()
    both = ties.unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (links.unionByName(both.withColumn("weight", F.lit(1.0)))
            .groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING,
              iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of every kind at once.

    ``edges``: (kind, src, dst, weight); ``seeds``: (kind, host, seed).  The
    rank of a host is (1 - damping) * seed + damping * what its in-edges bring;
    rank that reaches a host without out-edges stays there unspent.  Seeds are
    not normalised, so one fully seeded host alone ranks 1 - damping.

    Until converged: ranks only grow from round to round and a round hands on at
    most ``damping`` times the last one's growth, so all that is still to come to
    any host is bounded by the growth of the sum of ranks over the last rounds,
    the one number the driver reads per job."""
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("_total"))
    step = materialize(edges.join(out, ["kind", "src"])
                       .select("kind", "src", "dst", (F.col("weight") / F.col("_total")).alias("p")), "host-edges")
    seeds = materialize(seeds.where(F.col("seed") > 0), "host-seeds")
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank, left, before = base, iterations, 0.0
    while left is None or left > 0:
        rounds = ROUNDS_PER_WRITE if left is None else min(left, ROUNDS_PER_WRITE)
        for _ in range(rounds):
            moved = (rank.withColumnRenamed("host", "src").join(step, ["kind", "src"])
                     .select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p") * damping).alias("rank")))
            rank = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = materialize(rank, "host-ranks")
        if left is not None:
            left -= rounds
            continue
        now = rank.agg(F.sum("rank")).first()[0] or 0.0
        # Each later job adds at most damping^rounds of what this one has added.
        shrink = damping ** rounds
        if (now - before) * shrink / (1 - shrink) <= tolerance * (1 - damping):
            break
        before = now
    return rank


def host_scores(pages: DataFrame, html_col: str = "html", id_col: str = "page_id",
                damping: float = DAMPING, iterations: int | None = None) -> DataFrame:
    """(host, trust, distrust) of every host reached, from ``judged`` pages."""
    edges = materialize(host_edges(pages, html_col, id_col), "host-links")
    seeds = (pages.where(F.col("host") != "").groupBy("host")
             .agg(F.avg((F.coalesce(F.col("_verdict"), F.lit("")) == "allow").cast("double")).alias("_t"),
                  F.avg((F.coalesce(F.col("_verdict"), F.lit("")) == "block").cast("double")).alias("_d")))
    kinds = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    starts = seeds.select(F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), "host", F.col("_t").alias("seed")),
        F.struct(F.lit(1).alias("kind"), "host", F.col("_d").alias("seed")))).alias("s")).select("s.*")
    rank = propagate(kinds, starts, damping, iterations)
    scale = 1.0 / (1 - damping)
    at = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)) * scale
    return rank.groupBy("host").agg(at(0).alias("trust"), at(1).alias("distrust"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url",
               html_col: str = "html", id_col: str = "page_id", margin: float = MARGIN,
               damping: float = DAMPING, iterations: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    pages = judged(pages, rules, url_col)
    scores = host_scores(pages, html_col, id_col, damping, iterations)
    bad = materialize(scores.where(F.round(F.col("distrust") - F.col("trust"), 9) > margin)
                      .select("host", F.lit(True).alias("_bad")), "blocked-hosts")
    verdict = F.coalesce(F.col("_verdict"), F.when(F.col("_bad"), F.lit("block")), F.lit("allow"))
    cols = [c for c in pages.columns if c not in ("_verdict", "verdict")]
    return pages.join(bad, "host", "left").select(*cols, verdict.alias("verdict"))
