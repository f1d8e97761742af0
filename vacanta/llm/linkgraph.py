"""URL verdicts: rules, and trust and distrust propagated over the host graph.

A host is a trusted (blocked) seed if the rules allow (block) more than half of its
pages. Personalised PageRank carries trust from the trusted seeds along the links
between hosts, and distrust from the blocked seeds along the reversed links: who
links to blocked hosts is distrusted. Both run together as Spark joins on the
aggregated host edges, until the scores settle. A host whose distrust is over
``ratio`` times its trust is blocked, any other allowed; that verdict is used for
the pages on which no rule decides.

Defined cases: a url that is null or has no ``://`` has empty host and path, no rule
fits it, it takes no part in the graph and is allowed; a null html has no links;
links within a host and links to hosts without pages carry nothing; repeated rows
keep their rows (and count as pages); a graph without seeds or edges leaves the
seeds' own scores.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(after_scheme: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return _host(F.coalesce(rest, F.lit(""))), F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. ``rules`` is a
    short list of (verdict, host + path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # a longer one overrides
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from ``pages`` (host, html)."""
    target = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
    return (pages.where("host <> ''")
            .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(target), 1)).alias("dst"))
            .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6,
              max_rounds: int = 10_000) -> DataFrame:
    """(host, trust, distrust) from ``hosts`` (host, trusted, blocked: seed flags) and
    ``edges`` (src, dst, n). Mass that reaches a host without links onwards returns to
    the seeds. Rounds end when the scores change by less than ``tolerance`` in sum and no
    round reaches a host whose score was zero; it is an error if ``max_rounds`` do not do."""
    seeds = stored(hosts.select("host", F.col("trusted").cast("double").alias("t0"),
                                F.col("blocked").cast("double").alias("d0")), "seeds")
    total = seeds.agg(F.sum("t0").alias("t"), F.sum("d0").alias("d")).collect()[0]
    seeds = seeds.select("host", (F.col("t0") / (total["t"] or 1.0)).alias("t0"), (F.col("d0") / (total["d"] or 1.0)).alias("d0"))
    known = seeds.select("host")
    edges = edges.join(known.withColumnRenamed("host", "dst"), "dst", "left_semi")
    both = edges.select("src", "dst", "n", F.lit("t").alias("side")).union(
        edges.select(F.col("dst"), F.col("src"), F.col("n"), F.lit("d")))
    out = both.groupBy("side", "src").agg(F.sum("n").alias("all"))
    flow = stored(both.join(out, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "flow")

    scores = stored(seeds.select("host", "t0", "d0", F.col("t0").alias("t"), F.col("d0").alias("d")), "scores")
    if flow.limit(1).count() == 0:
        return scores.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))
    for _ in range(max_rounds):
        long = scores.select(F.col("host").alias("src"), F.explode(F.create_map(
            F.lit("t"), F.col("t"), F.lit("d"), F.col("d"))).alias("side", "score")).where("score > 0")
        moved = (long.join(flow, ["side", "src"]).groupBy(F.col("dst").alias("host"))
                 .agg(F.sum(F.when(F.col("side") == "t", F.col("score") * F.col("share")).otherwise(0.0)).alias("mt"),
                      F.sum(F.when(F.col("side") == "d", F.col("score") * F.col("share")).otherwise(0.0)).alias("md")))
        met = stored(scores.join(moved, "host", "left").na.fill(0.0, ["mt", "md"]), "moved")
        mass = met.agg(F.sum("mt").alias("t"), F.sum("md").alias("d")).collect()[0]
        # What the damping and the hosts without links took goes back to the seeds.
        back_t, back_d = 1 - damping * (mass["t"] or 0.0), 1 - damping * (mass["d"] or 0.0)
        met = met.select("host", "t0", "d0", F.col("t").alias("pt"), F.col("d").alias("pd"),
                         (damping * F.col("mt") + back_t * F.col("t0")).alias("t"),
                         (damping * F.col("md") + back_d * F.col("d0")).alias("d"))
        met = stored(met, "scores")
        change, reached = met.agg(
            F.sum(F.abs(F.col("t") - F.col("pt")) + F.abs(F.col("d") - F.col("pd"))),
            F.count_if(((F.col("pt") == 0) & (F.col("t") > 0)) | ((F.col("pd") == 0) & (F.col("d") > 0)))).collect()[0]
        scores = met.select("host", "t0", "d0", "t", "d")
        if (change or 0.0) < tolerance and not reached:
            break
    else:
        raise RuntimeError(f"scores not settled after {max_rounds} rounds")
    return scores.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], ratio: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``
    (page_id, url, html)."""
    host, path = split_url(F.col("url"))
    given = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled_pages = given.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    hosts = (ruled_pages.where("host <> ''").groupBy("host")
             .agg((2 * F.count_if(F.col("ruled") == "allow") > F.count("*")).alias("trusted"),
                  (2 * F.count_if(F.col("ruled") == "block") > F.count("*")).alias("blocked"))
             .select("host", F.col("trusted").cast("int"), F.col("blocked").cast("int")))
    found = propagate(hosts, host_edges(given))
    verdict = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when(
        F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return ruled_pages.join(found, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
