"""URL verdicts from rules and from trust spread over the link graph.

A short list of rules judges the urls that they fit.  For the rest, the pages
that rules allow or block seed two personalised PageRanks over host edges: trust
follows links from allowed hosts, distrust follows them backwards from blocked
ones (a host that links to bad hosts is suspect).  Edges are links between
hosts, counted, and one edge each way between a host and its parent domain.
Hosts that are only linked to and parent domains are nodes without pages: they
pass ranks on and are never judged; each different linked url of such a host
that a rule fits is one seed page of it.  A name of one label (``net``) is a
parent only if it has pages; IP addresses and names over 253 characters have no
parent.  Mass at a host without a way on goes back to the seeds, so each rank keeps
the mass of its seeds (counted in pages) and trust and distrust are on one scale.
A host's expected share of bad pages is (distrust mass minus trust mass) over its
pages; from ``BLOCK_SHARE`` on it is blocked.

The ranks are iterated until a round changes them by no more than ``TOLERANCE`` of
the seeds' mass, summed over all hosts: about ln(TOLERANCE) / ln(DAMPING) rounds
at most, whatever the graph.  Mass that goes back to the seeds only scales the
result, so it is settled once, at the end.

Pages are aggregated to hosts before anything is joined, so a host with a third
of all pages is one row; ranks are written to the shared folder every few rounds.

Edge cases: a null url or one without ``://`` has empty host and path, is no
rule's, and belongs to the host ``''``, which takes no part in the graph and is
allowed; null html has no links; repeated rows count as pages of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.common import ascii_lower, hinted, stored

#: (verdict, host, path): fixed production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Summed change of a round, as a share of the seeds' mass, that ends the iteration; rounds between two writes.
TOLERANCE, PER_WRITE = 1e-5, 3
BLOCK_SHARE = 0.5
_HREF = r"""(?i)\shref\s*=\s*["']?((?<=["'])[^"']*(?=["'])|(?<!["'])[^\s>"'][^\s>]*)"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict; of the rules that fit, the longest wins."""
    p = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return p.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_links(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(src, dst, url, kind, w): links between different hosts; url (no scheme, no fragment) and kind only where a rule fits the link."""
    links = pages.select(F.col("host").alias("src"), F.explode_outer(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("to"))
    links = ruled(links.select("src", F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")).alias("url")), rules)
    links = links.where("host <> '' and src <> '' and src <> host")
    rest = F.concat("host", F.regexp_extract(_after(F.col("url")), r"^[^/?#]*([^#]*)", 1))
    return links.groupBy("src", F.col("host").alias("dst"), F.when(F.col("rule_verdict").isNotNull(), rest).alias("url"),
                         F.col("rule_verdict").alias("kind")).agg(F.count(F.lit(1)).alias("w"))


def host_edges(pages: DataFrame, hosts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(src, dst, w): links between different hosts, and edges between a host and its parent domain, with or without pages."""
    links = (host_links(pages) if links is None else links).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    names = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    parts = names.where((F.length("host") <= 253) & ~F.col("host").rlike(r"^[0-9.]+(:[0-9]*)?$")).select(F.split("host", r"\.").alias("p")).where("size(p) > 1")
    up = parts.select("p", F.explode(F.expr("sequence(1, size(p) - 1)")).alias("i")).select(
        F.expr("array_join(slice(p, i, size(p)), '.')").alias("src"), F.expr("array_join(slice(p, i + 1, size(p)), '.')").alias("dst")).distinct()
    single = ~F.col("dst").rlike(r"[^.]\.[^.]")
    known = hosts.select(F.col("host").alias("dst"))
    up = up.where("src <> '' and dst <> ''")
    up = up.where(~single).unionByName(up.where(single).join(known, "dst", "left_semi").select("src", "dst"))
    up = up.select("src", "dst", F.lit(1).cast("long").alias("w"))
    both = links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def nodes(hosts: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """``hosts`` and, with 0 pages, every other end of an edge, seeded with the different linked urls that rules fit."""
    seeds = links.where("kind is not null").select(F.col("dst").alias("host"), "url", "kind").distinct().groupBy("host").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).cast("double").alias(n) for k, n in (("allow", "seed_good"), ("block", "seed_bad"))))
    more = edges.select(F.col("dst").alias("host")).unionByName(edges.select(F.col("src").alias("host"))).distinct().join(hosts, "host", "left_anti")
    return hosts.unionByName(more.join(seeds, "host", "left").select(
        "host", F.lit(0).cast("long").alias("pages"), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in ("seed_good", "seed_bad"))))


def propagate(hosts: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, good, bad): personalised ranks in seed pages.  ``hosts``: host, seed_good, seed_bad; ``edges``: src, dst, w."""
    out_w = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    in_w = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    # trust goes along an edge, distrust back
    ways = F.explode(F.array(F.struct(F.lit("good").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") / F.col("out_w")).alias("part")),
                             F.struct(F.lit("bad").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("w") / F.col("in_w")).alias("part"))))
    e = stored(edges.join(out_w, "src").join(in_w, "dst").select(ways.alias("e")).select("e.*"), "host_edges")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"seed_{k}").alias("seed")) for k in ("good", "bad")]))
    seeds = stored(hosts.select("host", kinds.alias("s")).select("host", "s.kind", "s.seed").where("seed <> 0"), "host_seeds")
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    source = seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("v"))
    way = hinted(e)
    rank = seeds.select("host", "kind", F.col("seed").alias("v"))
    while total:
        for _ in range(PER_WRITE):
            before = rank
            moved = way.join(before.withColumnRenamed("host", "a"), ["a", "kind"]).select(
                F.col("b").alias("host"), "kind", (F.col("v") * F.col("part") * damping).alias("v"))
            rank = moved.unionByName(source).groupBy("host", "kind").agg(F.sum("v").alias("v"))
        both = rank.withColumn("u", F.lit(0.0)).unionByName(before.select("host", "kind", F.lit(0.0).alias("v"), F.col("v").alias("u")))
        both = stored(both.groupBy("host", "kind").agg(F.sum("v").alias("v"), F.sum("u").alias("u")), "host_ranks")
        change = both.agg(F.sum(F.abs(F.col("v") - F.col("u")))).first()[0] or 0.0
        rank = both.select("host", "kind", "v")
        if change <= tolerance * total:
            break
    mass = {r["kind"]: r["m"] for r in rank.groupBy("kind").agg(F.sum("v").alias("m")).collect()}
    own = {r["kind"]: r["m"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("m")).collect()}
    value = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("v"))), F.lit(0.0)) * (own[k] / mass[k] if mass.get(k) else 0.0)
    got = rank.groupBy("host").agg(value("good").alias("good"), value("bad").alias("bad"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return hosts.select("host").join(got, "host", "left").select("host", zero("good"), zero("bad"))


def blocked_hosts(pages: DataFrame) -> DataFrame:
    """(host, bad_share) of the hosts that the method blocks; ``pages`` as ``ruled`` returns them."""
    hosts = stored(pages.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("rule_verdict") == "allow", 1)).cast("double").alias("seed_good"),
        F.count(F.when(F.col("rule_verdict") == "block", 1)).cast("double").alias("seed_bad")), "hosts")
    links = stored(host_links(pages), "host_links")
    edges = stored(host_edges(pages, hosts.select("host"), links), "host_graph")
    ranks = propagate(stored(nodes(hosts, links, edges), "host_nodes"), edges)
    share = F.round((F.col("bad") - F.col("good")) / F.col("pages"), 9)
    # ``hosts`` has no node without pages, so none is judged.
    return hosts.join(ranks, "host").select("host", share.alias("bad_share")).where(F.col("bad_share") >= BLOCK_SHARE)


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page row."""
    p = ruled(pages.select("page_id", "url", "html"))
    bad = stored(blocked_hosts(p), "blocked_hosts").select(F.col("host").alias("bad_host"))
    judged = p.select("page_id", "host", "path", "rule", "rule_verdict").join(hinted(bad), F.col("host") == F.col("bad_host"), "left")
    method = F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))
