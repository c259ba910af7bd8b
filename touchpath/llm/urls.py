"""URL filters: rules by host and path, and propagation over the link graph where no rule fits.

Trust flows along links from hosts that the rules only allow, distrust against links from hosts that they only block
(who links to a blocked host is suspect). Both are personalised PageRanks of the host graph.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpath.session import cut_lineage

#: The host of an absolute or protocol-relative link.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^"'\s>/?#]+)"""


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlOptions:
    rules: tuple[Rule, ...] = (
        Rule("allow", "org"),
        Rule("block", "example.org", "/es/"),
        Rule("block", "example.org", "/en/1"),
        Rule("allow", "com", "/fr/"),
        Rule("block", "com", "/de/"),
    )
    damping: float = 0.85
    tolerance: float = 1e-6  # of the summed change of all scores in a round; each kind has a mass of at most 1
    limit: float = 0.5  # blocked above this share of distrust


OPTIONS = UrlOptions()


def _lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host from the first ``://`` to the path, query or fragment, A-Z lowered; path up to query or fragment.

    Both are empty for null and for a text without ``://``.
    """
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), path


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, else null; ties go to the earlier rule."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def host_edges(judged: DataFrame) -> DataFrame:
    """Distinct links ``src``, ``dst`` between different hosts, from the ``html`` of pages with a ``host``."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), _lower))
    links = judged.where("host <> ''").select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
    return links.where("src <> dst and dst <> ''").distinct()


def host_scores(edges: DataFrame, seeds: DataFrame, options: UrlOptions = OPTIONS) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of every host that mass reaches, however far.

    ``seeds`` has ``kind`` (trust or distrust) and ``host``, each once. A walk that finds no way on ends there. Rounds go on
    until one reaches no new host and changes all scores together by less than ``tolerance``; two numbers a round meet on
    the driver.
    """
    edges = cut_lineage(edges)
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    degrees = cut_lineage(ways.groupBy("kind", "src").agg(F.count("*").alias("ways")))
    arcs = cut_lineage(ways.join(degrees, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.lit(options.damping) / F.col("ways")).alias("share")))
    totals = seeds.groupBy("kind").agg(F.count("*").alias("n"))  # two rows
    start = cut_lineage(seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.lit(1.0) / F.col("n")).alias("score")))
    home = start.select("kind", "host", (F.col("score") * (1 - options.damping)).alias("score"), F.lit(0.0).alias("before"))
    state = start
    while True:
        moved = state.join(arcs, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"), F.lit(0.0).alias("before"))
        kept = state.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
        found = moved.union(home).union(kept).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before"))
        found = cut_lineage(found)
        change, new = found.agg(F.sum(F.abs(F.col("score") - F.col("before"))), F.count_if(F.col("before") == 0)).first()
        state = found.drop("before")
        if not new and (change is None or change < options.tolerance):
            break

    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)

    return state.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame, options: UrlOptions = OPTIONS) -> DataFrame:
    """One row per row of ``pages`` (``page_id``, ``url``, ``html``): ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    The longest fitting rule decides. Else the page's host decides: it is blocked if distrust makes up more than ``limit``
    of its score, and allowed if less, or if nothing reached it. A host is a seed of trust if rules allow pages of it
    and block none, of distrust the other way round. Null urls and urls without ``://`` have no host and are allowed;
    null html has no links; repeated rows are judged alike and links count once; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    judged = named.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), options.rules))
    counts = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("fit.verdict") == "allow").alias("allowed"), F.count_if(F.col("fit.verdict") == "block").alias("blocked"))
    kind = F.when((F.col("allowed") > 0) & (F.col("blocked") == 0), "trust").when((F.col("blocked") > 0) & (F.col("allowed") == 0), "distrust")
    seeds = cut_lineage(counts.select(kind.alias("kind"), "host").where("kind is not null"))
    scores = host_scores(host_edges(judged), seeds, options)
    suspects = cut_lineage(scores.where(F.col("distrust") > options.limit * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("_suspect")))
    verdict = F.coalesce("fit.verdict", "_suspect", F.lit("allow"))
    return judged.drop("html").join(suspects, "host", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def oracle_sql(options: UrlOptions = OPTIONS) -> str:
    """The same for DuckDB, as a recursion with the same end."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    quoted = LINK.replace("'", "''")
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in options.rules)
    steps = f"""home AS MATERIALIZED (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS score FROM seeds),
    state(round, kind, host, score, moving) AS (
      SELECT 0, kind, host, score, true FROM home
      UNION ALL
      SELECT round, kind, host, score, bool_or(before = 0) OVER () OR sum(abs(score - before)) OVER () >= {options.tolerance!r} FROM (
        SELECT max(round) + 1 AS round, kind, host, sum(score) AS score, sum(before) AS before FROM (
          SELECT s.round, s.kind, a.dst AS host, s.score * a.share AS score, 0.0::DOUBLE AS before FROM state s JOIN arcs a USING (kind, host) WHERE s.moving
          UNION ALL SELECT s.round, s.kind, s.host, h.score * {1 - options.damping!r}::DOUBLE, 0.0 FROM state s JOIN home h USING (kind, host) WHERE s.moving
          UNION ALL SELECT s.round, s.kind, s.host, 0.0, s.score FROM state s WHERE s.moving
        ) GROUP BY kind, host))"""
    return f"""
    WITH RECURSIVE cut AS (
      SELECT row_number() OVER () AS row, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), named AS MATERIALIZED (
      SELECT row, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    ), fitting AS (
      SELECT row, max_by(verdict, length(rule_host || rule_path)) AS rule_verdict, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule
      FROM named JOIN (VALUES {rules}) r(verdict, rule_host, rule_path)
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row
    ), judged AS MATERIALIZED (SELECT * FROM named LEFT JOIN fitting USING (row)),
    seeds AS (
      SELECT CASE WHEN bool_and(rule_verdict = 'allow') THEN 'trust' ELSE 'distrust' END AS kind, host
      FROM judged WHERE host <> '' AND rule IS NOT NULL GROUP BY host HAVING count(DISTINCT rule_verdict) = 1
    ), edges AS (
      SELECT DISTINCT src, dst FROM (SELECT host AS src, unnest(list_transform(regexp_extract_all(html, '{quoted}', 1), lambda x: translate(x, '{upper}', '{lower}'))) AS dst
        FROM judged WHERE host <> '') WHERE src <> dst AND dst <> ''
    ), ways AS (SELECT 'trust' AS kind, src AS host, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges
    ), arcs AS MATERIALIZED (SELECT kind, host, dst, {options.damping!r}::DOUBLE / count(*) OVER (PARTITION BY kind, host) AS share FROM ways
    ), {steps}, suspects AS (
      SELECT host FROM state WHERE round = (SELECT max(round) FROM state) GROUP BY host
      HAVING coalesce(sum(score) FILTER (kind = 'distrust'), 0) > {options.limit!r} * sum(score)
    )
    SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM suspects) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
    """
