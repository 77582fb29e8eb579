"""URL filter by propagation over the link graph of hosts.

Rules judge some pages at once. Hosts of allowed pages are seeds of trust, which follows links;
hosts of blocked pages are seeds of distrust, which goes against links, to those who link there.
Both spread as personalised PageRank, round by round as Spark joins, and every host is held against
a threshold. Amounts are whole numbers (millionths of a page), so results do not depend on the
order in which tasks add them up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import column, cut, prepare, union

# The rules as (verdict, host and path); a host stands for its subdomains too.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

UNIT = 1_000_000  # mass of one page
DAMPING = (17, 20)  # part of a host's mass that goes on in a round, as a fraction
ROUNDS = 20  # rounds at most; 0.85 ** 20 of the mass, 4 %, may still be on its way then
BLOCK_FROM = (1, 2)  # distrust per page from which a host is blocked, as a fraction
SALTS = 16  # parts in which the pages of one host meet the host's verdict
LONGEST_HOST = 253  # characters of a domain name; longer ones have no owners

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = "<[aA][ \\t\\r\\n\\f][^>]*?[hH][rR][eE][fF][ \\t\\r\\n\\f]*=[ \\t\\r\\n\\f]*[\"']?([^\"' \\t\\r\\n\\f>]+)"
TARGET = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)"
HOST, PATH = "://([^/?#]*)", "://[^/?#]*([^?#]*)"
ADDRESS = "(^|\\.)[0-9]+(:[0-9]*)?$"


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def longest_first(rules) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path) of every rule, longest first."""
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"a rule is allow or block, and a host with a path: {verdict} {rule}")
    parts = [(v, r, r[:r.index("/")], r[r.index("/"):]) for v, r in dict((r, (v, r)) for v, r in rules).values()]
    return sorted(parts, key=lambda p: (-len(p[1]), p[1]))


def fitting(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, or null. ``rules`` are as few as a plan may hold, some hundreds."""
    return F.coalesce(*[F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(r))
                        for _, r, h, p in longest_first(rules)], F.lit(None).cast("string"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts, (a, b), from (host, html). Relative links stay within."""
    found = pages.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.regexp_extract_all(
        "html", F.lit(LINK), F.lit(1))).alias("link"))
    return found.select("a", F.translate(F.regexp_extract("link", TARGET, 1), UPPER, LOWER).alias("b")).where(
        "b <> '' AND a <> b").distinct()


def owner_links(hosts: DataFrame) -> DataFrame:
    """Links both ways between every host and the domain it belongs to, up to names of two labels.

    Addresses of numbers and names beyond ``LONGEST_HOST`` have no owner.
    """
    named = hosts.where((F.length("host") <= LONGEST_HOST) & ~F.col("host").rlike(ADDRESS)).select(
        F.split("host", "\\.").alias("l")).where("size(l) > 2")
    steps = named.select(F.explode(F.expr(
        "transform(sequence(1, size(l) - 2), k -> named_struct('a', concat_ws('.', slice(l, k, size(l))), "
        "'b', concat_ws('.', slice(l, k + 1, size(l)))))")).alias("s")).select("s.a", "s.b")
    return union(steps, steps.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS,
              damping: tuple[int, int] = DAMPING) -> DataFrame:
    """Mass that reaches every host: (host, trust, distrust).

    ``links``: distinct (a, b); ``seeds``: (host, trust, distrust), one row a host. A round hands the
    damped part of a host's newly come mass on, in equal parts, trust to the hosts it links to and
    distrust to those that link to it; fractions of a unit get lost. The sum over all rounds is personalised
    PageRank divided by 1 - damping. Every round is written as a table. Rounds end early where nothing moves.
    """
    go, of = damping
    both = union(links.select(F.lit(0).alias("kind"), "a", "b"),
                 links.select(F.lit(1).alias("kind"), F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = cut(both.join(both.groupBy("kind", "a").agg(F.count("*").alias("n")), ["kind", "a"]))
    new = cut(union(*[seeds.select(F.lit(k).alias("kind"), "host", F.col(name).alias("mass"))
                      for k, name in enumerate(("trust", "distrust"))]).where("mass > 0"))
    come = [new]
    for _ in range(rounds):
        if new.isEmpty():
            break
        new = cut(new.withColumnRenamed("host", "a").join(arcs, ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg(
            F.sum(F.expr(f"mass * {go} DIV ({of} * n)")).alias("mass")).where("mass > 0"))
        come.append(new)
    total = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0).cast("long")).alias(name)
             for k, name in enumerate(("trust", "distrust"))]
    return union(*come).groupBy("host").agg(*total)


def filter_urls(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url",
                html_column: str = "html", rounds: int = ROUNDS, damping: tuple[int, int] = DAMPING,
                block_from: tuple[int, int] = BLOCK_FROM, owners: bool = True) -> DataFrame:
    """A row per page: id, host, path, rule, verdict, trust, distrust.

    The longest rule whose host is the url's or a domain above it, and whose path the url's path
    starts with, gives the verdict. The others' host decides: it is blocked where its distrust is
    at least ``block_from`` of its pages and greater than its trust, both counted in pages of ``UNIT``.
    A page linking to other hosts joins hosts; with ``owners`` so do domains and their subdomains.

    A null url or one without '://' has an empty host and path and no links; no rule fits it, and it is
    allowed. Null html has no links. Null and repeated ids keep a row each; so do equal rows. An
    empty table gives no rows. Whole pages are read; other columns are not.
    """
    prepare(pages.sparkSession)
    url = column(url_column).cast("string")
    read = pages.select(column(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        column(html_column).cast("string").alias("html")).withColumn(
        "rule", fitting(F.col("host"), F.col("path"), rules))
    verdict = {v: [r for w, r in rules if w == v] for v in ("allow", "block")}
    counted = cut(read.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"),
        *[(F.count_if(F.col("rule").isin(verdict[v])) * F.lit(UNIT)).alias(name)
          for v, name in (("allow", "trust"), ("block", "distrust"))]))
    links = cut(host_links(read))
    if owners:
        hosts = reduce(DataFrame.union, (counted.select("host"), links.select("a"), links.select("b"))).distinct()
        links = union(links, owner_links(hosts)).distinct()
    spread = propagate(links, counted, rounds, damping)
    low, of = block_from
    judged = counted.select("host", "pages").join(spread, "host").select(
        "host", "trust", "distrust",
        F.expr(f"distrust > trust AND distrust * {of} >= pages * {low * UNIT}").alias("blocked"))
    # one host may hold any share of the pages: they meet its verdict in parts
    parts = judged.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = read.drop("html").withColumn("part", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    return salted.join(parts, ["host", "part"], "left").select(
        "id", "host", "path", "rule",
        F.when(F.col("rule").isin(verdict["block"]), "block").when(F.col("rule").isNotNull(), "allow").when(
            F.col("blocked"), "block").otherwise("allow").alias("verdict"),
        *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("trust", "distrust")])


def oracle(rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL over the table ``pages``."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'"
                    for _, r, h, p in longest_first(RULES))
    lists = {v: ", ".join(quoted(r) for w, r in RULES if w == v) for v in ("allow", "block")}
    (go, of), (low, high) = DAMPING, BLOCK_FROM
    re_ = [quoted(x.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n").replace("\\f", "\f"))
           for x in (HOST, PATH, LINK, TARGET, ADDRESS)]
    steps = "".join(f""",
x{k + 1} AS MATERIALIZED (SELECT kind, b AS host, sum(mass * {go} // ({of} * n))::BIGINT AS mass
    FROM x{k} JOIN arcs USING (kind, host) GROUP BY kind, b HAVING sum(mass * {go} // ({of} * n)) > 0)""" for k in range(rounds))
    come = " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(rounds + 1))
    return f"""
WITH p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, {re_[0]}, 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, {re_[1]}, 1), '') AS path FROM pages),
r AS MATERIALIZED (SELECT *, CASE {fits} END AS rule FROM p),
counted AS (SELECT host, count(*) AS pages, count_if(rule IN ({lists['allow']})) * {UNIT} AS trust,
    count_if(rule IN ({lists['block']})) * {UNIT} AS distrust FROM r WHERE host <> '' GROUP BY host),
found AS (SELECT host, unnest(regexp_extract_all(html, {re_[2]}, 1)) AS link FROM r WHERE host <> ''),
links AS (SELECT DISTINCT host AS a, translate(regexp_extract(link, {re_[3]}, 1), '{UPPER}', '{LOWER}') AS b FROM found),
outward AS MATERIALIZED (SELECT a, b FROM links WHERE b <> '' AND a <> b),
labels_ AS (SELECT string_split(host, '.') AS l FROM (SELECT host FROM counted UNION SELECT a FROM outward UNION SELECT b FROM outward)
    WHERE length(host) <= {LONGEST_HOST} AND NOT regexp_matches(host, {re_[4]})),
steps AS (SELECT array_to_string(l[k:], '.') AS a, array_to_string(l[k + 1:], '.') AS b
    FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM labels_ WHERE len(l) > 2)),
edges AS MATERIALIZED (SELECT a, b FROM outward UNION SELECT a, b FROM steps UNION SELECT b, a FROM steps),
arcs AS MATERIALIZED (SELECT 0 AS kind, a AS host, b, count(*) OVER (PARTITION BY a) AS n FROM edges
    UNION ALL SELECT 1, b, a, count(*) OVER (PARTITION BY b) FROM edges),
x0 AS (SELECT 0 AS kind, host, trust AS mass FROM counted WHERE trust > 0
    UNION ALL SELECT 1, host, distrust FROM counted WHERE distrust > 0){steps},
spread AS (SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0)::BIGINT AS trust,
    coalesce(sum(mass) FILTER (kind = 1), 0)::BIGINT AS distrust FROM ({come}) GROUP BY host),
judged AS (SELECT host, s.trust, s.distrust, s.distrust > s.trust AND s.distrust * {high} >= pages * {low * UNIT} AS blocked
    FROM counted JOIN spread s USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ({lists['block']}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
    coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM r LEFT JOIN judged USING (host)"""
