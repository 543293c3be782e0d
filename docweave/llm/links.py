"""URL filter by link-graph propagation.

Host edges come from every absolute link, and every mail address, in the pages' HTML: the page's
host points to the named host, weighted by the number of such mentions; links within a host don't
count.  Trust starts at the trusted hosts and follows the edges (personalised PageRank); distrust
starts at the blocked hosts and follows them backwards, so that whoever links to a blocked host
shares its score.  Mass at hosts without further edges returns to the seeds: for personalised
PageRank that equals dropping it and scaling the scores to a sum of one, which is what is done.  Rounds
go on until the scores stand still to within ``TOLERANCE``, so chains and circles of any length count.

Seeds are hosts of the pages and of their links, chosen by rules that hold for any table: blocked are hosts
with one of the words of ``BLOCKED`` as a part of their name; trusted are, of the others, those below the
suffixes of public institutions (``INSTITUTION``), and those that hold at least one in ``LARGE`` of all pages.
Lists of names may be given instead.

Defined results: a host is rejected when it is a blocked seed, or its distrust is at least
``MIN_DISTRUST`` and above ``RATIO`` times its trust; hosts that neither reaches are kept; pages with a
null or unreadable URL have no host and are rejected; null and empty HTML has no links; repeated
rows count twice as mentions and give a row each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import drop_scratch, scratch

WORDS = "casino casinos pills viagra cialis spam porn xxx poker betting warez malware phishing payday replica"
BLOCKED = rf"(^|[.-])({WORDS.replace(' ', '|')})([.-]|$)"
INSTITUTION = r"\.(gov|edu|mil|int)(\.[a-z][a-z])?$|\.ac\.[a-z][a-z]$"
LARGE = 50
DAMPING = 0.85
#: Of the SQL, which can't loop: exact where no chain of links is longer.
ROUNDS = 12
#: The propagation ends when STEP rounds have changed the scores by no more than this in sum; all later rounds would change about as much again.
TOLERANCE, STEP = 1e-10, 4
RATIO = 1.0
MIN_DISTRUST = 1e-4
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
LINK = r"(?:(?:https?:)?//|@)([a-z0-9-]+(?:\.[a-z0-9-]+)+)"


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: the number of mentions of the host dst in pages of src."""
    host = F.regexp_extract(F.lower("url"), HOST, 1)
    links = F.regexp_extract_all(F.lower("html"), F.lit(LINK), 1)
    return pages.select(host.alias("src"), F.explode(links).alias("dst")).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def page_host() -> Column:
    """Null where the URL can't be read."""
    host = F.regexp_extract(F.lower("url"), HOST, 1)
    return F.when(host != "", host)


def seed_hosts(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (0 trusted, 1 blocked), host, by the rules."""
    own = pages.select(page_host().alias("host")).filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    total = pages.count()
    named = edges.select(F.col("dst").alias("host")).distinct().withColumn("pages", F.lit(0).cast("bigint"))
    hosts = own.union(named).groupBy("host").agg(F.max("pages").alias("pages"))
    kind = F.when(F.col("host").rlike(BLOCKED), 1).when(F.col("host").rlike(INSTITUTION) | (F.col("pages") * LARGE >= total), 0)
    return hosts.select(kind.alias("kind"), "host").filter("kind is not null")


def host_scores(pages: DataFrame, trusted: tuple | None = None, blocked: tuple | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, blocked of every host that either seeds reach.  Both propagations run as one: kind 0 forwards, kind 1 backwards."""
    spark = pages.sparkSession
    e = scratch(host_edges(pages), "edges")
    both = e.select(F.lit(0).alias("kind"), "src", "dst", "w").union(e.select(F.lit(1), F.col("dst"), F.col("src"), "w"))
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    both = scratch(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("total")).alias("share")), "shares")
    rule = seed_hosts(pages, e)
    given = [rule.filter(F.col("kind") == k) if own is None else spark.createDataFrame([(k, h) for h in sorted(set(own))], rule.schema) for k, own in enumerate((trusted, blocked))]
    seeds = scratch(given[0].union(given[1]), "seeds")
    number = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    seeds = seeds.select("kind", "host", F.when(F.col("kind") == 0, 1.0 / number.get(0, 1)).otherwise(1.0 / number.get(1, 1)).alias("r"))
    rank = last = seeds
    for i in itertools.count(1):
        at = rank.select(F.col("kind").alias("k"), F.col("host").alias("h"), "r")
        moved = both.join(at, (F.col("kind") == F.col("k")) & (F.col("src") == F.col("h"))).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("r") * DAMPING).alias("r"))
        rank = moved.union(seeds.select("kind", "host", F.col("r") * (1 - DAMPING))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % STEP == 0:
            rank = scratch(rank, "rank")
            change = rank.union(last.select("kind", "host", -F.col("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r")).agg(F.sum(F.abs("r"))).first()[0]
            if last is not seeds:
                drop_scratch(last)
            if (change or 0.0) <= tolerance:
                break
            last = rank
    total = {r["kind"]: r["t"] for r in rank.groupBy("kind").agg(F.sum("r").alias("t")).collect()}
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)) / F.lit(total.get(k) or 1.0)
    scores = rank.groupBy("host").agg(part(0).alias("trust"), part(1).alias("distrust"))
    return scores.join(seeds.filter("kind = 1").select(F.col("host").alias("_host")), F.col("host") == F.col("_host"), "left").select("host", "trust", "distrust", F.col("_host").isNotNull().alias("blocked"))


def url_filter(pages: DataFrame, trusted: tuple | None = None, blocked: tuple | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, trust, distrust, keep for every page."""
    scores = host_scores(pages.select("url", "html"), trusted, blocked, tolerance)
    df = pages.select("page_id", page_host().alias("host")).join(scores, "host", "left").withColumns({c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 9) for c in ("trust", "distrust")})
    bad = F.col("host").isNull() | F.coalesce("blocked", F.lit(False)) | ((F.col("distrust") >= MIN_DISTRUST) & (F.col("distrust") > RATIO * F.col("trust")))
    return df.select("page_id", "host", "trust", "distrust", (~bad).alias("keep"))


def _sql() -> str:
    rounds = "".join(
        f""", r{i + 1} as materialized (select kind, host, sum(r) as r from (select b.kind, b.dst as host, b.share * r.r * {DAMPING} as r from b join r{i} r on r.kind = b.kind and r.host = b.src
 union all select kind, host, r * (1 - {DAMPING}::double) from r0) group by kind, host)"""
        for i in range(ROUNDS)
    )
    return f"""
with p as (select page_id, nullif(regexp_extract(lower(url), '{HOST}', 1), '') as host, html from pages),
m as (select host as src, unnest(regexp_extract_all(lower(html), '{LINK}', 1)) as dst from p where host is not null),
e as materialized (select src, dst, count(*)::double as w from m where src <> dst group by src, dst),
a as (select 0 as kind, src, dst, w from e union all select 1, dst, src, w from e),
b as materialized (select kind, src, dst, w / sum(w) over (partition by kind, src) as share from a),
h as (select host, sum(n) as n from (select host, count(*) as n from p where host is not null group by host union all select distinct dst, 0 from e) group by host),
k as materialized (select host, case when regexp_matches(host, '{BLOCKED}') then 1 when regexp_matches(host, '{INSTITUTION}') or n * {LARGE} >= (select count(*) from pages) then 0 end as kind from h),
r0 as (select kind, host, 1.0e0 / count(*) over (partition by kind) as r from k where kind is not null){rounds},
t as (select kind, sum(r) as t from r{ROUNDS} group by kind),
s as (select host, sum(case when kind = 0 then r / t else 0 end) as trust, sum(case when kind = 1 then r / t else 0 end) as distrust from r{ROUNDS} join t using (kind) group by host),
f as (select p.page_id, p.host, round(coalesce(trust, 0), 9) as trust, round(coalesce(distrust, 0), 9) as distrust from p left join s on p.host = s.host)
select *, not (host is null or host in (select host from k where kind = 1) or (distrust >= {MIN_DISTRUST} and distrust > {RATIO} * trust)) as keep from f"""


SQL = _sql()
