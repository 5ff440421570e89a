"""URL filters by a tree of path templates, in DataFrame functions only.

Rules come first: a rule names a host, with all its subdomains, and the start of a
path; the longest that fits decides. What no rule decides is judged by templates.

Each host has a tree of path segments. Segments of digits are variable and become
``*`` (``*.html`` with an ending). A level at which a host has more than
``MOST_CHILDREN`` different segments below one parent is variable, too. A template is
the resulting path. Labels are pages on which a rule decided, or given ones: blocked is
bad. A node's labels are those of all paths below it.

Nodes are merged over all levels: a node whose share of bad labels doesn't differ
significantly from its parent's belongs to the parent's branch, so siblings that are
alike share one branch, and a node without labels, which nothing tells from its parent,
belongs to that of its nearest ancestor that has one of its own. A branch's labels are
those of the templates that end in it. A branch is rejected if its labels are bad to at
least ``REJECT``, after smoothing with ``PRIOR`` labels at the host's share, and there
are ``LEAST`` or more of them; so templates without labels are judged by the labelled
ones that they are merged with.

The tree is built on the distinct paths of a host with their label counts, after
partial aggregation; a page's row meets only the table of rejected paths. Tables are
joined, not broadcast, unless Spark measures that they are small. The tree has as many
levels as the longest path; every ``STEP`` levels it is stored, so that plans stay short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import fresh, stored

MOST_CHILDREN = 64
#: Levels after which the tree is stored.
STEP = 4
LEAST, PRIOR, REJECT, Z = 5, 4.0, 0.8, 1.96


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


PRODUCTION = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """A-Z only are lower-cased."""
    raw = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest last, so it is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    """Digits are variable."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.regexp_replace(s, r"^[0-9]+(?=$|\.[a-z]+$)", "*"))


def _generalised(paths: DataFrame) -> DataFrame:
    """Adds ``template`` to (host, segs, ...)."""
    out = paths.withColumn("template", F.lit(""))
    for level in range(paths.agg(F.max(F.size("segs"))).first()[0] or 0):
        seg = F.get("segs", F.lit(level))
        children = out.where(seg.isNotNull()).select("host", "template", seg.alias("seg")).distinct()
        wide = children.groupBy("host", "template").agg(F.count("*").alias("n")).where(F.col("n") > MOST_CHILDREN).select("host", "template", F.lit(True).alias("variable"))
        out = out.join(wide, ["host", "template"], "left")
        taken = F.when(seg.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("variable"), F.lit("*")).otherwise(seg)))
        out = out.withColumn("template", taken).drop("variable")
        if level % STEP == STEP - 1:
            out = stored(out, "levels")
    return out


def path_verdicts(paths: DataFrame) -> DataFrame:
    """(host, segs, template, branch, n_labels, purity, rejected) of (host, segs, n, k): labels and bad labels of each path."""
    tree = stored(_generalised(paths), "templates")
    counts = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    steps = F.split(F.substr("template", F.lit(2)), "/")
    # the path to each node that a template passes, the host's root ("") first
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda j: F.when(j == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, F.greatest(j, F.lit(1))), "/"))))
    counts = stored(counts.withColumn("nodes", F.when(F.col("template") == "", F.array(F.lit(""))).otherwise(above)), "templates")
    nodes = counts.select("host", "n", "k", F.posexplode("nodes").alias("level", "node"), F.expr("nodes").alias("nodes"))
    nodes = nodes.select("host", "node", "level", F.get("nodes", F.col("level") - 1).alias("parent"), "n", "k")
    nodes = nodes.groupBy("host", "node", "level", "parent").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    parents = nodes.select("host", F.col("node").alias("parent"), F.col("n").alias("pn"), F.col("k").alias("pk"))
    joined = nodes.join(parents, ["host", "parent"], "left")  # the parent of a node is unique; a root has none
    share = F.col("pk") / F.greatest("pn", F.lit(1))
    spread = F.sqrt(share * (1 - share) / F.greatest("n", F.lit(1)))
    alike = (F.col("n") == 0) | (F.abs(F.col("k") / F.greatest("n", F.lit(1)) - share) <= Z * spread + 1e-9)
    starts = joined.where(F.col("parent").isNull() | ~alike).select("host", "node", F.lit(True).alias("own"))
    passed = counts.select("host", "template", "n", "k", F.posexplode("nodes").alias("level", "node"))
    ends = passed.join(starts, ["host", "node"]).groupBy("host", "template").agg(F.max_by("node", "level").alias("branch"), F.first("n").alias("n"), F.first("k").alias("k"))
    hosts = counts.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    pooled = ends.groupBy("host", "branch").agg(F.sum("n").alias("n_labels"), F.sum("k").alias("n_bad")).join(hosts, "host")
    prior = F.col("hk") / F.greatest("hn", F.lit(1))
    purity = (F.col("n_bad") + PRIOR * prior) / (F.col("n_labels") + PRIOR)
    judged = pooled.select("host", "branch", "n_labels", purity.alias("purity"), ((F.col("n_labels") >= LEAST) & (purity >= REJECT)).alias("rejected"))
    judged = ends.select("host", "template", "branch").join(judged, ["host", "branch"])
    return tree.select("host", "segs", "template").join(judged, ["host", "template"])


def labelled(pages: DataFrame, rules=PRODUCTION, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, fit (rule and verdict, or null), segs, bad of every row."""
    key = fresh(pages, "_id")
    own = pages.select(F.col("page_id").alias(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("segs", _segments(F.col("path")))
    bad = F.when(F.col("fit").isNotNull(), F.col("fit.verdict") == "block")
    if labels is not None:
        own = own.join(labels.select(F.col("page_id").alias(key), F.col("bad").alias("given")), key, "left")
        bad = F.coalesce(bad, F.col("given"))
    return own.select(F.col(key).alias("page_id"), "host", "path", "fit", "segs", bad.alias("bad"))


def judge(pages: DataFrame, rules=PRODUCTION, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    labels: (page_id, bad) of further pages, each page once; a rule's verdict comes
    before them. Null urls and urls without ``://`` have an empty host and path and are
    judged like any other; repeated rows stay; an empty table gives no rows.
    """
    own = labelled(pages, rules, labels)
    paths = own.groupBy("host", "segs").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    rejected = path_verdicts(paths).where("rejected").select("host", "segs", F.lit(True).alias("rejected"))
    out = own.join(rejected, ["host", "segs"], "left")
    said = F.coalesce(F.col("fit.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), said.alias("verdict"))


def sql(rules=PRODUCTION, levels: int = 12) -> str:
    """``judge`` as SQL, for pages without further labels whose paths have at most ``levels`` segments."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(rules, key=lambda r: -len(r.name))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in longest) + " END"
    steps = []
    for k in range(levels):
        steps.append(f"c{k} AS (SELECT host, template, count(DISTINCT segs[{k + 1}]) AS kids FROM p{k} WHERE len(segs) > {k} GROUP BY host, template)")
        step = f"CASE WHEN len(segs) <= {k} THEN template ELSE template || '/' || CASE WHEN kids > {MOST_CHILDREN} THEN '*' ELSE segs[{k + 1}] END END AS template"
        steps.append(f"p{k + 1} AS (SELECT host, segs, n, k, {step} FROM p{k} LEFT JOIN c{k} USING (host, template))")
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), f AS (
  SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS said, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM h
), s AS (
  SELECT *, list_transform(parts, lambda x: regexp_replace(x, '^[0-9]+($|\\.[a-z]+$)', '*\\1')) AS segs FROM f
), p0 AS (
  SELECT host, segs, count(said) AS n, count(*) FILTER (said = 'block') AS k, '' AS template FROM s GROUP BY host, segs
), {", ".join(steps)}, tree AS (
  SELECT host, segs, n, k, template FROM p{levels}
), counts AS (
  SELECT host, template, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, string_split(substring(template, 2), '/') AS steps FROM tree GROUP BY host, template
), passed AS (
  SELECT host, template, n, k, level, CASE WHEN level = 0 THEN '' ELSE '/' || array_to_string(steps[1:level], '/') END AS node,
         CASE WHEN level = 0 THEN NULL WHEN level = 1 THEN '' ELSE '/' || array_to_string(steps[1:level - 1], '/') END AS parent
  FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS level FROM counts) x
), nodes AS (
  SELECT host, node, parent, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM passed GROUP BY host, node, parent
), shares AS (
  SELECT a.host, a.node, a.parent, a.n, a.k, CAST(b.k AS DOUBLE) / greatest(b.n, 1) AS share FROM nodes a LEFT JOIN nodes b ON a.host = b.host AND a.parent = b.node
), starts AS (
  SELECT host, node FROM shares WHERE parent IS NULL OR NOT (n = 0 OR abs(CAST(k AS DOUBLE) / greatest(n, 1) - share) <= {Z} * sqrt(share * (1 - share) / greatest(n, 1)) + 1e-9)
), ends AS (
  SELECT p.host, p.template, arg_max(p.node, p.level) AS branch, first(p.n) AS n, first(p.k) AS k FROM passed p JOIN starts s ON s.host = p.host AND s.node = p.node GROUP BY p.host, p.template
), hosts AS (
  SELECT host, CAST(sum(k) AS DOUBLE) / greatest(sum(n), 1) AS prior FROM counts GROUP BY host
), pooled AS (
  SELECT host, branch, sum(n) AS n, sum(k) AS k FROM ends GROUP BY host, branch
), rejected AS (
  SELECT e.host, e.template FROM ends e JOIN pooled q USING (host, branch) JOIN hosts USING (host) WHERE q.n >= {LEAST} AND (q.k + {PRIOR} * prior) / (q.n + {PRIOR}) >= {REJECT}
)
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.said, CASE WHEN r.template IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM s LEFT JOIN tree t ON t.host = s.host AND t.segs = s.segs LEFT JOIN rejected r ON r.host = t.host AND r.template = t.template
"""
