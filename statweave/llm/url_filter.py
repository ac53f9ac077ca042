"""URL filters by a tree of path templates, in DataFrame operations only.

Rules label what they fit. Per host, paths become a tree, level by level from the root: digits and long hexadecimal
segments are wildcards at once; under a node with many children, the rare ones become wildcards, by what most of their
pages are labelled; then children are ordered by their labels, and neighbours that a chi-squared test can't tell apart
are one branch. A whole path through the tree is a template. It is rejected if the share of blocked pages among its
labelled ones, smoothed towards its host's share among all pages, is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm.common import attach_group, materialise

#: (verdict, host, path) of the rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Levels of the tree; deeper segments are one wildcard.
LEVELS = 4
#: Children of a node that keep their names whatever their size; beyond, only those with this share of the pages do.
FAN_OUT = 20
#: 95 % quantile of chi-squared with two degrees of freedom.
CRITICAL = 5.991
#: Pages as good as seen already at the host's share, and the share above which a template is rejected.
SMOOTHING, REJECT = 4, 0.8
#: A template's parts are parted by what no path holds, as it would end it.
SEPARATOR, WILDCARD = "?", "#"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and where no :// is."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path) that fits, and its verdict; both null if none does."""
    name = verdict = None
    for decision, domain, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, domain + prefix) if name is None else name.when(fits, domain + prefix)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def general_path(path: Column) -> Column:
    """The path with wildcards for runs of digits and for segments of 8 or more hexadecimal digits and hyphens."""
    return F.regexp_replace(F.regexp_replace(path, "/[0-9a-fA-F-]{8,}(?=/|$)", f"/{WILDCARD}h"), "[0-9]+", f"{WILDCARD}n")


def labelled_paths(pages: DataFrame) -> DataFrame:
    """pages: host, path, label. host, general path, and how many pages are blocked, allowed and without a label (b, a, u)."""
    count = lambda what: F.coalesce(F.sum(what.cast("long")), F.lit(0)).cast("long")
    return pages.groupBy("host", general_path(F.col("path")).alias("general")).agg(count(F.col("label") == "block").alias("b"), count(F.col("label") == "allow").alias("a"), count(F.col("label").isNull()).alias("u"))


def _unlike(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Chi-squared of two rows of counts; columns without any count for nothing."""
    total = {k: left[k] + right[k] for k in "bau"}
    n, m = (sum((x[k] for k in "bau"), F.lit(0)).cast("double") for x in (left, right))
    out = F.lit(0.0)
    for k in "bau":
        for row, size in ((left, n), (right, m)):
            expected = total[k] * size / (n + m)
            out = out + F.when(total[k] == 0, 0.0).otherwise((row[k] - expected) * (row[k] - expected) / expected)
    return out


def branches(paths: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """One level of the tree. paths: host, node, segment, b, a, u. Returns host, node, segment, branch: the segment's own
    name, a wildcard, or the name of the first of the segments that it is merged with. A node's children are counted
    first; what goes through a window are at most fan_out children of a node and its wildcards."""
    n = F.col("b") + F.col("a") + F.col("u")
    children = paths.groupBy("host", "node", "segment").agg(*[F.sum(k).alias(k) for k in "bau"])
    nodes = children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("fan"), F.sum(n).alias("pages"))
    rare = (F.col("fan") > fan_out) & (n * fan_out < F.col("pages"))
    most = F.when(2 * F.col("b") > n, "b").when(2 * F.col("a") > n, "a").otherwise("u")
    named = materialise(
        children.join(nodes, ["host", "node"]).select("host", "node", "segment", F.when(rare, F.concat(F.lit(WILDCARD), most)).otherwise(F.col("segment")).alias("name"), "b", "a", "u"), "children"
    )
    sums = named.groupBy("host", "node", "name").agg(*[F.sum(k).alias(k) for k in "bau"])
    order = Window.partitionBy("host", "node").orderBy((F.col("b") / n).desc(), (F.col("a") / n).desc(), "name")
    before = {k: F.lag(k).over(order) for k in "bau"}
    apart = _unlike({k: F.col(f"{k}0") for k in "bau"}, {k: F.col(k) for k in "bau"}) > CRITICAL
    linked = sums.select("*", *[c.alias(f"{k}0") for k, c in before.items()]).withColumn("new", F.col("b0").isNull() | apart)
    linked = linked.withColumn("part", F.sum(F.col("new").cast("int")).over(order))
    merged = linked.select("host", "node", "name", F.min("name").over(Window.partitionBy("host", "node", "part")).alias("branch"))
    return named.select("host", "node", "segment", "name").join(merged, ["host", "node", "name"]).select("host", "node", "segment", "branch")


def templates(paths: DataFrame, levels: int = LEVELS, fan_out: int = FAN_OUT) -> DataFrame:
    """paths as of labelled_paths(). Adds template, for each of its rows, a level at a time."""
    parts = F.when(F.col("general") == "", F.array().cast("array<string>")).otherwise(F.split(F.substr(F.col("general"), F.lit(2)), "/"))
    cut = F.when(F.size(parts) > levels, F.concat(F.slice(parts, 1, levels), F.array(F.lit(WILDCARD)))).otherwise(parts)
    table = materialise(paths.select("*", F.lit("").alias("node"), cut.alias("parts")), "paths")
    for level in range(levels + 1):
        here = F.size("parts") > level
        rows = table.where(here).withColumn("segment", F.element_at("parts", level + 1))
        if rows.isEmpty():
            break
        key = F.struct("host", "node", "segment")
        groups = rows.groupBy("host", "node", "segment").agg(*[F.sum(k).alias(k) for k in "bau"], F.count(F.lit(1)).alias("rows"))
        groups = materialise(groups, "segments")
        named = groups.join(branches(groups, fan_out), ["host", "node", "segment"]).select(key.alias("key"), "branch", "rows")
        total = groups.agg(F.sum("rows")).first()[0]
        moved = attach_group(rows.withColumn("key", key), materialise(named, "branches"), "key", "rows", total)
        moved = moved.select("host", "general", "b", "a", "u", F.concat("node", F.lit(SEPARATOR), "branch").alias("node"), "parts")
        table = materialise(table.where(~here).select(moved.columns).unionByName(moved), "paths")
    return table.select("host", "general", "b", "a", "u", F.col("node").alias("template"))


def judged(paths: DataFrame) -> DataFrame:
    """paths as of templates(). Adds verdict, of the template, and pages, of the path."""
    n = F.col("b") + F.col("a") + F.col("u")
    hosts = paths.groupBy("host").agg(F.sum("b").alias("host_b"), F.sum(n).alias("host_n"))
    found = paths.groupBy("host", "template").agg(F.sum("b").alias("all_b"), F.sum("a").alias("all_a"))
    prior = (F.col("host_b") + 1) / (F.col("host_n") + 2)
    purity = (F.col("all_b") + SMOOTHING * prior) / (F.col("all_b") + F.col("all_a") + SMOOTHING)
    found = found.join(hosts, "host").select("host", "template", F.when(purity > REJECT, "block").otherwise("allow").alias("judged"))
    return paths.join(found, ["host", "template"]).select("host", "general", "template", "judged", n.alias("pages"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, levels: int = LEVELS, fan_out: int = FAN_OUT) -> DataFrame:
    """One row for each input row: page_id, host, path, rule (null if none fits), verdict (the rule's, else that of the
    path's template) and template.

    Of rules that fit a host or a parent domain of it and start the path, the longest counts; its verdict labels the
    page. Null URLs and those without :// have an empty host and path; as no rule fits, their template, the host's root,
    is judged like any other. Repeated rows each get a result and count each in the statistics; null ids stay; an empty
    table gives an empty result; other columns, whatever their names, are ignored. Without any rule nothing is labelled
    and all are allowed. Paths that start many pages of one host are broadcast with a proven bound, the rest joined by a
    shuffle of ids, hosts and paths.
    """
    host, path = url_parts(F.col(f"`{url_col}`"))
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, label = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), label.alias("label"))
    found = judged(templates(materialise(labelled_paths(parts), "labelled_paths"), levels, fan_out))
    found = materialise(found.select(F.struct("host", "general").alias("key"), "template", "judged", "pages"), "judged_paths")
    total = found.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    out = attach_group(parts.withColumn("key", F.struct("host", general_path(F.col("path")).alias("general"))), found, "key", "pages", total)
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", "judged").alias("verdict"), F.replace(F.col("template"), F.lit(SEPARATOR), F.lit("/")).alias("template"))


def oracle(levels: int = LEVELS, fan_out: int = FAN_OUT, rules=RULES) -> str:
    """DuckDB's SQL for url_verdicts over pages."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered) + " END"
    sums, n = "sum(b)::BIGINT AS b, sum(a)::BIGINT AS a, sum(u)::BIGINT AS u", "(b + a + u)"
    cell = lambda x, k, side: f"CASE WHEN {k} + {k}0 = 0 THEN 0 ELSE pow({x} - ({k} + {k}0) * {side}::DOUBLE / (n + n0), 2) / (({k} + {k}0) * {side}::DOUBLE / (n + n0)) END"
    chi = " + ".join(cell(f"{k}0", k, "n0") + " + " + cell(k, k, "n") for k in "bau")
    steps = []
    for i in range(levels + 1):
        steps.append(f"""
r{i} AS (SELECT *, parts[{i + 1}] AS segment FROM t{i} WHERE len(parts) > {i}),
c{i} AS (SELECT host, node, segment, {sums} FROM r{i} GROUP BY ALL),
f{i} AS (SELECT *, count(*) OVER w AS fan, sum({n}) OVER w AS pages FROM c{i} WINDOW w AS (PARTITION BY host, node)),
d{i} AS (SELECT *, CASE WHEN fan > {fan_out} AND {n} * {fan_out} < pages
                        THEN '{WILDCARD}' || CASE WHEN 2 * b > {n} THEN 'b' WHEN 2 * a > {n} THEN 'a' ELSE 'u' END ELSE segment END AS name FROM f{i}),
s{i} AS (SELECT *, {n} AS n FROM (SELECT host, node, name, {sums} FROM d{i} GROUP BY ALL)),
l{i} AS (SELECT *, lag(b) OVER w AS b0, lag(a) OVER w AS a0, lag(u) OVER w AS u0, lag(n) OVER w AS n0 FROM s{i}
         WINDOW w AS (PARTITION BY host, node ORDER BY b / n DESC, a / n DESC, name)),
p{i} AS (SELECT *, sum(CASE WHEN b0 IS NULL OR {chi} > {CRITICAL} THEN 1 ELSE 0 END) OVER (PARTITION BY host, node ORDER BY b / n DESC, a / n DESC, name) AS part FROM l{i}),
m{i} AS (SELECT host, node, name, min(name) OVER (PARTITION BY host, node, part) AS branch FROM p{i}),
t{i + 1} AS (SELECT host, general, b, a, u, node, parts FROM t{i} WHERE len(parts) <= {i}
    UNION ALL SELECT r.host, r.general, r.b, r.a, r.u, r.node || '{SEPARATOR}' || m.branch, r.parts
              FROM r{i} r JOIN d{i} d USING (host, node, segment) JOIN m{i} m ON m.host = d.host AND m.node = d.node AND m.name = d.name)""")
    return f"""
WITH h AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
g AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM h),
q AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS label,
             regexp_replace(array_to_string(list_transform(string_split(path, '/'), lambda x, i: CASE WHEN i > 1 AND regexp_full_match(x, '[0-9a-fA-F-]{{8,}}') THEN '{WILDCARD}h' ELSE x END), '/'), '[0-9]+', '{WILDCARD}n', 'g') AS general FROM g),
k AS (SELECT host, general, count(*) FILTER (label = 'block') AS b, count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label IS NULL) AS u FROM q GROUP BY ALL),
v AS (SELECT *, CASE WHEN general = '' THEN [] ELSE string_split(general[2:], '/') END AS whole FROM k),
t0 AS (SELECT host, general, b, a, u, '' AS node, CASE WHEN len(whole) > {levels} THEN list_append(whole[1:{levels}], '{WILDCARD}') ELSE whole END AS parts FROM v),
{",".join(steps)},
y AS (SELECT host, (sum(b) + 1)::DOUBLE / (sum({n}) + 2) AS prior FROM k GROUP BY host),
z AS (SELECT host, node, sum(b) AS b, sum(a) AS a FROM t{levels + 1} GROUP BY ALL),
o AS (SELECT host, node, CASE WHEN (b + {SMOOTHING} * prior) / (b + a + {SMOOTHING}) > {REJECT} THEN 'block' ELSE 'allow' END AS judged FROM z JOIN y USING (host))
SELECT q.page_id, q.host, q.path, q.rule, coalesce(q.label, o.judged) AS verdict, replace(t.node, '{SEPARATOR}', '/') AS template
FROM q JOIN t{levels + 1} t ON t.host = q.host AND t.general = q.general JOIN o ON o.host = t.host AND o.node = t.node
"""


ORACLE = oracle()
