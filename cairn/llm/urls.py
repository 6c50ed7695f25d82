"""URL filter by a tree of path templates per host, with DataFrame operations only.

Host and path are cut from the url; the segments of the path spell a branch of the host's tree, as deep as the paths go.
1. A segment that looks variable (it holds a digit, or is longer than 24 characters) becomes ``*``, and a known file
ending stays. 2. Level by level from the host down, under each branch with at least ``fan`` different children, a child
with less than ``rare`` of its pages becomes ``*`` too, if it has under ``least`` labels or its labelled purity differs
from its parent's by no more than ``z`` standard errors: a section that its labels set apart keeps its name. 3. Siblings
whose purity does not differ so from their parent's are merged into one branch ``~`` of the template. 4. A template is
rejected if its smoothed share of bad pages, (bad + weight x prior) / (labelled + weight), reaches ``limit``; the prior is
the share over all labels.

All counts are partial aggregates of whole tables, joined back by equi-joins that adaptive execution can split, so a
host with most pages is no task of its own. Each level is a written table of one row per shape that still forks, so plans
stay short; a branch whose shapes all end alike needs no further level, and there are as many levels as paths fork. Rules
(host, path, verdict) come first: a rule fits its host and all its subdomains if the path starts with the rule's, and the
longest that fits decides.

Defined results: a null url or one without ``://`` has an empty host and path and is judged by the template of those;
null labels count as none; repeated pages count and are judged each; very long urls are cut and judged whole; with no
label at all the prior is 0 and nothing is rejected; equal rules take the verdict that sorts first; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written_for_later

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path as one text) that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(sorted(rules, key=lambda r: r[2], reverse=True), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape_of(host: Column, path: Column) -> Column:
    """Host and segments joined by slashes, variable segments as *; no host or segment holds a slash, and none is empty."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    ending = lambda x: F.regexp_extract(x, r"(\.[A-Za-z]{1,5})?$", 0)
    return F.concat_ws("/", host, F.transform(parts, lambda x: F.when(x.rlike("[0-9]") | (F.length(x) > 24), F.concat(F.lit("*"), ending(x))).otherwise(x)))


def templates(shapes: DataFrame, scratch: Scratch, fan: int = 12, rare: float = 0.05, least: int = 4, z: float = 1.96) -> DataFrame:
    """shapes (shape, n, labelled, bad) with the template that steps 2 and 3 give each."""

    def alike(l: str, b: str) -> Column:  # noqa: E741
        # |bad - labelled x share| against z standard errors, without a division by the branch's own count
        share = F.try_divide("_pb", "_pl")
        return F.pow(F.col(b) - F.col(l) * share, F.lit(2)) <= z * z * F.col(l) * share * (1 - share)

    host, level, done = F.substring_index("shape", "/", 1), 0, None
    live = scratch(shapes.select("shape", "n", "labelled", "bad", host.alias("branch"), host.alias("template")), "tree")
    while True:
        # element 1 is the host; what ends here is a child without a name
        now = live.withColumn("_c", F.coalesce(F.try_element_at(F.split("shape", "/"), F.lit(level + 2)), F.lit("")))
        child = now.groupBy("branch", "_c").agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"))
        parent = child.groupBy("branch").agg(F.count("*").alias("_kids"), F.sum("_n").alias("_all"), F.sum("_l").alias("_pl"), F.sum("_b").alias("_pb"))
        folds = (F.col("_kids") >= fan) & (F.col("_n") < rare * F.col("_all")) & (F.col("_c") != "") & ((F.col("_l") < least) | alike("_l", "_b"))
        named = scratch(child.join(parent, "branch").select("branch", "_c", "_l", "_b", "_pl", "_pb", F.when(folds, F.lit("*")).otherwise(F.col("_c")).alias("_t")), "children")
        twigs = named.groupBy("branch", "_t").agg(F.sum("_l").alias("_tl"), F.sum("_b").alias("_tb"), F.first("_pl").alias("_pl"), F.first("_pb").alias("_pb"))
        merges = (F.col("_twigs") > 1) & (F.col("_t") != "") & ((F.col("_tl") == 0) | alike("_tl", "_tb"))
        merged = twigs.join(twigs.groupBy("branch").agg(F.count("*").alias("_twigs")), "branch").select("branch", "_t", F.when(merges, F.lit("~")).otherwise(F.col("_t")).alias("_u"))
        told = named.select("branch", "_c", "_t").join(merged, ["branch", "_t"])
        below = now.join(told, ["branch", "_c"]).select("shape", "n", "labelled", "bad", F.concat_ws("/", "branch", "_t").alias("branch"), F.when(F.col("_t") == "", F.col("template")).otherwise(F.concat_ws("/", "template", "_u")).alias("template"), F.slice(F.split("shape", "/"), level + 3, 1 << 30).alias("_rest"))
        step = scratch(below, "tree")
        forks = step.groupBy("branch").agg(F.min("_rest").alias("_low"), F.max("_rest").alias("_high")).where("_low <> _high").select("branch")
        over = step.join(forks, "branch", "left_anti").select("shape", F.concat_ws("/", "template", "_rest").alias("template"), "labelled", "bad")
        done = over if done is None else done.unionByName(over)
        live = scratch(step.join(forks, "branch", "left_semi").drop("_rest"), "tree")
        if live.isEmpty():
            return done
        level += 1


def judged(pages: DataFrame, bad: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", weight: float = 4.0, limit: float = 0.5, **options) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, template. bad: (key, bad boolean), at most one row a key counts."""
    link, scratch = F.col(f"`{url}`").cast("string"), Scratch(pages.sparkSession)
    rows = pages.select(F.col(f"`{key}`").alias("_key"), host_of(link).alias("host"), path_of(link).alias("path"))
    rows = rows.withColumn("shape", shape_of(F.col("host"), F.col("path")))
    labels = bad.select(F.col(f"`{key}`").alias("_key"), F.col("bad")).where("bad is not null").groupBy("_key").agg(F.max("bad").alias("bad"))
    # labelled pages only are joined with their labels; all pages are counted where they lie
    counted = rows.groupBy("shape").agg(F.count("*").alias("n"))
    told = rows.join(labels, "_key").groupBy("shape").agg(F.count("*").alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    shapes = counted.join(told, "shape", "left").fillna(0, ["labelled", "bad"])
    tree = scratch(templates(shapes, scratch, **options), "templates")
    prior = labels.agg(F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0)).alias("_prior"))
    whole = tree.groupBy("template").agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b")).join(F.broadcast(prior))
    said = whole.select("template", F.when((F.col("_b") + weight * F.col("_prior")) / (F.col("_l") + weight) >= limit, F.lit("block")).otherwise(F.lit("allow")).alias("_said"))
    known = written_for_later(tree.select("shape", "template").join(said, "template"), "verdicts")
    scratch.drop()
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return rows.join(known, "shape").select(F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("_said")).alias("verdict"), "template")


def oracle(rules: list[tuple[str, str, str]], bad: str, depth: int = 6, fan: int = 12, rare: float = 0.05, least: int = 4, z: float = 1.96, weight: float = 4.0, limit: float = 0.5) -> str:
    """The SQL that judged must equal over pages (page_id, url) of at most depth segments; bad: a query of (page_id, bad)."""
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END"
    general = r"list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > 24 THEN '*' || regexp_extract(x, '(\.[A-Za-z]{1,5})?$', 0) ELSE x END)"
    alike = f"pow(b - l * (pb / nullif(pl, 0)), 2) <= {z * z} * l * (pb / nullif(pl, 0)) * (1 - (pb / nullif(pl, 0)))"
    with_ = [
        f"cut AS (SELECT page_id, translate(coalesce(regexp_extract({rest}, '^[^/?#]*', 0), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"seg AS (SELECT *, list_prepend(host, {general}) AS parts FROM cut)",
        f"lab AS (SELECT page_id, bool_or(bad) AS bad FROM ({bad}) WHERE bad IS NOT NULL GROUP BY page_id)",
        "tree0 AS MATERIALIZED (SELECT parts, count(*) AS n, count(lab.bad) AS labelled, coalesce(sum(lab.bad::INT), 0) AS bad, parts[1] AS branch, parts[1] AS template FROM seg LEFT JOIN lab USING (page_id) GROUP BY parts)",
    ]
    for d in range(depth + 1):
        with_ += [
            f"c{d} AS MATERIALIZED (SELECT branch, coalesce(parts[{d + 2}], '') AS c, sum(n) AS k, sum(labelled) AS l, sum(bad) AS b FROM tree{d} GROUP BY ALL)",
            f"p{d} AS MATERIALIZED (SELECT branch, count(*) AS kids, sum(k) AS total, sum(l) AS pl, sum(b) AS pb FROM c{d} GROUP BY ALL)",
            f"m{d} AS MATERIALIZED (SELECT *, CASE WHEN kids >= {fan} AND k < {rare} * total AND c <> '' AND (l < {least} OR {alike}) THEN '*' ELSE c END AS t FROM c{d} JOIN p{d} USING (branch))",
            f"g{d} AS MATERIALIZED (SELECT branch, t, sum(l) AS l, sum(b) AS b, any_value(pl) AS pl, any_value(pb) AS pb FROM m{d} GROUP BY branch, t)",
            f"u{d} AS MATERIALIZED (SELECT branch, t, CASE WHEN twigs > 1 AND t <> '' AND (l = 0 OR {alike}) THEN '~' ELSE t END AS u FROM g{d} JOIN (SELECT branch, count(*) AS twigs FROM g{d} GROUP BY branch) USING (branch))",
            f"tree{d + 1} AS MATERIALIZED (SELECT parts, n, labelled, bad, branch || '/' || t AS branch, CASE WHEN t = '' THEN template ELSE template || '/' || u END AS template FROM tree{d} JOIN (SELECT branch, c, t, u FROM m{d} JOIN u{d} USING (branch, t)) x USING (branch) WHERE x.c = coalesce(parts[{d + 2}], ''))",
        ]
    prior = "(SELECT coalesce(avg(bad::INT), 0) FROM lab)"
    with_.append(f"said AS (SELECT template, CASE WHEN (sum(bad) + {weight} * {prior}) / (sum(labelled) + {weight}) >= {limit} THEN 'block' ELSE 'allow' END AS verdict FROM tree{depth + 1} GROUP BY template)")
    ordered = sorted(sorted(rules, key=lambda r: r[2]), key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " ELSE said.verdict END"
    return f"WITH {', '.join(with_)} SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, template FROM seg JOIN tree{depth + 1} USING (parts) JOIN said USING (template)"
