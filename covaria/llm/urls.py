"""URL filters: rules, and per host a tree of path templates judged by their labelled purity.

Segments that vary (they hold a digit, or are very long) become wildcards at once, keeping their
extension. Then, level by level, a child of a node stays itself if a
two-proportion z-test tells its share of bad pages from that of its siblings; where a node's segment
varies, that is where it has more different children than each of them has pages on average, the other
children become one wildcard. What is left are the templates of a host. Siblings, the templates of one parent, are
merged where their shares of bad pages don't differ: one that a two-proportion z-test tells from the
others of its parent stays alone, the rest are counted together. A template is rejected if its
share of bad pages among labelled ones, smoothed towards the share of all pages (or half of ``PURE``
where that is less, so that no template is rejected for what others are), is at least ``PURE``.

When pages are judged, a node whose subtree has too few bad pages for any branch to be rejected (``FEWEST``)
is left as it is, and where all templates of a node go on alike they are followed to where they part, so that the rounds
of the loop are the levels at which rejectable templates part, however long paths are.

Counting by host and first template precedes every other step, so a host with a third of all
pages is a few counted rows when the tree is built.

Defined cases: a null url, or one without ``://``, has an empty host and path; pages without a label
count for the tree but not for purity; without any label nothing is rejected; null ids and repeated
rows are judged like others; an empty table gives no rows; other columns stay, whatever their names, and
host, path, rule and verdict replace columns of the same name. A page's label is that of the document
whose id is the first segment of the path that is a number, an extension aside (a year or a day in the
path is such a number); numbers that no 64 bits hold, and parts of longer words and numbers, name none.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

Z, PRIOR, PURE = 1.96, 10.0, 0.5
#: Bad pages without which no branch is as pure, even if it has no others and the usual share is as large as it may count.
FEWEST = PRIOR * (PURE - PURE / 2) / (1 - PURE)
#: Levels of the tree in the SQL only, which is right for tables whose paths have no more segments.
DEPTH = 8
#: The number that names a document.
NAMED = r"/([0-9]+)(?:[/.]|$)"
#: A child that holds digits and was told from its siblings; no segment is shown so, as those with digits are wildcards.
TOLD = "0*"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def first_template(path: Column) -> Column:
    """The path's segments as an array, those that vary as wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    extension = lambda s: F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
    return F.transform(segments, lambda s: F.when(s.rlike(r"\d") | (F.length(s) > 40), F.concat(F.lit("*"), extension(s))).otherwise(s))


def told_apart(known: str, bads: str, all_known: str, all_bads: str) -> Column:
    """Whether the z-test tells the share of bad pages from that of the rest."""
    rest, share = F.col(all_known) - F.col(known), F.col(all_bads) / F.nullif(F.col(all_known), F.lit(0))
    spread = F.sqrt(share * (1 - share) * (1 / F.nullif(F.col(known), F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
    z = F.abs(F.col(bads) / F.nullif(F.col(known), F.lit(0)) - (F.col(all_bads) - F.col(bads)) / F.nullif(rest, F.lit(0))) / F.nullif(spread, F.lit(0.0))
    return F.coalesce(z, F.lit(0.0)) > Z


def _prefix(depth: str) -> Column:
    return F.array_join(F.slice("template", F.lit(1), F.col(depth)), "/")


def templates(pages: DataFrame, fewest: float = 0) -> DataFrame:
    """(host, path, bad: null where not labelled) to (host, first, template, rejected).

    Subtrees with fewer than fewest bad pages keep the templates they have; up to FEWEST that changes no rejection.
    """
    seen = pages.groupBy("host", first_template(F.col("path")).alias("first")).agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bads"))
    tree, done = cut(seen.withColumns({"template": F.col("first"), "depth": F.lit(0)})), []
    while True:  # once for each level at which templates of a node that may be rejected part
        deeper = F.size("template") > F.col("depth")
        done.append(tree.where(~deeper).drop("depth"))
        tree = tree.where(deeper).withColumn("above", _prefix("depth"))
        # of arrays in order the first and the last share what all share
        nodes = tree.groupBy("host", "above").agg(F.sum("bads").alias("_bads"), F.min("template").alias("_low"), F.max("template").alias("_high"))
        shared = F.aggregate(F.zip_with("_low", "_high", lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")))["n"]
        tree = cut(tree.join(nodes.select("host", "above", "_bads", shared.alias("_shared")), ["host", "above"]))
        done.append(tree.where(F.col("_bads") < fewest).select(*seen.columns, "template"))
        tree = tree.where(F.col("_bads") >= fewest).withColumn("depth", F.col("_shared")).drop("above", "_bads", "_shared")
        done.append(tree.where(F.size("template") <= F.col("depth")).drop("depth"))
        tree = tree.where(F.size("template") > F.col("depth"))
        if tree.isEmpty():
            break
        tree = tree.withColumn("above", _prefix("depth")).withColumn("here", F.get("template", F.col("depth")))
        children = tree.groupBy("host", "above", "here").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bads")])
        nodes = children.groupBy("host", "above").agg(F.count(F.lit(1)).alias("fan"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "known", "bads")]).where(F.col("fan") * F.col("fan") > F.col("all_n"))
        apart = told_apart("known", "bads", "all_known", "all_bads")
        shown = F.when(~apart, F.lit("*")).when(F.col("here") == "*", F.lit(TOLD)).otherwise(F.col("here"))
        shown = children.join(nodes, ["host", "above"]).select("host", "above", "here", shown.alias("shown")).where("shown != here")
        tree = tree.join(shown, ["host", "above", "here"], "left")
        renamed = F.concat(F.slice("template", F.lit(1), F.col("depth")), F.array(F.col("shown")), F.slice("template", F.col("depth") + 2, F.size("template")))
        tree = tree.withColumn("template", F.when(F.col("shown").isNotNull(), renamed).otherwise(F.col("template")))
        tree = cut(tree.withColumn("depth", F.col("depth") + 1).drop("above", "here", "shown"))
    tree = reduce(DataFrame.unionAll, done)
    by_template = ["host", "template"]
    tree = cut(tree.withColumn("template", F.array_join("template", "/")))
    counted = tree.groupBy(*by_template).agg(F.sum("known").alias("known"), F.sum("bads").alias("bads"))
    counted = counted.withColumn("parent", F.regexp_replace("template", "/?[^/]*$", ""))
    of_parent = counted.groupBy("host", "parent").agg(F.sum("known").alias("all_known"), F.sum("bads").alias("all_bads"))
    counted = counted.join(of_parent, ["host", "parent"])
    apart = told_apart("known", "bads", "all_known", "all_bads")
    counted = cut(counted.withColumn("branch", F.when(apart, F.col("template")).otherwise(F.concat("parent", F.lit("/~")))))
    branches = counted.groupBy("host", "parent", "branch").agg(F.sum("known").alias("b_known"), F.sum("bads").alias("b_bads"))
    usual = counted.agg((F.sum("bads") / F.nullif(F.sum("known"), F.lit(0))).alias("usual"))
    judged = branches.crossJoin(F.broadcast(usual))  # one row
    pure = (F.col("b_bads") + PRIOR * F.least(F.col("usual"), F.lit(PURE / 2))) / (F.col("b_known") + PRIOR)
    judged = counted.join(judged.select("host", "parent", "branch", F.coalesce(pure >= PURE, F.lit(False)).alias("rejected")), ["host", "parent", "branch"])
    return tree.join(judged.select(*by_template, "rejected"), by_template).select("host", "first", "template", "rejected")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """pages (with a column bad: boolean, null where not labelled) with host, path, rule, verdict."""
    whole = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]).alias("page")
    known = pages.select(whole, F.col(bad_col).alias("bad"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = templates(known.select("host", "path", "bad"), FEWEST).where("rejected").select("host", "first", F.lit("block").alias("by_tree"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = known.withColumn("first", first_template(F.col("path"))).join(found, ["host", "first"], "left")
    return out.select("page.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_tree"), F.lit("allow")).alias("verdict"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages with bad (a column of that name is replaced): what the labels say of the document that the path names."""
    pages = pages.drop("bad")
    named = F.expr("try_cast(named AS bigint)")
    bad = labels.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    keyed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.regexp_extract(path_of(F.col("url")), NAMED, 1).alias("named"))
    # pages that name none are dealt out by their url, under numbers that no document has
    keyed = keyed.withColumn("named", F.coalesce(named, -F.shiftrightunsigned(F.xxhash64("page.url"), 1) - 1))
    return keyed.join(bad.where("doc_id >= 0").withColumnRenamed("doc_id", "named"), "named", "left").select("page.*", "bad")


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of op9."""
    return judged(cut(labelled(pages.select("page_id", "url"), labels))).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    host, path = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    shown = "CASE WHEN regexp_matches(s, '\\d') OR length(s) > 40 THEN '*' || regexp_extract(s, '(\\.[A-Za-z]{1,5})$', 1) ELSE s END"
    apart = lambda k, b, ak, ab: f"coalesce(abs({b} / nullif({k}, 0) - ({ab} - {b}) / nullif({ak} - {k}, 0)) / nullif(sqrt(({ab} / nullif({ak}, 0)) * (1 - {ab} / nullif({ak}, 0)) * (1 / nullif({k}, 0) + 1 / nullif({ak} - {k}, 0))), 0), 0) > {Z}"
    steps = []
    for d in range(DEPTH):
        steps.append(f"""s{d} AS (SELECT host, template[1:{d}] AS above, template[{d + 1}] AS here, sum(n) AS n, sum(known) AS k, sum(bads) AS b FROM t{d} WHERE len(template) > {d} GROUP BY ALL),
w{d} AS (SELECT host, above, sum(n) AS an, sum(k) AS ak, sum(b) AS ab FROM s{d} GROUP BY ALL HAVING count(*) * count(*) > sum(n)),
c{d} AS (SELECT s.host, s.above, here, CASE WHEN NOT ({apart("k", "b", "ak", "ab")}) THEN '*' WHEN here = '*' THEN '{TOLD}' ELSE here END AS shown
      FROM s{d} s JOIN w{d} w ON w.host = s.host AND w.above = s.above),
t{d + 1} AS (SELECT t.host, t.first, t.n, t.known, t.bads, CASE WHEN c.host IS NOT NULL THEN template[1:{d}] || [c.shown] || template[{d + 2}:] ELSE template END AS template
      FROM t{d} t LEFT JOIN c{d} c ON len(t.template) > {d} AND c.host = t.host AND c.above = t.template[1:{d}] AND c.here = t.template[{d + 1}])""")
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(p.path, '{p}')", h + p, a) for a, h, p in ordered]
    rule, verdict = (f"CASE {' '.join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits)} END" for k in (1, 2))
    return f"""
WITH l AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels GROUP BY doc_id),
u AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
f AS (SELECT u.*, l.bad, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {shown}) AS parts
      FROM u LEFT JOIN l ON l.doc_id = TRY_CAST(regexp_extract(path, '{NAMED}', 1) AS BIGINT)),
p AS (SELECT *, parts AS first FROM f),
t0 AS (SELECT host, first, count(*) AS n, count(bad) AS known, coalesce(sum(CAST(bad AS INT)), 0) AS bads, first AS template FROM p GROUP BY host, first),
{", ".join(steps)},
t AS (SELECT host, first, known, bads, array_to_string(template, '/') AS template FROM t{DEPTH}),
c AS (SELECT host, template, sum(known) AS known, sum(bads) AS bads, regexp_replace(template, '/?[^/]*$', '') AS parent FROM t GROUP BY ALL),
a AS (SELECT *, sum(known) OVER w AS ak, sum(bads) OVER w AS ab FROM c WINDOW w AS (PARTITION BY host, parent)),
z AS (SELECT *, {apart("known", "bads", "ak", "ab")} AS apart FROM a),
b AS (SELECT *, CASE WHEN apart THEN template ELSE parent || '/~' END AS branch FROM z),
j AS (SELECT host, template, (sum(bads) OVER w + {PRIOR} * least((SELECT sum(bads) / nullif(sum(known), 0) FROM c), {PURE / 2})) / (sum(known) OVER w + {PRIOR}) >= {PURE} AS rejected
      FROM b WINDOW w AS (PARTITION BY host, parent, branch))
SELECT page_id, p.host, p.path, {rule} AS rule, coalesce({verdict}, CASE WHEN j.rejected THEN 'block' END, 'allow') AS verdict
FROM p JOIN t ON t.host = p.host AND t.first = p.first JOIN j ON j.host = t.host AND j.template = t.template
"""


#: The rows of op9 by DuckDB.
ORACLE = _oracle()
