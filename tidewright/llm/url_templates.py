"""URL filter: per-host path-template trees with smoothed labelled purity, in DataFrame functions only.

A url's path is read as segments.  Level by level, under one host and template
prefix, a segment position whose values hardly repeat becomes a wildcard; so
does every segment with a digit.  From the leaves upwards, sibling branches whose
labelled shares don't differ significantly from the rest are merged into their
parent; those that do stand alone and count for nobody else.
A template is rejected when its share of bad labels, smoothed towards the share
over all labels, reaches the purity; stated rules go before.

Defined cases: a null url, or one without ``://``, has empty host and path, one
root template and no labels of its own; without labels the global share is 0
and nothing is rejected; repeated urls count once per row; the tree is as deep
as the longest path of the table; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import store

#: Levels that the SQL form in oracle.py spells out; the operator itself goes to the counted depth.
DEPTH = 4
#: A position is a wildcard when it has more values than this and fewer than REPEAT rows a value.
FEW_VALUES, REPEAT = 8, 3.0
#: Siblings further than this many standard errors from their parent's pool stand alone.
Z_MERGE = 3.0
#: Rows of the prior in the smoothed share, and the share from which a template is rejected.
PRIOR, PURITY = 10.0, 0.5
SALTS = 16

#: Stated rules (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_choice(rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits; needs columns host and path."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    choice = None
    for verdict, h, p in ordered:
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, hit) if choice is None else choice.when(fits, hit)
    return choice if choice is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (with host and path) plus parent and template (host + generalised path).

    Every level groups once by (host, prefix, segment) and once by (host,
    prefix), both with partial sums, and joins the resulting flags back under a
    salt, so that a host with a third of all rows is spread over tasks.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    shaped = F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))
    rows = pages.withColumn("_segments", shaped).withColumn("_prefix", F.col("host")).withColumn("_parent", F.col("host"))
    depth = pages.agg(F.max(F.size(segments))).first()[0] or 0
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS))
    for level in range(depth):
        here = F.get("_segments", F.lit(level))
        seen = rows.select("_prefix", here.alias("s")).filter("s is not null").groupBy("_prefix", "s").agg(F.count("*").alias("n"))
        flags = seen.groupBy("_prefix").agg(F.count("*").alias("values"), F.sum("n").alias("n")).filter((F.col("values") > FEW_VALUES) & (F.col("n") < REPEAT * F.col("values")))
        wild = flags.select("_prefix", F.lit(True).alias("_wild"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
        joined = rows.withColumn("_salt", salt).join(wild, ["_prefix", "_salt"], "left").drop("_salt")
        step = F.when(F.col("_wild"), F.lit("*")).otherwise(here)
        rows = store(
            joined.withColumn("_parent", F.when(here.isNotNull(), F.col("_prefix")).otherwise(F.col("_parent")))
            .withColumn("_prefix", F.when(here.isNotNull(), F.concat("_prefix", F.lit("/"), step)).otherwise(F.col("_prefix")))
            .drop("_wild"),
            "templates",
        )
    return rows.withColumn("template", F.col("_prefix")).withColumn("parent", F.col("_parent")).drop("_segments", "_prefix", "_parent")


def verdicts(labelled: DataFrame) -> DataFrame:
    """(parent, template, rejected) from rows with parent, template and bad (boolean, null: no label).

    From the leaves upwards a branch that differs from the rest of its siblings
    stands alone; the others' labels go to their parent, which is then compared
    in its turn.  A branch that was merged has the verdict of its parent.
    """
    known = F.when(F.col("bad").isNotNull(), 1).otherwise(0)
    bad = F.when(F.col("bad"), 1).otherwise(0)
    level = F.size(F.split("template", "/")) - 1
    leaves = store(labelled.groupBy("parent", "template").agg(F.sum(known).alias("n"), F.sum(bad).alias("k")).withColumn("level", level), "leaves")
    deepest, total, worst = leaves.agg(F.max("level"), F.sum("n"), F.sum("k")).first()
    rate = (worst or 0) / max(total or 0, 1)
    share = (F.col("k") + PRIOR * rate) / (F.col("n") + PRIOR)
    up, levels = None, []
    for d in range(deepest or 0, -1, -1):
        here = leaves.filter(F.col("level") == d).select("template", "n", "k")
        nodes = (here if up is None else here.unionByName(up)).groupBy("template").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        nodes = nodes.withColumn("above", F.regexp_replace("template", r"(?s)/[^/]*$", "")).withColumn("rejected", share >= PURITY)
        if d:
            pool = nodes.groupBy("above").agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"))
            rest = F.col("pn") - F.col("n") + PRIOR
            p = (F.col("pk") - F.col("k") + PRIOR * rate) / rest
            off = F.abs(F.col("k") - F.col("n") * p)
            alone = off > Z_MERGE * F.sqrt(F.greatest(F.col("n") * p * (1 - p) * (1 + F.col("n") / rest), F.lit(0.25)))
            nodes = nodes.join(pool, "above").withColumn("alone", alone)
        else:
            nodes = nodes.withColumn("alone", F.lit(True))
        nodes = store(nodes.select("above", "template", "n", "k", "rejected", "alone"), "nodes")
        up = nodes.filter("not alone").groupBy(F.col("above").alias("template")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        levels.append(nodes)
    known_above, judged = None, []
    for nodes in reversed(levels):
        if known_above is not None:
            nodes = nodes.join(known_above.select(F.col("template").alias("above"), F.col("rejected").alias("theirs")), "above", "left")
            nodes = nodes.withColumn("rejected", F.when(F.col("alone"), F.col("rejected")).otherwise(F.col("theirs")))
        known_above = store(nodes.select("template", "rejected"), "judged")
        judged.append(known_above)
    whole = judged[0]
    for j in judged[1:]:
        whole = whole.union(j)
    return leaves.select("parent", "template").join(whole, "template")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template.

    ``labels``: (page_id, bad boolean); a page with several takes the worst.
    """
    rows = pages.select("page_id", host().alias("host"), path().alias("path"))
    bad = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    shaped = templates(rows)
    decided = store(verdicts(shaped.join(bad, "page_id", "left")).filter("rejected").select("parent", "template", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"), F.lit(True).alias("rejected")), "rejected")
    salted = shaped.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    judged = salted.join(decided, ["parent", "template", "_salt"], "left")
    choice = rule_choice(rules)
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", choice["rule"].alias("rule"), F.coalesce(choice["verdict"], own).alias("verdict"), "template")
