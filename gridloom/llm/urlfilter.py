r"""URL filter: fixed rules, and for the rest a path-template tree with labelled purity.

Rules (host, path, verdict) fit a host and its subdomains if the path starts with the rule's; the longest wins. Pages
that a rule judges are the labelled ones. The tree holds, per host, the paths' segments. Branching by branching, from
counts:

* digits in a segment become {n}, long hexadecimal strings {x}, a segment's third and further repetitions in a row go:
  variable by form;
* where a node has many children with little support each, its rare children become {*}: variable by statistics;
* children with the same frequent shapes below them and like labels make a group; those of a group whose shapes are
  distributed like the group's (total variation at most ``spread``) become one branch.

Labels of a shape of paths on other hosts, a vote for each host, are the prior of that shape on a host: with V the sum of
the other hosts' blocked shares and H their number, (V + weight * prior) / (H + weight). The purity of a template is
(blocked + weight * its pages' mean prior) / (labelled + weight); labels are alike if that estimate is at or over
``threshold``, or at or under 1 - threshold, or between the two for all. A template is rejected, and its unruled pages
blocked, if its purity reaches ``threshold``.

All counts are partial aggregates over (host, path shape), so a hot host is never in one task. Stretches of a path on
which no other path of its host branches off are passed over at once, so the rounds grow with the branchings that lie
below one another, not with the length of paths.

Cases: null url, or one without ``://``, has empty host and path and is judged as such; a null page_id is kept; repeated
rows count and are judged each; a very long path is one row of segments; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._spark import stored

# Fixed rules of the query op3.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Bytes of (host, shape, template) rows that may be broadcast.
SIDE_BYTES = 1 << 24


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    seg = F.transform(F.slice(F.split(path, "/"), 2, 1 << 20), lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{x}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))
    both = F.zip_with(F.zip_with(seg, F.concat(F.array(F.lit(None).cast("string")), seg), lambda a, b: F.struct(a.alias("s"), (a == b).alias("one"))), F.concat(F.array(F.lit(None).cast("string"), F.lit(None).cast("string")), seg), lambda a, b: F.struct(a["s"].alias("s"), F.coalesce(a["one"] & (a["s"] == b), F.lit(False)).alias("again")))
    return F.transform(F.filter(both, lambda x: x["s"].isNotNull() & ~x["again"]), lambda x: x["s"])


def with_priors(shapes: DataFrame, prior: float, weight: float) -> DataFrame:
    """shapes(host, shape, n, labelled, blocked) with the column prior: what the labels of the shape on other hosts say."""
    share = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled"))
    all_hosts = shapes.groupBy("shape").agg(F.sum(share).alias("votes"), F.count(share).alias("voters"))
    own = F.coalesce(share, F.lit(0.0))
    others = F.coalesce(F.col("votes"), F.lit(0.0)) - own + weight * prior
    return shapes.join(all_hosts, "shape").withColumn("prior", others / (F.col("voters") - F.when(F.col("labelled") > 0, 1).otherwise(0) + weight)).drop("votes", "voters")


def templates(shapes: DataFrame, many: int, support: int, spread: float, threshold: float, weight: float) -> DataFrame:
    """shapes(host, shape, n, labelled, blocked, prior) with the column template."""
    whole = shapes.withColumns({"at": F.lit(""), "rest": F.col("shape")})
    now, done = whole, []
    columns = ["host", "shape", "n", "labelled", "blocked", "prior", "at"]
    node, child = ["host", "at"], ["host", "at", "seg"]
    joined = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("/"), F.array_join(c, "/"))).otherwise(F.lit(""))
    while True:
        # What all paths below a node begin with is the common beginning of the least and the greatest of them.
        ends = now.groupBy(*node).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        same = F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
        first = F.when(F.col("lo") == F.col("hi"), F.size("lo")).otherwise(F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1)
        now = now.join(ends.select(*node, first.alias("common"), (F.col("lo") == F.col("hi")).alias("alone")), node)
        at = F.concat("at", joined(F.slice("rest", 1, F.col("common"))))
        now = now.select(*columns[:-1], at.alias("at"), F.expr("slice(rest, common + 1, size(rest))").alias("rest"), "alone")
        now = stored(now, "templates")
        done.append(now.filter("alone").select(*columns))
        now = now.filter(~F.col("alone"))
        if now.isEmpty():
            break
        below = F.when(F.size("rest") > 1, F.regexp_replace(F.array_join(F.expr("slice(rest, 2, size(rest))"), "/"), "[^/{}$]+", "a")).otherwise(F.lit("$"))
        now = now.withColumns({"seg": F.coalesce(F.try_element_at("rest", F.lit(1)), F.lit("$")), "below": below})
        cs = stored(now.groupBy(*child, "below").agg(F.sum("n").alias("csn"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.sum(F.col("n") * F.col("prior")).alias("p")), "below")
        c = cs.groupBy(*child).agg(F.sum("csn").alias("cn"), F.sum("l").alias("cl"), F.sum("b").alias("cb"), F.sum("p").alias("cp"))
        p = c.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("cn").alias("pn"))
        often = cs.join(c, child).filter(F.col("csn") >= spread * F.col("cn")).groupBy(*child).agg(F.sort_array(F.collect_list("below")).alias("often"))
        estimate = (F.col("cb") + weight * F.col("cp") / F.col("cn")) / (F.col("cl") + weight)
        lean = F.when(estimate >= threshold, "block").when(estimate <= 1 - threshold, "allow").otherwise("open")
        c = stored(c.join(often, child).join(p, node).withColumn("group", F.concat(F.lit("{"), F.hex(F.xxhash64("often", lean)), F.lit("}"))).drop("often"), "branches")
        group = [*node, "group"]
        g = c.groupBy(*group).agg(F.count("*").alias("gk"), F.sum("cn").alias("gn"))
        cs = cs.join(c.select(*child, "cn", "group"), child)
        gs = cs.groupBy(*group, "below").agg(F.sum("csn").alias("gsn"))
        # Total variation is the sum of the positive differences, which only shapes below the child have.
        far = cs.join(gs, [*group, "below"]).join(g, group).groupBy(*child).agg(F.sum(F.greatest(F.lit(0.0), F.col("csn") / F.col("cn") - F.col("gsn") / F.col("gn"))).alias("far"))
        c = c.join(g, group).join(far, child)
        rare = (F.col("kids") > many) & (F.col("pn") < F.col("kids") * support) & (F.col("cn") < F.greatest(F.lit(support), F.col("pn") * 0.05))
        fixed = F.col("seg").rlike(r"^\$$|^\{x\}$|\{n\}")
        name = F.when(fixed, F.col("seg")).when(rare, F.lit("{*}")).when((F.col("gk") > 1) & (F.col("far") <= spread), F.col("group")).otherwise(F.col("seg"))
        after = now.join(c.select(*child, name.alias("name")), child)
        after = stored(after.withColumn("at", F.when(F.size("rest") == 0, F.col("at")).otherwise(F.concat("at", F.lit("/"), "name"))).select(*columns, "rest"), "templates")
        done.append(after.filter(F.size("rest") == 0).select(*columns))
        now = after.filter(F.size("rest") > 0).withColumn("rest", F.expr("slice(rest, 2, size(rest))"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("at", "template")


def judge(pages: DataFrame, rules=RULES, many: int = 8, support: int = 20, spread: float = 0.15, prior: float = 0.3, weight: float = 4.0, threshold: float = 0.9, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row."""
    base = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"))
    host, path = parts(F.col("url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), _shape(F.col("path")).alias("shape"))
    shapes = stored(base.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")), "shapes")
    found = templates(stored(with_priors(shapes, prior, weight), "priors"), many, support, spread, threshold, weight)
    mean = F.sum(F.col("n") * F.col("prior")) / F.sum("n")
    purity = found.groupBy("host", "template").agg(((F.sum("blocked") + weight * mean) / (F.sum("labelled") + weight)).alias("purity"))
    known = stored(found.join(purity, ["host", "template"]).select("host", "shape", "template", "purity"), "purity")
    # Shapes may be long, so the bound of a broadcast counts their bytes.
    size = known.agg(F.sum(F.length("host") + F.length("template") + F.length(F.array_join("shape", "/")) + 64)).first()[0]
    side = F.broadcast(known) if (size or 0) <= SIDE_BYTES else known
    out = base.join(side, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")


def op3(pages: DataFrame) -> DataFrame:
    return judge(pages)
