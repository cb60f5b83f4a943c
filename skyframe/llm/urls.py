"""URL filter: rules by host and path, and a tree of path templates a host.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: then up to ``?``, ``#`` or the end.  Null, or without ``://``: both empty.

A rule ``host/path`` fits its host and all subdomains where the path starts with
the rule's; the longest fitting rule decides.

All other urls are judged by their path's template.  Segments with a digit are
wildcards (``*``, with the file ending kept), then, from the root of each host's tree down, so are
the rare ones among many siblings; what lies deeper than ``depth`` is ``**``.  So
a node keeps at most ``siblings`` named children.

Then, from the leaves up, statistically similar branches of a node are merged.
Siblings whose most frequent remainder is the same are of one kind; a
branch is similar to its kind if how its pages spread over what lies below can't be told from
how those of its whole kind do, G = 2 sum n ln(n / expected) being at most
f + 3 sqrt(2 f) + 2 * alike * pages with f degrees of freedom (alike: a divergence, in
nats, that doesn't count however many pages show it).  Similar branches whose labels speak for
different verdicts stay apart, and those without labels go with the labelled ones
if these agree.  A node with nothing below its children merges none.

Labels are the pages that a rule decides, and those of ``labelled`` (page_id, bad
boolean), if given.  A template is rejected if the smoothed share of bad pages,
(bad + prior * weight) / (labelled + weight), reaches the cutoff.

Only DataFrame operations; paths are summed by template before anything joins,
and each level of the tree is written, so no plan holds more than one.  A host
and shape with more than one in ``HOT`` pages is joined by a broadcast, of ``HOT`` rows
at most; all others by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
DEPTH, SIBLINGS, PRIOR, WEIGHT, CUTOFF, ALIKE = 4, 24, 0.2, 4.0, 0.5, 0.02
#: Greatest number of keys with more than one in HOT rows; and parts that a node of many children is joined in.
HOT, PARTS = 20_000, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _segments(path: Column, depth: int) -> Column:
    """Of a path, ``depth`` segments; those with a digit are wildcards, an empty one stands for the end."""
    all_ = F.filter(F.split(path, "/"), lambda x: x != "")
    general = F.transform(all_, lambda x: F.when(x.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(x, r"(\.[A-Za-z]+)\z", 1))).otherwise(x))
    return F.when(F.size(general) > depth, F.concat(F.slice(general, 1, depth - 1), F.array(F.lit("**")))).otherwise(general)


def _generalised(now: DataFrame, node: list[str], at: str, siblings: int) -> DataFrame:
    """The rare ones among many siblings become ``*``."""
    child = now.groupBy(*node, at).agg(F.sum("n").alias("own"))
    whole = child.groupBy(*node).agg(F.count("*").alias("children"), F.sum("own").alias("all")).where(F.col("children") > siblings)
    # a node may have any number of children, so they don't meet it in one task
    whole = whole.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    child = child.withColumn("_part", F.pmod(F.xxhash64(at), F.lit(PARTS)).cast("int"))
    rare = child.join(whole, [*node, "_part"]).where((F.col("own") * siblings < F.col("all")) & ~F.col(at).isin("", "**"))
    rare = rare.select(*node, at, F.lit("*").alias("_general"))
    return now.join(rare, [*node, at], "left").withColumn(at, F.coalesce("_general", at)).drop("_general")


def _merged(tree: DataFrame, node: list[str], at: str, below: list[str], prior: float, weight: float, alike: float, cutoff: float) -> DataFrame:
    """Similar branches get one name."""
    # a node has ``siblings`` branches and three special ones at most by now, so all these partitions are small
    kin = Window.partitionBy(*node, "kind")
    cells = tree.where(F.col(at) != "").groupBy(*node, at, *below).agg(*(F.sum(x).alias(x) for x in ("n", "labelled", "bad")))
    cells = cells.withColumn("kind", F.first(F.concat_ws("/", *below)).over(Window.partitionBy(*node, at).orderBy(F.desc("n"), *below)))
    pool = Window.partitionBy(*node, "kind", *below)
    cells = cells.withColumn("p", F.sum("n").over(pool)).withColumn("one", 1 / F.count("*").over(pool))
    log, deep = F.sum(F.col("n") * F.log(F.col("n") / F.col("p"))), F.max((F.col(below[0]) != "").cast("int"))
    branch = cells.groupBy(*node, "kind", at).agg(F.sum("n").alias("m"), F.sum("one").alias("one"), log.alias("log"), deep.alias("deep"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    whole, free = F.sum("m").over(kin), F.round(F.sum("one").over(kin)) - 1
    branch = branch.withColumn("g", F.round(2 * (F.col("log") + F.col("m") * F.log(whole / F.col("m"))), 6)).withColumn("free", free).withColumn("deep", F.max("deep").over(kin))
    similar = branch.where((F.col("deep") == 1) & (F.col("g") <= F.col("free") + 3 * F.sqrt(2 * F.col("free")) + 2 * alike * F.col("m")))
    bad = (F.col("b") + prior * weight) / (F.col("l") + weight) >= cutoff
    sided = similar.withColumn("side", F.when(F.col("l") > 0, bad.cast("int")))
    lo, hi = F.min("side").over(kin), F.max("side").over(kin)
    sided = sided.withColumn("group", F.coalesce("side", F.when(lo == hi, lo), F.lit(-1)))
    names = sided.select(*node, at, F.concat_ws("|", F.sort_array(F.collect_set(at).over(Window.partitionBy(*node, "kind", "group")))).alias("_name"))
    return tree.join(names, [*node, at], "left").withColumn(at, F.coalesce("_name", at)).drop("_name")


def templates(pages: DataFrame, depth: int = DEPTH, siblings: int = SIBLINGS, prior: float = PRIOR, weight: float = WEIGHT, alike: float = ALIKE, cutoff: float = CUTOFF) -> DataFrame:
    """pages: host, shape (array), bad (boolean, null: no label). A row a host and shape: n (its pages), template, the template's pages and labelled ones, and smoothed share of bad ones."""
    segments, places = [f"s{k}" for k in range(depth)], [f"t{k}" for k in range(depth)]
    now = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    now = runtime.cut(now.select("*", *(F.coalesce(F.get("shape", F.lit(k)), F.lit("")).alias(s) for k, s in enumerate(segments))))
    for k, at in enumerate(segments):
        now = runtime.cut(_generalised(now, ["host", *segments[:k]], at, siblings), (now,))
    tree = now.groupBy("host", *segments).agg(*(F.sum(x).alias(x) for x in ("n", "labelled", "bad")))
    tree = runtime.cut(tree.select("*", *(F.col(s).alias(t) for s, t in zip(segments, places, strict=True))))
    for k in reversed(range(depth - 1)):
        tree = runtime.cut(_merged(tree, ["host", *segments[:k]], segments[k], segments[k + 1 :], prior, weight, alike, cutoff), (tree,))
    total = tree.groupBy("host", *segments).agg(F.sum("n").alias("pages"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    share = (F.col("b") + prior * weight) / (F.col("l") + weight)
    text = F.concat(F.lit("/"), F.array_join(F.filter(F.array(*segments), lambda x: x != ""), "/"))
    judged = tree.select("host", *places, *segments).join(total, ["host", *segments]).select("host", *places, text.alias("template"), "pages", F.col("l").alias("labelled"), share.alias("bad_share"))
    found = now.select("host", "shape", "n", *(F.col(s).alias(t) for s, t in zip(segments, places, strict=True)))
    return found.join(judged, ["host", *places]).select("host", "shape", "n", "template", "pages", "labelled", "bad_share")


def judge(pages: DataFrame, rules: dict[str, str] | None = None, labelled: DataFrame | None = None, depth: int = DEPTH, cutoff: float = CUTOFF, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share of every row of pages (page_id, url)."""
    rules = RULES if rules is None else rules
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    decided = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        decided = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(decided)
    rows = rows.withColumn("decided", decided).withColumn("shape", _segments(F.col("path"), depth))
    marked = rows.withColumn("bad", F.col("decided") == "block")
    if labelled is not None:
        own = labelled.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("_bad"))
        marked = marked.join(own, "page_id", "left").withColumn("bad", F.coalesce("bad", "_bad"))
    found = runtime.cut(templates(marked.select("host", "shape", "bad"), depth, cutoff=cutoff, **options))
    verdict = F.coalesce("decided", F.when(F.col("bad_share") >= cutoff, "block").otherwise("allow"))
    every = found.agg(F.sum("n")).collect()[0][0] or 0
    hot = F.col("n") * HOT > every
    common = found.where(hot).select("host", "shape", F.struct("template", "bad_share").alias("_common"))
    rest = found.where(~hot).select("host", "shape", F.struct("template", "bad_share").alias("_rest"))
    known = rows.join(F.broadcast(common), ["host", "shape"], "left")
    usual, other = known.where("_common is not null").withColumn("_found", F.col("_common")), known.where("_common is null").join(rest, ["host", "shape"], "left").withColumn("_found", F.col("_rest"))
    columns = ["page_id", "host", "path", "rule", "decided", "_found.template", "_found.bad_share"]
    both = usual.select(*columns).unionByName(other.select(*columns))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_share")
