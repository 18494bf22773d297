"""Operator 2: URL filter by path-template trees, in DataFrame and SQL functions only.

Each host has a tree over path segments. Numbers and hashes are wildcards from the start.
Level by level, segments too rare among their siblings become one wildcard branch, and of
the others those that are statistically similar merge into one branch: neither their
labelled bad rates, tested against the pooled rate of the whole branch, nor the kinds of
segments that follow them differ. Siblings without any label merge with one another alone, and so
keep the rate of their parent. A template's rate of bad labels is smoothed towards its
parent's, up to the host and the whole table, and a template at or above ``reject`` is
blocked. Explicit rules come before the tree.

Rows are counted by (host, normalised path) first; the tree works on those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fits, materialise, new_column, unused

RARE_SHARE = 0.02
RARE_LEAST = 5
SIMILAR = 2.0
SHAPE = 0.25
SMOOTHING = 10.0
REJECT = 0.5
BROADCAST_BYTES = 64 << 20

#: A branch of siblings: their segments, labels, and paths in all and by what follows (end, number, hash, word).
BRANCH = "struct<segs:array<string>,labelled:bigint,bad:bigint,n:bigint,ends:bigint,numbers:bigint,hashes:bigint,words:bigint>"
KINDS = ("ends", "numbers", "hashes", "words")

#: The rules of the contract query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of rule and action, else null. ``rules`` is a list held by the driver."""
    hits = []
    for action, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        hits.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    if not hits:
        return F.lit(None).cast("struct<size:int,rule:string,action:string>")
    return F.array_max(F.array_compact(F.array(*hits)))


def segments_of(path: Column) -> Column:
    """Normalised segments: numbers, with or without a file ending, and hashes become wildcards."""
    return F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(s.rlike(r"^\d+$"), F.lit("#"))
        .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.regexp_replace(s, r"^[0-9]+", "#"))
        .when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("@"))
        .otherwise(s),
    )


def _similar(a: str, b: str) -> str:
    """SQL: two branches that are both labelled or both not, of rates and continuations that do not differ."""
    pooled = f"(({a}.bad + {b}.bad) / ({a}.labelled + {b}.labelled))"
    error = f"sqrt(greatest(1e-9D, {pooled} * (1 - {pooled})) * (1 / {a}.labelled + 1 / {b}.labelled))"
    rates = f"({a}.labelled = 0 and {b}.labelled = 0 or {a}.labelled > 0 and {b}.labelled > 0 and abs({a}.bad / {a}.labelled - {b}.bad / {b}.labelled) < {SIMILAR}D * {error})"
    apart = " + ".join(f"abs({a}.{k} / {a}.n - {b}.{k} / {b}.n)" for k in KINDS)
    return f"({rates} and {apart} <= {2 * SHAPE}D)"


def _merged() -> str:
    """SQL: the branches of ``siblings``, in the order of their rates; each joins the last branch that it is similar to."""
    sums = ", ".join(f"'{k}', b.{k} + x.{k}" for k in ("labelled", "bad", "n", *KINDS))
    own = ", ".join(f"'{k}', x.{k}" for k in ("labelled", "bad", "n", *KINDS))
    joined = f"named_struct('segs', concat(b.segs, array(x.seg)), {sums})"
    alone = f"named_struct('segs', array(x.seg), {own})"
    place = f"array_max(transform(bs, (b, i) -> if({_similar('b', 'x')}, i, cast(null as int))))"
    step = f"element_at(transform(array(coalesce({place}, -1)), k -> if(k < 0, concat(bs, array({alone})), transform(bs, (b, i) -> if(i = k, {joined}, b)))), 1)"
    return f"aggregate(array_sort(siblings), cast(array() as array<{BRANCH}>), (bs, x) -> {step})"


def template_tree(seen: DataFrame) -> DataFrame:
    """``(host, segs, template, purity)`` for every ``seen(host, segs, n, labelled, bad)``, one row each.

    The tree is as deep as the longest path; a path leaves it once it has ended, so others' depth does not change it.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    base = seen.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("r")).first()["r"] or 0.0
    smooth = lambda above: (F.col("bad") + SMOOTHING * above) / (F.col("labelled") + SMOOTHING)
    hosts = seen.groupBy("host").agg(*sums).select("host", smooth(F.lit(base)).alias("purity"))
    tree = seen.join(hosts, "host").withColumn("template", F.lit(""))
    level, ended = 0, []
    while True:
        at = lambda k: F.coalesce(F.get("segs", F.lit(k)), F.lit(""))
        tree, after = tree.withColumn("seg", at(level)), at(level + 1)
        kind = [after == "", after.startswith("#"), after == "@"]
        kind.append(~(kind[0] | kind[1] | kind[2]))
        follows = [F.sum(F.when(x, F.col("n")).otherwise(F.lit(0))).alias(k) for k, x in zip(KINDS, kind)]
        child = tree.groupBy("host", "template", "seg").agg(*sums, *follows, F.first("purity").alias("above"))
        parent = child.groupBy("host", "template").agg(F.sum("n").alias("pn"), F.count("*").alias("kinds"))
        child = child.join(parent, ["host", "template"])
        fixed = (F.col("seg").isin("", "@") | F.col("seg").startswith("#")) | (F.col("kinds") == 1)
        rare = F.col("n") < F.greatest(F.lit(RARE_LEAST), RARE_SHARE * F.col("pn"))
        child = materialise(child.withColumn("fixed", fixed).withColumn("rare", rare), "children")
        # of the open siblings, each with RARE_SHARE of the paths, there are at most 1 / RARE_SHARE
        rate = F.coalesce(F.try_divide("bad", "labelled"), F.lit(-1.0)).alias("rate")
        siblings = F.collect_list(F.struct(rate, "seg", "labelled", "bad", "n", *KINDS)).alias("siblings")
        branch = child.where("not fixed and not rare").groupBy("host", "template").agg(siblings)
        branch = branch.select("host", "template", F.posexplode(F.expr(_merged())).alias("number", "b"))
        branch = branch.where("size(b.segs) > 1").select("host", "template", F.concat(F.lit("+"), F.col("number").cast("string")).alias("branch"), F.explode("b.segs").alias("seg"))
        child = child.join(branch, ["host", "template", "seg"], "left")
        name = F.when(F.col("fixed"), F.col("seg")).when(F.col("rare"), F.lit("*")).otherwise(F.coalesce("branch", "seg"))
        child = child.withColumn("grown", F.concat("template", F.when(F.col("seg") == "", F.lit("")).otherwise(F.concat(F.lit("/"), name))))
        # where nothing goes on, a path's end is no branch of its own
        alone = F.first((F.col("seg") == "") & (F.col("kinds") == 1)).alias("alone")
        rates = child.groupBy("host", "grown").agg(*sums, F.first("above").alias("above"), alone)
        rates = rates.select("host", "grown", F.when(F.col("alone"), F.col("above")).otherwise(smooth(F.col("above"))).alias("rate"))
        child = child.select("host", "template", "seg", "grown").join(rates, ["host", "grown"])
        tree = tree.join(child, ["host", "template", "seg"]).select(
            "host", "segs", "n", "labelled", "bad", F.col("grown").alias("template"), F.col("rate").alias("purity")
        )
        tree = materialise(tree, "templates")
        if tree.where(F.size("segs") > level + 1).isEmpty():
            break
        ended.append(tree.where(F.size("segs") <= level))
        tree, level = tree.where(F.size("segs") > level), level + 1
    for own in ended:
        tree = tree.unionByName(own)
    return tree.select("host", "segs", "template", "purity")


def judge(urls: DataFrame, labels: DataFrame, url_col: str = "url", rules=RULES, reject: float = REJECT, out_col: str = "judged") -> DataFrame:
    """``urls`` with ``out_col`` added: struct of host, path, rule, verdict, template and purity.

    ``labels(key, bad)`` holds labels, 0 or 1, by the number that ends a path, before a file ending if it has one; a key that
    repeats is bad if any of its rows is. A null url or one without ``://`` has an empty host
    and path and is judged as such. Rows that repeat are judged alike; an empty table stays
    empty; without labels nothing but rules blocks. Own columns stay, whatever their names; one
    that is called ``out_col`` is an error. Long urls count whole, however many segments they have.
    """
    new_column(out_col, urls.columns)
    p, k = unused("parts", urls.columns), unused("known", urls.columns)
    key = F.expr(f"try_cast(nullif(regexp_extract({p}.path, '/([0-9]+)([.][A-Za-z0-9]+)?/?$', 1), '') as bigint)")
    parts = urls.withColumn(p, F.struct(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")))
    parts = parts.withColumn(p, F.struct(f"{p}.host", f"{p}.path", segments_of(F.col(f"{p}.path")).alias("segs")))
    keyed = parts.select(f"{p}.host", f"{p}.segs", key.alias("key")).groupBy("host", "segs", "key").agg(F.count("*").alias("n"))
    labels = labels.where("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    seen = keyed.join(labels, "key", "left").groupBy("host", "segs").agg(
        F.sum("n").alias("n"), F.sum(F.col("bad").isNotNull().cast("long")).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
    )
    tree = template_tree(materialise(seen, "paths")).select(F.struct("host", "segs", "template", "purity").alias(k))
    tree = F.broadcast(tree) if fits(tree, BROADCAST_BYTES) else tree
    met = parts.join(tree, (F.col(f"{p}.host") == F.col(f"{k}.host")) & (F.col(f"{p}.segs") == F.col(f"{k}.segs")), "left")
    hit = matched_rule(F.col(f"{p}.host"), F.col(f"{p}.path"), rules)
    own = F.when(F.col(f"{k}.purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return met.select(
        *[F.col(f"`{c}`") for c in urls.columns],
        F.struct(
            F.col(f"{p}.host"), F.col(f"{p}.path"), hit["rule"].alias("rule"), F.coalesce(hit["action"], own).alias("verdict"),
            F.col(f"{k}.template"), F.col(f"{k}.purity"),
        ).alias(out_col),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page. A page is labelled bad where the document its path names is toxic or of low quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), labels.select(F.col("doc_id").alias("key"), bad.alias("bad")))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.template", "judged.purity")
