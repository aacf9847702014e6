"""URL filters: fixed rules, and a path-template tree for what no rule covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.plans.lineage import Pieces, cut, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A segment that looks like an id: a number, four digits in a row, or a long hexadecimal name.
ID_LIKE = "^[0-9]+\\z|[0-9]{4}|^[0-9a-fA-F-]{16,}\\z"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"

# (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does.

    A rule fits its host and all subdomains when the path starts with the rule's. The
    rules are a parameter, written into the plan as one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _next_level(active: DataFrame, level: int, rare: int, many: int, z2: float) -> DataFrame:
    """Active paths (host, path, template, n, labelled, blocked) with one more template part, and whether they rest."""
    parts = F.split(F.substring("path", 2, 1 << 30), "/")
    at = active.withColumn("seg", F.get(parts, F.lit(level - 1))).withColumn("rest", F.array_join(F.slice(parts, level, F.greatest(F.size(parts) - level + 1, F.lit(0))), "/"))
    child = at.groupBy("host", "template", "seg").agg(*[F.sum(c).alias("_" + c) for c in ("n", "labelled", "blocked")], F.count(F.lit(1)).alias("_paths"))
    child = cut(child.withColumn("_id", F.coalesce(F.col("seg").rlike(ID_LIKE), F.lit(False))).withColumn("_rare", ~F.col("_id") & (F.col("_n") <= rare)))
    own = F.col("seg").isNotNull() & ~F.col("_id")
    part = lambda c, which: F.sum(F.when(own & which, F.col(c)).otherwise(0))
    node = cut(child.groupBy("host", "template").agg(
        F.sum("_paths").alias("_all"), F.count_if(own & F.col("_rare")).alias("_kinds"),
        part("_labelled", ~F.col("_rare")).alias("_fl"), part("_blocked", ~F.col("_rare")).alias("_fb"),
        part("_labelled", F.col("_rare")).alias("_rl"), part("_blocked", F.col("_rare")).alias("_rb"),
    ))
    both = child.join(node.withColumnRenamed("host", "_h").withColumnRenamed("template", "_t"), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    loose = F.col("_kinds") >= many  # so many rare ones that rare segments vary
    variable = F.col("_id") | (F.col("_rare") & loose)
    n1, b1 = F.col("_labelled").cast("double"), F.col("_blocked").cast("double")
    n0 = F.col("_fl") + F.when(loose, 0).otherwise(F.col("_rl")) - n1
    b0 = F.col("_fb") + F.when(loose, 0).otherwise(F.col("_rb")) - b1
    p = F.try_divide(b1 + b0, n1 + n0)
    gap = F.try_divide(b1, n1) - F.try_divide(b0, n0)
    apart = F.coalesce(gap * gap > F.lit(z2) * p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)), F.lit(False))
    # A branch with labels that nothing else has to be told from keeps its name too.
    kept = F.when(variable, "*").when(F.col("_labelled") == 0, F.concat("seg", F.lit("/**"))).when(apart | (n0 <= 0), F.col("seg")).otherwise("+")
    rests = F.col("seg").isNull() | (F.col("_all") == 1) | (~variable & (F.col("_labelled") == 0))
    decided = both.select(
        F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("seg").alias("_seg"), F.col("_all") == 1, kept.alias("_part"), rests.alias("rests"),
    ).toDF("_h", "_t", "_seg", "_single", "_part", "rests")
    out = at.join(decided, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & F.col("seg").eqNullSafe(F.col("_seg")))
    longer = F.when(F.col("seg").isNull(), F.col("template")).otherwise(
        F.concat("template", F.lit("/"), F.when(F.col("_single"), F.col("rest")).otherwise(F.col("_part"))))
    out = cut(out.select("host", "path", longer.alias("template"), "n", "labelled", "blocked", "rests"))
    release(child, node)
    return out


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    rare: int = 2,
    many: int = 32,
    z2: float = 3.84,
    strength: float = 4.0,
    reject: float = 0.8,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every page.

    Pages under a rule take its verdict and are the labels of the rest. Per host, paths form a tree, and each
    segment of a node is decided by itself, whatever else the node holds: one that looks like an id is
    variable and becomes ``*``, as does one of at most ``rare`` pages where ``many`` such segments show that
    they vary; a branch without a label keeps its name and ends there (``/**``); a branch with
    labels keeps its name if its share of blocked pages differs from that of its labelled siblings together
    (two-proportion test, squared statistic over ``z2``) or it has none, and else merges with those
    it resembles (``+``). So it goes on to the deepest segment; a branch of a single path takes the rest as it is.

    What is left are templates. A template's purity is its share of blocked labelled pages, drawn with the weight
    of ``strength`` pages towards the share of all labelled pages. Pages without a rule are
    blocked when their template has labels of its own and its purity reaches ``reject``. A single label can thus
    never reject a template.

    Counts are combined per distinct path before any shuffle by host, and hosts of any
    size are joined, never gathered. Null and odd urls have an empty host and path,
    rows with null or repeated page_id are judged like others, an empty table gives no
    rows, and other columns are left alone. Without any labelled page nothing is
    blocked but by rule.
    """
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")))
    active = cut(rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")
    ).withColumn("template", F.lit("")))
    settled, level = Pieces(), 0
    while not active.isEmpty():
        level += 1
        step = _next_level(active, level, rare, many, z2)
        settled.add(step.filter("rests").drop("rests"))
        before, active = active, cut(step.filter("not rests").drop("rests"))
        release(before, step)
    paths = settled.all() if level else active
    m = F.lit(float(strength))
    base = paths.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.0)).alias("base")).scalar()
    leaves = paths.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"))
    leaves = cut(leaves.select("_h", "_t", "_l", ((F.col("_b") + m * base) / (F.col("_l") + m)).alias("purity")))
    scored = paths.join(leaves, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    scored = cut(scored.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "template", "purity", (F.col("_l") > 0).alias("_own")))
    judged = F.coalesce("ruled", F.when(F.col("_own") & (F.col("purity") >= reject), "block").otherwise("allow"))
    out = rows.join(scored, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")))
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"), "template", "purity")
