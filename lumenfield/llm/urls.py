"""URL filter: fixed host and path rules first, association rules mined by FP-growth for the rest.

A url's tokens are its host's last two labels, the words of the labels before them, the path's
segments with digits folded, and the names of its query's parameters. Labels say of some pages whether
they are bad. FP-growth sees the bad ones and finds the combinations that a fixed small number of
them share, so that a rare host gives a rule in a table of any size. Rules stay if their confidence
and lift over all labelled pages suffice and no shorter rule of at least the same confidence is
contained in them. They are matched through an inverted index: each rule hangs from the token that
fewest urls hold, a url's tokens look up that index, and a rule fires when all its tokens are there.

Tokens that the same labelled pages hold count as one, the first in the alphabet: a long path that many
bad pages repeat gives one item instead of a power of two of combinations. A rule has ``ITEMS``
items at most; the number of rules grows with the number of bad hosts and paths.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict
allow. Labels other than 0 and 1 and null ids do not teach; of contradicting labels the higher counts.
Without labels of both kinds, or with fewer than ``LEAST_COUNT`` bad pages, no rule is mined. Of rules
of one confidence the last in the alphabet is named. Repeated rows get equal verdicts. An empty table of pages gives
no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LEAST_COUNT, CONFIDENCE, LIFT, ITEMS = 5, 0.8, 1.5, 4


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null; ties in length go to the longer host, then block."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block")):
        inside = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(inside, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def tokens(url: Column) -> Column:
    """Distinct tokens of a url, sorted."""
    host, path = split_url(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    some = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    folded = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    domain = F.array(F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), "."))
    inner = F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0)))
    words = F.transform(F.flatten(F.transform(inner, lambda x: F.split(x, "[-_]"))), folded)
    steps = F.transform(F.split(path, "/"), folded)
    names = F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0])
    every = F.concat(some("domain", domain), some("word", words), some("step", steps), some("query", names))
    return F.when(host != "", F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def document_number(url: Column) -> Column:
    """The number that the first path segment with leading digits starts with; null without one."""
    return F.regexp_extract(split_url(url)[1], "/([0-9]+)", 1).try_cast("long")


def distinct_in(sets: DataFrame) -> DataFrame:
    """(token) of sets (items, pages): of tokens that lie in the same sets, only the first in the alphabet."""
    terms = sets.select(F.explode("items").alias("token"), *[F.xxhash64("items", F.lit(salt)).alias(f"h{salt}") for salt in (1, 2)])
    where = terms.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    return where.groupBy("n", "h1", "h2").agg(F.min("token").alias("token")).select("token")


def counted(sets: DataFrame, wanted: DataFrame, items: int) -> DataFrame:
    """(antecedent, pages) of the wanted combinations among (items, pages), items sorted.

    Combinations grow token by token and only along wanted ones, whose beginnings are wanted too.
    """
    level = sets.select("pages", F.array().cast("array<string>").alias("antecedent"), F.col("items").alias("rest"))
    out = None
    for _ in range(items):
        step = level.select("pages", "antecedent", "rest", F.posexplode("rest").alias("at", "token"))
        step = step.select("pages", F.array_append("antecedent", F.col("token")).alias("antecedent"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))
        level = step.join(wanted.select("antecedent"), "antecedent", "left_semi")
        found = level.groupBy("antecedent").agg(F.sum("pages").alias("pages"))
        out = found if out is None else out.unionByName(found)
    return out


def mine(pages: DataFrame, labels: DataFrame, count: int = LEAST_COUNT, confidence: float = CONFIDENCE, lift: float = LIFT, items: int = ITEMS) -> DataFrame:
    """rule_id, antecedent (array), confidence, lift, support of the pruned blocking rules.

    labels: (page_id, bad), bad 1 for pages to block, 0 for others. FP-growth sees the bad pages and
    finds what ``count`` of them share, at every size of the table; confidences are exact counts over all labelled pages.
    """
    known = labels.where("page_id is not null and bad in (0, 1)").groupBy("page_id").agg(F.max("bad").alias("bad"))
    work = Workspace(pages.sparkSession, "urls")
    sets = pages.join(known, "page_id").groupBy(tokens(F.col("url")).alias("items")).agg(F.count("*").alias("pages"), F.sum("bad").alias("bad"))
    sets = work.save(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    total, bad = sets.agg(F.sum("pages"), F.sum("bad")).first()
    # a combination seen on a few pages only says nothing, however small the table
    if (bad or 0) < count:
        return pages.sparkSession.createDataFrame([], "rule_id string, antecedent array<string>, confidence double, lift double, support double")
    terms = sets.where("bad > 0").select("set", "bad", F.explode("items").alias("token"))
    deals = terms.join(distinct_in(sets), "token", "left_semi").groupBy("set", "bad").agg(F.collect_list("token").alias("items"))
    deals = work.save(deals.select("items", F.explode(F.sequence(F.lit(1), F.col("bad"))).alias("_")).select("items"), "deals")
    # half a page less, so that no rounding of the quotient asks for one more
    model = FPGrowth(itemsCol="items", minSupport=(count - 0.5) / bad).fit(deals)
    common = model.freqItemsets.where(F.size("items") <= items).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("bad"))
    common = work.save(common, "common")
    rules = common.join(counted(sets, common, items), "antecedent").withColumn("confidence", F.col("bad") / F.col("pages"))
    rules = rules.select("antecedent", "confidence", (F.col("confidence") * total / bad).alias("lift"), (F.col("bad") / total).alias("support"))
    rules = work.save(rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift)), "rules")
    # a rule that holds a shorter one of the same strength adds nothing; subsets are found by equi-join
    n = F.size("antecedent")
    masks = F.explode(F.sequence(F.lit(1), F.pow(2, n).cast("int") - 2))
    smaller = rules.where(n > 1).select("antecedent", "confidence", masks.alias("mask"))
    chosen = F.expr("filter(antecedent, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    smaller = smaller.select(F.col("antecedent").alias("whole"), F.col("confidence").alias("own"), chosen.alias("antecedent"))
    beaten = smaller.join(rules.select("antecedent", "confidence"), "antecedent").where("confidence >= own").select(F.col("whole").alias("antecedent")).distinct()
    left = rules.join(beaten, "antecedent", "left_anti")
    return left.select(F.sha2(F.array_join("antecedent", "\n"), 256).alias("rule_id"), "antecedent", "confidence", "lift", "support")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id and the strongest mined rule that its url satisfies, by inverted index.

    The url is judged once for each distinct set of tokens; the index maps a rule's rarest token to the rule.
    """
    sets = pages.select(tokens(F.col("url")).alias("items")).distinct()
    terms = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    postings = sets.select(F.explode("items").alias("token"), "items").join(terms.select("token").distinct(), "token", "left_semi")
    # of a rule's tokens the one that fewest urls hold is looked up; one that none holds cannot fire
    often = postings.groupBy("token").agg(F.count("*").alias("often"))
    key = terms.join(often, "token").groupBy("rule_id").agg(F.min(F.struct("often", "token"))["token"].alias("token"), F.first("antecedent").alias("antecedent"), F.first("confidence").alias("confidence"))
    hits = postings.join(key, "token").where(F.size(F.array_except("antecedent", "items")) == 0)
    return hits.groupBy("items").agg(F.max(F.struct("confidence", F.array_join("antecedent", " & ").alias("mined")))["mined"].alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, fixed=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the association rule that blocks, else null).

    labels: (page_id, bad), bad 1 for pages to block, 0 for others.
    """
    rows = pages.select("page_id", "url")
    known = labels.where("page_id is not null")
    found = matched(rows, mine(rows, known)).withColumnRenamed("items", "_items")
    host, path = split_url(F.col("url"))
    out = rows.select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("_items"))
    out = out.withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), fixed)).join(found, "_items", "left")
    by_method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce("_fixed.verdict", by_method).alias("verdict"), F.when(F.col("_fixed").isNull(), F.col("mined")).alias("mined"))
