"""URL filters by association rules: Spark FP-growth over URL tokens and labels, matched through an inverted index.

Fixed rules are looked at first: a rule fits its host and all subdomains where the path starts with the rule's path, and the
longest that fits decides. Other urls are judged by mined rules: sets of url tokens that come with a bad label in at least
`least_support` of the labelled pages. With them a page must be bad at least `least_confidence` of the time and `least_lift` times as
often as pages are at all, and that twice: among the pages that the sets are mined from and among a third of the labelled pages kept
aside, so that sets which only fit the noise of their labels are pruned. A url that holds all tokens of a rule is blocked, others get the training pages' commoner
verdict. Each rule is listed under the rarest of its tokens, so a url meets only the rules listed under tokens it has.

Null urls and urls without `://` have empty host and path, fit no fixed rule and have no tokens: they get the default verdict.
Repeated rows are judged alike; urls of any length are taken whole, and fixed rules of one length can't both fit (ties). Extra
columns pass through; columns named like the results are replaced. Without labels nothing is mined and the default is allow. An
empty table gives no rows. Labels and pages are joined by id; a label that has no page is not used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, labelled_split

#: (host and path, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Of the ids' crc32 mod 4, what is kept aside for pruning (2 is held out from everything).
ASIDE = 3
#: Rules that may be broadcast: a hundred bytes or so each.
FEW_RULES = 50_000


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without `://`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def fixed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does. Written out for each rule, longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        own = (host == rule[:at]) | host.endswith("." + rule[:at])
        out = F.when(own & path.startswith(rule[at:]), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: all labels of the host, from the last, path words (numbers as one), suffix, and query keys with their values."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.split(path, r"[^\p{L}\p{N}]+"), lambda w: F.concat(F.lit("path:"), F.regexp_replace(F.lower(w), r"^\p{N}+$", "0")))
    query = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^#&]+)"), F.lit(1)), lambda q: F.concat(F.lit("query:"), q))
    shape = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.when(url.contains("#"), F.lit("fragment")))
    both = F.filter(F.concat(labels, words, query, shape), lambda t: t.isNotNull() & ~t.isin("path:", "scheme:"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def mine(pages: DataFrame, labels: DataFrame, least_support: float = 0.01, least_confidence: float = 0.5, least_lift: float = 2.0, page_id: str = "page_id") -> tuple[DataFrame, str]:
    """(rules, default verdict). rules: tokens, listed (the token it is listed under), n_tokens, confidence, lift, support, checked
    (the confidence on the pages kept aside); none contains another. pages has `__tokens`."""
    from pyspark.ml.fpm import FPGrowth

    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~labelled_split())
    known = known.groupBy(F.col("doc_id").alias("__k")).agg((F.min("quality") == 0).alias("bad"))
    aside = F.crc32(F.col("__k").cast("string").cast("binary")) % 4 == ASIDE
    baskets = pages.select(F.col(f"`{page_id}`").alias("__p"), "__tokens").join(known, F.col("__p") == F.col("__k"))
    baskets = cut(baskets.groupBy("__tokens", "bad", aside.alias("aside")).agg(F.count("*").alias("n")), "baskets")
    n, bad, all_bad, all_n = baskets.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (~F.col("aside"), ~F.col("aside") & F.col("bad"), F.col("bad"), F.lit(True)))).first()
    default = "block" if 2 * all_bad > all_n else "allow"
    none = "tokens array<string>, listed string, n_tokens int, confidence double, lift double, support double, checked double"
    if not bad or bad < least_support * n:
        return pages.sparkSession.createDataFrame([], none), default
    base = bad / n
    # A rule's support counts baskets with its tokens and the label, so only bad baskets can give frequent ones. Sets are mined
    # there; how often their tokens appear in all baskets is counted afterwards.
    each = baskets.where("bad and not aside").select(F.col("__tokens").alias("items"), F.explode(F.sequence(F.lit(1), F.col("n"))))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least_support * n / bad), minConfidence=0.0).fit(each.select("items")).freqItemsets
    sets = cut(sets.select(F.array_sort("items").alias("tokens"), "freq"), "sets")
    single = sets.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("t"), F.col("freq").alias("f"))
    rarest = sets.select("tokens", F.explode("tokens").alias("t")).join(single, "t").groupBy("tokens").agg(F.min_by("t", F.struct("f", "t")).alias("listed"))
    rarest = cut(rarest, "sets")
    when = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    counted = matches(baskets, rarest).groupBy("tokens", "listed").agg(
        when("not aside").alias("had"), when("not aside and bad").alias("hit"), when("aside").alias("had_aside"), when("aside and bad").alias("hit_aside"))
    confidence, checked = F.col("hit") / F.col("had"), F.when(F.col("had_aside") > 0, F.col("hit_aside") / F.col("had_aside"))
    rules = counted.select("tokens", "listed", F.size("tokens").alias("n_tokens"), confidence.alias("confidence"), (confidence / base).alias("lift"), (F.col("hit") / n).alias("support"), checked.alias("checked"))
    least = max(least_confidence, least_lift * base)
    rules = cut(rules.where((F.col("confidence") >= least) & (F.col("support") >= least_support) & (F.col("checked") >= least)), "rules")
    # A rule is pruned if a smaller one matches its tokens: that one blocks all it would.
    wider = matches(rules.select(F.col("tokens").alias("__tokens"), F.col("n_tokens").alias("m")), rules).where("n_tokens < m")
    return cut(rules.join(wider.select(F.col("__tokens").alias("tokens")).distinct(), "tokens", "left_anti"), "rules"), default


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of pages joined with each rule (tokens, listed, ...) whose tokens are all in `__tokens`, of any number and size."""
    entries = pages.withColumn("__t", F.explode("__tokens"))
    if rules.limit(FEW_RULES + 1).count() <= FEW_RULES:
        rules = F.broadcast(rules)
    return entries.join(rules, F.col("__t") == F.col("listed")).where(F.size(F.array_except("tokens", "__tokens")) == 0).drop("__t")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", page_id: str = "page_id", **how) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block)."""
    made = {"host", "path", "rule", "verdict"}
    rest = [f"`{c}`" for c in pages.columns if c not in made]
    host, path = parts(F.col(f"`{url}`"))
    found = pages.select(*rest, host.alias("host"), path.alias("path"), F.col(f"`{url}`").alias("__u"))
    found = found.select("*", fixed(F.col("host"), F.col("path"), rules).alias("__fixed"), tokens(F.col("__u"), F.col("host"), F.col("path")).alias("__tokens"))
    mined, default = mine(found.select(f"`{page_id}`", "__tokens"), labels, page_id=page_id, **how)
    if mined.isEmpty():
        other = F.lit(default)
    else:
        # Equal token sets are matched once, and found again by the set however many pages have it.
        open_ = found.where("__fixed is null")
        sets = open_.groupBy("__tokens").agg(F.count("*").alias("__n"))
        hit = matches(sets, mined).select("__tokens").distinct().withColumn("__hit", F.lit(True))
        sets = cut(sets.join(hit, "__tokens", "left").select("__tokens", F.coalesce("__hit", F.lit(False)).alias("__hit"), "__n"), "urls")
        open_ = join_hot(open_, sets, "__tokens", "__n", sets.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])
        found = open_.unionByName(found.where("__fixed is not null").withColumn("__hit", F.lit(False)))
        other = F.when(F.col("__hit"), "block").otherwise(default)
    return found.select(*rest, "host", "path", F.col("__fixed.rule").alias("rule"), F.coalesce(F.col("__fixed.verdict"), other).alias("verdict"))
