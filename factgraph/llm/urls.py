"""Operator 4, URL filters: association rules, with DataFrame functions and Spark's FP-growth.

Tokens of labelled URLs, each with the item ``#bad`` if its label is bad, are mined by FP-growth for
rules (tokens => ``#bad``).  Only tokens that enough bad URLs hold can stand in a rule; of a URL with more
than ``Params.width`` of them FP-growth gets the rarest, which bounds the item sets of one URL.  That
changes no count of a set that no bad URL so cut holds; the sets that one holds are grown by ``grow``, from whole
URLs.  The rules found are counted again over all labelled URLs, pruned by support, confidence and conviction,
and a rule that holds a smaller one is dropped.  An inverted index lists each rule under its rarest token
alone; a URL meets the rules of its tokens there and is blocked if it holds all tokens of one.

Listed host and path rules come first: the longest that fits decides.  The label of a page is that of
the document with its id: bad if its quality is 0 or it is toxic.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no listed rule and
has only the tokens it is made of; a URL is read whole; equal rows get equal results; repeated labels
of one id count as bad if one of them is; null labels count as good; repeated pages count each; empty
tables give no mined rules or an empty result.  Only named columns are read, so other columns cannot
clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, small, spread_join

#: (verdict, host, path)
LISTED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BAD = "#bad"
#: Labelled URLs a task of FP-growth reads; rules of an index that is broadcast.
MINED_ROWS, INDEXED = 200_000, 100_000


@dataclass(frozen=True)
class Params:
    """Limits of a mined rule, and of the tokens of a labelled URL that FP-growth gets (``grow`` mines wider ones).

    Support is the share (and number) of labelled URLs that hold the rule's tokens and are bad.  Conviction is the
    share of good URLs by that of good ones among the URLs the rule meets: it can be met at any share of bad ones.
    """

    min_support: float = 0.002
    min_count: int = 30
    min_confidence: float = 0.6
    min_conviction: float = 1.5
    width: int = 12


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: runs of letters, and one for the kind of digits-only runs."""
    runs = F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(runs, lambda x: x != ""), lambda x: F.when(F.regexp_like(x, F.lit(r"^\p{N}+$")), F.concat(F.lit("0*"), F.length(x).cast("string"))).otherwise(x)))


def mine(urls: DataFrame, bad: str, p: Params, scratch: Scratch) -> DataFrame:
    """Rules (rule, tokens, n, confidence, support) mined from (url, bad boolean)."""
    base = urls.agg(F.count("*").alias("n"), F.sum(F.col(bad).cast("long")).alias("b")).first()
    n, b = base["n"], base["b"] or 0
    least = max(p.min_count, -int(-p.min_support * n // 1))
    held = scratch.write(urls.where("url IS NOT NULL").select(F.monotonically_increasing_id().alias("k"), F.coalesce(F.col(bad), F.lit(False)).alias("bad"), tokens(F.col("url")).alias("own")))
    if b < least:
        return urls.sparkSession.createDataFrame([], "rule string, tokens array<string>, n int, confidence double, support double")
    counts = held.where("bad").select(F.explode("own").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    counts = scratch.write(counts)  # at most a URL's tokens by 1 / min_support
    own = held.select("k", "bad", F.explode("own").alias("token")).join(F.broadcast(counts) if small(counts) else counts, "token")
    rarest = F.sort_array(F.collect_list(F.struct("c", "token")))
    whole = scratch.write(own.groupBy("k", "bad").agg(F.transform(rarest, lambda x: x["token"]).alias("rest")))
    items, cut = F.slice("rest", 1, p.width), F.col("bad") & (F.size("rest") > p.width)
    baskets = scratch.write(whole.select(F.when(F.col("bad"), F.array_append(items, F.lit(BAD))).otherwise(items).alias("items")))
    lanes = max(1, -(-n // MINED_ROWS))
    fp = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / baskets.count()), minConfidence=p.min_confidence, numPartitions=max(lanes, baskets.sparkSession.sparkContext.defaultParallelism))
    found = fp.fit(baskets.repartition(lanes)).associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD))
    found = found.select(F.sort_array("antecedent").alias("tokens"))
    if not whole.where(cut).isEmpty():
        weights = [F.count_if("bad").alias("hit"), F.count_if(~F.col("bad")).alias("good"), F.count_if(cut).alias("cut")]
        found = found.unionByName(grow(whole.groupBy("rest").agg(*weights), n, b, held.where("NOT bad").count(), least, p, scratch)).distinct()
    found = scratch.write(found.withColumn("rule", F.array_join("tokens", "+")))
    met = holders(held.select("bad", "own"), found, scratch).groupBy("rule").agg(F.count("*").alias("met"), F.count_if("bad").alias("hit"))
    kept = met.where((F.col("hit") >= least) & passes(n, b, p))
    kept = scratch.write(found.join(kept, "rule").select("rule", "tokens", F.size("tokens").alias("n"), (F.col("hit") / F.col("met")).alias("confidence"), (F.col("hit") / n).alias("support")))
    wider = holders(kept.select(F.col("rule").alias("wide"), F.col("tokens").alias("own")), kept.select("rule", "tokens"), scratch).where("rule <> wide").select(F.col("wide").alias("rule")).distinct()
    return kept.join(wider, "rule", "left_anti")


def passes(n: int, b: int, p: Params) -> Column:
    """Whether a set that ``met`` URLs hold, ``hit`` of them bad, has the confidence and the conviction of a rule."""
    good = (F.col("met") - F.col("hit")) * n * p.min_conviction <= F.col("met") * (n - b)
    return (F.col("hit") >= F.col("met") * p.min_confidence) & good


def grow(base: DataFrame, n: int, b: int, good: int, least: int, p: Params, scratch: Scratch) -> DataFrame:
    """The smallest sets (tokens) that pass, among those that a cut bad URL holds, whatever its width.

    base: (rest, hit, good, cut), token lists in one order, and the bad, good and cut bad URLs that have them; good: the good
    URLs.  Sets grow by a token a level, from conditional bases: for the sets of a level (head), the later tokens of the URLs
    that hold them, equal lists as one row.  A set goes on if it does not pass and each of its tokens keeps a good URL away.  No
    other can lie in a smallest set: without a token that keeps none away it has the same good URLs and no fewer bad ones, so
    it passes if the set does.  So tokens that always come together never meet, and a level has only sets whose parts all
    went on.
    """
    sums = [F.sum(c).alias(c) for c in ("hit", "good", "cut")]
    below = held = scratch.write(base.withColumn("head", F.array().cast("array<string>")))
    before = base.sparkSession.range(1).select(F.array().cast("array<string>").alias("part"), F.lit(good).alias("most"))
    found = base.sparkSession.createDataFrame([], "tokens array<string>")
    while True:
        sets = below.withColumn("token", F.explode("rest")).groupBy("head", "token").agg(*sums).where((F.col("hit") >= least) & (F.col("cut") > 0))
        sets = scratch.write(sets.withColumn("tokens", F.array_append("head", F.col("token"))).withColumn("met", F.col("hit") + F.col("good")))
        parts = sets.select("tokens", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("part"))
        parts = parts.join(F.broadcast(before) if small(before, INDEXED) else before, "part")
        parts = parts.groupBy("tokens").agg(F.count("*").alias("parts"), F.min("most").alias("most")).where(F.col("parts") == F.size("tokens"))
        level = scratch.write(sets.join(parts, "tokens").withColumn("rule", passes(n, b, p)))
        found = found.unionByName(level.where("rule").select(F.sort_array("tokens").alias("tokens")))
        on = level.where(~F.col("rule") & (F.col("good") < F.col("most")))
        if on.isEmpty():
            return found
        before = on.select(F.col("tokens").alias("part"), F.col("good").alias("most"))
        heads = on.groupBy("head").agg(F.collect_list("token").alias("on"))
        if small(on, INDEXED):
            rows = below.join(F.broadcast(heads), "head")
        else:
            rows = spread_join(below.withColumn("_deal", F.xxhash64("rest")), heads, ["head"], scratch)
        rows = rows.withColumn("rest", F.array_intersect("rest", "on")).where(F.size("rest") > 1).groupBy("head", "rest").agg(*sums)
        old, held = held, scratch.write(rows)
        scratch.drop(old, sets)
        at = held.select("*", F.posexplode("rest").alias("at", "token")).where(F.col("at") + 1 < F.size("rest"))
        below = at.select(F.array_append("head", F.col("token")).alias("head"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "hit", "good", "cut")


def holders(rows: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (with ``own`` tokens) and the rules of which they hold all tokens, by the inverted index."""
    met = rows.withColumn("token", F.explode("own")).join(index(rules, rows, scratch), "token")
    return met.where(F.size(F.array_except("tokens", "own")) == 0).drop("token", "tokens")


def index(rules: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Inverted index: each rule under the one of its tokens that the fewest rows hold; broadcast if proven small."""
    each = rules.select("rule", "tokens", F.explode("tokens").alias("token"))
    wanted = each.select("token").distinct()
    counts = rows.select(F.explode("own").alias("token")).join(F.broadcast(wanted) if small(wanted) else wanted, "token").groupBy("token").agg(F.count("*").alias("c"))
    rarest = F.min(F.struct(F.coalesce("c", F.lit(0)), F.col("token"))).alias("m")
    out = scratch.write(each.join(counts, "token", "left").groupBy("rule", "tokens").agg(rarest).select("rule", "tokens", F.col("m.token").alias("token")))
    return F.broadcast(out) if small(out, INDEXED) else out


def matches(urls: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """(url, mined_rule): for each URL that holds all tokens of a rule, the first such rule by name."""
    own = urls.select("url", tokens(F.col("url")).alias("own"))
    return holders(own, rules.select("rule", "tokens"), scratch).groupBy("url").agg(F.min("rule").alias("mined_rule"))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest listed rule that fits, as a struct (rule, verdict), or null."""
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = LISTED, p: Params = Params()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for every page.

    labels: rows of (doc_id, quality, toxic).
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    bad = F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long").alias("page_id"), "quality", "toxic").groupBy("page_id").agg(bad.alias("bad"))
    mined = scratch.write(mine(scratch.write(rows.join(known, "page_id").select("url", "bad")), "bad", p, scratch))
    host, path = parts(F.col("url"))
    if mined.isEmpty():
        out = rows.withColumn("mined_rule", F.lit(None).cast("string"))
    else:
        hits = scratch.write(matches(rows.where("url IS NOT NULL").select("url").distinct(), mined, scratch))
        out = spread_join(rows, hits, ["url"], scratch, how="left")
    out = out.withColumn("host", host).withColumn("path", path)
    out = out.withColumn("_l", listed(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_l.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_l.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
