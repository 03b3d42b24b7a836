"""Operator 9: URL filtering by listed rules and by association rules.

Listed rules (host and path) come first, the longest that fits wins. Other urls are
judged by rules that FP-growth mines from labelled pages: combinations of url tokens
that go along with bad labels, kept at a least support, confidence and lift. A mined
rule is indexed under its rarest token; urls look up their tokens there and are checked
against the whole combination. Equal token sets are looked up once, so a hot host costs
one row. What no rule blocks is allowed.

Null urls and urls without ``://`` have an empty host and path and no tokens: allowed.
With no labels, or none that is bad, nothing is mined. Repeated rows are judged alike.
Other columns are not read.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.scratch import cut, tidy

#: A combination must stand in this share of the labelled urls, and in this many.
MIN_SUPPORT, MIN_COUNT = 0.005, 20
MIN_CONFIDENCE = 0.5
#: Listed rules become one expression; a longer list belongs in a joined table.
MAX_LISTED = 1000
BLOCK, ALLOW = "=block", "=allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url="url") -> dict:
    """Host, path and tokens of a url."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    tail = F.translate(F.regexp_extract(rest, r"^[^?#]*([\s\S]*)", 1), UPPER, LOWER)

    def tokens(text, kind):
        found = F.regexp_extract_all(text, F.lit("[a-z][a-z-]+"), F.lit(0))
        return F.transform(found, lambda t: F.concat(F.lit(kind), t))

    low = F.translate(path, UPPER, LOWER)
    items = F.array_sort(F.array_distinct(F.concat(tokens(host, "h:"), tokens(low, "p:"), tokens(tail, "q:"))))
    return {"host": host, "path": path, "tokens": items}


def listed_rule(rules: list[tuple[str, str, str]]):
    """The longest rule (verdict, host, path) that fits columns host and path, as a struct."""
    if len(rules) > MAX_LISTED:
        raise ValueError("too many listed rules for one expression")
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        chosen = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def mine(labelled: DataFrame) -> DataFrame:
    """(antecedent, n_all, n_bad) of the rules that (tokens, bad) support."""
    items = cut(
        labelled.select(F.array_append("tokens", F.when(F.col("bad"), BLOCK).otherwise(ALLOW)).alias("items"))
    )
    total = items.count()
    bad = items.where(F.array_contains("items", BLOCK)).count()
    least = max(MIN_COUNT, -(-total * MIN_SUPPORT // 1))
    if not bad or total < least:
        return items.sparkSession.createDataFrame([], "antecedent array<string>, n_all long, n_bad long")
    # Half a row below, so that rounding does not raise the least count.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=MIN_CONFIDENCE).fit(items)
    sets = cut(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_bad = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1))
    with_bad = with_bad.select(F.array_remove("items", BLOCK).alias("antecedent"), F.col("freq").alias("n_bad"))
    rules = with_bad.join(sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("n_all")), "antecedent")
    sure = F.col("n_bad") >= MIN_CONFIDENCE * F.col("n_all")
    lifts = F.col("n_bad") * F.lit(total) > F.lit(bad) * F.col("n_all")
    return cut(rules.where(sure & lifts).select("antecedent", "n_all", "n_bad"))


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, confidence, antecedent) of the surest rule within each token set."""
    tokens = rules.select(F.explode("antecedent").alias("token"), "n_all", F.size("antecedent").alias("size"))
    # The rarest token is the one with the fewest rows in any rule that has it alone, else in its smallest rule.
    rarity = tokens.groupBy("token").agg(F.min_by("n_all", F.struct("size", "n_all")).alias("rows"))
    keyed = (
        rules.withColumn("token", F.explode("antecedent"))
        .join(rarity, "token")
        .groupBy("antecedent", "n_all", "n_bad")
        .agg(F.min_by("token", F.struct("rows", "token")).alias("token"))
    )
    looked = token_sets.distinct().withColumn("token", F.explode("tokens")).join(keyed, "token")
    fits = looked.where(F.size(F.array_except("antecedent", "tokens")) == 0).withColumn("confidence", F.col("n_bad") / F.col("n_all"))
    best = F.max_by(F.struct("confidence", "antecedent"), F.struct("confidence", "n_bad", "antecedent")).alias("best")
    return fits.groupBy("tokens").agg(best).select("tokens", "best.*")


@tidy
def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence, antecedent) for every (page_id, url).

    ``labels`` has (page_id, bad): rows with a null in either are passed over, a page with
    several labels counts with each.
    """
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    split = cut(read.withColumns(parts()).withColumn("listed", listed_rule(rules)))
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL")
    mined = mine(split.join(known, "page_id").select("tokens", "bad"))
    judged = split.join(match(split.where("listed IS NULL").select("tokens"), mined), "tokens", "left")
    mined_verdict = F.when(F.col("antecedent").isNotNull(), "block").otherwise("allow")
    own = F.col("listed").isNull()
    return judged.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", mined_verdict).alias("verdict"),
        F.when(own, F.col("confidence")).alias("confidence"), F.when(own, F.array_join("antecedent", " ")).alias("antecedent"),
    )
