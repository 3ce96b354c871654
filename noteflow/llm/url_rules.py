"""URL filtering by association rules over URL tokens.

Spark's FP-growth mines frequent token combinations of labelled URLs together with the mark
``bad``; the rules "these tokens -> bad" that keep enough support and confidence, and say more
than a rule with fewer tokens, block a URL.  Tokens that all bad URLs hold together or not at all, such as the
labels of one host, are mined as one item and told apart afterwards.  Rules are found through an inverted index: each is
filed under its rarest token, a URL looks up its own tokens, and the rest is compared there.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import store

BAD = "=bad"  # no URL token holds "="

# host suffix and path start of the base rules, with their verdicts (fixed values)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def base_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Longest fitting base rule (host and path as text) and its verdict, both null without one."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels and suffixes, path words by depth, query and fragment names; digits as 0."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host, path = url_parts(url)
    plain = lambda c: F.regexp_replace(F.lower(c), r"\d+", "0")
    labels = F.filter(F.split(host, r"\."), lambda t: t != "")
    suffix = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("s:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(labels, lambda t: F.concat(F.lit("h:"), t))
    pieces = F.flatten(F.transform(labels, lambda t: F.transform(F.split(t, "[-_]"), lambda p: F.concat(F.lit("w:"), p))))
    steps = F.filter(F.split(plain(path), "/"), lambda t: t != "")
    steps = F.transform(steps, lambda t, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), t))
    names = F.transform(F.regexp_extract_all(plain(F.regexp_extract(url, r"\?([^#]*)", 1)), F.lit(r"([^&=]+)"), F.lit(1)), lambda t: F.concat(F.lit("q:"), t))
    mark = F.transform(F.filter(F.array(plain(F.regexp_extract(url, r"#(.*)", 1))), lambda t: t != ""), lambda t: F.concat(F.lit("f:"), t))
    scheme = F.array(F.concat(F.lit("u:"), F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))))
    every = F.concat(scheme, words, pieces, suffix, steps, names, mark)
    return F.array_distinct(F.transform(every, lambda t: F.replace(t, F.lit("="), F.lit("~"))))


def token_sets(classes: list[list[str]], length: int) -> list[list[str]]:
    """All sets of at most ``length`` tokens with at least one of each class."""
    ways = [[c for k in range(1, length - len(classes) + 2) for c in combinations(tokens, k)] for tokens in classes]
    return [sorted(t for part in parts for t in part) for parts in product(*ways) if sum(map(len, parts)) <= length]


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", support: int = 5, confidence: float = 0.5, odds: float = 2.0,
         length: int = 3) -> DataFrame:
    """Rules as rows: rule (sorted tokens), key (its rarest token), support, confidence, odds.

    ``support`` is the least number of bad URLs that hold the rule's tokens.  A rule needs ``confidence``,
    odds of being bad at least ``odds`` times those of all labelled URLs (which a rule can have at any share
    of bad URLs), at most ``length`` tokens, and more confidence than every mined rule made of some of its
    tokens.  Tokens that fewer bad URLs hold than the support asks for cannot be in a rule and are left
    out before mining.  Rows with a null url or mark are not used; without bad URLs, or without
    good ones to tell them from, there is no rule.
    """
    schema = "rule array<string>, key string, support double, confidence double, odds double"
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(url_col).isNotNull() & F.col(bad_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), url_tokens(F.col(url_col)).alias("tokens"), (F.col(bad_col) > 0).alias("bad"))
    rows = store(rows, "labelled")
    n, bad = rows.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("long"))).first()
    if not bad or bad == n:
        return spark.createDataFrame([], schema)
    # a token's bad URLs, by their number and two sums of 40-bit hashes: equal for tokens that always occur together
    tokens = rows.select("row", "bad", F.explode("tokens").alias("token"))
    mark = F.when(F.col("bad"), F.xxhash64("row"))
    low, high = F.sum(mark.bitwiseAND(F.lit((1 << 40) - 1))), F.sum(F.shiftrightunsigned(mark, 24))
    counts = tokens.groupBy("token").agg(F.count(mark).alias("bad"), F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"))
    counts = store(counts.filter(F.col("bad") >= support), "tokens")
    classes = store(counts.groupBy("bad", "low", "high").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")), "classes")
    baskets = tokens.filter("bad").join(classes.select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    baskets = baskets.select(F.concat("items", F.array(F.lit(BAD))).alias("items"))
    # sets of bad URLs alone give the rules; how many URLs hold each is counted afterwards over all rows
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (support - 0.5) / bad), minConfidence=0.0).fit(baskets)
    sets = model.freqItemsets.select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("hits")).filter(
        F.size("items").between(1, length)).distinct()

    @F.udf("array<array<string>>", useArrow=False)
    def unfolded(members):
        return token_sets(members, length)

    members = sets.select("items", "hits", F.explode("items").alias("item")).join(classes.select("item", "members"), "item")
    members = members.groupBy("items", "hits").agg(F.collect_list("members").alias("members"))
    sets = members.select("hits", F.explode(unfolded("members")).alias("rule"))
    rarest = sets.select("rule", "hits", F.explode("rule").alias("token")).join(counts.select("token", "n"), "token")
    sets = store(rarest.groupBy("rule", "hits").agg(F.min_by("token", F.struct("n", "token")).alias("key")), "itemsets")
    # few bytes, but many rules to compare with: dealt to all tasks
    spread = rows.select("row", "tokens").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")
    held = matches(spread, sets.select("rule", "key"), "row").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    rules = sets.join(held, "rule").select("rule", "key", (F.col("hits") / n).alias("support"), (F.col("hits") / F.col("n")).alias("confidence"),
                                           F.coalesce(F.try_divide(F.col("hits") * (n - bad), (F.col("n") - F.col("hits")) * bad), F.lit(float("inf"))).alias("odds"))
    strong = store(rules.filter((F.col("confidence") >= confidence) & (F.col("odds") >= odds)), "rules")
    # at most 2**length smaller rules each, found by equality
    bits = F.explode(F.sequence(F.lit(1), F.expr("cast(power(2, size(rule)) as int) - 2")))
    parts = strong.filter(F.size("rule") > 1).select("rule", "confidence", bits.alias("mask"))
    parts = parts.select("rule", "confidence", F.filter("rule", lambda t, i: F.expr("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0).alias("part"))
    beaten = parts.join(strong.select(F.col("rule").alias("part"), F.col("confidence").alias("c")), "part").filter("c >= confidence").select("rule").distinct()
    return strong.join(beaten, "rule", "left_anti").select("rule", "key", "support", "confidence", "odds")


def matches(rows: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """id_col and the columns of ``rules`` for every rule whose tokens are all among the row's ``tokens``.

    Tokens meet the rules filed under them in a join that adaptive execution may broadcast when
    the rules are small and split where a token is frequent.
    """
    ask = rows.select(id_col, "tokens", F.explode("tokens").alias("key"))
    return ask.join(rules, "key").filter(F.size(F.array_except("rule", "tokens")) == 0).drop("tokens")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", base: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence of every row.

    A fitting base rule decides; otherwise a URL that any mined rule matches is blocked (the
    most confident one, ties to the smallest text, is named in ``mined``) and others are
    allowed.  A null url or one without ``://`` has empty parts, fits no rule and is allowed.
    Repeated rows give equal rows; an empty table an empty one; other columns are not read.
    """
    host, path = url_parts(F.col(url_col))
    rule, verdict = base_rule(F.col("host"), F.col("path"), base)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(F.col(url_col)).alias("tokens"))
    rows = rows.withColumn("rule_", rule).withColumn("verdict_", verdict)
    asked = rows.filter("verdict_ is null and host <> ''").select("tokens").distinct()
    asked = asked.select(F.xxhash64("tokens").alias("set"), "tokens")
    hits = matches(asked, rules, "set").groupBy("set").agg(
        F.min(F.struct((-F.col("confidence")).alias("least"), F.array_join("rule", " ").alias("mined"), "confidence")).alias("best"))
    out = rows.withColumn("set", F.xxhash64("tokens")).join(hits, "set", "left")
    method = F.when(F.col("verdict_").isNull() & (F.col("host") != "") & F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    decided = F.coalesce("verdict_", method)
    mined = F.col("verdict_").isNull() & (F.col("host") != "")
    return out.select("page_id", "host", "path", F.col("rule_").alias("rule"), decided.alias("verdict"),
                      F.when(mined, F.col("best.mined")).alias("mined"), F.when(mined, F.col("best.confidence")).alias("confidence"))
