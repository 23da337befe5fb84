"""URL filtering by a rule list, then by association rules that FP-growth mines from labelled URLs.

All in DataFrame operations. Tokens that always come together are mined as one and told apart again afterwards. A listed rule (host, path) fits its host and every subdomain of it where
the path begins as the rule's does; the longest wins. URLs that no listed rule fits are judged by mined
rules: token combinations that go with a block label, pruned by support, confidence and lift, and by
dropping every rule that a shorter one of no less confidence covers, before any rule leaves Spark. None of those left is cut.
An inverted index from token to rules finds the rules whose tokens a URL has all of. Up to RULES of them stand in the plan as a column
expression; more are joined by token to the distinct token sets. The verdicts are the same.

Defined results. Null URLs and those without ``://`` have an empty host and path, fit no listed rule and
have no tokens: allow. Without labels there are no mined rules: allow. Repeated rows are judged each;
extra columns pass through, and the five columns that are added replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unlike

#: The listed rules and their verdicts.
LISTED = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Mined rules up to this number are an expression in the plan; more are joined.
RULES = 500
SUPPORT, CONFIDENCE, LIFT = 0.005, 0.9, 1.2
BLOCK = "label:block"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda x: len(x[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct words of letters: a host's labels and a path's segments, told apart."""
    letters = lambda c, kind: F.transform(F.filter(F.split(c, "[^a-z]+"), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(letters(host, "host:"), letters(F.lower(path), "path:")))


def twins(labelled: DataFrame) -> DataFrame:
    """(token, twin, all): tokens that the same rows have, under the first of them; ``all`` lists them. Those that stand alone are their own twins.

    Rows are told by their place, and a token's rows by their number and two sums of hashes of the places.
    """
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens"))
    told = rows.select("row", F.explode("tokens").alias("token")).distinct()
    print_ = [F.count("*").alias("n"), *(F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2))]
    same = Window.partitionBy("n", "h1", "h2")
    return told.groupBy("token").agg(*print_).select("token", F.min("token").over(same).alias("twin"), F.array_sort(F.collect_list("token").over(same)).alias("all"))


def spelled(tokens: Column, members: Column) -> Column:
    """Every choice of one member for each of ``tokens``: the rules that a rule over twins stands for."""
    return F.aggregate(F.transform(tokens, lambda t: F.try_element_at(members, t)), F.array(F.array().cast("array<string>")), lambda made, some: F.flatten(F.transform(made, lambda a: F.transform(some, lambda x: F.concat(a, F.array(x))))))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, confidence): the least token combinations that mean block, from ``labelled`` (tokens, label)."""
    spark = labelled.sparkSession
    if labelled.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, confidence double")
    # Tokens that always come together are one item while rules are mined: n of them would be 2^n itemsets.
    held = stored(twins(labelled))
    merged = held.where("token <> twin").select("token", "twin")
    at = F.monotonically_increasing_id()
    rows = stored(labelled.select(at.alias("row"), "tokens", "label"))
    first = rows.select("row", F.explode("tokens").alias("token")).join(merged, "token", "left").groupBy("row").agg(F.collect_set(F.coalesce("twin", "token")).alias("tokens"))
    baskets = rows.select("row", "label").join(first, "row", "left").select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    blocking = stored(rules.where((F.col("consequent")[0] == BLOCK) & (F.col("lift") >= LIFT)).select(F.array_sort("antecedent").alias("tokens"), "confidence"))
    # A rule that covers another has fewer tokens, its first one among the other's.
    shorter = blocking.select(F.col("tokens").alias("few"), F.col("confidence").alias("of"), F.col("tokens")[0].alias("token"))
    covered = blocking.withColumn("token", F.explode("tokens")).join(shorter, "token")
    covered = covered.where((F.size("few") < F.size("tokens")) & (F.col("of") >= F.col("confidence")) & (F.size(F.array_except("few", "tokens")) == 0))
    left = stored(blocking.join(covered.select("tokens").distinct(), "tokens", "left_anti"))
    members = left.select("tokens", "confidence", F.explode("tokens").alias("twin")).join(held.where("token = twin"), "twin")
    members = members.groupBy("tokens", "confidence").agg(F.map_from_entries(F.collect_list(F.struct("twin", "all"))).alias("members"))
    return stored(members.select(F.explode(spelled(F.col("tokens"), F.col("members"))).alias("tokens"), "confidence").select(F.array_sort("tokens").alias("tokens"), "confidence"))


def fitting(words: Column, rules: list[tuple[list[str], float]]) -> Column:
    """The most confident mined rule all of whose tokens are among ``words``, or null: its place in ``rules``, the first of equals."""
    if not rules:
        return F.lit(None).cast("int")
    index: dict[str, list[int]] = {}
    for k, (needs, _) in enumerate(rules):
        for t in needs:
            index.setdefault(t, []).append(k)
    held = F.create_map(*(x for t, ks in index.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    needs = F.array(*(F.lit(len(r)) for r, _ in rules))
    hits = F.flatten(F.filter(F.transform(words, lambda t: F.try_element_at(held, t)), lambda x: x.isNotNull()))
    whole = F.transform(F.array(hits), lambda h: F.filter(F.array_distinct(h), lambda k: F.size(F.filter(h, lambda x: x == k)) == F.get(needs, k)))[0]
    by_confidence = F.array(*(F.lit(c) for _, c in rules))
    ranked = F.transform(whole, lambda k: F.struct(-F.get(by_confidence, k), k.alias("k")))
    return F.array_min(ranked)["k"]


def joined(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined_rule) of the distinct token ``sets`` that a rule fits: the inverted index as a join."""
    name = F.concat_ws(" & ", "needs")
    index = rules.select(F.col("tokens").alias("needs"), "confidence", F.explode("tokens").alias("token"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("tokens", "needs", "confidence").agg(F.count("*").alias("n"))
    best = hits.where(F.col("n") == F.size("needs")).groupBy("tokens").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.size("needs").alias("n"), "needs")).alias("best"))
    return best.select("tokens", F.col("best.needs").alias("needs")).select("tokens", name.alias("mined_rule"))


def judge(pages: DataFrame, rules=LISTED, url: str = "url", most: int = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the tokens of the mined rule that decided, if one did."""
    host, path = parts(F.col(url))
    said_in, tokens_in = unlike(pages, "said"), unlike(pages, "tokens")
    df = pages.withColumns({"host": host, "path": path})
    rule, said = listed(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, said_in: said, tokens_in: tokens(F.col("host"), F.col("path"))})
    learned = mined(df.where(F.col(said_in).isNotNull()).select(F.col(tokens_in).alias("tokens"), F.col(said_in).alias("label")))
    open_ = F.col(said_in).isNull()
    if learned.count() <= most:
        held = sorted(((r.tokens, r.confidence) for r in learned.collect()), key=lambda r: (-r[1], len(r[0]), r[0]))
        names = F.array(*(F.lit(" & ".join(r)) for r, _ in held)) if held else F.array().cast("array<string>")
        df = df.withColumn("mined_rule", F.when(open_, F.get(names, fitting(F.col(tokens_in), held))))
    else:
        fits = joined(df.where(open_).select(F.col(tokens_in).alias("tokens")).distinct(), learned)
        mined_in = unlike(df, "mined")
        fits = fits.select(F.col("tokens").alias(tokens_in), F.col("mined_rule").alias(mined_in))
        df = df.join(fits, tokens_in, "left").withColumn("mined_rule", F.when(open_, F.col(mined_in))).drop(mined_in)
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return df.withColumn("verdict", F.coalesce(said_in, method)).drop(said_in, tokens_in)
