"""Operator 7, URL filter: rules, and for the rest logistic regression on hashed character n-grams of host and path.

DataFrame operations only. The model is trained by stochastic gradient steps inside one SQL expression over a small table
of labelled URLs (a parameter, at most `LIMIT` rows); its weights, one number for each of `SIZE` buckets, become a literal
of the scoring expression, so scoring is a projection without a shuffle.

Results: null URLs and those without `://` have empty host and path and no rule; the model then sees no n-gram and decides
by its intercept. Repeated rows are judged row by row. Of rules of the same length that fit, the one listed first wins.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the contract as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SIZE, LIMIT, ROUNDS = 1024, 500, 30

#: Labelled URLs, invented for training.
BLOCKED = """
http://casino-royal.example.org/play http://best-casino.example.org/bonus/win https://free-casino-slots.example.org/slots http://cheap-pills.example.net/buy
http://buy-pills-online.example.org/order https://pills4you.example.org/cheap/viagra http://adult-cams.example.org/live https://xxx-videos.example.org/hot
http://spam-farm.example.org/links https://link-farm.example.org/page/links http://seo-spam.example.net/backlinks https://win-prize-now.example.org/claim
http://lottery-winner.example.net/claim/prize https://crypto-doubler.example.org/double http://get-rich-fast.example.org/money https://replica-watches.example.net/cheap
http://payday-loans-fast.example.org/apply https://phish-login.example.org/verify/account http://warez-crack.example.org/download/keygen https://torrent-crack.example.net/full/crack
http://sexy-dating.example.org/chat https://poker-bonus.example.net/bonus http://betting-tips-win.example.org/bet https://cheap-viagra-pills.example.net/order
"""
ALLOWED = """
http://library.example.org/en/books https://news.example.org/en/2021/story https://docs.example.net/en/manual http://blog.example.org/de/post/12
https://university.example.org/courses/math http://museum.example.net/en/exhibits https://recipes.example.org/soup/leek http://weather.example.net/en/today
https://wiki.example.org/wiki/history http://science.example.net/articles/physics https://school.example.org/en/lessons http://garden.example.org/plants/roses
https://health.example.org/en/advice http://maps.example.net/city/streets https://forum.example.org/thread/482 http://city-council.example.org/minutes/2020
https://m.travel.example.net/en/guide http://blog.cooking.example.org/fr/recette https://www.history.example.net/en/essay http://music.example.org/concerts/list
https://archive.example.org/en/catalog/77 http://hospital.example.net/en/visit https://theatre.example.org/program http://sports.example.net/de/tabelle
"""


def labelled(spark: SparkSession) -> DataFrame:
    """url, label: 1 for URLs to block."""
    return spark.createDataFrame([(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()], "url string, label int")


def lowered(x: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last that fits wins: the longest, of these the first listed
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def buckets(host: Column, path: Column, size: int = SIZE) -> Column:
    """Distinct buckets of the n-grams (3 to 5 characters) of host and of path; the two do not share n-grams."""
    def grams(mark: str, text: Column, n: int) -> Column:
        at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(size)).cast("int"))

    return F.array_distinct(F.concat(*(grams(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in (3, 4, 5))))


def train(examples: DataFrame, size: int = SIZE, rounds: int = ROUNDS, rate: float = 0.15) -> list[float]:
    """size weights and an intercept, by gradient steps over examples(url, label) in the order of their hash."""
    x = examples.filter(F.col("url").isNotNull() & F.col("label").isNotNull()).orderBy(F.xxhash64("url"), "url", "label").limit(LIMIT)
    x = x.select(F.xxhash64("url").alias("o"), buckets(host_of(F.col("url")), path_of(F.col("url")), size).alias("x"), F.col("label").cast("double").alias("y"))
    rows = x.agg(F.array_sort(F.collect_list(F.struct("o", "y", "x"))).alias("rows"))

    def step(w: Column, row: Column) -> Column:
        z = F.aggregate(row["x"], F.element_at(w, size + 1), lambda acc, b: acc + F.element_at(w, b + 1))
        g = (row["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-z))) * rate
        return F.transform(w, lambda v, i: v * (1 - rate * 1e-3) + F.when(F.array_contains(row["x"], i) | (i == size), g).otherwise(0.0))

    start = F.array_repeat(F.lit(0.0), size + 1)
    order = F.flatten(F.array_repeat(F.col("rows"), rounds))
    found = rows.select(F.aggregate(order, start, step).alias("w")).first()
    return list(found["w"])


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's probability that a URL is to be blocked."""
    w = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    size = len(weights) - 1
    z = F.aggregate(buckets(host, path, size), F.lit(weights[-1]), lambda acc, b: acc + F.element_at(w, b + 1))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judged(pages: DataFrame, examples: DataFrame | None = None, rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row of pages(page_id, url). score: the model's probability."""
    weights = train(examples if examples is not None else labelled(pages.sparkSession))
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    own = own.withColumns({"r": rule_of(host, path, rules), "score": probability(host, path, weights)})
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return own.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")
