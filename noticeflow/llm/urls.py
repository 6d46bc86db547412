"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Only DataFrame functions touch the URLs.  The model is fitted on a small
labelled URL table (at most ``MAX_LABELLED`` rows), hashed by the same Spark
expressions that later score the pages.

Defined results: NULL, or no ``://``: host and path are empty; such a URL fits
no rule and is judged by the model on empty text (allowed unless the fitted
intercept says otherwise).  Repeated rows are judged alike; extra columns pass.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
BUCKETS = 4096
MAX_LABELLED = 5_000
ROUNDS = 200
RATE = 0.5
DECAY = 1e-4

# The rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))

# Words from which the labelled URL table is made.
BAD_WORDS = ("casino", "poker", "slots", "jackpot", "bets", "betting", "pills", "viagra", "pharma", "spam", "adult",
             "xxx", "porn", "escort", "ads", "track", "click", "loans", "payday", "warez", "crack", "keygen",
             "phish", "malware", "fake", "replica")
BAD_PARTS = ("cheap", "free", "win", "farm", "x", "bonus", "deal", "now", "hot", "easy", "best", "24")
GOOD_WORDS = ("news", "wiki", "library", "museum", "school", "weather", "garden", "travel", "kitchen", "history",
              "science", "sports", "music", "river", "mountain", "city", "health", "archive", "journal", "forum",
              "recipes", "astronomy", "chemistry", "thesis", "theatre", "thermal", "shore", "northern", "station",
              "nation", "another", "leather", "thinner", "stone", "reading", "handle", "notion", "gather")
GOOD_PARTS = ("blog", "www", "m", "docs", "shop", "daily", "open", "public", "national", "our", "the", "local")
# Common English letter pairs, for harmless hosts of no known word.
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it",
         "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le")
TOPS = ("example.com", "example.org", "example.net")
LANGS = ("en", "de", "fr", "es")
ENDS = ("", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top")


def labelled_urls() -> list[tuple[str, int]]:
    """The training table: each word paired in turn with parts, domains, languages and endings."""
    rows = []
    made = tuple(a + b + c for i, a in enumerate(PAIRS) for b, c in [(PAIRS[(7 * i + 1) % 30], PAIRS[(11 * i + 5) % 30]),
                                                                     (PAIRS[(13 * i + 2) % 30], "")])
    for label, words, parts in ((1, BAD_WORDS, BAD_PARTS), (0, GOOD_WORDS, GOOD_PARTS), (0, made, GOOD_PARTS[:6])):
        for i, word in enumerate(words):
            for j, part in enumerate(parts):
                k = 7 * i + 3 * j
                host = (f"{part}-{word}", f"{word}-{part}", f"{part}.{word}", word)[(i + j) % 4]
                rows.append((f"http{'s' * (k % 2)}://{host}.{TOPS[k % 3]}/{LANGS[k % 4]}/{k % 997}{ENDS[k % 6]}",
                             label))
    return rows


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host (or a parent of it) and path start fit; NULL if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"),
                                    F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def buckets(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of host and path, each part with marked ends."""
    def hashed(tag: str, chars: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(chars) - (GRAM - 1), F.lit(1)))
        return F.transform(at, lambda i: F.pmod(
            F.xxhash64(F.lit(tag), F.concat_ws("", F.slice(chars, i, GRAM))), F.lit(BUCKETS)).cast("int"))

    def grams(tag: str, text: Column) -> Column:
        chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
        return F.element_at(F.transform(F.array(chars), lambda cs: hashed(tag, cs)), 1)     # split once

    return F.concat(grams("host", host), grams("path", path))


def train(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> list[float]:
    """Weights (intercept last) of the logistic regression; full-batch gradient steps on the small table."""
    rows = (labelled_urls() if rows is None else rows)[:MAX_LABELLED]
    data = spark.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps([{"url": u, "label": y} for u, y in rows])), "array<struct<url:string,label:int>>")).alias("r"))
    url = F.col("r.url")
    hashed = data.select(F.sort_array(F.array_distinct(buckets(host_of(url), path_of(url)))).alias("b"),
                         F.col("r.label").alias("y"), url.alias("url")).orderBy("url", "y").collect()
    w, bias, seen = [0.0] * BUCKETS, 0.0, [1e-6] * BUCKETS
    bad = max(1, sum(r.y for r in hashed))
    share = {1: 2.0 * bad, 0: 2.0 * max(1, len(hashed) - bad)}       # both labels weigh the same
    for _ in range(ROUNDS):
        grad, grad_bias = [DECAY * x for x in w], 0.0
        for r in hashed:
            z = bias + sum(w[k] for k in r.b) / math.sqrt(len(r.b))
            miss = (1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))) - r.y) / share[r.y]
            grad_bias += miss
            step = miss / math.sqrt(len(r.b))
            for k in r.b:
                grad[k] += step
        for k, g in enumerate(grad):
            if g:
                seen[k] += g * g
                w[k] -= RATE * g / math.sqrt(seen[k])
        bias -= RATE * grad_bias
    return [*w, bias]


def bad_probability(host: Column, path: Column, weights: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")

    def margin(b: Column) -> Column:
        total = F.aggregate(b, F.lit(0.0), lambda acc, k: acc + F.element_at(table, k + 1))
        return total / F.sqrt(F.size(b).cast("double")) + F.lit(weights[-1])

    z = F.element_at(F.transform(F.array(F.array_distinct(buckets(host, path))), margin), 1)
    return 1.0 / (1.0 + F.exp(-z))


def judge(pages: DataFrame, weights: list[float], url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the model's probability of a bad URL."""
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    out = out.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    out = out.withColumn("p_bad", bad_probability(F.col("host"), F.col("path"), weights))
    model = F.when(F.col("p_bad") >= 0.5, "block").otherwise("allow")
    return out.withColumn("rule", F.col("_rule.rule")).withColumn(
        "verdict", F.coalesce(F.col("_rule.verdict"), model)).drop("_rule")
