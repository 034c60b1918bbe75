"""URL filter: explicit rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host and path); the path begins at the first slash.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

FEATURES = 1 << 16
GRAMS = (3, 4, 5)
#: Parts of names from which the labelled table is built: of hosts that sell, cheat or show what isn't wanted, and of others.
BAD = (
    "casino poker slots jackpot betting bets gambling roulette pills meds viagra pharmacy drugs loans payday cash replica rolex watches handbags adult porn sex cams escort dating "
    "warez crack keygen torrent cheats hacks prizes winner giveaway lottery spam clicks tracker popups adserver adult-video hot-singles free-spins cheap-pills free-bets link-farm"
).split()
GOOD = (
    "library museum garden history weather kitchen science travel letters poetry archive theatre village railway bakery harbour orchard painter teacher doctor lawyer parish council journal "
    "gazette courier herald tribune observer chronicle notes recipes birds flowers rivers mountains walking cycling sailing chess music opera ballet school college academy institute "
    "university hospital church castle market garage builder plumber florist bookshop newspaper radio film photo studio design software python data maps city county forest ocean park "
    "farm wine coffee family health sports football tennis runner climber astronomy physics chemistry biology geology language grammar dictionary encyclopedia"
).split()
SYLLABLES = [c + v for c in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "th", "st", "ch") for v in "aeiou"]
BEFORE, AFTER = ("", "best", "my", "the", "online", "top", "new", "e", "real"), ("", "hub", "24", "world", "site", "online", "zone", "club", "now")
ENDS = ("example.com", "example.net", "example.org", "com", "net", "org", "info", "de", "fr", "es", "co.uk")
PREFIXES = ("", "www.", "blog.", "m.")
LANGUAGES = ("en", "de", "fr", "es")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """``(action, rule)`` of the longest rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)

    longest_last = sorted(rules, key=lambda r: (len(r[1]), r[1]))
    none = F.lit(None).cast("struct<action:string,rule:string>")
    return reduce(lambda out, r: F.when(fits(r[1]), F.struct(F.lit(r[0]).alias("action"), F.lit(r[1]).alias("rule"))).otherwise(out), longest_last, none)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, told apart by a prefix."""

    def of(tag: str, text: Column, n: int) -> Column:
        last = F.length(text) - n + 1
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(tag), F.substring(text, i, F.lit(n)))))

    parts = [of(tag, F.concat(F.lit("^"), text, F.lit("$")), n) for tag, text in (("h:", host), ("p:", path)) for n in GRAMS]
    return F.concat(*parts)


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled URL table ``(name, url, label)``, 1 for block, built by rule.

    Each part of a name stands in hosts with and without other words around
    it, under all endings and forms of paths in turn.  Names of plain syllables stand for
    the many that are in no list and are good; there are more good names than bad.
    """
    plain = ["".join(SYLLABLES[(7 * i + 31 * j + i * j) % len(SYLLABLES)] for j in range(2 + i % 3)) for i in range(120)]
    rows, k = [], 0
    for label, names, times in ((1, BAD, 8), (0, GOOD, 6), (0, plain, 6)):
        for name in names:
            for _ in range(times):
                k += 1
                before, after = BEFORE[k % len(BEFORE)], AFTER[(k // 3) % len(AFTER)]
                joined = ("-" if k % 2 else "").join(x for x in (before, name, after) if x)
                n = (37 * k) % 1000
                path = (f"/{LANGUAGES[k % 4]}/{n}", f"/{LANGUAGES[k % 4]}/{n}.html", f"/{LANGUAGES[k % 4]}/{n}/", "/", f"/{2000 + k % 25}/{1 + k % 12}/{n}")[k % 5]
                rows.append(f"('{name}', 'https://{PREFIXES[k % 4]}{joined}.{ENDS[k % len(ENDS)]}{path}', {label}.0D)")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(name, url, label)")


def _hashed(df: DataFrame, host: Column, path: Column) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="__features").transform(df.withColumn("__grams", grams(host, path)))


def train(table: DataFrame, reg: float = 0.001) -> LogisticRegressionModel:
    """Fit on a labelled table of ``url`` and ``label`` (small: one partition, so that the sums have one order)."""
    host, path = host_and_path(F.col("url"))
    return LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", regParam=reg, maxIter=60, standardization=False).fit(_hashed(table.coalesce(1), host, path))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, model: LogisticRegressionModel | None = None, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``.

    The rule's verdict holds, else the model's: block at ``threshold`` or
    more.  Null URLs and those without ``://`` have an empty host and path and
    are judged like others.  Rows are independent; columns of these five names
    are replaced, all others stay.
    """
    model = model or train(labelled(pages.sparkSession))
    host, path = host_and_path(F.col(url_col))
    made = ("host", "path", "rule", "verdict", "score")
    keep = [c for c in pages.columns if c not in made]
    split = pages.select(*keep, host.alias("__host"), path.alias("__path"))
    scored = model.transform(_hashed(split, F.col("__host"), F.col("__path"))).withColumn("__score", vector_to_array("__probability")[1]).withColumn("__rule", rule_for(F.col("__host"), F.col("__path"), rules))
    verdict = F.coalesce(F.col("__rule.action"), F.when(F.col("__score") >= threshold, "block").otherwise("allow"))
    return scored.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), F.col("__score").alias("score"))
