"""URL verdicts: host and path rules first, then logistic regression on hashed character n-grams. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sondage.functions.columns import quoted

ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule, or null. A rule is (verdict, host followed by the start of a path)."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def grams(host: Column, path: Column, sizes: Sequence[int] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path, marked with the part they come from; ends are marked too, and all digits count as 0."""

    def of(text: Column, mark: str) -> Column:
        whole = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))
        parts = [
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), F.substr(whole, i, F.lit(n))))
            for n in sizes
        ]
        return F.concat(*parts)

    return F.concat(of(host, "h:"), of(path, "p:"))


def split(df: DataFrame, url_column: str = "url") -> DataFrame:
    """``df`` with ``_host`` and ``_path``."""
    url = quoted(url_column).cast("string")
    return df.withColumn("_host", host_of(url)).withColumn("_path", path_of(url))


def bucketed(rows: DataFrame, features: int) -> DataFrame:
    """``rows`` with the hash buckets of ``_grams``, as texts, in ``_buckets``."""
    hashed = HashingTF(numFeatures=features, binary=True, inputCol="_grams", outputCol="_hashed").transform(rows)
    return hashed.withColumn("_buckets", F.transform(F.unwrap_udt("_hashed")["indices"], lambda i: i.cast("string"))).drop("_hashed")


@dataclass
class UrlModel:
    """Regression over those of ``features`` hash buckets that the training urls meet; the weight of any other is zero."""

    features: int
    met: CountVectorizerModel
    regression: LogisticRegressionModel

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.regression.transform(self.met.transform(bucketed(rows, self.features)))


def train(labelled: DataFrame, features: int = 1 << 19, ridge: float = 0.00001, rounds: int = 30) -> UrlModel | None:
    """Model from a small table (url, label: 1 for block, and optionally weight). None if it does not hold both labels.

    There are so many features that n-grams never met seldom share one with those learned. Features are not standardized: the
    penalty then falls on rare n-grams, and the weight goes to those that many urls share. Only the buckets that the table meets
    have a place in the regression, since every step of it brings a number for each place to the driver.
    """
    weight = F.col("weight").cast("double") if "weight" in labelled.columns else F.lit(1.0)
    rows = split(labelled.where("url is not null and label in (0, 1)")).select(grams(F.col("_host"), F.col("_path")).alias("_grams"), F.col("label").cast("double").alias("_label"), weight.alias("_weight"))
    rows = bucketed(rows, features).drop("_grams").cache()
    try:
        if rows.select("_label").distinct().count() < 2:
            return None
        met = CountVectorizer(vocabSize=features, binary=True, inputCol="_buckets", outputCol="_features").fit(rows)
        model = LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_predicted", weightCol="_weight", rawPredictionCol="_raw", probabilityCol="_probability", regParam=ridge, maxIter=rounds, standardization=False)
        return UrlModel(features, met, model.fit(met.transform(rows)))
    finally:
        rows.unpersist()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel | None, cut: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row.

    Where no rule fits, the verdict is ``block`` if the model gives the url a probability of ``cut`` or more, else ``allow``; without
    a model it is ``allow`` and the score null.

    Defined cases: a url that is null or holds no ``://`` has an empty host and path, fits no rule and is scored like any other;
    urls may be of any length; repeated rows each come back; an empty table gives an empty result. Other columns are ignored.
    """
    rows = split(pages).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), grams(F.col("_host"), F.col("_path")).alias("_grams"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = model.transform(rows) if model is not None else rows
    score = vector_to_array("_probability")[1] if model is not None else F.lit(None).cast("double")
    rows = rows.withColumn("block_score", score)
    by_model = F.when(F.col("block_score") >= cut, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return rows.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), by_model).alias("verdict"), "block_score")


# Words of unwanted and of ordinary hosts, and parts of invented names and urls, in the small labelled table.
UNWANTED = """casino poker roulette blackjack baccarat gambling betting bets wager lottery lotto jackpot slots bingo win winner
pills pharmacy viagra cialis meds steroids slimming adult porn sex xxx escort nude webcam hookup erotic
ads adserver adclick banner popup popunder tracker tracking track clicks pixel affiliate
spam farm linkfarm phishing malware virus trojan keylogger exploit spyware botnet
warez torrent crack keygen pirate replica cheap discount counterfeit fake payday loan bonus free freebie prize giveaway scam""".split()
ORDINARY = """news museum garden recipe library school weather travel history science music river kitchen village market letters forum wiki
archive planet books health bridge harbor station theater orchestra county research photo university college hospital academy
society journal city bank insurance energy water forest mountain island ocean summer winter bakery coffee dental clinic church
football cycling running hiking camera design studio gallery fashion flowers furniture electric software cloud data network mobile
engineering factory transport airline hotel restaurant wedding family children animals veterinary farmers agriculture traffic winery
freedom window trackside address download headset broadband freelance adulthood""".split()
_ONSETS = "b c d f g h j k l m n p r s t v w z th sh ch st br tr gr pl cr fl sp".split()
_VOWELS = "a e i o u ea ou ai ee oo".split()
_CODAS = ["", "n", "r", "l", "s", "t", "nd", "st", "ng", "rk", "tion", "ble", "ly", "ck", "m"]
_TOPS = "com net org info io de fr co.uk biz".split()
_SUBS = ["", "www.", "m.", "blog.", "shop.", "en.", "static."]
_PATHS = ["", "/", "/index.html", "/en/#", "/de/#/", "/a/#.html", "/2021/#", "/item?id=#"]


def _pick(words: Sequence[str], *key: Column) -> Column:
    """One of ``words``, by hash of ``key``."""
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(*key), F.lit(len(words))) + 1).cast("int"))


def _invented(*key: Column) -> Column:
    """A pronounceable name of two syllables that is no word of either list but by chance."""
    return F.concat(*[_pick(part, *key, F.lit(k)) for k, part in enumerate((_ONSETS, _VOWELS, _CODAS) * 2)])


def seed_urls(spark: SparkSession, frames: int = 40, others: int = 4, unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """A small labelled table (url, label: 1 for block): ``frames`` urls of each unwanted word, each with ``others`` ordinary twins.

    A twin has the same subdomain, top domain, path and neighbouring name, and differs in its words alone (ordinary or invented
    ones by turns), so that nothing but the words tells the labels apart. No url under judgement is read.
    """
    i, j = F.col("id"), F.col("twin")
    rows = spark.range(0, len(unwanted) * frames, 1, 2).withColumn("twin", F.explode(F.sequence(F.lit(0), F.lit(others))))
    bad = F.element_at(F.array(*map(F.lit, unwanted)), (i % len(unwanted) + 1).cast("int"))

    def word(own: Column, key: int) -> Column:
        return F.when(j == 0, own).when(j % 2 == 0, _pick(ORDINARY, i, j, F.lit(key))).otherwise(_invented(i, j, F.lit(key)))

    path = F.replace(_pick(_PATHS, i, F.lit(6)), F.lit("#"), F.pmod(F.xxhash64(i, F.lit(7)), F.lit(90_000)).cast("string"))
    rows = rows.select(
        "id", "twin", word(bad, 1).alias("a"), word(_pick(unwanted, i, F.lit(2)), 2).alias("b"), _invented(i, F.lit(3)).alias("beside"),
        _pick(_SUBS, i, F.lit(4)).alias("sub"), _pick(_TOPS, i, F.lit(5)).alias("top"), path.alias("path"),
    )
    forms = [F.col("a"), F.concat_ws("-", "a", "b"), F.concat("a", "b"), F.concat_ws("-", "beside", "a"), F.concat_ws("-", "a", "beside")]
    host = F.element_at(F.array(*forms), (F.floor(i / len(unwanted)) % len(forms) + 1).cast("int"))
    url = F.concat(F.lit("http://"), "sub", host, F.lit("."), "top", "path")
    return rows.select(url.alias("url"), (j == 0).cast("int").alias("label"))
