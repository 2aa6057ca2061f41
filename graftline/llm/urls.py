"""URL filters: rules for hosts and paths, and a logistic regression for the rest.

The model sees hashed character n-grams of host and path. It is trained from a
small labelled table of urls, ``(url, label)`` with 1 for block, of which at most
``max_rows`` by a hash order are used; scoring covers every row.

Defined results: a null url, or one without ``://``, has empty host and path; no
rule fits it, and the model judges it by its intercept; a table of labels that is
empty or of one label gives a model that answers with that label (allow if there
is none); repeated rows are judged each, urls of any length whole; an empty table
gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


@dataclass(frozen=True)
class Rule:
    """``site`` is a host and a path after it, such as ``example.org/es/``."""

    verdict: str
    site: str


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


@dataclass(frozen=True)
class Learning:
    """``features``: size of the hashed space, which bounds the model; ``max_rows``:
    labelled rows used at most."""

    features: int = 1 << 16
    least: int = 3
    most: int = 5
    max_rows: int = 20_000
    steps: int = 30
    penalty: float = 1e-4


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits: a struct of ``length, rule, verdict``, or null."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")

    def fits(rule: Rule) -> Column:
        site, slash, rest = rule.site.partition("/")
        here = (host == site) | host.endswith("." + site)
        return F.when(here & path.startswith(slash + rest), F.struct(F.lit(len(rule.site)).alias("length"), F.lit(rule.site).alias("rule"), F.lit(rule.verdict).alias("verdict")))

    return F.array_max(F.array(*map(fits, rules)))


def ngrams(host: Column, path: Column, learning: Learning) -> Column:
    """Character n-grams of host and path, each marked with where it is from."""

    def of(text: Column, mark: str) -> Column:
        ends = F.concat(F.lit("^"), text, F.lit("$"))
        runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(ends) - (n - 1))), lambda i, n=n: F.concat(F.lit(mark), F.substring(ends, i, F.lit(n)))) for n in range(learning.least, learning.most + 1)]
        return F.concat(*runs)

    return F.concat(of(host, "h"), of(path, "p"))


class UrlModel:
    """A trained model, or the one label that all training rows had."""

    def __init__(self, learning: Learning, model=None, label: int = 0):
        self.learning, self.model, self.label = learning, model, label

    def judge(self, rows: DataFrame, host_col: str = "host", path_col: str = "path") -> DataFrame:
        """Adds ``blocked`` to rows that have host and path; other columns, whatever
        their names but ``blocked``, are left alone."""
        if self.model is None:
            return rows.withColumn("blocked", F.lit(bool(self.label)))
        own = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), ngrams(rows[host_col], rows[path_col], self.learning).alias("_grams"))
        judged = self.model.setPredictionCol("_prediction").transform(_hashed(own, self.learning))
        return judged.select("_row.*", (F.col("_prediction") > 0.5).alias("blocked"))


def _hashed(rows: DataFrame, learning: Learning) -> DataFrame:
    from pyspark.ml.feature import HashingTF

    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=learning.features, binary=True).transform(rows)


def train(labelled: DataFrame, learning: Learning = Learning(), url_col: str = "url", label_col: str = "label") -> UrlModel:
    """Fit the model to ``labelled``; rows without a label are left out."""
    from pyspark.ml.classification import LogisticRegression

    rows = labelled.select(host(labelled[url_col]).alias("host"), path(labelled[url_col]).alias("path"), labelled[label_col].cast("double").alias("label")).where("label is not null").distinct()
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(learning.max_rows)
    rows = rows.select("label", ngrams(F.col("host"), F.col("path"), learning).alias("_grams")).checkpoint()
    labels = [r[0] for r in rows.select("label").distinct().collect()]  # two at most
    if len(labels) < 2:
        return UrlModel(learning, label=int(labels[0]) if labels else 0)
    fit = LogisticRegression(featuresCol="_features", labelCol="label", maxIter=learning.steps, regParam=learning.penalty, standardization=False)
    return UrlModel(learning, fit.fit(_hashed(rows, learning)))


def labelled_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """A table of urls that curated rules have labelled, for want of one by hand."""
    fit = fitting_rule(host(pages[url_col]), path(pages[url_col]), rules)
    return pages.select(pages[url_col].alias("url"), fit.alias("fit")).where("fit is not null").select("url", (F.col("fit.verdict") == "block").cast("int").alias("label"))


def held_out(labelled: DataFrame, learning: Learning = Learning(), folds: int = 5, url_col: str = "url", label_col: str = "label") -> DataFrame:
    """``(label, blocked, n)``: how a model that has learnt from all urls but one
    of ``folds`` parts judges that part. Parts are dealt by host and path, so a
    url that repeats is on one side only; rows without a label are left out."""
    rows = labelled.select(labelled[url_col].alias("url"), labelled[label_col].cast("int").alias("label")).where("label is not null")
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    aside = F.pmod(F.xxhash64("host", "path", F.lit(3)), F.lit(folds)) == 0
    judged = train(rows.where(~aside), learning).judge(rows.where(aside))
    return judged.groupBy("label", "blocked").agg(F.count("*").alias("n"))


def judge(pages: DataFrame, model: UrlModel, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row."""
    rows = pages.select(pages[id_col].alias("page_id"), host(pages[url_col]).alias("host"), path(pages[url_col]).alias("path"))
    judged = model.judge(rows).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
