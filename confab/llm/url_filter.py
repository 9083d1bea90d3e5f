"""URL rules, and a logistic regression on hashed character n-grams for urls that no rule fits. Native.

Features, training and scores are SQL expressions; the model is a dense weight array of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm.common import let

#: (verdict, host and path) of the contract; the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SIZES = (3, 4, 5)
BUCKETS = 4096
EPOCHS = 200
#: Steps of the weights and of the bias. Rows have length 1 beside the bias, so that these lie below what full-batch descent on the log loss stays stable at.
RATE, BIAS_RATE = 12.0, 2.0
DECAY = 0.0002
#: The labelled table is fitted whole and must stay this small: it becomes one row of arrays.
MAX_LABELLED = 2000

#: Scores from here on block: of 0.5 to 0.7 by 0.05 the least at which at most 5 % of the labelled table's allowed hosts, held out, are blocked.
THRESHOLD = 0.6

#: The small labelled table: a url and its label (1: block) a line.
LABELLED = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(spark: SparkSession, path: Path = LABELLED) -> DataFrame:
    """url, label (1: block) of the labelled table, read on the driver."""
    rows = [line.split("\t") for line in path.read_text().splitlines()]
    values = ", ".join(f"('{url}', {int(label)})" for url, label in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to /, ?, # or the end, A-Z lower-cased; then up to ? or #. Without it, or null: empty."""
    at = F.call_function("instr", url, F.lit("://"))
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null; ties go to the rule named first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last to fit is the outermost
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + tail))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams; host and path hash apart, their ends count as characters."""

    def of(part: Column, mark: str) -> Column:
        padded = F.concat(F.lit("^"), part, F.lit("$"))
        grams = [_grams(padded, n) for n in SIZES]
        return F.transform(F.concat(*grams), lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(of(host, "h"), of(path, "p")))


def _grams(text: Column, n: int) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, some).otherwise(F.expr("cast(array() as array<string>)"))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[list[float], float]:
    """Weights and bias after full-batch gradient descent on the log loss, from zero; every run gives the same.

    The labelled table (url, label) is small by contract: more than ``max_labelled`` rows raise. An empty one gives
    zeros. It is folded within one expression: rows hold their buckets, buckets their rows, so that both the
    margins and the gradient are lookups.
    """
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    row = F.struct(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("label", F.lit(0)).cast("double").alias("y"), ngrams(host, path).alias("f"))
    packed = labelled.select("url", "label").limit(max_labelled + 1).select(row.alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"), F.count(F.lit(1)).alias("n"))
    if packed.select("n").first()[0] > max_labelled:
        raise ValueError(f"more than {max_labelled} labelled urls")
    held = packed.select(F.posexplode("rows").alias("i", "r")).select("i", F.explode("r.f").alias("b")).groupBy("b").agg(F.array_sort(F.collect_list("i")).alias("own"))
    every = labelled.sparkSession.range(BUCKETS).join(held, F.col("id") == F.col("b"), "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("own", F.expr("cast(array() as array<int>)")).alias("own")))).alias("h"))
    holders = every.select(F.transform("h", lambda x: x["own"]).alias("holders"), F.lit(1).alias("one"))
    packed = packed.withColumn("one", F.lit(1)).join(holders, "one")  # one row each
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")

    def margin(w: Column, r: Column) -> Column:
        return w["b"] + F.aggregate(r["f"], F.lit(0.0), lambda m, f: m + F.get(w["w"], f)) / F.sqrt(F.size(r["f"]).cast("double"))

    def step(w: Column, _: Column) -> Column:
        errors = F.transform("rows", lambda r: (1.0 / (1.0 + F.exp(-margin(w, r))) - r["y"]) / n)

        def moved(e: Column) -> Column:
            scaled = F.zip_with(e, F.col("rows"), lambda x, r: x / F.sqrt(F.size(r["f"]).cast("double")))
            return let(scaled, lambda g: F.struct(
                F.zip_with(w["w"], F.col("holders"), lambda x, own: x * (1.0 - RATE * DECAY) - RATE * F.aggregate(own, F.lit(0.0), lambda s, i: s + F.get(g, i))).alias("w"),
                (w["b"] - BIAS_RATE * F.aggregate(e, F.lit(0.0), lambda s, x: s + x)).alias("b"),
            ))

        return let(errors, moved)

    start = F.struct(F.array_repeat(F.lit(0.0), BUCKETS).alias("w"), F.lit(0.0).alias("b"))
    fitted = packed.select(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, step).alias("m")).first()["m"]
    return list(fitted["w"]), fitted["b"]


def score(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """The probability of a block; the weights enter the plan as one folded array literal."""
    held = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    grams = ngrams(host, path)
    return let(grams, lambda g: 1.0 / (1.0 + F.exp(-(F.lit(bias) + F.aggregate(g, F.lit(0.0), lambda m, f: m + F.get(held, f)) / F.sqrt(F.greatest(F.size(g), F.lit(1)).cast("double"))))))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict added or replaced; other columns ride along.

    verdict is the fitting rule's, else block where the score reaches ``threshold``. Null urls and such without ://
    have an empty host and path and are scored as that. Rows are judged where they lie; nothing is shuffled.
    """
    weights, bias = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    host, path = host_and_path(F.col(url))
    rows = pages.drop(*[c for c in ("host", "path", "rule", "score", "verdict", "_fit") if c != url])
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumns({"_fit": fitting_rule(F.col("host"), F.col("path"), rules), "score": score(F.col("host"), F.col("path"), weights, bias)})
    verdict = F.coalesce(F.col("_fit")["verdict"], F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.withColumns({"rule": F.col("_fit")["rule"], "verdict": verdict}).drop("_fit")
