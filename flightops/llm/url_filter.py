"""URL filters: host and path rules, and logistic regression on hashed n-grams for what no rule decides.

Only DataFrame operations: n-grams, margins and gradients are expressions and aggregations. A model is
at most BUCKETS weights, whatever the size of the table it was trained on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.llm.common import staged

ALLOW, BLOCK = "allow", "block"
BUCKETS = 4096
GRAMS = (3, 4)
LABELLED_ROWS = 2000  # the most labelled URLs that training uses
ROUNDS, RATE, DECAY = 25, 0.5, 1e-4


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#`, with A-Z lower-cased; then up to `?`, `#`."""
    at = F.instr(F.coalesce(F.col(url), F.lit("")), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """A struct (size, rule, verdict) of the longest rule that fits the columns host and path, or null.

    A rule is a host and a path in one text. It fits its host and all subdomains if the path starts
    with its path.
    """
    found = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        size, name, says = F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")
        found.append(F.when(fits, F.struct(size, name, says)))
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _gram(n: int) -> Callable[[Column], Column]:
    return lambda i: F.pmod(F.xxhash64(F.lit(n), *[F.get("chars", i + k) for k in range(n)]), F.lit(BUCKETS))


def buckets() -> tuple[Column, Column]:
    """The characters of host and path between two marks, and the hashed n-grams of the column chars."""
    chars = F.split(F.concat(F.lit("^"), "host", "path", F.lit("$")), "")
    parts = []
    for n in GRAMS:
        places = F.when(F.size("chars") >= n, F.sequence(F.lit(0), F.size("chars") - n)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(places, _gram(n)))
    return chars, F.transform(F.concat(*parts), lambda b: b.cast("int"))


def featured(pages: DataFrame) -> DataFrame:
    """Adds `buckets` to pages with host and path."""
    chars, hashed = buckets()
    return pages.withColumn("chars", chars).withColumn("buckets", hashed).drop("chars")


@dataclass
class Model:
    weights: list[float]
    bias: float = 0.0

    def margin(self) -> Column:
        """Log-odds of `block` from the column buckets: its weights' sum over the root of its length."""
        table = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        total = F.aggregate("buckets", F.lit(0.0), lambda s, b: s + F.get(table, b))
        return F.lit(self.bias) + F.coalesce(F.try_divide(total, F.sqrt(F.size("buckets").cast("double"))), F.lit(0.0))


# Names from which the labelled table is built: hosts to block, and ordinary ones.
BLOCKED_NAMES = (
    "casino jackpot poker slots roulette bet bets betting win lottery pills pharmacy viagra meds cheap replica adult porn "
    "xxx sex escort cams dating ads adserver track tracker clicks popup spam farm linkfarm seo free prize loan payday "
    "credit warez crack keygen torrent phish malware virus x"
).split()
ALLOWED_NAMES = (
    "news weather library museum garden school station nation theatre heritage engineer harbor kitchen recipes travel "
    "history science physics biology medicine hospital university college research archive journal times herald tribune "
    "gazette review forum wiki docs help support city council county village river mountain forest ocean island bridge "
    "railway airport market bakery coffee music concert orchestra gallery artist poetry novel letters story language "
    "dictionary grammar maths algebra logic robot circuit battery solar energy water earth climate animal bird horse "
    "cycling running tennis football chess puzzle photo camera cinema film radio podcast theology temple church thing "
    "other then there where here within under over again nothing something another whether rather either neither"
).split()
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = ("com", "net", "org")
FOLDERS = ("en", "de", "fr", "es")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled URL table (host, path, label): every name alone and joined with another one.

    Prefixes, endings, folders and numbers take turns, so that only the names tell the labels apart;
    there are twice as many ordinary names, so that an unknown one is let through.
    """

    def pick(values: Sequence[str], i: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.pmod(i, F.lit(len(values))).cast("int"))

    def urls(label: int, words: Sequence[str]) -> DataFrame:
        n, i = len(words), F.col("i")
        names = F.split(F.lit(" ".join(words)), " ")
        rows = spark.range(1).select(F.posexplode(names).alias("i", "name"))
        hosts = (F.col("name"), F.concat("name", F.lit("-"), pick(words, 7 * i + 3)), F.concat("name", pick(words, 5 * i + 2)))
        forms = F.array(*[F.struct((i + k * n).alias("k"), h.alias("h")) for k, h in enumerate(hosts)])
        rows = rows.select(F.inline(forms))
        k = F.col("k")
        host = F.concat(pick(PREFIXES, k), "h", F.lit(".example."), pick(ENDINGS, k))
        number = F.pmod((k + 1) * 7919, F.lit(50_000)).cast("string")
        path = F.concat(F.lit("/"), pick(FOLDERS, F.floor(k / 3)), F.lit("/"), number, pick(("", "/", ".html"), k))
        return rows.select(host.alias("host"), path.alias("path"), F.lit(label).alias("label"))

    return urls(1, BLOCKED_NAMES).unionByName(urls(0, ALLOWED_NAMES))


def train(labelled: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Gradient descent, with steps adapted to each weight, on labelled URLs (host, path, label 0 or 1).

    Different URLs are used, at most `rows` of them, first in hash order; null labels are left out. No
    rows give a model that decides nothing. Sums are rounded, so that their order does not matter.
    """
    known = labelled.filter("label is not null").groupBy("host", "path").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)
    known = staged(featured(known).select("label", "buckets", F.sqrt(F.size("buckets").cast("double")).alias("norm")), "labelled")
    n = max(1, known.count())
    model, seen = Model([0.0] * BUCKETS), [0.0] * (BUCKETS + 1)
    for _ in range(ROUNDS):
        error = (F.col("label") - 1 / (1 + F.exp(-model.margin()))).alias("error")
        parts = known.select(error, "norm", F.explode(F.concat(F.array(F.lit(-1)), "buckets")).alias("bucket"))
        part = F.when(F.col("bucket") < 0, F.col("error")).otherwise(F.col("error") / F.col("norm"))
        gradient = parts.groupBy("bucket").agg(F.round(F.sum(part), 9).alias("g")).collect()  # at most BUCKETS + 1 rows
        push = {b: g / n for b, g in gradient}
        values = [*model.weights, model.bias]
        for b in range(BUCKETS + 1):
            slope = push.get(b if b < BUCKETS else -1, 0.0) - (DECAY * values[b] if b < BUCKETS else 0.0)
            seen[b] += slope * slope
            values[b] += RATE * slope / math.sqrt(seen[b] + 1e-12)
        model = Model(values[:-1], values[-1])
    return model


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], model: Model | None = None) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, score.

    The longest fitting rule decides; if none fits, the model does: block if its probability, the score,
    exceeds one half. Without a model it is trained on `labelled_urls`. A URL that is null
    or has no `://` has an empty host and path and is scored like any other. Repeated rows give
    repeated rows, an empty table none; other columns are not read.
    """
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("match", matching_rule(rules))
    if model is None:
        model = train(labelled_urls(pages.sparkSession))
    score = 1 / (1 + F.exp(-model.margin()))
    out = featured(rows).withColumn("score", score)
    verdict = F.coalesce("match.verdict", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), "score")
