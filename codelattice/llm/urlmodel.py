"""URL filters: rules on host and path, and for the rest the ratio of two character language models.

All of it is column expressions. The models are variable-order Markov chains over a small alphabet, smoothed
towards shorter contexts; a URL's score is the mean log ratio per character of the model of accepted URLs to
that of rejected ones, and the threshold is the one that errs least on the URLs that rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
ORDER = 4  # characters of a gram, the last one of which is predicted
#: Letters, one sign for all digits, common signs, one for all others: 38 symbols, so there are at most
#: 39 ** 4 grams, 2.3 million; that bounds the table of the models, whatever the number of URLs.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%~"
OTHER = "*"
START = "^"
STEPS = 400  # thresholds tried


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """A URL over the alphabet of the models."""
    low = F.translate(F.lower(url), "123456789", "0" * 9)
    return F.regexp_replace(low, r"(?s)[^a-z0/.\-_?=&#:%~]", OTHER)


def grams(column: Column) -> Column:
    """The gram that ends at each character; the first ones are filled with the start sign."""
    padded = F.concat(F.lit(START * (ORDER - 1)), column)
    n = F.length(column)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(ORDER)))).otherwise(F.array().cast("array<string>"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """``gram``, ``ratio`` for all grams of ``counts`` (gram, n_allow, n_block; 0 and 0 for grams to score only).

    Interpolated towards the next shorter context by the number of different characters seen after it. Both
    models end at the same even distribution over the alphabet.
    """
    even = F.lit(1.0 / (len(ALPHABET) + 1))
    shorter = None  # probabilities of the grams that are shorter by one
    for length in range(1, ORDER + 1):
        seen = counts.groupBy(F.substring("gram", ORDER - length + 1, length).alias("g")).agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("r"))
        context = F.substring("g", 1, length - 1)
        after = seen.groupBy(context.alias("c")).agg(
            *[x for n in ("a", "r") for x in (F.sum(n).alias(f"all_{n}"), F.count_if(F.col(n) > 0).alias(f"kinds_{n}"))])
        rows = seen.withColumn("c", context).join(after, "c")
        if shorter is None:
            rows = rows.withColumn("q_a", even).withColumn("q_r", even)
        else:
            rows = rows.withColumn("s", F.substring("g", 2, length - 1)).join(shorter, "s")
        shorter = rows.select(F.col("g").alias("s"), *[
            F.when(F.col(f"all_{n}") > 0, (F.col(n) + F.col(f"kinds_{n}") * F.col(f"q_{n}")) / (F.col(f"all_{n}") + F.col(f"kinds_{n}")))
            .otherwise(F.col(f"q_{n}")).alias(f"q_{n}") for n in ("a", "r")])
    return shorter.select(F.col("s").alias("gram"), F.log(F.col("q_a") / F.col("q_r")).alias("ratio"))


def threshold_of(scored: DataFrame) -> float:
    """The threshold with the least mean of both error rates on rows that have ``label`` and ``score``."""
    low_high = scored.where("label is not null").agg(F.min("score"), F.max("score")).first()
    if low_high[0] is None or low_high[0] == low_high[1]:
        return 0.0
    low, width = low_high[0], (low_high[1] - low_high[0]) / STEPS
    bins = scored.where("label is not null").groupBy(F.floor((F.col("score") - low) / width).alias("b")).agg(
        F.count_if(F.col("label") == ALLOW).alias("a"), F.count_if(F.col("label") == BLOCK).alias("r"))
    all_rows = bins.agg(F.sum("a"), F.sum("r")).first()  # at most STEPS + 1 rows
    if not all_rows[0] or not all_rows[1]:
        return 0.0
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    wrong = bins.select(
        "b", (F.coalesce(F.sum("a").over(before), F.lit(0)) / all_rows[0] + (all_rows[1] - F.coalesce(F.sum("r").over(before), F.lit(0))) / all_rows[1]).alias("e"))
    best = wrong.orderBy("e", F.abs(F.lit(low) + F.col("b") * width), "b").first()
    return low + best["b"] * width


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Every URL with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    ``pages`` has ``page_id`` and ``url``; further columns are ignored. The verdict is the rule's; without one
    it is ``allow`` if the score reaches the threshold. A URL that is null or empty scores 0. Where rules
    decide no URL of one kind, the threshold is 0. Repeated rows are judged alike, each.
    """
    url = F.col("url").cast("string")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = named.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_row", F.monotonically_increasing_id())
    kept = ruled.select("page_id", "_row", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("label"), grams(symbols(F.coalesce("url", F.lit("")))).alias("_grams"))
    spelled = kept.select("label", F.explode("_grams").alias("gram"))
    counts = spelled.groupBy("gram").agg(F.count_if(F.col("label") == ALLOW).alias("n_allow"), F.count_if(F.col("label") == BLOCK).alias("n_block"))
    ratios = log_ratios(cut_lineage(counts))
    parts = kept.select("page_id", "_row", "host", "path", "rule", "label", F.explode_outer("_grams").alias("gram"))
    # at most (alphabet + 1) ** ORDER rows
    met = parts.join(F.broadcast(cut_lineage(ratios)), "gram", "left")
    scored = met.groupBy("page_id", "_row", "host", "path", "rule", "label").agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("score"))
    scored = cut_lineage(scored)
    limit = threshold_of(scored)
    own = F.when(F.col("score") >= limit, ALLOW).otherwise(BLOCK)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "score")
