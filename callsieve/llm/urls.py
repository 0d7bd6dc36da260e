"""URL filtering by rules given by hand and by association rules mined from labels.

FP-growth finds token sets that occur in enough labelled URLs; those that go along with bad
labels often enough become rules. A rule is filed under its rarest token, so a URL meets only the
rules of its own tokens and is then checked for the others.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.session import materialise

#: Share of the labelled URLs in which a token set must occur, and share of bad ones among them.
SUPPORT, CONFIDENCE = 0.005, 0.6
BAD = "label:bad"

# Rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in small letters and path; both empty for null and for a text without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, the host and its parent domains, path segments with
    digits as ``0``, and names of query fields."""
    host, path = host_and_path(url)
    scheme = F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1))
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -n, n), ".")),
    )
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda s: s != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fields = F.filter(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), lambda n: n != "")
    named = F.concat(
        F.array(scheme),
        domains,
        F.transform(segments, lambda s: F.concat(F.lit("path:"), s)),
        F.transform(fields, lambda n: F.concat(F.lit("query:"), n)),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(named)).otherwise(F.array().cast("array<string>"))


def mine_rules(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, partitions: int | None = None
) -> DataFrame:
    """``anchor, antecedent, confidence, support`` from ``url, bad`` rows; rows of null are not used.

    ``anchor`` is the antecedent's rarest token. ``support`` bounds the number of rules: a URL of
    t frequent tokens holds 2 ** t sets, and a set must be in that share of all URLs.
    """
    baskets = materialise(
        labelled.filter("url IS NOT NULL AND bad IS NOT NULL").select(
            F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array())).alias("items")
        ),
        "baskets",
    )
    schema = "anchor string, antecedent array<string>, confidence double, support double"
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    miner = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence)
    fitted = (miner.setNumPartitions(partitions) if partitions else miner).fit(baskets)
    rules = fitted.associationRules.filter(F.col("consequent")[0] == BAD).select("antecedent", "confidence", "support")
    single = fitted.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchors = (
        rules.select("*", F.explode("antecedent").alias("token"))
        .join(single, "token")
        .groupBy("antecedent", "confidence", "support")
        .agg(F.min(F.struct("freq", "token")).alias("least"))
    )
    return materialise(anchors.select(F.col("least.token").alias("anchor"), "antecedent", "confidence", "support"), "rules")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, confidence`` of distinct ``urls`` that hold all tokens of a rule, with the best one."""
    tokens = urls.select("url", url_tokens(F.col("url")).alias("tokens"))
    met = tokens.select("url", "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    whole = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    return whole.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` for each row of ``pages``.

    The longest rule by hand decides; else a URL is blocked if a mined rule matches, and allowed
    if none does. ``labels`` has ``doc_id, quality, toxic`` of pages: bad is toxic or of quality 0.
    Pages without a label are not learned from; a label's repeated rows count as often as they
    occur. A null URL has no tokens and an empty host, and is allowed. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    bad = labels.select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")
    )
    rules = mine_rules(rows.join(bad, "page_id").select("url", "bad"), **options)
    host, path = host_and_path(F.col("url"))
    rule, by_hand = longest_rule(F.col("host"), F.col("path"))
    open_urls = rows.filter("url IS NOT NULL").select("url").distinct()
    judged = rows.join(match_rules(open_urls, rules), "url", "left")
    parts = judged.select("page_id", host.alias("host"), path.alias("path"), "confidence")
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(by_hand, mined).alias("verdict"), "confidence"
    )
