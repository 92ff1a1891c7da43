"""URL filters: pattern rules found through their rarest literal token.

Every rule has literal tokens that any URL it fits must hold in full. The rule is filed under the one of them that the
fewest URLs hold. A URL looks up its own tokens, and only the rules found so run their regular expression on it. Rules
without such a token are filed under the empty token, which every URL has. All of it is joins and aggregates: a rule table
of any size works, and Spark broadcasts it only while it is small.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexspark.llm.text import lower_ascii

TOKEN = "[a-z0-9]+"
#: The query's own list. Words of a host or path that mark junk; a rule of a host and path comes first.
JUNK_WORDS = ("adult", "bet", "casino", "cheap-pills", "clickbait", "escort", "gambling", "lottery", "malware", "phishing",
              "pills", "poker", "porn", "spam", "spam-farm", "torrent", "viagra", "warez", "xxx")


class UrlRule(NamedTuple):
    """A rule on ``host`` + ``path``: ``pattern`` is a regular expression that is searched in it, ``tokens`` are literals
    every fitting URL holds as whole tokens, ``strength`` decides between rules (then the smaller name)."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    strength: int
    given: bool


def place_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``. The longest such rule wins over all others."""
    host = host.lower()
    closed = path if path.endswith("/") or not path else re.sub(r"[^/]*$", "", path)  # a last part may go on in the URL
    tokens = tuple(re.findall(TOKEN, host + closed.lower()))
    return UrlRule(host + path, rf"^([^/]*\.)?{re.escape(host)}(?=/|$){re.escape(path)}", tokens, verdict, 1_000_000 + len(host + path), True)


def word_rule(word: str, verdict: str) -> UrlRule:
    """Fits where ``word`` stands in host or path between characters other than letters and digits."""
    return UrlRule(word, rf"(?i)(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", tuple(re.findall(TOKEN, word.lower())), verdict, len(word), False)


def pattern_rule(pattern: str, verdict: str, tokens: Iterable[str] = ()) -> UrlRule:
    """Any regular expression; ``tokens`` may be empty, then it runs on every URL."""
    return UrlRule(pattern, pattern, tuple(tokens), verdict, 0, False)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)))


def rule_index(spark: SparkSession, urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """The rules with the ``token`` each is filed under: its rarest one over all ``urls`` (column ``text``), the smaller
    token on a tie, the empty one where a rule has none. Counts are taken over every distinct URL."""
    table = spark.createDataFrame(
        [(i, r.name, r.pattern, sorted(set(r.tokens)), r.verdict, r.strength, r.given) for i, r in enumerate(rules)],
        "id int, name string, pattern string, tokens array<string>, verdict string, strength int, given boolean")
    filed = table.select("id", F.explode("tokens").alias("token"))
    counts = (urls.select(F.explode(tokens_of(F.col("text"))).alias("token"))
              .join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")))
    rarest = (filed.join(counts, "token", "left").groupBy("id")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    return table.drop("tokens").join(rarest, "id", "left").withColumn("token", F.coalesce("token", F.lit("")))


def filter_urls(df: DataFrame, rules: list[UrlRule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (the name of the deciding rule if it is one of host and path, else null), matched (the
    name of whichever rule decided, null for none) and verdict.

    The strongest fitting rule decides, the smaller name on a tie; ``default`` holds where none fits. Every distinct URL
    is judged once, so a URL that a third of the rows share costs one row here. Null URLs and those without ``://`` have
    an empty host and path and get the default. Columns of ``df`` with the names of new ones are replaced.
    """
    url = F.col("__url")
    urls = df.select(F.col(f"`{url_col}`").alias("__url")).distinct()
    urls = urls.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("text", F.concat("host", "path"))
    index = rule_index(df.sparkSession, urls.select("text"), rules).withColumnRenamed("token", "at")
    asked = urls.where("text <> ''").select("__url", "text", F.explode(F.array_append(tokens_of(F.col("text")), F.lit(""))).alias("at"))
    fits = asked.join(index, "at").where(F.expr("regexp_like(text, pattern)"))
    top = fits.groupBy(F.col("__url").alias("of")).agg(F.max_by(F.struct("name", "verdict", "given"), F.struct("strength", (-F.col("id")).alias("first"))).alias("r"))
    judged = urls.join(top, url == F.col("of"), "left").select(
        "__url", "host", "path", F.when(F.col("r.given"), F.col("r.name")).alias("rule"), F.col("r.name").alias("matched"),
        F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
    new = ("host", "path", "rule", "matched", "verdict")
    kept = [c for c in df.columns if c not in new or c == url_col]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    return rows.join(judged, rows[f"`{url_col}`"].eqNullSafe(judged["__url"]), "left").select(*[rows[f"`{c}`"] for c in kept if c not in new], *[judged[c] for c in new])
