"""URL filters: fixed host and path rules, then association rules mined with FP-growth."""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.95
#: Rows that a rule of ``judge_urls`` rests on at least.
MIN_ROWS = 20
#: Deviations by which a rule's confidence must stand above the share of all examples that are blocked: 99 of 100 sure.  However large that share, enough rows get there.
SURE = 2.33
BLOCK = "verdict=block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict, names) of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's; else null.

    names are the tokens (see ``url_tokens``) of the rule itself.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string,names:array<string>>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        names = [f"host:{x}" for x in h.split(".") if x] + [f"path:{x.lower()}" for x in re.split(r"[/._-]+", p) if x]
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"), F.array(*[F.lit(x) for x in names]).cast("array<string>").alias("names"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: host labels, path words, file extension, query keys; numbers say nothing and are left out."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    parts = [
        F.transform(F.split(host, r"\."), lambda x: F.when(x != "", F.concat(F.lit("host:"), x))),
        F.transform(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), r"[/._-]+"), lambda x: F.when((x != "") & ~x.rlike("^[0-9]+$"), F.concat(F.lit("path:"), F.lower(x)))),
        F.array(F.when(path.rlike(r"\.[A-Za-z0-9]+$"), F.concat(F.lit("ext:"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))))),
        F.transform(F.split(query, "&"), lambda x: F.when(x != "", F.concat(F.lit("query:"), F.split(x, "=")[0]))),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull())))


def frequent_tokens(labelled: DataFrame, least: int) -> list[list[tuple[str, int]]]:
    """Classes of (token, count) of the tokens that at least ``least`` rows hold; tokens of a class are in exactly the same rows.

    A row holds few tokens, so at most average length / MIN_SUPPORT of them are frequent whatever the input's size.
    """
    rows = labelled.select("tokens", F.xxhash64("tokens", "blocked").alias("x"), F.xxhash64("blocked", "tokens").alias("y")).select(F.explode("tokens").alias("token"), "x", "y")
    cover = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("x", "y")]
    classes: dict[tuple, list[tuple[str, int]]] = {}
    for r in sorted(rows.groupBy("token").agg(F.count("*").alias("n"), *cover).where(F.col("n") >= least).collect()):
        classes.setdefault((r["n"], r["x"], r["y"]), []).append((r["token"], r["n"]))
    return list(classes.values())


def least_confidence(hits: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share of which ``n`` rows give ``hits``."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def rule_table(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, z: float = SURE, min_rows: int = 1) -> DataFrame:
    """Rules (tokens, confidence, support, pivot) from (tokens, blocked).

    FP-growth runs on all labelled URLs with all their frequent tokens.  A rule goes if its support, rows or
    confidence are too few, or if its confidence isn't surely (``z``) above the share of blocked examples, or if fewer of its tokens are as confident.  So tokens that occur in exactly
    the same rows never make a rule together: one of them is mined, and its rules hold for each.
    The pivot is a rule's rarest token.  Itemsets and rules stay tables.
    """
    total, blocked = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    base = blocked / max(total, 1)
    min_support = max(min_support, min_rows / max(total, min_rows, 1))
    classes = frequent_tokens(labelled, math.ceil(min_support * total - 1e-9)) if total else []
    names = F.from_json(F.lit(json.dumps({c[0][0]: [{"n": n, "token": t} for t, n in c] for c in classes})), "map<string,array<struct<n:bigint,token:string>>>")
    mined = F.array(*[F.lit(c[0][0]) for c in classes]).cast("array<string>")
    baskets = labelled.select(F.array_intersect("tokens", mined).alias("tokens"), "blocked")
    items = baskets.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items"))
    found = materialise(FPGrowth(itemsCol="items", minSupport=min_support).fit(items).freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    sets = found.where(~F.array_contains("items", BLOCK)).select(F.col("items").alias("t"), F.col("freq").alias("all"))
    hits = found.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("t"), "freq")
    rated = materialise(hits.join(sets, "t").select("t", "freq", (F.col("freq") / F.col("all")).alias("confidence")), "rated")
    best, kept = None, []
    for size in range(1, 1 + (rated.agg(F.max(F.size("t"))).first()[0] or 0)):
        level = rated.where(F.size("t") == size).withColumn("above", F.lit(0.0))
        if best is not None:  # of any part of the tokens
            parts = level.select("t", F.explode(F.transform("t", lambda x: F.array_remove("t", x))).alias("part")).join(best, "part").groupBy("t").agg(F.max("best").alias("above"))
            level = level.drop("above").join(parts, "t")
        level = materialise(level, "level")
        best = level.select(F.col("t").alias("part"), F.greatest("above", "confidence").alias("best"))
        sure = (F.col("confidence") > base) & (least_confidence(F.col("freq"), F.col("freq") / F.col("confidence"), z) > base) if z else F.lit(True)
        kept.append(level.where((F.col("freq") >= min_rows) & (F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("above")) & sure).select("t", "freq", "confidence"))
    rules = reduce(DataFrame.unionByName, kept) if kept else rated.select("t", "freq", "confidence")
    none = F.array(F.array().cast("array<struct<n:bigint,token:string>>"))
    each = F.aggregate("t", none, lambda done, x: F.flatten(F.transform(done, lambda d: F.transform(names[x], lambda m: F.array_append(d, m)))))
    rules = rules.select(F.explode(each).alias("r"), "freq", "confidence")
    return materialise(rules.select(F.array_sort(F.transform("r", lambda m: m["token"])).alias("tokens"), (F.col("freq") / F.lit(max(total, 1))).alias("support"), "confidence", F.array_min("r")["token"].alias("pivot")), "rules")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[dict]:
    """The rows of ``rule_table`` as a list, to look at."""
    return [r.asDict() for r in rule_table(labelled, min_support, min_confidence).collect()]


def match_rules(token_sets: DataFrame, rules: DataFrame | list[dict]) -> DataFrame:
    """(tokens, mined) for the distinct token sets that a rule fits, with the most confident rule's text.

    Inverted index: each rule is listed under its rarest token only; a set looks up its tokens and
    checks the rest of each listed rule.
    """
    if not isinstance(rules, DataFrame):
        rules = token_sets.sparkSession.createDataFrame([(r["pivot"], r["tokens"], r["confidence"]) for r in rules], "pivot string, tokens array<string>, confidence double")
    index = rules.select("pivot", F.col("tokens").alias("need"), "confidence")
    sets = token_sets.select("tokens").distinct()
    found = sets.withColumn("pivot", F.explode("tokens")).join(index, "pivot").where(F.size(F.array_except("need", "tokens")) == 0)
    return found.groupBy("tokens").agg(F.max(F.struct("confidence", F.concat_ws(" & ", "need").alias("text"))).alias("best")).select("tokens", F.col("best.text").alias("mined"))


def parsed_urls(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (url and others) with host, path, fit (see ``fitting_rule``) and tokens."""
    url = F.coalesce(F.col("url"), F.lit(""))
    df = urls.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    return df.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(url, F.col("host"), F.col("path")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, mined.

    The longest fitting fixed rule decides; without one, a mined rule that fits blocks and anything
    else is allowed.  ``labelled`` (url, blocked) are the examples to mine; without it, the URLs that a
    fixed rule decides are, without the tokens that this rule itself names: those are blocked or allowed by definition, and
    say nothing on other URLs.  Null URLs, and those without ``://``, have an empty host and path and are
    allowed; null ids and repeated rows keep their rows; empty tables give none; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    rows = parsed_urls(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), rules).drop("url")
    rows = materialise(rows, "urls")
    ruled = rows.where("fit is not null").select("fit", F.array_except("tokens", "fit.names").alias("tokens"))
    examples = ruled.select("tokens", (F.col("fit.verdict") == "block").alias("blocked")) if labelled is None else parsed_urls(labelled.select("url", "blocked"), rules).select("tokens", "blocked")
    mined = rule_table(examples, min_rows=MIN_ROWS)
    hits = materialise(match_rules(rows.where("fit is null"), mined), "hits")
    judged = rows.where("fit is null").join(hits, "tokens", "left").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("mined").isNull(), "allow").otherwise("block").alias("verdict"), "mined")
    ruled = rows.where("fit is not null").select("id", "host", "path", "fit.rule", "fit.verdict", F.lit(None).cast("string").alias("mined"))
    return ruled.unionByName(judged).withColumnRenamed("id", id_col)


def leave_one_rule_out(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(rule, verdict, n, blocked): of the URLs that each fixed rule decides, how many the rules mined from all others block."""
    rules, out = RULES if rules is None else rules, []
    named = judge_urls(pages, rules, pages.limit(0).select(F.col(url_col).alias("url"), F.lit(True).alias("blocked")), id_col, url_col).select(F.col(id_col).alias("id"), "rule", F.col("verdict").alias("due"))
    urls = materialise(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).join(named.where("rule is not null"), "id"), "decided")
    for h, p, _ in rules:
        own = urls.where(F.col("rule") == h + p)
        rest = parsed_urls(urls.where(F.col("rule") != h + p), rules)
        taught = rest.where("fit is not null").select(F.array_except("tokens", "fit.names").alias("tokens"), (F.col("fit.verdict") == "block").alias("blocked"))
        sets = parsed_urls(own, [])
        hits = match_rules(sets, rule_table(taught, min_rows=MIN_ROWS))
        out.append(sets.join(hits, "tokens", "left").groupBy("rule", F.col("due").alias("verdict")).agg(F.count("*").alias("n"), F.count("mined").alias("blocked")))
    return reduce(DataFrame.unionByName, out)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
