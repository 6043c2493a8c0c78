"""URL filter with rules indexed by their rarest literal token; DataFrame functions only.

A rule is (verdict, 'host/path'): it fits its host and all subdomains when the url's path starts with the rule's; a rule
without a slash is a host and fits every path, the empty one too. A port is part of the host: 'a.com' doesn't fit
'a.com:8080', which needs a rule of its own.
Each rule is filed under the one of its literal tokens (host labels, path words) that fewest urls hold. A url fetches
the rules filed under its own tokens, and only those run their regular expressions; the longest that fits wins
(ties: longer host, then the rule string). Up to ``INLINE_RULES`` rules the index is a map literal looked up inside one
projection, so urls are never shuffled. Beyond that the index is a table with one row for each token, broadcast only
after a count, else joined with hot tokens split off; tokens that no rule is filed under end there, and what is left is
folded to one row a url, with the same result.

Defined cases: null url or no ``://`` gives empty host and path, no rule and the default verdict; an empty table gives
an empty result; repeated page ids are judged row by row; other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, settle, skew_join, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 64
TOKEN = r"[^./]+"


def host_path(url: Column) -> tuple[Column, Column]:
    whole = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, whole, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _parse(rules: list[tuple[str, str]]) -> list[dict]:
    out = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        host, path = host.lower(), slash + path
        # a last path word without an end may go on in the url, so it is no literal token
        words = re.findall(TOKEN, host) + re.findall(r"[^./]+(?=[./])", path)
        if not words:
            raise ValueError(f"rule without a literal token: {rule!r}")
        out.append({"rule": host + path, "verdict": verdict, "tokens": sorted(set(words)), "host_len": len(host),
                    "pattern": r"\A(?:[^/]*\.)?" + re.escape(host + path) + ("" if slash else r"(?=/|\z)")})
    return out


def token_frequencies(tokens: DataFrame, wanted: list[str], inline: int) -> dict[str, int]:
    """How many urls hold each of the rules' tokens; the result is no longer than the rule list."""
    if len(wanted) <= inline:
        held = tokens.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("t"))
    else:
        asked = tokens.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
        held = tokens.select(F.explode("tokens").alias("t")).join(small(asked), "t", "left_semi")
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict."""
    host, path = host_path(F.col(url_col))
    urls = (df.select(F.col(id_col), host.alias("host"), path.alias("path"))
            .withColumn("tokens", F.array_distinct(F.expr(rf"regexp_extract_all(concat(host, path), '{TOKEN}', 0)"))))
    known = _parse(rules)
    none = F.lit(None).cast("struct<len:int,host_len:int,rule:string,verdict:string>")
    finish = lambda d: d.select(id_col, "host", "path", F.col("best.rule").alias("rule"),
                                F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
    if not known:
        return finish(urls.withColumn("best", none))
    inline = len(known) <= inline_rules
    if not inline:
        urls = settle(row_key(urls, "_row"), "urls")
    freq = token_frequencies(urls, sorted({t for r in known for t in r["tokens"]}), 2 * INLINE_RULES)
    for r in known:
        r["token"] = min(r["tokens"], key=lambda t: (freq.get(t, 0), t))
    if inline:
        entry = lambda r: F.struct(F.lit(len(r["rule"])).alias("len"), F.lit(r["host_len"]).alias("host_len"), F.lit(r["rule"]).alias("rule"),
                                   F.lit(r["verdict"]).alias("verdict"), F.lit(r["pattern"]).alias("pattern"))
        filed = sorted({r["token"] for r in known})
        index = F.create_map(*[x for t in filed for x in (F.lit(t), F.array(*[entry(r) for r in known if r["token"] == t]))])
        fetched = F.flatten(F.transform(F.filter("tokens", lambda t: F.map_contains_key(index, t)), lambda t: F.element_at(index, t)))
        fits = F.filter(fetched, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"]))
        return finish(urls.withColumn("best", F.array_max(F.transform(fits, lambda r: F.struct(r["len"].alias("len"), r["host_len"].alias("host_len"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))))
    index = df.sparkSession.createDataFrame([(r["token"], r["pattern"], len(r["rule"]), r["host_len"], r["rule"], r["verdict"]) for r in known],
                                            "token string, pattern string, len int, host_len int, rule string, verdict string")
    index = index.groupBy("token").agg(F.collect_list(F.struct("len", "host_len", "rule", "verdict", "pattern")).alias("rules"))
    keyed = urls.select("_row", F.concat("host", "path").alias("at"), F.explode("tokens").alias("token"))
    few = small(index)
    met = keyed.join(few, "token") if few is not index else skew_join(settle(keyed, "tokens"), index, "token", "inner")
    fits = F.filter("rules", lambda r: F.regexp_like("at", r["pattern"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["len"].alias("len"), r["host_len"].alias("host_len"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    # a url's rows leave one task together, so the partial aggregate folds them before the shuffle
    found = met.select("_row", best.alias("best")).filter("best IS NOT NULL").groupBy("_row").agg(F.max("best").alias("best"))
    return finish(urls.join(found, "_row", "left"))
