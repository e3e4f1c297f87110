"""URL filters: ordered-by-length allow/block rules, then a logistic regression on hashed character n-grams.

The model reads character n-grams of host and path, hashed into ``dim`` weights, each an integer millionth so
that sums are exact in any order.  It is fitted on the driver in plain Python from a small labelled URL table
(at most ``MAX_LABELLED`` rows), which is given: a DataFrame of url and label, or ``labelled_urls()``.  Judging is column
expressions only.  Of rules that fit, the longest wins; of equally long ones the last by name, then by action.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
the model (whose bias decides).  Empty tables give no rows; other columns of the input are kept out of the
result; repeated rows are judged alike; a very long url costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_sample

#: Rows of a labelled table that are read to the driver; of a larger one a sample by hash of the url, of half as many or more.
MAX_LABELLED = 20_000
#: Rules that become one expression; a longer list, or a table of rules, is joined.
MAX_RULES = 200

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The small labelled URL table: names and what they stand for, as a blocklist and a directory of sites would list them.
LABELLED = {
    1: (
        "casino", "poker", "jackpot", "slots", "roulette", "betting", "bets", "bingo", "lottery", "gambling", "pills", "viagra", "cialis",
        "pharmacy-discount", "weightloss", "botox", "replica", "porn", "xxx", "adult", "escort", "nude", "sexcam", "hookup", "malware",
        "phishing", "spyware", "trojan", "warez", "torrent", "crack", "keygen", "spam", "clickbait", "adserver", "popup", "tracker", "ads",
        "affiliate", "payday-loan", "bitcoin-doubler", "getrich", "fastcash", "freegift", "winprize", "cheap-deals", "linkfarm", "seo-backlinks", "spammers", "spambot", "bulkmail",
    ),
    0: (
        "university", "college", "school", "library", "museum", "archive", "research", "science", "journal", "institute", "academy", "history",
        "news", "weather", "herald", "tribune", "gazette", "city", "county", "parliament", "ministry", "court", "health", "hospital", "clinic",
        "recipes", "garden", "travel", "railway", "music", "theatre", "orchestra", "football", "chess", "forum", "docs", "wiki", "blog",
        "encyclopedia", "dictionary", "translation", "literature", "poetry", "physics", "biology", "mathematics", "geology", "astronomy",
        "engineering", "software", "opensource", "community", "foundation", "charity", "church", "farm", "forest", "river", "mountain", "coast",
    ),
}
#: Made-up syllables, of which plain hosts are built: a name that says nothing is allowed.
SYLLABLES = ("ba", "den", "for", "gal", "hem", "in", "kor", "lun", "mar", "nes", "or", "pel", "ran", "sol", "ten", "ul", "ver", "wick")


def labelled_urls(held_out: bool = False) -> list[tuple[str, int]]:
    """The table as (url, 1 = block): each name alone and beside others of its label; ``held_out``: other combinations."""
    rows = []
    tops, langs = ("com", "net", "org", "info", "co.uk"), ("en", "fr", "de", "es", "it")
    shift = 7 if held_out else 0
    for label, names in LABELLED.items():
        for i, name in enumerate(names):
            other = names[(i * 5 + 11 + shift) % len(names)]
            hosts = (f"{other}-{name}", f"{name}{other}") if held_out else (name, f"{name}-{other}", f"{other}{name}", f"www.{name}")
            for k, host in enumerate(hosts):
                n = i * 7 + k * 3 + label + shift
                path = ("", "/", f"/{langs[n % 5]}/{n * 37 % 1000}", f"/{langs[n % 5]}/{n % 9}.html")[(n // 2) % 4]
                rows.append((f"https://{host}.{tops[n % 5]}{path}", label))
    for i in range(len(SYLLABLES) * 4):
        host = "".join(SYLLABLES[(i * (3 + k) + k * 7 + shift) % len(SYLLABLES)] for k in range(2 + i % 2))
        rows.append((f"https://{('', 'www.', 'blog.')[i % 3]}{host}.{tops[i % 5]}/{langs[(i + shift) % 5]}/{i * 13 % 1000}", 0))
    return rows


@dataclass(frozen=True)
class UrlModel:
    dim: int
    n: int
    bias: int
    weights: tuple[int, ...]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:stop]


def features(url: str | None, dim: int, n: int) -> list[int]:
    s = " ".join(["", *split_url(url), ""])
    return [int(hashlib.md5(s[i : i + n].encode()).hexdigest()[:8], 16) % dim for i in range(max(0, len(s) - n + 1))]


def fit(labelled: DataFrame | list[tuple[str, int]], dim: int = 4096, n: int = 4, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> UrlModel:
    """Stochastic gradient descent in a fixed order; ``labelled`` has columns url and label (1 = block)."""
    if isinstance(labelled, DataFrame):
        labelled = labelled.select("url", "label")
        if labelled.count() > MAX_LABELLED:
            labelled = bounded_sample(labelled, MAX_LABELLED // 2, "url")
        labelled = [(r[0], r[1]) for r in labelled.collect()]
    rows = sorted(((f, y) for u, y in labelled if y is not None and (f := features(u, dim, n))), key=lambda r: r[0])
    w, b = [0.0] * dim, 0.0
    for epoch in range(epochs):
        for f, y in rows:
            z = b + sum(w[i] for i in f)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * rate / (len(f) * (1 + epoch / 10))
            b -= g
            for i in f:
                w[i] -= g + rate * decay * w[i]
    return UrlModel(dim, n, round(b * 1e6), tuple(round(x * 1e6) for x in w))


def host_of(url: Column) -> Column:
    found = F.instr(url, "://") > 0
    rest = F.substring_index(F.substr(url, F.instr(url, "://") + F.lit(3)), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(found, F.translate(host, upper, lower)).otherwise(F.lit(""))


def path_of(url: Column, host: Column) -> Column:
    found = F.instr(url, "://") > 0
    rest = F.substr(url, F.instr(url, "://") + F.lit(3) + F.length(host))
    return F.when(found, F.substring_index(F.substring_index(rest, "?", 1), "#", 1)).otherwise(F.lit(""))


def logit(host: Column, path: Column, model: UrlModel) -> Column:
    """Bias plus the weights of all n-grams of ' host path ', in millionths (long).

    The string is split into characters once, so a gram costs the same at any place of a long url.
    """
    chars = F.filter(F.split(F.concat(F.lit(" "), host, F.lit(" "), path, F.lit(" ")), ""), lambda c: c != "")
    weights = F.expr(f"array({','.join(map(str, model.weights))})")
    size = F.size(chars)
    at = F.when(size >= model.n, F.sequence(F.lit(1), size - F.lit(model.n - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(at, lambda i: F.array_join(F.slice(chars, i, model.n), ""))
    index = lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % F.lit(model.dim)
    total = F.aggregate(
        grams, F.lit(model.bias).cast("long"), lambda a, g: a + F.element_at(weights, (index(g) + 1).cast("int")).cast("long")
    )
    return total


def rule_by_case(df: DataFrame, rules) -> DataFrame:
    host, path = F.col("host"), F.col("path")
    rule = action = F.lit(None).cast("string")
    # the longest rule that fits wins: shorter ones stand deeper in the CASE
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return df.withColumn("rule", rule).withColumn("__action", action)


def rule_by_join(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (action, host, path) of any number: distinct hosts are joined with their suffixes' rules, urls with their hosts' rules.

    Of a host the rules are gathered in order, so a url's are searched without leaving its row.
    """
    hosts = df.select("host").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.select(F.col("action").alias("__a"), F.col("host").alias("__h"), F.col("path").alias("__p"))
    name = F.concat("__h", "__p")
    order = F.struct(F.length(name).alias("n"), name.alias("rule"), F.col("__a").alias("action"), F.col("__p").alias("path"))
    fitting = hosts.select("host", F.explode(suffixes).alias("__h")).join(rules, "__h").groupBy("host").agg(F.sort_array(F.collect_set(order), asc=False).alias("__rules"))
    found = df.join(fitting, "host", "left")
    best = F.try_element_at(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    return found.withColumn("rule", best["rule"]).withColumn("__action", best["action"]).drop("__rules")


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's logit in millionths; rules: (action, host, path), or a table of them."""
    df = pages.select("page_id", "url").withColumn("host", host_of(F.col("url")))
    df = df.withColumn("path", path_of(F.col("url"), F.col("host")))
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    df = rule_by_join(df, rules) if isinstance(rules, DataFrame) else rule_by_case(df, rules)
    df = df.withColumn("logit", logit(F.col("host"), F.col("path"), model))
    verdict = F.coalesce(F.col("__action"), F.when(F.col("logit") > 0, "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "logit")


def oracle(model: UrlModel, rules=RULES) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered)) + " END"
    act = "CASE " + " ".join(f"WHEN {f} THEN '{a}'" for f, (a, _, _) in zip(fits, ordered)) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    weights = ",".join(map(str, model.weights))
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h0, coalesce(rest, '') AS rest FROM a),
c AS (SELECT page_id, translate(h0, '{upper}', '{lower}') AS host,
             regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, ' ' || host || ' ' || path || ' ' AS s FROM c),
w AS (SELECT [{weights}] AS ws),
e AS (SELECT d.*, {model.bias} + coalesce(list_sum(list_transform(range(1, greatest(1, length(s) - {model.n - 2})),
        lambda i: ws[1 + (('0x' || substr(md5(substr(s, i, {model.n})), 1, 8))::BIGINT % {model.dim})]::BIGINT)), 0)::BIGINT AS logit FROM d, w)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({act}, CASE WHEN logit > 0 THEN 'block' ELSE 'allow' END) AS verdict, logit::BIGINT AS logit
FROM e"""
