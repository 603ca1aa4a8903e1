"""URL filter: allow and block rules, and logistic regression on hashed character n-grams of host and path.

The regression is trained once on the driver from a small labelled URL table (its size is that of the
literal below, or of the table passed in); its weights are whole numbers in a literal array, so the data
path is column expressions alone: character trigrams, a polynomial hash, an array lookup and a sum.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged
by the method on empty strings; very long urls are used whole; a margin of 0, between both verdicts, allows; repeated rows give repeated results; an
empty table gives an empty one; only page_id and url are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import table

BUCKETS = 1024
SCALE = 10_000
#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled urls: 1 is to be blocked.
LABELLED = (
    ("https://ads.banner.example/click?id=1", 1), ("http://track.pixel.example/collect/1.gif", 1), ("https://cdn.adserver.example/serve/ad.js", 1),
    ("https://shop.example/cart/add/12", 1), ("https://shop.example/checkout", 1), ("https://example.org/login", 1),
    ("https://example.org/account/signin", 1), ("https://casino.win-big.example/bonus/slots", 1), ("http://free-bonus.casino.example/poker", 1),
    ("https://xxx-videos.example/hot/tube", 1), ("https://cheap-pills.example/buy/now", 1), ("https://redirect.example/out?u=x", 1),
    ("https://affiliate.example/promo/deal-9", 1), ("https://popup.ads.example/banner/300x250", 1), ("https://telemetry.example/beacon", 1),
    ("https://spam-links.example/seo/backlinks", 1), ("https://warez.example/crack/keygen.exe", 1), ("https://example.com/wp-admin/admin.php", 1),
    ("https://example.com/cgi-bin/form", 1), ("https://example.com/search/?q=a", 1), ("https://example.com/tag/promo/feed", 1),
    ("https://blog.example.org/en/751", 0), ("https://m.example.org/en/25", 0), ("https://news.example.com/fr/article/12", 0),
    ("https://example.org/wiki/history", 0), ("https://docs.example.org/guide/install", 0), ("https://library.example/books/12", 0),
    ("https://university.example/research/paper-3", 0), ("https://example.com/es/noticias/9", 0), ("https://example.com/en/stories/weather", 0),
    ("https://museum.example/collection/painting", 0), ("https://journal.example/volume/4/issue/2", 0), ("https://example.net/en/685", 0),
    ("https://recipes.example/soup/lentil", 0), ("https://science.example/physics/light", 0), ("https://forum.example/thread/77", 0),
    ("https://city.example/council/minutes", 0), ("https://example.org/about", 0), ("https://blog.example.com/2020/05/title-of-post", 0),
    ("https://www.example.org/de/artikel/44", 0), ("https://archive.example/letters/1901", 0), ("https://example.com/help/faq", 0),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one url, as the column expressions give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def buckets(text: str, part: int) -> list[int]:
    """Hashed trigrams of a host (part 0) or path (part 1) with its ends marked."""
    c = [ord(x) for x in f"^{text}$"]
    return [(a * 961 + b * 31 + d + 7919 * part) % BUCKETS for a, b, d in zip(c, c[1:], c[2:], strict=False)]


def train(labelled=LABELLED, epochs: int = 400, rate: float = 2.0, l2: float = 1e-3) -> tuple[list[int], int]:
    """Whole-number weights and bias of the regression on trigram frequencies."""
    x = np.zeros((len(labelled), BUCKETS))
    for i, (url, _) in enumerate(labelled):
        host, path = split_url(url)
        b = buckets(host, 0) + buckets(path, 1)
        np.add.at(x[i], b, 1 / max(1, len(b)))
    y = np.array([v for _, v in labelled], float)
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        g = p - y
        w -= rate * (x.T @ g + l2 * w)
        bias -= rate * 0.1 * g.mean()
    return np.rint(w * SCALE).astype(int).tolist(), int(round(bias * SCALE))


def host_path() -> tuple[Column, Column]:
    """Host and path of the column url."""
    has = F.coalesce(F.col("url").contains("://"), F.lit(False))
    # the first "://" counts: what follows it, however many more there are
    rest = F.when(has, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(rules) -> tuple[Column, Column]:
    """The rule that fits best and its verdict, over the columns host and path; both null where none fits."""
    name = verdict = None
    for rule, what in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(f"/{p}"))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def margin(bias: int) -> Column:
    """Sum of the trigrams' weights, with the bias for each trigram, over the columns host_codes, path_codes
    and weights: positive is a block."""

    def total(codes: str, k: int) -> Column:
        return F.expr(
            f"aggregate(if(size({codes}) < 3, array(), sequence(1, size({codes}) - 2)), 0L, (s, i) -> s + {bias} + "
            f"weights[(element_at({codes}, i) * 961 + element_at({codes}, i + 1) * 31 + element_at({codes}, i + 2) + {7919 * k}) % {BUCKETS}])"
        )

    return total("host_codes", 0) + total("path_codes", 1)


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, margin) for every page."""
    weights, bias = train(labelled)
    host, path = host_path()
    codes = lambda c: F.expr(f"transform(regexp_extract_all(concat('^', {c}, '$'), '(?s).', 0), x -> ascii(x))")
    rule, verdict = rule_columns(rules)
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumns({"host_codes": codes("host"), "path_codes": codes("path"), "weights": F.expr("array(" + ",".join(map(str, weights)) + ")")})
        .withColumns({"margin": margin(bias), "rule": rule, "by_rule": verdict})
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin")
    )


def sql(rules=RULES, labelled=LABELLED) -> str:
    """DuckDB SQL for the same rows."""
    weights, bias = train(labelled)
    ordered = sorted(rules, key=lambda r: -len(r[0]))

    def case(pick):
        out = "CASE"
        for r in ordered:
            h, _, p = r[0].partition("/")
            out += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{pick(r)}'"
        return out + " END"

    def total(c, k):
        return (
            f"coalesce(list_sum(list_transform(range(1, len(c_{c}) - 1), lambda i: "
            f"w[1 + (c_{c}[i] * 961 + c_{c}[i + 1] * 31 + c_{c}[i + 2] + {7919 * k}) % {BUCKETS}] + {bias})), 0)"
        )

    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
         h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
         c AS (SELECT *, list_transform(regexp_extract_all('^' || host || '$', '(?s).'), lambda x: unicode(x)) AS c_host,
                      list_transform(regexp_extract_all('^' || path || '$', '(?s).'), lambda x: unicode(x)) AS c_path,
                      [{",".join(map(str, weights))}] AS w FROM h),
         m AS (SELECT *, CAST({total("host", 0)} + {total("path", 1)} AS BIGINT) AS margin, {case(lambda r: r[0])} AS rule, {case(lambda r: r[1])} AS by_rule FROM c)
    SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict, margin FROM m
    """


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
