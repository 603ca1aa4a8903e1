"""Crawls of many seeds at once against each alone."""

import random

import pytest

from webloom.operators import crawl as c


@pytest.fixture(scope="module")
def links(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        h = rng.choice("ab")
        rows.append((f"https://{h}.x/{rng.randint(0, 25)}" + rng.choice(["", "#f"]), rng.randint(0, 9), f"https://{rng.choice('aab')}.x/{rng.randint(0, 40)}" + rng.choice(["", "#g", "/skip"])))
    rows += [("https://a.x/0", 1, None), ("https://a.x/0", 2, "mailto:q"), (None, 1, "https://a.x/9")]
    return spark.createDataFrame([(*r, "x") for r in rows], "url string, pos int, link string, host string")


@pytest.mark.parametrize("given", [{"limit": 4}, {"max_depth": 4, "limit": 30, "exclude": "skip$"}, {"include": ["1", "2"]}, {"same_host": False, "limit": 25}, {"limit": 1}])
def test_each_crawl_is_as_it_is_alone(spark, links, given):
    seeds = ["https://a.x/0", "https://a.x/1#top", "https://b.x/3"]
    got = c.crawl_all(links, spark.createDataFrame([(s, 1) for s in [*seeds, None, "https://a.x/1", "https://nowhere.x/"]], "seed string, place int"), **given).collect()
    for s in seeds:
        want = sorted(map(tuple, c.crawl(links, s, **given).collect()))
        assert sorted(tuple(r)[1:] for r in got if r.seed == s.split("#")[0]) == want
    assert {r.seed for r in got} == {"https://a.x/0", "https://a.x/1", "https://b.x/3", "https://nowhere.x/"}


def test_no_seeds(spark, links):
    assert c.crawl_all(links, spark.createDataFrame([], "seed string")).collect() == []
    with pytest.raises(ValueError, match="excludePaths"):
        c.crawl_all(links, spark.createDataFrame([], "seed string"), exclude="(")
