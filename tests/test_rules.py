"""The prefix index of access rules against trying every rule of a site on every target."""

import random

import pytest

from webloom.operators import rules


def fits(rule, target):
    anchored = rule.endswith("$")
    pieces = (rule[:-1] if anchored else rule).split("*")
    if not target.startswith(pieces[0]):
        return False
    at = len(pieces[0])
    for p in pieces[1:]:
        found = target.find(p, at)
        if found < 0:
            return False
        at = found + len(p)
    return not anchored or at == len(target) or rule.endswith("*$")


def brute(targets, given):
    out = []
    for i, site, target in targets:
        best = max(((len(r), k == "allow", r, k) for s, k, r in given if s is not None and s == site and r and target is not None and fits(r, target)), default=None)
        out.append((i, site, best and best[2], best and best[3], best is None or best[3] != "disallow" or target == "/robots.txt"))
    return sorted(out, key=str)


def run(spark, targets, given):
    t = spark.createDataFrame([(*x, "x") for x in targets], "id long, site string, target string, rule string")
    r = spark.createDataFrame([(*x, 1) for x in given], "site string, kind string, rule string, id int")
    return sorted(map(tuple, rules.decide(t, r).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    part = lambda n: "".join(rng.choice(["/", "a", "b", "é", "_", "%", "$"]) for _ in range(n))
    targets = [(i, rng.choice("st"), "/" + part(rng.randint(0, 70))) for i in range(300)]
    given = [(rng.choice("st"), rng.choice(["allow", "disallow"]), t[2][: rng.randint(0, len(t[2]))] + rng.choice(["", "*", "$", "*$", "*" + part(1), "*" + part(1) + "$"])) for t in targets for _ in range(2)]
    given += [("s", "disallow", "*"), ("s", "allow", "/*a$"), ("t", "disallow", "/" + "x" * 2000), ("t", "allow", "$")] + given[:50]
    targets += [(900, "t", "/" + "x" * 3000), (901, "s", "/robots.txt"), (902, "u", "/free"), (903, None, "/a"), (904, "s", None), (905, "s", "")]
    given += [(None, "disallow", "/"), ("s", "disallow", None), ("s", "disallow", ""), ("u", "allow", "/fre"), ("u", "disallow", "/fre")]
    assert run(spark, targets, given) == brute(targets, given)


@pytest.mark.parametrize("rule,key", [("/a/b", "/a/b"), ("/a/b/c", "/a/b/c"), ("/a/b/cd", "/a/b/c"), ("/a/b*x", "/a/b"), ("/a$", "/a"), ("/a$*", "/a$"), ("*", ""), ("/abcdefgh$", "/abcdefg"), ("$", "")])
def test_keys(spark, rule, key):
    got = rules.keyed_rules(spark.createDataFrame([("s", "allow", rule)], "site string, kind string, rule string")).first()
    assert got.prefix == key


def test_empty(spark):
    assert run(spark, [], [("s", "allow", "/")]) == []
    assert run(spark, [(1, "s", "/")], []) == [(1, "s", None, None, True)]


def test_a_sites_rules_do_not_meet_all_its_targets(spark):
    """10,000 rules and as many targets of one site: what meets is in proportion to both."""
    t = spark.range(10_000).selectExpr("id", "'s' AS site", "concat('/', lower(hex(id * 7919 % 65536)), '/page') AS target")
    r = spark.range(10_000).selectExpr("'s' AS site", "'disallow' AS kind", "concat('/', lower(hex(id * 7919 % 65536)), '/') AS rule")
    met = rules.keyed_targets(t).join(rules.keyed_rules(r), ["site", "prefix"])
    assert met.count() < 40 * 10_000 and rules.decide(t, r).where("NOT allowed").count() == 10_000
    plan = rules.fitting(t, r)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
