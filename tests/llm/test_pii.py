import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import pii


def luhn(d):
    return sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    """The contract's patterns as they are written."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


PARTS = ["a.b@c.de", "@", ".", "x", "1.2.3.4", "256", "0255.", "4111 1111-1111 1111", "4349000490986231", "+1 (269) 555-3296", "+", "12", " ", "  ", "-", "é🙂", "_", "\n", "a@b.c_d@e.f", "a@b.com@d.org", "%"]


@pytest.fixture(scope="module")
def found(spark):
    def run(texts):
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
        return {r.doc_id: r for r in pii.find(df).collect()}

    return run


def test_base_against_brute_force(found):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += [None, "", "x" * 3000 + " a@b.cd", "1" * 3000, "1." * 2000, "+1" + "-" * 1000 + "1234567890", ("+1 (269) 555-3296 and 4349000490986231, " * 300)]
    got = found(texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert got[i].base_sha256 == digest(want), (t or "")[:200]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]


def test_very_long_texts(found):
    """Sizes at which the plain patterns' backtracking would not end."""
    got = found(["x" * 300000 + " a@b.cd", "1" * 200000, "1." * 100000, "+1" + "-" * 100000 + "1234567890"])
    assert got[0].base_sha256 == digest([("email", 300001, 300007)]) and got[1].spans == ""
    assert got[2].n_ip == 25000 and got[3].n_phone == 1


def test_bootstrapping_finds_unseen_identifiers(found):
    seeds = [f"please call us at +1 (269) 555-{1000 + i} today" for i in range(12)]
    texts = [*seeds, "please call us at 269-555-7788 today.", "the total was 269-555-9911 units", "version 1.2.3 of it"]
    got = found(texts)
    added = texts[12].index("269")
    assert got[12].spans == f"phone:{added}:{added + 12}" and got[12].n_added == 1
    assert got[13].spans == "" and got[14].spans == ""
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(12))


def test_redact(spark):
    rows = [(1, "mail a@b.cd now", 15, "s"), (2, None, None, "s"), (3, "", 0, "s"), (3, "", 0, "s"), (None, "+1 (269) 555-3296", 17, "s"), (4, "10.0.0.1/4349000490986231", 25, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    got = sorted(map(tuple, pii.redact(df).collect()), key=repr)
    want = [(1, "mail <EMAIL> now", 16, "s"), (2, None, None, "s"), (3, "", 0, "s"), (3, "", 0, "s"), (None, "<PHONE>", 7, "s"), (4, "<IP>/<CARD>", 11, "s")]
    assert got == sorted(want, key=repr)
    assert pii.redact(df.limit(0)).collect() == [] and pii.find(df.limit(0)).collect() == []


def test_redact_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.cd or 10.0.0.1", 7, "k", "t", 3.5, [1], "r", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, _text string, base string, email double, _m_ip array<int>, row string, added int")
    assert sorted(map(tuple, pii.redact(df).collect())) == [(1, "mail <EMAIL> or <IP>", *rows[0][2:])]


def test_recall_on_planted_contextual_identifiers(spark, monkeypatch):
    """Identifiers in forms that no base pattern has, among lines of the same kind that have it, and odd numbers."""
    import random

    rng = random.Random(7)
    cues = ["my direct line is", "reach me under", "ring the office on", "text me at"]
    noise = ["the parcel weighed", "build number", "we sold about", "room"]
    rows, planted = [], {}
    for i in range(400):
        digits = "".join(rng.choice("0123456789") for _ in range(10))
        kind = i % 4
        if kind < 2:
            rows.append((i, f"{rng.choice(cues)} +1 ({digits[:3]}) {digits[3:6]}-{digits[6:]} today"))
        elif kind == 2:
            value = f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"
            text = f"{rng.choice(cues)} {value} today"
            rows.append((i, text))
            planted[i] = f"phone:{text.index(value)}:{text.index(value) + len(value)}"
        else:
            rows.append((i, f"{rng.choice(noise)} {digits[:3]}-{digits[3:6]}-{digits[6:]} units"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (pii.BROADCAST_SPANS, 0):  # accepted spans joined by broadcast, and by row
        monkeypatch.setattr(pii, "BROADCAST_SPANS", most)
        got = {r.doc_id: r for r in pii.find(df).collect()}
        assert sum(got[i].spans == s for i, s in planted.items()) >= 0.95 * len(planted)
        assert sum(got[i].n_added for i in range(3, 400, 4)) == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = pii.find(df)._jdf.queryExecution().executedPlan().toString() + pii.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan
