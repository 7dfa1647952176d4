"""Personal data against plain patterns, checksums by hand, context, and odd input."""

import random
import re

from lodestone.llm import pii

#: The four kinds as plain patterns.
PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
PIECES = ["a@b.c", "a@b.c_x@c.d", "é", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "0000000000255.1.1.1", "4111111111111111", "4111 1111-1111 1111", "4111  1111", "+49 (30) 1234-5678 ", "+1", "x@y", "@", "..", "-", " ", "4", "5500005555555559", "12345678901234", "+12345678901", "😀", "%+-a@", "A.b@c.d.e-", "\n", "n@m@o.p"]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def table_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, spans int, spans_m0 string, i string").repartition(4)


def test_base_spans(spark):
    rnd = random.Random(5)
    texts = [None, "", ".", "+" + "1" * 50_000, "1" * 100_000, "a" * 100_000 + "@" + "b.c" * 3, "1.2.3.4 " * 3000, "x@y.zz, " * 3000] + ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", "x"]) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    got = {r[0]: r[1] for r in pii.pii(table_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert [tuple(x)[:3] for x in got[i] if x["base"]] == plain(text), text


def found(spark, texts):
    return {r[0]: [(x["kind"], x["score"]) for x in r[1]] for r in pii.pii(table_of(spark, texts)).collect()}


def test_added_kinds(spark):
    got = found(spark, [
        "to GB82 WEST 1234 5698 7654 32 now", "GB82WEST12345698765433", "iban DE89370400440532013000", "my SSN: 078-05-1120", "part 078-05-1120", "ssn 000-05-1120",
        "call me at 212-555-1234", "item 212-555-1234", "call +1 212-555-1234", "email a@b.cd", "a@b.cd",
    ])
    assert got[0] == [("iban", 0.7)] and got[1] == [] and got[2] == [("iban", 1.0)] and [x[0] for x in got[3]] == ["ssn"] and got[4] == got[5] == []
    assert [x[0] for x in got[6]] == ["local_phone"] and got[7] == [] and [x[0] for x in got[8]] == ["phone"] and got[9][0][1] > got[10][0][1]


def test_masked(spark):
    texts = [None, "", "é a@b.cd, 1.2.3.4 x", "nothing", "tel +49 30 1234567 and a@b.c_x@c.d."]
    d = table_of(spark, texts)
    got = pii.masked(d)
    assert got.columns == d.columns
    assert [r["text"] for r in sorted(got.collect())] == [None, "", "é <email>, <ip> x", "nothing", "tel <phone> and <email><email>."] and got.first()["spans_m0"] == "x"


def test_odd_tables(spark):
    d = spark.createDataFrame([(None, "a@b.cd"), (None, "a@b.cd"), (3, None)], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in pii.pii(d).collect()) == [0, 1, 1]
    assert pii.pii(d.limit(0)).collect() == [] and pii.masked(d.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = pii.pii(table_of(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
