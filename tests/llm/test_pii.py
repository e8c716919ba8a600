"""Personal data, against Python's regular expressions."""

import hashlib
import random
import re
import time

import pytest

from symgraph.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    text = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(x[1] == k for x in found) for k in range(4)], hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, _t string, spans string")
    got = [(r["doc_id"], [r[f"n_{k}"] for k in BASE], r["base_sha256"]) for r in pii.find(df).collect()]
    want = [(r[0], *brute(r[1])) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_base(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "_d@e.f", "x.y@mail3.example.com", "@", ".", "1.2.3.4", ".5", "300.1.2.3", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005",
            "+1 (504) 555-2652", "+49", " ", "-", "é", "\U0001f600", "\x01", "\x02", "\n", "word", "12", "7", "+", "(", ")", "%", "a", "ö@ü.de", "4417467210607149"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))), "", "") for i in range(800)]
    rows += [(None, None, "", ""), (900, "", None, None), (901, "a" * 200_000, "", ""), (902, "1" * 100_000 + ".1.1.1", "", ""), (903, "1 2-" * 30_000, "", ""), (904, "x@y.zz " * 2000, "", "")]
    rows += rows[:3]
    check(spark, rows)


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r[0], r[1], "", "") for r in docs.select("doc_id", "text").collect()])


def test_added_spans(spark):
    texts = {
        1: "please call (415) 555-2671 soon", 2: "SSN 219-09-9999 on file", 3: "IBAN DE89 3704 0044 0532 0130 00 please",
        4: "contact jane [at] mail [dot] com now", 5: "version 10.12.2020 of page 123 456", 6: "plain words only", 7: "order 1234567890123456 shipped",
    }
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    found = {i: [(x.split(":")[0], texts[i][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in s.split(",") if x] for i, s in got.items()}
    assert found[1] == [("local_phone", "(415) 555-2671")]
    assert found[2] == [("ssn", "219-09-9999")]
    assert found[3] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found[4] == [("masked_email", "jane [at] mail [dot] com")]
    assert found[5] == found[6] == found[7] == []


def brute_base(text):
    """Valid base spans as (start, kind, end)."""
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.A):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            found += [(m.start(), k, m.end())] if ok else []
    return found


def brute_features(k, m, before, after):
    d = re.sub("[^0-9]", "", m)
    shape = re.sub(r"[\x20.()/]", "-", re.sub("[0-9]", "9", m))
    flags = [
        re.search("^-?999-{1,2}999-9999$", shape),
        re.search(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", m) and not re.search(r"^(?:000|666|9)|^...-00|-0000$", m),
        re.search(r"^(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]$|^[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}$", m),
        "." in m,
        *[re.search(p, before, re.A) for p in pii._CUES.values()],
        re.search(r"[#$€£=v]\x20?$", before), re.search(r"^\x20?(?:%|€|\$|kg|km|cm|mm|MB|GB)", after), re.search("[A-Z]", m),
    ]
    return [float(k), float(len(d)), float(len(m)), float(len(re.findall(r"[\x20./()-]", m))), *[1.0 if f else 0.0 for f in flags]]


def brute_spans(text, trees, thresholds):
    """Every candidate is held against every base span and every other candidate."""
    base, good = brute_base(text), []
    for pattern, kinds in ((pii._DIGITS, (4, 5)), (pii._IBAN, (6,)), (pii._MASKED, (7,))):
        end = 0
        for m in re.finditer(pattern, text, re.A):
            before, end = text[max(end, m.start() - 40) : m.start()], m.end()
            following = re.compile(pattern, re.A).search(text, m.end())
            after = text[m.end() : min(m.end() + 4, following.start() if following else len(text))]
            for k in kinds:
                f = brute_features(k, m.group(), before, after)
                if sum(pii._value(t, f) for t in trees) >= thresholds[k] - 1e-9:
                    good.append((m.start(), k, m.end()))
    left = [x for x in good if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
    left = [x for x in left if not any(y[0] <= x[0] and x[2] <= y[2] and x[2] - x[0] < y[2] - y[0] for y in left)]
    return ",".join(f"{(pii.BASE + pii.MORE)[k]}:{s}:{e}" for s, k, e in sorted(base + left))


def test_all_spans_by_brute_force(spark):
    rng = random.Random(8)
    bits = ["call ", "SSN ", "IBAN ", "order ", "mail ", "(415) 555-2671", "219-09-9999", "DE89 3704 0044 0532 0130 00", "jane [at] mail [dot] com", "10.12.2020", "123 456 7890",
            "415.555.2671", "0415/5552671", "GB29ABCD60161331926819", "x@y.zz", "1.2.3.4", "+1 (504) 555-2652", "4111 1111 1111 1111", "DE89x@y.zz", ", ", "\n", "word ", "$", "é "]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 150 if i % 20 == 0 else 12)))) for i in range(400)]
    trees, thresholds = pii.model(spark)
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_spans(t, trees, thresholds) for i, t in rows}
    assert sum("local_phone" in x for x in got.values()) > 20 and sum("iban" in x for x in got.values()) > 20


@pytest.mark.parametrize("unit", ["a@b.co ", "1.2.3.4 ", "call 415-555-2671 a@b.co "])
def test_a_dense_megabyte(spark, unit):
    """Twice the text takes about twice the time; nothing is paired with everything."""
    pii.model(spark)
    took = []
    for n in (1 << 10, 1 << 20):
        text = (unit * (n // len(unit) + 1))[:n]
        began = time.perf_counter()
        r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
        took.append(time.perf_counter() - began)
        assert sum(r[f"n_{k}"] for k in BASE) >= n // len(unit) - 1
    assert took[1] - took[0] < 5


def test_running(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [([rng.randrange(-50, 50) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 200, 1000)]
    df = spark.createDataFrame(rows, "v array<bigint>").select("v", pii.running("v", lambda a, b: F.greatest(a, b), -99).alias("top"), pii.running("v", lambda a, b: a + b, 0).alias("sum"))
    for r in df.collect():
        assert r["top"] == [max(r["v"][: i + 1]) for i in range(len(r["v"]))] and r["sum"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))]


def test_no_python_in_the_plan(spark):
    df = pii.find(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
