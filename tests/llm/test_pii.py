import random
import re

from pyspark.sql import functions as F

from shoprank.llm import pii
from tests.llm.common import AWKWARD, documents, tuples

CASES = ["mail a.b+c@ex-ample.co.uk and x@y.z, not @y.z nor a@b", "a@b.c_d@e.f g@h.i@j.k", "1.2.3.4.5.6.7.8 and 256.1.1.1 010.0.0.255 1.2.3",
         "4111 1111 1111 1111, 4111111111111111 4111111111111112 4111-1111-1111-1111-", "card 5 500000000000000004 6011000990139424 00",
         "+1 (415) 555-2671 +49 30 12345 67. +1 2 +123456789012345678 ++44 20 7946 0958", "😀é +1 415 555 2671 漢 a@b.cd", "1" * 3000, "a" * 20_000, "a." * 4000 + "@b.c",
         "1.1." * 3000, "+" * 500 + "1" * 10, "x@" + "a." * 3000 + "a", "- -1 2-3 4"]
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    twice = [sum(divmod(int(d) * 2, 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) < 256 for x in m.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d or "1"), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text or "") if valid(k, m.group())]


def found(df):
    spans = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["x"]] for r in pii.find_spans(df).select("doc_id", spans.alias("x")).collect()}


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(4)
    alphabet = ["1", "2", "5", "4111111111111111", " ", "-", ".", "+", "(", ")", "@", "a", "b.c", "_", "é", "255"]
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + [t for _, t in AWKWARD]
    got = found(documents(spark, list(enumerate(texts)), extra=False))
    for k, t in enumerate(texts):
        assert got[k] == brute(t), t[:80]


def test_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "social security 123-45-6789", "part 123-45-6789", "GB82WEST12345698765432"]
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in ("iban", "ssn")] for r in pii.find_spans(documents(spark, list(enumerate(texts)))).collect()}
    assert rows == {0: [("iban", 5, 32)], 1: [], 2: [("ssn", 16, 27)], 3: [], 4: [("iban", 0, 22)]}
    score = {r["doc_id"]: r["s"] for r in pii.find_spans(documents(spark, [(0, "call +1 415 555 2671"), (1, "see +1 415 555 2671")], False)).select("doc_id", F.col("pii")[0]["score"].alias("s")).collect()}
    assert score[0] > score[1]


def test_ibans_end_at_their_length(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947", "BE68 5390 0754 7034"]
    after = [" Please pay", " The bank", " EUR 500", " 500", " 2 A", ", X", "", " ok", " A", "\n12"]
    texts = [f"{before}{i}{x}" for i in ibans for x in after for before in ("to ", "AB12 ", "DE12 DE34 ", "é REF X1 ")]
    want = [[(before, before + len(i))] for i in ibans for x in after for before in (3, 5, 10, 9)]
    texts += [" ".join(ibans), "DE89 3704 0044 0532 0130 0 EUR", "DE89370400440532013000EUR 1", "DE88 3704 0044 0532 0130 00 Please", "AB12 " * 4000 + ibans[0]]
    ends = [sum(len(x) + 1 for x in ibans[: k + 1]) - 1 for k in range(len(ibans))]
    want += [[(e - len(i), e) for i, e in zip(ibans, ends)], [], [], [], [(20_000, 20_027)]]
    docs = documents(spark, list(enumerate(texts)), extra=False)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["pii"] if s["kind"] == "iban"] for r in pii.find_spans(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k] == want[k], t[:80]
    by = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert by[0] == "to [IBAN] Please pay" and by[8] == "to [IBAN] EUR 500"


def test_redaction_keeps_rows_and_columns(spark):
    rows = [*AWKWARD, (30, "é a@b.cd, 1.2.3.4 😀 +1 415 555 2671"), (31, "+1 4111 1111 1111 1111")]
    docs = documents(spark, rows)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[30] == "é [EMAIL], [IP] 😀 [PHONE]" and by[0] is None and by[1] == "" and by[8] == "one two three"
    assert tuples(pii.redact(documents(spark, [])), "doc_id") == []


def test_plan_is_native(spark):
    plan = pii.redact(documents(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
