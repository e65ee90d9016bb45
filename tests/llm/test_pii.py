"""Personal data: the linear scans against the contract's patterns, and edge rows."""

import random
import re

from lotwise.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [(k, s, e) for k, s, e, _ in pii.find_spans(text) if k in pii.BASE_KINDS]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    pieces = ["a", "b.c", "@", ".", "-", " ", "1", "23", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+", "(",
              ")", "+1 (555) 010-9999", "é", "😀", "x@y.zz", "1.2.3.4", "_", "%", "\n", "0"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25)))
        assert base(text) == brute(text), text


def test_added_kinds_need_checksum_or_context():
    kinds = lambda t: [k for k, *_ in pii.find_spans(t) if k in pii.ADDED_KINDS]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("code 123-45-6789") == []
    assert kinds("call (555) 010-9999") == ["local_phone"] and kinds("part 555 010-9999") == []


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "@" * 200_000, "+1" + "(" * 200_000, "A1" * 200_000):
        pii.find_spans(text)


def test_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "é x@y.zz", None), (4, "x@y.zz", "t"), (4, "x@y.zz", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = sorted((r.doc_id or 0, [tuple(s)[:3] for s in r.spans]) for r in pii.pii_spans(df).collect())
    assert got == [(0, [("email", 2, 8)]), (1, []), (2, []), (4, [("email", 0, 6)]), (4, [("email", 0, 6)])]
    assert pii.pii_spans(df.limit(0)).count() == 0


def test_query_on_whole_table(spark):
    got = pii.op1_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == pii.sha256_of(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PATTERNS]
