import hashlib
import re

from pyspark.sql import functions as F

from tidebar.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
]
TEXTS = [
    "write to a.b@c.de or x@y, a@b.com_x@d.org; a@b.com.c@d.org @@ z@-.-",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.02.3.255 999.1.2.3.4 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500 0000 0000 0004 12345678901234567890123 4 4",
    "call +1 (456) 555-2186, +44 20 7946 0958 +1 +12 ( 3 +1234567890123456 +49.151.1234567x",
    "ä𝄞é mail: ü@x.org m@x.org 𝄞 +49 151 23456789\x01 1.1.1.1\x02",
    "1" * 3000 + " " + "a" * 3000 + "@" + "b." * 3000 + "c " + "+1 " * 2000,
    "4111111111111111 " * 700,
    "",
    None,
]


def test_base_spans_against_plain_patterns(documents):
    found = pii.find_pii(documents(list(enumerate(TEXTS))))
    got = {r.doc_id: r for r in pii.Digest().apply(found).collect()}
    for i, t in enumerate(TEXTS):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PLAIN for m in re.finditer(p, t or "") if ok(m[0])]
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("iban")] == want, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(k) for s in want) for k in pii.BASE]


def test_account_codes_and_context(documents):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 here"), (2, "my account: GB82WEST12345698765432."), (3, "DE89 3704 0044 0532 0130 01"), (4, "xGB82WEST12345698765432")]
    got = {r.doc_id: r for r in pii.find_pii(documents(rows)).collect()}
    assert [len(got[i].iban) for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    assert (got[1].iban[0].start, got[1].iban[0].end) == (5, 32)
    scores = {r.doc_id: r.ip[0].score for r in pii.find_pii(documents([(1, "server at 10.0.0.1"), (2, "value 10.0.0.1")])).collect()}
    assert scores[1] > scores[2]


def test_redaction_leaves_clean_text_alone(documents):
    rows = [(1, "mail a@b.de, card 4111 1111 1111 1111, ip 1.2.3.4, call +44 20 7946 0958!"), (2, "nothing 12 here 1.2.3"), (3, None), (4, "")]
    got = {r.doc_id: r.t for r in documents(rows).select("doc_id", pii.redact(F.col("text")).alias("t")).collect()}
    assert got == {1: "mail [EMAIL], card [CARD], ip [IP], call [PHONE]!", 2: rows[1][1], 3: None, 4: ""}


def test_edges(documents):
    assert pii.find_pii(documents([])).collect() == []
    twice = pii.Digest().apply(pii.find_pii(documents([(None, "a@b.de"), (None, "a@b.de")]))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    plan = pii.find_pii(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
