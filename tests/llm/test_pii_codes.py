from pyspark.sql import functions as F

from tidebar.llm import pii

CODES = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "SE45 5000 0000 0583 9825 7466", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "ES9121000418450200051332"]


def test_upper_case_word_behind_a_full_code(documents):
    rows = [(10 * i + k, f"pay {c}{tail}") for i, c in enumerate(CODES) for k, tail in enumerate(("", " BIC CAIXESBB", " EUR", ", SWIFT", " ABCD EFGH"))]
    got = {r.doc_id: [(s.start, s.end) for s in r.iban] for r in pii.find_pii(documents(rows)).collect()}
    assert got == {k: [(4, 4 + len(CODES[k // 10]))] for k, _ in rows}
    clean = {r.doc_id: r.t for r in documents(rows).select("doc_id", pii.redact(F.col("text")).alias("t")).collect()}
    assert clean == {k: t.replace(CODES[k // 10], "[IBAN]") for k, t in rows}


def test_context_on_both_sides_and_across_proposals(documents):
    texts = ["10.0.0.1 is the server", "server 10.0.0.1 10.0.0.2", "10.0.0.1 " + "x" * 40 + " server", "server " + "x" * 40 + " 10.0.0.1", "10.0.0.1 999.1.1.1 host", "10.0.0.1"]
    got = {r.doc_id: [s.score for s in r.ip] for r in pii.find_pii(documents(list(enumerate(texts)))).collect()}
    assert got == {0: [0.7], 1: [0.7, 0.7], 2: [0.5], 3: [0.5], 4: [0.7], 5: [0.5]}
