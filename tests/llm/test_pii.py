import hashlib
import random
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.llm import pii

# The contract's patterns, read by another regular expression engine.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "", re.ASCII)
        if passes(kind, m.group())
    ]


TEXTS = [
    None, "", "nothing here", "write to a.b+c@mail.example.org, or x@y", "a@b.c_d@e.f@g.h é\U0001f525 i@j.kk.",
    "x@y@b.c", "1.2.3.4.5.6.7.8 and 256.1.1.1 0001.2.3.004 1234.5.6.7 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 or 4111111111111111 5500005555555559000",
    "call +1 (555) 123-4567. +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +49 30 123456) ",
    "\U0001f525 4111 1111 1111 1111 x\n10.0.0.1\n+33 1 23 45 67 89", "a" * 50_000, "1" * 50_000, "1.2.3.4 " * 500,
    "a@" + "b." * 20_000 + "c", "+1" + " 2" * 30_000, "1 " * 30_000, ".".join(["7"] * 4001),
    "@@@ ++ .. 1.2.3 +1 a@b .a@-.-", "DE89 3704 0044 0532 0130 00 bank, DE89370400440532013001",
]


def test_spans_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "q@w.e", None), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    want = {(i, ",".join(brute(t))) for i, t, _ in rows}
    for r in got:
        base = [s for s in r.spans.split(",") if s and s.split(":")[0] in pii.BASE_KINDS]
        assert (r.doc_id, ",".join(base)) in want
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        for kind in pii.BASE_KINDS:
            assert getattr(r, f"n_{kind}") == sum(s.startswith(kind + ":") for s in base)
        assert len(list(filter(None, r.scores.split(",")))) == len([s for s in r.spans.split(",") if s])
    assert pii.report(docs.limit(0)).count() == 0


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: ",".join(brute(r.text)) for r in docs.collect()}
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert {i: ",".join(s for s in t.split(",") if not s.startswith("iban")) for i, t in got.items()} == want
    assert any(want.values())


@pytest.mark.parametrize("text, valid", [("DE89370400440532013000", True), ("GB82 WEST 1234 5698 7654 32", True), ("DE88370400440532013000", False)])
def test_mod97(spark, text, valid):
    assert spark.range(1).select(pii.mod97(F.lit(text)).alias("v")).first().v is valid


def test_context_moves_the_score_and_redaction(spark):
    texts = [(0, "my card 4111111111111111 ok"), (1, "order 4111111111111111 ok"), (2, None), (3, "DE89370400440532013000 for a@b.cd")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    scores = {r.doc_id: [s.score for s in r.pii] for r in pii.find_spans(docs).collect()}
    assert scores[0][0] > scores[1][0] and scores[2] == []
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean == {0: "my card <card> ok", 1: "order <card> ok", 2: None, 3: "<iban> for <email>"}


DE, GB, FR = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"
ACCOUNTS = [
    "IBAN DE89370400440532013000 BIC COBADEFF", f"{GB} Please pay", f"{DE} 2024-05-01", "REF12 DE89370400440532013000",
    f"{DE} {GB} {FR} X", f"NO12 {DE}", f"{FR}.", "IBANDE89370400440532013000", "NO93 8601 1117 947 1", "DE88370400440532013000 A",
    f"\U0001f525é {DE}\n{GB}X", "MT84 MALT 0110 0001 2345 MTLC AST0 01S 5", "QX89 3704 0044 0532 0130 00", "AB12 " * 300,
    "ZZ48 3704 0044 0532 013 A BC", "ZZ4837040044053201312", "aZZ48370400440532013", "AA00 " + "1" * 5000, DE + "\n" + DE, "DE89", "",
]


def remainder(number):
    plain = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def brute_accounts(text):
    """Every place and every length, tried one by one."""
    lengths = {code: n for n, codes in pii.ACCOUNT_LENGTHS.items() for code in codes.split()}
    found, at = [], 0
    while at < len(text):
        best = None
        known = lengths.get(text[at : at + 2])
        if re.match("[A-Z]{2}[0-9]{2}", text[at:]) and (known or not re.match("[A-Za-z0-9]", text[at - 1 : at])):
            for n in [known] if known else range(15, 35):
                end = re.compile(rf"[A-Z0-9]{{4}}(?: ?[A-Z0-9]){{{n - 4}}}" + ("" if known else "(?![A-Z0-9])")).match(text, at)
                if end and remainder(end.group()) == 1:
                    best = end.end()
        if best:
            found.append(f"iban:{at}:{best}")
        at = best or at + 1
    return found


def test_account_numbers_equal_brute_force(spark):
    rng = random.Random(5)
    pieces = [DE, GB, FR, DE.replace(" ", ""), "NO9386011117947", "REF12", "BIC COBADEFF", "2024-05-01", "X", "7", "é", "ok", "QX89", "DE89"]
    texts = ACCOUNTS + [rng.choice(["", " ", "\n"]).join(rng.choices(pieces, k=6)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in pii.report(docs).collect()}
    assert {texts[i]: spans for i, spans in got.items()} == {t: brute_accounts(t) for t in texts}
    assert [len(got[i]) for i in range(10)] == [1, 1, 1, 1, 3, 1, 1, 1, 1, 0]


def brute_scores(text, spans):
    scores = []
    for span in filter(None, spans.split(",")):
        kind, start, end = span.split(":")
        near = text[max(0, int(start) - 40) : int(start)] + "\n" + text[int(end) : int(end) + 40]
        score = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9}[kind]
        score += 0.1 * bool(re.search(pii.SUPPORTING[kind], near.lower(), re.ASCII))
        scores.append(round(score - 0.1 * bool(re.search(pii.DOUBTING, near.lower())), 2))
    return scores


def test_scores_are_in_the_query(spark):
    from strata.llm import queries

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op8_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.scores == ",".join(f"{s:.2f}" for s in brute_scores(texts[r.doc_id], r.spans))
    assert len({s for r in got for s in r.scores.split(",")}) > 3


def test_sql_says_the_same_of_account_numbers_and_scores(spark):
    texts = [t for t in ACCOUNTS if len(t) < 1000] + [f"my bank {DE} test", "a@b.cd mail", "host 1.2.3.4 é", "x" * 70 + " 10.0.0.1 " + "login " * 3]
    documents = pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = pii.report(docs)
    sql = duckdb.sql(f"SELECT {', '.join(want.columns)} FROM ({pii.report_sql()})").fetchall()
    assert len(documents) == len(texts) and sorted(sql) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(
    "text, kind, n",
    [(" ".join(["1.2.3.4"] * 100_000), "ip", 100_000), ("é DE89370400440532013000 " * 20_000, "iban", 20_000), ("a@b.cd " * 50_000, "email", 50_000)],
)
def test_one_text_of_very_many_spans(spark, text, kind, n):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.report(docs).first()
    assert row[f"n_{kind}"] == n and time.time() - began < 60
    spans = [s for s in row.spans.split(",") if s.startswith(kind)]
    step = len(text) // n if kind != "ip" else 8
    places = [int(s.split(":")[1]) for s in spans]
    assert places == [places[0] + step * i for i in range(n)]
