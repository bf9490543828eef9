import hashlib
import random
import re

import pyarrow as pa
import pytest

from wicker.llm import pii, secret_scan
from wicker.llm.pii import find, find_pii, luhn, mod97
from wicker.llm.queries import op5_pii, op8_secret_scan
from wicker.llm.secret_scan import RULES, Rule, compiled, masked, open_ledger, scan_secrets
from pyspark.sql import functions as F

TEXTS = [
    "a@b.c.d, x..y@z.w@q.r.s and @no.one or me@host only",
    "1.2.3.4.5.6.7.8 and 1.2.3.999 and 001.02.3.4 12.3.4",
    "4111 1111 1111 1111 or 4111-1111-1111-1112, 5755695738806562",
    "+49 (30) 1234-5678. and +1 2 and ++1 555 010 0000",
    "9" * 3000,
    "a." * 3000 + "@",
    "",
]


def naive(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert [x[:3] for x in find(text) if x[0] in pii.BASE] == naive(text)


def test_checks_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB83WEST12345698765432")
    assert find("my IBAN GB82 WEST 1234 5698 7654 32 ok")[0][:3] == ("iban", 8, 35)
    assert find("number 219-09-9999 here") == []
    assert find("her SSN 219-09-9999 here")[0][0] == "ssn"
    assert pii.score("call +49 30 12345678", "phone", 5, 20) > pii.score("version +49 30 12345678", "phone", 8, 23)


def with_check(country, rest):
    """A valid account number of the country."""
    left = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
    return f"{country}{left:02d}{rest}"


def test_accounts_end_where_their_country_says():
    accounts = ["ES9121000418450200051332", "BE68539007547034", "AT611904300234573201", "GB82WEST12345698765432", "NO9386011117947", "SE4550000000058398257466"]
    accounts += [with_check(c, ("7" * 40)[: n - 4]) for c, n in pii.IBAN_LENGTH.items()]
    accounts += [with_check("QQ", "1234" * n) for n in range(3, 8)]
    for account in accounts:
        spaced = " ".join(account[k : k + 4] for k in range(0, len(account), 4))
        for shown in (account, spaced):
            for after in ("", ",", " BIC X", " EUR", " 2024", " 2024 2025 USD", " A1", " and more", f" {accounts[0]}", " " + accounts[1] + " 2024"):
                found = [x[1:3] for x in find(f"to {shown}{after}") if x[0] == "iban"]
                assert found[:1] == [(3, 3 + len(shown))], (shown, after)
                assert len(found) == 1 + ("ES91" in after or "BE68" in after), (shown, after)
    assert [x[1:3] for x in find("CD34 BE68 5390 0754 7034 EUR") if x[0] == "iban"] == [(5, 24)]
    assert not [x for x in find("BE68 5390 0754 7035 EUR or BE685390075470340") if x[0] == "iban"]
    assert find("AB12 CD34 " * 5000) == []


def test_pii_rows(docs_of, odd_rows):
    got = find_pii(docs_of([*odd_rows, (50, TEXTS[0])])).collect()
    assert len(got) == len(odd_rows) + 1
    assert [len(r.spans) for r in got if r.doc_id == 50] == [len(naive(TEXTS[0]))]
    assert find_pii(docs_of([])).count() == 0


SECRET = "x TOKEN = 'abcdef12' y AKIA" + "Q" * 20 + " z " + "0a" * 14


def test_secret_rules():
    found = secret_scan.find(SECRET, compiled(RULES))
    assert [f["kind"] for f in found] == ["assign", "access", "hex"]
    assert secret_scan.find("token = abc", compiled(RULES)) == []
    assert secret_scan.find("ſecret=abcdefg", compiled(RULES)) == []
    assert secret_scan.find("-----BEGIN RSA PRIVATE KEY-----", compiled(RULES))[0]["kind"] == "private_key"


def test_ledger_scans_new_pairs_only(spark, docs_of, odd_rows, tmp_path):
    ledger = f"{tmp_path}/ledger"
    docs = docs_of([*odd_rows, (50, SECRET), (51, SECRET), (None, SECRET)])
    got = scan_secrets(docs, ledger).collect()
    assert len(got) == len(odd_rows) + 3
    assert sorted(str(r.doc_id) for r in got if r.spans) == ["50", "51", "None"]
    texts = {t or "" for _, t in odd_rows} | {SECRET}
    assert open_ledger(spark, ledger).count() == len(texts)
    assert sorted(map(str, scan_secrets(docs, ledger).collect())) == sorted(map(str, got))
    assert open_ledger(spark, ledger).count() == len(texts)
    raised = (*RULES[:2], Rule("hex", 2, r"[0-9a-f]{30,}"), *RULES[3:])
    again = scan_secrets(docs, ledger, raised).where("doc_id = 50").first()
    assert [s.kind for s in again.spans] == ["assign", "access"]
    added = [r for r in open_ledger(spark, ledger).collect() if r.rules == ["hex@2"]]
    assert len(added) == len(texts)
    assert scan_secrets(docs_of([]), f"{tmp_path}/none").count() == 0


def test_mask(spark):
    rows = spark.createDataFrame([("ab secret cd", [("k", 3, 9), ("l", 5, 10)]), ("plain", [])], "t string, s array<struct<kind:string,start:int,end:int>>")
    assert [r[0] for r in rows.select(masked(F.col("t"), F.col("s"))).collect()] == ["ab [SECRET]cd", "plain"]


def naive_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def random_texts(parts, seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


SECRET_PARTS = ["password", "Secret", "api_key", "APIKEY", "token", '"', "'", " ", ":", "=", "ab12", "+/x", "AKIA", "QZ09", "deadbeef", "0", "f", "é", "-----", "eyJ", "ſ", "\n", "ghp_"]


def test_base_secrets_against_the_patterns_as_stated():
    ready = compiled(RULES)
    for text in random_texts(SECRET_PARTS, 1, 1500):
        assert [(f["kind"], f["start"], f["end"]) for f in secret_scan.find(text, ready) if f["kind"] in secret_scan.BASE] == naive_secrets(text), text


def test_base_personal_data_against_the_patterns_as_stated():
    parts = ["a", "b.c", "@", ".", "-", " ", "1", "255", "256", ".7", "4111", "1111", "+", "49", "(30)", "  ", "é", "x_%", "\n"]
    for text in random_texts(parts, 2, 1500):
        assert [x[:3] for x in find(text) if x[0] in pii.BASE] == naive(text), text


def as_digest(found, base):
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    return (*[sum(k == b for k, _, _ in found) for b in base], hashlib.sha256(joined.encode()).hexdigest())


def test_queries_against_the_patterns_as_stated(spark, docs_of, odd_rows, tmp_path):
    docs = [*odd_rows, *enumerate(TEXTS, 100), *enumerate(random_texts(SECRET_PARTS, 3, 60), 200)]
    docs_of(docs).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for query, base, plain in ((op8_secret_scan, secret_scan.BASE, naive_secrets), (op5_pii, pii.BASE, naive)):
        got = sorted(((r.doc_id, *[r[f"n_{b}"] for b in base], r.base_sha256) for r in query(spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted(((i, *as_digest(plain(t or ""), base)) for i, t in docs), key=repr)


def test_texts_that_can_hold_nothing_are_told_apart():
    texts = ["plain words, no digit", "", None, "x@", "one 1", "ünï ² ٣ + - ."]
    assert pii.may_hold(pa.array(texts)).to_pylist() == [False, False, None, True, True, False]
    parts = ["a", "GB82 WEST 1234 5698 7654 32", "@", "b.c", " ", "219-09-9999", "4111", "é", "²", "+49 30 12345678", "1.2.3.4"]
    for text in random_texts(parts, 4, 1500):
        assert pii.may_hold(pa.array([text]))[0].as_py() or find(text, 0) == [], text


def test_patterns_begin_with_characters_and_find_what_was_stated():
    stated = {
        pii._IP: r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        pii._SSN: r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        pii._IBAN: r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    }
    parts = ["GB82", "WEST", "1234", " ", "é", "Z", "_", "000", "666", "9", "219-09-9999", "-", "00", "123-45-", "6789", ".", "7", "255", "²", "\n"]
    for text in random_texts(parts, 5, 3000):
        for ready, plain in stated.items():
            assert [m.span() for m in ready.finditer(text)] == [m.span() for m in re.finditer(plain, text)], text
    assert all(p.pattern.startswith("[") for p in stated)  # the engine skips to such a beginning
