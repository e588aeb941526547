import random
import re

from brute import DOCS, documents, empty

from strandline.llm import pii as P

KEY = b"test key"


def test_feistel_is_a_permutation():
    for radices in ([10], [10, 10], [10, 10, 10], [26, 10], [7, 3, 5]):
        space = [[]]
        for r in radices:
            space = [[*s, v] for s in space for v in range(r)]
        assert sorted(P.feistel(s, radices, KEY, "t") for s in space) == sorted(space)


def test_formats_and_validity():
    text = "card 4111 1111 1111 1111, ip 10.20.30.40, date 1999-12-31, ssn 123-45-6789, mail jane.doe7@example.com, call +1 (389) 555-5010, iban DE89 3704 0044 0532 0130 00, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"."
    new, spans = P.pseudonymise(text, KEY)
    assert [k for k, _, _ in spans] == ["card", "ip", "date", "ssn", "email", "phone", "iban", "secret"]
    for kind, a, b in spans:
        assert new[a:b] not in text, kind
    assert re.fullmatch(r"card (\d{4} ){3}\d{4}, ip [\d.]+, date \d{4}-\d\d-\d\d, ssn \d{3}-\d\d-\d{4}, mail [a-z]{4}\.[a-z]{3}\d@example.com, call \+1 \(\d{3}\) \d{3}-\d{4}, iban DE\d\d (\d{4} ){4}\d\d, token = \"[0-9a-f]{40}\"\.", new)
    again, more = P.pseudonymise(new, KEY)
    assert [k for k, _, _ in more] == [k for k, _, _ in spans], "pseudonyms are valid in their formats"


def test_decoys_stay():
    for text in ("4111 1111 1111 1112", "300.1.2.3", "1999-02-30", "000-12-3456", "DE89 3704 0044 0532 0130 03", "Version 2.0", "no at sign @ here", "1.2.3.4.5", "12345"):
        assert P.pseudonymise(text, KEY) == (text, [])


def test_dates_are_permuted_within_their_days():
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1990, 2020) for m in range(1, 13) for d in range(1, 29)]
    new = [P.date(d, KEY) for d in days]
    assert len(set(new)) == len(days) and all(P.date(n, KEY) for n in new)


def test_documents(spark):
    r = random.Random(2)
    mail = "bob.smith@mail.example.org"
    rows = [*DOCS, (30, f"write to {mail} now", "a"), (31, "x" * r.randrange(1, 5) + f" {mail}", "b")]
    out = {r.doc_id: r for r in P.pseudonyms(documents(spark, rows).withColumnRenamed("lang", "pii"), KEY).collect()}
    assert out[30].text.split()[2] == out[31].text.split()[1] != mail
    assert out[2].text is None and out[2].pii == []
    assert all(out[i].text == t for i, t, _ in DOCS)
    s = out[30].pii[0]
    assert out[30].text[s.start : s.end].endswith("@mail.example.org") and s.kind == "email"
    assert P.pseudonyms(empty(spark), KEY).count() == 0


def test_a_value_has_one_pseudonym_in_all_its_spellings():
    digits = lambda x: re.sub(r"\D", "", x)
    one = lambda x: P.pseudonymise(x, KEY)[0]
    assert len({digits(one(x)) for x in ("+49 30 123456 78", "+49-30-123456-78", "+493012345678")}) == 1
    assert {digits(one(x))[-10:] for x in ("(212) 555-0123", "212-555-0123", "212.555.0123", "+1 212 555 0123", "+12125550123")} == {digits(one("212-555-0123"))}
    for day, month in ((25, 1), (1, 12), (13, 6), (12, 6)):
        y, m, d = one(f"2020-{month:02d}-{day:02d}").split("-")
        assert one(f"{day:02d}.{month:02d}.2020") == f"{d}.{m}.{y}" and (int(d) > 12) == (day > 12)
        assert one(f"{day:02d}/{month:02d}/2020" if day > 12 else f"{month:02d}/{day:02d}/2020") == (f"{d}/{m}/{y}" if day > 12 else f"{m}/{d}/{y}")
    assert one("Bob.Smith@x.com").lower() == one("bob.smith@x.com") != "bob.smith@x.com"
    assert one("2001:db8:0:0:0:0:0:1") == one("2001:DB8::1") != "2001:db8::1"
    assert len({one(f"fe80::{i:x}") for i in range(1, 200)}) == 199


def test_ibans_of_other_countries_stay_valid():
    for text in ("HR12 1001 0051 8630 0016 0", "RO49AAAA1B31007593840000", "MT84MALT011000012345MTLCAST001S"):
        new, spans = P.pseudonymise(f"to {text}, please", KEY)
        flat = new[spans[0][1] : spans[0][2]].replace(" ", "")
        assert [k for k, _, _ in spans] == ["iban"] and flat != text.replace(" ", "") and P._mod97(flat) == 1


def test_more_decoys_stay():
    for text in ("at 12:30:45 today", "std::vector<int>", "::1", "a::b", "1:2:3:4:5:6:7:8:9"):
        assert P.pseudonymise(text, KEY) == (text, [])
