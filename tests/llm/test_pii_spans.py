"""op8 against plain regular expressions over whole texts, and many matches in one text."""

import hashlib
import random
import re
import time

import pytest

from weftgraph.llm import pii, queries

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if valid(kind, m.group())]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def texts():
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "x@@y.z.w@q.r", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49.30.1234567890123", "++1 23",
             "é", "ß@ß.de", "😀", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "SSN 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "password: hunter2", "plain words", "\n", "0" * 30, "-", "12 34"]
    out = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(12)))) for i in range(300)]
    return [*out, (1000, None), (1001, ""), (1002, "a" * 50000 + "@b.c"), (1002, "7 " * 20000), (None, "me@home.org")]


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pii"))
    spark.createDataFrame(texts(), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return queries.op8_pii(spark, folder).collect()


def test_counts_and_base_hash(got):
    want = sorted((str(i), *[sum(s.startswith(k) for s in base(t or "")) for k, _ in PATTERNS], hashlib.sha256(",".join(base(t or "")).encode()).hexdigest()) for i, t in texts())
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_spans_hold_the_base_and_what_the_method_adds(got):
    by = dict(texts())
    added = {}
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        if r.doc_id != 1002:
            assert [s for s in spans if s.split(":")[0] in dict(PATTERNS)] == base(by[r.doc_id] or "")
            starts = [int(s.split(":")[1]) for s in spans]
            assert starts == sorted(starts)
            for s in spans:
                kind, a, b = s.split(":")
                if kind in pii.EXTRA:
                    added.setdefault(kind, set()).add(by[r.doc_id][int(a) : int(b)])
    assert "04dbebab91ab85687d33eeaaf9ac699e1188f962" in added["secret"]
    assert "DE89 3704 0044 0532 0130 00" in added["account"] and "123-45-6789" in added["account"]


def test_many_candidates_take_time_in_proportion(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "abcdefg12 " * n)], "doc_id long, text string")
        began = time.time()
        assert pii.personal_data(df).count() == 1
        return time.time() - began

    seconds(100)
    few, many = seconds(10_000), seconds(80_000)
    assert many < 16 * max(few, 1)


def test_a_secret_is_found_in_a_text_without_digits(spark):
    own = ["password: hunter", "no secret here", 'api key="correct-horse-battery" and more', "", "secret = abc", "é 😀 token=ghp_abcdefgh"]
    docs = [*enumerate(own), *[(100 + i, f"{t} 7") for i, t in enumerate(own)], *[(200 + i, f"see abcdefgh{i} and /path/{i}{i}{i}{i}{i}{i}{i}{i}") for i in range(40)]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.candidates for r in pii._found(df).select("doc_id", "candidates").collect()}
    assert [[c.value for c in got[i]] for i in range(6)] == [["hunter"], [], ["correct-horse-battery"], [], [], ["ghp_abcdefgh"]]
    assert all(own[i][c.start : c.end] == c.value for i in range(6) for c in got[i])
    spans = {r.doc_id: r.all_spans for r in pii.personal_data(df).collect()}
    # a digit elsewhere in the text changes nothing, and every secret after a key word is kept
    assert all(spans[i] == spans[100 + i] for i in range(6)) and [len(spans[i]) for i in range(6)] == [1, 0, 1, 0, 0, 1]
