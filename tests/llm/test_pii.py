import hashlib
import os
import random
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spillspark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(d(m[0])) <= 15],
    }


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.-@+ ()7:é\n4", max_size=60))
def test_base_spans_are_the_patterns(t):
    got = pii.find(t)
    assert {k: got[k] for k in pii.BASE} == brute(t)


def test_cards():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("0123456789 -") for _ in range(40))
        assert pii.find(t)["card"] == brute(t)["card"]
    assert pii.find("x 4111 1111 1111 1111 y")["card"] == [(2, 21)]


def test_added_kinds_and_masks():
    t = 'see https://bob:pw@h.example/x and token = "04dbebab91ab8568", iban DE89370400440532013000, +1 (017) 555-7713'
    s = pii.find(t)
    assert [t[a:b] for a, b in s["account"]] == ["04dbebab91ab8568", "DE89370400440532013000"]
    assert [t[a:b] for a, b in s["url"]] == ["https://bob:pw@h.example/x"]
    out = pii.masked(t, s)
    assert "pw" not in out and "[PHONE]" in out and out.startswith("see [URL] and token")
    assert pii.find("tokens are nice; an account of it")["account"] == []


def test_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a@b.co"), (3, "é" * 50_000 + " 10.0.0.1"), (4, "1.1.1.256")]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as spans")).collect()
    by = {(r.doc_id, r.spans) for r in got}
    assert by == {(1, ""), (2, ""), (None, "email:0:6"), (3, "ip:50001:50009"), (4, "")} and len(got) == 6
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cues_in_any_case():
    for cue in ("apiKey", "ApiKey", "API_KEY", "pAsSword", "İ token", "éİ Iban"):
        text = f"x {cue} = 'abc12345xyz' y"
        assert [text[a:b] for a, b in pii.find(text)["account"]] == ["abc12345xyz"], cue


def test_recall_on_the_given_table():
    """Whatever looks like personal data in the documents lies in some span: all kinds, not the base alone."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the given tables")
    shapes = (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?i)(?<=token = \")[0-9a-f]{40}", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d{1,3}(?:\.\d{1,3}){3}\b")
    seen = caught = 0
    for text in pq.read_table(path, columns=["text"]).column("text").to_pylist():
        spans = sorted(s for v in pii.find(text or "").values() for s in v)
        for shape in shapes:
            for m in re.finditer(shape, text or ""):
                seen += 1
                caught += any(a < m.end() and m.start() < b for a, b in spans)
    assert seen > 30 and caught >= 0.99 * seen
