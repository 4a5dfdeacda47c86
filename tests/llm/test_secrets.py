import hashlib
import math
import random
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from harvestry.llm import queries, secrets


def brute_base(text):
    """The plain reading of the patterns, with the lengths tested afterwards."""
    word = "".join
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    either = re.sub(r"(password|passwd|secret|token|api_\?key)", lambda m: word(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in m[1]), assign)
    found = [(m.start(), 0, m.end()) for m in re.finditer(either, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(["assign", "access", "hex"][k], s, e) for s, k, e in sorted(found)]


parts = st.sampled_from(["password", "PassWd", "ſecret", "toKen", "API_KEY", "apikey", "=", " : ", '"', "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef", "é", "\U0001f389", " ", "\n", "x", "abc.def-1="])


@settings(max_examples=400, deadline=None)
@given(st.lists(parts, max_size=14).map("".join))
def test_base_spans(text):
    got = [x for x in secrets.Scanner().scan(text) if not x[0].startswith("entropy")]
    assert got == brute_base(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd01", max_size=60), st.integers(1, 24), st.floats(0.5, 2.4))
def test_sliding_entropy(text, width, bits):
    def entropy(part):
        return -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())

    width_ = min(width, len(text))
    covered = set()
    for k in range(len(text) - width_ + 1) if width_ else ():
        if entropy(text[k : k + width_]) >= bits - 1e-10:
            covered |= set(range(k, k + width_))
    got = [i for s, e in secrets.suspicious(text, width, bits) for i in range(s, e)]
    assert sorted(got) == sorted(covered)


def test_entropy_kinds_and_allow_list():
    scan = secrets.Scanner().scan
    key = "Zx8Qm2Lr9Tb4Vn7Kc1Wp6Hd3Yg5Js0F"
    assert scan(f"see {key} here") == [("entropy_base64", 4, 4 + len(key))]
    assert scan("ABCDEFGHIJ0123456789abcdefghij") == []
    assert scan("aB3aB3aB3aB3aB3aB3aB3aB3aB3aB3") == []
    assert scan("1B9D6BCD-BBFD-4B2D-9B5D-AB8DFBBD4BED") == []
    assert scan("Averylongcompoundwordwithoutanydigits") == []
    assert scan(f"{key}abcdefghij") == [("entropy_base64", 0, len(key))]  # only the allowed part is suppressed
    assert scan(f"{key}-1B9D6BCD-BBFD-4B2D-9B5D-AB8DFBBD4BED{key}") == [("entropy_base64", 0, len(key) + 1), ("entropy_base64", len(key) + 37, 2 * len(key) + 37)]
    assert secrets.Scanner(allowed=["Zx8.*"]).scan(f"see {key} here") == []
    assert [k for k, _, _ in scan(f"token={key}")] == ["assign"]


def test_spans_are_swept_in_linear_time():
    dice = random.Random(4)
    unit = "".join(f" token=abcdef{k} {''.join(dice.choices('abcXYZ0123456789defGHI', k=40))} " for k in range(50))
    scan = secrets.Scanner().scan
    scan(unit)

    def seconds(text):
        began = time.process_time()
        found = scan(text)
        return time.process_time() - began, len(found)

    (t, n), (t8, n8) = seconds(unit * 40), seconds(unit * 320)  # a million characters
    assert n8 == 8 * n and t8 < 16 * max(t, 0.05)


def test_query(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables hold no secret
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_secret_scans(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        base = brute_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for k, _, _ in base) for n in ("assign", "access", "hex"))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows(spark):
    dice = random.Random(1)
    long = "word " * 200_000 + "password: hunter22" + "".join(dice.choices("abcdef0123456789", k=50))
    rows = [(1, None), (2, ""), (None, "token=abcdef"), (3, long), (3, long)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = sorted(((r.id or 0), [(s.kind, s.start) for s in r.spans]) for r in secrets.scan(docs).collect())
    assert got[:3] == [(0, [("assign", 0)]), (1, []), (2, [])]
    assert got[3] == got[4] and got[3][1][0] == ("assign", 1_000_000)
    assert secrets.scan(docs.limit(0)).count() == 0
