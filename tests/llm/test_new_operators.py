"""Lexical search, personal data and centroid clusters against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import centroid_clusters, lexical_search, pii, queries

R = random.Random(11)
WORDS = ["".join(R.choice("abcdeéß") for _ in range(R.randint(1, 3))) for _ in range(60)]


def prose(n):
    return "".join(R.choice(WORDS).capitalize() + R.choice([" ", ", ", "-", "\n", "\x00", "'"]) for _ in range(n))


def brute_search(documents, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, split(t)) for i, t in documents]
    docs = [(i, w) for i, w in docs if w]
    total, df = sum(len(w) for _, w in docs), Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in docs:
            tf, m = Counter(w), 25 + 75 * len(w) * len(docs) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in split(text) if tf[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("size", [16_384, 3])
def test_lexical_search(spark, size, monkeypatch):
    monkeypatch.setattr(lexical_search, "DOCUMENTS", size)
    texts = [prose(R.randint(1, 60)) for _ in range(90)]
    documents = [*enumerate(texts), (3, texts[3]), (3, prose(5)), (200, texts[7]), (None, texts[7]), (201, None), (202, ""), (203, "-- !!"), (204, "long " + prose(40_000))]
    items = [*enumerate(prose(8) for _ in range(12)), (0, texts[5]), (1, None), (2, ""), (5, "zzzz nowhere"), (None, texts[9][:40]), (7, "a a A é"), (7, "a a A é")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in documents], "doc_id long, text string, item_id string, n int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    for k, blocks in ((10, 1_000_000), (3, 20)):
        got = lexical_search.lexical_search(docs, asked, k, asked=blocks)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == brute_search(documents, items, k)
    assert lexical_search.lexical_search(docs.limit(0), asked).count() == 0
    assert lexical_search.lexical_search(docs, asked.limit(0)).count() == 0
    named = docs.select(docs.doc_id.cast("string").alias("doc_id"), "text")
    assert dict(lexical_search.lexical_search(named, asked).dtypes)["doc_id"] == "string"


def test_lengths_of_any_size():
    n = np.array([1, 10**9, 5 * 10**12], np.int64)
    assert lexical_search.damping(n, 10**12, 10**18).tolist() == [25 + 75 * int(x) * 10**12 // 10**18 for x in n]
    assert lexical_search.terms_of("Ab-c\x00D9é ÀÄ") == ["ab".encode(), b"c", "d9é".encode(), "ÀÄ".encode()]


def brute_base(text):
    """The four base kinds by their patterns alone."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) < 256 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(found)]


def test_base_spans_equal_their_patterns():
    pieces = ["a", "b.c", "@", "@x.de", ".", "..", "1", "25", "256", "007", "1.2.3.4", "4111 1111-1111 1111", "4111111111111111", "+", "+49 (30) 1234-567", "-", "  ", "\n", "é", "%", "(", "0" * 13, "٣", "://", "token"]
    for _ in range(6000):
        text = "".join(R.choice(pieces) for _ in range(R.randint(1, 14)))
        assert [s for s in pii.find(text) if s[1] in pii.BASE] == brute_base(text), text
    numbers = ["".join(R.choice("0123456789") + R.choice(["", "", " ", "-", "."]) for _ in range(R.randint(10, 40))) for _ in range(3000)]
    assert all([s for s in pii.find(x) if s[1] in pii.BASE] == brute_base(x) for x in numbers)


@pytest.mark.parametrize(
    ("text", "kind", "held"),
    [
        ('Token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        ("MY_API_KEY:sk-Ab12Cd34Ef56Gh78", "secret", "sk-Ab12Cd34Ef56Gh78"),
        ("mail müller@bücher.de, now", "mailbox", "müller@bücher.de"),
        ("see https://bob:pw1@host.org/x", "login", "bob:pw1"),
        ("IBAN GB82 WEST 1234 5698 7654 32 PAY it", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("Account no: 0012345678.", "account", "0012345678"),
        ("SSN 123-45-6789,", "ssn", "123-45-6789"),
    ],
)
def test_cued_spans(text, kind, held):
    assert [text[a:b] for a, k, b in pii.find(text) if k == kind] == [held]


@pytest.mark.parametrize("text", ["tokens = abcdef0123456789abcdef", "a token of thanks", 'broken = "04dbebab91ab85687d33eeaaf9"', "SSN 000-12-3456", "SSN 900-12-3456", "IBAN GB82 WEST 1234 5698 7654 33", "https://host.org/a:b@c", "accounts of 123456789 men", "token = aaaaaaaaaaaaaaaaaaaa1", "token = " + "ab1" * 3000, "http://a:80/x@y"])
def test_clean_texts_have_no_cued_spans(text):
    assert [s for s in pii.find(text) if s[1] not in pii.BASE] == []


def test_long_texts_take_linear_time():
    import time

    for one in ("a" * 1000 + "@", "1.", "1 ", "+1 ", "token=", "token=ab1c", "http://a:b", "IBAN AA11", "é@é."):
        text = one * (2_000_000 // len(one))
        began = time.time()
        found = pii.find(text)
        assert time.time() - began < 40
        assert [s for s in found if s[1] in pii.BASE][:1] == brute_base(text[:4000])[:1] or one in ("1.", "1 ", "+1 ")


def test_personal_data_rows(spark):
    rows = [(1, "x a@b.cd y +1 (017) 555-7713"), (1, "x a@b.cd y +1 (017) 555-7713"), (2, None), (None, ""), (3, 'é token = "abcdef0123456789" 😀 10.0.0.1')]
    df = spark.createDataFrame([(i, t, "old", 5) for i, t in rows], "doc_id long, text string, spans string, kind int")
    got = pii.personal_data(df, redacted="clean")
    assert got.columns == ["doc_id", "text", "kind", "spans", "clean"]
    got = got.collect()
    assert Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.spans)) for r in got) == Counter((i, tuple(pii.find(t or ""))) for i, t in rows)
    assert {r.clean for r in got} == {"x <email> y <phone>", "", 'é token = "<secret>" 😀 <ip>'}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_pii_query(spark):
    from conftest import DATA

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.queries()["op12_pii"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in pii.BASE]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in pii.find(texts[r.doc_id]))
    assert sum(len(re.findall(r'token = "', t, re.I)) for t in texts.values()) == sum(r.spans.count("secret:") for r in got)


def brute_clusters(vectors, k, rounds, width, scale=1024):
    fit = [(i, [max(-(2**53), min(2**53, math.floor(scale * x))) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(fit, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in fit]
        groups = [[v for o, (_, v) in zip(own, fit, strict=True) if o == j] for j in range(len(cs))]
        cs = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, cs, strict=True)]
    last = [(i, *near(v)) for i, v in fit]
    most = 2**63 - 1
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    return Counter((i, j, min(d, most), min(inertia[j], most), min(sum(inertia.values()), most), tuple(cs[j])) for i, d, j in last)


@pytest.mark.parametrize("case", ["plain", "wide", "few", "same", "huge"])
def test_clusters(spark, case):
    width = 4
    draw = lambda: [round(R.choice([-3, 0, 4]) + R.gauss(0, 1), 3) for _ in range(width)]
    vectors = [(i, draw()) for i in range({"few": 3}.get(case, 150))] + [(3, draw()), (3, [0.5, 0.5, 0.5, 0.5]), (None, draw())]
    vectors += [(900, None), (901, []), (902, draw() + [1.0]), (903, [1.0, None, 0.0, 0.0]), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf")] * 4)]
    if case == "same":
        vectors = [(i, [1.5, -2.0, 0.25, 0.0]) for i in range(40)] * 2
    if case in ("wide", "huge"):
        vectors += [(910 + j, [x * {"wide": 1e7, "huge": 1e300}[case] for x in draw()]) for j in range(6)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in vectors], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = centroid_clusters.cluster(df, k=8, rounds=5, width=width)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert Counter((*r[:5], tuple(r.centroid)) for r in got.collect()) == brute_clusters(vectors, 8, 5, width)
    assert centroid_clusters.cluster(df.limit(0), width=width).count() == 0


def test_rounds_compare_changed_centroids_only():
    v = np.array([[0, 0], [10, 10], [4, 4], [6, 6]], np.int64)
    c = np.array([[0, 0], [10, 10], [5, 5]], np.int64)
    owner, distance = np.array([0, 1, 0, 1]), np.array([0, 0, 32, 32])
    got = centroid_clusters.nearest(v, owner, distance, c, np.array([False, False, True]))
    assert got[0].tolist() == [0, 1, 2, 2] and got[1].tolist() == [0, 0, 2, 2]
    # an equal distance goes to the smaller number, whichever of the two has changed
    tie = centroid_clusters.nearest(np.array([[5, 5]]), np.array([1]), np.array([50]), np.array([[0, 0], [10, 10]]), np.array([True, False]))
    assert tie[0].tolist() == [0]
