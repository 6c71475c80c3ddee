"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, chat_format, jaccard_join, language_id, line_dedup, packing, quality_rules, queries, substring_dedup, topk_search, url_filter
from gridloom.operators import network

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghijkl") for _ in range(R.randint(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = prose(120)
PASSAGE = prose(55)
TEXTS = [
    BASE, BASE, BASE + " tail", BASE.replace(" ", "\n", 3), None, "", "   \n\t ", "one", "two words", prose(19), prose(20), "Heat " * 300, "Heat " * 299,
    prose(70) + " " + PASSAGE + " " + prose(40), PASSAGE + "\n" + prose(30), prose(10) + " " + PASSAGE, "éà ü " * 40, "x" * 70_000, prose(9000),
    "a line of more than twenty chars\nrest", "A LINE of more than twenty chars \nother", "\ta line of more than twenty chars\n\n", "1234 5678 !!", "\x1c \u00a0\u3000word\u2028next",
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, R.choice(["en", "fr", None]), "s", "clash") for i, t in enumerate(TEXTS)] + [(0, BASE, "en", "s", "clash"), (7, prose(60), "fr", "s", "clash"), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, key string").repartition(3)


@pytest.fixture(scope="module")
def unique(documents):
    return documents.filter("doc_id is not null").groupBy("doc_id").agg({"text": "max"}).withColumnRenamed("max(text)", "text")


def words(text):
    return (text or "").encode().split()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, key string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_url_filter(spark):
    urls = ["http://a.example.com/en/71?x", "https://EXAMPLE.com/en/8", "http://com/en/", "http://xcom/en/", "no scheme", None, "", "http://x.net/de/", "a://b://c/d#e", "http://example.net/de/8", "http://h?q/en/", "http://h#/x", "http://" + "a." * 30_000 + "example.com/en/" + "7" * 100_000, "HTTP://Example.COM/EN/1"]
    pages = spark.createDataFrame([(i, u, "p", "p", "p", 1) for i, u in enumerate(urls)] + [(0, urls[0], "p", "p", "p", 1)], "page_id long, url string, host string, rule string, verdict string, parts int")
    got = sorted(map(tuple, url_filter.url_filter(pages, url_filter.rule_table(spark)).collect()))

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        return host, path, rule, verdict

    assert got == sorted([(i, *judge(u)) for i, u in enumerate(urls)] + [(0, *judge(urls[0]))])
    assert url_filter.url_filter(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, url_filter.rule_table(spark).limit(0)).collect()} == {"allow"}


def brute_classes(rows):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows if (w := words(t))}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = {i: [j for j in sets if j != i and near(sets[i], sets[j])] for i in sets}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (min(seen), len(links.get(i, [])))
    return out


def keyed_classes(rows):
    """``doc_id``, class id and links of rows that may share ids: the smallest id of a class, null last."""
    found = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[found[k][0]].append(i)
    return Counter((i, min((x for x in ids[found[k][0]] if x is not None), default=None), found[k][1]) for k, (i, _) in enumerate(rows))


ODD_IDS = [(i, t) for i, t in enumerate(TEXTS)] + [(1, BASE), (None, BASE), (None, "alone words here"), (None, "alone words here"), (None, None), (2, "another text under that id"), (2, "another text under that id")]


def test_jaccard_join_odd_ids(spark):
    df = spark.createDataFrame(ODD_IDS, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_join(df).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == keyed_classes(ODD_IDS)
    carried = jaccard_join.jaccard_join(df.selectExpr("doc_id", "text", "length(text) as n", "'x' as class_id"), carry=("n", "class_id")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in carried) == keyed_classes(ODD_IDS)
    assert {r.n for r in carried} == {t and len(t) if t is not None else None for _, t in ODD_IDS} - {""} | {0}


def test_representatives(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in ODD_IDS], "doc_id long, text string, lang string").repartition(3)
    kept = [(r.doc_id, r.text) for r in jaccard_join.representatives(df).collect()]
    classes = brute_classes([(k, t) for k, (_, t) in enumerate(ODD_IDS)])
    want = Counter()
    for c in {c for c, _ in classes.values()}:
        members = [ODD_IDS[k] for k in classes if classes[k][0] == c]
        least = min((i for i, _ in members if i is not None), default=None)
        want[least] += 1
        assert any((least, t) in kept for i, t in members if i == least)
    assert Counter(i for i, _ in kept) == want
    same = spark.createDataFrame([(1, BASE), (1, BASE), (2, BASE), (None, BASE)], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in jaccard_join.representatives(same).collect()] == [(1, BASE)]


@pytest.mark.parametrize(("small", "least"), [(2048, 0.99), (20, 0.97)])
def test_jaccard_join_near_the_threshold(spark, small, least, monkeypatch):
    """Without a split, and with nodes so small that sets of one node are split several times."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = []
    for k in range(150):  # pairs whose similarity is 0.8 to 0.85, and some just below
        w = [f"w{R.randrange(10**6)}" for _ in range(R.randint(90, 200))]
        other = list(w)
        for at in R.sample(range(0, len(w) - 5, 7), round((len(w) - 4) * R.uniform(0.075, 0.12) / 5)):
            other[at] = f"v{R.randrange(10**6)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (t.split() for _, t in rows)]
    similar = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(150)]
    assert sum(0.8 <= x <= 0.85 for x in similar) > 30 and sum(0.75 < x < 0.8 for x in similar) > 10
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[2 * k] for k in range(150)]
    assert [x for x, s in zip(found, similar) if s < 0.8].count(1) == 0
    assert sum(found) >= least * sum(s >= 0.8 for s in similar)


def test_jaccard_join(spark, unique, monkeypatch):
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    rows += [(100 + i, " ".join(w if k != 7 * i else "new" for k, w in enumerate(BASE.split()))) for i in range(17)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()} == want
    monkeypatch.setattr(jaccard_join, "SMALL", 4)  # splitting, and tiles of nodes and blocks
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()} == want
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_jaccard_join_repeated_rows(spark, documents):
    got = jaccard_join.jaccard_join(documents).collect()
    assert len(got) == documents.count()
    assert {r.n_links for r in got if r.doc_id == 0} == {4} and {r.class_id for r in got if r.doc_id == 0} == {0}


def test_components(spark):
    edges = [(R.randrange(300), R.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = list(range(1100))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.v: r.component for r in network.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for e in edges for v in e if any(x != y and v in (x, y) for x, y in edges)}


@pytest.mark.parametrize("shard", [8192, 32])
def test_topk_search(spark, shard, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", shard)
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    rows = [(i % 250, [R.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(400 + i, [0.5] * 6) for i in range(30)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [2.0]), (520, []), (540, [0.1] * 9)]
    rows += [(40, [1e17] * 6), (60, [1e15, 1.0, 2.0]), (61, [-1e16, 3e9]), (62, [3e9] * 6), (None, [1.0] * 6), (400, [0.5] * 6), (400, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, 7, 7) for i, v in rows], "vec_id long, embedding array<double>, score long, own long").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.topk_search(df, lambda k: k % 20 == 0).collect())
    ok = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, q, v in (x for x in ok if x[1] % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(v, w)), c) for m, c, w in ok if m != n)[:20]
        want += [(q, k + 1, c, max(-(2**63), min(2**63 - 1, -s))) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    huge = spark.createDataFrame([(0, [1e300, -1e308]), (1, [1e308, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.topk_search(huge, lambda k: k == 0).collect()] == [(0, 1, 1, 2**63 - 1)]
    assert topk_search.topk_search(spark.createDataFrame([], df.schema), lambda k: k % 20 == 0).count() == 0


def test_byte_bpe(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = byte_bpe.decode(byte_bpe.encode(documents, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    enc = byte_bpe.encoding(path, public_tokenizers.PATTERN)
    for r in done.collect():
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.data) == (r.text or "").encode()
    long = "word  two\n\n three's 12.5 é\u00a0 x" * 9000
    assert public_tokenizers.PATTERN == byte_bpe.SPLIT_AT_SPACES
    assert len(list(byte_bpe.parts(long))) > 1 and byte_bpe.encode_text(enc, long) == enc.encode_ordinary(long)
    other = byte_bpe.encoding(path, r"[^ ]+ [^ ]+|.|\n")  # a pattern whose matches reach across spaces
    assert byte_bpe.encode_text(other, long) == other.encode_ordinary(long)
    assert byte_bpe.encode(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_chat_format(spark):
    odd = "".join(chat_format.CONTROL) + "\\\\<|\\ <</s>> [[/INST]] é \n " + chat_format.escape("</s>")
    rows = [(1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "assistant", " lead and trail "), (2, 0, "assistant", ""), (3, 0, "user", "q"), (4, 0, "assistant", "x" * 50_000), (5, 0, "user", "b"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, None, "assistant", "c")]
    order = lambda r: (r[0], -1 if r[1] is None else r[1], r[2], r[3] or "")
    rows.sort(key=order)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows[::-1]], "conv_id long, turn long, role string, text string, formatted string, turns string")
    made = chat_format.chat_format(df, public_tokenizers.path("byte_bpe_50k.json"))
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    for conv, r in back.items():
        turns = [(role, text or "") for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
        assert not any(c in chat_format.escape(odd) for c in chat_format.CONTROL)
    assert chat_format.chat_format(spark.createDataFrame([], df.schema), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    alone = spark.createDataFrame([(None, 0, "assistant", "a"), (None, 1, "user", "b"), (None, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.chat_format(alone, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert sorted(r.turns[0].text for r in back) == ["a", "b", "b"] and all(r.conv_id is None and len(r.turns) == 1 for r in back)


def test_packing(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(documents, path).collect()
    want = Counter()
    for r in documents.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == packing.lower_bound(np.array([r.length for r in rows]))
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_sequences_of_rows_that_share_ids(spark):
    from tokenizers import Tokenizer

    path, size = public_tokenizers.path("word_bpe_49k.json"), 16
    texts = [(1, "one text of a few words"), (1, "another text"), (1, "another text"), (None, "no id " * 9), (None, "no id " * 9), (None, None), (2, "two " * 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    made = packing.sequences(packing.pack_documents(df, path, size), df, path, size).collect()
    tok = Tokenizer.from_file(path)
    want = Counter(i for _, t in texts for i in tok.encode(t or "", add_special_tokens=False).ids + [1])
    assert Counter(i for r in made for i in r.input_ids) == want and max(len(r.input_ids) for r in made) <= size


def test_packing_bound_of_many_pieces():
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(2049, 2100, 600_000), rng.integers(1, 50, 900_000)])
    values, times = np.unique(lengths, return_counts=True)
    bound = packing.lower_bound(values, times=times)
    assert bound == packing.lower_bound(lengths) == 600_000 > -(-lengths.sum() // 4096)  # two of the large ones never fit


def test_packing_with_other_tokenizers(spark, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.by_words(public_tokenizers.path("word_bpe_49k.json")) and not packing.by_words(path)
    tok = Tokenizer.from_file(path)
    want = Counter(zlib.crc32(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in documents.collect())
    got = packing.pack_documents(documents, path, size=1 << 20)
    assert Counter(r.ids_crc32 for r in got.collect()) == want


def test_packing_rounds(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 4097, 3000)
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    packed = packing.pack(df, group=300)
    assert packed.count() == 3000
    bins = packed.select("sequence_id").distinct().count()
    assert bins <= packing.lower_bound(lengths) * 1.01 + 1
    odd = spark.createDataFrame([(1, "Hi <|endoftext|> <|ENDOFTEXT|> a. b.. c., É. x.\ny, 'S IT'S", 0)], "doc_id long, text string, x int")
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(odd.first().text, add_special_tokens=False).ids + [1]
    p = packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json"))
    assert p.first().ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.sequences(p, odd, public_tokenizers.path("word_bpe_49k.json")).first().input_ids == ids


def test_quality_rules(spark, documents):
    got = quality_rules.quality_rules(documents, spark.createDataFrame([(0,), (13,)], "doc_id long")).collect()
    assert len(got) == documents.count()
    want = Counter()
    for r in documents.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert all(r.log_ratio == 0 for r in quality_rules.quality_rules(documents, spark.createDataFrame([], "doc_id long")).collect())
    assert quality_rules.quality_rules(empty(spark), empty(spark)).count() == 0


def spark_hash(data, seed=42):
    value = xxhash.xxh64(data if isinstance(data, bytes) else (data % 2**64).to_bytes(8, "little"), seed=seed % 2**64).intdigest()
    return value - 2**64 if value >= 2**63 else value


def test_quality_ratio_and_verdict(spark):
    """The log-ratio, its bound and the verdict, recomputed without Spark."""
    rows = [(i, prose(R.randint(40, 90)) if i % 3 else " ".join(R.choice(WORDS[:60]) for _ in range(70))) for i in range(90)] + [(1000, None), (1001, "one"), (3, prose(60))]
    trusted = {i for i, _ in rows if i % 3 == 0}
    rows += [(None, prose(70)), (None, prose(70)), (6, rows[6][1])]  # no id is never trusted, and a trusted one may be shared
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality_rules.quality_rules(df, spark.createDataFrame([(i,) for i in (*trusted, None)], "doc_id long")).collect()

    def runs(text):
        h = [spark_hash(w) for w in words(text)]
        return [x % quality_rules.BUCKETS for x in h] + [spark_hash(b, spark_hash(a)) % quality_rules.BUCKETS for a, b in zip(h, h[1:])]

    fold = lambda t: spark_hash((t or "").encode()) % quality_rules.FOLDS if t is not None else 42 % quality_rules.FOLDS
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(runs(t))
        if i in trusted:
            good.update((fold(t), x) for x in runs(t))

    def ratio(text, without=None):
        some = Counter()
        for (f, x), n in good.items():
            some[x] += n * (f != without)
        share = lambda c, x: (c[x] + 1) / (sum(c.values()) + quality_rules.BUCKETS)
        found = [math.log(share(some, x) / share(raw, x)) for x in runs(text)]
        return sum(found) / len(found) if found else 0.0

    own = sorted(ratio(t, fold(t)) for i, t in rows if i in trusted and len(words(t)) >= 50)
    least = own[math.ceil(quality_rules.LOST * len(own)) - 1]
    want = Counter((i, round(ratio(t), 9), ratio(t) >= least) for i, t in rows)
    assert Counter((r.doc_id, round(r.log_ratio, 9), r.kept or (r.base_failed and r.log_ratio >= least)) for r in got) == want
    assert {r.kept for r in got} == {True, False}


def test_quality_verdict_on_held_out_labels(spark):
    whole = "/root/testdata/sf0.1"
    labels, documents = spark.read.parquet(f"{whole}/labels.parquet"), spark.read.parquet(f"{whole}/documents.parquet")
    got = quality_rules.quality_rules(documents, labels.filter("quality = 1 and toxic = 0 and doc_id % 2 = 0"))
    rows = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert len(bad) > 100 and not any(bad)
    assert sum(good) >= 0.97 * len(good) > 0


def test_language_fit_counts_words_of_every_length(spark):
    signs = {"ja": "のにはをたがでてとしれさあるいも", "zh": "的一是不了人我在有他这中大来上国"}
    line = lambda x: "".join(R.choice(signs[x]) for _ in range(150))
    rows = [(i, line(x), x) for i, x in enumerate(["ja", "zh"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.filter("doc_id < 16"), public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs.filter("doc_id >= 16"), model).collect()}
    assert got == {i: x for i, _, x in rows if i >= 16}


def plain_sum(word, weights):
    """The probability of all segmentations, without scaling."""
    sums = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        sums[j] = sums[j - 1] * language_id.UNSEEN + sum(sums[i] * weights.get(word[i:j], 0.0) for i in range(j))
    return sums[-1]


def test_language_sums():
    weights = {"a": 0.2, "b": 0.3, "ab": 0.1, "ba": 0.05, "a" * 20: 0.01}  # pieces of any length
    trie, p = language_id.Trie(tuple(weights)), np.array([[0.0], *([x] for x in weights.values())])
    for word in ("ab", "abba" * 5, "aqb" * 9, "a" * 21, "b" * 300, "ab" * 4_000):
        places = trie.places([word], len(word))
        ahead, back = (language_id.log_sums(places, p, 1, len(word), backward)[:, 0, 0] for backward in (False, True))
        assert ahead[-1] == pytest.approx(back[0])
        if len(word) < 100:
            assert ahead[-1] == pytest.approx(math.log(plain_sum(word, weights)))


def test_language_fit_is_expectation_maximisation():
    words, pieces = Counter({"ab": 3, "aab": 2, "b": 1, "q": 1}), ("a", "aa", "ab", "b", "c")

    def segmentations(word):
        if not word:
            yield (), 1.0
        for n in (1, 2):
            if len(word) >= n:
                p = weights.get(word[:n], 0.0)
                for rest, q in segmentations(word[n:]):
                    if p:
                        yield (word[:n], *rest), p * q
                    if n == 1:
                        yield rest, language_id.UNSEEN * q

    counts = {p: sum(times * sum(w[i : i + len(p)] == p for i in range(len(w))) / len(p) for w, times in words.items()) for p in pieces}
    for _ in range(language_id.ROUNDS):
        weights = {p: (c + 0.01) / (sum(counts.values()) + 0.01 * len(pieces)) for p, c in counts.items() if c}
        counts = dict.fromkeys(pieces, 0.0)
        for w, times in words.items():
            every = list(segmentations(w))
            for found, q in every:
                for p in found:
                    counts[p] += times * q / sum(x for _, x in every)
    want = [(counts[p] + 0.01) / (sum(counts.values()) + 0.01 * len(pieces)) for p in pieces]
    assert language_id.fit(words, pieces) == pytest.approx(want)


def test_language_sample(spark, monkeypatch):
    rows = [(i, f"x{i}", "en" if i % 3 else "fr") for i in range(2000)] + [(1, "x1", "en")] * 30 + [(None, "x4", "en"), (3, None, "fr"), (4, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    both = df.filter("text is not null and lang is not null").selectExpr("lang", "text", "xxhash64(text) as h").distinct().collect()
    smallest = lambda lang, n: {r.h for r in sorted((r for r in both if r.lang == lang), key=lambda r: r.h % 2**64)[:n]}
    n, chosen = language_id.sampled(df, 50)
    assert n == 2 and {(r.lang, r.h1) for r in chosen.collect()} == {(x, h) for x in ("en", "fr") for h in smallest(x, 50)} and chosen.count() == 100
    # many texts under one id or none, and many copies of one text, bring no more
    for i in (7, None):
        _, chosen = language_id.sampled(df.selectExpr("text", "'en' as lang").withColumn("doc_id", F.lit(i).cast("long")), 50)
        assert chosen.count() == 50
    # long texts come last, and all of them have a bound
    monkeypatch.setattr(language_id, "LONG", 4)
    monkeypatch.setattr(language_id, "CHARACTERS", 200)
    _, chosen = language_id.sampled(df, 500)
    texts = {r.h: r.text for r in both}
    sizes = [len(texts[r.h1]) for r in chosen.filter("lang = 'en'").collect()]
    assert sum(sizes) <= 200 and sum(sizes) > 190 and max(sizes) <= 4
    _, chosen = language_id.sampled(spark.createDataFrame([("y" * 900, "en"), ("z" * 900, "en")], "text string, lang string"), 5)
    assert chosen.count() == 1
    with pytest.raises(ValueError, match="languages"):
        language_id.sampled(spark.createDataFrame([(i, "x", str(i)) for i in range(300)], "doc_id long, text string, lang string"))


def test_language_id(spark, documents):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = queries.op8_language_id(spark, DATA).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0
    model = language_id.Model(("en", "fr"), ("▁a", "b", "▁ab"), np.array([[0.3, 0.1], [0.2, 0.4], [0.1, 0.1]]))
    texts = [(0, "ab ab"), (1, None), (2, "12 !"), (3, ""), (4, "q" * 90_000), (0, "ab ab"), (None, "ab ab")]
    got = language_id.predict(spark.createDataFrame([(*x, "clash", 1.0) for x in texts], "doc_id long, text string, lang_pred string, score double"), model).collect()
    p = [(a * b + c) ** 2 for a, b, c in ((0.3, 0.2, 0.1), (0.1, 0.4, 0.1))]
    assert len(got) == len(texts) and [r for r in got if r.doc_id in (0, None)] and all(r.lang_pred == "en" and abs(r.score - p[0] / sum(p)) < 1e-6 for r in got if r.doc_id in (0, None))
    one = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert one[1] == one[2] == one[3] == ("und", 0.0) and one[4] == ("en", 0.5)  # a tie goes to the first name
    assert language_id.train(empty(spark), public_tokenizers.path("piece_bpe_32k.model")) == language_id.NOTHING
    assert language_id.predict(documents, language_id.NOTHING).filter("lang_pred != 'und'").count() == 0
    assert language_id.predict(empty(spark), model).count() == 0


def test_language_known(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(table, public_tokenizers.path("piece_bpe_32k.model"))
    junk = [(-1, "漢字の文章はここで終わりです" * 5), (-2, "☃☄★☆" * 30 + " a"), (-3, "123 456"), (-4, None), (-5, "")]
    both = table.select("doc_id", "text").unionByName(spark.createDataFrame(junk, "doc_id long, text string"))
    left = {r.doc_id for r in language_id.known(both, model).collect()}
    assert left == {r.doc_id for r in table.collect()}


def test_line_dedup(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    least = lambda d: -(2**63) if d is None else d
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(least(d))
    want = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and least(d) != max(held[key(x)]))]
        want[(d, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(documents).collect()) == want
    assert sum(n for (_, _, n, _) in want) > 0
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def brute_substrings(rows):
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        w, gone = words(t), set()
        for p in range(len(w) - 19):
            if (x := tuple(w[p : p + 20])) in seen:
                gone |= set(range(p, p + 20))
            seen.add(x)
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return want


@pytest.mark.parametrize("hot", [2000, 20, 2, 0])
def test_substring_dedup(spark, unique, hot, monkeypatch):
    """Also with repeated rows, and with passages whose prefixes are lengthened to 10, 15 and all 20 words."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    rows += [(600, prose(80))]  # a text that is nowhere else
    rows += [r for r in rows if r[0] in (0, 3, 13, 14, 18, 600)] + [(600, rows[-1][1])]
    passage = PASSAGE.split()
    rows += [(1000 + i, f"{prose(25)} {' '.join(passage[i % 12 : 55 - i % 9])} {prose(25)}") for i in range(60)]
    want = brute_substrings(rows)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == Counter((i, *want[i]) for i, _ in rows)
    assert want[600][1] == 0 and sum(g for _, g, _ in want.values()) > 2000


def test_substring_dedup_lengthens_hot_prefixes(spark):
    """A passage in over 2,000 documents: each length of prefix comes into use."""
    passage = PASSAGE.split()
    rows = [(i, f"{prose(8)} {' '.join(passage)} {prose(8)}") for i in range(2300)]
    want = brute_substrings(rows)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    runs = spark.createDataFrame([(0, 1, 10), (1, 1, 11), (2, 2, 12)] + [(i, 3, 13 + i % 2) for i in range(4001)] + [(i, 4, 15) for i in range(2001)], "node long, run_10 long, run_15 long")
    found = {(r.run_10, r.run_15): r.prefix for r in substring_dedup._lengthened(runs).collect()}
    assert found == {(1, 10): 1, (1, 11): 1, (2, 12): 2, (3, 13): None, (3, 14): 14, (4, 15): None}


def test_substring_dedup_odd_rows(spark, documents):
    out = substring_dedup.substring_dedup(documents.filter("doc_id is not null")).collect()
    rows = [(r.doc_id, r.text) for r in documents.filter("doc_id is not null").collect()]
    assert len(out) == len(rows) and out[0].key == "clash"
    nulls = spark.createDataFrame([(None, PASSAGE), (None, PASSAGE), (5, PASSAGE), (None, prose(40)), (None, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(nulls).collect()) == Counter([(None, 55, 0), (None, 55, 0), (5, 55, 55), (None, 40, 0), (None, 0, 0)])
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def brute_lines(rows):
    """The texts of rows with distinct ids, without the lines that three documents or more share."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    drops = lambda d, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and d != max(held[key(x)])
    return [(d, "\n".join(x for x in (t or "").split("\n") if not drops(d, x))) for d, t in rows]


def test_pipeline(spark):
    """All stages by brute force."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = corpus_pipeline.run(spark, DATA).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]  # all in one of four languages
    texts = brute_lines(docs)
    near = brute_classes(texts)
    texts = [(i, t) for i, t in texts if near[i][0] == i]
    kept = brute_substrings(texts)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, _ in texts:
        ids = tok.encode(kept[i][2], add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[(i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len({r.sequence_id for r in rows}) == packing.lower_bound(np.array([r.length for r in rows]))


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    odd = [(i, t, "en", "s", 1, "x") for i, t in ODD_IDS] + [(900, "漢字の文章" * 30, None, None, None, None), (901, "12 34", "en", "s", 1, None)]
    for name, some in (("odd", odd), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    done = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = Counter(r.doc_id for r in done if r.piece == 0)
    lettered = spark.createDataFrame([(i, t) for i, t in ODD_IDS if t and re.search(r"[^\W\d_]", t)], "doc_id long, text string")
    left = [(r.doc_id, r.kept) for r in line_dedup.line_dedup(lettered).collect()]
    classes = defaultdict(list)
    for k, (c, _) in brute_classes([(k, t) for k, (_, t) in enumerate(left)]).items():
        classes[c].append(left[k][0])
    want = Counter(min((i for i in some if i is not None), default=None) for some in classes.values())
    assert ids == want and 900 not in ids and 901 not in ids
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_digests_are_of_whole_texts(spark):
    got = {r.doc_id: r.decoded_sha256 for r in queries.op4_byte_bpe(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest()
