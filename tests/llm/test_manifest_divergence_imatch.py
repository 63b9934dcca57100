"""Operators 11 to 13 against brute-force versions over awkward rows: nulls in every column, empty and very
long texts, repeated rows and ids, empty tables, columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlake.llm import op11_merkle, op12_divergence, op13_imatch
from fundlake.llm.common import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, block int, term string, id long, next_text string, depth int"


def fixture_rows():
    r = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}é" for k in range(400)] + ["the", "Of", "und"]
    rows = []
    for k in range(150):
        n = r.choice([3, 30, 120, 400])
        text = " ".join(r.choice(words[:200 + 200 * (k % 2)]) if r.random() < 0.8 else "THE" for _ in range(n))
        rows.append((k * 3, text, ["en", "fr", "en", "Ä"][k % 4], f"s{k % 7}", len(text)))
    rows += [(1000, None, "en", "s1", None), (1001, "", "en", None, 0), (1002, " \n\t0 1 2", None, "s2", 8), (1003, "alone", "solo", "only", 5),
             (1004, "12 34", "digits", "a", 5), (1005, "--", "digits", "b", 2), (None, "no id", "en", "s1", 5), (None, "no id", "en", "s1", 5),
             (None, None, None, None, None), (0, rows[0][1], rows[0][2], "s0", rows[0][4]), (0, "other text of that id", "en", "s0", 21),
             (1006, "long " * 300_000 + "tail", "fr", "s6", 1_500_004), (1007, rows[1][1], "fr", "s1", rows[1][4]), (1008, "x" * 300_000, "fr", "s5", 300_000),
             (1009, "\x00\x1c é \U0001f600" * 9, "en", "s3", 3), (1010, "", "", "", 0)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    full = [(*row, "h", 1, "t", 9, "n", 2) for row in rows]
    spark.createDataFrame(full, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_empty_tables(spark, empty_dir):
    for query in (op11_merkle.op11_merkle, op12_divergence.op12_divergence, op13_imatch.op13_imatch):
        assert query(spark, empty_dir).collect() == []


# ------------------------------------------------------------------ 11

def digest(*fields) -> str:
    told = ["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields]
    return hashlib.sha256("".join(told).encode()).hexdigest()


def joined(digests) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def tree(leaves, fanout):
    """Root, and for each leaf its siblings by level as (left, right)."""
    paths, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(place):
            first = at // fanout * fanout
            paths[k].append(("".join(level[first:at]), "".join(level[at + 1:first + fanout])))
        place = [at // fanout for at in place]
        level = [joined(level[k:k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


def manifest(rows, fanout=2):
    leaves = []
    for i, text, lang, source, n_chars in rows:
        altered = i is not None and n_chars is not None and zlib.crc32(str(i).encode()) % 7 == 0
        h = digest(i, source, lang, n_chars, text)
        leaves.append((lang, i, h, digest(i, source, lang, n_chars + 1, text) if altered else h))
    groups = {}
    for x in sorted(leaves, key=lambda x: (x[1] is None, x[1] or 0, x[2])):
        groups.setdefault(x[0], []).append(x)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[2] for x in groups[g]], fanout) for g in names}
    root, tops = tree([subs[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops):
        for (_, i, h, altered), path in zip(groups[g], subs[g][1]):
            back = altered
            for left, right in path + top:
                back = joined([left, back, right])
            out.append((i, h, subs[g][0], root, joined([a + b for a, b in path + top]), back, back == root))
    return out


COLUMNS_11 = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_against_a_plain_tree(spark, sf_dir, rows):
    got = [tuple(r) for r in op11_merkle.op11_merkle(spark, sf_dir).select(*COLUMNS_11).collect()]
    assert sorted(map(str, got)) == sorted(map(str, manifest(rows)))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("fanout,digits", [(2, 2), (3, 2)])
def test_manifest_of_several_rounds_of_blocks(spark, fanout, digits):
    """Small blocks: groups of 1 to 100 leaves need one to four rounds, one group holds most rows."""
    leaves = [("hot", k, joined([str(k)])) for k in range(100)] + [(f"g{k}", k, joined([f"g{k}"])) for k in range(5)] + [(None, 1, joined(["n"])), (None, 2, joined(["m"]))]
    df = spark.createDataFrame(leaves, "g string, at long, h string")
    held = op11_merkle.manifest(df, "g", ["at"], fanout, digits)
    names = sorted({x[0] for x in leaves}, key=lambda g: (g is not None, g or ""))
    subs = {g: tree([x[2] for x in leaves if x[0] == g], fanout) for g in names}
    root, tops = tree([subs[g][0] for g in names], fanout)
    want = {}
    for g, top in zip(names, tops):
        for x, path in zip([x for x in leaves if x[0] == g], subs[g][1]):
            want[x] = (subs[g][0], root, path + top)
    got = {(r.g, r.at, r.h): (r.subroot, r.root, [tuple(s) for s in r.path]) for r in held.collect()}
    assert got == want


# ------------------------------------------------------------------ 12

def words_of(text):
    return re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def audit(rows, min_docs, top=10):
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w, c in Counter(words_of(text)).items():
            n[lang, source, w] += c
            docs[lang, w] += 1
    kept = {lang: [w for (g, w), d in docs.items() if g == lang and d >= min_docs] for lang in {g for g, _ in groups}}
    out = []

    def rates(counts, terms):
        total = sum(counts.values())
        return {w: 1 + 10 ** 9 * (counts[w] + 2) // (total + 2 * len(terms)) for w in terms}
    for lang, terms in kept.items():
        by = {s: Counter({w: n[lang, s, w] for w in terms}) for g, s in groups if g == lang}
        p = {s: rates(c, terms) for s, c in by.items()}
        q = rates(sum(by.values(), Counter()) if by else Counter(), terms)

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in by:
            told = [(sum(f(p[s][w], p[o][w]) for w in terms), o.encode()) for o in by if o != s]
            out += [(lang, s, "pair", o.decode(), v, k + 1) for k, (v, o) in enumerate(sorted(told, key=lambda x: (-x[0], x[1])))]
            told = [(f(p[s][w], q[w]), w) for w in terms if by[s][w] and p[s][w] > q[w]]
            out += [(lang, s, "term", w.decode(), v, k + 1) for k, (v, w) in enumerate(sorted(told, key=lambda x: (-x[0], x[1]))[:top])]
    return out


@pytest.mark.parametrize("min_docs,held,piece", [(10, 250_000, 1_000_000), (1, 100, 50), (2, 1, 5000)])
def test_divergence_against_all_terms(spark, sf_dir, rows, min_docs, held, piece):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = op12_divergence.audit(docs, min_docs, held=held, piece_bytes=piece).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, audit(rows, min_docs)))


def test_divergence_in_many_blocks(spark, sf_dir, rows):
    """Row blocks of two groups and column blocks of 16 terms give what one block gives."""
    groups, cells = op12_divergence.matrix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {(r.lang, r.source, r.item): r.value for r in op12_divergence.pairs(groups, cells, 2, 16).collect()}
    want = {(x[0], x[1], x[3]): x[4] for x in audit(rows, 10) if x[2] == "pair"}
    assert got == want


@pytest.mark.parametrize("height,width,share,limit", [(1, 1, 1.0, 4), (7, 33, 0.2, 5), (20, 64, 0.0, 8), (13, 5, 0.6, 1), (40, 300, 0.03, 1 << 18)])
def test_quadtree_walk_equals_the_dense_sum(height, width, share, limit):
    r = np.random.default_rng(height)
    zero = r.integers(1, 50, height)
    dense = np.repeat(zero[:, None], width, 1)
    filled = r.random((height, width)) < share
    dense[filled] = r.integers(50, 10 ** 9, filled.sum())
    rows, columns = np.nonzero(filled)
    tree_ = op12_divergence.QuadTree(rows, columns, dense[filled], height, width)
    everyone = np.ones(height, bool)
    got = op12_divergence.pair_sums(tree_, zero, width, everyone, everyone, limit)
    for a in range(height):
        for b in range(height):
            assert got[a, b] == (int(((dense[a] - dense[b]) ** 2 // (dense[a] + dense[b])).sum()) if a < b else 0)


# ------------------------------------------------------------------ 13

def terms_of(text):
    return {w.decode() for w in re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))}


def share_of(n):
    return 0 if n <= 64 else 1 if n <= 256 else 2 if n <= 1024 else 3


def fingerprint(terms, band):
    mine, held = sorted(terms & band, key=str.encode), {}
    for w in mine:
        m = hashlib.md5(w.encode()).hexdigest()
        finest = 3 if m[2] == "0" and m[3] < "4" else 2 if m[2] == "0" else 1 if m[2] < "4" else 0
        for s in range(share_of(len(mine)), finest + 1):
            held.setdefault(f"{s}{int(m[:2], 16) % 64:02x}", []).append(w)
    hashes = [k + hashlib.md5(" ".join([k, *ws]).encode()).hexdigest()[:4] for k, ws in sorted(held.items())]
    text = f"{len(mine)}:" + (" ".join(hashes) if mine else hashlib.md5(" ".join(sorted(terms, key=str.encode)).encode()).hexdigest())
    return len(mine), hashes, text


def likeness(a, b):
    s = str(share_of(max(a[0], b[0])))
    x, y = ({h for h in p[1] if h[0] == s} for p in (a, b))
    filled = len({h[:3] for h in x | y})
    return len(x & y) / filled if filled else float(a[2] == b[2])


@pytest.mark.parametrize("broadcast_terms", [500_000, 0])
def test_fingerprints_against_plain_code(spark, sf_dir, rows, monkeypatch, broadcast_terms):
    monkeypatch.setattr(op13_imatch, "BROADCAST_TERMS", broadcast_terms)
    docs = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    df, n = Counter(w for _, t in docs for w in terms_of(t)), len(docs)
    band = {w for w, c in df.items() if c * 1000 >= n and c * 20 <= n}
    want, prints = [], [fingerprint(terms_of(t), band) for _, t in docs]
    for k, (i, t) in enumerate(docs):
        after = (k + 1) % n
        size = len(t) // 4
        edited = t[:len(t) - size] + docs[after][1][:size]
        other = fingerprint(terms_of(edited), band)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[k][2], other[2], likeness(prints[k], other), likeness(prints[k], prints[after])))
    got = op13_imatch.op13_imatch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_equal_texts_and_edits_stand_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cut(op13_imatch.op13_imatch(spark, "/root/testdata/sf0.01"), "test")
    same = docs.join(got, "doc_id").groupBy("text").agg(F.countDistinct("fingerprint").alias("n"))
    assert same.where("n > 1").count() == 0
    near = got.where("n_chars >= 200").agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    assert near[0] > 0.4 and near[1] < 0.05 and near[2] > 0.97


def test_no_python_on_the_main_path(spark, sf_dir):
    text = op13_imatch.op13_imatch(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


def test_next_over_a_single_row(spark):
    one = spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")
    r = op13_imatch.with_next(one).collect()
    assert [(x.doc_id, x.next_text, x.id == x.next_id) for x in r] == [(5, "ab cd", True)]
