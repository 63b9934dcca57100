"""Each operator against a brute-force version on a small fixture with awkward rows: nulls, empty and
long texts, repeated rows, ties, clashing extra columns, empty tables; and whole queries at sf0.001."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from fundlake.llm import op1_quality, op2_chat, op3_bpe, op4_jaccard, op5_embeddings, op6_tokens, op7_decontaminate, op8_suffixes, op9_sharding, op10_licenses
from fundlake.llm.common import components, cut

SF = "/root/testdata/sf0.001"
# extra columns named like the operators' own
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, doc string, held int, id int, score double"


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["an", "er", "th", "ou", "é", "ing", "Sch", "le"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def fixture_texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 300)
    rows: list[tuple[int | None, str | None]] = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, ""), (4, " \n\t"), (5, "one two"), (6, "One  TWO"), (7, "x")]
    r = random.Random(3)
    for k in range(40):  # near copies
        w = list(base)
        for _ in range(r.randint(1, 14)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))
    shared = " ".join(prose(9, 60))
    for k in range(30):  # a passage that many share
        rows.append((200 + k, " ".join(prose(50 + k, 40)) + " " + shared + ".\n" + " ".join(prose(90 + k, 40))))
    rows += [(300, "ab " * 400), (301, "ab " * 300), (302, "a" * 3000), (303, "<|endoftext|> x <|endoftext|><|endoftext|>y"), (304, "\x00\x1c é   \U0001f600" * 20),
             (305, " ".join(prose(5, 20000))), (None, "ab " * 350), (None, None), (300, "ab " * 400), (5, "another text with the same id")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", None if t is None else len(t), "x", None, 3, 4, 0.5) for i, t in fixture_texts()]
    return cut(spark.createDataFrame(rows, SCHEMA).repartition(3), "fixture")


def key(i):
    return (i is None, i or 0)


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k:k + size]) for k in range(len(w) - size + 1)])


def jaccard_groups(rows, size, num, den):
    """Root row of each row."""
    sets, up = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))], sets


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 620)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "t").collect())
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for a in {x for e in edges for x in e if e[0] != e[1]}:
        seen, todo = {a}, [a]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[a] == min(seen)


def test_quality(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = op1_quality.train(d, labels)
    rows = op1_quality.classify(d, model).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.85 * len(held) > 0
    assert op1_quality.accepted(d, model).columns == d.columns


def test_quality_awkward(spark, docs):
    none = op1_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none == {"rate": 0.5}
    one = op1_quality.train(docs, spark.createDataFrame([(200, 1), (201, 1), (201, 0), (None, 0), (202, None)], "doc_id long, quality int"))
    assert one == {"rate": 1.0}
    both = op1_quality.train(docs, spark.createDataFrame([(k, k % 2) for k in range(100, 240)], "doc_id long, quality int"))
    rows = op1_quality.classify(docs, both).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert op1_quality.classify(docs.limit(0), both).count() == 0


def test_forward_backward_matches_enumeration():
    r = np.random.default_rng(4)
    emit, init, trans = r.normal(size=7), r.normal(size=2), r.normal(size=(2, 2))
    first = np.array([0, 4, 4, 7])
    got = op1_quality.marginals(emit, first, init, trans)
    for a, b in ((0, 4), (4, 7)):
        weight = np.zeros((b - a, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            w = np.exp(init[y[0]] + sum(emit[a + k] * v for k, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:])))
            for k, v in enumerate(y):
                weight[k, v] += w
        assert np.allclose(got[a:b], weight[:, 1] / weight.sum(1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"<>[]/|\\sINTuer_ SY", "</s>", "[INST]", "[/INST]", "<|end|>", "<<SYS>>"]), max_size=30))
def test_escape_round_trip(parts):
    text = "".join(parts)
    safe = op2_chat.escape(text)
    assert op2_chat.unescape(safe) == text
    assert not any(c in safe for c in ("</s>", "[INST]", "[/INST]", "<|end|>", "<|turn|>", "<|says|>", "<<SYS>>"))


def test_chat(spark):
    rows = [(1, 1, "assistant", "a</s>"), (1, 0, "user", None), (1, 1, "assistant", "a</s>"), (2, None, None, "<|turn|>\\"), (None, 0, "assistant", ""), (3, 5, "x[INST]", "é\n" * 9)]
    path = public_tokenizers.path(op2_chat.VOCABULARY)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in op2_chat.read_back(op2_chat.format_turns(df, path), path).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert op2_chat.read_back(op2_chat.format_turns(df.limit(0), path), path).count() == 0


def test_bpe(spark, docs):
    path = public_tokenizers.path(op3_bpe.VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in fixture_texts())
    rows = op3_bpe.encode(docs, path).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert sorted(op3_bpe.decode(r.ids, op3_bpe.load(path)) for r in rows) == sorted((t or "").encode() for _, t in fixture_texts())
    assert op3_bpe.encode(docs.limit(0), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30), max_size=8))
def test_replay_any_bytes(words):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = op3_bpe.load(path)
    for w, ids in zip(words, op3_bpe.replay(words, ranks)):
        parts = [w[k:k + 1] for k in range(len(w))]
        while w not in ranks.rank and len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: ranks.rank.get(parts[k] + parts[k + 1], 10**9))
            if parts[best] + parts[best + 1] not in ranks.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        assert ids.tolist() == ([ranks.rank[w]] if w in ranks.rank else [ranks.rank[p] for p in parts])


def test_tokens(docs):
    path = public_tokenizers.path(op6_tokens.VOCABULARY)
    t = Tokenizer.from_file(path)
    want = []
    for i, x in fixture_texts():
        n = len(t.encode(x or "", add_special_tokens=False))
        want.append((i, len((x or "").encode()), n, n > 1024))
    got = [tuple(r) for r in op6_tokens.count_tokens(docs, path).collect()]
    assert Counter(got) == Counter(want)
    assert op6_tokens.count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_jaccard(docs, size, num, den):
    rows = fixture_texts()
    root, sets = jaccard_groups(rows, size, num, den)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i, key=key)
    want = Counter((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, root))
    got = op4_jaccard.jaccard_components(docs, size, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == want
    assert op4_jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_blocks_do_not_change_the_result(docs, monkeypatch):
    want = Counter(map(tuple, op4_jaccard.jaccard_components(docs).collect()))
    monkeypatch.setattr(op4_jaccard, "BLOCK_SETS", 5)
    assert Counter(map(tuple, op4_jaccard.jaccard_components(docs).collect())) == want


def test_jaccard_compares_only_sets_whose_prefixes_may_agree(spark, monkeypatch):
    """passages that texts share tie a cluster together; its blocks no longer meet all by all."""
    rng = random.Random(3)
    passages = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(60)]
    texts = [" ".join(rng.sample(passages, 10)) for _ in range(80)]
    texts += [" ".join("other" if i % 60 == 7 else w for i, w in enumerate(t.split())) for t in texts[::8]]
    rows = list(enumerate(texts))
    root, _ = jaccard_groups(rows, 4, 85, 100)
    monkeypatch.setattr(op4_jaccard, "BLOCK_SETS", 4)
    for paired, fewer in ((32, 60), (3, 91)):  # 3: most passages are too frequent for pairs and tie their texts together
        monkeypatch.setattr(op4_jaccard, "PAIRED", paired, raising=False)
        asked = {}
        monkeypatch.setattr(op4_jaccard, "cut", lambda df, name: asked.setdefault(name, cut(df, name)))
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in op4_jaccard.jaccard_components(d).collect()}
        assert got == {i: min(j for j, q in enumerate(root) if q == p) for i, p in enumerate(root)}
        assert len(set(got.values())) == 80 and asked["nj-parts"].count() >= 60
        assert asked["nj-asking"].count() < fewer


def test_trie_join_finds_all_links():
    r = random.Random(8)
    for _ in range(30):
        sets_ = [np.unique(np.array(r.sample(range(40), r.randint(1, 25)), np.uint64)) for _ in range(25)]
        sets_ += [np.unique(np.append(s[r.randint(0, 1):], np.uint64(99))) for s in sets_[:10]]
        forest, up = op4_jaccard.Forest(len(sets_)), op4_jaccard.Forest(len(sets_))
        op4_jaccard.trie_join(sets_, 7, 10, forest)
        for i, a in enumerate(sets_):
            for j in range(i):
                both = len(np.intersect1d(a, sets_[j]))
                if 10 * both >= 7 * (len(a) + len(sets_[j]) - both):
                    up.join(i, j)
        assert [forest.root(i) for i in range(len(sets_))] == [up.root(i) for i in range(len(sets_))]


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(1)
    centre = r.normal(size=(12, 16))
    vec = [(k, (centre[k % 12] + 0.08 * r.normal(size=16)).tolist(), 0) for k in range(400)]
    vec += [(500 + k, r.normal(size=16).tolist(), 0) for k in range(200)] + [(700 + k, [1.0, 2.0, 0.5], 0) for k in range(3)]
    vec += [(800, None, 0), (801, [0.0] * 16, 0), (802, [float("nan")] * 16, 0), (803, [None] * 16, 0), (804, [], 0), (805, [2.0, 4.0, 1.0], 0), (None, [9.0, 9.0], 0)]
    df = spark.createDataFrame([(*v, 1) for v in vec], "vec_id long, embedding array<float>, n int, id int")
    good = {k: np.array(e, np.float32).astype(float) for k, e, _ in vec if e and k not in (801, 802, 803)}
    links, group = Counter(), {k: k for k in good}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9:
                links[a] += 1
                if group[a] != group[b]:
                    low, high = sorted((group[a], group[b]))
                    group = {k: low if g == high else g for k, g in group.items()}
    for block in (1024, 16):
        monkeypatch.setattr(op5_embeddings, "BLOCK", block)
        got = {x.vec_id: x for x in op5_embeddings.near_duplicates(df).collect()}
        assert len(got) == len(vec)
        assert sum(x.n_links for x in got.values()) >= 0.9 * sum(links.values()) > 0
        assert all(x.n_links <= links[k] for k, x in got.items())
        assert {k: got[k].component_id for k in group} == group
        assert all(got[k].kept and not got[k].n_links for k in (800, 801, 802, 803, 804))
    assert op5_embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_a_dense_group(spark):
    """A third of the vectors are distinct near copies of one: their links are found."""
    r = np.random.default_rng(2)
    v = r.normal(size=(3000, 64))
    v[:1000] = r.normal(size=64) * 8 / 64 ** 0.5 + 0.25 * v[:1000]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    assert links[:1000].min() > 100
    got = {x.vec_id: x for x in op5_embeddings.near_duplicates(df, spread=10).collect()}
    assert all(got[k].n_links <= links[k] for k in got)
    assert sum(x.n_links for x in got.values()) >= 0.99 * links.sum()
    assert {got[k].component_id for k in range(1000)} == {0}


def test_pivots_stand_apart_and_roots_are_least():
    r = np.random.default_rng(3)
    p = op5_embeddings._apart(op5_embeddings._unit([x.tobytes() for x in r.normal(size=(200, 4))]), 0.7)
    near = p @ p.T
    np.fill_diagonal(near, 0)
    assert 1 < len(p) < 200 and near.max() <= 0.7
    for _ in range(20):
        link = r.random((30, 30)) < 0.02
        link |= link.T
        reach = np.linalg.matrix_power((link | np.eye(30, dtype=bool)).astype(float), 30) > 0
        assert (op5_embeddings._roots(link) == reach.argmax(1)).all()


def test_decontaminate(spark):
    items = [(1, " ".join(prose(31, 30))), (2, " ".join(prose(32, 12))), (3, "three words here"), (4, None), (5, "..."), (6, " ".join(prose(31, 30)))]
    near = prose(31, 30)
    near[0] = "changed"
    texts_ = [(1, " ".join(prose(70, 50)) + " " + items[0][1].upper() + "; " + " ".join(prose(71, 50))), (2, " ".join(near)), (3, " ".join(prose(31, 30)[:15])),
              (4, "x Three, words here!"), (5, None), (6, ""), (7, " ".join(prose(72, 500))), (None, items[1][1]), (8, " ".join(prose(73, 3000)) + " " + items[1][1])]
    d = spark.createDataFrame([(i, t, 7) for i, t in texts_], "doc_id long, text string, tag int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 100):
        got = {(r.doc_id, r.item_id): r for r in op7_decontaminate.contaminated(d, bench, block).collect()}
        assert set(got) == {(1, 1), (1, 6), (2, 1), (2, 6), (4, 3), (None, 2), (8, 2)}
        r = got[1, 1]
        assert r.similarity == 1 and texts_[0][1].encode()[r.first_byte:r.end_byte].decode() == items[0][1].upper()
        kept = op7_decontaminate.clean(d, bench, block)
        assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == [3, 5, 6, 7]
    assert op7_decontaminate.contaminated(d, bench.limit(0)).count() == 0
    assert op7_decontaminate.contaminated(d.limit(0), bench).count() == 0


def test_blocks_of_the_benchmark_do_not_change_the_result(spark):
    """Items with a long passage in common: a window without an item's own part is not like it."""
    common, own = prose(40, 60), [prose(41 + k, 20) for k in range(4)]
    items = [(k, " ".join(common + w)) for k, w in enumerate(own)]
    texts_ = [(0, items[0][1]), (1, " ".join(common + own[1][:10] + ["changed"] + own[1][11:])), (2, " ".join(common[:30] + ["changed"] + common[31:] + own[2]))]
    d = spark.createDataFrame(texts_, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [{(r.doc_id, r.item_id): (round(r.similarity, 9), r.distance) for r in op7_decontaminate.contaminated(d, bench, block).collect()} for block in (8_000_000, 100)]
    assert got[0] == got[1] and set(got[0]) == {(0, 0), (2, 2)}


def test_multi_index_finds_all_within_radius():
    index = op7_decontaminate.Items([(k, " ".join(prose(k, 20))) for k in range(60)])
    r = random.Random(6)
    for k in range(60):
        p = index.print[k]
        for b in r.sample(range(64), r.randint(0, op7_decontaminate.RADIUS)):
            p ^= 1 << b
        want = {j: (p ^ q).bit_count() for j, q in enumerate(index.print) if (p ^ q).bit_count() <= op7_decontaminate.RADIUS}
        assert index.within(p) == want and k in want


def removed(rows):
    """n_bytes, n_removed, n_spans, sha256 of each row by the definition."""
    holder = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            holder[w] = min(holder.get(w, i), i, key=key)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if key(holder[b[p:p + 50]]) < key(i):
                gone[p:p + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("wide", [2, 8, 256])
def test_suffixes(docs, monkeypatch, wide):
    monkeypatch.setattr(op8_suffixes, "BUCKET", 300)
    monkeypatch.setattr(op8_suffixes, "WIDE", wide)
    out = op8_suffixes.dedup(docs).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == Counter(removed(fixture_texts()))
    assert op8_suffixes.dedup(docs.limit(0)).count() == 0
    kept = op8_suffixes.cleaned(docs)
    assert kept.columns == docs.columns and kept.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("ids", [(1, None, None), (1, None, None, 7, 7)])
def test_texts_of_equal_crc32_are_told_apart(spark, ids):
    """Rows without a doc_id, or with the same one, and texts that crc32 does not tell apart."""
    seen: dict = {}
    for k in range(400_000):
        x = " ".join(re.findall(".{8}", hashlib.sha512(b"%d" % k).hexdigest()))
        a, b = seen.setdefault(zlib.crc32(x.encode()), x), x
        if a != b:
            break
    rows = list(zip(ids, (a, a, b, a, b)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert a != b and zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    out = op8_suffixes.dedup(d).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == Counter(removed(rows))
    assert sorted(r.text for r in op8_suffixes.cleaned(d).collect() if r.text) == sorted([a, b])
    assert {r.text for r in op4_jaccard.one_of_each(d).collect()} == {a, b}


def test_windows_that_a_run_covers_are_dealt_to_all_buckets():
    """A passage between differing neighbours: its smallest window is the same in every run."""
    passage = " ".join(prose(9, 40))[:120]
    rows = [{"doc": k, "mark": b"", "text": f"{k:03d}" + passage + f"{k:03d}", "held": [{"start": 0, "off": 0, "n": 70, "wide": True}]} for k in range(300)]
    kinds = pa.schema([("doc", pa.int64()), ("mark", pa.binary()), ("text", pa.string()), ("held", pa.list_(pa.struct(
        [("start", pa.int32()), ("off", pa.int32()), ("n", pa.int32()), ("wide", pa.bool_())])))])
    many = Counter()
    for batch in op8_suffixes._runs(16)([pa.RecordBatch.from_pylist(rows, kinds)]):
        for r in batch.to_pylist():
            if r["common"] is None:
                many[r["bucket"]] += len(r["doc"])
    assert sum(many.values()) >= 299 * 67 and len(many) == 16 and max(many.values()) < 2 * sum(many.values()) / 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=50, max_size=50), max_size=12), max_size=6), st.integers(0, 49))
def test_loser_tree_merges(runs, same):
    runs = [sorted(b"\7" * same + x[same:] for x in r) for r in runs]
    coded = [[(x, k, (0, 0, 0)) for x, k in op8_suffixes.unfolded(*op8_suffixes.front_coded(r))] for r in runs]
    out = list(op8_suffixes.LoserTree(coded))
    flat = sorted(x for r in runs for x in r)
    assert [x for x, _, _ in out] == [int.from_bytes(x) for x in flat]
    assert all(k == op8_suffixes.prefix_length(int.from_bytes(a), int.from_bytes(b)) for a, b, (_, k, _) in zip(flat, flat[1:], out[1:]))


def test_sharding(docs):
    for fan in (2048, 8):
        rows = op9_sharding.shard(docs, 16, fan).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in fixture_texts())
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
        together = defaultdict(set)
        for r in rows:
            together[r.text_crc32, r.size].add(r.shard)
        assert all(len(s) == 1 for s in together.values())
    assert op9_sharding.shard(docs.limit(0)).count() == 0


def test_sharding_balance(spark):
    rows = op9_sharding.op9_sharding(spark, SF).groupBy("shard").agg({"size": "sum"}).collect()
    load = [r[1] for r in rows]
    largest = max(len((r.text or "").encode()) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert len(load) == 16 and max(load) - min(load) <= largest


def test_licenses(spark):
    name = "GPL-3.0"
    t = op10_licenses.TEMPLATES[name]
    texts_ = [(1, f"the the the x.\n{t}"), (2, None), (3, ""), (4, " ".join(prose(4, 400)) + " " + t.upper().replace(",", "") + " end " + op10_licenses.TEMPLATES["MIT"]),
              (5, t.replace("work", "thing")), (6, "this license is public"), (None, t), (7, "the " * 5000)]
    d = spark.createDataFrame([(i, x, "l") for i, x in texts_], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in op10_licenses.scan_licenses(d).collect()}
    assert {i: r.license for i, r in got.items()} == {1: name, 2: None, 3: None, 4: name, 5: name, 6: None, None: name, 7: None}
    assert got[4].licenses == [name, "MIT"][::1] and got[1].coverage == 1 and 0.8 <= got[5].coverage < 1
    assert texts_[0][1][got[1].first_byte:got[1].end_byte + 1] == t
    assert op10_licenses.scan_licenses(d.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
     "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License", "GPL-3.0 notice"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-ND 4.0. Licensed under CC BY 4.0.", "CC-BY-4.0 CC-BY-ND-4.0"), ("Licensed under CC BY-XX 4.0.", ""), ("Licensed under CC BY 3.0.", ""),
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), (op10_licenses.TEMPLATES["BSD text"], "BSD text"),
    *[(t, name) for name, t in op10_licenses.TEMPLATES.items() if "full" in name or "notice" in name],
    (op10_licenses.TEMPLATES.get("BSD-3-Clause full", "").replace("copyright holder nor", "Regents nor"), "BSD-3-Clause full")])
def test_licenses_are_told_apart(text, want):
    data = np.frombuffer(text.encode(), np.uint8)
    found = op10_licenses.Scanner(op10_licenses.TEMPLATES, 0.8).scan(data, np.array([0, len(data)]))[0]
    assert " ".join(sorted(f[2] for f in found)) == want


def test_increasing_is_longest():
    r = random.Random(5)
    for _ in range(50):
        x = r.sample(range(12), r.randint(0, 9))
        got = [x[k] for k in op10_licenses.increasing(x)]
        best = max((len(c) for m in range(2 ** len(x)) if (c := [v for k, v in enumerate(x) if m >> k & 1]) == sorted(c)), default=0)
        assert got == sorted(got) and len(got) == best


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [d.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, cut(stage(spark, d, SF), f"test-{name}")
        sizes.append(d.count())
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            root, _ = jaccard_groups(rows, 5, 4, 5)
            assert sorted(r.doc_id for r in d.collect()) == sorted(min(i for (i, _), q in zip(rows, root) if q == p) for p in set(root))
        if name != "tokenize":
            assert d.schema == before.schema
    assert all(a >= b > 0 for a, b in zip(sizes, sizes[1:]))
    assert len(corpus_pipeline.STAGES) == 5 and regex.match(r"\w+", corpus_pipeline.STAGES[0][0])


def test_chat_oracle_and_names(spark):
    import duckdb

    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and sum(bool(re.match(r"op\d+_", n)) for n in names) == 13
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(entry.oracle_sql()["op2_chat"]).fetchall()
    got = op2_chat.op2_chat(spark, SF).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_tidy_passes_batches_on_and_closes():
    from fundlake.llm.common import tidy
    seen = []

    def run(batches):
        try:
            for b in batches:
                yield b + 1
        finally:
            seen.append("closed")
    assert list(tidy(run)([1, 2])) == [2, 3] and list(tidy(run)([])) == []
    part = tidy(run)([1, 2])
    next(part)
    part.close()  # a limit ends a task early
    assert seen == ["closed"] * 3
