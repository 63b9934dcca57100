"""Operator 7, benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased (A-Z, U+00C0 to U+00DE) runs of letters and digits; shingles have five words (an item of fewer words is
one shingle).  Windows as long as an item, in words, are fingerprinted (64-bit SimHash of the weighted
shingles) wherever a document has a shingle of that item: a window without any has similarity 0.  The
items' fingerprints lie in a multi-index of eight byte blocks; of two fingerprints within ``RADIUS`` one
block differs in ``RADIUS // 8`` bits at most, so probing all bytes that near finds every item within
the radius.  Candidates are verified by exact weighted Jaccard similarity of the shingle multisets; a
shingle's weight is the inverse of the number of items that have it, counted over the whole benchmark.

The benchmark goes through the driver in blocks of bounded bytes, one pass over the documents each; every pass
holds its block's index and the counts of all shingles that several items have.  Defined results: null or word-less items and texts match nothing; a document shorter than an item is
one window; repeated documents each get rows; repeated items each match; a null doc_id keeps its rows; of
several windows the most similar, then the first, is told; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spare, texts, tidy, utf8
from .shingles import mix, spans, words

SIZE, THRESHOLD, RADIUS = 5, 0.8, 20
BLOCK_BYTES = 8_000_000
SHIFT = 2  # windows this many words beside an aligned one are tried as well
_SIGNS = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _SIGNS[_a:_b] = False
_NEAR = [[y for y in range(256) if bin(x ^ y).count("1") <= RADIUS // 8] for x in range(256)]


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes of a text with the capitals of U+00C0 to U+00DE as small letters (A-Z fold in the hashes)."""
    if len(data) < 2:
        return data
    data, lead = data.copy(), data[:-1] == 0xC3
    tail = data[1:]
    tail[lead & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    return data


def fingerprint(shingles: np.ndarray, weight: np.ndarray) -> int:
    bit = (shingles[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    total = (weight[:, None] * (bit.astype(np.float64) * 2 - 1)).sum(0)
    return int(sum(1 << k for k in np.flatnonzero(total > 0).tolist()))


def similarity(a: Counter, b: Counter, weight) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum(min(n, b[x]) * weight(x) for x, n in a.items() if x in b)
    return both / (sum(n * weight(x) for x, n in a.items()) + sum(n * weight(x) for x, n in b.items()) - both)


def _shingled(batches):
    """text -> h, the distinct shingles of each item."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            data = np.frombuffer(text.encode(), np.uint8)
            h = words(folded(data), np.array([0, len(data)]), _SIGNS)[0]
            out.append(np.unique(spans(h, min(SIZE, len(h)))).view(np.int64) if len(h) else [])
        yield pa.record_batch([pa.array(out, pa.list_(pa.int64()))], ["h"])


def shared_shingles(benchmark: DataFrame) -> dict[int, int]:
    """The shingles that several items have, and how many."""
    held = benchmark.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_shingled, "h array<long>")
    return {h & 2**64 - 1: n for h, n in held.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 1").toLocalIterator()}


class Items:
    """The index of a block of items: shingle postings, weights, fingerprints and their blocks.
    ``shared``: number of items of each shingle that several items of the benchmark have; by default
    these items are all."""

    def __init__(self, rows: list[tuple[int, str]], shared: dict[int, int] | None = None):
        self.id, self.size, self.words, self.bag = [], [], [], []
        postings = defaultdict(list)
        for i, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            h = words(folded(data), np.array([0, len(data)]), _SIGNS)[0]
            if not len(h):
                continue
            k, size = len(self.id), min(SIZE, len(h))
            run = spans(h, size).tolist()
            for j, x in enumerate(run):
                postings[x].append((k, j))
            self.id.append(i)
            self.size.append(size)
            self.words.append(len(h))
            self.bag.append(Counter(run))
        self.postings = dict(postings)
        self.shared = {x: len({k for k, _ in at}) for x, at in postings.items()} if shared is None else shared
        self.known = {s: np.array(sorted({x for k, b in enumerate(self.bag) if self.size[k] == s for x in b}), np.uint64)
                      for s in set(self.size)}
        self.print = [self._print(list(b.elements())) for b in self.bag]
        self.block = [defaultdict(set) for _ in range(8)]
        for k, p in enumerate(self.print):
            for b in range(8):
                self.block[b][p >> 8 * b & 255].add(k)

    def _weight(self, x: int) -> float:
        return 1 / self.shared.get(x, 1)

    def _print(self, run: list[int]) -> int:
        return fingerprint(np.array(run, np.uint64), np.array([self._weight(x) for x in run]))

    def within(self, p: int) -> dict[int, int]:
        """All items with a fingerprint within RADIUS of p, and the distances."""
        found = set()
        for b in range(8):
            for y in _NEAR[p >> 8 * b & 255]:
                found |= self.block[b].get(y, set())
        return {k: d for k in found if (d := (p ^ self.print[k]).bit_count()) <= RADIUS}

    def matches(self, data: np.ndarray, at: np.ndarray):
        """(text, item, similarity, distance, first byte, end byte) of all matches."""
        h, start, end, first = words(folded(data), at, _SIGNS)
        runs = {s: spans(h, s) for s in self.known}
        asked = defaultdict(set)  # (text, words of the item, shingle size) -> first words of windows
        for s, known in self.known.items():
            run = runs[s]
            if not len(run):
                continue
            table = np.zeros(1 << 18, bool)
            table[(known >> np.uint64(46)).astype(np.int64)] = True
            hit = np.flatnonzero(table[(run >> np.uint64(46)).astype(np.int64)])
            hit = hit[np.isin(run[hit], known)]
            text = np.searchsorted(first, hit, "right") - 1
            inside = hit + s <= first[text + 1]
            for p, t in zip(hit[inside].tolist(), text[inside].tolist()):
                for k, j in self.postings.get(int(run[p]), ()):
                    if self.size[k] == s:
                        low, high = int(first[t]), max(int(first[t]), int(first[t + 1]) - self.words[k])
                        asked[t, self.words[k], s].update(min(max(p - j + d, low), high) for d in range(-SHIFT, SHIFT + 1))
        best: dict = {}
        for (t, length, s), begins in asked.items():
            for w in sorted(begins):
                stop = min(w + length, int(first[t + 1]))
                run = runs[s][w:stop - s + 1].tolist()
                if not run:
                    continue
                bag = Counter(run)
                for k, d in self.within(self._print(run)).items():
                    if self.words[k] == length and (v := similarity(bag, self.bag[k], self._weight)) >= THRESHOLD and v > best.get((t, k), (0,))[0]:
                        best[t, k] = v, d, int(start[w]), int(end[stop - 1])
        return [(t, k, *found) for (t, k), found in best.items()]


def _found(index: Items):
    def run(batches):
        for batch in batches:
            out = []
            for a, b in slices(batch, "text"):
                data, at = utf8(batch.column("text").slice(a, b - a))
                ids, tags = (batch.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "tag"))
                out += [(ids[t], tags[t], index.id[k], v, d, x - int(at[t]), y - int(at[t])) for t, k, v, d, x, y in index.matches(data, at)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)],
                                  ["doc_id", "text_crc32", "item_id", "similarity", "distance", "first_byte", "end_byte"])
    return run


def indexes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark's items in blocks of bounded bytes, each as an index; one at least."""
    held, size, some = [], 0, False
    shared = shared_shingles(benchmark)
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= block_bytes:
            yield Items(held, shared)
            held, size, some = [], 0, True
    if held or not some:
        yield Items(held, shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item of which it has a window of similarity 0.8 or more:
    doc_id, text_crc32, item_id, similarity, distance, first_byte, end_byte (of the window in the text)."""
    rows = texts(docs).select("doc_id", F.crc32("text").alias("tag"), "text")
    found = [rows.mapInArrow(tidy(_found(index)), "doc_id long, text_crc32 long, item_id long, similarity double, distance int, first_byte long, end_byte long")
             for index in indexes(benchmark, block_bytes)]
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without such a window, with all their columns."""
    name = spare(docs, "text")

    def without(index: Items):
        def run(batches):
            for batch in batches:
                for a, b in slices(batch, name):
                    part = batch.slice(a, b - a)
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in index.matches(*utf8(part.column(name)))]] = False
                    yield part.filter(pa.array(keep)).drop_columns([name])
        return run
    out = docs
    for index in indexes(benchmark, block_bytes):
        out = out.withColumn(name, F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(tidy(without(index)), docs.schema)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
