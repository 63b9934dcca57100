"""Operator 3, byte-level BPE by corpus-level merge replay, and decoding.

A task takes the distinct pre-tokens of its slice of the corpus, lays them out as one array of byte ids
with links to the neighbours, keeps an inverted index from token pair to the places where the
pair stands, and applies the merges in rank order; a merge touches only the places in its list and
their neighbours.  The ids of each pre-token are put together for the documents, and decoding maps ids to their
bytes again.

Defined results: a null or empty text has no ids (digests of nothing); repeated rows each get a row;
a null doc_id keeps its row; an empty table gives no rows.  A pre-token of a million bytes takes memory
in proportion and n log n time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import Known, chunks, rows
from .common import tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PAIRS = 200_000  # pairs a task remembers the outcome of


class Ranks:
    """A rank file: ``token`` has each id's bytes, ``rank`` the id of each token, ``pairs`` what two joined
    tokens make."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, i in self.rank.items():
            self.token[i] = t
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.pairs = _Pairs(self.rank, self.token)


class _Pairs(dict):
    """left id << 32 | right id -> the id of the joined token, -1 where there is none; as they are asked for."""

    def __init__(self, rank: dict, token: list):
        self.rank, self.token = rank, token

    def __missing__(self, pair: int) -> int:
        made = self[pair] = self.rank.get(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF], -1)
        return made


def load(path: str) -> Ranks:
    return Ranks(path)


def replay(words: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """The ids of each of ``words``: all merges in rank order over all words at once.

    ``places`` is the inverted index (rank that a pair makes -> positions of its left token), ``makes`` what
    the pair at a position makes now, ``due`` the ranks of pairs that occur.  A rank that is made by several
    pairs takes the leftmost place first, as merging one word at a time does.
    """
    whole = [ranks.rank.get(w) for w in words]
    out = [np.array([i], "<u4") if i is not None else None for i in whole]
    rest = [k for k, i in enumerate(whole) if i is None and words[k]]
    size = np.array([len(words[k]) for k in rest], np.int64)
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    codes = ranks.byte[np.frombuffer(b"".join(words[k] for k in rest), np.uint8)]
    n = len(codes)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[start[:-1]], last[start[1:] - 1] = True, True
    at = np.arange(n)
    ids, left, right = codes.tolist(), np.where(first, -1, at - 1).tolist(), np.where(last, n, at + 1).tolist()
    pairs = ranks.pairs
    if len(pairs) > PAIRS:
        pairs.clear()
    places: list = [None] * len(ranks.token)
    due: list[int] = []
    makes = [-1] * n
    if n:  # the index over the bytes, in one pass
        at = at[~last]
        kinds, kind = np.unique(codes[at] << 32 | codes[at + 1], return_inverse=True)
        made = np.array([pairs[p] for p in kinds.tolist()], np.int64)[kind]
        full = np.full(n, -1)
        full[at] = made
        makes = full.tolist()
        at, made = at[made >= 0], made[made >= 0]
        order = np.argsort(made, kind="stable")
        due, begin = (x.tolist() for x in np.unique(made[order], return_index=True))
        for r, group in zip(due, np.split(at[order], begin[1:])):
            places[r] = group.tolist()
    while due:
        made = heapq.heappop(due)
        todo, places[made] = sorted(places[made]), None
        for k, i in enumerate(todo):
            if makes[i] != made:  # merged away or grown since it was noted
                continue
            j, before, lower = right[i], left[i], False
            right[i] = after = right[j]
            ids[i], ids[j], makes[j] = made, -1, -1
            if after < n:
                left[after] = i
                makes[i] = r = pairs[made << 32 | ids[after]]
                if r >= 0:
                    if places[r] is None:
                        places[r] = [i]
                        heapq.heappush(due, r)
                    else:
                        places[r].append(i)
                    lower = r < made
            else:
                makes[i] = -1
            if before >= 0:
                makes[before] = r = pairs[ids[before] << 32 | made]
                if r >= 0:
                    if places[r] is None:
                        places[r] = [before]
                        heapq.heappush(due, r)
                    else:
                        places[r].append(before)
                    lower = lower or r < made
            if lower:  # the merge made a pair of lower rank: that one goes first
                places[made] = todo[k + 1:]
                heapq.heappush(due, made)
                break
    done = np.array(ids, np.int64)
    kept = done >= 0
    count = np.concatenate([[0], np.cumsum(kept)])[start]
    flat = done[kept].astype("<u4")
    for k, a, b in zip(rest, count[:-1].tolist(), count[1:].tolist()):
        out[k] = flat[a:b]
    return [x if x is not None else np.zeros(0, "<u4") for x in out]


def _encoder(path: str, ranks: Ranks | None = None):
    def run(batches, ranks=ranks):
        ranks, known = ranks or Ranks(path), Known()
        for part, words, place, at in chunks(batches):
            value = known(words, lambda new: [x.tobytes() for x in replay([w.encode() for w in new], ranks)])
            begin = np.concatenate([[0], np.cumsum([len(v) // 4 for v in value])]).astype(np.int64)
            flat = np.frombuffer(b"".join(value), "<u4")
            each = (begin[1:] - begin[:-1])[place]
            ends = np.cumsum(each)
            ids = flat[np.arange(each.sum()) + np.repeat(begin[place] - (ends - each), each)]
            to = np.concatenate([[0], ends])[at]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(to), pa.int64()),
                                   pa.array([ids[x:y].tobytes() for x, y in zip(to[:-1], to[1:])], pa.binary())],
                                  ["doc_id", "n_tokens", "ids"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every whole text."""
    return rows(docs).mapInArrow(tidy(_encoder(path)), "doc_id long, n_tokens long, ids binary")


def decode(ids: bytes, ranks: Ranks) -> bytes:
    """The bytes that ``ids`` stand for."""
    return b"".join(map(ranks.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _round_trip(path: str):
    """Encoding and decoding in one task, so the ids of a text needn't leave the worker."""
    def run(batches):
        ranks = Ranks(path)
        for batch in _encoder(path, ranks)(batches):
            ids = batch.column("ids").to_pylist()
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_tokens"),
                                   pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                                   pa.array([hashlib.sha256(decode(x, ranks)).hexdigest() for x in ids], pa.string())],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes decoded from them."""
    return rows(docs).mapInArrow(tidy(_round_trip(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
