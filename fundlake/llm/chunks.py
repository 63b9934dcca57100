"""Distinct pre-tokens of chunks of documents: what operators 3 and 6 share.

A task takes its documents in chunks of bounded bytes; ``chunk`` cuts the whole texts into pre-tokens and
gives the chunk's distinct ones and the place of every occurrence among them, so what costs time is done
once for each distinct pre-token.  ``Known`` keeps results for the pre-tokens a task has met last, up
to a bound, for its later chunks; it goes with the task, since a worker serves many stages.  Nothing is shuffled: a row for each chunk and distinct pre-token,
dealt by pre-token and joined back, took more disk than the documents themselves.  Only the texts go to
the workers: lists of pieces made in the JVM filled its heap and the Arrow buffers.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, texts

CHUNK_BYTES = 3_000_000
KEPT = 100_000  # pre-tokens in each of the two tables of results that a task keeps
# Fixed value: public_tokenizers.PATTERN with \s as the Unicode property, as the libraries read it.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_found = regex.compile(PATTERN).findall


class Known:
    """word -> result for the words met last: when the newer of two tables is full it becomes the older,
    and what was the older goes."""

    def __init__(self):
        self.newer: dict = {}
        self.older: dict = {}

    def __call__(self, words: list, work) -> list:
        """Results for ``words`` (distinct) in order; ``work`` makes those that are not known."""
        newer, older = self.newer, self.older
        missing = [w for w in words if w not in newer and w not in older]
        made = dict(zip(missing, work(missing))) if missing else {}
        out = [made[w] if w in made else newer[w] if w in newer else older[w] for w in words]
        if len(newer) + len(words) > KEPT:
            self.older, self.newer = newer, {}
        self.newer.update(zip(words[:KEPT], out[:KEPT]))
        return out


class _Places(dict):
    """word -> its place, in the order of first use."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def pieces(text: str, special: str | None = None) -> list[str]:
    """The pre-tokens of a whole text; special: a string that is always one pre-token."""
    if not special or special not in text:
        return _found(text)
    first, *others = text.split(special)
    out = _found(first)
    for part in others:
        out.append(special)
        out += _found(part)
    return out


def rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and text (null: empty)."""
    return texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")


def chunks(batches, special: str | None = None):
    """For each chunk of the rows: its rows, its distinct pre-tokens, the place of each occurrence among
    them, and where each document's occurrences begin and end."""
    for batch in batches:
        for a, b in slices(batch, "text", CHUNK_BYTES):
            part, seen, place = batch.slice(a, b - a), _Places(), []
            for text in part.column("text"):
                held = pieces(text.as_py(), special)
                place.append(np.fromiter(map(seen.__getitem__, held), np.int64, len(held)))
            yield part, list(seen), np.concatenate(place), np.concatenate([[0], np.cumsum([len(x) for x in place])]).astype(np.int64)
            give_back()
