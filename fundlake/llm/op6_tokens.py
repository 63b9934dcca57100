"""Operator 6, token counts: pieces are counted once for each distinct pre-token of a chunk of
documents, joined to the documents' pre-token frequencies and summed; no document's ids are materialised.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id keeps its row; repeated
rows each get a row; an empty table gives no rows.  The special string of the vocabulary inside a
text is one token, as the library's default has it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import Known, chunks, rows
from .common import tidy

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def _counter(path: str, limit: int, special: str | None):
    def run(batches):
        from tokenizers import Tokenizer
        t, known = Tokenizer.from_file(path), Known()

        def counted(words):
            return [len(x) for x in t.encode_batch_fast(words, add_special_tokens=False)]
        for part, words, place, at in chunks(batches, special):
            value = np.array(known(words, counted), np.int64)
            doc, many = np.repeat(np.arange(len(at) - 1), np.diff(at)), max(1, len(value))
            pair, copies = np.unique(doc * many + place, return_counts=True)  # frequencies by document
            n = np.bincount(pair // many, copies * value[pair % many], len(at) - 1).astype(np.int64)
            yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), pa.array(n), pa.array(n > limit)],
                                  ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; ``path``: a tokenizers file whose
    pre-tokenizer is the byte-level pattern."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    added = [x["content"] for x in kind["added_tokens"]]
    if kind["pre_tokenizer"]["type"] != "ByteLevel" or kind["pre_tokenizer"]["add_prefix_space"] or len(added) > 1:
        raise ValueError("a byte-level pre-tokenizer without prefix space and one special string at most is expected")
    return rows(docs).mapInArrow(
        tidy(_counter(path, limit, added[0] if added else None)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
