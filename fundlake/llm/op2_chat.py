"""Operator 2, chat formatting at token level.

A turn is the reserved id TURN, the role's tokens, SAYS, the content's tokens, END.  Role and content
are encoded as segments of their own, so no token spans a mark, and the reserved ids lie beyond the
vocabulary, so no text can make one.  The loss mask covers an assistant's content tokens and comes
from prefix sums over the segment lengths.  Control strings inside texts get a backslash after their
first character (one more where backslashes stand there already), so the rendered text has control
strings only where marks are, and taking one backslash away gives the text back.

Turns are ordered by turn (nulls first), then role and text; repeated rows are turns of their own.
Null role or text: empty.  A null conv_id is a conversation.  Reading back streams a conversation's
turns in order through running digests, so its length takes no memory.  An empty table gives only the
conversation the query adds.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
MARKS = ("<|turn|>", "<|says|>", "<|end|>")  # how the reserved ids are written
_CONTROL = r"/?s>|/?INST\]|/?SYS>>|\|[A-Za-z_]+\|>|</?SYS>>|(?:user|system|assistant|unk|pad|bos|eos)>"
_PLAIN = re.compile(r"([<\[])(\\*)(" + _CONTROL + ")")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(" + _CONTROL + ")")
_loaded: dict = {}


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def encoding(path: str):
    """tiktoken's encoding for a rank file, and the first reserved id."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _loaded[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _loaded[path]


def assemble(role: str, text: str, enc, reserved: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the loss mask of one turn."""
    turn, says, end = ([reserved + k] for k in range(3))
    parts = [turn, enc.encode_ordinary(escape(role)), says, enc.encode_ordinary(escape(text)), end]
    length = np.array([len(p) for p in parts])
    counted = np.array([0, 0, 0, role == "assistant", 0])
    begin = np.cumsum(length) - length
    step = np.zeros(length.sum() + 1, np.int64)
    np.add.at(step, begin, counted)
    np.add.at(step, begin + length, -counted)
    return np.concatenate(parts).astype("<u4"), np.cumsum(step[:-1]).astype(bool)


def read_turn(ids: np.ndarray, mask: np.ndarray, enc, reserved: int) -> tuple[str, str, str, int]:
    """Role, text, text under the mask (all unescaped) and the rendered length of one turn's ids."""
    marks = np.flatnonzero(ids >= reserved)
    if (ids[marks] - reserved).tolist() != [0, 1, 2] or marks[0] or marks[2] != len(ids) - 1:
        raise ValueError("not one turn")
    role, text = (enc.decode(ids[a + 1:b].tolist()) for a, b in zip(marks[:-1], marks[1:]))
    loss = enc.decode(ids[mask].tolist()) if mask.any() else ""
    return unescape(role), unescape(text), unescape(loss), len(role) + len(text) + sum(map(len, MARKS))


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """One row a turn: conv_id, turn, role and text (for the order), ids (little-endian unsigned 32-bit)
    and mask (a byte a token)."""
    def run(batches):
        enc, reserved = encoding(path)
        for batch in batches:
            made = [assemble(r, t, enc, reserved) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.record_batch([*batch.columns, pa.array([i.tobytes() for i, _ in made], pa.binary()),
                                   pa.array([m.tobytes() for _, m in made], pa.binary())], [*batch.schema.names, "ids", "mask"])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, mask binary")


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """The digests of each conversation, from ids and mask alone."""
    def run(batches):
        enc, reserved = encoding(path)
        key = None  # (conv_id,) of the open conversation
        done: list = []

        def close():
            if key is not None:
                done.append((key[0], n, whole.hexdigest(), under, loss.hexdigest(), chars))
        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask"))):
                if key != (conv,):
                    close()
                    key, n, under, chars, whole, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text, counted, length = read_turn(np.frombuffer(ids, "<u4"), np.frombuffer(mask, bool), enc, reserved)
                n, under, chars = n + 1, under + len(counted), chars + length
                whole.update(f"{role}\n{text}\n".encode())
                loss.update(counted.encode())
            if done:
                yield _digests(done)
                done = []
        close()
        yield _digests(done)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    told = "</s>[INST] ok [/INST]"
    own = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{told}' as text")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    path = public_tokenizers.path(VOCABULARY)
    return read_back(format_turns(rows, path), path)


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>>|\|[A-Za-z_]+\|>|</?SYS>>|(?:user|system|assistant|unk|pad|bos|eos)>)', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>>|\|[A-Za-z_]+\|>|</?SYS>>|(?:user|system|assistant|unk|pad|bos|eos)>)', '\1\\\2\3', 'g'))
    + length('<|turn|><|says|><|end|>') AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
