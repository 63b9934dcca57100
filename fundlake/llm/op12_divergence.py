"""12. Source divergence audit: how far apart the word use of a language's sources is, from a K-squared
quadtree over the group-term count matrix.

A group is (lang, source); its terms are the words of its documents.  A language keeps the terms that at
least ``MIN_DOCS`` of its documents hold.  With N the group's count over kept terms and V their number, a
count gives the rate p = 1 + floor(10^9 (count + 2) / (N + 2 V)), zero counts included, and two rates
differ by f = floor((p - q)^2 / (p + q)).  ``pairs`` sums f over all kept terms for each two groups of a
language; ``terms`` ranks the terms that a group uses more than its language does.  All arithmetic is in
integers.

How: tasks count the terms of whole texts (bytes, no row a word) and give a bounded number of counts out at
a time, Spark sums them.  The matrix of
a language (rows: groups, columns: kept terms) is cut into blocks of at most ``ROWS`` by about ``COLUMNS``
cells, columns by hash; a task gets two row blocks of one column block as one matrix.  It lays a
K-squared tree (K = 2) over it: level bitmaps in Morton order, a quadrant without a count is not stored.
All pairs of groups walk the tree together from the root: two quadrants over the same columns that are
both empty hold zero counts only, so their pairs are priced at once, width times f of the two zero
rates; only quadrants with a count on either side are entered, down to single cells.  The walk takes the
open quadrants in slices of bounded size.  Spark adds the blocks' sums.  A source with a third of all
rows is one matrix row; its counts are combined before the shuffle.

Rows: null text, lang and source are ''.  A group without terms, or in a language without kept terms,
still has its pairs, with N and V as they are.  Rows repeated exactly count as often as they occur.
An empty table gives no rows.  A text of any length is read whole, in pieces cut between words.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, tidy

MIN_DOCS = 10
TOP = 10
ROWS = 256  # groups in a row block
COLUMNS = 4096  # terms in a column block, on average
HELD = 250_000  # counts of (group, term) that a task holds
PIECE_BYTES = 1_000_000
OPEN = 1 << 18  # quadrant pairs that a walk holds open at once on a level
# A-Z lower-cased, other ASCII characters than letters as blanks: the rest are the terms.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(data: bytes, size: int):
    """The terms of a text, in lists of bounded size."""
    data, at = data.translate(_WORDS), 0
    while at < len(data):
        end = at + size
        if end < len(data):
            near = data.rfind(b" ", at, end)
            end = near if near > at else data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Held:
    """Counts of the groups met since the last flush."""

    def __init__(self):
        self.uses: dict = {}
        self.docs: dict = {}
        self.size = 0

    def add(self, group, words: Counter) -> None:
        uses, docs = self.uses.setdefault(group, Counter()), self.docs.setdefault(group, Counter())
        before = len(uses)
        uses.update(words)
        docs.update(words.keys())
        self.size += len(uses) - before

    def rows(self) -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for group, uses in self.uses.items():
            size = len(uses) + 1
            lang += [group[0]] * size
            source += [group[1]] * size
            term += [None, *[t.decode() for t in uses]]
            n += [0, *uses.values()]
            docs += [0, *map(self.docs[group].__getitem__, uses)]
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()),
                                pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _count(limit: int, piece_bytes: int):
    """(lang, source, term, n, docs) of the texts of a task, given out each time ``limit`` counts are held;
    a row with term null for every group met."""
    def run(batches):
        held = _Held()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                words = Counter()
                for piece in _pieces(text.as_buffer().to_pybytes(), piece_bytes):
                    words.update(piece)
                held.add((lang.as_py(), source.as_py()), words)
                if held.size >= limit:
                    yield held.rows()
                    held = _Held()
        yield held.rows()
    return run


def counts(docs: DataFrame, held: int = HELD, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and its documents with it; every
    group also has a row with term null."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    made = text.mapInArrow(tidy(_count(held, piece_bytes)), "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def matrix(docs: DataFrame, min_docs: int = MIN_DOCS, **limits) -> tuple[DataFrame, DataFrame]:
    """groups (lang, source, total, kept, number, zero) and cells (lang, source, term, n, lang_n, p, q):
    the groups with their number in the language and the rate of a zero count; the counts of kept terms
    with the rates of the group and of the language."""
    every = cut(counts(docs, **limits), "divergence-counts")
    w = Window.partitionBy("lang", "term")  # a term's rows are at most the sources of a language
    kept = cut(every.where("term is not null").select("*", F.sum("docs").over(w).alias("in_docs"), F.sum("n").over(w).alias("lang_n"))
               .where(F.col("in_docs") >= min_docs).drop("docs", "in_docs"), "divergence-kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.countDistinct("term").alias("kept"))
    groups = (every.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "kept")],
                      (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number")))
    groups = cut(groups.withColumn("zero", _rate("0", "total", "kept")), "divergence-groups")
    cells = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "number", _rate("n", "total", "kept").alias("p"), _rate("lang_n", "lang_total", "kept").alias("q"))
    return groups, cells


def _rate(count: str, total: str, kept: str) -> Column:
    return F.expr(f"if({kept} = 0, 0L, 1L + (1000000000BD * cast({count} + 2 as decimal(20,0)))"
                  f" div cast({total} + 2 * {kept} as decimal(20,0)))")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of two arrays of rates; 0 where both are 0."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


class QuadTree:
    """K-squared tree (K = 2) of the non-zero cells of a matrix: for each level, four bits a stored quadrant
    (upper left, upper right, lower left, lower right), the stored ones in Morton order."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int):
        self.levels = max(1, int(max(height, width, 2) - 1).bit_length())
        code = self._morton(rows, columns)
        order = np.argsort(code)
        self.values, code = values[order], code[order]
        self.bits, self.first = [], []  # of each level from the root: bits, and stored children before a quadrant
        for level in range(self.levels, 0, -1):
            child = np.unique(code >> np.int64(2 * (level - 1)))
            parent = np.unique(child >> 2)
            bits = np.zeros(4 * len(parent), bool)
            bits[4 * np.searchsorted(parent, child >> 2) + (child & 3)] = True
            self.bits.append(bits)
            self.first.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int64))
        self.root = 0 if len(code) else -1

    def _morton(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        code = np.zeros(len(rows), np.int64)
        for b in range(self.levels):
            code |= ((rows.astype(np.int64) >> b & 1) << (2 * b + 1)) | ((columns.astype(np.int64) >> b & 1) << (2 * b))
        return code

    def child(self, depth: int, node: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Numbers of the children ``which`` (0 to 3) of stored quadrants ``node``; -1: empty."""
        at = 4 * np.maximum(node, 0) + which
        if not len(self.bits[depth]):
            return np.full(len(node), -1, np.int64)
        there = (node >= 0) & self.bits[depth][at]
        return np.where(there, self.first[depth][at], -1)


def pair_sums(tree: QuadTree, zero: np.ndarray, width: int, first: np.ndarray, second: np.ndarray, limit: int = OPEN) -> np.ndarray:
    """Sum of f over all ``width`` columns for every row a < b of the matrix, 0 elsewhere; only pairs of a
    row marked in ``first`` with one marked in ``second`` are entered.  ``zero``: each row's rate without a count."""
    height = len(zero)
    total = np.zeros((height, height), np.int64)
    has = [[np.bincount(np.arange(height) >> level, rows) > 0 for rows in (first, second)] for level in range(tree.levels + 1)]
    priced = {}  # side of a quadrant in bits -> columns found empty on both sides, by the quadrants' row numbers

    def price(level, a, b, columns):
        side = ((height - 1) >> level) + 1
        held = priced.setdefault(level, np.zeros((side, side), np.int64))
        np.add.at(held, (a, b), columns)

    def walk(depth, na, nb, ra, rb, c):
        """Quadrant pairs: nodes (-1 empty), row numbers and column number in units of their side."""
        if len(na) > limit:
            for k in range(0, len(na), limit):
                walk(depth, *(x[k:k + limit] for x in (na, nb, ra, rb, c)))
            return
        level = tree.levels - depth
        void = (na < 0) & (nb < 0)
        if void.any():
            start = c[void] << level
            price(level, ra[void], rb[void], np.minimum(width, start + (1 << level)) - start)
        na, nb, ra, rb, c = (x[~void] for x in (na, nb, ra, rb, c))
        if not len(na):
            return
        if not level:
            p = np.where(na >= 0, tree.values[np.maximum(na, 0)], zero[ra])
            q = np.where(nb >= 0, tree.values[np.maximum(nb, 0)], zero[rb])
            np.add.at(total, (ra, rb), apart(p, q))
            return
        half = level - 1
        parts = []
        for right in (0, 1):
            cc = 2 * c + right
            for low_a in (0, 1):
                aa = 2 * ra + low_a
                for low_b in (0, 1):
                    bb = 2 * rb + low_b
                    keep = (cc << half < width) & (aa << half < height) & (bb << half < height) & (aa <= bb)
                    keep[keep] = has[half][0][aa[keep]] & has[half][1][bb[keep]]
                    if not half:
                        keep &= aa < bb
                    if keep.any():
                        parts.append((tree.child(depth, na[keep], np.full(keep.sum(), 2 * low_a + right)),
                                      tree.child(depth, nb[keep], np.full(keep.sum(), 2 * low_b + right)), aa[keep], bb[keep], cc[keep]))
        if parts:
            walk(depth + 1, *(np.concatenate(x) for x in zip(*parts)))

    one = np.zeros(1, np.int64)
    if width and height:
        walk(0, one + tree.root, one + tree.root, one, one, one)
    columns = np.zeros((height, height), np.int64)  # empty columns of each pair, handed down from the larger quadrants
    for level, held in priced.items():
        spread = np.arange(height) >> level
        columns += held[spread[:, None], spread[None, :]]
    upper = np.triu(np.ones((height, height), bool), 1) & first[:, None] & second[None, :]
    return np.where(upper, total + columns * apart(zero[:, None], zero[None, :]), 0)


def _block(row_block: int):
    """One column block of two row blocks -> (lang, a, b, part) for each pair of groups of the two."""
    def run(table: pa.Table) -> pa.Table:
        number, term = table.column("number").to_numpy(), table.column("term").to_pylist()
        p, lang = table.column("p").to_numpy(), table.column("lang")[0].as_py()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        head = np.array([t is None for t in term], bool)
        rows, at = np.unique(number[head], return_index=True)
        zero = p[head][at]
        column = {t: k for k, t in enumerate(sorted({t for t in term if t is not None}))}
        where = np.array([column[t] for t in term if t is not None], np.int64)
        tree = QuadTree(np.searchsorted(rows, number[~head]), where, p[~head], len(rows), len(column))
        first, second = rows // row_block == low, rows // row_block == high
        sums = pair_sums(tree, zero, len(column), first, second)
        a, b = np.nonzero(np.triu(np.ones(sums.shape, bool), 1) & first[:, None] & second[None, :])
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(rows[a], pa.int32()),
                         "b": pa.array(rows[b], pa.int32()), "part": pa.array(sums[a, b], pa.int64())})
    return run


def pairs(groups: DataFrame, cells: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(lang, source, item, value) for each group and each other source of its language."""
    sizes = groups.groupBy("lang").agg(F.max("kept").alias("kept"), (F.max("number") + 1).alias("sources"))
    blocks = F.ceil(F.greatest(F.col("kept"), F.lit(1)) / columns).cast("int")
    last = F.floor((F.col("sources") - 1) / rows).cast("int")
    own = F.floor(F.col("number") / rows).cast("int")
    # a row block meets every row block of its language
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    heads = groups.join(sizes.drop("kept"), "lang").select("lang", "number", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"),
                                                          F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "sources")
    body = cells.join(sizes, "lang").select("lang", "number", "term", "p", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "sources")
    sent = heads.unionByName(body).select("lang", "number", "term", "p", "block", own.alias("own"), other)
    units = sent.select("lang", "number", "term", "p", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    made = units.groupBy("lang", "block", "low", "high").applyInArrow(_block(rows), "lang string, a int, b int, part long")
    sums = made.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = sums.select("lang", "a", "b", "value").union(sums.select("lang", "b", "a", "value"))
    names = groups.select("lang", "number", "source")
    return (both.join(names.withColumnRenamed("number", "a"), ["lang", "a"])
            .join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
            .select("lang", "source", "item", "value"))


def terms(cells: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms a group uses more than its language, the first ``top``."""
    f = F.expr("(p - q) * (p - q) div (p + q)")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (cells.where("p > q").select("lang", "source", F.col("term").alias("item"), f.alias("value"))
            .select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **limits) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    groups, cells = matrix(docs, min_docs, **limits)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = pairs(groups, cells).withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return told.select(*columns).unionByName(terms(cells, top).withColumn("part", F.lit("term")).select(*columns))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
uses AS (SELECT rid, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM uses GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
langs AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS HUGEINT) AS lang_total FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
cell AS (
  SELECT u.lang, u.source, u.term, count(*) AS n FROM uses u JOIN kept k ON u.lang = k.lang AND u.term = k.term
  GROUP BY u.lang, u.source, u.term),
totals AS (SELECT s.lang, s.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total
  FROM sources s LEFT JOIN cell c ON s.lang = c.lang AND s.source = c.source GROUP BY s.lang, s.source),
rates AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)) // (t.total + 2 * l.v) AS p,
    1 + (1000000000 * (CAST(k.lang_n AS HUGEINT) + 2)) // (l.lang_total + 2 * l.v) AS q
  FROM totals t JOIN langs l ON t.lang = l.lang JOIN kept k ON k.lang = t.lang
  LEFT JOIN cell c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
             FROM rates x JOIN rates y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
             GROUP BY x.lang, x.source, y.source) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM rates WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM told)
WHERE part = 'pair' OR rank <= 10
"""
