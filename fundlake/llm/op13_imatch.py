"""13. Document fingerprints: I-Match over randomised lexicon subsets, in DataFrame functions only.

The lexicon holds the terms whose share of the documents lies in a band (inverse document frequency
neither low, function words, nor high, slips and names): ``RARE`` <= df / N <= ``COMMON``.  It is split
into random subsets by the term's MD5: ``CELLS`` cells of the whole lexicon, of a quarter of it, of a
sixteenth and of a sixty-fourth.  For each subset the distinct terms of a document that the subset holds are
sorted and hashed.  A fingerprint is the number n of the document's lexicon terms and the hashes of its
non-empty subsets.  A fine share of the lexicon suits a long text: n says which one compares (at most
``CELLS`` expected terms in the cells), the finer ones are kept for longer partners.  The likeness of two
fingerprints is the share of equal hashes among the subsets that either of them fills, in the share of
the lexicon that the longer one asks for.  A text without lexicon terms has the hash of all its terms
instead and is like equal ones only.

How: terms are cut and made distinct within the row; only (term, count) goes to the count of documents.
The lexicon is written and counted: up to ``BROADCAST_TERMS`` it is broadcast, beyond it the terms are
shuffled to it.  Its size does not grow with the corpus: the band is a share of the documents, so it has at
most RARE times the distinct terms of an average document.  Lexicon terms come back as one list a document,
gathered before the shuffle.

The next document of a text (``with_next``) is found without a window over all rows: the corpus is cut
into ``RANGES`` doc_id ranges for each shuffle partition, from range bounds over narrow rows; each
range also gets the first row of the range after it (the last range that of the first), so that ``lead``
within the range is enough and a text is shuffled once.

Rows: null text is ''.  A null doc_id orders after all others; rows that share a doc_id are ordered by the
MD5 of the text.  Equal texts have equal fingerprints; two texts without terms have likeness 1.  A table
of one row is its own next.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST, cut, texts

RARE, COMMON = 1000, 20  # the band as N / df: from one document in 1000 to one in 20
CELLS = 64
RANGES = 4  # doc_id ranges for each shuffle partition, so that partitions come out even
BROADCAST_TERMS = 500_000  # a lexicon of at most so many terms (some 30 MB) is broadcast, a larger one shuffled
SHARES = 4  # the whole lexicon, a 4th, a 16th, a 64th
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The distinct terms: letters, digits and whatever is not ASCII, A-Z lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), _BETWEEN)), "")


def _bounds(rows: DataFrame, n: int) -> list:
    """The smallest (at, tie) of each of at most ``n`` ranges of about equal size, in order."""
    low = (rows.repartitionByRange(n, "at", "tie").groupBy(F.spark_partition_id().alias("p"))
           .agg(F.min(F.struct("at", "tie")).alias("low")))
    return [r.low for r in low.orderBy("low").collect()]


def _range_of(bounds: list) -> Column:
    """The number of the last bound at or below a row's (at, tie): first among every ``step``-th bound,
    then among those up to the next."""
    step = max(1, int(len(bounds) ** 0.5))
    own = F.struct("at", "tie")

    def shown(some):
        return F.array(*[F.struct(F.lit(b.at).cast("long").alias("at"), F.lit(b.tie).alias("tie")) for b in some])
    groups = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    first = F.size(F.filter(shown([g[0] for g in groups]), lambda b: b <= own))
    inner = F.size(F.filter(F.element_at(F.array(*[shown(g) for g in groups]), F.greatest(first, F.lit(1))), lambda b: b <= own))
    return F.greatest((first - 1) * step + inner - 1, F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, id, next_id and next_text of every row in the order of (doc_id, MD5 of the text)."""
    rows = texts(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("at"), F.md5("text").alias("tie"))
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(cut(rows.select("at", "tie"), "imatch-order"), n)
    if not bounds:
        return rows.select("doc_id", "text", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("next_id"), F.col("text").alias("next_text"))
    last = len(bounds) - 1
    placed = rows.withColumn("range", _range_of(bounds))
    starts = F.array(*[F.struct(F.lit(b.at).cast("long").alias("at"), F.lit(b.tie).alias("tie")) for b in bounds])
    is_first = F.element_at(starts, F.col("range") + 1) == F.struct("at", "tie")
    before = F.when(F.col("range") == 0, F.lit(last)).otherwise(F.col("range") - 1)
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("range"), F.lit(1).alias("guest"))
    dealt = placed.select("doc_id", "text", "at", "tie", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    w = Window.partitionBy("range").orderBy("guest", "at", "tie")
    seen = dealt.select("doc_id", "text", "at", "tie", "to.*").select(
        "*", F.row_number().over(w).cast("long").alias("row"), F.lead("text").over(w).alias("next_text"), F.lead("guest").over(w).alias("ends"))
    wide = F.lit(1 << 40)
    after = F.when(F.col("range") == last, F.lit(0)).otherwise(F.col("range") + 1)
    return seen.where("guest = 0").select(
        "doc_id", "text", (F.col("range") * wide + F.col("row")).alias("id"),
        F.when(F.col("ends") == 1, after * wide + 1).otherwise(F.col("range") * wide + F.col("row") + 1).alias("next_id"), "next_text")


def lexicon(term_lists: DataFrame, column: str, n_docs: int, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """(term, cell, finest): the terms in the band, the cell of each and the finest share that has it."""
    df = term_lists.select(F.explode(column).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = df.where((F.col("df") * rare >= n_docs) & (F.col("df") * common <= n_docs)).select("term", F.md5("term").alias("m"))

    def digits(at, size):
        return F.conv(F.substring("m", at, size), 16, 10).cast("int")
    third, fourth = digits(3, 1), digits(4, 1)
    finest = F.when((third == 0) & (fourth < 4), 3).when(third == 0, 2).when(third < 4, 1).otherwise(0)
    return band.select("term", F.lower(F.lpad(F.hex((digits(1, 2) % CELLS).cast("long")), 2, "0")).alias("cell"), finest.alias("finest"))


def _share(n: Column) -> Column:
    """The coarsest share of the lexicon in which n terms fill the cells at most once each on average."""
    told = F.when(n <= CELLS, 0)
    for k in range(1, SHARES - 1):
        told = told.when(n <= CELLS * 4 ** k, k)
    return told.otherwise(SHARES - 1)


def _prints(held: DataFrame, names: dict) -> DataFrame:
    """``held`` with, for each (column of entries, see ``fingerprints`` -> name), name_n and name_hashes."""
    cols = [c for c in held.columns if c not in names]
    x = held.select(*cols, *[F.col(c) for c in names], *[F.size(c).alias(f"{n}_n") for c, n in names.items()])
    cols += [f"{n}_n" for n in names.values()]

    def spread(c, n):
        own = _share(F.col(f"{n}_n"))
        parts = F.transform(c, lambda e: F.struct(F.substring(e, 2, 1).cast("int").alias("finest"), F.substring(e, 3, 2).alias("cell"),
                                                  F.substring(e, 5, 2 ** 31 - 1).alias("term")))
        return F.sort_array(F.flatten(F.transform(F.filter(parts, lambda t: t["finest"] >= own), lambda t: F.transform(
            F.sequence(own, t["finest"]), lambda s: F.struct(F.concat(s.cast("string"), t["cell"]).alias("key"), t["term"].alias("term"))))))
    x = x.select(*cols, *[spread(c, n).alias(c) for c, n in names.items()])

    def lines(c):
        """One line a subset: its key, then its terms."""
        def line(e, i):
            new = (i == 0) | (F.element_at(F.col(c), F.greatest(i, F.lit(1)))["key"] != e["key"])
            return F.concat(F.when(new, F.concat(F.lit("\n"), e["key"], F.lit(" "))).otherwise(F.lit(" ")), e["term"])
        return F.filter(F.split(F.array_join(F.transform(c, line), ""), "\n"), lambda s: s != "")

    def hashed(s):
        return F.concat(F.substring(s, 1, 3), F.substring(F.md5(s), 1, 4))
    return x.select(*cols, *[F.transform(lines(c), hashed).alias(f"{n}_hashes") for c, n in names.items()])


def shown(n: Column, hashes: Column, every: Column) -> Column:
    """The fingerprint as text."""
    return F.concat(n.cast("string"), F.lit(":"), F.when(n > 0, F.array_join(hashes, " ")).otherwise(every))


def likeness(rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """``rows`` with the likeness of the fingerprints in ``left``_n, _hashes, _text and ``right``_..."""
    share = _share(F.greatest(f"{left}_n", f"{right}_n")).cast("string")
    x = rows.withColumn("__share", share)
    for side in (left, right):
        x = x.withColumn(f"__{side}", F.filter(f"{side}_hashes", lambda h: F.substring(h, 1, 1) == F.col("__share")))
    both = F.size(F.array_intersect(f"__{left}", f"__{right}"))
    filled = F.size(F.array_union(*[F.transform(f"__{s}", lambda h: F.substring(h, 1, 3)) for s in (left, right)]))
    x = x.withColumn("__both", both).withColumn("__filled", filled)
    same = (F.col(f"{left}_text") == F.col(f"{right}_text")).cast("double")
    return x.withColumn(out, F.when(F.col("__filled") > 0, F.col("__both") / F.col("__filled")).otherwise(same)) \
        .drop("__share", f"__{left}", f"__{right}", "__both", "__filled")


def _marked(terms_: str, sides: int) -> Column:
    return F.transform(terms_, lambda t: F.struct(t.alias("term"), F.lit(sides).alias("sides")))


def _of_side(got: str, bit: int) -> Column:
    return F.filter(got, lambda e: F.substring(e, 1, 1).cast("int").bitwiseAND(bit) > 0)


def fingerprints(rows: DataFrame, sides: list[str], keep: list[str], corpus: str, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """``rows`` (id, ``keep``, a text in each of at most two columns ``sides``) with, for each side,
    side_n, side_hashes and side_text (the fingerprint).  The lexicon is that of the side ``corpus``."""
    lists = rows.select("id", *keep, *[terms(F.col(s)).alias(s) for s in sides])
    every = {s: F.md5(F.array_join(F.sort_array(s), " ")).alias(f"{s}_every") for s in sides}
    if len(sides) == 2:  # a term of both texts goes once
        a, b = sides
        parts = {3: F.array_intersect(a, b), 1: F.array_except(a, b), 2: F.array_except(b, a)}
    else:
        parts = {1: F.col(sides[0])}
    held = cut(lists.select("id", *keep, *every.values(), *[p.alias(f"__in{k}") for k, p in parts.items()]), "imatch-terms")
    bit = 1 << sides.index(corpus)
    own = F.concat(*[F.col(f"__in{k}") for k in parts if k & bit])
    words = cut(lexicon(held.select(own.alias("own")), "own", held.count(), rare, common), "imatch-lexicon")
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    said = held.select("id", F.explode(F.concat(*[_marked(f"__in{k}", k) for k in parts])).alias("t")).select("id", "t.*")
    # an entry of a document's list: sides and finest share (a digit each), cell (two), term
    entry = F.concat(F.col("sides").cast("string"), F.col("finest").cast("string"), "cell", "term")
    got = said.join(words, "term").groupBy("id").agg(F.collect_list(entry).alias("got"))
    by_side = got.select("id", *[_of_side("got", 1 << k).alias(s) for k, s in enumerate(sides)])
    made = _prints(by_side, {s: s for s in sides})
    out = held.select("id", *keep, *[f"{s}_every" for s in sides]).join(made, "id", "left")
    for s in sides:
        out = out.withColumn(f"{s}_n", F.coalesce(f"{s}_n", F.lit(0))) \
            .withColumn(f"{s}_hashes", F.coalesce(f"{s}_hashes", F.array().cast("array<string>"))) \
            .withColumn(f"{s}_text", shown(F.col(f"{s}_n"), F.col(f"{s}_hashes"), F.col(f"{s}_every")))
    return out.drop(*[f"{s}_every" for s in sides])


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pairs = docs.select("id", "next_id", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.col("text").alias("own"), "next_text")
    edited = F.expr("concat(substring(own, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))")
    rows = pairs.select("id", "next_id", "doc_id", "n_chars", "own", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    made = likeness(fingerprints(rows, ["own", "edited"], ["next_id", "doc_id", "n_chars", "edited_sha256"], "own"),
                    "own", "edited", "near_edited")
    made = cut(made.drop("edited_hashes", "edited_n"), "imatch-prints")
    after = made.select(F.col("id").alias("next_id"), *[F.col(f"own_{c}").alias(f"next_{c}") for c in ("n", "hashes", "text")])
    return likeness(made.join(after, "next_id"), "own", "next", "near_next").select(
        "doc_id", "n_chars", "edited_sha256", F.col("own_text").alias("fingerprint"), F.col("edited_text").alias("edited_fingerprint"),
        "near_edited", "near_next")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS own, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS id,
    count(*) OVER () AS total FROM documents),
pairs AS (
  SELECT d.id, n.id AS next_id, d.total, d.doc_id, length(d.own) AS n_chars, d.own,
    substring(d.own, 1, length(d.own) - length(d.own) // 4) || substring(n.own, 1, length(d.own) // 4) AS edited
  FROM docs d JOIN docs n ON n.id = CASE WHEN d.id = d.total THEN 1 ELSE d.id + 1 END),
sides AS (
  SELECT id, total, side, list_sort(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS words
  FROM (SELECT id, total, 1 AS side, own AS text FROM pairs UNION ALL SELECT id, total, 2, edited FROM pairs)),
uses AS (SELECT id, side, total, unnest(words) AS term FROM sides),
lexicon AS (
  SELECT term, lower(printf('%02x', CAST('0x' || substr(md5(term), 1, 2) AS INTEGER) % 64)) AS cell,
    CASE WHEN substr(md5(term), 3, 1) = '0' AND substr(md5(term), 4, 1) < '4' THEN 3 WHEN substr(md5(term), 3, 1) = '0' THEN 2
         WHEN substr(md5(term), 3, 1) < '4' THEN 1 ELSE 0 END AS finest
  FROM uses WHERE side = 1 GROUP BY term HAVING count(*) * 1000 >= min(total) AND count(*) * 20 <= min(total)),
got AS (SELECT id, side, term, cell, finest, count(*) OVER (PARTITION BY id, side) AS n FROM uses JOIN lexicon USING (term)),
shared AS (
  SELECT id, side, term, cell, n, unnest(generate_series(CASE WHEN n <= 64 THEN 0 WHEN n <= 256 THEN 1 WHEN n <= 1024 THEN 2 ELSE 3 END, finest)) AS s FROM got),
hashes AS (
  SELECT id, side, n, s || cell AS key, s || cell || substr(md5(s || cell || ' ' || string_agg(term, ' ' ORDER BY term)), 1, 4) AS hash
  FROM shared GROUP BY id, side, n, s, cell),
prints AS (
  SELECT x.id, x.side, coalesce(g.n, 0) AS n, coalesce(h.keys, []) AS keys, coalesce(h.hashes, []) AS hashes,
    coalesce(g.n, 0) || ':' || CASE WHEN coalesce(g.n, 0) > 0 THEN coalesce(array_to_string(h.hashes, ' '), '') ELSE md5(array_to_string(x.words, ' ')) END AS print
  FROM sides x LEFT JOIN (SELECT DISTINCT id, side, n FROM got) g ON g.id = x.id AND g.side = x.side
  LEFT JOIN (SELECT id, side, list(hash ORDER BY key) AS hashes, list(key ORDER BY key) AS keys FROM hashes GROUP BY id, side) h
    ON h.id = x.id AND h.side = x.side),
met AS (
  SELECT a.id, 'edited' AS met, a.n AS n1, b.n AS n2, a.hashes AS h1, b.hashes AS h2, a.keys AS k1, b.keys AS k2, a.print = b.print AS same
  FROM prints a JOIN prints b ON a.id = b.id AND a.side = 1 AND b.side = 2
  UNION ALL
  SELECT a.id, 'next', a.n, b.n, a.hashes, b.hashes, a.keys, b.keys, a.print = b.print
  FROM prints a JOIN pairs p ON p.id = a.id JOIN prints b ON b.id = p.next_id AND b.side = 1 WHERE a.side = 1),
asked AS (SELECT *, CAST(CASE WHEN greatest(n1, n2) <= 64 THEN 0 WHEN greatest(n1, n2) <= 256 THEN 1 WHEN greatest(n1, n2) <= 1024 THEN 2 ELSE 3 END AS VARCHAR) AS s FROM met),
sized AS (
  SELECT id, met, same, len(list_filter(list_intersect(h1, h2), lambda h: h[1:1] = s)) AS equal_,
    len(list_distinct(list_filter(list_concat(k1, k2), lambda k: k[1:1] = s))) AS filled FROM asked),
near AS (SELECT id, met, CASE WHEN filled > 0 THEN equal_ / filled WHEN same THEN 1.0 ELSE 0.0 END AS near FROM sized)
SELECT p.doc_id, p.n_chars, sha256(p.edited) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
  CAST(e.near AS DOUBLE) AS near_edited, CAST(x.near AS DOUBLE) AS near_next
FROM pairs p JOIN prints a ON a.id = p.id AND a.side = 1 JOIN prints b ON b.id = p.id AND b.side = 2
JOIN near e ON e.id = p.id AND e.met = 'edited' JOIN near x ON x.id = p.id AND x.met = 'next'
"""
