"""11. Merkle dataset manifest: a tree of SHA-256 digests over the rows, by nested-struct rollup.

Every row becomes a leaf, a digest of its fields.  The leaves of a group (a language) stand in the order
of doc_id; while several nodes remain, every ``fanout`` consecutive ones become the digest of their
digests (the last run may be shorter, even one).  The groups' roots, in the order of the group, form a
tree in the same way.  A proof is the row's siblings from its leaf up to the root: ``path``, one step a
level with the digests to the left and to the right of the node.

How: leaves get their rank by range partitions (``asof.positions``, so a language with a third of all
rows is numbered by many tasks).  The rank's digits in base ``fanout`` become columns; its last ``DIGITS``
digits tell a leaf's place in its block of ``fanout ** DIGITS`` leaves, the rest the block.  Rows are dealt
by (group, block) once; then ``DIGITS`` aggregates, none with an exchange, group the digit columns away
one after the other and nest the structs of the children in their parent.  A block is one row of bounded
size, whatever the group's size.  Blocks are the leaves of the next round until every group has one.
On the way down a block's own path joins its tree as one more row of the aggregate by (group, block),
and ``transform`` with ``explode`` deals the paths to the children: no joins.  Each round is written
under ``spark.checkpoint.dir``; the number of rounds grows with the logarithm of the largest group.

Rows: a null field is told from every value; a null doc_id orders after all others; a null group is a
group of its own and orders first.  Rows that share a doc_id are ordered by their digest, so
rows repeated exactly have the same digest and stand next to each other.  An empty text is a value.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.operators.asof import positions

from .common import LAST, cut

FANOUT = 2
DIGITS = 10  # rank digits that one block holds
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left: string, right: string>>"


def digest(*fields: Column) -> Column:
    """SHA-256 in lowercase hex of the fields, each ``-`` if null, else its length in bytes, ``:`` and itself."""
    told = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
            for f in (x.cast("string") for x in fields)]
    return F.sha2(F.concat(*told), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _depth(count: Column, fanout: int) -> Column:
    """How many levels lie above ``count`` leaves."""
    powers = [fanout ** k for k in range(63) if fanout ** k < 2 ** 63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < count))


def _nest(nodes: DataFrame, keys: list[str], level: int, fanout: int, digits: int) -> DataFrame:
    """(keys, depth, pos, h, row) -> a row a block: (keys, depth, block, node), node nesting its children."""
    place = [F.expr(f"cast(pos div {fanout ** j}L % {fanout} as int)").alias(f"d{j}") for j in range(digits)]
    held = nodes.select(*keys, "depth", F.expr(f"pos div {fanout ** digits}L").alias("block"), *place,
                        F.struct("h", "row").alias("node")).repartition(*keys, "block")
    for j in range(digits):
        rest = [*keys, "block", "depth", *[f"d{i}" for i in range(digits - 1, j, -1)]]
        child = F.struct(F.col(f"d{j}").alias("place"), F.col("node.h").alias("h"),
                         F.col("node.row" if j == 0 else "node.kids").alias("row" if j == 0 else "kids"))
        held = held.groupBy(*rest).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        h = F.when(F.col("depth") > level + j, F.sha2(_joined(F.col("kids.h")), 256)).otherwise(F.col("kids")[0]["h"])
        held = held.select(*rest, F.struct(h.alias("h"), "kids").alias("node"))
    return held


def _step(kids: Column, kid: Column) -> Column:
    left = F.filter(kids, lambda k: k["place"] < kid["place"])
    right = F.filter(kids, lambda k: k["place"] > kid["place"])
    return F.struct(_joined(left["h"]).alias("left"), _joined(right["h"]).alias("right"))


def _dealt(node: Column, path: Column, depth: Column, top: int, left: int) -> Column:
    """Array of (row, path) of all leaves under ``node``, ``left`` levels below it, ``top`` its level;
    ``path`` is the node's own.  Levels from ``depth`` on have one node and no step."""
    def below(kid):
        step = F.when(depth >= top, F.array(_step(node["kids"], kid))).otherwise(F.array().cast(_STEPS))
        own = F.concat(step, path)
        if left == 1:
            return F.array(F.struct(kid["row"].alias("row"), own.alias("path")))
        return _dealt(kid, own, depth, top - 1, left - 1)
    return F.flatten(F.transform(node["kids"], below))


def _up(nodes: DataFrame, keys: list[str], fanout: int, digits: int) -> list[DataFrame]:
    """The written block trees of every round; the last round has one block a group."""
    rounds = []
    while True:
        trees = cut(_nest(nodes, keys, len(rounds) * digits, fanout, digits), "merkle")
        rounds.append(trees)
        if not trees.agg(F.max("block")).first()[0]:
            return rounds
        nodes = trees.select(*keys, "depth", F.col("block").alias("pos"), F.col("node.h").alias("h"),
                             F.struct("block").alias("row"))


def _down(rounds: list[DataFrame], keys: list[str], above: DataFrame, digits: int) -> DataFrame:
    """(keys, told, row, path) of every leaf; ``above``: keys, path and told of every group's root."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        trees = rounds[k]
        both = trees.select(*keys, "block", "depth", "node").unionByName(
            above.select(*keys, "block", "path", "told"), allowMissingColumns=True)
        held = both.groupBy(*keys, "block").agg(*[F.first(c, ignorenulls=True).alias(c)
                                                  for c in ("depth", "node", "path", "told")])
        leaves = F.explode(_dealt(F.col("node"), F.col("path"), F.col("depth"), (k + 1) * digits, digits)).alias("leaf")
        out = held.select(*keys, "told", leaves).select(*keys, "told", "leaf.row", "leaf.path")
        above = out.select(*keys, "told", "path", "row.*") if k else above
    return out


def _ranked(rows: DataFrame, keys: list[str], order: list[str], fanout: int) -> DataFrame:
    """``rows`` with pos (from 0, by ``order`` within the group) and the depth of the group's tree."""
    placed = cut(positions(rows, keys, [F.asc(c) for c in order], "pos"), "merkle-ranks")
    sizes = placed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(_depth(F.max("pos"), fanout).alias("depth"))
    same = F.lit(True)
    for k in keys:
        same = same & placed[k].eqNullSafe(sizes[f"__{k}"])
    return placed.join(sizes, same).drop(*[f"__{k}" for k in keys]).withColumn("pos", F.col("pos") - 1)


def manifest(leaves: DataFrame, group: str, order: list[str], fanout: int = FANOUT, digits: int = DIGITS) -> DataFrame:
    """``leaves`` (leaf digest ``h``, ``group``, ``order`` and other columns) with subroot (the group's
    root), root and path (the siblings of each level, from the leaf up)."""
    spark = leaves.sparkSession
    rest = [c for c in leaves.columns if c != group]
    base = cut(leaves, "merkle-leaves")
    ranked = _ranked(base, [group], order, fanout)
    rounds = _up(ranked.select(group, "depth", "pos", "h", F.struct(*rest).alias("row")), [group], fanout, digits)
    tops = rounds[-1].select(F.lit(0).alias("all"), F.col("node.h").alias("h"), F.col(group).alias("name"))
    over = _up(_ranked(tops, ["all"], ["name"], fanout).select("all", "depth", "pos", "h", F.struct("name", "h").alias("row")),
               ["all"], fanout, digits)
    root = over[-1].select("all", F.array().cast(_STEPS).alias("path"), F.col("node.h").alias("told"))
    groups = _down(over, ["all"], root, digits).select(
        F.col("row.name").alias(group), "path", F.struct(F.col("row.h").alias("subroot"), F.col("told").alias("root")).alias("told"))
    out = _down(rounds, [group], groups, digits)
    return out.select(group, *[F.col(f"row.{c}").alias(c) for c in rest], "told.subroot", "told.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    doc_id, source, lang, n_chars, text = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(doc_id.cast("string")) % 7 == 0, digest(doc_id, source, lang, n_chars + 1, text))
    leaves = docs.select(lang, doc_id, F.coalesce(doc_id, F.lit(LAST)).alias("at"), digest(doc_id, source, lang, n_chars, text).alias("h"),
                         tampered.alias("altered"))
    held = manifest(leaves, "lang", ["at", "h"])
    siblings = _joined(F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    back = folded(F.coalesce("altered", "h"), F.col("path"))
    return held.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                       back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32 in SQL: the bits of the reflected polynomial, eight steps a byte (-1 stands for a step).
ORACLE_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT *, row_number() OVER () AS rid,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END AS f1,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS f2,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS f3,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS f5
  FROM documents),
leaves AS (
  SELECT rid, doc_id, lang,
    sha256(f1 || f2 || f3 || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || f5) AS leaf,
    CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor(list_reduce(
        list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
          lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 7 = 0
      THEN sha256(f1 || f2 || f3 || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || f5) END AS altered
  FROM rows_),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS lev, pos, n, leaf AS h FROM ranked
  UNION ALL
  SELECT lang, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY lang, lev, pos // 2, n),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lev, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1
  GROUP BY lev, pos // 2, n),
siblings AS (
  SELECT r.rid, s.pos AS at, nodes.lev, nodes.pos AS place, other.h AS sibling
  FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
  JOIN nodes ON nodes.lang IS NOT DISTINCT FROM r.lang AND nodes.pos = r.pos >> nodes.lev AND nodes.n > 1
  LEFT JOIN nodes other ON other.lang IS NOT DISTINCT FROM nodes.lang AND other.lev = nodes.lev AND other.pos = xor(nodes.pos, 1)
  UNION ALL
  SELECT r.rid, s.pos, 1000 + tops.lev, tops.pos, other.h
  FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
  JOIN tops ON tops.pos = s.pos >> tops.lev AND tops.n > 1
  LEFT JOIN tops other ON other.lev = tops.lev AND other.pos = xor(tops.pos, 1)),
proofs AS (
  SELECT rid, string_agg(coalesce(sibling, ''), '' ORDER BY lev) AS told,
    list(CASE WHEN place % 2 = 1 THEN coalesce(sibling, '') ELSE '' END ORDER BY lev) AS lefts,
    list(CASE WHEN place % 2 = 0 THEN coalesce(sibling, '') ELSE '' END ORDER BY lev) AS rights
  FROM siblings GROUP BY rid),
folds AS (
  SELECT r.rid, 0 AS k, coalesce(altered, leaf) AS h FROM ranked r
  UNION ALL
  SELECT f.rid, k + 1, sha256(lefts[k + 1] || h || rights[k + 1]) FROM folds f JOIN proofs p ON f.rid = p.rid WHERE k < len(lefts))
SELECT r.doc_id, r.leaf, s.subroot, t.h AS root, sha256(coalesce(p.told, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON t.n = 1
LEFT JOIN proofs p ON p.rid = r.rid JOIN folds f ON f.rid = r.rid AND f.k = coalesce(len(p.lefts), 0)
"""
