"""Registered queries over the text tables: corpus, ranking, chat memory, routing, eval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundlake.functions.exact import ratio, ratio_sql
from fundlake.operators import corpus
from fundlake.sources.driver import read_table

REGISTRY: dict = {}

# Fixed values of the derived corpus / chat / eval tables.
AUDIENCES = ["internal", "partner"]          # by doc_id % 2
CORPUS_REGIONS = ["GLOBAL", "AMER", "EMEA"]  # by doc_id % 3
ROLES = ["director", "channel_mgr", "rmd", "finance", "dealer"]  # by user % 5, user = conv_id % 10
CATEGORIES = ["metric", "policy", "action", "refuse"]           # by conv_id % 4
CORPUS_AS_OF = "2001-06-30"
N_FAMILIES = 50


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _sd(num, den, scale=2, mult=1):
    return ratio_sql(num, den, scale, mult, "duckdb")


def _pick(values, idx_col):
    e = None
    for i, v in enumerate(values):
        e = F.when(idx_col == i, F.lit(v)) if e is None else e.when(idx_col == i, F.lit(v))
    return e


def _sql_pick(values, expr):
    return "CASE " + " ".join(f"WHEN {expr} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# -------------------------------------------------------------- corpus rows
def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    eff = F.date_add(F.lit("2000-01-01").cast("date"), (k % 700).cast("int"))
    return d.select(
        "doc_id", "lang", "text",
        F.concat(F.lit("KA-"), F.upper("lang"), F.lit("-"), F.lpad((k % N_FAMILIES).cast("string"), 3, "0"))
        .alias("family_id"),
        _pick(AUDIENCES, k % 2).alias("audience"), _pick(CORPUS_REGIONS, k % 3).alias("region"),
        eff.alias("effective_date"), F.date_add(eff, 365).alias("expires"))


_CORPUS_SQL = f"""corpus AS (
  SELECT doc_id, lang, text,
         concat('KA-', upper(lang), '-', lpad(cast(doc_id % {N_FAMILIES} AS string), 3, '0')) AS family_id,
         {_sql_pick(AUDIENCES, 'doc_id % 2')} AS audience, {_sql_pick(CORPUS_REGIONS, 'doc_id % 3')} AS region,
         DATE '2000-01-01' + CAST(doc_id % 700 AS INTEGER) AS effective_date,
         DATE '2000-01-01' + CAST(doc_id % 700 AS INTEGER) + 365 AS expires
  FROM documents)"""

_TOK = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"


def _tok(x):
    return _TOK.format(x=x)


_CHUNKS_SQL = _CORPUS_SQL + f""",
chunks0 AS (SELECT doc_id, audience, region, unnest(string_split(text, chr(10))) AS chunk_text,
                   unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM corpus),
chunks AS (SELECT concat(cast(doc_id AS string), ':', cast(pos AS string)) AS chunk_id, doc_id, pos, audience, region,
                  chunk_text FROM chunks0 WHERE length(trim(chunk_text)) > 0)"""


def _bm25_sql(chunk_filter: str = "TRUE") -> str:
    return _CHUNKS_SQL + f""",
ctok AS (SELECT chunk_id, doc_id, pos, {_tok('chunk_text')} AS toks FROM chunks WHERE {chunk_filter}),
post AS (SELECT term, chunk_id, doc_id, pos, dl, count(*) AS tf
         FROM (SELECT chunk_id, doc_id, pos, len(toks) AS dl, unnest(toks) AS term FROM ctok) x
         GROUP BY term, chunk_id, doc_id, pos, dl),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM ctok),
dft AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark),
scored AS (
  SELECT q.query_id, p.chunk_id, p.doc_id, p.pos,
         sum(ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
  FROM qt q JOIN dft d ON q.term = d.term JOIN post p ON p.term = q.term CROSS JOIN stats s GROUP BY 1, 2, 3, 4)"""


_BM25_FINAL = """
SELECT query_id, chunk_id, score, rank FROM (
  SELECT query_id, chunk_id, CAST(round(score, 6) AS DECIMAL(18,6)) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score, 6) AS DECIMAL(18,6)) DESC, doc_id, pos) AS rank
  FROM scored) x WHERE rank <= 6"""


@register("corpus_front_matter", "WITH " + _CORPUS_SQL + """
SELECT doc_id, family_id, audience, region, CAST(effective_date AS VARCHAR) AS effective_date FROM corpus""")
def corpus_front_matter(spark, sf_dir):
    """Documents rendered as markdown with a front-matter block, fields parsed back."""
    c = corpus_rows(spark, sf_dir)
    md = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("doc_id: "), F.col("family_id")),
                     F.concat(F.lit("audience: "), F.col("audience")), F.concat(F.lit("region: "), F.col("region")),
                     F.concat(F.lit("effective_date: "), F.col("effective_date").cast("string")), F.lit("---"),
                     F.col("text"))
    x = c.select("doc_id", md.alias("md"))
    return x.select("doc_id", corpus.front_matter(F.col("md"), "doc_id").alias("family_id"),
                    corpus.front_matter(F.col("md"), "audience").alias("audience"),
                    corpus.front_matter(F.col("md"), "region").alias("region"),
                    corpus.front_matter(F.col("md"), "effective_date").alias("effective_date"))


@register("corpus_chunks", "WITH " + _CHUNKS_SQL + """
SELECT chunk_id, doc_id, CAST(pos AS INTEGER) AS pos, length(chunk_text) AS n_chars FROM chunks""")
def corpus_chunks(spark, sf_dir):
    """One chunk per paragraph of every document (whole texts)."""
    ch = corpus.chunk_paragraphs(corpus_rows(spark, sf_dir), "doc_id", "text")
    return ch.select("chunk_id", "doc_id", F.col("pos").cast("int").alias("pos"),
                     F.length("chunk_text").cast("bigint").alias("n_chars"))


# Policy texts: the lines of a document under headings, some numbered, with a table and fenced code, by rule.
def policy_texts(spark, sf_dir) -> DataFrame:
    """(doc_id, md): a markdown text for every document; before every fourth line stands an H2 heading
    (numbered unless doc_id is divisible by 5), before every ninth an H3 heading, before every seventh a
    table, before every eleventh a fenced line that looks like a heading."""
    def line(t, i):
        number = F.floor(i / 4).cast("string")
        plain = F.col("doc_id") % 5 == 0
        h2 = F.when(i % 4 == 3, F.when(plain, F.concat(F.lit("## Part & Rule "), number, F.lit("\n")))
                    .otherwise(F.concat(F.lit("## "), number, F.lit(". Rule "), number, F.lit("\n")))).otherwise(F.lit(""))
        h3 = F.when(i % 9 == 8, F.concat(F.lit("### "), number, F.lit(".1 Detail\n"))).otherwise(F.lit(""))
        table = F.when(i % 7 == 6, F.lit("| a | b |\n|---|---|\n| 1 | 2 |\n")).otherwise(F.lit(""))
        code = F.when(i % 11 == 10, F.lit("```\n## no heading\n```\n")).otherwise(F.lit(""))
        return F.concat(h2, h3, table, code, t)
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("md"))


@register("corpus_sections", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
told AS (
  SELECT doc_id, string_agg(
    CASE WHEN i % 4 = 3 THEN CASE WHEN doc_id % 5 = 0 THEN '## Part & Rule ' || (i // 4) ELSE '## ' || (i // 4) || '. Rule ' || (i // 4) END || chr(10) ELSE '' END
    || CASE WHEN i % 9 = 8 THEN '### ' || (i // 4) || '.1 Detail' || chr(10) ELSE '' END
    || CASE WHEN i % 7 = 6 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) ELSE '' END
    || CASE WHEN i % 11 = 10 THEN '```' || chr(10) || '## no heading' || chr(10) || '```' || chr(10) ELSE '' END
    || line, chr(10) ORDER BY i) AS md FROM lines GROUP BY doc_id),
md_lines AS (
  SELECT doc_id, unnest(string_split(md, chr(10))) AS line, unnest(range(0, len(string_split(md, chr(10))))) AS pos FROM told),
fenced AS (
  SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM md_lines),
headed AS (
  SELECT *, CASE WHEN starts_with(line, '## ') AND fences % 2 = 0 THEN 1 ELSE 0 END AS opens FROM fenced),
carried AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM headed),
parts AS (
  SELECT doc_id, section_no, arg_min(line, pos) AS head, string_agg(line, chr(10) ORDER BY pos) AS body, max(pos) AS last,
    count_if(starts_with(line, '|---')) AS n_tables
  FROM carried GROUP BY doc_id, section_no),
ends AS (SELECT *, lead(section_no) OVER (PARTITION BY doc_id ORDER BY section_no) IS NOT NULL AS more FROM parts)
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no,
  CASE WHEN section_no = 0 THEN '0' WHEN regexp_matches(head, '^## [0-9]+[.] ') THEN regexp_extract(head, '^## ([0-9]+)[.]', 1)
       ELSE replace(replace(lower(substr(head, 4)), ' & ', '-'), ' ', '-') END AS section_id,
  CASE WHEN section_no = 0 THEN '' ELSE regexp_replace(substr(head, 4), '^[0-9]+[.] ', '') END AS title,
  n_tables, sha256(body || CASE WHEN more THEN chr(10) ELSE '' END) AS section_sha256
FROM ends WHERE section_no > 0 OR trim(replace(body, chr(10), ' ')) <> ''""")
def corpus_sections(spark, sf_dir):
    """One chunk per H2 section of every policy text, with its section id, tables kept whole."""
    s = corpus.sections(policy_texts(spark, sf_dir), "doc_id", "md")
    return s.select("doc_id", "section_no", "section_id", "title",
                    F.regexp_count("section_text", F.lit(r"(?m)^\|---")).cast("bigint").alias("n_tables"),
                    F.sha2("section_text", 256).alias("section_sha256"))


@register("corpus_current_versions", "WITH " + _CORPUS_SQL + f"""
SELECT family_id, doc_id, effective_date FROM (
  SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY effective_date DESC, doc_id DESC) AS rn
  FROM corpus WHERE effective_date <= DATE '{CORPUS_AS_OF}' AND DATE '{CORPUS_AS_OF}' <= expires) x WHERE rn = 1""")
def corpus_current_versions(spark, sf_dir):
    """Version in force per document family at the as-of date (superseded hidden)."""
    c = corpus_rows(spark, sf_dir)
    a = F.lit(CORPUS_AS_OF).cast("date")
    live = c.filter((F.col("effective_date") <= a) & (a <= F.col("expires")))
    latest = live.groupBy("family_id").agg(F.max(F.struct("effective_date", "doc_id")).alias("m"))
    return latest.select("family_id", F.col("m.doc_id").alias("doc_id"), F.col("m.effective_date").alias("effective_date"))


def _bm25(spark, sf_dir, chunk_filter=None):
    docs = corpus_rows(spark, sf_dir)
    ch = corpus.chunk_paragraphs(docs if chunk_filter is None else docs.filter(chunk_filter), "doc_id", "text")
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                       F.col("text").alias("query_text"))
    from fundlake.session import materialize
    r = corpus.bm25_top_k(ch, q, 6, materialize=lambda d: materialize(d, "bm25-postings"))
    cid = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"))
    return r.select("query_id", cid.alias("chunk_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@register("corpus_keyword_top6", "WITH " + _bm25_sql() + _BM25_FINAL)
def corpus_keyword_top6(spark, sf_dir):
    """BM25 top 6 chunks for every benchmark item used as a query."""
    return _bm25(spark, sf_dir)


@register("corpus_keyword_top6_partner_amer",
          "WITH " + _bm25_sql("chunk_id IN (SELECT chunk_id FROM chunks WHERE audience = 'partner' "
                              "AND region IN ('GLOBAL', 'AMER'))") + _BM25_FINAL)
def corpus_keyword_top6_partner_amer(spark, sf_dir):
    """M6 + N4: audience/region filter applied before ranking (statistics over visible chunks)."""
    return _bm25(spark, sf_dir, (F.col("audience") == "partner") & F.col("region").isin("GLOBAL", "AMER"))


_VEC_SQL = """cent AS (
  SELECT label AS qid, list(m ORDER BY i) AS q FROM (
    SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) a GROUP BY 1, 2) b
  GROUP BY label),
cv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT cent.qid AS query_id, cv.vec_id,
             list_dot_product(cv.v, cent.q) / (sqrt(list_dot_product(cv.v, cv.v)) * sqrt(list_dot_product(cent.q, cent.q))) AS c
      FROM cv CROSS JOIN cent)"""


def _centroids(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    x = e.select("label", F.posexplode("embedding").alias("i", "x"))
    c = x.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s"))
    return c.select(F.col("label").cast("bigint").alias("vec_id"), F.transform("s", lambda t: t["m"]).alias("embedding"))


@register("corpus_vector_top6", "WITH " + _VEC_SQL + """
SELECT query_id, vec_id, cosine, rank FROM (
  SELECT query_id, vec_id, CAST(round(c, 6) AS DECIMAL(18,6)) AS cosine,
         row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(c, 6) AS DECIMAL(18,6)) DESC, vec_id) AS rank
  FROM s) x WHERE rank <= 6""")
def corpus_vector_top6(spark, sf_dir):
    """The 6 vectors nearest (cosine) to each label centroid; centroids are the queries."""
    e = read_table(spark, sf_dir, "embeddings")
    r = corpus.cosine_top_k(e, _centroids(spark, sf_dir), 6)
    return r.select(F.col("query_id").cast("int").alias("query_id"), "vec_id", "cosine",
                    F.col("rank").cast("bigint").alias("rank"))


def _rrf_sql() -> str:
    import re as _re
    full = _bm25_sql()
    part = full[len(_CHUNKS_SQL):]
    names = ["ctok", "post", "stats", "dft", "qt", "scored"]

    def suffixed(sql, sfx):
        for n in names:
            sql = _re.sub(rf"\b{n}\b", f"{n}_{sfx}", sql)
        return sql
    part_b = _bm25_sql("chunk_id IN (SELECT chunk_id FROM chunks WHERE audience = 'partner' "
                       "AND region IN ('GLOBAL', 'AMER'))")[len(_CHUNKS_SQL):]
    rank = """{r} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id
                 ORDER BY CAST(round(score, 6) AS DECIMAL(18,6)) DESC, doc_id, pos) AS rank FROM {s})"""
    return ("WITH " + _CHUNKS_SQL + suffixed(part, "a") + suffixed(part_b, "b") + ",\n"
            + rank.format(r="ra", s="scored_a") + ",\n" + rank.format(r="rb", s="scored_b") + """,
u AS (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS rrf FROM ra WHERE rank <= 6
      UNION ALL SELECT query_id, chunk_id, 1.0 / (60 + rank) FROM rb WHERE rank <= 6),
f AS (SELECT query_id, chunk_id, CAST(round(sum(rrf), 8) AS DECIMAL(18,8)) AS rrf_score FROM u GROUP BY 1, 2)
SELECT query_id, chunk_id, rrf_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f) x
WHERE rank <= 6""")


@register("corpus_hybrid_rrf", _rrf_sql())
def corpus_hybrid_rrf(spark, sf_dir):
    """Reciprocal-rank fusion of the unfiltered and the audience-filtered BM25 rankings."""
    a = _bm25(spark, sf_dir)
    b = _bm25(spark, sf_dir, (F.col("audience") == "partner") & F.col("region").isin("GLOBAL", "AMER"))
    r = corpus.reciprocal_rank_fusion([a, b], ["query_id"], "chunk_id")
    return r.select("query_id", "chunk_id", "rrf_score", F.col("rank").cast("bigint").alias("rank"))


QUERY_EVERY = 100  # the documents whose id it divides are the queries


_HYBRID_SQL = f"""WITH dtok AS (SELECT doc_id, {_tok('text')} AS toks FROM documents WHERE length(trim(text)) > 0),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dtok) x GROUP BY 1, 2, 3),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM dtok),
dft AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT doc_id AS query_id, unnest(toks) AS term FROM dtok WHERE doc_id % {QUERY_EVERY} = 0),
kw AS (SELECT q.query_id, p.doc_id,
              sum(ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
       FROM qt q JOIN dft d ON q.term = d.term JOIN post p ON p.term = q.term CROSS JOIN stats s GROUP BY 1, 2),
ra AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score, 6) AS DECIMAL(18,6)) DESC, doc_id) AS place FROM kw),
cv AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cs AS (SELECT q.doc_id AS query_id, c.doc_id,
              list_dot_product(c.v, q.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(q.v, q.v))) AS c
       FROM cv c CROSS JOIN cv q WHERE q.doc_id % {QUERY_EVERY} = 0),
rb AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(c, 6) AS DECIMAL(18,6)) DESC, doc_id) AS place FROM cs),
u AS (SELECT query_id, doc_id, 1.0 / (60 + place) AS rrf, 1 AS kw, 0 AS vec FROM ra WHERE place <= 6
      UNION ALL SELECT query_id, doc_id, 1.0 / (60 + place), 0, 1 FROM rb WHERE place <= 6),
f AS (SELECT query_id, doc_id, CAST(round(sum(rrf), 8) AS DECIMAL(18,8)) AS rrf_score, sum(kw) > 0 AS by_keyword, sum(vec) > 0 AS by_vector
      FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, rrf_score, by_keyword, by_vector, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM f) x WHERE rank <= 6"""


@register("corpus_hybrid_vector", _HYBRID_SQL)
def corpus_hybrid_vector(spark, sf_dir):
    """N6 over N4 and N5: the documents like a document, for every id divisible by 100: BM25 over whole texts and the
    cosine of the vectors, six each, fused by reciprocal ranks.  A document's vector is the stand-in row of
    ``embeddings`` with its id."""
    from fundlake.session import materialize
    d = read_table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0).select("doc_id", "text")
    e = read_table(spark, sf_dir, "embeddings")
    asked = d.where(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    a = corpus.bm25_top_k(d, asked, 6, keys=("doc_id",), text_col="text", materialize=lambda x: materialize(x, "bm25-postings"))
    b = corpus.cosine_top_k_in_blocks(e, e.where(F.col("vec_id") % QUERY_EVERY == 0), 6).withColumnRenamed("vec_id", "doc_id")
    r = corpus.reciprocal_rank_fusion([a, b], ["query_id"], "doc_id", names=["keyword", "vector"])
    return r.select("query_id", "doc_id", "rrf_score", "by_keyword", "by_vector", F.col("rank").cast("bigint").alias("rank"))


# -------------------------------------------------------------- chat + eval tables
def chat_turns(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    user = F.col("conv_id") % 10
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", "text",
                    F.concat(F.lit("U-"), user.cast("string")).alias("user_id"),
                    _pick(ROLES, user % 5).alias("user_role"),
                    ((F.length("text") * 7) % 9000).cast("int").alias("latency_ms"))


_CHAT_SQL = f"""chat AS (
  SELECT conv_id AS session_id, turn AS turn_index, role, text, concat('U-', cast(conv_id % 10 AS string)) AS user_id,
         {_sql_pick(ROLES, '(conv_id % 10) % 5')} AS user_role, CAST((length(text) * 7) % 9000 AS INTEGER) AS latency_ms
  FROM conversations)"""


def eval_answers(spark, sf_dir) -> DataFrame:
    """Assistant turns with citations injected by a rule on the conversation id."""
    t = chat_turns(spark, sf_dir).filter(F.col("role") == "assistant")
    k = F.col("session_id")
    cite = (F.when(k % 4 == 0, F.concat(F.lit(" [KA-HANDBOOK-00"), (k % 7).cast("string"), F.lit(" §2.1]")))
            .when(k % 4 == 1, F.lit(" See KA-ELIG-002 and KA-ELIG-002 §3."))
            .when(k % 4 == 2, F.lit(" (KA-FAQ-010 §4; KA-PB-003)")).otherwise(F.lit("")))
    return t.select("session_id", "turn_index", F.concat(F.col("text"), cite).alias("answer"),
                    (k % 3 == 0).alias("must_cite"), _pick(CATEGORIES, k % 4).alias("category"))


_EVAL_SQL = _CHAT_SQL + f""",
answers AS (
  SELECT session_id, turn_index,
         text || CASE WHEN session_id % 4 = 0 THEN ' [KA-HANDBOOK-00' || cast(session_id % 7 AS string) || ' §2.1]'
                      WHEN session_id % 4 = 1 THEN ' See KA-ELIG-002 and KA-ELIG-002 §3.'
                      WHEN session_id % 4 = 2 THEN ' (KA-FAQ-010 §4; KA-PB-003)' ELSE '' END AS answer,
         session_id % 3 = 0 AS must_cite, {_sql_pick(CATEGORIES, 'session_id % 4')} AS category
  FROM chat WHERE role = 'assistant')"""


@register("chat_next_turn", "WITH " + _CHAT_SQL + """
SELECT session_id, coalesce(max(turn_index), -1) + 1 AS next_turn_index FROM chat GROUP BY session_id""")
def chat_next_turn(spark, sf_dir):
    """Next turn index per session."""
    t = chat_turns(spark, sf_dir)
    return t.groupBy("session_id").agg((F.coalesce(F.max("turn_index"), F.lit(-1)) + 1).alias("next_turn_index"))


@register("chat_latest_session", "WITH " + _CHAT_SQL + """
SELECT user_id, max(session_id) AS latest_session_id, count(DISTINCT session_id) AS n_sessions FROM chat GROUP BY user_id""")
def chat_latest_session(spark, sf_dir):
    """Latest session per user (session ids increase with start time)."""
    t = chat_turns(spark, sf_dir)
    return t.groupBy("user_id").agg(F.max("session_id").alias("latest_session_id"),
                                    F.countDistinct("session_id").alias("n_sessions"))


@register("chat_last_turns", "WITH " + _CHAT_SQL + """
SELECT session_id, turn_index, role, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC, role) AS rn FROM chat) x WHERE rn <= 8""")
def chat_last_turns(spark, sf_dir):
    """The last 8 turns per session (returned with their recency rank)."""
    t = chat_turns(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_index"), F.asc("role"))
    r = t.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 8)
    return r.select("session_id", "turn_index", "role", F.col("rn").cast("bigint").alias("rn")).orderBy(
        "session_id", "turn_index")


@register("chat_compaction_buckets", "WITH " + _CHAT_SQL + """
SELECT session_id, turn_index // 10 AS bucket, count(*) AS n_turns, sum(length(text)) AS n_chars FROM chat GROUP BY 1, 2""")
def chat_compaction_buckets(spark, sf_dir):
    """Turns folded per block of 10 (size of each compaction unit)."""
    t = chat_turns(spark, sf_dir)
    return t.groupBy("session_id", F.floor(F.col("turn_index") / 10).cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@register("chat_latency_by_role", "WITH " + _CHAT_SQL + """
SELECT role, CAST(quantile_cont(latency_ms, 0.5) AS DECIMAL(12,2)) AS p50_ms,
       CAST(quantile_cont(latency_ms, 0.95) AS DECIMAL(12,2)) AS p95_ms, count(*) AS n_turns FROM chat GROUP BY role""")
def chat_latency_by_role(spark, sf_dir):
    """Latency percentiles per role."""
    t = chat_turns(spark, sf_dir)
    return t.groupBy("role").agg(F.percentile("latency_ms", 0.5).cast("decimal(12,2)").alias("p50_ms"),
                                 F.percentile("latency_ms", 0.95).cast("decimal(12,2)").alias("p95_ms"),
                                 F.count(F.lit(1)).alias("n_turns"))


_NORM = r"' ' || trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


def _rx(x, alts):
    return f"regexp_matches({_NORM.format(x=x)}, ' ({alts}) ')"


@register("question_routes", "WITH " + _CHAT_SQL + f"""
SELECT session_id, turn_index, user_role,
       CASE WHEN user_role = 'channel_mgr' AND {_rx('text', corpus.REFUSE_OTHER_REGION)} THEN 'refuse'
            WHEN {_rx('text', corpus.QUANT_VERBS)} THEN
                 CASE WHEN {_rx('text', corpus.MARKETING_SIGNALS)} THEN 'metrics_marketing' ELSE 'metrics_utilization' END
            WHEN {_rx('text', corpus.POLICY_VERBS)} THEN 'ka' ELSE 'ka' END AS route
FROM chat WHERE role = 'user'""")
def question_routes(spark, sf_dir):
    """Route every user question (regex precedence, refusal for region-scoped roles)."""
    t = chat_turns(spark, sf_dir).filter(F.col("role") == "user")
    return t.select("session_id", "turn_index", "user_role", corpus.route(F.col("text"), F.col("user_role")).alias("route"))


@register("eval_citations", "WITH " + _EVAL_SQL + r"""
SELECT session_id, turn_index, citation, CAST(min(pos) AS INTEGER) AS first_pos FROM (
  SELECT session_id, turn_index, unnest(regexp_extract_all(answer, 'KA-[A-Z]+-[0-9]{3}')) AS citation,
         unnest(range(0, len(regexp_extract_all(answer, 'KA-[A-Z]+-[0-9]{3}')))) AS pos
  FROM answers) x GROUP BY 1, 2, 3""")
def eval_citations(spark, sf_dir):
    """Cited doc ids per answer with first-seen position."""
    a = eval_answers(spark, sf_dir)
    x = a.select("session_id", "turn_index",
                 F.posexplode(F.regexp_extract_all("answer", F.lit(f"({corpus.CITATION})"), 1)).alias("pos", "citation"))
    return x.groupBy("session_id", "turn_index", "citation").agg(F.min("pos").cast("int").alias("first_pos"))


@register("eval_citation_sections", "WITH " + _EVAL_SQL + r"""
SELECT session_id, turn_index, cited[1] AS citation, cited[2] AS section, CAST(min(pos) AS INTEGER) AS first_pos FROM (
  SELECT session_id, turn_index, unnest(list_transform(regexp_extract_all(answer, 'KA-[A-Z]+-[0-9]{3}(?: §[0-9]+(?:[.][0-9]+)*)?'),
           lambda c: [c[1:strpos(c || ' ', ' ') - 1], CASE WHEN contains(c, '§') THEN string_split(c, '§')[2] ELSE '' END])) AS cited,
         unnest(range(0, len(regexp_extract_all(answer, 'KA-[A-Z]+-[0-9]{3}')))) AS pos
  FROM answers) x GROUP BY ALL""")
def eval_citation_sections(spark, sf_dir):
    """The document and section each answer cites, in first-seen order; first_pos counts all citations."""
    a = eval_answers(spark, sf_dir)
    every = F.lit(f"({corpus.CITATION})(?: §([0-9]+(?:[.][0-9]+)*))?")
    said = F.transform(F.arrays_zip(F.regexp_extract_all("answer", every, 1).alias("doc"), F.regexp_extract_all("answer", every, 2).alias("section")),
                       lambda c: F.struct(c["doc"].alias("doc"), c["section"].alias("section")))
    x = a.select("session_id", "turn_index", said.alias("said"), F.explode(corpus.citations(F.col("answer"))).alias("c"))
    first = F.array_position(F.transform("said", lambda c: F.concat_ws(" ", c["doc"], c["section"])), F.concat_ws(" ", F.col("c.doc"), F.col("c.section")))
    return x.select("session_id", "turn_index", F.col("c.doc").alias("citation"), F.col("c.section").alias("section"), (first - 1).cast("int").alias("first_pos"))


@register("eval_citation_scores", "WITH " + _EVAL_SQL + """
SELECT category, count(*) AS n_answers,
       count_if(CASE WHEN must_cite THEN regexp_matches(answer, 'KA-[A-Z]+-[0-9]{3}') ELSE TRUE END) AS n_passed,
       """ + _sd("count_if(CASE WHEN must_cite THEN regexp_matches(answer, 'KA-[A-Z]+-[0-9]{3}') ELSE TRUE END)",
                  "count(*)", 4) + """ AS pass_rate
FROM answers GROUP BY category""")
def eval_citation_scores(spark, sf_dir):
    """N8 + N10: citation-present scorer and pass rate per category."""
    a = eval_answers(spark, sf_dir).withColumn("passed", corpus.citation_present(F.col("must_cite"), F.col("answer")))
    g = a.groupBy("category").agg(F.count(F.lit(1)).alias("n_answers"), F.count_if("passed").alias("n_passed"))
    return g.select("category", "n_answers", "n_passed", ratio("n_passed", "n_answers", 4).alias("pass_rate"))


@register("eval_numbers_in_range", "WITH " + _CHAT_SQL + r"""
SELECT session_id, turn_index,
       len(regexp_extract_all(text, '[0-9][0-9,]*\.?[0-9]*')) AS n_numbers,
       coalesce(list_bool_or(list_transform(regexp_extract_all(text, '[0-9][0-9,]*\.?[0-9]*'),
                 lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE) BETWEEN 1 AND 100)), false) AS has_number_in_range
FROM chat""")
def eval_numbers_in_range(spark, sf_dir):
    """Numbers found in each turn and whether any lies in [1, 100]."""
    t = chat_turns(spark, sf_dir)
    nums = F.regexp_extract_all("text", F.lit(f"({corpus.NUMBER})"), 1)
    return t.select("session_id", "turn_index", F.size(nums).cast("bigint").alias("n_numbers"),
                    F.coalesce(corpus.numbers_in_range(F.col("text"), 1, 100), F.lit(False)).alias("has_number_in_range"))


@register("eval_trace_sample", "WITH " + _EVAL_SQL + """
SELECT t.session_id, t.turn_index, t.role, a.category
FROM (SELECT * FROM chat WHERE CAST('0x' || substr(md5(concat_ws('|', CAST(session_id AS VARCHAR), CAST(turn_index AS VARCHAR), role)), 1, 6) AS BIGINT) % 100 < 20) t
LEFT JOIN (SELECT DISTINCT session_id, category FROM answers) a ON t.session_id = a.session_id""")
def eval_trace_sample(spark, sf_dir):
    """A 20% sample of chat turns joined to the eval rows of the same session; a turn's hash decides,
    so the sample is the same on every cluster."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("session_id").cast("string"), F.col("turn_index").cast("string"),
                                                  "role")), 1, 6), 16, 10).cast("bigint") % 100
    t = chat_turns(spark, sf_dir).filter(bucket < 20)
    a = eval_answers(spark, sf_dir).select("session_id", "category").distinct()
    return t.join(a, "session_id", "left").select("session_id", "turn_index", "role", "category")


def _preview_sql() -> str:
    from fundlake.plans.oracle import q as _q
    return _q("""
SELECT (SELECT count(*) FROM top) AS n_rows,
       string_agg(dealer_id || ' | ' || CAST(net_revenue_usd AS VARCHAR), '; ' ORDER BY net_revenue_usd DESC, dealer_id) AS preview
FROM (SELECT * FROM top ORDER BY net_revenue_usd DESC, dealer_id LIMIT 3) x""", """top AS (
  SELECT p.dealer_id, d.dealer_name, CAST(sum(p.net_revenue_usd) AS DECIMAL(18,2)) AS net_revenue_usd
  FROM perf p LEFT JOIN s_dealer d ON p.dealer_id = d.dealer_id
  GROUP BY 1, 2 ORDER BY net_revenue_usd DESC, dealer_id LIMIT 10)""")


@register("result_preview", _preview_sql())
def result_preview(spark, sf_dir):
    """Row count and the first 3 rows (total order) of a result as one text line."""
    from fundlake.plans.catalog import q_top10_dealers_revenue
    r = q_top10_dealers_revenue(spark, sf_dir)
    n = r.agg(F.count(F.lit(1))).scalar()
    first3 = r.orderBy(F.desc("net_revenue_usd"), "dealer_id").limit(3)
    item = F.struct((-F.col("net_revenue_usd")).alias("o"), F.col("dealer_id"),
                    F.concat_ws(" | ", F.col("dealer_id"), F.col("net_revenue_usd").cast("string")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"])
    return first3.agg(F.array_join(lines, "; ").alias("preview")).select(n.alias("n_rows"), "preview")


@register("eval_expected_facts", "WITH " + _CHAT_SQL + f""",
qa AS (
  SELECT u.session_id, u.turn_index, list_filter([list_min({_tok('u.text')}), list_max({_tok('u.text')})], lambda f: f IS NOT NULL) AS facts, lower(a.text) AS answer
  FROM chat u LEFT JOIN chat a ON a.session_id = u.session_id AND a.turn_index = u.turn_index + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')
SELECT session_id, turn_index, len(facts) AS n_facts,
       answer IS NOT NULL AND coalesce(list_bool_and(list_transform(facts, lambda f: contains(answer, f))), true) AS passed
FROM qa""")
def eval_expected_facts(spark, sf_dir):
    """The answer (next assistant turn) must contain every expected fact; the facts of a
    question are the first and the last of all its tokens in dictionary order.  A question without
    an answer fails."""
    t = chat_turns(spark, sf_dir)
    u = t.filter(F.col("role") == "user").select("session_id", "turn_index",
                                                  F.array_compact(F.array(F.array_min(corpus.tokens(F.col("text"))),
                                                                           F.array_max(corpus.tokens(F.col("text"))))).alias("facts"))
    a = t.filter(F.col("role") == "assistant").select("session_id", (F.col("turn_index") - 1).alias("turn_index"),
                                                       F.lower("text").alias("answer"))
    j = u.join(a, ["session_id", "turn_index"], "left")
    return j.select("session_id", "turn_index", F.size("facts").cast("bigint").alias("n_facts"),
                    F.coalesce(F.col("answer").isNotNull() & F.forall("facts", lambda f: F.col("answer").contains(f)),
                               F.lit(False)).alias("passed"))
