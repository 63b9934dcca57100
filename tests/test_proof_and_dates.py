"""Every code, flag and level of the rule queries occurs on the driver data, and the operators on planted rows."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID
from fundlake.functions import fiscal
from fundlake.operators import corpus, proof, rules, windows, workflow

Q = E.queries()


def test_every_rejection_code_occurs(spark):
    codes = {r.code for r in Q["rule_rejection_reasons"](spark, SF_MID).collect()}
    assert codes == {"MISSING_PREAPPROVAL", "TIER_INELIGIBLE", "OFF_BRAND", "OUT_OF_REGION", "DOC_INCOMPLETE", "DOUBLE_DIP", "OTHER"}


def test_every_due_date_outcome_occurs(spark):
    r = Q["rule_due_dates"](spark, SF_MID)
    for flag in ("decided_late", "paid_late", "proof_late"):
        assert {x[0] for x in r.select(flag).distinct().collect()} == {True, False}


def test_claims_with_and_without_all_documents(spark):
    r = Q["rule_proof_completeness"](spark, SF_MID).agg(F.count_if(F.expr("n_missing = 0")), F.count_if(F.expr("n_missing > 0")),
                                                        F.count_if(F.col("n_missing") > F.col("n_required"))).first()
    assert r[0] > 0 and r[1] > 0 and r[2] == 0


def test_proof_completeness_on_planted_files(spark):
    claims = spark.createDataFrame([("c1", "ACT-15"), ("c2", "ACT-15"), ("c3", "ACT-99"), ("c4", None)], "claim_id string, activity_type_id string")
    files = spark.createDataFrame([("c1", "print_invoice"), ("c1", "print_invoice"), ("c1", "agenda"), ("c2", "print_invoice"), ("c2", "printed_sample")],
                                  "claim_id string, document string")
    got = {r.claim_id: (r.n_required, r.n_missing, r.missing) for r in proof.completeness(claims, proof.requirements(spark), files).collect()}
    assert got == {"c1": (2, 1, "printed_sample"), "c2": (2, 0, ""), "c3": (0, 0, ""), "c4": (0, 0, "")}


def test_after_business_days(spark):
    cal = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-29')) as date_key") \
        .withColumn("is_business_day", ~F.dayofweek("date_key").isin(1, 7))
    idx = fiscal.business_day_index(cal)
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),), (None,), (dt.date(2024, 2, 29),)], "d date")
    got = {r.d: r.due for r in rules.after_business_days(df, idx, "d", 3, "due").collect()}
    # from a Friday and from the Saturday after it: Wednesday
    assert got == {dt.date(2024, 1, 5): dt.date(2024, 1, 10), dt.date(2024, 1, 6): dt.date(2024, 1, 10), None: None, dt.date(2024, 2, 29): None}


def test_list_hash_tells_lists_of_equal_count_and_sum_apart(spark):
    lists = spark.createDataFrame([("a", 0, ["D-1", "D-4"]), ("b", 0, ["D-2", "D-3"]), ("c", 0, ["D-1"]), ("c", 1, ["D-4"]), ("d", 1, ["D-4"]), ("d", 0, ["D-1"])],
                                  "region_id string, part long, dealer_ids array<string>")
    h = {r.region_id: (r.n_ids, r.ids_hash) for r in workflow.list_hash(lists, "region_id").collect()}
    assert {x[0] for x in h.values()} == {2} and h["c"] == h["d"] and len({x[1] for x in h.values()}) == 3


def test_daily_grid_has_every_day_of_a_span(spark):
    ev = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5), ("a", dt.date(2024, 1, 4), 2), ("a", dt.date(2024, 1, 4), 1), ("b", dt.date(2024, 3, 1), 7)], "k string, day date, v int")
    got = [(r.k, r.day.day, r.v, r.cum_v) for r in windows.daily_grid(ev, ["k"], "day", ["v"]).orderBy("k", "day").collect()]
    assert got == [("a", 1, 5, 5), ("a", 2, 0, 5), ("a", 3, 0, 5), ("a", 4, 3, 8), ("b", 1, 7, 7)]


def test_compaction_follows_the_step_by_step_fold(spark):
    sizes = {"s": [k + 1 for k in range(47)], "t": [3] * 9, "u": [2] * 10}
    df = spark.createDataFrame([(s, k, x) for s, xs in sizes.items() for k, x in enumerate(xs)], "s string, turn int, n int")
    got = {}
    for r in windows.compacted(df, "s", ["turn"], "n").orderBy("s", "position").collect():
        got.setdefault(r.s, []).append((r.n_turns, r.n))
    want = {}
    for s, xs in sizes.items():
        rows = []
        for k, x in enumerate(xs):
            rows.append((1, x))
            if (k + 1) % 10 == 0:
                rows = [tuple(map(sum, zip(*rows[:6])))] + rows[6:]
        want[s] = rows
    assert got == want


def test_sections_keep_tables_and_ignore_fenced_headings(spark):
    md = "intro\n## 1. First\ntext\n| a |\n|---|\n```\n## no\n```\n### 1.1 Sub\nx\n## 2.3 Second\n## Part & Rule"
    rows = corpus.sections(spark.createDataFrame([(1, md), (2, "## 7. Only"), (3, "\n\n"), (4, "```\n## a\n```\n## b"), (5, None)], "id int, md string"), "id", "md").collect()
    got = [(r.id, r.section_no, r.section_id, r.title) for r in rows]
    assert got == [(1, 0, "0", ""), (1, 1, "1", "First"), (1, 2, "2.3", "Second"), (1, 3, "part-rule", "Part & Rule"), (2, 1, "7", "Only"), (4, 0, "0", ""), (4, 1, "b", "b")]
    assert "".join(r.section_text for r in rows if r.id == 1) == md and "### 1.1 Sub" in rows[1].section_text


def test_bm25_equals_all_pairs(spark):
    import math
    import random
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rnd.choices(words, [60 - k for k in range(60)], k=rnd.randint(1, 30))) for _ in range(300)] + ["w1", "w1"]
    queries = [" ".join(rnd.choices(words, k=8)) for _ in range(12)] + ["w0 w1", "unknown", "w59"]
    ch = spark.createDataFrame([(k // 3, k % 3, t) for k, t in enumerate(texts)], "doc_id long, pos int, chunk_text string")
    qs = spark.createDataFrame(list(enumerate(queries)), "query_id int, query_text string")
    got = {(r.query_id, r.doc_id, r.pos): (r["rank"], float(r.score)) for r in corpus.bm25_top_k(ch, qs, 6).collect()}
    toks = [t.split() for t in texts]
    avg, n = sum(map(len, toks)) / len(toks), len(toks)
    want = {}
    for qi, query in enumerate(queries):
        scored = []
        for k, t in enumerate(toks):
            s = 0.0
            for w in set(query.split()):
                df = sum(w in x for x in toks)
                tf = t.count(w)
                if tf:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if s:
                scored.append((-round(s, 6), k // 3, k % 3))
        want.update({(qi, d, p): (i + 1, -s) for i, (s, d, p) in enumerate(sorted(scored)[:6])})
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
