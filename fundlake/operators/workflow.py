"""Workflow tables as set-based updates.

Every "update" is expressed as a new version of a table: decisions are joined to
the current rows, a guarded projection computes the next state, and the result
is written (append or overwrite) by the caller.  Nothing loops on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.operators.history import latest_per_key

# Review states, terminal states, rejection codes (precedence order).
REVIEW_STATES = ["Pending", "Approved", "Rejected", "PaidStaged"]
TERMINAL_REVIEW_STATES = ["Approved", "Rejected", "PaidStaged"]
REJECTION_CODES = ["MISSING_PREAPPROVAL", "TIER_INELIGIBLE", "OFF_BRAND", "OUT_OF_REGION", "DOC_INCOMPLETE",
                   "DOUBLE_DIP", "OTHER"]


def review_queue(claims: DataFrame) -> DataFrame:
    """claim_review rows mirrored from claims (Submitted/Under_Review -> Pending, ...)."""
    st = F.col("status")
    rs = (F.when(st.isin("Submitted", "Under_Review"), F.lit("Pending")).when(st == "Approved", F.lit("Approved"))
          .when(st == "Rejected", F.lit("Rejected")).when(st == "Paid", F.lit("PaidStaged")))
    created = F.col("submission_date").cast("timestamp")
    decided = F.col("decision_date").cast("timestamp")
    return (claims.select("claim_id", "dealer_id", rs.alias("status"), "requested_amount_usd",
                          created.alias("created_at"), decided.alias("decision_at"),
                          F.coalesce(decided, created).alias("updated_at"))
            .filter(F.col("status").isNotNull()))


def apply_decisions(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Guarded state update.  Only non-terminal reviews advance; a decision on a
    terminal review is a no-op reported with ``was_idempotent``.  Several decisions for
    one claim: the earliest wins (later ones meet a terminal state)."""
    first = latest_per_key(decisions.select("claim_id", F.col("decided_at").cast("long").alias("neg_t"),
                                            "decided_at", "decision", "user_id")
                           .withColumn("neg_t", -F.col("neg_t")), ["claim_id"], "neg_t").drop("neg_t")
    j = first.join(reviews.select("claim_id", F.col("status").alias("old_status")), "claim_id", "left")
    terminal = F.col("old_status").isin(TERMINAL_REVIEW_STATES)
    target = F.when(F.col("decision") == "Approve", F.lit("Approved")).otherwise(F.lit("Rejected"))
    return j.select(
        "claim_id", "old_status",
        F.when(F.col("old_status").isNull(), F.lit(None).cast("string"))
        .when(terminal, F.col("old_status")).otherwise(target).alias("new_status"),
        F.coalesce(terminal, F.lit(False)).alias("was_idempotent"),
        (F.col("old_status").isNotNull() & ~F.coalesce(terminal, F.lit(False))).alias("applied"),
        "user_id", "decided_at")


def next_reviews(reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New version of claim_review after applied decisions (B7 upsert: latest wins)."""
    upd = (outcomes.filter("applied")
           .join(reviews.drop("status", "decision_at", "updated_at"), "claim_id")
           .select("claim_id", "dealer_id", F.col("new_status").alias("status"), "requested_amount_usd",
                   "created_at", F.col("decided_at").alias("decision_at"), F.col("decided_at").alias("updated_at")))
    return upsert(reviews, upd, ["claim_id"], "updated_at")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Union + latest row per key by ``order_col`` (ties: the update wins)."""
    t = target.withColumn("__src", F.lit(0))
    u = updates.select(*target.columns).withColumn("__src", F.lit(1))
    both = t.unionByName(u).withColumn("__ord", F.struct(F.col(order_col), F.col("__src")))
    return latest_per_key(both, keys, "__ord").drop("__ord", "__src")


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING -- only rows whose key is absent are added."""
    new = rows.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def effective_status(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claim status with the latest workflow decision applied."""
    r = latest_per_key(reviews.select("claim_id", "updated_at", "status"), ["claim_id"], "updated_at")
    j = claims.join(r.withColumnRenamed("status", "review_status"), "claim_id", "left")
    eff = (F.when(F.col("review_status") == "Approved", F.lit("Approved"))
           .when(F.col("review_status") == "Rejected", F.lit("Rejected"))
           .when(F.col("review_status") == "PaidStaged", F.lit("Paid")).otherwise(F.col("status")))
    return j.withColumn("effective_status", eff)


def call_hash(user: Column, ids: Column, template: Column, deadline: Column) -> Column:
    """Deterministic request hash over a request-sized id list (sorted)."""
    return F.sha2(F.concat_ws("|", user, F.array_join(F.sort_array(ids), ","), template,
                              F.coalesce(deadline.cast("string"), F.lit("None"))), 256)


def list_hash(lists: DataFrame, key: str, part: str = "part", ids: str = "dealer_ids") -> DataFrame:
    """C25 over id lists of any length: (key, n_ids, ids_hash).  ``lists`` holds the sorted ids of a key in
    parts of bounded size; each part is hashed, and the parts' hashes in their order (64 characters a
    part) are hashed again."""
    leaf = lists.select(key, part, F.size(ids).cast("long").alias("n"), F.sha2(F.array_join(ids, ","), 256).alias("h"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(part, "h"))), lambda x: x["h"])
    return leaf.groupBy(key).agg(F.sum("n").alias("n_ids"), F.sha2(F.array_join(ordered, ","), 256).alias("ids_hash"))


def campaign_code(created: Column, hash_hex: Column) -> Column:
    """``nudge-YYYYMM-<first 6 hex of the call hash>``."""
    return F.concat(F.lit("nudge-"), F.date_format(created, "yyyyMM"), F.lit("-"), F.substring(hash_hex, 1, 6))


def resolve_recipients(requests: DataFrame, dealers: DataFrame, id_col: str = "dealer_ids") -> DataFrame:
    """Explode a request's id list and resolve each id against the dealer table."""
    x = requests.select("*", F.explode(id_col).alias("dealer_id")).drop(id_col)
    return x.join(dealers, "dealer_id", "left")
