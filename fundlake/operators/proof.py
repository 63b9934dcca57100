"""Proof completeness -- which required documents a claim lacks -- as relational division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The documents that a claim of an activity (by number) needs.
PROOF_DOCUMENTS = [
    ([0, 1, 2], ["creative", "platform_invoice", "placement_screenshot", "run_dates"]),
    ([3], ["creative", "audience_size", "send_dates", "platform_invoice"]),
    ([4], ["live_url", "page_screenshots", "analytics_14_days"]),
    ([5], ["final_asset", "partner_invoice", "placement_screenshot"]),
    ([6], ["account_list", "campaign_brief", "vendor_invoice", "performance_report"]),
    ([7, 8, 10], ["invite", "agenda", "attendee_list", "event_photos", "vendor_invoice"]),
    ([9, 11], ["booth_contract", "booth_photos", "lead_export", "vendor_invoice"]),
    ([12, 13, 14], ["before_after_photos", "design_plan", "contractor_invoice", "signage_photo"]),
    ([15], ["printed_sample", "print_invoice"]),
    ([16, 17], ["final_asset", "rights_confirmation", "vendor_invoice"]),
    ([18, 19], ["final_asset", "publishing_date", "promotion_plan"]),
    ([20, 21], ["agreement", "benefits_list", "context_photo"]),
]
WORD = 63  # documents whose presence one long holds


def requirements(spark: SparkSession) -> DataFrame:
    """(activity_type_id, document): a fixed table of 76 rows."""
    rows = [(f"ACT-{a:02d}", d) for acts, docs in PROOF_DOCUMENTS for a in acts for d in docs]
    return spark.createDataFrame(rows, "activity_type_id string, document string")


def completeness(claims: DataFrame, needed: DataFrame, files: DataFrame) -> DataFrame:
    """(claim_id, n_required, n_missing, missing): ``claims`` (claim_id, activity_type_id) divided by the
    requirement matrix; ``files`` (claim_id, document) may repeat a document and may hold others.  A claim
    whose activity asks for nothing lacks nothing.

    The matrix is a short code list: its documents are read and numbered, the files of a claim combine to one bit a
    document before any exchange, and what a claim lacks follows in its row.  One row a claim is joined by shuffle
    (its size is not known beforehand, so it is never broadcast)."""
    names = sorted(r[0] for r in needed.select("document").where("document IS NOT NULL").distinct().collect())
    word, bit = {n: f"__w{i // WORD}" for i, n in enumerate(names)}, {n: 1 << i % WORD for i, n in enumerate(names)}

    def word_of(w: str) -> F.Column:
        mine = {n: b for n, b in bit.items() if word[n] == w}
        return F.bit_or(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for nb in mine.items() for x in nb]).cast("map<string,long>"),
                                                    F.col("document")), F.lit(0).cast("long"))).alias(w)
    bits = files.where(F.col("claim_id").isNotNull() & F.col("document").isin(names)).groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("__n_files"), *[word_of(w) for w in sorted(set(word.values()))])
    asked = needed.where("document IS NOT NULL").groupBy("activity_type_id").agg(F.collect_list("document").alias("__asked"))
    have = [F.when(F.col(word[n]).bitwiseAND(F.lit(bit[n])) != 0, F.lit(n)) for n in names]
    none = F.array().cast("array<string>")
    j = claims.select("claim_id", "activity_type_id").join(F.broadcast(asked), "activity_type_id", "left") \
        .join(bits.hint("merge"), "claim_id", "left").withColumn("__have", F.array_compact(F.array(*have)).cast("array<string>"))
    needs = F.coalesce("__asked", none)
    lacks = F.filter(needs, lambda d: ~F.array_contains("__have", d))
    j = j.select("claim_id", F.size(needs).cast("long").alias("__n"), lacks.alias("__lacks"))
    return j.groupBy("claim_id").agg(F.sum("__n").alias("n_required"), F.sum(F.size("__lacks").cast("long")).alias("n_missing"),
                                     F.array_join(F.sort_array(F.flatten(F.collect_list("__lacks"))), ",").alias("missing"))
