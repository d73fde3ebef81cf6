"""Ledgers derived from the supplied tables, so every operator has real rows to run on.

``event_lines``: two lines a voucher with real posting times. ``order_lines``: many lines a
voucher, posted at midnight. Both are plain projections and joins of the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.config import Thresholds
from ledgerloom.functions import dates
from ledgerloom.schema import LINE_COLUMNS

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_VOUCHER_TYPES = ["journal", "contra", "purchase", "receipt", "sales"]

EVENT_THRESHOLDS = Thresholds(
    approval_limit_paise=5000,
    threshold_band_paise=500,
    materiality_paise=2500,
    round_step_paise=100,
    round_min_paise=500,
    rare_pair_max_share=0.0015,
    amount_deviation_threshold=4.0,
    unfamiliar_preparer_max_entries=1_000_000,
    unfamiliar_preparer_max_share=0.02,
)
LEDGER_THRESHOLDS = {"EVT": EVENT_THRESHOLDS, "ORD": Thresholds()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pad(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def two_digits(n: Column) -> Column:
    """A line number with a leading zero below ten."""
    return F.concat(F.when(n < 10, "0").otherwise(""), n.cast("string"))


def event_vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with the fields both of its lines share."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    ti = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") - 1
    shifted = F.col("ts") + F.make_dt_interval(F.lit(61))
    rung = sum((F.col("user_id") >= f).cast("int") for f in [1, 3, 7, 15, 31, 63, 127, 255, 511, 1023])
    base = e.select(
        k.alias("k"),
        ti.alias("ti"),
        "event_type",
        shifted.alias("shifted"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        rung.alias("rung"),
    )
    k, ti, amount = F.col("k"), F.col("ti"), F.col("amount")
    return base.select(
        "k",
        "ti",
        "amount",
        F.concat(F.lit("V"), pad(k, 9)).alias("voucher_id"),
        F.col("shifted").cast("date").alias("voucher_date"),
        (F.col("shifted") + F.when(k % 250 == 7, F.make_dt_interval(F.lit(60))).otherwise(F.make_dt_interval(F.lit(0)))).alias("posted_at"),
        F.element_at(F.array(*map(F.lit, EVENT_VOUCHER_TYPES)), ti + 1).alias("voucher_type"),
        F.concat(F.lit("5"), pad(ti, 3)).alias("debit_account"),
        F.concat(F.lit("2"), pad(F.col("rung"), 3)).alias("credit_account"),
        F.concat(F.lit("P"), F.when(k % 200 == 11, (ti + 1 + k % 4) % 5).otherwise(ti).cast("string")).alias("created_by"),
        F.when((amount >= 5000) | (k % 3 == 0), F.concat(F.lit("A"), (k % 3).cast("string"))).alias("approved_by"),
        F.when(k % 20 != 3, F.concat(F.lit("D"), k.cast("string"))).alias("document_ref"),
        F.when(k % 9 != 4, F.col("event_type")).alias("narration"),
        ti.isin(1, 2).alias("is_manual"),
        (k % 997 == 5).alias("is_post_close"),
    )


def event_lines(spark: SparkSession, sf_dir: str, *, positive_only: bool = True) -> DataFrame:
    v = event_vouchers(spark, sf_dir)
    if positive_only:
        v = v.where(F.col("amount") > 0)
    sides = F.explode(
        F.array(
            F.struct(F.lit(1).alias("line_number"), F.col("debit_account").alias("account_code")),
            F.struct(F.lit(2).alias("line_number"), F.col("credit_account").alias("account_code")),
        )
    )
    lines = v.withColumn("side", sides)
    n, code, zero = F.col("side.line_number"), F.col("side.account_code"), F.lit(0).cast("bigint")
    debit = n == 1
    return lines.select(
        F.lit("EVT").alias("ledger_id"),
        F.concat("voucher_id", F.lit("-"), pad(n, 2)).alias("line_id"),
        "voucher_id",
        n.alias("line_number"),
        F.lit("EVT-IN").alias("entity_id"),
        dates.fiscal_year(F.col("voucher_date")).alias("fiscal_year"),
        dates.fiscal_period(F.col("voucher_date")).alias("period"),
        "voucher_date",
        "posted_at",
        F.lit("date_and_time").alias("time_fidelity"),
        "voucher_type",
        code.alias("account_code"),
        F.concat(F.when(debit, "Expense ").otherwise("Creditor "), code).alias("account_name"),
        F.when(debit, "expense").otherwise("liability").alias("account_group"),
        F.when(debit, F.col("amount")).otherwise(zero).alias("debit_paise"),
        F.when(debit, zero).otherwise(F.col("amount")).alias("credit_paise"),
        F.lit("INR").alias("currency"),
        "created_by",
        "approved_by",
        "document_ref",
        "narration",
        F.lit(None).cast("string").alias("cost_centre"),
        "is_manual",
        "is_post_close",
        (F.col("k") * 2 + n + 1).alias("source_row"),
    ).select(*LINE_COLUMNS)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    nth = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    whole = Window.partitionBy("l_orderkey")
    zero = F.lit(0).cast("bigint")
    paise = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    supplier = F.concat(F.lit("5"), pad(F.col("l_suppkey") % 25, 3))
    placed = items.select(
        F.col("l_orderkey").alias("o_orderkey"), F.row_number().over(nth).alias("line_number"), supplier.alias("account_code"),
        paise.alias("debit_paise"), F.count(F.lit(1)).over(whole).alias("_n"), F.sum(paise).over(whole).alias("_total"),
    )
    line = lambda n, code, debit, credit: F.struct(
        n.alias("line_number"), code.alias("account_code"), debit.alias("debit_paise"), credit.alias("credit_paise")
    )
    item = line(F.col("line_number"), F.col("account_code"), F.col("debit_paise"), zero)
    # The last item of an order brings its credit line along.
    credit = line(F.col("line_number") + 1, F.lit(None).cast("string"), zero, F.col("_total"))
    sides = F.when(F.col("line_number") == F.col("_n"), F.array(item, credit)).otherwise(F.array(item))
    k = F.col("o_orderkey")
    n = F.col("line_number")
    lines = placed.select("o_orderkey", F.inline(sides)).join(o, "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    code = F.coalesce(F.col("account_code"), F.concat(F.lit("2"), pad(F.col("o_custkey") % 10, 3)))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    document = F.when(
        ~((F.col("o_orderstatus") == "P") & (k % 5 == 0)) & (n % 3 != 0),
        F.concat(F.lit("D"), k.cast("string"), F.lit("-"), n.cast("string")),
    )
    voucher = F.concat(F.lit("V"), pad(k, 9))
    debit = F.col("debit_paise") > 0
    return lines.select(
        F.lit("ORD").alias("ledger_id"),
        F.concat(voucher, F.lit("-"), two_digits(n)).alias("line_id"),
        voucher.alias("voucher_id"),
        n.alias("line_number"),
        F.lit("ORD-IN").alias("entity_id"),
        dates.fiscal_year(day).alias("fiscal_year"),
        dates.fiscal_period(day).alias("period"),
        day.alias("voucher_date"),
        F.date_add(day, (k % 4).cast("int")).cast("timestamp_ntz").alias("posted_at"),
        F.lit("date_only").alias("time_fidelity"),
        F.lit("purchase").alias("voucher_type"),
        code.alias("account_code"),
        F.concat(F.when(debit, "Expense ").otherwise("Creditor "), code).alias("account_name"),
        F.when(debit, "expense").otherwise("liability").alias("account_group"),
        "debit_paise",
        "credit_paise",
        F.lit("INR").alias("currency"),
        F.concat(F.lit("P"), (F.col("o_custkey") % 6).cast("string")).alias("created_by"),
        F.when(urgent, F.concat(F.lit("A"), (k % 3).cast("string"))).alias("approved_by"),
        document.alias("document_ref"),
        F.concat(F.lit("Order "), k.cast("string")).alias("narration"),
        F.concat(F.lit("CC"), (F.col("o_custkey") % 4).cast("string")).alias("cost_centre"),
        F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED").alias("is_manual"),
        (k % 499 == 0).alias("is_post_close"),
        (k * 1000 + n).alias("source_row"),
    ).select(*LINE_COLUMNS)


def both_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).unionByName(order_lines(spark, sf_dir))


def event_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted kinds and legitimate look-alikes of the event ledger, from its own arithmetic."""
    v = event_vouchers(spark, sf_dir).where(F.col("amount") > 0)
    k, ti, amount = F.col("k"), F.col("ti"), F.col("amount")
    near = (amount >= 4500) & (amount < 5000)
    anomalies = F.array_compact(
        F.array(
            F.when(k % 200 == 11, "unusual_preparer_account"),
            F.when((k % 250 == 7) | (k % 997 == 5), "post_close_entry"),
            F.when((k % 20 == 3) & ti.isin(1, 2) & (amount >= 2500), "missing_document_ref"),
            F.when(near & (k % 3 != 0), "threshold_adjacent"),
        )
    )
    decoys = F.array_compact(
        F.array(
            F.when(near & (k % 3 == 0), "legit_below_threshold"),
            F.when((k % 20 == 3) & ~ti.isin(1, 2), "legit_system_no_document"),
        )
    )
    return v.select(
        F.lit("EVT").alias("ledger_id"), "voucher_id", anomalies.alias("anomalies"), decoys.alias("decoys")
    )


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the order ledger: only its orders that have lines are vouchers."""
    k = F.col("o_orderkey")
    bare = (F.col("o_orderstatus") == "P") & (k % 5 == 0)
    manual = F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED")
    approved = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    sunday = F.dayofweek("o_orderdate") == 1
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    anomalies = F.array_compact(
        F.array(
            F.when(k % 499 == 0, "post_close_entry"),
            F.when(bare & manual, "missing_document_ref"),
            F.when(sunday & manual, "weekend_posting"),
        )
    )
    decoys = F.array_compact(
        F.array(F.when(bare & ~manual, "legit_system_no_document"), F.when(sunday & approved, "legit_saturday_posting"))
    )
    return table(spark, sf_dir, "orders").join(items, "o_orderkey", "left_semi").select(
        F.lit("ORD").alias("ledger_id"), F.concat(F.lit("V"), pad(k, 9)).alias("voucher_id"),
        anomalies.alias("anomalies"), decoys.alias("decoys"),
    )


def both_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_truth(spark, sf_dir).unionByName(order_truth(spark, sf_dir))
