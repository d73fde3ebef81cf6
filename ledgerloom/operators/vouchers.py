"""Lines to vouchers, the frequency tables behind the signals, and per-ledger statistics.

Every table is keyed by ``ledger_id``. All group-bys but the voucher view combine map-side; the
voucher view is the only full shuffle of the lines on the voucher key.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import KEY, LEDGER, Thresholds, threshold_columns
from ledgerloom.functions import dates
from ledgerloom.functions.text import present
from ledgerloom.operators.scale import ranked, salted_join, stage


def file_order() -> Column:
    """Where a line stands in its file."""
    return F.coalesce(F.col("source_row"), F.col("line_number").cast("bigint"))


def first_seen(column: str) -> Column:
    """First non-null value of a voucher in file order (a voucher's rows have distinct places)."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), file_order())).alias(column)


def accounts_where(condition: Column) -> Column:
    return F.sort_array(F.collect_set(F.when(condition, F.col("account_code"))))


def set_key(*parts: Column) -> Column:
    """128 bits of a hash of the parts written out: array bounds and nulls count, so [a, b] [c] and [a] [b, c] differ."""
    named = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return F.unhex(F.substring(F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256), 1, 32))


def voucher_view(lines: DataFrame) -> DataFrame:
    """One row per voucher. Sets of accounts are sorted arrays, so equality is stable.

    Lines are dealt by voucher before they are grouped. A group-by that combines first would have to sort
    every map task's lines by voucher (nearly all are new to it), and a task's split of a well packed
    table is larger than its memory, so it would spill all of them.
    """
    firsts = ["voucher_date", "posted_at", "document_ref", "approved_by", "created_by", "voucher_type", "narration"]
    used = [
        *KEY, "source_row", "line_number", "account_code", "account_name", "debit_paise", "credit_paise",
        "is_manual", "is_post_close", *firsts,
    ]
    grouped = lines.select(*used).repartition(*KEY).groupBy(*KEY).agg(
        F.sum("debit_paise").alias("amount_paise"),
        accounts_where(F.col("debit_paise") > 0).alias("debit_accounts"),
        accounts_where(F.col("credit_paise") > 0).alias("credit_accounts"),
        F.sort_array(F.collect_set("account_name")).alias("account_names"),
        F.count("document_ref").alias("evidence_lines"),
        F.count("line_number").alias("line_count"),
        F.max("is_manual").alias("is_manual"),
        F.max("is_post_close").alias("is_post_close"),
        F.coalesce(F.max(dates.has_clock(F.col("posted_at"))), F.lit(False)).alias("clocked"),
        F.count("posted_at").alias("posted_lines"),
        *[first_seen(c) for c in firsts],
    )
    sides = [F.col("debit_accounts"), F.col("credit_accounts")]
    shape = [F.col("created_by"), *sides]
    return grouped.withColumns({
        "accounts": F.sort_array(F.array_union(*sides)),
        "primary_account": F.coalesce(F.try_element_at("debit_accounts", F.lit(1)), F.lit("")),
        "shape": set_key(*shape),
    })


def time_fidelity(posted: Column, clocked: Column) -> Column:
    """What the posting times are worth, from how many there are and whether any has a clock."""
    return F.when(posted == 0, "unknown").when(clocked, "date_and_time").otherwise("date_only")


def ledger_times(vouchers: DataFrame) -> DataFrame:
    """Per ledger: voucher count, time fidelity and the year end of the modal fiscal year."""
    per_year = vouchers.groupBy(
        LEDGER, dates.fiscal_start_year(F.col("voucher_date")).alias("fy")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("posted_lines").alias("posted"),
        F.max("clocked").alias("clocked"),
    )
    modal = F.min_by("fy", F.when(F.col("fy").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("fy"))))
    return per_year.groupBy(LEDGER).agg(
        F.sum("n").alias("n_vouchers"),
        time_fidelity(F.sum("posted"), F.max("clocked")).alias("fidelity"),
        dates.closing_day(modal).alias("year_end"),
    )


def distinct_sides(lines: DataFrame, side: str = "debit_paise") -> DataFrame:
    """Each account a voucher touches on one side, once, however many lines touch it."""
    return lines.where(F.col(side) > 0).select(*KEY, "account_code").distinct()


def line_properties(lines: DataFrame) -> DataFrame:
    """What a line says of itself: its amount, signed amount (debits positive) and whether it names a document."""
    debit, credit = F.col("debit_paise"), F.col("credit_paise")
    return lines.select(
        LEDGER, "line_id", F.greatest(debit, credit).alias("amount_paise"), (debit - credit).alias("signed_paise"),
        present(F.col("document_ref")).alias("has_evidence"),
    )


def account_pairs(vouchers: DataFrame) -> DataFrame:
    """Each distinct (debit, credit) account pair a voucher makes, in that direction."""
    return (
        vouchers.select(*KEY, F.explode("debit_accounts").alias("debit_account"), "credit_accounts")
        .select(*KEY, "debit_account", F.explode("credit_accounts").alias("credit_account"))
    )


PAIR = [LEDGER, "debit_account", "credit_account"]


#: A shape is a preparer with a set of debit and a set of credit accounts. Joins and
#: group-bys use its 128-bit key, a fixed-width column, not the arrays.
SHAPE = [LEDGER, "shape"]
SHAPE_PARTS = ["created_by", "debit_accounts", "credit_accounts"]


def posting_shapes(vouchers: DataFrame) -> DataFrame:
    """Distinct (preparer, debit accounts, credit accounts) with the vouchers that share them.

    A book repeats few shapes over many vouchers, so pairings and preparer habits are worked
    out once per shape and joined back, not once per voucher.
    """
    return vouchers.groupBy(*SHAPE, *SHAPE_PARTS).agg(F.count(F.lit(1)).alias("shape_vouchers"))


def shape_pairs(shapes: DataFrame) -> DataFrame:
    return shapes.withColumn("debit_account", F.explode("debit_accounts")).withColumn(
        "credit_account", F.explode("credit_accounts")
    )


def pair_counts(shapes: DataFrame) -> DataFrame:
    """Vouchers per directional (debit, credit) pair, and the shapes that make it."""
    return shape_pairs(shapes).groupBy(*PAIR).agg(
        F.sum("shape_vouchers").alias("times_seen"), F.count(F.lit(1)).alias("pair_shapes")
    )


def preparer_account_counts(lines: DataFrame) -> DataFrame:
    """Lines per (preparer, account), with the first row each pair was seen on."""
    return lines.groupBy(LEDGER, "created_by", "account_code").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(F.struct(file_order().alias("row"), F.col("line_id"))).alias("first_seen"),
    )


def account_amount_counts(lines: DataFrame) -> DataFrame:
    """Debit lines per (account, exact amount)."""
    return (
        lines.where(F.col("debit_paise") > 0)
        .groupBy(LEDGER, "account_code", F.col("debit_paise").alias("amount_paise"))
        .agg(F.count(F.lit(1)).alias("times_seen"))
    )


def account_owner(preparer_counts: DataFrame) -> DataFrame:
    """Per account: total lines, and the preparer with the largest share (first seen on a tie)."""
    best = F.min_by("created_by", F.struct((-F.col("entries")).alias("n"), F.col("first_seen")))
    return (
        preparer_counts.groupBy(LEDGER, "account_code")
        .agg(F.sum("entries").alias("total"), best.alias("owner"), F.max("entries").alias("most"))
        .withColumn("owner_share", F.col("most") / F.col("total"))
        .drop("most")
    )


def with_rare_ceiling(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per ledger: the rare-pair ceiling and whether rarity still tells vouchers apart."""
    ceiling = F.greatest(
        F.col("t_rare_pair_max_count"),
        F.bround(F.col("n_vouchers") * F.col("t_rare_pair_max_share")).cast("bigint"),
    )
    stats = stats.withColumn("rare_ceiling", ceiling)
    # Pairs are first counted per number of times seen: a short table even for a huge ledger.
    spread = pairs.groupBy(LEDGER, "times_seen").agg(F.count(F.lit(1)).alias("kinds"))
    rarity = (
        spread.join(stats.select(LEDGER, "rare_ceiling"), LEDGER)
        .groupBy(LEDGER)
        .agg(
            F.sum("kinds").alias("pair_kinds"),
            F.coalesce(F.sum(F.when(F.col("times_seen") <= F.col("rare_ceiling"), F.col("kinds"))), F.lit(0)).alias("rare_kinds"),
        )
    )
    share = F.col("rare_kinds") / F.col("pair_kinds")
    return stats.join(rarity, LEDGER, "left").withColumn(
        "rare_abstains",
        F.coalesce(share > 1 - F.col("t_rare_pair_max_flag_share"), F.lit(True)),
    )


class LedgerFrames:
    """The prepared ledger(s): lazily built frames shared by every signal.

    ``overrides`` is an optional threshold table keyed by ``ledger_id``.
    """

    def __init__(
        self,
        lines: DataFrame,
        thresholds: Thresholds | None = None,
        overrides: DataFrame | None = None,
    ) -> None:
        self.lines = lines
        self.thresholds = thresholds or Thresholds()
        self.overrides = overrides
        self._facts: dict[tuple[str, ...], DataFrame] = {}
        self._contexts: dict[tuple[str, ...], DataFrame] = {}

    @cached_property
    def vouchers(self) -> DataFrame:
        return stage(voucher_view(self.lines))

    @cached_property
    def shapes(self) -> DataFrame:
        return stage(posting_shapes(self.vouchers))

    @cached_property
    def pair_counts(self) -> DataFrame:
        return stage(pair_counts(self.shapes))

    @cached_property
    def preparer_counts(self) -> DataFrame:
        return stage(preparer_account_counts(self.lines))

    @cached_property
    def account_amounts(self) -> DataFrame:
        return account_amount_counts(self.lines)

    @cached_property
    def account_owner(self) -> DataFrame:
        return account_owner(self.preparer_counts)

    @cached_property
    def times(self) -> DataFrame:
        """One row per ledger: voucher count, fidelity, year end and thresholds."""
        times = ledger_times(self.vouchers)
        if self.overrides is not None:
            times = times.join(self.overrides, LEDGER, "left")
        columns = threshold_columns(self.thresholds, self.overrides is not None)
        return stage(times.select(LEDGER, "n_vouchers", "fidelity", "year_end", *columns))

    @cached_property
    def stats(self) -> DataFrame:
        """``times`` with the rare-pair ceiling and whether rarity still says anything."""
        return with_rare_ceiling(self.times, self.pair_counts)

    @cached_property
    def shape_rarity(self) -> DataFrame:
        """Per shape: its rarest pair, ties to the first pair in account order."""
        seen = salted_join(
            shape_pairs(self.shapes).select(*SHAPE, "debit_account", "credit_account"), self.pair_counts, PAIR,
            weight="pair_shapes", salt_by=SHAPE, how="inner",
        )
        spot = F.min(F.struct("times_seen", "debit_account", "credit_account"))
        return seen.groupBy(*SHAPE).agg(spot.alias("rarest"))

    @cached_property
    def shape_account_use(self) -> DataFrame:
        """Per (shape, account): the account's owner and total, and the preparer's own lines."""
        every = F.array_union("debit_accounts", "credit_accounts")
        touched = self.shapes.select(*SHAPE, "created_by", F.explode(every).alias("account_code"))
        per_account = touched.groupBy(LEDGER, "account_code").agg(F.count(F.lit(1)).alias("account_shapes"))
        owners = (self.account_owner.join(per_account, [LEDGER, "account_code"]))
        own = self.preparer_counts.select(LEDGER, "created_by", "account_code", "entries")
        per_preparer = touched.groupBy(LEDGER, "created_by", "account_code").agg(
            F.count(F.lit(1)).alias("preparer_shapes")
        )
        own = own.join(per_preparer, [LEDGER, "created_by", "account_code"])
        mine = salted_join(
            touched, own, [LEDGER, "created_by", "account_code"],
            weight="preparer_shapes", salt_by=SHAPE, sizes=per_preparer,
        )
        return (
            salted_join(
                mine, owners, [LEDGER, "account_code"], weight="account_shapes", salt_by=SHAPE, sizes=per_account
            )
            .withColumn("entries", F.coalesce(F.col("entries"), F.lit(0)))
            .select(*SHAPE, "created_by", "account_code", "entries", "total", "owner", "owner_share")
        )

    @cached_property
    def shape_preparer(self) -> DataFrame:
        """Per shape: how familiar the preparer is, and the first account they are a stranger to."""
        use = salted_join(
            self.shape_account_use,
            self.times.select(LEDGER, "n_vouchers", *[c for c in self.times.columns if "preparer" in c or "owner" in c]),
            [LEDGER], weight="n_vouchers", salt_by=SHAPE[1:], how="inner",
        )
        few = F.greatest(
            F.lit(1.0),
            F.least(
                F.col("t_unfamiliar_preparer_max_entries").cast("double"),
                F.col("t_unfamiliar_preparer_max_share") * F.col("total"),
            ),
        )
        stranger = (
            (F.col("total") >= F.col("t_unfamiliar_preparer_min_account_entries"))
            & (F.col("owner_share") >= F.col("t_dominant_owner_min_share"))
            & (F.col("owner") != F.col("created_by"))
            & (F.col("entries") <= few)
        )
        facts = F.struct("account_code", "owner", "owner_share", "entries", "total")
        return use.groupBy(*SHAPE).agg(
            F.min(F.col("entries") / F.col("total")).alias("familiarity"),
            F.min(F.when(stranger, facts)).alias("stranger"),
        )

    @cached_property
    def account_stats(self) -> tuple[DataFrame, DataFrame]:
        from ledgerloom.operators.statistics import account_amount_stats

        return account_amount_stats(self.vouchers)

    def shape_facts(self, *needs: str) -> DataFrame:
        """Per shape: its ledger's statistics and what ``needs`` asks for."""
        if needs not in self._facts:
            base = self.stats if "pairs" in needs else self.times
            facts = salted_join(
                self.shapes, base, [LEDGER], weight="n_vouchers", salt_by=SHAPE[1:], how="inner", sizes=self.times
            )
            if "pairs" in needs:
                facts = facts.join(self.shape_rarity, SHAPE, "left")
            if "preparer" in needs:
                facts = facts.join(self.shape_preparer, SHAPE, "left")
            if "amounts" in needs:
                first = F.coalesce(F.try_element_at("debit_accounts", F.lit(1)), F.lit(""))
                profile, usual = self.account_stats
                facts = salted_join(
                    facts.withColumn("primary_account", first), usual.withColumnRenamed("n", "account_entries"),
                    [LEDGER, "primary_account"], weight="account_entries", salt_by=SHAPE[1:],
                    sizes=profile.withColumnRenamed("n", "account_entries"),
                ).drop("primary_account")
            self._facts[needs] = stage(facts.drop(*SHAPE_PARTS))
        return self._facts[needs]

    def context(self, *needs: str) -> DataFrame:
        """Vouchers with their ledger's statistics and what ``needs`` asks for.

        ``pairs`` adds the rarest pair, ``preparer`` the preparer's habits, ``amounts`` the
        account's usual amount. All of them are functions of the voucher's shape, so they
        are joined on the (few) shapes and reach the vouchers in one salted join.
        """
        if needs not in self._contexts:
            if needs:
                facts, on, weight, sizes = self.shape_facts(*needs), SHAPE, "shape_vouchers", self.shapes
            else:
                facts, on, weight, sizes = self.times, [LEDGER], "n_vouchers", self.times
            self._contexts[needs] = salted_join(
                self.vouchers, facts, on, weight=weight, salt_by=["voucher_id"], how="inner", sizes=sizes
            )
        return self._contexts[needs]

    def keep_context(self, *needs: str) -> DataFrame:
        """The same, kept for the several branches of a whole review that read it."""
        self._contexts[needs] = stage(self.context(*needs))
        return self._contexts[needs]


def number_lines(lines: DataFrame) -> DataFrame:
    """Line numbers 1..n within a voucher in file order, and ids ``voucher-NN``."""
    numbered = ranked(lines.drop("line_number", "line_id"), KEY, ["source_row"], "line_number")
    return numbered.withColumn("line_number", F.col("line_number").cast("int")).withColumn(
        "line_id", F.format_string("%s-%02d", F.col("voucher_id"), F.col("line_number"))
    )
