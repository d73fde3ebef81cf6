"""Vouchers whose accounts are the same in order, but split differently between debit and credit."""

from pyspark.sql import functions as F

from ledgerloom.config import KEY
from ledgerloom.operators.similar import similar_entries
from ledgerloom.operators.vouchers import LedgerFrames
from ledgerloom.plans.review import EVERYTHING, build_findings


SAME = "same accounts"


def three_legs(book, voucher, debits, credits, preparer="dshah"):
    """One voucher of lines (account, amount); two-line vouchers from the builder are re-used leg by leg."""
    at = len(book.rows)
    for i, code in enumerate([*debits, *credits]):
        side = len(debits) if i < len(debits) else len(credits)
        book.add("L", voucher, amount=12_000_000 // side, debit=code, credit=code, created_by=preparer)
        pair = book.rows[-2:]
        del book.rows[-2:]
        book.rows.append(pair[0] if i < len(debits) else pair[1])
    return book.rows[at:]


def ledger(book):
    three_legs(book, "V1", ["A", "B"], ["C"])
    three_legs(book, "V2", ["A"], ["B", "C"])
    three_legs(book, "V3", ["P", "A"], ["B", "C"], preparer="nobody")
    three_legs(book, "V4", ["A"], ["B", "C"], preparer="P")
    for i in range(8):
        book.add("L", f"N{i}")
    return book


def frame(spark, book):
    """The ledger, with no preparer for V3."""
    return ledger(book).frame(spark).withColumn("created_by", F.when(F.col("voucher_id") != "V3", F.col("created_by")))


def test_every_voucher_has_one_context_row_and_one_finding(spark, book):
    lines = frame(spark, book)
    frames = LedgerFrames(lines)
    context = frames.context(*EVERYTHING)
    assert context.count() == 12 == context.select(*KEY).distinct().count()
    shapes = {r.voucher_id: bytes(r["shape"]) for r in frames.vouchers.select("voucher_id", "shape").collect()}
    assert len({shapes[v] for v in ("V1", "V2", "V3", "V4")}) == 4
    queue = build_findings(lines, use_model=False)
    assert queue.groupBy(*KEY).count().where("count > 1").count() == 0


def test_same_accounts_means_the_same_sides(spark, book):
    frames = LedgerFrames(frame(spark, book))
    vouchers = frames.vouchers
    found = vouchers.select(*KEY).where(F.col("voucher_id").isin("V1", "V2", "V3"))
    out = similar_entries(vouchers, found)
    sides = {r.voucher_id: (tuple(r.debit_accounts), tuple(r.credit_accounts)) for r in vouchers.collect()}
    for r in out.collect():
        same = sides[r.voucher_id] == sides[r.similar_id]
        assert same == (r.basis == SAME)
    assert {(r.voucher_id, r.similar_id) for r in out.where(F.col("basis") == SAME).collect()} >= {("V2", "V4")}
