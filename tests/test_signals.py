"""Every rule fires on its case and stays silent on the look-alike; each case is its own ledger."""

import datetime as dt

import pytest

from ledgerloom.operators.signals import FrameSignal, RowSignal, built_in, run_signals
from ledgerloom.operators.vouchers import LedgerFrames
from tests.conftest import Lines

CASES = {
    # name: (kind, fires)
    "dup_3_days": ("duplicate_entry", True), "dup_monthly": ("duplicate_entry", False),
    "round_once": ("round_amount", True), "round_routine": ("round_amount", False), "round_small": ("round_amount", False),
    "night": ("off_hours_posting", True), "noon": ("off_hours_posting", False), "all_midnight": ("off_hours_posting", False),
    "sunday": ("weekend_posting", True), "saturday": ("weekend_posting", False), "dated_sunday_posted_monday": ("weekend_posting", False),
    "year_end_bare": ("period_end_concentration", True), "year_end_supported": ("period_end_concentration", False),
    "near_limit": ("threshold_adjacent", True), "near_limit_approved": ("threshold_adjacent", False),
    "no_document": ("missing_evidence", True), "no_document_system": ("missing_evidence", False),
    "posted_late": ("post_close_entry", True), "flagged_late": ("post_close_entry", True), "posted_soon": ("post_close_entry", False),
    "odd_pair": ("rare_account_pair", True), "all_pairs_unique": ("rare_account_pair", False),
    "stranger": ("unusual_preparer_account", True), "no_owner": ("unusual_preparer_account", False),
    "outlier": ("amount_outlier", True), "flat_amounts": ("amount_outlier", False),
}


def build() -> Lines:
    b = Lines()
    b.add("dup_3_days", "V1", date="2024-06-10").add("dup_3_days", "V2", date="2024-06-13")
    for m in (4, 5, 6):
        b.add("dup_monthly", f"V{m}", date=f"2024-0{m}-10")
    b.add("round_once", "V1", amount=50_000_000)
    for n in range(4):
        b.add("round_routine", f"V{n}", amount=20_000_000, date=f"2024-0{n + 4}-11")
    b.add("round_small", "V1", amount=1_000_000)
    b.add("night", "V1", posted="02:15").add("noon", "V1", posted="14:15")
    b.add("all_midnight", "V1", posted="00:00").add("all_midnight", "V2", posted="00:00", amount=77)
    b.add("sunday", "V1", date="2024-06-16").add("saturday", "V1", date="2024-06-15")
    b.add("dated_sunday_posted_monday", "V1", date="2024-06-16", posted_at=dt.datetime(2024, 6, 17, 10, 0))
    b.add("year_end_bare", "V1", date="2025-03-31", document_ref=None, approved_by=None)
    b.add("year_end_supported", "V1", date="2025-03-31")
    b.add("near_limit", "V1", amount=4_920_000, approved_by=None).add("near_limit_approved", "V1", amount=4_920_000)
    b.add("no_document", "V1", amount=8_000_000, document_ref=None)
    b.add("no_document_system", "V1", amount=50_000, document_ref=None, is_manual=False)
    b.add("posted_late", "V1", posted_at=dt.datetime(2024, 10, 24, 10, 0)).add("flagged_late", "V1", is_post_close=True)
    b.add("posted_soon", "V1", posted_at=dt.datetime(2024, 6, 14, 10, 0))
    for n in range(60):
        b.add("odd_pair", f"V{n:02d}", debit=f"50{n % 3}", amount=1000 + n)
    b.add("odd_pair", "VX", debit="999", credit="888", amount=5)
    for n in range(40):
        b.add("all_pairs_unique", f"V{n:02d}", debit=f"5{n:03d}", credit=f"2{n:03d}", amount=1000 + n)
    for n in range(40):
        b.add("stranger", f"V{n:02d}", created_by="owner", amount=1000 + n)
    b.add("stranger", "VX", created_by="guest", amount=7)
    for n in range(40):
        b.add("no_owner", f"V{n:02d}", created_by=f"p{n % 5}", amount=1000 + n)
    for n in range(30):
        b.add("outlier", f"V{n:02d}", amount=1000 + n * 10)
        b.add("flat_amounts", f"V{n:02d}", amount=1000)
    b.add("outlier", "VX", amount=900_000_000)
    b.add("flat_amounts", "VX", amount=900_000_000)
    return b


@pytest.fixture(scope="module")
def hits(spark):
    frames = LedgerFrames(build().frame(spark))
    kinds = [k for k in built_in() if k != "ml_anomaly"]
    return run_signals(frames, kinds).collect()


@pytest.mark.parametrize("ledger", list(CASES))
def test_case(hits, ledger):
    kind, fires = CASES[ledger]
    assert any(h.ledger_id == ledger and h.kind == kind for h in hits) == fires


def test_the_later_duplicate_is_flagged_with_its_strength(hits):
    (hit,) = [h for h in hits if h.ledger_id == "dup_3_days" and h.kind == "duplicate_entry"]
    assert hit.voucher_id == "V2" and hit.strength == pytest.approx(1 - 3 / 8)
    assert '"earlier_voucher_id":"V1"' in hit.evidence


def test_every_hit_is_reviewable(hits):
    assert all(0 <= h.strength <= 1 and h.reason.strip() and h.evidence.startswith("{") for h in hits)
    assert len({(h.ledger_id, h.voucher_id, h.kind) for h in hits}) == len(hits)


def test_lean_hits_are_the_same_hits(spark, hits):
    frames = LedgerFrames(build().frame(spark))
    lean = run_signals(frames, [k for k in built_in() if k != "ml_anomaly"], detail=False).collect()
    assert {(h.ledger_id, h.voucher_id, h.kind, h.strength) for h in lean} == {
        (h.ledger_id, h.voucher_id, h.kind, h.strength) for h in hits
    }


def test_a_firm_can_register_its_own_signal(spark, book):
    from pyspark.sql import functions as F

    own = RowSignal(
        "big_entry", lambda: F.col("amount_paise") > 1_000, lambda: F.lit(0.5), lambda: F.lit("Big."),
        lambda: [F.col("amount_paise").alias("amount_paise")],
    )
    frames = LedgerFrames(book.add("L", "V1", amount=500).add("L", "V2", amount=5_000).frame(spark))
    got = run_signals(frames, ["big_entry"], {**built_in(), "big_entry": own}).collect()
    assert [h.voucher_id for h in got] == ["V2"]
    assert isinstance(built_in()["duplicate_entry"], FrameSignal)
