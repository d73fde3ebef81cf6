import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.schema import LINE, LINE_COLUMNS  # noqa: E402
from ledgerloom.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


class Lines:
    """Collects two-line vouchers for several ledgers and turns them into one frame."""

    def __init__(self):
        self.rows = []

    def add(self, ledger, voucher, amount=10_000_000, date="2024-06-12", posted="11:30", debit="5900", credit="2000", **more):
        day = dt.date.fromisoformat(date)
        at = more.pop("posted_at", dt.datetime.combine(day, dt.time.fromisoformat(posted)))
        start = day.year if day.month >= 4 else day.year - 1
        base = {
            "ledger_id": ledger, "voucher_id": voucher, "entity_id": "ACME-IN",
            "fiscal_year": f"FY{start}-{(start + 1) % 100:02d}", "period": (day.month - 4) % 12 + 1, "voucher_date": day,
            "posted_at": at, "time_fidelity": "date_and_time", "voucher_type": "journal", "account_group": "expense",
            "currency": "INR", "created_by": "dshah", "approved_by": "iyer.cfo", "document_ref": "JV/24-25/0001",
            "narration": "Test entry", "cost_centre": None, "is_manual": True, "is_post_close": False,
        } | more
        for n, (code, dr, cr) in enumerate([(debit, amount, 0), (credit, 0, amount)], start=1):
            row = base | {
                "line_id": f"{voucher}-{n:02d}", "line_number": n, "account_code": code, "account_name": f"Account {code}",
                "debit_paise": dr, "credit_paise": cr, "source_row": len(self.rows) + 2,
            }
            self.rows.append(tuple(row[c] for c in LINE_COLUMNS))
        return self

    def frame(self, spark):
        return spark.createDataFrame(self.rows, LINE)


@pytest.fixture
def book():
    return Lines()
