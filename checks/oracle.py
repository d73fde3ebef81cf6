"""The same results in plain SQL for DuckDB, built from shared common table expressions."""

from __future__ import annotations

import re
from dataclasses import asdict

from ledgerloom import config as C
from ledgerloom.operators.statistics import FEATURES
from ledgerloom.plans import evaluation, explain, fixtures, textaudit

CTE: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """Prefix a query with the common table expressions it (indirectly) uses, in order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in CTE:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(CTE[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in order) + "\n" + body


def oracle(name: str, body: str) -> None:
    ORACLE[name] = with_ctes(body)


def inr(p: str) -> str:
    """Indian 2-2-3 grouping without look-ahead."""
    r = f"(abs({p}) // 100)::VARCHAR"
    head = f"reverse(regexp_replace(reverse(left({r}, length({r}) - 3)), '(\\d\\d)', '\\1,', 'g'))"
    grouped = f"CASE WHEN length({r}) > 3 THEN ltrim({head}, ',') || ',' || right({r}, 3) ELSE {r} END"
    return f"(CASE WHEN {p} < 0 THEN '-' ELSE '' END || '₹' || {grouped} || '.' || lpad((abs({p}) % 100)::VARCHAR, 2, '0'))"


def fy(d: str) -> str:
    y = f"year({d} - INTERVAL 3 MONTH)"
    return f"('FY' || {y} || '-' || lpad((({y} + 1) % 100)::VARCHAR, 2, '0'))"


def period(d: str) -> str:
    return f"month({d} - INTERVAL 3 MONTH)"


def dmy(d: str) -> str:
    return f"strftime({d}, '%d-%m-%Y')"


# --- ledgers ------------------------------------------------------------------

_types = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(fixtures.EVENT_TYPES))
_vtypes = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(fixtures.EVENT_VOUCHER_TYPES))
_rungs = " + ".join(f"(user_id >= {f})::INT" for f in [1, 3, 7, 15, 31, 63, 127, 255, 511, 1023])
CTE["evt0"] = f"""
SELECT event_id k, CASE event_type {_types} END ti, event_type, ts + INTERVAL 61 DAY shifted,
  round(value * 100)::BIGINT amount, {_rungs} rung FROM events"""
CTE["evt"] = f"""
SELECT k, ti, amount, 'V' || lpad(k::VARCHAR, 9, '0') voucher_id, shifted::DATE voucher_date,
  shifted + CASE WHEN k % 250 = 7 THEN INTERVAL 60 DAY ELSE INTERVAL 0 DAY END posted_at,
  CASE ti {_vtypes} END voucher_type, '5' || lpad(ti::VARCHAR, 3, '0') debit_account, '2' || lpad(rung::VARCHAR, 3, '0') credit_account,
  'P' || CASE WHEN k % 200 = 11 THEN (ti + 1 + k % 4) % 5 ELSE ti END created_by,
  CASE WHEN amount >= 5000 OR k % 3 = 0 THEN 'A' || (k % 3) END approved_by,
  CASE WHEN k % 20 <> 3 THEN 'D' || k END document_ref, CASE WHEN k % 9 <> 4 THEN event_type END narration,
  ti IN (1, 2) is_manual, k % 997 = 5 is_post_close FROM evt0"""
CTE["evt_all"] = f"""
SELECT 'EVT' ledger_id, voucher_id || '-0' || n line_id, voucher_id, n line_number, 'EVT-IN' entity_id, {fy('voucher_date')} fiscal_year,
  {period('voucher_date')} period, voucher_date, posted_at, 'date_and_time' time_fidelity, voucher_type,
  CASE n WHEN 1 THEN debit_account ELSE credit_account END account_code,
  CASE n WHEN 1 THEN 'Expense ' || debit_account ELSE 'Creditor ' || credit_account END account_name,
  CASE n WHEN 1 THEN 'expense' ELSE 'liability' END account_group,
  CASE n WHEN 1 THEN amount ELSE 0 END debit_paise, CASE n WHEN 2 THEN amount ELSE 0 END credit_paise, 'INR' currency,
  created_by, approved_by, document_ref, narration, NULL::VARCHAR cost_centre, is_manual, is_post_close, k * 2 + n + 1 source_row
FROM evt, (VALUES (1), (2)) s(n)"""
CTE["ord_items"] = """
SELECT l_orderkey o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) line_number,
  '5' || lpad((l_suppkey % 25)::VARCHAR, 3, '0') account_code, round(l_extendedprice * 100)::BIGINT debit_paise, 0::BIGINT credit_paise FROM lineitem"""
CTE["ord_sides"] = """
SELECT * FROM ord_items UNION ALL
SELECT o_orderkey, count(*) + 1, NULL, 0, sum(debit_paise)::BIGINT FROM ord_items GROUP BY 1"""
CTE["ord_all"] = f"""
SELECT 'ORD' ledger_id, v || '-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n line_id, v voucher_id, n line_number, 'ORD-IN' entity_id,
  {fy('d')} fiscal_year, {period('d')} period, d voucher_date, (d + (k % 4)::INT)::TIMESTAMP posted_at, 'date_only' time_fidelity, 'purchase' voucher_type, code account_code,
  CASE WHEN debit_paise > 0 THEN 'Expense ' ELSE 'Creditor ' END || code account_name, CASE WHEN debit_paise > 0 THEN 'expense' ELSE 'liability' END account_group,
  debit_paise, credit_paise, 'INR' currency, 'P' || (o_custkey % 6) created_by,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' || (k % 3) END approved_by,
  CASE WHEN NOT (o_orderstatus = 'P' AND k % 5 = 0) AND n % 3 <> 0 THEN 'D' || k || '-' || n END document_ref,
  'Order ' || k narration, 'CC' || (o_custkey % 4) cost_centre, o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') is_manual, k % 499 = 0 is_post_close,
  k * 1000 + n source_row
FROM (SELECT s.*, o.*, o.o_orderkey k, s.line_number n, o_orderdate::DATE d, 'V' || lpad(o.o_orderkey::VARCHAR, 9, '0') v,
  coalesce(account_code, '2' || lpad((o_custkey % 10)::VARCHAR, 3, '0')) code
  FROM ord_sides s JOIN orders o ON o.o_orderkey = s.o_orderkey)"""
CTE["lines"] = "SELECT * FROM evt_all WHERE debit_paise + credit_paise > 0 UNION ALL SELECT * FROM ord_all"


def first(c: str) -> str:
    return f"arg_min({c}, source_row) FILTER ({c} IS NOT NULL) {c}"


CTE["vch0"] = f"""
SELECT ledger_id, voucher_id, sum(debit_paise)::BIGINT amount_paise,
  coalesce(list_sort(list_distinct(list(account_code) FILTER (debit_paise > 0))), []) debit_accounts,
  coalesce(list_sort(list_distinct(list(account_code) FILTER (credit_paise > 0))), []) credit_accounts,
  list_sort(list_distinct(list(account_name))) account_names, count(document_ref) evidence_lines, count(*) line_count,
  bool_or(is_manual) is_manual, bool_or(is_post_close) is_post_close, count(posted_at) posted_lines,
  coalesce(bool_or(hour(posted_at) <> 0 OR minute(posted_at) <> 0), FALSE) clocked,
  {", ".join(first(c) for c in ["voucher_date", "posted_at", "document_ref", "approved_by", "created_by", "voucher_type", "narration"])}
FROM lines GROUP BY 1, 2"""
CTE["vch"] = """
SELECT *, list_sort(list_distinct(list_concat(debit_accounts, credit_accounts))) accounts, coalesce(debit_accounts[1], '') primary_account FROM vch0"""
CTE["cfg"] = " UNION ALL ".join(
    f"SELECT '{ledger}' ledger_id, " + ", ".join(f"{v}::{'BIGINT' if isinstance(v, int) else 'DOUBLE'} t_{k}" for k, v in asdict(t).items())
    for ledger, t in fixtures.LEDGER_THRESHOLDS.items()
)
CTE["fyc"] = "SELECT ledger_id, year(voucher_date - INTERVAL 3 MONTH) y, count(*) n FROM vch GROUP BY 1, 2"
CTE["fym"] = "SELECT ledger_id, y FROM fyc QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY n DESC, y) = 1"
CTE["ltime"] = """
SELECT ledger_id, count(*) n_vouchers, CASE WHEN sum(posted_lines) = 0 THEN 'unknown' WHEN bool_or(clocked) THEN 'date_and_time' ELSE 'date_only' END fidelity,
  any_value(make_date(y + 1, 3, 31)) year_end FROM vch JOIN fym USING (ledger_id) GROUP BY 1"""
CTE["ctx"] = "SELECT * FROM vch JOIN ltime USING (ledger_id) JOIN cfg USING (ledger_id)"
CTE["prs"] = "SELECT ledger_id, voucher_id, debit_account, unnest(credit_accounts) credit_account FROM (SELECT ledger_id, voucher_id, credit_accounts, unnest(debit_accounts) debit_account FROM vch)"
CTE["prc"] = "SELECT ledger_id, debit_account, credit_account, count(*) times_seen FROM prs GROUP BY 1, 2, 3"
CTE["rarest"] = """
SELECT ledger_id, voucher_id, debit_account, credit_account, times_seen FROM prs JOIN prc USING (ledger_id, debit_account, credit_account)
QUALIFY row_number() OVER (PARTITION BY ledger_id, voucher_id ORDER BY times_seen, debit_account, credit_account) = 1"""
CTE["ceil0"] = "SELECT ledger_id, n_vouchers, greatest(t_rare_pair_max_count, round_even(n_vouchers * t_rare_pair_max_share, 0)::BIGINT) rare_ceiling, t_rare_pair_max_flag_share FROM ltime JOIN cfg USING (ledger_id)"
CTE["ceilings"] = """
SELECT ledger_id, any_value(rare_ceiling) rare_ceiling, count(*) FILTER (times_seen <= rare_ceiling) / count(*) > 1 - any_value(t_rare_pair_max_flag_share) abstains
FROM prc JOIN ceil0 USING (ledger_id) GROUP BY 1"""
CTE["pac"] = "SELECT ledger_id, created_by, account_code, count(*) entries, min(source_row) seen FROM lines GROUP BY 1, 2, 3"
CTE["own"] = """
SELECT ledger_id, account_code, sum(entries)::BIGINT total, arg_min(created_by, (-entries, seen)) AS owner, max(entries) / sum(entries) owner_share FROM pac GROUP BY 1, 2"""
CTE["use"] = """
SELECT x.*, coalesce(p.entries, 0) entries, o.total, o.owner, o.owner_share
FROM (SELECT ledger_id, voucher_id, created_by, unnest(accounts) account_code FROM vch) x
LEFT JOIN pac p USING (ledger_id, created_by, account_code) LEFT JOIN own o USING (ledger_id, account_code)"""
CTE["aac"] = "SELECT ledger_id, account_code, debit_paise amount_paise, count(*) times_seen FROM lines WHERE debit_paise > 0 GROUP BY 1, 2, 3"
CTE["prof"] = """
SELECT ledger_id, primary_account, count(*) n, quantile_cont(amount_paise::DOUBLE, 0.5) median_paise, quantile_cont(amount_paise::DOUBLE, 0.1) low_paise,
  quantile_cont(amount_paise::DOUBLE, 0.9) high_paise, quantile_cont(log10(greatest(amount_paise, 1)), 0.5) log_median FROM vch GROUP BY 1, 2"""
CTE["mads"] = """
SELECT ledger_id, primary_account, quantile_cont(abs(log10(greatest(amount_paise, 1)) - log_median), 0.5) mad FROM vch JOIN prof USING (ledger_id, primary_account) GROUP BY 1, 2"""
CTE["devs"] = """
SELECT v.*, p.n, p.median_paise, p.low_paise, p.high_paise,
  coalesce(abs(log10(greatest(amount_paise, 1)) - log_median) / nullif(mad / 0.6745, 0), 0) deviation
FROM vch v JOIN prof p USING (ledger_id, primary_account) JOIN mads USING (ledger_id, primary_account)"""

# --- signals ---------------------------------------------------------------------

CTE["dup"] = """
SELECT * FROM (SELECT ctx.*, lag(voucher_date) OVER w earlier_date, lag(voucher_id) OVER w earlier_id,
  date_diff('day', lag(voucher_date) OVER w, voucher_date) gap FROM ctx WINDOW w AS (PARTITION BY ledger_id, amount_paise, accounts ORDER BY voucher_date, voucher_id))
WHERE gap BETWEEN 0 AND t_duplicate_window_days"""
CTE["rnd"] = """
SELECT x.*, coalesce((SELECT max(a.times_seen) FROM aac a WHERE a.ledger_id = x.ledger_id AND a.amount_paise = x.amount_paise AND list_contains(x.accounts, a.account_code)), 0) seen
FROM ctx x WHERE amount_paise >= t_round_min_paise AND amount_paise % t_round_step_paise = 0"""
CTE["strangers"] = """
SELECT u.*, row_number() OVER (PARTITION BY ledger_id, voucher_id ORDER BY account_code) nth FROM use u JOIN cfg USING (ledger_id)
WHERE total >= t_unfamiliar_preparer_min_account_entries AND owner_share >= t_dominant_owner_min_share AND owner <> created_by
AND entries <= greatest(1, least(t_unfamiliar_preparer_max_entries, t_unfamiliar_preparer_max_share * total))"""
CTE["wknd"] = """
SELECT *, CASE WHEN timed THEN posted_at::DATE ELSE voucher_date END day_used, CASE WHEN timed THEN 'posted' ELSE 'dated' END basis
FROM (SELECT *, fidelity = 'date_and_time' AND posted_at IS NOT NULL timed FROM ctx)"""
CTE["lagd"] = "SELECT *, date_diff('day', voucher_date, posted_at::DATE) lag_days FROM ctx"

_missing = "list_filter([CASE WHEN document_ref IS NULL THEN 'supporting document' END, CASE WHEN approved_by IS NULL THEN 'approval' END], lambda x: x IS NOT NULL)"
SIGNALS = {
    "duplicate_entry": (
        "FROM dup", "1 - gap / (t_duplicate_window_days + 1)",
        f"'Same amount ' || {inr('amount_paise')} || ' posted to the same accounts ' || gap || ' day(s) after ' || earlier_id || '.'",
        {"days_apart": "gap", "earlier_voucher_id": "earlier_id"},
    ),
    "round_amount": (
        "FROM rnd WHERE seen < t_routine_repeat_count", "0.7",
        f"{inr('amount_paise')} || ' is an exactly round amount and this figure does not recur on these accounts (seen ' || seen || ' time(s)).'",
        {"times_seen_on_account": "seen", "round_step_paise": "t_round_step_paise"},
    ),
    "off_hours_posting": (
        "FROM ctx WHERE fidelity = 'date_and_time' AND (hour(posted_at) >= t_off_hours_start OR hour(posted_at) < t_off_hours_end)", "0.8",
        "'Entered at ' || strftime(posted_at, '%H:%M') || ', outside the working day (' || lpad(t_off_hours_end::VARCHAR, 2, '0') || ':00–' || lpad(t_off_hours_start::VARCHAR, 2, '0') || ':00).'",
        {"hour": "hour(posted_at)", "posted_at": "posted_at"},
    ),
    "weekend_posting": (
        "FROM wknd WHERE dayofweek(day_used) = 0", "0.6",
        f"'Entry ' || basis || ' on Sunday ' || {dmy('day_used')} || ', when the office is closed.'",
        {"basis": "basis", "date": "day_used"},
    ),
    "period_end_concentration": (
        f"FROM ctx WHERE date_diff('day', voucher_date, year_end) BETWEEN 0 AND t_period_end_window_days AND is_manual AND len({_missing}) > 0", "0.85",
        f"'Manual entry dated ' || {dmy('voucher_date')} || ', at the year end, with no ' || array_to_string({_missing}, ' and no ') || '.'",
        {"days_before_close": "date_diff('day', voucher_date, year_end)", "year_end": "year_end"},
    ),
    "rare_account_pair": (
        "FROM ctx JOIN rarest USING (ledger_id, voucher_id) JOIN ceilings USING (ledger_id) WHERE NOT abstains AND times_seen <= rare_ceiling", "0.75",
        "'Accounts ' || debit_account || ' and ' || credit_account || ' appear together only ' || times_seen || ' time(s) in a ledger of ' || format('{:,}', n_vouchers) || ' vouchers.'",
        {"debit_account": "debit_account", "credit_account": "credit_account", "times_seen": "times_seen", "rare_below": "rare_ceiling"},
    ),
    "threshold_adjacent": (
        "FROM ctx WHERE amount_paise >= t_approval_limit_paise - t_threshold_band_paise AND amount_paise < t_approval_limit_paise AND approved_by IS NULL", "0.8",
        f"{inr('amount_paise')} || ' falls ' || {inr('(t_approval_limit_paise - amount_paise)')} || ' below the ' || {inr('t_approval_limit_paise')} || ' approval limit and carries no approver.'",
        {"shortfall_paise": "t_approval_limit_paise - amount_paise", "approval_limit_paise": "t_approval_limit_paise"},
    ),
    "missing_evidence": (
        "FROM ctx WHERE is_manual AND amount_paise >= t_materiality_paise AND evidence_lines = 0", "0.9",
        f"'Manual entry of ' || {inr('amount_paise')} || ' with no supporting document reference on any of its ' || line_count || ' lines.'",
        {"amount_paise": "amount_paise", "lines": "line_count"},
    ),
    "unusual_preparer_account": (
        "FROM strangers WHERE nth = 1", "0.7",
        "'Account ' || account_code || ' is normally handled by ' || owner || ' (' || round(owner_share * 100)::INT || '% of its ' || total || ' entries), but this voucher was posted by ' || created_by || ', who has touched it ' || entries || ' time(s).'",
        {"account_code": "account_code", "regular_owner": "owner", "entries_by_this_preparer": "entries"},
    ),
    "post_close_entry": (
        "FROM lagd WHERE is_post_close OR lag_days > t_post_close_lag_days", "0.85",
        f"CASE WHEN lag_days > t_post_close_lag_days THEN 'Dated ' || {dmy('voucher_date')} || ' but entered ' || lag_days || ' days later.' ELSE 'Marked as posted after the books were closed (' || {dmy('voucher_date')} || ').' END",
        {"lag_days": "lag_days", "source_flag": "is_post_close"},
    ),
    "amount_outlier": (
        "FROM devs JOIN cfg USING (ledger_id) WHERE deviation >= t_amount_deviation_threshold", "least(1, deviation / (t_amount_deviation_threshold * 3))",
        f"{inr('amount_paise')} || ' is ' || printf('%.1f', deviation) || ' robust deviations from the usual amount on account ' || primary_account || '.'",
        {"account_code": "primary_account", "account_median_paise": "round_even(median_paise, 0)::BIGINT", "entries_compared": "n"},
    ),
}
CTE["hits"] = " UNION ALL ".join(
    f"SELECT ledger_id, voucher_id, '{kind}' kind, ({strength})::DOUBLE strength, {reason} reason {body}"
    for kind, (body, strength, reason, _f) in SIGNALS.items()
)

# --- evidence and fusion --------------------------------------------------------------

CTE["evd"] = """
SELECT ledger_id, voucher_id, amount_paise, voucher_date, evidence_lines > 0 has_document, trim(coalesce(approved_by, '')) <> '' has_approval,
  amount_paise >= t_approval_limit_paise approval_expected, trim(coalesce(narration, '')) <> '' has_narration,
  round(evidence_lines / line_count, 4) document_coverage, line_count,
  round((evidence_lines / line_count * 0.55::DOUBLE + CASE WHEN trim(coalesce(narration, '')) <> '' THEN 0.15::DOUBLE ELSE 0 END
    + CASE WHEN amount_paise >= t_approval_limit_paise AND approved_by IS NOT NULL THEN 0.30::DOUBLE ELSE 0 END)
    / (0.7::DOUBLE + CASE WHEN amount_paise >= t_approval_limit_paise THEN 0.30::DOUBLE ELSE 0 END), 4) completeness FROM ctx"""
CTE["evm"] = """
SELECT *, list_filter([CASE WHEN NOT has_document THEN 'supporting document' END, CASE WHEN approval_expected AND NOT has_approval THEN 'approval' END,
  CASE WHEN NOT has_narration THEN 'narration' END], lambda x: x IS NOT NULL) missing FROM evd"""
CTE["wts"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in C.SIGNAL_WEIGHTS.items()) + ") w(kind, weight)"
CTE["whits"] = "SELECT ledger_id, voucher_id, kind, max(weight * strength) c FROM hits JOIN wts USING (kind) GROUP BY 1, 2, 3"
CTE["bases"] = "SELECT ledger_id, voucher_id, 1 - product(1 - least(c, 1)) base, list_sort(list(kind)) kinds FROM whits GROUP BY 1, 2"
CTE["fnd"] = """
SELECT ledger_id, voucher_id, base, kinds, p, round(p, 6) priority, CASE WHEN round(p, 12) >= 0.7 THEN 'high' WHEN round(p, 12) >= 0.4 THEN 'medium' ELSE 'low' END band,
  uplift, amount_paise, voucher_date, line_count, completeness, has_document, missing
FROM (SELECT *, base + 0.45::DOUBLE * (1 - completeness) * (1 - base) p, 0.45::DOUBLE * (1 - completeness) * (1 - base) uplift FROM bases JOIN evm USING (ledger_id, voucher_id))"""
CTE["que"] = "SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY priority DESC, voucher_id) AS rank FROM fnd"
CTE["contrib"] = """
SELECT ledger_id, voucher_id, kind, c, CASE kind WHEN 'amount_outlier' THEN 'y' ELSE 'a' || kind END tie FROM whits JOIN fnd USING (ledger_id, voucher_id)
UNION ALL SELECT ledger_id, voucher_id, 'evidence_gap', round(uplift::DECIMAL(20, 10), 4)::DOUBLE, 'z' FROM fnd WHERE uplift > 0"""
CTE["heads0"] = """
SELECT ledger_id, voucher_id, kind, c, row_number() OVER (PARTITION BY ledger_id, voucher_id ORDER BY c DESC, kind) nth FROM whits JOIN fnd USING (ledger_id, voucher_id)"""
CTE["heads"] = "SELECT ledger_id, voucher_id, list(kind ORDER BY nth) concerns FROM heads0 WHERE c >= 0.05 OR nth = 1 GROUP BY 1, 2"
CTE["trail0"] = """
SELECT ledger_id engagement_id, voucher_id, substr(voucher_id, 2, 9)::BIGINT k, unnest(CASE WHEN substr(voucher_id, 2, 9)::BIGINT % 7 = 0 THEN [0, 1] ELSE [0] END) turn
FROM fnd WHERE ledger_id = 'EVT' OR substr(voucher_id, 2, 9)::BIGINT % 3 <> 0"""
CTE["trail"] = """
SELECT engagement_id, voucher_id, k * 2 + turn + 1 sequence, CASE (k + turn) % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'investigate' ELSE 'adjust' END action,
  'R' || (k % 3) reviewer, CASE WHEN (k + turn) % 4 = 1 THEN 'checked to the invoice' END note, TIMESTAMP '2024-06-01 09:00:00' + to_minutes((k * 2 + turn)::BIGINT) decided_at FROM trail0"""
CTE["now_at"] = "SELECT * FROM trail QUALIFY row_number() OVER (PARTITION BY engagement_id, voucher_id ORDER BY sequence DESC) = 1"
CTE["fdec"] = """
SELECT f.*, d.action, d.reviewer, d.note, d.sequence, d.decided_at, coalesce(d.action, 'not yet reviewed') status
FROM fnd f LEFT JOIN now_at d ON d.engagement_id = f.ledger_id AND d.voucher_id = f.voucher_id"""
CTE["truth"] = """
SELECT 'EVT' ledger_id, voucher_id,
  list_filter([CASE WHEN k % 200 = 11 THEN 'unusual_preparer_account' END, CASE WHEN k % 250 = 7 OR k % 997 = 5 THEN 'post_close_entry' END,
    CASE WHEN k % 20 = 3 AND ti IN (1, 2) AND amount >= 2500 THEN 'missing_document_ref' END,
    CASE WHEN amount >= 4500 AND amount < 5000 AND k % 3 <> 0 THEN 'threshold_adjacent' END], lambda x: x IS NOT NULL) anomalies,
  list_filter([CASE WHEN amount >= 4500 AND amount < 5000 AND k % 3 = 0 THEN 'legit_below_threshold' END,
    CASE WHEN k % 20 = 3 AND ti NOT IN (1, 2) THEN 'legit_system_no_document' END], lambda x: x IS NOT NULL) decoys
FROM evt WHERE amount > 0
UNION ALL SELECT 'ORD', 'V' || lpad(o_orderkey::VARCHAR, 9, '0'),
  list_filter([CASE WHEN o_orderkey % 499 = 0 THEN 'post_close_entry' END, CASE WHEN bare AND manual THEN 'missing_document_ref' END,
    CASE WHEN sunday AND manual THEN 'weekend_posting' END], lambda x: x IS NOT NULL),
  list_filter([CASE WHEN bare AND NOT manual THEN 'legit_system_no_document' END, CASE WHEN sunday AND approved THEN 'legit_saturday_posting' END], lambda x: x IS NOT NULL)
FROM (SELECT *, o_orderstatus = 'P' AND o_orderkey % 5 = 0 bare, o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') manual,
  o_orderpriority IN ('1-URGENT', '2-HIGH') approved, dayofweek(o_orderdate) = 0 sunday FROM orders) WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
CTE["bad"] = "SELECT ledger_id, voucher_id FROM truth WHERE len(anomalies) > 0"
CTE["harmless"] = "SELECT ledger_id, voucher_id FROM truth WHERE len(decoys) > 0"
CTE["run"] = """
SELECT q.*, (b.voucher_id IS NOT NULL)::INT found, sum((b.voucher_id IS NOT NULL)::INT) OVER (PARTITION BY ledger_id ORDER BY rank) found_so_far
FROM que q LEFT JOIN bad b USING (ledger_id, voucher_id)"""
CTE["wanted"] = "SELECT ledger_id, count(*) actual FROM bad GROUP BY 1"""

KEY = "ledger_id, voucher_id"
join = lambda c, alias=None: f"array_to_string({c}, '|') {alias or c}"
day = lambda c: f"{c}::DATE::VARCHAR {c}"

# --- sources and sinks ----------------------------------------------------------------

_book = f"""voucher_id voucher_no, {dmy('voucher_date')} date, account_name ledger,
  CASE WHEN debit_paise = 0 THEN {{blank}} ELSE {inr('debit_paise')} END debit, CASE WHEN credit_paise = 0 THEN {{blank}} ELSE {inr('credit_paise')} END credit"""
oracle(
    "ingest_stream",
    "SELECT ledger_id, count(*) lines, count(DISTINCT voucher_id) vouchers, count(*) line_ids, sum(debit_paise)::BIGINT debit_paise, "
    "sum(credit_paise)::BIGINT credit_paise, 0 stray FROM lines GROUP BY 1",
)
oracle("source_row", "SELECT count(*) data_rows, 0 repeated, 0 gaps, 1 lo FROM lines WHERE ledger_id = 'EVT'")
oracle(
    "mapping_missing",
    "SELECT requirement, false ok, (SELECT count(*) FROM lineitem) AS \"rows\" "
    "FROM (VALUES ('account_name'), ('voucher_date'), ('voucher_id'), ('debit/credit or amount')) t(requirement)",
)
oracle("read_csv_text", f"SELECT {_book.format(blank='NULL')}, document_ref doc_ref, approved_by FROM lines WHERE ledger_id = 'ORD'")
oracle("read_parquet_ledger", "SELECT l_returnflag, l_linestatus, count(*) n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT paise FROM lineitem GROUP BY 1, 2")
oracle("intake_guards", """
SELECT 'has_columns' AS "check", TRUE ok, 11::BIGINT AS "value" UNION ALL SELECT 'has_rows', count(*) > 0, count(*) FROM lineitem
UNION ALL SELECT 'rows_within_limit', count(*) <= 50000, count(*) FROM lineitem UNION ALL SELECT 'bytes_within_limit', TRUE, NULL""")
oracle("adapt_sap_corpus", f"""
SELECT (l_suppkey % 3) || '/' || {fy('d')} ledger_id, k || '-' || n line_id, {fy('d')} fiscal_year, {period('d')} period, d::VARCHAR voucher_date, 'date_only' time_fidelity,
  CASE k % 6 WHEN 0 THEN 'sales' WHEN 1 THEN 'purchase' WHEN 2 THEN 'journal' WHEN 3 THEN 'receipt' WHEN 4 THEN 'payment' ELSE 'other' END voucher_type,
  (l_suppkey % 25 + 5000)::VARCHAR account_code, CASE WHEN n % 4 <> 0 THEN 'GL ' || l_suppkey ELSE 'Unnamed account' END account_name,
  CASE l_partkey % 4 WHEN 0 THEN 'asset' WHEN 1 THEN 'income' WHEN 2 THEN 'expense' ELSE 'asset' END account_group,
  CASE WHEN n % 2 = 0 THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END debit_paise, CASE WHEN n % 2 = 1 THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END credit_paise,
  CASE WHEN k % 5 <> 0 THEN 'INR' ELSE 'USD' END currency, CASE WHEN k % 7 <> 0 THEN 'U' || (k % 9) ELSE 'UNKNOWN' END created_by,
  CASE WHEN k % 3 <> 0 THEN 'R' || k END document_ref, coalesce(CASE WHEN n % 3 = 0 THEN 'line ' || n END, CASE WHEN k % 2 = 0 THEN 'head ' || k END) narration,
  k % 4 = 0 is_manual, CASE WHEN k % 10 <> 1 THEN k % 11 = 0 ELSE FALSE END is_post_close
FROM (SELECT *, l_orderkey k, l_linenumber n, o_orderdate::DATE d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
CTE["srcs"] = """
SELECT 'S' || o_orderkey id, 'E' || (o_custkey % 50) engagement_id, 'file' || (o_custkey % 97) || '.csv' filename, sha256('content ' || (o_custkey % 97)) sha256,
  o_orderdate uploaded_at, 'U' || (o_orderkey % 5) uploaded_by FROM orders"""
oracle("register_source", """
SELECT id, engagement_id, sha256, filename, uploaded_by FROM (SELECT * FROM srcs WHERE uploaded_at >= TIMESTAMP '1996-01-01'
  QUALIFY row_number() OVER (PARTITION BY engagement_id, sha256 ORDER BY uploaded_at, id) = 1) f
WHERE NOT EXISTS (SELECT 1 FROM srcs s WHERE s.uploaded_at < TIMESTAMP '1996-01-01' AND s.engagement_id = f.engagement_id AND s.sha256 = f.sha256)""")
oracle("source_preview", f"""SELECT source_row, voucher_id voucher_no, account_name ledger, CASE WHEN debit_paise = 0 THEN '' ELSE {inr('debit_paise')} END debit
FROM lines WHERE ledger_id = 'ORD' AND source_row BETWEEN 5002 AND 105001""")
oracle("source_liveness", """
SELECT engagement_id, count(*) FILTER (live) live, count(*) FILTER (NOT live) deleted, count(*) FILTER (NOT any_live) unreferenced
FROM (SELECT *, bool_or(live) OVER (PARTITION BY sha256) any_live FROM (SELECT *, substr(id, 2)::BIGINT % 3 = 0 live FROM srcs)) GROUP BY 1""")
oracle("write_ledger", "SELECT ledger_id, count(*) n, sum(debit_paise)::BIGINT debit_paise FROM lines WHERE ledger_id = 'ORD' GROUP BY 1")
CTE["reasons"] = "SELECT ledger_id, voucher_id, array_to_string(list(reason ORDER BY c DESC, kind), ' | ') reasons FROM hits JOIN whits USING (ledger_id, voucher_id, kind) GROUP BY 1, 2"
CTE["behind"] = "SELECT ledger_id, voucher_id, array_to_string(list_sort(list(line_id)), ', ') source_lines, count(*) lines_behind FROM lines GROUP BY 1, 2"
oracle("report_frame", f"""
SELECT ledger_id, voucher_id, voucher_date::VARCHAR date, {inr('amount_paise')} amount, amount_paise, round(priority::DECIMAL(20, 6), 3)::DOUBLE priority, band,
  array_to_string(kinds, '; ') concerns, reasons, completeness evidence_completeness, array_to_string(missing, ', ') evidence_missing, source_lines,
  CASE action WHEN 'accept' THEN 'Exception — follow up' WHEN 'reject' THEN 'Cleared — not a concern' WHEN 'investigate' THEN 'Investigating' WHEN 'adjust' THEN 'Re-banded' ELSE 'Not yet reviewed' END reviewer_decision,
  status status_code, coalesce(reviewer, '') reviewer, coalesce(strftime(decided_at, '%d-%m-%Y %H:%M') || ' UTC', '') decided_at, coalesce(note, '') note
FROM fdec JOIN reasons USING (ledger_id, voucher_id) JOIN behind USING (ledger_id, voucher_id)""")
oracle("report_csv_safe", """
SELECT doc_id, md5(safe) cell_md5, length(safe) cell_length FROM (SELECT doc_id, CASE WHEN regexp_matches(cell, '^[\\t\\r]') OR regexp_matches(cell, '^\\s*[=+\\-@\\t\\r]') THEN '''' || cell ELSE cell END safe
FROM (SELECT doc_id, ['', '=', '+', ' -', '@', chr(9), chr(13), 'a', ''''][doc_id % 9 + 1] || text cell FROM documents))""")
oracle("daybook_export", f"""
SELECT {_book.format(blank="''")}, strftime(posted_at, '%d-%m-%Y %H:%M') posted, upper(voucher_type[1]) || voucher_type[2:] vch_type, coalesce(narration, '') narration,
  coalesce(document_ref, '') doc_ref, created_by entered_by, coalesce(approved_by, '') approved_by FROM lines WHERE ledger_id = 'EVT'""")
_states = ", ".join(f"count(*) FILTER (status = '{s}') {s}" for s in ["accept", "reject", "investigate", "adjust"])
_tally = f"SELECT ledger_id, count(*) flagged, count(*) FILTER (band = 'high') high, count(*) FILTER (band = 'medium') medium, {{low}} {_states}, count(*) FILTER (status = 'not yet reviewed') outstanding FROM fdec GROUP BY 1"
oracle("report_tally", _tally.format(low="count(*) FILTER (band = 'low') low,"))
oracle("queue_counts", _tally.format(low="count(*) FILTER (band = 'low') low,"))

# --- projection, conformance, filters -----------------------------------------------------

_filled = [
    ("Voucher No", "voucher_id", "voucher_id <> ''"), ("Date", "voucher_date", "voucher_date IS NOT NULL"), ("Posted", "posted_at", "posted_at IS NOT NULL"),
    ("Vch Type", "voucher_type", "voucher_type <> ''"), ("Ledger", "account_name", "account_name <> ''"), ("Debit", "debit", "debit_paise <> 0"),
    ("Credit", "credit", "credit_paise <> 0"), ("Narration", "narration", "narration <> ''"), ("Doc Ref", "document_ref", "document_ref <> ''"),
    ("Entered By", "created_by", "created_by <> ''"), ("Approved By", "approved_by", "approved_by <> ''"),
]
oracle("infer_mapping", " UNION ALL ".join(
    f"SELECT {i} position, '{header}' header, '{field}' field, 'mapped' state, count(*) FILTER ({filled}) filled FROM lines WHERE ledger_id = 'EVT'"
    for i, (header, field, filled) in enumerate(_filled, start=1)
))
_no_ledger = "This file does not look like a ledger: could not find a voucher number, a date, a ledger or account name"
_no_amount = "; could not find a debit/credit or amount column. Columns recognised: none."
oracle("usable_check", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{_no_ledger}{rest}' AS problem, count(*) AS "rows" FROM {t}"""
    for t, rest in [("orders", _no_amount), ("lineitem", _no_amount), ("customer", _no_amount), ("events", ". Columns recognised: user_id, value.")]
))

oracle("header_normalise", """SELECT p_partkey, trim(regexp_replace(lower(p_name || '  (No.)_' || p_type || '--X'), '[^\\p{L}\\p{N}]+', ' ', 'g')) header FROM part""")
oracle("canonical_passthrough", f"SELECT line_id, ledger_id, debit_paise, credit_paise, is_manual, approved_by, document_ref, {day('voucher_date')} FROM lines")
oracle("coerce_types", f"""
SELECT voucher_id, [7, 8, 0, 0, 12][k % 5 + 1] line_number, [3, 0][k % 2 + 1] period, amount debit_paise, [0, 0, 5][k % 3 + 1] credit_paise,
  CASE WHEN k % 4 <> 0 THEN voucher_date::VARCHAR END voucher_date, CASE WHEN k % 5 <> 0 THEN strftime(posted_at, '%Y-%m-%d %H:%M:%S') END posted_at,
  [TRUE, TRUE, TRUE, FALSE, FALSE, TRUE, TRUE][k % 7 + 1] is_manual, [FALSE, TRUE][k % 2 + 1] is_post_close,
  [NULL, NULL, 'A1'][k % 3 + 1] approved_by, [' D1 ', NULL][k % 2 + 1] document_ref, narration, NULL::VARCHAR cost_centre FROM evt""")
oracle("posting_date_fallback", f"""
SELECT line_id, posted_at::DATE::VARCHAR voucher_date, NULL::TIMESTAMP posted_at, 'unknown' time_fidelity, debit_paise FROM lines WHERE ledger_id = 'EVT'""")
oracle("carry_text_defaults", """
SELECT line_id, 'unknown' created_by, 'UNKNOWN' entity_id, 'INR' currency, narration, approved_by, NULL::VARCHAR document_ref, NULL::VARCHAR cost_centre FROM lines WHERE ledger_id = 'ORD'""")
oracle("amounts_to_paise", """
SELECT voucher_id, greatest(s, 0) debit_paise, greatest(-s, 0) credit_paise FROM
(SELECT voucher_id, CASE WHEN k % 4 IN (1, 2) THEN -amount WHEN k % 11 = 0 THEN 0 ELSE amount END s FROM evt)""")
oracle("parse_dates", """
SELECT voucher_id, CASE WHEN k % 10 < 7 THEN strftime(voucher_date, '%Y-%m-%d 00:00') WHEN k % 10 = 7 THEN strftime(voucher_date, '%Y-%m-%d 14:05') END parsed FROM evt""")
oracle("time_fidelity_at_intake", """
SELECT ledger_id, CASE ledger_id WHEN 'EVT' THEN 'date_and_time' ELSE 'date_only' END time_fidelity, count(*) n FROM lines GROUP BY 1, 2
UNION ALL SELECT 'EVT-none', 'unknown', count(*) FROM lines WHERE ledger_id = 'EVT'""")
oracle("identity_defaults", """
SELECT CASE WHEN source_row % 5 <> 0 THEN account_name ELSE 'UNKNOWN' END account_code, count(*) n, sum(debit_paise)::BIGINT debit_paise FROM lines WHERE ledger_id = 'ORD' GROUP BY 1""")
oracle("classify_voucher_type", """
SELECT p_partkey, CASE WHEN t LIKE '%sales%' OR t LIKE '%sale%' THEN 'sales' WHEN t LIKE '%purchase%' OR t LIKE '%purc%' THEN 'purchase' WHEN t LIKE '%receipt%' THEN 'receipt'
  WHEN t LIKE '%payment%' THEN 'payment' WHEN t LIKE '%contra%' THEN 'contra' WHEN t LIKE '%journal%' OR t LIKE '%jrnl%' THEN 'journal' WHEN t LIKE '%debit note%' THEN 'debit_note'
  WHEN t LIKE '%credit note%' THEN 'credit_note' WHEN t LIKE '%opening%' THEN 'opening_balance' ELSE 'other' END voucher_type
FROM (SELECT p_partkey, lower(concat_ws(' ', ['Sales', 'Cash Sale', 'PURC order', 'Purchase Debit Note', 'receipt', 'Payment', 'Contra', 'JRNL', 'debit note', 'Credit Note', 'Opening', 'misc', NULL][p_partkey % 13 + 1], p_type)) t FROM part)""")
oracle("classify_account_group", """
SELECT p_partkey, ['asset', 'liability', 'equity', 'income', 'expense', 'income', 'asset', 'asset'][p_partkey % 8 + 1] account_group FROM part""")
oracle("flag_columns", "SELECT p_partkey, [TRUE, TRUE, TRUE, TRUE, FALSE, FALSE, FALSE, FALSE, FALSE][p_partkey % 9 + 1] flag FROM part")
oracle("drop_unusable_rows", """
SELECT count(*) rows_in, count(*) FILTER (n % 13 <> 0 AND n % 17 <> 0 AND n % 19 <> 0) rows_out, count(*) FILTER (n % 17 = 0) unreadable_dates
FROM (SELECT source_row n FROM lines WHERE ledger_id = 'ORD' AND source_row % 11 <> 0)""")
CTE["dented"] = """
SELECT * REPLACE (CASE WHEN k % 101 = 1 THEN 'inr' ELSE currency END AS currency, CASE WHEN k % 103 = 2 THEN 14 WHEN k % 107 = 3 THEN 1 ELSE period END AS period,
  CASE WHEN k % 109 = 4 THEN credit_paise + 5 ELSE credit_paise END AS credit_paise, CASE WHEN k % 113 = 5 THEN '' ELSE account_name END AS account_name,
  CASE WHEN k % 127 = 6 THEN '2024' ELSE fiscal_year END AS fiscal_year, CASE WHEN k % 131 = 7 THEN 'memo' ELSE voucher_type END AS voucher_type)
FROM (SELECT *, substr(voucher_id, 2)::BIGINT k FROM evt_all)"""
oracle("validate_lines", f"""
SELECT line_id, array_to_string(list_filter([CASE WHEN account_name = '' THEN 'account_name_empty' END, CASE WHEN NOT regexp_matches(fiscal_year, '^FY\\d{{4}}-\\d{{2}}$') THEN 'fiscal_year_shape' END,
  CASE WHEN period NOT BETWEEN 1 AND 12 THEN 'period_out_of_range' END, CASE WHEN voucher_type = 'memo' THEN 'voucher_type_unknown' END,
  CASE WHEN debit_paise < 0 OR credit_paise < 0 THEN 'negative_amount' END,
  CASE WHEN NOT regexp_matches(currency, '^[A-Z]{{3}}$') THEN 'currency_shape' END, CASE WHEN (debit_paise <> 0) = (credit_paise <> 0) THEN 'not_one_sided' END,
  CASE WHEN fiscal_year <> {fy('voucher_date')} THEN 'fiscal_year_of_date' END, CASE WHEN period <> {period('voucher_date')} THEN 'period_of_date' END], lambda x: x IS NOT NULL), '; ') problems FROM dented""")
oracle("money_guard", """
SELECT event_id, CASE WHEN k = 1 THEN 'finer_than_a_paisa' WHEN k = 2 THEN 'not_a_finite_number' WHEN k = 3 THEN 'beyond_the_sanity_limit' END problem,
  CASE WHEN k IN (1, 2) THEN NULL WHEN k = 3 THEN 12345678901234500 ELSE round(value * 100)::BIGINT END paise FROM (SELECT *, event_id % 10 k FROM events)""")
oracle("decision_rules", """
SELECT conv_id, turn, CASE WHEN action = 'close' THEN 'unknown_action'
  WHEN action = 'reject' AND (k % 3 <> 0 OR len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) < 3) THEN 'rejection_without_reason'
  WHEN action = 'adjust' AND k % 2 <> 0 THEN 'adjustment_without_band' WHEN k % 17 = 0 THEN 'no_reviewer' END problem
FROM (SELECT *, ['accept', 'reject', 'investigate', 'adjust', 'close'][k % 5 + 1] action FROM (SELECT *, conv_id * 7 + turn k FROM conversations))""")
oracle("queue_filter", f"""
SELECT ledger_id, voucher_id, priority, status, {join('concerns')} FROM fdec JOIN heads USING (ledger_id, voucher_id)
WHERE band = 'high' AND list_contains(concerns, 'missing_evidence') AND NOT has_document AND status = 'not yet reviewed'""")
oracle("queue_search", """
SELECT ledger_id, voucher_id, f.amount_paise FROM fnd f JOIN vch v USING (ledger_id, voucher_id)
WHERE contains(lower(concat_ws(' ', voucher_id, narration, created_by, array_to_string(account_names, ' '))), 'expense')
AND (contains(lower(concat_ws(' ', voucher_id, narration, created_by, array_to_string(account_names, ' '))), '5003') OR contains(f.amount_paise::VARCHAR, '5003'))""")
oracle("lines_for_voucher", f"SELECT {KEY}, source_row, line_id, account_code, debit_paise, credit_paise FROM lines SEMI JOIN (SELECT * FROM fnd WHERE band = 'high') USING (ledger_id, voucher_id)")
oracle("owner_scope", "SELECT 'E' || c_custkey id, 'U3' owner_id FROM customer WHERE c_custkey % 7 = 3")

# --- joins -----------------------------------------------------------------------------------

oracle("account_pairs", f"SELECT {KEY}, debit_account, credit_account FROM prs")
oracle("freq_lookup", f"""
SELECT {KEY}, any_value(times_seen) rarest_pair, round(min(entries / total), 6) familiarity FROM use LEFT JOIN rarest USING (ledger_id, voucher_id) GROUP BY 1, 2""")
oracle("findings_decisions", f"SELECT {KEY}, status, reviewer, note, sequence FROM fdec")
oracle("findings_assemble", f"SELECT {KEY}, {join('kinds')}, completeness, amount_paise, {day('voucher_date')}, lines_behind FROM fnd JOIN behind USING (ledger_id, voucher_id)")
_similar = """
SELECT ledger_id, voucher_id, similar_rank, similar_id{more} FROM (
  SELECT t.ledger_id, t.voucher_id, v.voucher_id similar_id,
    CASE WHEN t.debit_accounts = v.debit_accounts AND t.credit_accounts = v.credit_accounts THEN 'same accounts' ELSE 'same debit account' END basis,
    round(abs(log10(greatest(v.amount_paise, 1)) - log10(greatest(t.amount_paise, 1))), 12) d, abs(date_diff('day', t.voucher_date, v.voucher_date)) AS days,
    row_number() OVER (PARTITION BY t.ledger_id, t.voucher_id ORDER BY t.debit_accounts <> v.debit_accounts OR t.credit_accounts <> v.credit_accounts,
      round(abs(log10(greatest(v.amount_paise, 1)) - log10(greatest(t.amount_paise, 1))), 12), abs(date_diff('day', t.voucher_date, v.voucher_date)), v.voucher_id) similar_rank
  FROM vch t SEMI JOIN ({targets}) s USING (ledger_id, voucher_id) JOIN vch v ON v.ledger_id = t.ledger_id AND v.primary_account = t.primary_account AND v.voucher_id <> t.voucher_id
{where}) WHERE similar_rank <= 3"""
oracle("similar_entries", _similar.format(more=", basis, round(d, 6) distance, days", targets="SELECT * FROM fnd", where=""))
oracle("similarity_rank", _similar.format(
    more="", targets="SELECT * FROM fnd WHERE list_contains(kinds, 'amount_outlier')", where="  WHERE t.primary_account <> ''"
))
oracle("account_names", "SELECT ledger_id, account_code, arg_min(account_name, (source_row, line_id)) account_name FROM lines GROUP BY 1, 2")
oracle("approach_only", f"SELECT DISTINCT {KEY} FROM hits WHERE kind = 'amount_outlier' EXCEPT SELECT {KEY} FROM hits WHERE kind <> 'amount_outlier'")
oracle("truth_join", f"SELECT ledger_id, decoys[1] decoy, count(*) queued FROM truth SEMI JOIN fnd USING (ledger_id, voucher_id) WHERE len(decoys) > 0 GROUP BY 1, 2")
oracle("engagement_summary", """
SELECT e.id, flagged, high, coalesce(reviewed, 0) reviewed, latest_file, greatest(opened_at, last_decision)::TIMESTAMP::VARCHAR last_activity
FROM (SELECT 'E' || c_custkey id, c_custkey, TIMESTAMP '1995-01-01' + to_days((c_custkey % 2500)::INT) opened_at FROM customer) e
LEFT JOIN (SELECT o_custkey, count(*) flagged, count(*) FILTER (o_orderpriority = '1-URGENT') high, count(DISTINCT o_orderkey % 40) reviewed, max(o_orderdate) last_decision,
  arg_max('f' || o_orderkey || '.csv', (o_orderdate, 'f' || o_orderkey || '.csv')) FILTER (o_orderkey % 3 <> 0) latest_file FROM orders GROUP BY 1) o ON o.o_custkey = e.c_custkey""")
oracle("same_book", "SELECT DISTINCT ledger_id, ledger_id = 'EVT' same_book FROM lines")

# --- aggregations --------------------------------------------------------------------------------

oracle("voucher_view", f"""
SELECT {KEY}, amount_paise, {join('accounts')}, {join('debit_accounts')}, {join('credit_accounts')}, {join('account_names')}, document_ref, evidence_lines, line_count, approved_by,
  created_by, is_manual, is_post_close, voucher_type, narration, {day('voucher_date')}, primary_account FROM vch""")
oracle("pair_counts", "SELECT * FROM prc")
oracle("preparer_account_counts", "SELECT ledger_id, created_by, account_code, entries FROM pac")
oracle("account_amount_counts", "SELECT * FROM aac")
oracle("time_fidelity", "SELECT ledger_id, fidelity, n_vouchers FROM ltime")
oracle("year_end", f"SELECT ledger_id, {day('year_end')} FROM ltime")
oracle("account_profile", "SELECT ledger_id, primary_account, n, round(median_paise, 2) median_paise, round(low_paise, 2) low_paise, round(high_paise, 2) high_paise FROM prof")
_obs = lambda d: f"(count(*) FILTER (digit = {d}) / count(*))"
_mad = "(" + " + ".join(f"abs({_obs(d)} - log10(1 + 1 / {d}))" for d in range(1, 10)) + ") / 9"
oracle("benford_by_account", f"""
SELECT *, CASE WHEN mad <= 0.006 THEN 'close' WHEN mad <= 0.012 THEN 'acceptable' WHEN mad <= 0.015 THEN 'marginal' ELSE 'non-conforming' END conformity FROM (
SELECT ledger_id, primary_account, count(*) sample_size, round({_obs(1)}, 6) ones, round({_mad}, 6) mad FROM (SELECT *, left(greatest(amount_paise, 1)::VARCHAR, 1)::INT digit FROM vch WHERE primary_account <> '')
GROUP BY 1, 2 HAVING count(*) >= 100)""")
_kinds = ", ".join(f"('{k}')" for k in C.ALL_KINDS)
oracle("hits_by_kind", f"""
SELECT ledger_id, kind, count(DISTINCT voucher_id) vouchers FROM (SELECT * FROM (SELECT DISTINCT ledger_id FROM hits), (VALUES {_kinds}) k(kind)) g LEFT JOIN hits USING (ledger_id, kind) GROUP BY 1, 2""")
oracle("hits_by_voucher", f"SELECT {KEY}, array_to_string(list_sort(list(kind)), '|') kinds FROM hits GROUP BY 1, 2")
oracle("flagged_vouchers", f"SELECT DISTINCT {KEY} FROM hits")
oracle("unbalanced_vouchers", f"SELECT {KEY}, sum(debit_paise - credit_paise)::BIGINT gap_paise FROM dented GROUP BY 1, 2 HAVING sum(debit_paise - credit_paise) <> 0")
oracle("balanced_vouchers", "SELECT line_id, voucher_id, line_number FROM (SELECT *, sum(debit_paise - credit_paise) OVER (PARTITION BY voucher_id) gap FROM dented) WHERE gap = 0")
CTE["tb"] = "SELECT ledger_id, account_code, sum(debit_paise)::BIGINT debit_paise, sum(credit_paise)::BIGINT credit_paise, sum(debit_paise - credit_paise)::BIGINT balance_paise FROM lines GROUP BY 1, 2"
oracle("trial_balance", "SELECT * FROM tb")
_held = lambda p: f"coalesce(sum(balance_paise) FILTER (starts_with(account_code, '{p}')), 0)"
oracle("ledger_ratios", f"""
SELECT ledger_id, round({_held('50')} / nullif(-{_held('2')}, 0) * 365, 4) debtor_days, round(abs({_held('20')}) / nullif({_held('5')}, 0) * 365, 4) creditor_days,
  round(1 - {_held('5')} / nullif(-{_held('2')}, 0), 4) gross_margin, abs({_held('2002')}) < -{_held('2')} * 0.1 AND abs({_held('2003')}) < -{_held('2')} * 0.1 dues_within_share,
  (SELECT count(*) FROM lines l WHERE l.ledger_id = tb.ledger_id AND starts_with(account_code, '2001') AND credit_paise > 1000000) cash_over_limit FROM tb GROUP BY ledger_id""")
oracle("monthly_movement", """
SELECT ledger_id, month::DATE::VARCHAR AS month, (month + INTERVAL 1 MONTH)::DATE::VARCHAR due_month, o output_paise, i input_paise, CASE WHEN o > 0 AND i >= 0 AND o - i > 0 THEN o - i ELSE 0 END net_due_paise
FROM (SELECT ledger_id, date_trunc('month', voucher_date) AS month, coalesce(sum(credit_paise - debit_paise) FILTER (account_code IN ('2004', '2005')), 0)::BIGINT o,
  -coalesce(sum(credit_paise - debit_paise) FILTER (account_code = '5001'), 0)::BIGINT i FROM lines GROUP BY 1, 2)""")
_cols = sorted(["line_id", "voucher_id", "line_number", "entity_id", "fiscal_year", "period", "voucher_date", "posted_at", "time_fidelity", "voucher_type", "account_code", "account_name",
                "account_group", "debit_paise", "credit_paise", "currency", "created_by", "approved_by", "document_ref", "narration", "cost_centre", "is_manual", "is_post_close"])
_text = " || chr(31) || ".join(f"coalesce({c}::VARCHAR, '␀')" for c in _cols)
_word = lambda i: f"sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT::HUGEINT)"
oracle("ledger_digest", f"""
SELECT ledger_id, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) digest, n n_lines
FROM (SELECT ledger_id, count(*) n, {_word(0)} s0, {_word(1)} s1, {_word(2)} s2, {_word(3)} s3 FROM (SELECT ledger_id, sha256({_text}) h FROM lines) GROUP BY 1)""")
oracle("engagement_open", f"""
SELECT ledger_id, entity_id, fiscal_year, entity_id || ' ' || fiscal_year AS name, voucher_count FROM (SELECT ledger_id, arg_min(entity_id, (source_row, line_id)) entity_id,
arg_min(fiscal_year, (source_row, line_id)) fiscal_year, count(DISTINCT voucher_id) voucher_count FROM lines GROUP BY 1)""")
oracle("concern_counts", "SELECT ledger_id, concern, count(*) findings FROM (SELECT ledger_id, unnest(concerns) concern FROM heads) GROUP BY 1, 2")
oracle("noisy_or", f"SELECT {KEY}, round(base, 6) base FROM bases")

# --- windows ---------------------------------------------------------------------------------------

oracle("duplicate_entry", f"SELECT {KEY}, amount_paise, gap days_apart, earlier_id earlier_voucher_id, earlier_date::VARCHAR earlier_date FROM dup")
oracle("line_numbers", """
SELECT ledger_id, voucher_id || '-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n line_id, n line_number, account_code, debit_paise, -source_row source_row
FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, voucher_id ORDER BY -source_row) n FROM lines)""")
oracle("decision_current", "SELECT engagement_id, voucher_id, sequence, action FROM now_at")
oracle("decision_trail", """
SELECT engagement_id, voucher_id, sequence, action FROM trail WHERE sequence % 2 = 1 UNION ALL
SELECT engagement_id, voucher_id, (SELECT max(sequence) FROM trail WHERE sequence % 2 = 1) + row_number() OVER (ORDER BY decided_at, engagement_id, voucher_id), action FROM trail WHERE sequence % 2 = 0""")
oracle("account_owner", "SELECT ledger_id, account_code, total, owner, round(owner_share, 6) owner_share FROM own")
oracle("contribution_order", f"""
SELECT c.ledger_id, c.voucher_id, array_to_string(list(kind ORDER BY c DESC, tie), '|') ordered, list(kind ORDER BY c DESC, tie)[1] top, array_to_string(any_value(concerns), '|') headline
FROM contrib c JOIN heads USING (ledger_id, voucher_id) GROUP BY 1, 2""")
oracle("cumulative_hits", f"SELECT {KEY}, rank, found_so_far::BIGINT found_so_far FROM run")

# --- sorts, sets --------------------------------------------------------------------------------------

oracle("hits_sorted", f"SELECT {KEY}, kind, round(strength, 6) strength FROM hits")
oracle("queue_ranked", f"SELECT {KEY}, rank, priority, band FROM que")
oracle("queue_top", f"SELECT {KEY}, rank, priority FROM que WHERE rank <= 50")
oracle("detect_ranked", f"SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY total DESC, voucher_id) AS rank FROM (SELECT {KEY}, round(sum(strength), 6) total FROM hits GROUP BY 1, 2)")
oracle("queue_unranked", f"SELECT {KEY}, row_number() OVER (PARTITION BY ledger_id ORDER BY voucher_id) AS rank FROM fnd")
oracle("page", f"SELECT {KEY}, rank FROM que WHERE rank BETWEEN 201 AND 400")
oracle("union_hits", "SELECT ledger_id, kind, count(*) n, round(sum(strength), 4) strength FROM hits GROUP BY 1, 2")
CTE["sets"] = f"SELECT DISTINCT {KEY}, unnest(CASE WHEN kind = 'amount_outlier' THEN ['statistics', 'statistics+model', 'all'] ELSE ['rules', 'all'] END) approach FROM hits"
oracle("approach_sets", "SELECT ledger_id, approach, count(*) flagged FROM sets GROUP BY 1, 2")
oracle("set_intersect", f"SELECT {KEY} FROM fnd INTERSECT SELECT {KEY} FROM harmless")
oracle("set_except", f"SELECT {KEY} FROM bad EXCEPT SELECT {KEY} FROM fnd WHERE band = 'high'")
oracle("distinct_sides", f"SELECT DISTINCT {KEY}, account_code FROM lines WHERE debit_paise > 0")
oracle("drop_signals", f"""
SELECT {KEY}, round(p, 6) priority, CASE WHEN round(p, 12) >= 0.7 THEN 'high' WHEN round(p, 12) >= 0.4 THEN 'medium' ELSE 'low' END band FROM
(SELECT {KEY}, base + 0.45::DOUBLE * (1 - completeness) * (1 - base) p FROM (SELECT {KEY}, 1 - product(1 - least(c, 1)) base FROM whits WHERE kind NOT IN ('missing_evidence', 'off_hours_posting') GROUP BY 1, 2)
JOIN evm USING (ledger_id, voucher_id))""")

# --- signals ----------------------------------------------------------------------------------------------

from checks.queries import SIGNAL_FACTS  # noqa: E402

for _name, (_kind, _facts) in SIGNAL_FACTS.items():
    _body, _strength, _reason, _sql = SIGNALS[_kind]
    oracle(_name, f"SELECT {KEY}, round(({_strength})::DOUBLE, 6) strength, " + ", ".join(f"({_sql[f]})::VARCHAR AS {f}" for f in _facts) + f" {_body}")

# --- statistics -----------------------------------------------------------------------------------------------

oracle("amount_deviation", f"SELECT {KEY}, primary_account, round(deviation, 6) deviation FROM devs")
CTE["familiar"] = f"SELECT {KEY}, min(entries / total) familiarity FROM use GROUP BY 1, 2"
_tz = "CASE WHEN amount_paise = 0 THEN 0 ELSE least(10, length(amount_paise::VARCHAR) - length(rtrim(amount_paise::VARCHAR, '0'))) END"
CTE["feats0"] = f"""
SELECT ledger_id, voucher_id, log10(greatest(amount_paise, 1)) log_amount, line_count::DOUBLE line_count, left(greatest(amount_paise, 1)::VARCHAR, 1)::DOUBLE first_digit, ({_tz})::DOUBLE trailing_zeros,
  (amount_paise % 100000 = 0)::INT::DOUBLE is_round_thousand, CASE WHEN fidelity = 'date_and_time' THEN hour(posted_at) ELSE -1 END::DOUBLE posting_hour,
  (fidelity = 'date_and_time')::INT::DOUBLE has_posting_time, ((dayofweek(voucher_date) + 6) % 7)::DOUBLE day_of_week, date_diff('day', voucher_date, year_end)::DOUBLE days_to_year_end,
  date_diff('day', voucher_date, posted_at::DATE)::DOUBLE posting_lag_days, is_manual::INT::DOUBLE is_manual, is_post_close::INT::DOUBLE is_post_close, (evidence_lines > 0)::INT::DOUBLE has_evidence,
  evidence_lines / line_count evidence_coverage, (approved_by IS NOT NULL)::INT::DOUBLE has_approver, -log10(coalesce(times_seen, 1) / n_vouchers) account_pair_rarity,
  coalesce(familiarity, 1) preparer_familiarity, deviation amount_deviation
FROM ctx LEFT JOIN rarest USING (ledger_id, voucher_id) LEFT JOIN familiar USING (ledger_id, voucher_id) JOIN (SELECT {KEY}, deviation FROM devs) USING (ledger_id, voucher_id)"""
CTE["feats"] = "SELECT ledger_id, voucher_id, " + ", ".join(f"round({f}, 6) {f}" for f in FEATURES) + " FROM feats0"
CTE["centres"] = "SELECT ledger_id, " + ", ".join(f"quantile_cont({f}, 0.5) m_{f}, stddev_pop({f}) s_{f}" for f in FEATURES) + " FROM feats0 GROUP BY 1"
_far = ", ".join(
    "{'d': -round(coalesce(abs(%s - m_%s) / nullif(s_%s, 0), 0), 6), 'i': %d, 'f': '%s'}" % (f, f, f, i, f) for i, f in enumerate(FEATURES)
)
oracle("voucher_features", "SELECT * FROM feats")
oracle("top_features", f"SELECT {KEY}, array_to_string(list_transform(list_sort([{_far}])[1:3], lambda x: x.f), '|') top FROM feats0 JOIN centres USING (ledger_id)")
oracle("first_digit", f"SELECT {KEY}, left(greatest(amount_paise, 1)::VARCHAR, 1)::INT first_digit, ({_tz})::INT trailing_zeros FROM vch")
_ltz = _tz.replace("amount_paise", "(debit_paise + credit_paise)")
oracle("trailing_zeros", f"SELECT ledger_id, ({_ltz})::INT trailing_zeros, count(*) n FROM lines GROUP BY 1, 2")
oracle("pair_rarity", f"SELECT {KEY}, round(-log10(coalesce(times_seen, 1) / n_vouchers), 6) rarity FROM ctx LEFT JOIN rarest USING (ledger_id, voucher_id)")
oracle("preparer_familiarity", f"SELECT {KEY}, round(familiarity, 6) familiarity FROM familiar")

# --- evidence, fusion ---------------------------------------------------------------------------------------------

oracle("evidence_score", f"SELECT {KEY}, completeness, has_document, has_approval, approval_expected, has_narration, document_coverage FROM evd")
oracle("evidence_missing", f"""SELECT {KEY}, {join('missing')}, CASE WHEN len(missing) = 0 THEN 'Fully supported: document, approval and narration all present.' ELSE 'No ' || array_to_string(missing, ' and no ') || '.' END summary FROM evm""")
oracle("evidence_state", f"""
SELECT {KEY}, d || '|' || a || '|not_in_file' states, (d = 'present')::INT + (a = 'present')::INT present_items, 1 + (a <> 'not_expected')::INT expected_items
FROM (SELECT *, CASE WHEN has_document THEN 'present' ELSE 'missing' END d, CASE WHEN has_approval THEN 'present' WHEN NOT approval_expected THEN 'not_expected' ELSE 'missing' END a FROM evd)""")
oracle("corroboration", f"SELECT {KEY}, round(coalesce(1 - (1 - base) * (1 - 0.15::DOUBLE), 0), 6) priority FROM vch LEFT JOIN bases USING (ledger_id, voucher_id)")
oracle("fuse_priority", f"SELECT {KEY}, priority FROM fnd")
oracle("contributions", f"SELECT {KEY}, kind, round(c, 4) contribution FROM contrib")
oracle("risk_band", "SELECT ledger_id, band, count(*) findings FROM fnd GROUP BY 1, 2")
oracle("build_findings", f"SELECT {KEY}, rank, priority, band, amount_paise, {day('voucher_date')}, {join('kinds')}, completeness, {join('missing')} FROM que")
oracle("weights_table", f"SELECT kind, weight, (SELECT count(*) FROM hits h WHERE h.kind = w.kind) hits FROM (SELECT * FROM wts UNION ALL SELECT 'evidence_gap', 0.45::DOUBLE) w")

# --- text -----------------------------------------------------------------------------------------------------------

oracle("reason_text", f"SELECT {KEY}, kind, reason FROM hits")
_words = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END"
_phr = [*textaudit.FORBIDDEN_PHRASES, "approval", "provenance", "reviewed", "Clearly Shows", "defraud"]
_lit = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
oracle("forbidden_language", f"""
SELECT id, array_to_string(list_filter({_lit(textaudit.FORBIDDEN_PHRASES)}, lambda p: regexp_matches(lower(text), '\\b' || p || '\\b')), '|') phrases, {_words} words, {_words} > 220 too_long FROM (
SELECT 'e' || event_id id, 'The entry ' || ({_lit(_phr)})[event_id % {len(_phr)} + 1] || ', in part: ' || event_type AS text FROM events UNION ALL SELECT 'd' || doc_id, text FROM documents)""")
_cue_case = " ".join(
    f"WHEN '{k}' THEN " + " OR ".join(f"contains(t, '{cue}')" for cue in explain.CUES[k]) for k in C.ALL_KINDS
)
_first_cues = [explain.CUES[k][0] for k in C.ALL_KINDS]
oracle("omitted_concerns", f"""
SELECT voucher_id, coalesce(array_to_string(list_sort(list_distinct(list(kind) FILTER (c >= 0.05 AND NOT (CASE kind {_cue_case} END)))), '|'), '') omitted
FROM (SELECT voucher_id, lower('Noted: ' || ({_lit(_first_cues)})[k % 12 + 1] || '.') t, ({_lit(C.ALL_KINDS)})[(k + s) % 12 + 1] kind, CASE s WHEN 0 THEN 0.5 ELSE (k % 20) / 100 END c FROM evt, (VALUES (0), (5)) x(s)) GROUP BY 1""")

# --- evaluation ------------------------------------------------------------------------------------------------------

oracle("score_sets", """
SELECT ledger_id, p predicted, actual, h hits, round(h / actual, 6) recall, round(h / p, 6) AS precision, round(2 * (h / actual) * (h / p) / (h / actual + h / p), 6) f1
FROM (SELECT ledger_id, count(*) p FROM fnd GROUP BY 1) JOIN wanted USING (ledger_id)
JOIN (SELECT ledger_id, count(*) h FROM bad SEMI JOIN fnd USING (ledger_id, voucher_id) GROUP BY 1) USING (ledger_id)""")
oracle("false_positive_rate", "SELECT ledger_id, round(count(f.voucher_id) / count(*), 6) rate FROM harmless LEFT JOIN fnd f USING (ledger_id, voucher_id) GROUP BY 1")
oracle("precision_at_k", "SELECT ledger_id, k, round(avg(found), 6) AS precision FROM run, (VALUES (10), (25), (50), (100)) b(k) WHERE rank <= k GROUP BY 1, 2")
oracle("queue_quality", """
SELECT ledger_id, count(*) queue, round(avg(found) FILTER (rank <= 10), 3) p_at_10, round(avg(found) FILTER (rank <= 25), 3) p_at_25, round(avg(found) FILTER (rank <= 50), 3) p_at_50,
  round(avg(found) FILTER (rank <= 100), 3) p_at_100, min(rank) FILTER (found = 1) first_hit, min(rank) FILTER (found_so_far >= 0.95 * actual) items_for_95pct,
  round(sum(found) / any_value(actual), 3) recall FROM run JOIN wanted USING (ledger_id) GROUP BY 1""")
CTE["vbase"] = """
SELECT ledger_id, voucher_id, variant, 1 - product(1 - least(c, 1)) base FROM whits, (VALUES ('full'), ('no evidence uplift'), ('no evidence at all'), ('no model'), ('unranked')) x(variant)
WHERE variant <> 'no evidence at all' OR kind <> 'missing_evidence' GROUP BY 1, 2, 3"""
CTE["vque"] = """
SELECT ledger_id, voucher_id, variant, row_number() OVER (PARTITION BY ledger_id, variant ORDER BY CASE variant WHEN 'unranked' THEN 0 ELSE round(p, 6) END DESC, voucher_id) AS rank
FROM (SELECT *, base + CASE WHEN variant LIKE 'no evidence%' THEN 0 ELSE 0.45::DOUBLE * (1 - completeness) * (1 - base) END p FROM vbase JOIN evm USING (ledger_id, voucher_id)) WHERE p > 0"""
CTE["vrun"] = """
SELECT q.*, (b.voucher_id IS NOT NULL)::INT found, sum((b.voucher_id IS NOT NULL)::INT) OVER (PARTITION BY ledger_id, variant ORDER BY rank) found_so_far
FROM vque q LEFT JOIN bad b USING (ledger_id, voucher_id)"""
oracle("ablation_rules", """
SELECT ledger_id, variant, count(*) queue, round(avg(found) FILTER (rank <= 10), 3) p_at_10, round(avg(found) FILTER (rank <= 25), 3) p_at_25, round(avg(found) FILTER (rank <= 50), 3) p_at_50,
  round(avg(found) FILTER (rank <= 100), 3) p_at_100, min(rank) FILTER (found = 1) first_hit, min(rank) FILTER (found_so_far >= 0.95 * actual) items_for_95pct,
  round(sum(found) / any_value(actual), 3) recall FROM vrun JOIN wanted USING (ledger_id) GROUP BY 1, 2""")
_duty = ", ".join(
    f"('{s}', '{k}', {repr(evaluation.TRAPS[s]) if s in evaluation.TRAPS else 'NULL'}, {C.SIGNAL_WEIGHTS[s]}::DOUBLE)" for s, k in evaluation.RESPONSIBILITY.items()
)
_caught = "avg(EXISTS (SELECT 1 FROM hits h WHERE h.ledger_id = t.ledger_id AND h.voucher_id = t.voucher_id AND h.kind = d.kind)::INT)"
oracle("signal_scorecard", f"""
SELECT kind, round(avg(coalesce(r, 0)), 4) mean_recall, round(min(coalesce(r, 0)), 4) min_recall, round(sum(coalesce(f, 0)), 4) trap_false_positives, any_value(weight) weight FROM (
SELECT ledger_id, kind, weight, (SELECT {_caught} FROM truth t WHERE t.ledger_id = b.ledger_id AND list_contains(anomalies, planted)) r,
  (SELECT {_caught} FROM truth t WHERE t.ledger_id = b.ledger_id AND list_contains(decoys, trap)) f
FROM (VALUES {_duty}) d(kind, planted, trap, weight), (SELECT DISTINCT ledger_id FROM truth) b) GROUP BY 1""")
oracle("mean_by_variant", "SELECT kind, round(avg(n), 4) vouchers, round(avg(s), 4) strength FROM (SELECT ledger_id, kind, count(*) n, avg(strength) s FROM hits GROUP BY 1, 2) GROUP BY 1")
oracle("label_lift", """
SELECT ledger_id, round(l, 6) labelled_share, round(b, 6) baseline_share, round(l / greatest(b, 1e-9), 4) lift FROM (SELECT ledger_id, avg(shows) FILTER (list_contains(anomalies, 'post_close_entry')) l, avg(shows) b
FROM (SELECT *, (coalesce(date_diff('day', voucher_date, posted_at::DATE) > 45, FALSE) OR is_post_close)::INT shows FROM vch JOIN truth USING (ledger_id, voucher_id)) GROUP BY 1)""")
oracle("truth_lookup", "SELECT ledger_id, count(*) FILTER (len(anomalies) > 0) anomalous, count(*) FILTER (len(decoys) > 0) decoys, round(count(*) FILTER (len(anomalies) > 0) / count(*), 6) anomaly_rate FROM truth GROUP BY 1")
oracle("heldout_guard", f"SELECT DISTINCT (user_id * 7)::VARCHAR ledger_id FROM events WHERE (user_id * 7)::VARCHAR IN ({', '.join(repr(t) for t in C.TUNING_LEDGERS)})")

# --- scalar functions --------------------------------------------------------------------------------------------------

_p = "round(o_totalprice * 100)::BIGINT"
oracle("fiscal_year_period", f"SELECT o_orderkey, {fy('o_orderdate')} fiscal_year, {period('o_orderdate')} period FROM orders")
oracle("rupee_text_to_paise", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN -{_p} WHEN o_orderkey % 4 = 2 THEN {_p} WHEN o_orderkey % 9 = 0 THEN 0 ELSE {_p} END paise FROM orders")
oracle("float_rupees_to_paise", f"SELECT o_orderkey, {_p} paise FROM orders")
oracle("paise_to_rupees", "SELECT o_orderkey, o_totalprice::DECIMAL(20, 2)::VARCHAR rupees FROM orders")
oracle("rupees_to_paise", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN {_p} END paise FROM orders")
oracle("format_inr", f"SELECT o_orderkey, {inr('p')} amount FROM (SELECT o_orderkey, {_p} * CASE o_orderkey % 5 WHEN 0 THEN -100 WHEN 1 THEN 0 ELSE 1 END + o_orderkey % 7 p FROM orders)")
oracle("line_props", "SELECT ledger_id, line_id, greatest(debit_paise, credit_paise) amount_paise, debit_paise - credit_paise signed_paise, coalesce(trim(document_ref) <> '', FALSE) has_evidence FROM lines")
oracle("uk_date", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'not-a' ELSE {dmy('o_orderdate')} END uk FROM orders")
_red = lambda c: f"CASE WHEN {c} IS NULL THEN '-' WHEN regexp_matches({c}, '^[A-Za-z0-9_.:-]{{1,64}}$') THEN {c} ELSE '[redacted]' END"
oracle("redact", f"SELECT 'p' || page_id id, {_red('url')} logged FROM pages UNION ALL SELECT 'c' || c_custkey, {_red('c_name')} FROM customer")
oracle("conformity_level", """SELECT o_orderkey, CASE WHEN x <= 60 THEN 'close' WHEN x <= 120 THEN 'acceptable' WHEN x <= 150 THEN 'marginal' ELSE 'non-conforming' END conformity FROM (SELECT o_orderkey, o_orderkey % 200 x FROM orders)""")
oracle("contribution_level", f"SELECT {KEY}, kind, CASE WHEN c >= 0.6 THEN 'High' WHEN c >= 0.3 THEN 'Medium' ELSE 'Low' END AS level, c < 0.05 minor FROM contrib")
_sentences = "greatest(len(list_filter(regexp_split_to_array(t, '[.!?]+(?:\\s|$)'), lambda x: trim(x) <> '')), 1)"
oracle("readability", f"""
SELECT doc_id, round(w, 6) words_per_sentence, CASE WHEN w <= 18 THEN 'easy' WHEN w <= 25 THEN 'fair' ELSE 'heavy' END reading
FROM (SELECT doc_id, {_words} / {_sentences} w FROM (SELECT *, translate(text, chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '     ') t FROM documents))""")
_layer = {"amount_outlier": "statistics", "ml_anomaly": "model"}
_reg = ", ".join(f"({i}, '{k}', '{_layer.get(k, 'rule')}', {C.SIGNAL_WEIGHTS[k]}::DOUBLE)" for i, k in enumerate(C.ALL_KINDS, start=1))
oracle("signal_registry", f"SELECT position, kind, layer, weight, (SELECT count(*) FROM hits h WHERE h.kind = r.kind) hits FROM (VALUES {_reg}) r(position, kind, layer, weight)")
oracle("detector_config", "SELECT cfg.* FROM cfg JOIN (SELECT DISTINCT ledger_id FROM lines) USING (ledger_id)")
