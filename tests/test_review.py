import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Thresholds, threshold_frame, threshold_problems
from ledgerloom.operators import digest, fusion, review, scale, similar, vouchers
from ledgerloom.operators.evidence import evidence_columns
from ledgerloom.operators.vouchers import LedgerFrames
from ledgerloom.plans import evaluation, fixtures
from ledgerloom.plans.review import EVERYTHING, all_hits, build_findings
from tests.conftest import SMALL


def fused(spark, rows, completeness=None):
    hits = spark.createDataFrame([("L", v, k, s) for v, k, s in rows], "ledger_id string, voucher_id string, kind string, strength double")
    df = fusion.strongest(hits).withColumn("completeness", F.lit(completeness))
    out = fusion.fuse(df, completeness="completeness" if completeness is not None else None)
    return {r.voucher_id: r for r in out.collect()}


def test_fusion_is_bounded_monotone_and_needs_corroboration(spark):
    rows = [("one", "missing_evidence", 0.9), ("two", "missing_evidence", 0.9), ("two", "weekend_posting", 0.6),
            ("weak", "weekend_posting", 0.3), ("weak", "threshold_adjacent", 0.3), ("model", "ml_anomaly", 1.0),
            ("twice", "missing_evidence", 0.2), ("twice", "missing_evidence", 0.9)]
    got = fused(spark, rows)
    assert all(0 <= r.priority <= 1 for r in got.values())
    assert got["two"].priority > got["one"].priority == got["twice"].priority == pytest.approx(0.81)
    assert got["weak"].priority < got["one"].priority and got["model"].priority == 0 and got["model"].contributions == []
    lifted = fused(spark, rows, 0.0)
    assert lifted["one"].priority == pytest.approx(0.81 + 0.45 * 0.19)


def test_bands_sit_on_their_edges(spark):
    from ledgerloom.functions.labels import risk_band

    df = spark.createDataFrame([(0.7,), (0.6999,), (0.4,), (0.39,)], "p double")
    assert [r[0] for r in df.select(risk_band(F.col("p"))).collect()] == ["high", "medium", "medium", "low"]


@pytest.fixture(scope="module")
def both(spark):
    return LedgerFrames(fixtures.both_lines(spark, SMALL), overrides=threshold_frame(spark, fixtures.LEDGER_THRESHOLDS))


def rows_of(q):
    return sorted((r.ledger_id, r["rank"], r.voucher_id, r.priority, r.band) for r in q.collect())


def test_two_ledgers_together_equal_each_alone(spark, both):
    together = rows_of(build_findings(both, use_model=False))
    alone = rows_of(build_findings(fixtures.event_lines(spark, SMALL), fixtures.EVENT_THRESHOLDS, use_model=False)) + rows_of(
        build_findings(fixtures.order_lines(spark, SMALL), use_model=False)
    )
    assert together == sorted(alone)


def test_order_partitions_and_hot_limits_do_not_matter(spark, monkeypatch):
    lines = fixtures.event_lines(spark, SMALL)
    plain = rows_of(build_findings(lines, fixtures.EVENT_THRESHOLDS))
    monkeypatch.setattr(scale, "HOT_ROWS", 37)
    shuffled = rows_of(build_findings(lines.orderBy(F.rand(5)).repartition(13), fixtures.EVENT_THRESHOLDS))
    assert plain == shuffled


def test_model_flags_its_share_and_repeats(spark, both):
    from ledgerloom.operators.forest import ml_scores

    scores = ml_scores(both).collect()
    assert all(0 < r.score < 1 for r in scores)
    flagged = [r for r in scores if r.ledger_id == "EVT" and r.score >= r.threshold]
    assert len(flagged) == pytest.approx(0.02 * sum(r.ledger_id == "EVT" for r in scores), abs=3)
    again = {(r.ledger_id, r.voucher_id): r.score for r in ml_scores(LedgerFrames(both.lines.repartition(7), overrides=both.overrides)).collect()}
    assert all(again[r.ledger_id, r.voucher_id] == r.score for r in scores)


@pytest.mark.parametrize("hot", [None, 25])
def test_similar_entries_equal_brute_force(spark, both, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(scale, "HOT_ROWS", hot)
    every = both.vouchers.where(F.col("ledger_id") == "EVT")
    found = every.where(F.abs(F.xxhash64("voucher_id")) % 9 == 0)
    got = {}
    for r in similar.similar_entries(every, found).collect():
        got.setdefault(r.voucher_id, {})[r.similar_rank] = (r.similar_id, r.basis)
    pool = every.collect()
    for t in found.collect():
        rest = [v for v in pool if v.primary_account == t.primary_account and v.voucher_id != t.voucher_id]
        key = lambda v: (
            (v.debit_accounts, v.credit_accounts) != (t.debit_accounts, t.credit_accounts),
            round(abs(math.log10(max(v.amount_paise, 1)) - math.log10(max(t.amount_paise, 1))), 12),
            abs((v.voucher_date - t.voucher_date).days), v.voucher_id,
        )
        want = [v.voucher_id for v in sorted(rest, key=key)[:3]]
        assert [got[t.voucher_id][n][0] for n in sorted(got.get(t.voucher_id, {}))] == want


def test_similar_entries_in_one_crowded_cell(spark, book):
    for n in range(300):
        book.add("L", f"V{n:03d}", amount=500, date="2024-06-12")
    vouchers = LedgerFrames(book.frame(spark)).vouchers
    got = similar.similar_entries(vouchers, vouchers.where("voucher_id in ('V000', 'V200')")).orderBy("voucher_id", "similar_rank").collect()
    assert [r.similar_id for r in got] == ["V001", "V002", "V003", "V000", "V001", "V002"]


def test_decisions_append_and_the_latest_counts(spark):
    cols = "engagement_id string, voucher_id string, sequence bigint, action string, reviewer string, note string, adjusted_band string, decided_at timestamp_ntz"
    import datetime as dt

    at = lambda h: dt.datetime(2024, 6, 1, h)
    trail = spark.createDataFrame([("E", "V1", 1, "accept", "R", None, None, at(1))], cols)
    more = spark.createDataFrame(
        [("E", "V1", 0, "reject", "R", "agreed to invoice", None, at(3)), ("E", "V2", 0, "reject", "R", "no", None, at(2)),
         ("E", "V3", 0, "adjust", "R", None, "low", at(2)), ("E", "V4", 0, "adjust", "R", None, None, at(2))], cols,
    ).drop("sequence")
    added = review.append_decisions(trail, more).select(trail.columns)
    now = {r.voucher_id: (r.sequence, r.action) for r in review.current_decisions(trail.unionByName(added)).collect()}
    assert now == {"V1": (3, "reject"), "V3": (2, "adjust")}


def test_digest_ignores_order_and_provenance_but_not_content(spark, book):
    lines = book.add("L", "V1").add("L", "V2", amount=5).add("M", "V1").frame(spark)
    read = lambda df: {r.ledger_id: r.digest for r in digest.ledger_digest(df).collect()}
    first = read(lines)
    assert read(lines.orderBy(F.desc("line_id")).repartition(3).withColumn("source_row", F.lit(9).cast("bigint"))) == first
    assert read(lines.withColumn("narration", F.lit("x")))["L"] != first["L"]


def test_queue_quality_on_a_known_queue(spark):
    q = spark.createDataFrame([("L", f"V{n:02d}", n) for n in range(1, 31)], "ledger_id string, voucher_id string, rank int")
    good = spark.createDataFrame([("L", f"V{n:02d}") for n in (2, 4, 30, 99)], "ledger_id string, voucher_id string")
    r = evaluation.queue_quality(q, good).first()
    assert (r.queue, r.p_at_10, r.first_hit, r.items_for_95pct, r.recall) == (30, 0.2, 2, None, 0.75)
    with pytest.raises(evaluation.TuningLedgerError):
        evaluation.require_heldout(q, q)


def test_ablation_only_moves_what_it_should(spark, both):
    truth = fixtures.event_truth(spark, SMALL)
    got = {(r.ledger_id, r.variant): r for r in evaluation.ablation(both, evaluation.anomalous(truth), use_model=False).collect()}
    full, bare = got["EVT", "full"], got["EVT", "no evidence at all"]
    assert full.queue >= bare.queue and full.queue == got["EVT", "unranked"].queue and full.recall == got["EVT", "unranked"].recall


def test_thresholds_are_checked(spark):
    with pytest.raises(ValueError):
        Thresholds(off_hours_start=5, off_hours_end=6)
    with pytest.raises(ValueError):
        Thresholds(approval_limit_paise=5, threshold_band_paise=6)
    bad = threshold_frame(spark, {"L": Thresholds()}).withColumn("threshold_band_paise", F.lit(10**9).cast("bigint"))
    assert [r.problem for r in threshold_problems(bad).collect()] == ["band_wider_than_limit"]


def test_findings_keep_their_evidence(spark, both):
    hits = all_hits(both, use_model=False)
    found = fusion.findings(hits, both.context(*EVERYTHING))
    seen = fusion.with_signals(found, hits).limit(200).collect()
    for r in seen:
        downs = [s.contribution for s in r.signals]
        assert downs == sorted(downs, reverse=True) and [s.kind for s in r.signals] and set(r.kinds) == {s.kind for s in r.signals}
    assert list(itertools.chain(*[r.missing for r in seen]))


def test_every_variant_is_the_queue_made_alone(spark, both):
    hits = scale.stage(all_hits(both, use_model=False, detail=False))
    context = both.context(*EVERYTHING)
    got = {}
    for r in evaluation.variant_queues(hits, context.select("ledger_id", "voucher_id", *evidence_columns())).collect():
        got.setdefault(r.variant, set()).add((r.ledger_id, r.voucher_id, r["rank"]))
    rules = hits.where("kind <> 'missing_evidence'")
    alone = {
        "full": fusion.queue(fusion.findings(hits, context)),
        "no evidence uplift": fusion.queue(fusion.findings(hits, context, use_evidence=False)),
        "no evidence at all": fusion.queue(fusion.findings(rules, context, use_evidence=False)),
        "no model": fusion.queue(fusion.findings(hits, context)),
        "unranked": evaluation.unranked(fusion.findings(hits, context)),
    }
    assert set(got) == set(alone)
    for variant, one in alone.items():
        assert got[variant] == {(r.ledger_id, r.voucher_id, r["rank"]) for r in one.collect()}, variant


def test_pages_owners_totals_and_sides(spark, book):
    queue = spark.createDataFrame([("L", f"V{n}", n) for n in range(1, 8)], "ledger_id string, voucher_id string, rank int")
    assert [r["rank"] for r in review.page(queue, 2, 3).orderBy("rank").collect()] == [4, 5, 6]
    assert review.page(queue, 4, 3).count() == 0
    owners = spark.createDataFrame([("E1", "U1"), ("E2", "U2"), ("E3", None)], "id string, owner_id string")
    assert [r.id for r in review.owner_scope(owners, "U2").collect()] == ["E2"] and review.owner_scope(owners, None).count() == 3
    hits = spark.createDataFrame(
        [("L", "B", "x", 0.5), ("L", "A", "x", 0.25), ("L", "A", "y", 0.25), ("M", "C", "x", 0.1)],
        "ledger_id string, voucher_id string, kind string, strength double",
    )
    assert {(r.voucher_id, r["rank"]) for r in fusion.by_total_strength(hits).collect()} == {("A", 1), ("B", 2), ("C", 1)}
    lines = book.add("L", "V1").add("L", "V1", credit="3000", document_ref=" ").frame(spark)
    assert vouchers.distinct_sides(lines).count() == 1 and vouchers.distinct_sides(lines, "credit_paise").count() == 2
    said = {(r.line_id, r.signed_paise > 0, r.has_evidence) for r in vouchers.line_properties(lines).collect()}
    assert said == {("V1-01", True, True), ("V1-02", False, True), ("V1-01", True, False), ("V1-02", False, False)}


def test_similar_entries_on_amounts_of_many_days(spark, book):
    """An amount that recurs daily: the nearest days on both sides, ties to the smaller id."""
    for n in range(120):
        book.add("L", f"V{n:03d}", amount=700 if n % 2 else 701, date=str(dt.date(2024, 4, 1) + dt.timedelta(days=3 * n)))
    every = LedgerFrames(book.frame(spark)).vouchers
    got = {}
    for r in similar.similar_entries(every, every, k=4).collect():
        got.setdefault(r.voucher_id, []).append((r.similar_rank, r.similar_id))
    for n in range(120):
        same = sorted((abs(m - n), m) for m in range(n % 2, 120, 2) if m != n)[:4]
        assert [i for _, i in sorted(got[f"V{n:03d}"])] == [f"V{m:03d}" for _, m in same]


def test_similar_entries_ask_only_amounts_within_reach(spark, book):
    """A finding with enough vouchers at its own amount asks for no other; a lone one for those its nearest need."""
    for n in range(12):
        book.add("L", f"C{n:02d}", amount=1_000, date="2024-06-12")
        book.add("L", f"S{n:02d}", amount=2_000 + n, date="2024-06-12")
    vouchers = LedgerFrames(book.frame(spark)).vouchers
    group = ["ledger_id", "primary_account"]
    cells = similar.cells_of(vouchers, group, 4)
    wanted = vouchers.where("voucher_id in ('C03', 'S06')")
    near = {r.amount_paise: r.near for r in similar.neighbouring_amounts(cells, wanted, group, 4).collect()}
    assert [x.amount_paise for x in near[1_000]] == [1_000] and near[1_000][0].n == 4
    assert [x.amount_paise for x in near[2_006]] == [2_006, 2_007, 2_005, 2_008]
    assert [[c.voucher_id for c in x.few] for x in near[2_006]] == [["S06"], ["S07"], ["S05"], ["S08"]]
    got = similar.similar_entries(vouchers, wanted).orderBy("voucher_id", "similar_rank").collect()
    assert [r.similar_id for r in got] == ["C00", "C01", "C02", "S07", "S05", "S08"]


def test_cells_of_a_large_group_are_dealt_to_several_tasks(spark, book):
    """A join on the group leaves it in one task; its cells are sorted in more than that one."""
    for n in range(64):
        book.add("L", f"V{n:03d}", amount=500 + n)
    vouchers = LedgerFrames(book.frame(spark)).vouchers
    group = ["ledger_id", "primary_account"]
    one_group = vouchers.join(vouchers.select(*group).distinct().hint("merge"), group, "left_semi")
    kinds = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = similar.parts_of(one_group, group).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kinds)
    assert held > 1


def test_similar_entries_leave_no_finding_out(spark, book, monkeypatch):
    """Findings of every band are looked up, and those that debit no account, among their like."""
    from checks import queries

    for n in range(4):
        book.add("L", f"N{n}", amount=1_000 + n)
        book.add("L", f"Z{n}", amount=0)
    frames = LedgerFrames(book.frame(spark))
    found = frames.vouchers.select("ledger_id", "voucher_id").withColumn(
        "band", F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "low"])), F.substring("voucher_id", 2, 1).cast("int") + 1)
    )
    own = queries.Book(spark, "own")
    own.__dict__.update(frames=frames, found=found)
    monkeypatch.setattr(queries.Book, "_open", {(spark.sparkContext.applicationId, "own"): own})
    got = {}
    for r in queries.QUERIES["similar_entries"](spark, "own").orderBy("voucher_id", "similar_rank").collect():
        got.setdefault(r.voucher_id, []).append(r.similar_id)
    assert got == {
        "N0": ["N1", "N2", "N3"], "N1": ["N2", "N0", "N3"], "N2": ["N3", "N1", "N0"], "N3": ["N2", "N1", "N0"],
        **{f"Z{n}": [f"Z{m}" for m in range(4) if m != n] for n in range(4)},
    }
