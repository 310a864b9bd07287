"""Small fixtures with known outcomes, one per rule that is easy to get wrong."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from belegwerk import model
from belegwerk.codelists import CodeLists, is_unit, load_codes
from belegwerk.functions import jcs, normalize as N, text
from belegwerk.operators import amounts, audit, claims, costs, evidence, findings, limits, ordering, scoring
from belegwerk.sources import extractions, records, validator_reports

PAGES = [
    (1, 1, "Südlicht Buchhandel GmbH · Kanalstraße 8\nRechnung Nr. B-2024-7718\nDatum: 01.10.2026"),
    (1, 2, "IBAN: DE79 0000 0000 1234 5678 90\nGesamtbetrag 1.190,00 EUR"),
]
PAGE_DDL = "doc_id int, page int, text string"
FACT_DDL = "doc_id int, path string, value string, quote string, page int"


def test_evidence_decisions(spark):
    cases = [
        ("a", "B-2024-7718", "Rechnung Nr. B-2024-7718", 1, None), ("b", "B-2024-7718", "rechnung  nr.\nB-2024-7718", 1, None),
        ("c", "DE79", "IBAN: DE7900000000123456789 0", 2, None), ("d", "01.10.2026", "Rechnung Nr. B-2024-7718\\nDatum: 01.10.2026", 1, None),
        ("e", "1.190,00", "Gesamtbetrag 1.190,00 EUR", 1, "quote-not-on-page"), ("f", "B-2024-7791", "Rechnung Nr. B-2024-7718", 1, "value-not-in-quote"),
        ("g", "x", "x", 3, "page-out-of-range"), ("h", "x", "  ", 1, "empty-quote")]
    facts = spark.createDataFrame([(1, p, v, q, g) for p, v, q, g, _ in cases] + [(1, "blank", " ", "x", 9)], FACT_DDL)
    ok, rejected = evidence.check_evidence(facts, spark.createDataFrame(PAGES, PAGE_DDL))
    got = {r.path: r.reason for r in rejected.collect()} | {r.path: None for r in ok.collect()}
    assert got == {p: reason for p, _, _, _, reason in cases}


def test_canonical_text_takes_the_slow_path_only_where_needed(spark):
    given = [("plain – „x“",), ("ﬁx ² ½ Ａ",), ("a\\nb \t c",), (None,)]
    got = [r.c for r in spark.createDataFrame(given, "t string").select(text.canonical("t").alias("c")).collect()]
    assert got == ['plain - "x"', "fix 2 1⁄2 a", "a b c", None]


def test_overlapping_count_against_brute_force(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choices("ab.\\E", k=30)), "".join(rng.choices("ab.\\E", k=rng.randint(1, 3)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "t string, q string").select("t", "q", text.overlapping_count(F.col("t"), F.col("q")).alias("n")).collect()
    for r in got:
        assert r.n == sum(r.t.startswith(r.q, i) for i in range(len(r.t))), (r.t, r.q)


def _party(prefix, **given):
    paths = {"name": "name", "street": "address.line1", "city": "address.city", "postcode": "address.postcode", "ea": "electronicAddress.value"}
    return [(f"{prefix}.{paths[k]}", v, q) for k, (v, q) in given.items()]


def _losers(spark, lines, facts):
    pages = spark.createDataFrame([(1, 1, "\n".join(lines))], PAGE_DDL)
    table = spark.createDataFrame([(1, p, v, q, 1) for p, v, q in facts], FACT_DDL)
    return {(r.party, r.key) for r in evidence.resolve_shared_address(table, pages).collect()}


def test_shared_address_lines(spark):
    seller = dict(name=("Ulmenhof", "Ulmenhof"), street=("Weg 1", "Weg 1"))
    buyer = dict(name=("Gemeinde", "Gemeinde"), street=("Markt 3", "Markt 3"))
    place = ("Birkenau", "12345 Birkenau")
    code = ("12345", "12345 Birkenau")
    block = ["Ulmenhof", "Weg 1", "Rechnung", "-", "-", "Gemeinde", "Markt 3", "12345 Birkenau", "post@gemeinde.example"]
    both = _party("seller", **seller, city=place, postcode=code) + _party("buyer", **buyer, city=place, postcode=code)
    assert _losers(spark, block, both) == {("seller", "city"), ("seller", "postcode")}
    assert _losers(spark, block[:2] + ["12345 Birkenau"] + block[2:], both) == set()
    assert _losers(spark, ["12345 Birkenau"], _party("seller", city=place) + _party("buyer", city=place)) == {("seller", "city"), ("buyer", "city")}
    mail = ("post@gemeinde.example", "post@gemeinde.example")
    assert _losers(spark, block, _party("seller", **seller, ea=mail) + _party("buyer", **buyer)) == {("seller", "electronicAddress")}
    assert _losers(spark, block, _party("seller", **seller) + _party("buyer", **buyer, ea=mail)) == set()


def test_claim_owner_stays_owner_and_same_kind_may_share(spark):
    rows = [(1, p, v, v, 1) for p, v in (
        ("seller.electronicAddress.value", "a@b.example"), ("seller.contact.email", "a@b.example"), ("seller.address.city", "Birkenau"), ("buyer.address.city", "Birkenau"))]
    kept, rejected = claims.claim_evidence(spark.createDataFrame(rows, FACT_DDL))
    assert {(r.path, r.reason) for r in rejected.collect()} == {("seller.contact.email", "same evidence already used for BT-34")}
    assert kept.count() == 3


def test_line_net_rounds_half_up_once(spark):
    rng = random.Random(3)
    from decimal import ROUND_HALF_UP, Decimal, getcontext
    getcontext().prec = 60
    rows = [("5127.58", "0.19", None), ("1", "0.01499999", "3"), ("-1", "0.005", None), ("1", "0.014999", "3"), ("2", "0.00749999", "3.0"),
            ("1000000", "0.0000004", None), ("999999999999.999999", "0.00000001", "7"), ("100", "99999999999.99999999", "1000000")]
    rows += [(str(rng.randint(-999, 9999)), f"{rng.randint(0, 10**8) / 10**4:.4f}", str(rng.randint(1, 1000))) for _ in range(500)]
    df = spark.createDataFrame(rows, "quantity string, net_price string, price_base_quantity string")
    for r in amounts.derive_line_net(df).collect():
        want = (Decimal(r.quantity) * Decimal(r.net_price) / Decimal(r.price_base_quantity or "1")).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert r.net_amount == want, r


def test_every_line_has_an_amount_or_is_named(spark):
    rows = [("1000000000000", "1", None, "quantity"), ("1", "0.123456789", None, "net_price"), ("x", "1", None, "quantity"), ("2", "3", "0", "net_amount"),
            ("999999999999", "99999999999", None, "net_amount"), ("1", "2", "1.0000001", "price_base_quantity"), ("1.5000000000000000000000", "2", "", None),
            ("0.0000000000000000000000001", "2", None, "quantity"), ("1.2500000000", "2.50", None, None), ("-3", "0.00000001", "2", None)]
    df = spark.createDataFrame([(1, i, *r[:3], "S", "19") for i, r in enumerate(rows)], "doc_id int, line_index int, quantity string, net_price string, price_base_quantity string, vat_category string, vat_rate string")
    nets = amounts.derive_line_net(df)
    kept = {r.line_index for r in nets.collect() if r.net_amount is not None}
    refused = {r.line_index: r.field for r in amounts.refused_amounts(df).collect()}
    assert kept == {6, 8, 9} and refused == {i: r[3] for i, r in enumerate(rows) if r[3]}
    # What is not known does not pass for a smaller sum, and it blocks the document.
    assert [r.taxable_amount for r in amounts.vat_breakdown(nets).collect()] == [None]
    assert amounts.invoice_totals(amounts.vat_breakdown(nets)).first().grand_total is None
    printed = df.select("doc_id", "line_index", F.lit("1.00").alias("amount"))
    assert {r.line_index for r in amounts.check_lines(printed, nets).collect()} == set(range(10))


def test_null_keys_and_buckets_are_kept_in_order(spark):
    rows = [(None, 1, 5), (None, None, 6), ("a", None, 7), ("a", 2, 8), ("a", 2, 9)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    order, bucket = [F.col("t"), F.col("v")], [F.expr("t div 2")]
    placed = {(r.k, r.v): r.i for r in ordering.index_rows(df, ["k"], order, bucket, "i").collect()}
    assert placed == {(None, 6): 0, (None, 5): 1, ("a", 7): 0, ("a", 8): 1, ("a", 9): 2}
    before = {(r.k, r.v): r.s for r in ordering.sum_before(df, ["k"], order, bucket, "v", "s").collect()}
    assert before == {(None, 6): 0, (None, 5): 6, ("a", 7): 0, ("a", 8): 7, ("a", 9): 15}
    calls = df.selectExpr("v as call_id", "cast(null as timestamp_ntz) as ts", "cast(v as decimal(18,8)) as cost")
    assert costs.budget_admission(calls, "12").count() == 5


def test_claims_keep_every_fact(spark):
    rows = [(1, "seller.contact.email", "a@b.example", None, 1), (1, "seller.electronicAddress.value", "a@b.example", None, 1),
            (1, "seller.address.city", None, "x", 1), (1, "number", "1", "1", 1), (None, "dueDate", None, None, None)]
    kept, rejected = claims.claim_evidence(spark.createDataFrame(rows, FACT_DDL))
    assert kept.count() + rejected.count() == 5 and [r.path for r in rejected.collect()] == ["seller.contact.email"]


def test_a_rejecting_report_stays_one(spark):
    body = lambda said: f'<rep:report xmlns:rep="http://r"><rep:scenarioMatched><t><![CDATA[<accept >]]></t></rep:scenarioMatched><rep:assessment><rep:{said}><a/></rep:{said}></rep:assessment></rep:report>'
    rows = spark.createDataFrame([(1, body("reject"), None), (2, body("accept"), None), (3, "<rep", None), (4, None, None)], "doc_id int, report string, processing_errors array<string>")
    assert {r.doc_id: r.valid for r in validator_reports.parse_validator_reports(rows)[0].collect()} == {1: False, 2: True, 3: False, 4: False}


def test_breakdown_groups_by_value_and_keeps_missing_rates_apart(spark):
    rows = [(1, 0, "S", "19"), (1, 1, "S", "19.00"), (1, 2, "O", None), (1, 3, "Z", "0")]
    nets = spark.createDataFrame([(*r, "10.00") for r in rows], "doc_id int, line_index int, vat_category string, vat_rate string, n string").withColumn("net_amount", F.col("n").cast("decimal(18,2)"))
    got = {(r.vat_category, r.rate, r.no_rate): (str(r.taxable_amount), str(r.tax_amount)) for r in amounts.vat_breakdown(nets).collect()}
    assert got == {("S", "19", False): ("20.00", "3.80"), ("O", "0", True): ("10.00", "0.00"), ("Z", "0", False): ("10.00", "0.00")}


def test_canonical_json_numbers_and_keys():
    assert jcs.canonical_json(json.loads('{"b":1e3,"a":[1.50,-0.0,1e21,1e-7,123456789012345680000,0.000001],"é":"\\u001f\\n€"}')) == (
        '{"a":[1.5,0,1e+21,1e-7,123456789012345680000,0.000001],"b":1000,"é":"\\u001f\\n€"}')


def test_chain_of_free_form_events(spark):
    events = [("r", i, f"2026-01-01T00:00:0{i}.000Z", t, '{"version":"0.1.0","kind":"core"}', h, None, d) for i, (t, h, d) in enumerate((
        ("INGEST", "sha256:ab", '{"pages": 2}'), ("EXTRACT", None, '{"z":{"b":1e3,"a":"ü\\n"},"list":[1,2.50]}'), ("OUTPUT", None, None)))]
    df = spark.createDataFrame(events, "run_id string, seq int, ts string, type string, actor string, input_hash string, output_hash string, data string")
    rows = audit.build_audit_chain(df).orderBy("seq").collect()
    last = model.GENESIS_HASH
    for r in rows:
        parsed = json.loads(r.line)
        claimed = parsed.pop("hash")
        assert parsed["prevHash"] == last
        last = "sha256:" + hashlib.sha256(jcs.canonical_json(parsed).encode()).hexdigest()
        assert claimed == last == r.hash
    streamed = {r.seq: r.hash for r in audit.build_audit_chain(df.repartition(5)).collect()}
    assert streamed == {r.seq: r.hash for r in rows}
    lines = spark.createDataFrame([("r", r.seq, r.line) for r in rows], "run_id string, line_no int, line string")
    decision = audit.verify_audit_chain(audit.parse_audit_lines(lines), df.select("run_id").distinct()).first()
    assert decision.ok and decision.events == 3 and decision.reason is None


def test_prices(spark):
    calls = spark.createDataFrame([(1, "nvidia/nemotron-3-super-120b-a12b", 10**6, 10**6), (2, "nvidia/nemotron-3-super-120b-a12b", 63, 34), (3, "other", 1, 1)], "id int, model string, prompt_tokens long, completion_tokens long")
    priced, refused = costs.price_calls(calls)
    assert {r.id: str(r.cost) for r in priced.collect()} == {1: "1.20000000", 2: "0.00004950"}
    assert [r.error for r in refused.collect()] == ['No pinned price for model "other"']


def test_budget_rolls_over_at_midnight(spark):
    rows = [(1, "2026-01-01 23:58:00", "1.5"), (2, "2026-01-01 23:59:00", "1.0"), (3, "2026-01-01 23:59:30", "0.1"), (4, "2026-01-02 00:03:00", "0.1")]
    calls = spark.createDataFrame(rows, "call_id int, t string, c string").select("call_id", F.col("t").cast("timestamp_ntz").alias("ts"), F.col("c").cast("decimal(18,8)").alias("cost"))
    assert {r.call_id: r.admitted for r in costs.budget_admission(calls, "2.00").collect()} == {1: True, 2: True, 3: False, 4: True}


def test_rate_limit_forgets_refused_requests(spark):
    at = [0, 10, 20, 3_600_000, 3_600_001, 3_600_010]
    got = limits.rate_limit(spark.createDataFrame([("ip", i, t) for i, t in enumerate(at)], "key string, request_id long, at_ms long"), limit=2).orderBy("request_id").collect()
    assert [(r.admitted, r.retry_after_s) for r in got] == [(True, 0), (True, 0), (False, 3600), (True, 0), (False, 1), (True, 0)]


def test_positions_and_sums_do_not_depend_on_buckets(spark):
    rng = random.Random(5)
    rows = [(1 if i % 3 else i % 7, rng.randint(0, 50), i, rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, a int, b int, v int")
    order = [F.col("a"), F.col("b")]
    placed = {(r.k, r.b): r.i for r in ordering.index_rows(df, ["k"], order, [F.expr("a div 8")], "i").collect()}
    sums = {(r.k, r.b): r.s for r in ordering.sum_before(df, ["k"], order, [F.expr("a div 8")], "v", "s").collect()}
    for k in {r[0] for r in rows}:
        total = 0
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            assert placed[(k, r[2])] == i and sums[(k, r[2])] == total
            total += r[3]


def test_page_text_from_items(spark):
    items = [(0, "A", 700.0, False), (1, "B", 700.5, False), (2, "  ", 10.0, True), (3, "C", 700.5, False), (4, "D", 650.0, False)]
    df = spark.createDataFrame([(1, 1, *i) for i in items] + [(2, 1, 0, " ", 0.0, False)], "doc_id int, page int, seq int, str string, y double, has_eol boolean")
    assert {r.doc_id: r.text for r in extractions.assemble_page_text(df).collect()} == {1: "A B\nC\nD", 2: ""}


def test_last_exemption_of_a_category_wins(spark):
    inv = spark.createDataFrame([(1,)], "doc_id int").select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("number", "issue_date", "currency", "due_date", "buyer_reference", "order_reference", "payment_terms")],
                                                             F.lit(None).cast(model.SELLER_DDL).alias("seller"), F.lit(None).cast(model.BUYER_DDL).alias("buyer"), F.lit(None).cast(model.PAYMENT_DDL).alias("payment"))
    lines = spark.createDataFrame([(1, 0, "1", "x", "1.50", "H87", "2.00", None, "E", "-0.00")], model.LINE_DDL.replace("doc_id string", "doc_id int"))
    ex = spark.createDataFrame([(1, 0, "E", "first", "C"), (1, 1, "E", "second", None)], model.EXEMPTION_DDL.replace("doc_id string", "doc_id int"))
    got = {r.key: r.value for r in scoring.flatten_facts(inv, lines, ex).collect()}
    assert got["BT-120[E]"] == "second" and got["BT-121[E]"] == "C" and got["BT-129#0"] == "1.5" and got["BT-146#0"] == "2" and got["BT-152#0"] == "-0"


def test_summary_uses_the_lower_median(spark):
    rows = [(i, "OUTPUT", True, 0, "0.001", ms, 10, 9, 1, True, True) for i, ms in enumerate((5, 1, 9, 7))]
    df = spark.createDataFrame(rows, "doc_id int, state string, valid boolean, iterations int, cost string, ms long, fields_total long, fields_correct long, fields_invented long, totals_correct boolean, as_expected boolean").withColumn("fields_without_provenance", F.lit(0))
    row = scoring.summarize_eval(df).first()
    assert (row.median_ms, row.gate_pass, str(row.total_cost)) == (5, 4, "0.0040")


def test_unknown_rules_first_three_per_run(spark):
    rows = [("r", i, f"X-{i % 5}", "error", f"m{i}") for i in range(10)] + [("r", -1, "BR-02", "error", "known"), ("r", -2, "X-9", "warning", "w")]
    got = findings.unknown_rules(spark.createDataFrame(rows, "run_id string, seq int, rule_id string, severity string, message string")).orderBy("position").collect()
    assert [(r.rule_id, r.message) for r in got] == [("X-0", "m0"), ("X-1", "m1"), ("X-2", "m2")]


def test_code_list_from_a_file(spark, tmp_path):
    (tmp_path / "units.csv").write_text("code,name\nH87,piece\n4K,milliampere\n", encoding="utf-8")
    units = load_codes(spark, str(tmp_path / "units.csv"))
    row = spark.range(1).select(N.unit(F.lit("x (4k)"), CodeLists(units=units)).alias("n")).first()
    assert units == ("4K", "H87") and row.n.value == "4K"


def test_units_are_the_whole_official_list(spark):
    lists = CodeLists()
    assert len(lists.units) == len(set(lists.units)) == 2162
    codes = spark.createDataFrame([(c,) for c in lists.units] + [("XXE",), ("BX",), ("NPR",), ("x (xxe)",)], "raw string")
    refused = {r.raw for r in codes.withColumn("n", N.unit(F.col("raw"), lists)).where("n.value is null").collect()}
    assert refused == {"XXE", "BX", "NPR", "x (xxe)"}
    lines = spark.createDataFrame([("d", k, c) for k, c in enumerate(["B22", "XXE", "XPP", "2N"])], "doc_id string, line_index int, unit_code string")
    bad = lines.where(~is_unit(F.col("unit_code"), lists)).collect()
    assert [r.unit_code for r in bad] == ["XXE"]


def test_corpus_files(spark, tmp_path):
    lost = {"id": "clean/b-classic", "set": "clean", "groundTruth": "clean/b-classic.json"}
    entry = {"id": "clean/a-classic", "set": "clean", "holdout": False, "invoiceId": "a", "groundTruth": "clean/a-classic.json", "sha256": "0"}
    (tmp_path / "clean").mkdir()
    (tmp_path / "manifest.json").write_text(json.dumps({"testsuite": "t", "generator": "g", "entries": [entry, lost]}), encoding="utf-8")
    (tmp_path / "clean" / "a-classic.json").write_text(json.dumps({"invoice": {"number": "R-1", "lines": [{"id": "1"}]}, "printed": {"grandTotal": "1.00"}}), encoding="utf-8")
    manifest, truth, unread = records.read_corpus(spark, str(tmp_path))
    (tmp_path / "clean" / "b-classic.json").write_text("{", encoding="utf-8")
    assert manifest.count() == 2 and [r.id for r in unread.collect()] == ["clean/b-classic"]
    assert [(r.id, r.invoice.number, r.printed.grandTotal) for r in truth.collect()] == [("clean/a-classic", "R-1", "1.00")]
