"""What queries carry and shuffle on the way, and that cheaper forms of a step are the same step."""

import re
import unicodedata
from datetime import date

from pyspark.sql import functions as F

from belegwerk import model
from belegwerk.functions import normalize
from belegwerk.functions.text import WS, canonical, nfkc, squeeze, squeeze_untidy, strip
from belegwerk.operators import amounts, corpus, evidence, scoring
from belegwerk.operators import tables as tables_of
from belegwerk.plans import queries_score, queries_text, views
from belegwerk.plans.bindings import Tables
from belegwerk.session import materialise_by
from belegwerk.sources import invoice_xml


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def carried(plan: str) -> list[str]:
    """What each Generate keeps of its input beside the rows it makes."""
    return [line.rsplit("], false, [", 1)[0].rsplit(", [", 1)[1] for line in plan.splitlines() if "Generate explode" in line or "Generate posexplode" in line]


def tables(spark, tmp_path) -> Tables:
    rows = [(7, "Ein Beleg aus 12345 Moorbach " * 40, 1160), (8, "kurz", 4), (9, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return Tables(spark, str(tmp_path))


def test_pieces_of_a_text_do_not_carry_it(spark, tmp_path):
    t = tables(spark, tmp_path)
    for df in (queries_text.quote_occurrences(t), queries_text.city_follows_postcode(t), t.quotes):
        kept = carried(plan_of(df))
        assert kept and all(re.fullmatch(r"doc_id#\d+L", k) for k in kept), kept


def test_pieces_are_the_same_as_cut_by_hand(spark, tmp_path):
    t = tables(spark, tmp_path)
    text = "Ein Beleg aus 12345 Moorbach " * 40
    quotes = [text[10 + 300 * i:13 + 300 * i] for i in range(1 + (len(text) - 11) // 300)]
    got = sorted(r.quote for r in queries_text.quote_occurrences(t).where("doc_id = 7").collect())
    assert got == sorted(quotes)
    whole = text.lower() + "summe: 1.160,50 € datum 04.04.2016"
    words = whole.split(" ")
    places = [(words[i + 1 if (7 + i) % 2 == 0 else i + 2], words[i]) for i in range(1, len(words), 20)]
    got = queries_text.city_follows_postcode(t).where("doc_id = 7").collect()
    assert sorted((r.city, r.postcode, r.follows) for r in got) == sorted((c, p, f"{p} {c}" in whole) for c, p in places)


def test_needles_and_texts_are_shuffled_once_each(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        needles = spark.createDataFrame([(1, "a"), (1, "a"), (1, ""), (2, "b"), (None, "a")], "doc_id bigint, needle string")
        texts = spark.createDataFrame([(1, "a ba"), (2, ""), (None, "a")], "doc_id bigint, text string")
        found = evidence.search(needles, texts, ["doc_id"])
        assert len(re.findall(r"Exchange hashpartitioning", plan_of(found))) == 2
        assert sorted(map(tuple, found.collect())) == [(1, "a", 2, True), (2, "b", 0, False)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_needles_of_a_text_come_in_packs(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PACK", 3)
    needles = spark.range(20).select(F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("string").alias("needle"))
    texts = spark.createDataFrame([(1, "0 1 12 19")], "doc_id bigint, text string")
    found = {r.needle: r.n for r in evidence.search(needles, texts, ["doc_id"]).collect()}
    assert found == {str(i): "0 1 12 19".count(str(i)) for i in range(20)}


def test_every_character_is_normalised_and_squeezed_as_it_should_be(spark):
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [0x1D400, 0x1F600, 0x2F800]
    rows = spark.createDataFrame([(c, f"a{chr(c)}{chr(c)} b") for c in points], "c int, s string")
    space = re.compile(f"[{WS}]+")
    for r in rows.select("c", "s", nfkc(F.col("s")).alias("n"), squeeze(F.col("s")).alias("q")).collect():
        assert r.n == unicodedata.normalize("NFKC", r.s), hex(r.c)
        assert r.q == space.sub(" ", r.s).strip(" "), hex(r.c)


def test_evidence_reads_pages_in_canonical_form_once(spark):
    pages = spark.createDataFrame([(1, 1, "Straße  1"), (2, 1, None)], "doc_id bigint, page int, text string")
    facts = spark.createDataFrame([(d, "p", "1", q, p) for d, q, p in ((1, "straße 1", 1), (1, "x", 1), (1, "x", 2), (2, "x", 1), (1, "  ", 2))],
                                  "doc_id bigint, path string, value string, quote string, page int")
    judged = evidence.evidence_problem_searched(facts, pages)
    assert sorted((r.doc_id, r.page, r.problem or "") for r in judged.collect()) == [
        (1, 1, ""), (1, 1, "quote-not-on-page"), (1, 2, "empty-quote"), (1, 2, "page-out-of-range"), (2, 1, "page-out-of-range")]


def test_variants_are_not_broadcast(spark):
    """Options of all variants have a text key and a row per document and variant: no task or driver holds them all."""
    from belegwerk.operators import tables as T
    flat = {c: F.lit("x") for _, c in T.HEADER_COLUMNS}
    invoices = T.nest_invoice(spark.range(3).select(F.col("id").alias("doc_id"), *[v.alias(c) for c, v in flat.items()]))
    ids = spark.range(2).withColumnRenamed("id", "doc_id")
    nets = ids.selectExpr("doc_id", "0 line_index", "'1' id", "'n' name", "'1' quantity", "'H87' unit_code", "'1' net_price", "null price_base_quantity",
                          "'S' vat_category", "'19' vat_rate", "cast(1 as decimal(18,2)) net_amount")
    breakdown = ids.selectExpr("doc_id", "'S' vat_category", "'19' rate", "false no_rate", "cast(1 as decimal(18,2)) taxable_amount", "cast(0.19 as decimal(18,2)) tax_amount", "0 first_line")
    totals = ids.selectExpr("doc_id", "cast(1 as decimal(18,2)) line_total", "cast(0.19 as decimal(18,2)) tax_total", "cast(1.19 as decimal(18,2)) grand_total")
    exemptions = ids.selectExpr("doc_id", "0 ex_index", "'E' category", "'r' reason", "null reason_code")
    pages = corpus.noise_variants(invoices, nets, breakdown, totals, exemptions)
    assert "BroadcastExchange" not in plan_of(pages)
    assert {(r.doc_id, r.page) for r in pages.collect()} == {
        (f"{v[0]}/{d}-{v[1]}", p) for d in range(3) for v in corpus.VARIANTS for p in ((1, 2) if v[6] else (1,))}


def test_canonical_form_of_every_character(spark):
    space, signs = re.compile(f"[{WS}]+"), str.maketrans("\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2018\u2019\u201c\u201d\u201e", "-------''\"\"\"")
    points = [c for c in [*range(0x20, 0x130), *range(0x1680, 0x1690), *range(0x2000, 0x2300), 0x3000, 0xFEFF]]
    rows = spark.createDataFrame([(c, s) for c in points for s in (f"a{chr(c)}b", f"{chr(c)}a b", f"a  {chr(c)}", f"a {chr(c)} b")], "c int, s string")
    for r in rows.select("c", "s", canonical("s").alias("t")).collect():
        assert r.t == space.sub(" ", unicodedata.normalize("NFKC", r.s).translate(signs)).strip(" ").lower(), hex(r.c)


def test_strip_takes_every_whitespace_from_the_ends_without_a_pattern(spark):
    space = re.compile(f"^[{WS}]+|[{WS}]+\\Z")
    points = [c for c in range(1, 0x3100)] + [0xFEFF, 0x1F600]
    rows = spark.createDataFrame([(f"{chr(c)} {chr(c)}a{chr(c)}b {chr(c)}",) for c in points] + [("",), (" \n ",)], "s string")
    shown = rows.select("s", strip(F.col("s")).alias("t"))
    assert "regexp_replace" not in plan_of(shown)
    for r in shown.collect():
        assert r.t == space.sub("", r.s), repr(r.s)
    assert rows.limit(1).select(strip(F.lit(None).cast("string"))).first()[0] is None


def test_plain_numbers_take_the_short_way_to_the_same_result(spark):
    """What the general rule makes of a number, it makes of it with a sign too: only there the short way is not taken."""
    given = ["0", "12", "007", "1,5", "1.234,50", "1.2.3,4", "12.345.678,90", "1..2,3", " 12,50\n", "9,", ",9", "1,2,3", "1.234", "1.2", "1,2.3", "", None]
    rows = spark.createDataFrame([(v, f) for v in given for f in ("de", "plain", None)], "v string, f string")
    two = rows.select("v", "f", normalize.decimal(F.col("v"), F.col("f")).alias("a"), normalize.decimal(F.concat(F.lit("+"), F.trim("v")), F.col("f")).alias("b"))
    for r in two.collect():
        assert r.a is None or (r.a.value, r.a.reason is None) == (r.b.value, r.b.reason is None), (r.v, r.f)


def test_only_shown_facts_are_shuffled_and_no_row_stands_for_an_empty_field(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.createDataFrame(
            [(1, "number", "R1", "evidence", 2), (1, "number", "R2", "user", 1), (1, "buyerReference", "", "derived", 1), (1, "lines.0.name", "x", "derived", 1),
             (2, "currency", "EUR", "derived", 1), (2, "issueDate", "", "derived", 1), (3, "number", "R3", None, None), (None, "number", "R4", "user", 1)],
            "doc_id bigint, path string, value string, kind string, page int")
        missing = spark.createDataFrame(
            [(1, "buyerReference"), (1, "buyerReference"), (2, "seller.electronicAddress"), (2, "lines.0.id"), (4, "number"), (None, "number")], "doc_id bigint, path string")
        docs = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "doc_id bigint")
        view = views.result_view(facts, missing, docs)
        plan = plan_of(view)
        assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, \d+\)", plan)) == len(re.findall("Exchange hashpartitioning", plan)) == 3
        two = [(2, "currency", "EUR", "calc", False), (2, "seller.electronicAddress.value", None, "—", True)]
        got = sorted(map(str, ((r.doc_id, r.path, r.value, r.mark, r.missing) for r in view.collect())))
        assert got == sorted(map(str, [
            (1, "buyerReference", None, "calc", True), (1, "number", "R1", "p.2", False), (1, "number", "R2", "you", False), *two, *two, (3, "number", "R3", "—", False)]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_number_is_read_exactly_or_not_at_all(spark):
    given = {
        "1.5": "1.500000", "0.0000005": None, "1.1234567": None, "1e-3": "0.001000", "12345678901234": None, "123456789012": "123456789012.000000",
        "0.0000000000000000001": None, "0.000000000000000000": "0.000000", "1.10000000000000000000": "1.100000", "1.1000000000000000001": None, "x": None, "": None}
    rows = spark.createDataFrame([(k,) for k in given], "v string").select("v", amounts.measure("v").cast("string").alias("n")).collect()
    assert {r.v: r.n for r in rows} == given


def test_only_shown_rows_are_collected(spark):
    compared = spark.createDataFrame([
        (1, "BT-1", "BT-1", "correct", "a", "a"), (1, "BT-2", "BT-2", "wrong", "b", "c"), (1, "BT-9", "BT-9", "invented", None, "d"),
        (1, "BT-3", "BT-3", "not extracted", "e", None), (2, "BT-1", "BT-1", "correct", "a", "a"), (None, "BT-1", "BT-1", "wrong", "a", "b")],
        "doc_id bigint, key string, term string, status string, want string, got string")
    runs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id bigint").selectExpr(
        "doc_id", "'OUTPUT' state", "'OUTPUT' expected", "cast(null as string) error", "true valid", "0 iterations", "0L fields_without_provenance",
        "0.0 cost", "1L ms", "'1' truth_grand", "'1' got_grand", "'1' truth_due", "'1' got_due")
    for given in (compared, scoring.for_counting(compared)):
        df = scoring.score_documents(given, runs)
        got = {r.doc_id: (r.fields_total, r.fields_correct, r.fields_invented, r.invented_keys, r.wrong_keys) for r in df.collect()}
        assert got == {1: (3, 1, 1, ["BT-9=d"], ["BT-2: c (truth b)"]), 2: (1, 1, 0, [], []), 3: (0, 0, 0, [], []), None: (0, 0, 0, [], [])}
        # A list is collected behind a filter, the counts are not.
        assert "status" in re.search(r"pushed|Filter .*status.*IN .*|Filter .*\bin\b.*", plan_of(df), re.I).group(0)


def test_lines_travel_as_numbers(spark, tmp_path):
    rows = [(1, 5, 6, 2, 3.0, 10.5, 0.0, 0.19, "N", "O", None), (1, 7, 6, 1, 2.0, 1.25, 0.0, 0.0, "R", "O", None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = Tables(spark, str(tmp_path)).lazy_lines
    plan = plan_of(lines)
    assert "Artikel" in plan and "Artikel" not in plan[plan.index("Exchange hashpartitioning"):]
    got = sorted(tuple(r) for r in lines.select("doc_id", "line_index", "id", "name", "quantity", "unit_code", "net_price", "price_base_quantity", "vat_category", "vat_rate").collect())
    assert got == [(1, 0, "1", "Artikel 7", "2", "H87", "1.25", None, "O", None), (1, 1, "2", "Artikel 5", "3", "HUR", "10.50", "2", "S", "19.00")]


def test_tables_stored_by_a_key_meet_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "d"), (1, 0, "a")], "doc_id bigint, line_index int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = materialise_by(rows, "kept", "doc_id", "line_index")
        assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
        met = kept.join(kept.withColumnRenamed("v", "w"), ["doc_id", "line_index"], "full_outer")
        assert "Exchange" not in plan_of(met) and met.count() == 4 + 1 + 1 + 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_values_that_differ_in_spaces_alone_are_the_same(spark):
    names = [p for p, _ in tables_of.HEADER_COLUMNS]
    kinds = "doc_id bigint, " + ", ".join(f"`{c}` string" for _, c in tables_of.HEADER_COLUMNS)
    one = lambda **v: tables_of.nest_invoice(spark.createDataFrame([(1, *[v.get(p) for p in names])], kinds))
    none = spark.createDataFrame([], model.LINE_DDL.replace("doc_id string", "doc_id bigint")), spark.createDataFrame([], model.EXEMPTION_DDL.replace("doc_id string", "doc_id bigint"))
    want = one(number="A  1 ", currency="EUR", dueDate="", buyerReference=" ", orderReference="x")
    got = one(number="A 1", currency="EUR", dueDate="d", buyerReference=None, orderReference="y ")
    rows = {r.key: (r.status, r.want, r.got) for r in scoring.compare_tables((want, *none), (got, *none)).collect()}
    assert rows == {"BT-1": ("correct", "A 1", "A 1"), "BT-5": ("correct", "EUR", "EUR"), "BT-9": ("invented", None, "d"),
                    "BT-10": ("not extracted", "", None), "BT-13": ("wrong", "x", "y")}


def test_tidy_texts_need_no_pattern(spark):
    odd = ["a b", " a", "a ", "a  b", "a\tb", "a\nb", "a\rb", "a\x0bb", "a\x0cb", "a\x00b", "a\x7fb", "A\\nB", "a b", "ﬁ", "„a“ –", "", " ", "Ä  ö", None, "Ω"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v string")
    rows = df.select("v", canonical("v").alias("c"), squeeze(F.col("v")).alias("s"), squeeze_untidy(F.col("v")).alias("u")).collect()
    spaces = re.compile("[" + WS.replace(r"\x0B", "\x0b") + "]+")
    for r in rows:
        assert r.s == r.u
        if r.v is None:
            assert r.c is None
        else:
            text = unicodedata.normalize("NFKC", r.v.replace("\\n", " ")).translate(str.maketrans("–„“", '-""'))
            assert r.c == spaces.sub(" ", text).strip(" ").lower()


def test_headers_are_read_in_parts(spark):
    from belegwerk.plans import queries_repair
    t = Tables(spark, "/root/testdata/sf0.001")
    queries_repair.reading(t)
    assert "Bucketed: true" in plan_of(t.keyed_invoices.groupBy("doc_id").count()) and "invoices" not in vars(t)


def test_invented_facts_are_those_of_the_flat_facts_without_shuffling_them(spark):
    address = "struct<line1:string,line2:string,city:string,postcode:string,country_code:string>"
    head = tables_of.nest_invoice(spark.createDataFrame([(1,)], "doc_id bigint").select("doc_id", *[
        F.lit(None).cast("string").alias(c) for _, c in tables_of.HEADER_COLUMNS])).schema
    assert address in head.simpleString()
    blank = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,)], "doc_id bigint")
    facts = lambda **given: tables_of.nest_invoice(blank.select("doc_id", *[
        F.expr(given.get(c, "null")).cast("string").alias(c) for _, c in tables_of.HEADER_COLUMNS]))
    of_lines = lambda rows: spark.createDataFrame(rows, "doc_id bigint, line_index int, n string").select(
        "doc_id", "line_index", *[(F.col("n") if c in ("quantity", "name") else F.lit(None).cast("string")).alias(c) for _, _, c in model.LINE_FIELDS])
    of_ex = lambda rows: spark.createDataFrame(rows, "doc_id bigint, ex_index int, category string, reason string, reason_code string")
    want = (facts(number="case when doc_id = 1 then 'a' else '' end", currency="' '"), of_lines([(1, 0, ".0"), (1, 0, None), (1, 1, "x"), (None, 0, "1")]),
            of_ex([(1, 0, "E", "r", None), (1, 1, "E", "", "c"), (2, 0, None, "r", None)]))
    have = (facts(number="'b'", currency="'EUR'", issue_date="doc_id"), of_lines([(1, 0, "1.0"), (1, 0, "2"), (1, 1, "2"), (1, None, "3"), (None, 0, "1")]),
            of_ex([(1, 0, "E", "r", "d"), (2, 0, None, "r", "e"), (3, 0, "O", " ", "f")]))
    plain = scoring.invented_keys(scoring.flatten_facts(*want), scoring.flatten_facts(*have))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(scoring.invented_in_tables(want, have)) == rows(plain) != []
    stored = [(materialise_by(side[0], "i", "doc_id"), materialise_by(side[1], "l", "doc_id", "line_index"), side[2]) for side in (want, have)]
    # The exemptions of both sides are grouped and met; nothing else is moved.
    assert "BroadcastExchange" not in plan_of(scoring.invented_in_tables(*stored))
    assert len(re.findall("Exchange hashpartitioning", plan_of(scoring.invented_in_tables(*stored)))) <= 4
    assert rows(scoring.invented_in_tables(*stored)) == rows(plain)


def invoice_tables(spark, folder) -> Tables:
    given = {
        "nation": ("n_nationkey int, n_name string", [(1, "GERMANY")]),
        "customer": ("c_custkey bigint, c_name string, c_nationkey int", [(15, "Kunde", 1)]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", [(1, "Haus", 1)]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double", [(k, 15, date(2020, 1, k), 10.0 * k) for k in (1, 2, 3)]),
        "lineitem": ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_shipdate date, "
                     "l_tax double, l_returnflag string", [(k, n, n, 1, 3.0, 10.0 + k, date(2020, 2, 1), 0.07 * (n % 2), "E") for k in (1, 3) for n in (2, 1, 3)]),
    }
    for name, (kind, rows) in given.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def test_xml_lines_are_read_once_and_placed_once(spark, tmp_path):
    t = invoice_tables(spark, tmp_path)
    made = queries_score.written(t)
    # What is left to do reads the stored lines; only exemptions are still made from the given ones.
    assert len(re.findall(r"ReadSchema: struct<[^>]*l_returnflag", plan_of(made))) == 1 and "Window" not in plan_of(made)
    plain = invoice_xml.write_invoice_xml(queries_score.good_invoices(t), t.placed_nets, t.placed_breakdown, t.totals, t.exemptions)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(made) == rows(plain) and made.count() == 3
    assert made.where("xml like '%<ram:LineID>3</ram:LineID>%'").count() == 2
