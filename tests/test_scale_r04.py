"""What jobs keep, shuffle and read again on the way, and that cheaper forms of a step are the same step."""

import glob
import os

from pyspark.sql import functions as F

from belegwerk.functions.text import canonical
from belegwerk.operators import corpus, evidence, patches
from belegwerk.plans import assemble, queries_corpus, queries_repair, queries_score, views
from belegwerk.plans.bindings import Tables
from belegwerk.session import _storing, discard, materialise, materialise_by

from test_scale_r03 import invoice_tables, plan_of

BREAKS = ["Haus\nMarkt 1", "Haus\\nMarkt 1", "Haus", " Haus  am\tMarkt ", "ﬁrma\n\n", "\n", "\\n", "", None, "„Haus“ – 1 €", "Ａ̈\\nB", "＼n", "Ärger x"]


def rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shuffled_files(spark) -> set:
    jvm_dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in jvm_dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    before = shuffled_files(spark)
    settings = {k: spark.conf.get(k) for k in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.requireAllClusterKeysForCoPartition")}
    kept = materialise(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "kept")
    assert shuffled_files(spark) <= before and kept.count() == 10
    stored = materialise_by(spark.range(1000).withColumn("k", F.col("id") % 10), "stored", "k")
    left = shuffled_files(spark)
    again = materialise_by(stored.groupBy("k").count(), "again", "k", placed=True)
    assert shuffled_files(spark) == left and again.count() == 10
    assert settings == {k: spark.conf.get(k) for k in settings}
    path = stored._stored[0]
    discard(stored)
    assert not os.path.exists(path) and again.count() == 10


def test_tables_that_lie_by_document_are_joined_on_more_without_a_shuffle(spark):
    a = materialise_by(spark.range(100).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("n")), "a", "doc_id")
    joined = a.join(a.groupBy("doc_id", "n").count().hint("merge"), ["doc_id", "n"], "left")
    assert "Exchange" in plan_of(joined)
    with _storing(spark):
        assert "Exchange" not in plan_of(a.join(a.groupBy("doc_id", "n").count().hint("merge"), ["doc_id", "n"], "left"))


def test_marked_facts_hold_what_the_address_rule_compares(spark):
    paths = ("seller.name", "buyer.address.line1", "paymentTerms")
    facts = spark.createDataFrame([(i, p, a, b) for i, (p, a, b) in enumerate((p, a, b) for p in paths for a in BREAKS for b in BREAKS[:4])],
                                  "doc_id bigint, path string, value string, quote string")
    marked = evidence.marked_facts(facts)
    assert rows(marked.select("doc_id", "value_c", "quote_c")) == rows(facts.select("doc_id", canonical("value"), canonical("quote")))
    assert rows(evidence.party_claims(marked, ["doc_id"])) == rows(evidence.party_claims(facts, ["doc_id"]))


def test_read_pages_give_what_the_pages_give(spark):
    texts = [(1, 2, "Zweite „Seite“\n\n 1,50 €"), (1, 1, "Erste  Seite\\nx\n12.30 EUR"), (2, 1, None), (3, 1, "b"), (3, 1, "a"), (3, None, "ﬁ 3,20"), (None, 1, "z\t1.20")]
    pages = spark.createDataFrame([*texts, *[(10 + i, 1, b) for i, b in enumerate(BREAKS)]], "doc_id bigint, page int, text string")
    read = evidence.read_pages(pages)
    assert rows(evidence.lines_of_pages(read)) == rows(evidence.document_lines(pages))
    assert rows(evidence.text_of_pages(read).where("doc_id <> 3")) == rows(evidence.document_text(pages).where("doc_id <> 3"))
    assert rows(read.select("doc_id", "page", "text_c")) == rows(evidence.canonical_pages(pages))
    assert rows(evidence.number_format(read)) == rows(evidence.detect_number_format(pages))
    assert rows(read.groupBy("doc_id").agg(F.bool_or("eur_seen"))) == rows(evidence.currency_on_page(pages))
    facts = spark.createDataFrame([(d, "number", v, v, p) for d in (1, 2, 3, 4, None) for p in (1, 2, None) for v in ("seite", "a", "x", "", None)],
                                  "doc_id bigint, path string, value string, quote string, page int")
    near = evidence.evidence_problem_by_document(evidence.marked_facts(facts), read.select("doc_id", "page", "text_c")).drop("value_head", "quote_head")
    assert rows(near) == rows(evidence.evidence_problem(facts, evidence.canonical_pages(pages)).select(near.columns))


def test_the_assembly_moves_no_facts_and_keeps_no_spent_table(spark, tmp_path):
    t: Tables = invoice_tables(spark, tmp_path)
    given = queries_repair.reading(t)
    assert given["facts"].count() > 0 and "Bucketed: true" in plan_of(given["facts"].groupBy("doc_id").count())
    facts, read = assemble.read_texts(given["facts"], given["pages"])
    made = assemble.assemble_read(facts, read, given["line_ids"])
    assert not os.path.exists(facts._stored[0])
    plain = assemble.assemble_facts(materialise(given["facts"], "f"), given["line_ids"], materialise(given["pages"], "p"))
    for name in ("accepted", "rejected", "missing", "printed"):
        assert rows(made[name]) == rows(plain[name])
    assert made["accepted"].count() > 0 and "Exchange" not in plan_of(made["accepted"].groupBy("doc_id").count())


def test_printed_variants_are_not_shuffled(spark, tmp_path):
    t = invoice_tables(spark, tmp_path)
    made = queries_corpus.text_page_variants(t)
    assert "Exchange hashpartitioning" not in plan_of(made)
    assert {(r.doc_id, r.page) for r in made.collect()} == {
        (f"{v[0]}/{d}-{v[1]}", p) for d in (1, 3) for v in corpus.VARIANTS for p in ((1, 2) if v[6] else (1,))}


def test_pages_of_blocks_in_one_table_and_in_several(spark):
    """More rows than a piece holds, blocks in reverse, a split page, a row without text, an option that comes twice."""
    kind = "doc_id bigint, block int, seq int, text string"
    head, lines = [(d, b, s, f"{b}.{s}") for d in (1, 2) for b in (2, 0, 1) for s in (1, 0)], [(d, 3, s, f"l{s}") for d in (1, 2) for s in reversed(range(600))]
    rest = [(1, 4, 0, None), (2, 5, 0, "sum"), (3, 5, 0, "no option"), (None, 5, 0, "no number")]
    options = spark.createDataFrame([(1, True, False), (2, False, True), (2, False, True), (4, False, False)], "doc_id bigint, shuffled boolean, split boolean")
    several = corpus.text_pages([spark.createDataFrame(rows_, kind) for rows_ in (head, lines, rest)], options)
    text = "\n".join(f"l{s}" for s in range(600))
    twice = lambda lines_: "\n".join(x for line in lines_.split("\n") for x in (line, line))
    assert rows(several) == [(1, 1, "2.0\n2.1\n1.0\n1.1\n0.0\n0.1\n" + text + "\n"), (2, 1, twice("0.0\n0.1\n1.0\n1.1\n2.0\n2.1")), (2, 2, twice(text + "\nsum"))]
    assert rows(corpus.text_pages([spark.createDataFrame([*head, *lines, *rest], kind)], options)) == rows(several)


def test_rounds_move_no_facts_and_judge_a_patch_once(spark, tmp_path):
    t = invoice_tables(spark, tmp_path)
    given = queries_repair.repair_input(t)
    assert all("Bucketed: true" in plan_of(given[k].groupBy("doc_id").count()) for k in ("facts", "printed_lines", "line_ids"))
    kind = "doc_id bigint, seq int, op string, path string, value string, quote string, page int"
    plan = spark.createDataFrame([(1, 0, "add", "/orderReference", "PO-7", "Bestellung PO-7", 1), (1, 1, "add", "/orderReference", "x", "x", 1)], kind)
    pages = spark.createDataFrame([(d, 1, "Bestellung PO-7") for d in (1, 2, 3)], "doc_id bigint, page int, text string")
    formats = given["docs"].select("doc_id", F.lit("de").alias("number_format"))
    guarded = patches.guard_patches(plan, pages, evidence.canonical_pages(pages), evidence.document_text(pages), formats, given["facts"], queries_repair.LISTS)
    # The judged patches are read where they are stored: nothing is left of the evidence check in what comes after.
    assert "PO-7" not in plan_of(guarded) and "judged-" in plan_of(guarded)
    assert rows(guarded.select("seq", "normalized", "reason")) == [(0, "PO-7", None), (1, None, "evidence: quote-not-on-page")]


def test_the_round_trip_places_lines_once(spark, tmp_path):
    t = invoice_tables(spark, tmp_path)
    made = queries_score.xml_round_trip(t)
    assert "Window" not in plan_of(made) and "placed_lines" not in vars(t) and "invoices" not in vars(t)
    good = queries_score.good_invoices(t)
    only = lambda df: df.join(good.select("doc_id"), "doc_id", "left_semi")
    plain = views.roundtrip_check(good, only(t.placed_nets), only(t.placed_breakdown), only(t.totals), only(t.exemptions))
    assert rows(made) == rows(plain) and {r.differences for r in made.collect()} == {0}
