"""Many needles in one text: against a plain count, in packs, and the two plans of the evidence check side by side."""

from __future__ import annotations

import random

import pytest

from belegwerk.operators import evidence


def count(text: str, needle: str) -> int:
    return sum(text.startswith(needle, i) for i in range(len(text)))


@pytest.mark.parametrize("pack", [3, 4096])
def test_search_equals_a_plain_count(spark, monkeypatch, pack):
    monkeypatch.setattr(evidence, "PACK", pack)
    rng = random.Random(4)
    texts = [(k, k % 2, "".join(rng.choice("aab é") for _ in range(rng.randint(0, 400)))) for k in range(30)] + [(99, 0, None), (98, 0, "x" * 300_000)]
    needles = [(k, p, "".join(rng.choice("aab é") for _ in range(rng.randint(1, 5)))) for k, p, _ in texts for _ in range(25)]
    needles += [(98, 0, "x" * n) for n in (1, 2, 100)] + [(98, 0, "x"), (1, 1, ""), (1, 1, None), (1234, 0, "a"), (None, 0, "a")]
    # A third of all needles under one text.
    needles += [(0, 0, f"{k}a") for k in range(400)]
    got = evidence.search(
        spark.createDataFrame(needles, "doc int, part int, needle string").repartition(5), spark.createDataFrame(texts, "doc int, part int, text string"),
        ["doc", "part"])
    own = {(k, p): t or "" for k, p, t in texts}
    want = {(k, p, n, count(own[k, p], n), n.replace(" ", "") in own[k, p].replace(" ", "")) for k, p, n in needles if n and (k, p) in own and n.strip()}
    assert {tuple(r) for r in got.where("trim(needle) <> ''").collect()} == want
    assert got.count() == len({(k, p, n) for k, p, n in needles if n and (k, p) in own})


def test_both_plans_judge_evidence_alike(spark):
    pages = spark.createDataFrame([(1, 1, "Rechnung Nr. 7\nBetrag 10,00 EUR"), (1, 2, None), (2, 1, "a b c"), (3, 1, "")], "doc_id int, page int, text string")
    facts = [(d, f"p{i}", v, q, p) for i, (d, v, q, p) in enumerate([
        (1, "7", "rechnung nr. 7", 1), (1, "7", "Rechnung Nr.7", 1), (1, "8", "Rechnung Nr. 7", 1), (1, "7", "Rechnung 7", 1), (1, "7", " ", 1), (1, "7", None, 1),
        (1, "7", "7", 3), (1, "7", "7", 2), (2, "abc", "a b c", 1), (2, None, "a", 1), (2, " ", "a", 1), (3, "x", "x", 1), (4, "x", "x", 1), (2, "a b", "ab", None), (2, "b", "b", 1), (2, "b", "b", 1)])]
    df = spark.createDataFrame(facts, "doc_id int, path string, value string, quote string, page int")
    for blank in (True, False):
        plans = [evidence.check_evidence(df, pages, blank, many) for many in (False, True)]
        for part in (0, 1):
            cols = [c for c in plans[0][part].columns if not c.endswith("_c")]
            one, two = (sorted(map(repr, p[part].select(*cols).collect())) for p in plans)
            assert one == two and one


def test_cities_after_postcodes_equals_the_plain_plan(spark):
    texts = spark.createDataFrame([(1, "10115 berlin 20095 hamburg"), (2, None)], "doc_id int, text_c string")
    cities = spark.createDataFrame([(1, "Berlin", "10115"), (1, "Hamburg", "10115"), (1, "Hamburg", "20095"), (1, None, "20095"), (2, "x", "1"), (3, "x", "1")], "doc_id int, city string, postcode string")
    one, two = (sorted(map(repr, f(cities, texts).collect())) for f in (evidence.city_follows_postcode, evidence.cities_after_postcodes))
    assert one == two
