import re

from belegwerk.llm import contamination
from conftest import make_docs, words


def split(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


ITEMS = [("a", " ".join(words(1, 400)[50:75])), ("b", "two words"), ("c", "ONE"), ("d", None), ("e", " ?! "),
         ("f", " ".join(words(2, 150)[20:32])), ("f", " ".join(words(3, 300)[7:17])), ("g", " ".join(["the", "same"] * 6)), ("h", "never seen here at all")]


def brute(rows, items, size=10):
    windows = []
    for item, text in items:
        own = split(text)
        windows += [(item, own[i:i + size]) for i in range(max(1, len(own) - size + 1)) if own]
    out = []
    for i, text in rows:
        own, hit, found = split(text), set(), set()
        for item, w in windows:
            for p in range(len(own) - len(w) + 1):
                if own[p:p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    found.add(item)
        out.append((repr(i), len(own), len(hit), sorted(found)))
    return sorted(out)


def result(found) -> list:
    return sorted((repr(r.doc_id), r.n_words, sum(h.end - h.start for h in r.hits), list(r["items"])) for r in found.collect())


def test_windows_in_documents(spark, docs, none):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id string, text string, words string")
    want = brute([d[:2] for d in make_docs()], ITEMS)
    assert result(contamination.find_windows(docs, items)) == want
    # Small blocks of windows: several passes, same answer.
    assert result(contamination.find_windows(docs, items, block=7)) == want
    assert contamination.find_windows(none, items).collect() == []
    assert all(r.hits == [] for r in contamination.find_windows(docs, items.limit(0)).collect())
    clean = contamination.drop_contaminated(docs, items, block=7)
    assert clean.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(w[0] for w in want if not w[2])


def test_numeric_item_ids_sort_as_strings(spark):
    items = spark.createDataFrame([(10, "alpha beta"), (9, "beta gamma")], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "alpha, beta"), (3, "alphabeta gamma")], "doc_id bigint, text string")
    assert result(contamination.find_windows(rows, items)) == brute([(1, "Alpha beta gamma"), (2, "alpha, beta"), (3, "alphabeta gamma")],
                                                                    [("10", "alpha beta"), ("9", "beta gamma")])
