import random
import re

from belegwerk.llm import graph, jaccard
from conftest import make_docs, words


def shingles(text: str | None, k: int) -> frozenset:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(own[i:i + k]) for i in range(max(1, len(own) - k + 1))) if own else frozenset()


def brute(rows: list[tuple], k: int, percent: int) -> list:
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((repr(i), len(sets[x]), repr(least.get(root(x)) if sets[x] else i)) for x, (i, _) in enumerate(rows)))


def check(spark, frame, rows, k, percent) -> None:
    got = jaccard.jaccard_components(frame, jaccard.Rule(k, percent)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows, k, percent)


def test_awkward_rows(spark, docs, none):
    check(spark, docs, [d[:2] for d in make_docs()], 4, 85)
    assert jaccard.jaccard_components(none).collect() == []


def test_chains_groups_and_borders(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(5)
    rows, base = [], words(9, 120)
    for n in range(150):  # one group of near copies with few and many changes
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10 ** 6)}"
        rows.append((1000 - n, " ".join(own)))
    chain = words(10, 200)
    rows += [(2000 + n, " ".join(chain[3 * n:3 * n + 100])) for n in range(20)]
    rows += [(3000 + n, " ".join(words(50 + n, 60) + base[:50])) for n in range(30)]
    rows += [(4000 + n, "short text here"[:n]) for n in range(16)] + [(5000, "Short TEXT here"), (5001, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    check(spark, frame, rows, 4, 85)
    check(spark, frame, rows, 5, 80)


def test_one_of_each_group_stays(docs, none):
    left = jaccard.one_of_each(docs, jaccard.Rule(5, 80))
    assert left.columns == docs.columns
    ids = sorted(repr(r.doc_id) for r in left.collect())
    gone = ["7", "8", "6", "6", "None"]  # the copies of 6, and the null id with its text
    want = sorted(repr(d[0]) for d in make_docs())
    for g in gone:
        want.remove(g)
    assert ids == want
    assert jaccard.one_of_each(none).collect() == []


def test_components_of_long_paths_and_hubs(spark):
    path = [(n, n + 1) for n in range(300)] + [(1000, n) for n in range(1001, 1300)] + [(5, 5), (2001, 2000), (2000, 2001)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert {found[n] for n in range(301)} == {0} and {found[n] for n in range(1000, 1300)} == {1000}
    assert found[2001] == found[2000] == 2000
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
