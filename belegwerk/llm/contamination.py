"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, text_bytes
from .words import ALPHANUMERIC, gram_values, word_values

WINDOW = 10
#: Words per shingle. The rarest shingle of a window is its prefix: with containment 1 every occurrence has it.
SHINGLE = 3
#: Windows per block; a block is what one pass over the documents carries (about 100 bytes a window).
BLOCK = 200_000


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows of the items: words (array of their values), items (sorted ids). Short items are one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, bounds = word_values(*text_bytes(batch.column("text")), ALPHANUMERIC)
            ids, rows = [], []
            for item, a, b in zip(batch.column("item_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                own = values[a:b].view(np.int64)
                for k in range(max(1, len(own) - window + 1) if len(own) else 0):
                    ids.append(item)
                    rows.append(own[k:k + window])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("item_id").type),
                                              pa.array(rows, pa.list_(pa.int64()))], ["item_id", "words"])

    given = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = given.schema["item_id"].dataType.simpleString()
    rows = given.mapInArrow(run, f"item_id {kind}, words array<bigint>")
    return rows.groupBy("words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Values of the shingles of one window; a window shorter than a shingle has itself."""
    return gram_values(words, min(size, len(words)))


def _seen(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, int]:
    """How often each wanted shingle occurs in all documents: the rarity order. Counts are made per task and summed."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {size: np.zeros(len(keys), np.int64) for size, keys in shared.value.items()}
        for batch in slices(batches):
            values, bounds = word_values(*text_bytes(batch.column("text")), ALPHANUMERIC)
            for size, keys in shared.value.items():
                _, found = _places(values, bounds, size, keys)
                counts[size] += np.bincount(found, minlength=len(keys))
        for size, keys in shared.value.items():
            some = np.flatnonzero(counts[size])
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[size][some])], ["shingle", "n"])

    rows = docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r.shingle: r.n for r in rows.toLocalIterator()}


def _places(values: np.ndarray, bounds: np.ndarray, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which one of the sorted `keys` begins, within one document each, and the index of the key."""
    grams = gram_values(values, size)
    if not len(grams) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A table over the low bits settles most positions with one lookup.
    table = np.zeros(1 << 20, bool)
    table[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
    index = np.searchsorted(keys, grams[maybe])
    index[index == len(keys)] = 0
    hit = keys[index] == grams[maybe]
    at, index = maybe[hit], index[hit]
    same = np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at + size - 1, "right")
    return at[same], index[same]


class _Plan:
    """One block of windows ready to look for: by shingle size the sorted prefix shingles, and for each the windows
    that have it as prefix with its offset in them."""

    def __init__(self, windows: list[tuple[list[int], list[str]]], rarity: dict[int, int], shingle: int):
        self.words = [np.array(w, np.int64).view(np.uint64) for w, _ in windows]
        self.items = [i for _, i in windows]
        by_size: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, words in enumerate(self.words):
            grams = _shingles(words, shingle)
            rare = [(rarity.get(int(g), 0), int(g)) for g in grams.view(np.int64)]
            if min(rare)[0] == 0:
                continue  # a shingle that no document has: the window cannot occur
            offset = min(range(len(rare)), key=rare.__getitem__)
            by_size.setdefault(min(shingle, len(words)), {}).setdefault(int(grams[offset]), []).append((k, offset))
        self.keys: dict[int, np.ndarray] = {}
        self.owners: dict[int, list[list[tuple[int, int]]]] = {}
        for size, found in by_size.items():
            order = sorted(found)
            self.keys[size], self.owners[size] = np.array(order, np.uint64), [found[g] for g in order]

    def occurrences(self, values: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, first word) of every verified occurrence."""
        for size, keys in self.keys.items():
            at, index = _places(values, bounds, size, keys)
            doc = np.searchsorted(bounds, at, "right")
            for key in np.unique(index):
                mine = index == key
                where, lo, hi = at[mine], bounds[doc[mine] - 1], bounds[doc[mine]]
                for window, offset in self.owners[size][key]:
                    words = self.words[window]
                    start = where - offset
                    # Positional and length bound: the whole window must lie in the document.
                    start = start[(start >= lo) & (start + len(words) <= hi)]
                    for k in range(len(words)):
                        if not len(start):
                            break
                        start = start[values[start + k] == words[k]]
                    for s in start.tolist():
                        yield window, s


def _plans(docs: DataFrame, items: DataFrame, window: int, shingle: int, block: int) -> Iterator[_Plan]:
    """The windows in blocks, each with the prefix shingles that are rarest in `docs` (doc_id, text, text_key)."""
    rows: list[tuple[list[int], list[str]]] = []

    def plan() -> _Plan:
        wanted: dict[int, set[int]] = {}
        for words, _ in rows:
            values = np.array(words, np.int64).view(np.uint64)
            wanted.setdefault(min(shingle, len(words)), set()).update(int(g) for g in _shingles(values, shingle))
        sought = {size: np.array(sorted(keys), np.uint64) for size, keys in wanted.items()}
        return _Plan(rows, _seen(docs, sought) if rows else {}, shingle)

    done = False
    for row in _windows(items, window).orderBy(F.xxhash64("words"), "words").toLocalIterator():
        rows.append((row["words"], row["items"]))
        if len(rows) == block:
            yield plan()
            rows, done = [], True
    if rows or not done:
        yield plan()


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, n_words, hits (array of (start, end), the maximal runs of hit words,
    end exclusive) and items (sorted ids, as strings, of the items with a window in the document).

    A window is `window` consecutive words of an item (all of a shorter item); words are lower-cased runs of digits,
    Latin letters and non-ASCII characters. The shingles of the windows are counted over all documents, the rarest of
    each window is its prefix, and only positions of prefixes are verified, word by word. Null and empty texts have no
    words; items without words have no windows; without items nothing is hit. Repeated rows get a row each; items that
    share an id are one item. Other columns are left out.

    The windows go to the tasks in blocks of at most `block`, one pass over the documents for each, so what is
    broadcast is bounded (about 100 bytes a window); documents are never shuffled, so no passage or source is hot."""
    given = documents(docs)
    passes = [_pass(given, p) for p in _plans(given, items, window, shingle, block)]
    if len(passes) == 1:
        return passes[0]
    # Several blocks: the passes run over the same rows in the same order, so rows are matched by document.
    every = passes[0]
    for p in passes[1:]:
        every = every.unionAll(p)
    merged = every.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / len(passes)).cast("int").alias("copies"))
    return merged.select("doc_id", "text_key", "n_words", _runs("hits").alias("hits"), "items",
                         F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("c")).drop("c")


def _runs(hits: str):
    """Sorted runs that overlap or touch, as one."""
    kind = "array<struct<start:bigint,end:bigint>>"
    empty = F.array().cast(kind)

    def step(done, run):
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return (F.when(F.size(done) == 0, F.array(run).cast(kind))
                .when(run["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown).cast(kind)).cast(kind))
                .otherwise(F.concat(done, F.array(run).cast(kind)).cast(kind)))

    return F.aggregate(F.col(hits), empty, step)


def _pass(given: DataFrame, plan: _Plan) -> DataFrame:
    shared = given.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches):
            values, bounds = word_values(*text_bytes(batch.column("text")), ALPHANUMERIC)
            n = np.diff(bounds)
            edge = np.zeros(len(values) + 1, np.int64)
            found: list[set[str]] = [set() for _ in n]
            for window, start in block.occurrences(values, bounds):
                edge[start] += 1
                edge[start + len(block.words[window])] -= 1
                found[int(np.searchsorted(bounds, start, "right")) - 1].update(block.items[window])
            hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]]) if len(values) else np.zeros(2, bool)
            runs: list[list[dict[str, int]]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                turn = np.flatnonzero(np.diff(np.concatenate([[False], hit[a + 1:b + 1], [False]]).astype(np.int8)))
                runs.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                ["doc_id", "text_key", "n_words", "hits", "items"])

    key = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(
        run, f"doc_id {key}, text_key bigint, n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of `docs` without any window of an item, all columns as they were. Windows, words and blocks are those
    of `find_windows`; every block of windows is one pass that drops rows where they stand, so nothing is shuffled."""
    out = docs
    for plan in _plans(documents(docs), items, window, shingle, block):
        out = _clean(out, plan)
    return out


def _clean(docs: DataFrame, plan: _Plan) -> DataFrame:
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, bounds = word_values(*text_bytes(batch.column("text")), ALPHANUMERIC)
            clean = np.ones(batch.num_rows, bool)
            starts = np.array([s for _, s in shared.value.occurrences(values, bounds)], np.int64)
            clean[np.searchsorted(bounds, starts, "right") - 1] = False
            yield batch.select(["row"]).filter(pa.array(clean))

    return inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}").select("row.*")
