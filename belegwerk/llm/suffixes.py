"""Removal of repeated byte strings with a sparse suffix array that is range-partitioned by sampled splitters.

Every string of `length` bytes has one anchor: the start of the leftmost of its grams (GRAM bytes) with the least
hash. Equal strings have their anchors at the same place, so it is enough to index the suffixes at anchors, each with
the bytes of all the strings that it anchors (its block). Suffixes are ordered by the hash of their leading gram, then
document and place; splitters sampled from that order deal them into buckets of about equal size, and a gram that is
very frequent is spread over several. A bucket is sorted by content, eight bytes at a time and only where bytes so
far are equal (a multikey sort), which finds its equal strings. Where a gram goes across a bucket boundary, the first
occurrence of each of its strings per bucket is compared with those of the other buckets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, slices, text_bytes, written
from .words import _mix

GRAM = 16
#: Text bytes per bucket.
BUCKET_BYTES = 8 << 20
#: Sampled suffixes per splitter.
SAMPLE = 64
#: Bytes that are indexed at once, and block bytes that are packed at once.
_PLACE_BITS = 18
_CHUNK = (1 << _PLACE_BITS) - 1024
_PACK = 24 << 20
_SLAB = 2 << 20
_LEVEL = 3
_NO_ID = np.iinfo(np.int64).min
_F1, _F2, _F3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _words_at(data: np.ndarray, count: int, shift: int) -> np.ndarray:
    """The eight bytes from each of `count` places on, big-endian so that numbers order as bytes do."""
    return np.ndarray((count,), ">u8", buffer=data, offset=shift, strides=(1,)).astype(np.uint64)


def _hash(words: list[np.ndarray]) -> np.ndarray:
    """Of each gram, given as its words."""
    h = words[0] * _F1
    for word in words[1:]:
        h = (h ^ (h >> np.uint64(29))) * _F2 + word * _F3
    return _mix(h)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the strings of `length` bytes in `data` (shorter than a chunk): runs of starts with one anchor, as
    (gram hash, anchor, first start, last start)."""
    count = len(data) - GRAM + 1
    h = _hash([_words_at(data, count, k) for k in range(0, GRAM, 8)])
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = (h & ~mask) | np.arange(count, dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    at = (least & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], at[first], first, last


@dataclass
class _Rows:
    """Indexed suffixes: gram hash, document (two numbers), anchor in the document, bytes of the block before the
    anchor, block size; and the blocks end to end."""
    gram: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    place: np.ndarray
    before: np.ndarray
    size: np.ndarray
    blocks: np.ndarray

    NUMBERS: ClassVar = ("gram", "doc", "key", "place", "before", "size")

    def take(self, rows: np.ndarray) -> _Rows:
        offsets = np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)])
        return _Rows(*(getattr(self, n)[rows] for n in self.NUMBERS), _gather(self.blocks, offsets[rows], self.size[rows]))

    @staticmethod
    def joined(parts: list[_Rows]) -> _Rows:
        return _Rows(*(np.concatenate([getattr(p, n) for p in parts]) for n in (*_Rows.NUMBERS, "blocks")))

    def packed(self) -> bytes:
        """Compressed; the gram hashes are left out, since the blocks hold the grams."""
        pairs, index = np.unique(np.stack([self.doc, self.key], 1), axis=0, return_inverse=True)
        columns = [pairs.ravel(), index.ravel().astype(np.int32), self.place.astype(np.int64), self.before.astype(np.uint16),
                   self.size.astype(np.uint16), self.blocks]
        raw = b"".join([np.array([len(pairs), len(index)], np.int64).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])
        return np.int64(len(raw)).tobytes() + pa.Codec("zstd", compression_level=_LEVEL).compress(raw, asbytes=True)

    @staticmethod
    def unpacked(pack: bytes) -> _Rows:
        size = int(np.frombuffer(pack, np.int64, 1)[0])
        raw = pa.Codec("zstd").decompress(pack[8:], decompressed_size=size, asbytes=True)
        known, n = np.frombuffer(raw, np.int64, 2).tolist()
        at, columns = 16, []
        for kind, count in ((np.int64, 2 * known), (np.int32, n), (np.int64, n), (np.uint16, n), (np.uint16, n)):
            columns.append(np.frombuffer(raw, kind, count, at))
            at += count * np.dtype(kind).itemsize
        pairs, index, place, before, sizes = columns
        blocks, before, sizes = np.frombuffer(raw, np.uint8, offset=at), before.astype(np.int64), sizes.astype(np.int64)
        grams = _gather(blocks, np.cumsum(sizes) - sizes + before, np.full(n, GRAM))
        pairs = pairs.reshape(-1, 2)[index]
        return _Rows(_hash([np.ascontiguousarray(grams.reshape(n, GRAM)[:, k:k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, GRAM, 8)]),
                     pairs[:, 0], pairs[:, 1], place, before, sizes, blocks)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges (start, size) of `flat` end to end, made some megabytes at a time."""
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    cuts = np.searchsorted(ends, np.arange(_SLAB, len(out) + _SLAB, _SLAB))
    a = 0
    for b in (min(int(c) + 1, len(ends)) for c in cuts):
        if b > a:
            lo, hi = int(ends[a] - sizes[a]), int(ends[b - 1])
            shift = starts[a:b] - (ends[a:b] - sizes[a:b] - lo)
            out[lo:hi] = flat[np.repeat(shift, sizes[a:b]) + np.arange(hi - lo)]
            a = b
    return out


def _indexed(batch: pa.RecordBatch, length: int, blocks: bool = True) -> Iterator[_Rows]:
    """The suffixes of a batch of documents, a chunk of whole texts (or part of a long one) at a time."""
    flat, offsets = text_bytes(batch.column("text"))
    docs = batch.column("doc").to_numpy()
    keys = batch.column("text_key").to_numpy()
    # (document, first byte, end) of pieces: the strings that start in a piece reach length - 1 bytes past it.
    pieces = [(k, s, min(s + _CHUNK, b)) for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
              for s in range(a, max(a, b - length + 1), _CHUNK - length + 1)]
    i = 0
    while i < len(pieces):
        j, begin = i + 1, pieces[i][1]
        while j < len(pieces) and pieces[j][2] - begin <= _CHUNK and pieces[j][1] >= pieces[j - 1][2]:
            j += 1
        group = pieces[i:j]
        data = np.ascontiguousarray(flat[begin:group[-1][2]])
        i = j
        gram, at, first, last = anchors(data, length)
        starts = np.array([p[1] - begin for p in group])
        ends = np.array([p[2] - begin - length for p in group])  # last start that stays inside the piece
        # Cut the runs to pieces: a run may lie across documents, where its strings mean nothing.
        own = np.searchsorted(starts, first, "right") - 1
        until = np.searchsorted(starts, last, "right") - 1
        rows, piece = np.arange(len(first)), own
        across = np.flatnonzero(until > own)
        if len(across):
            n = until[across] - own[across]
            rows = np.concatenate([rows, np.repeat(across, n)])
            piece = np.concatenate([own, np.concatenate([np.arange(a + 1, b + 1) for a, b in zip(own[across], until[across], strict=True)])])
        lo, hi = np.maximum(first[rows], starts[piece]), np.minimum(last[rows], ends[piece])
        good = lo <= hi
        rows, piece, lo, hi = rows[good], piece[good], lo[good], hi[good]
        k = np.array([p[0] for p in group])[piece]
        size = (hi - lo + length).astype(np.int32)
        yield _Rows(gram[rows], docs[k], keys[k], at[rows] + begin - offsets[k], (at[rows] - lo).astype(np.int32), size,
                    _gather(data, lo, size) if blocks else np.empty(0, np.uint8))


def _equal_groups(group: np.ndarray, words: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows that agree in `group` and in all of `words` (functions from row numbers to a word): the rows in groups of
    two and more, group by group and in row order inside each, and where groups begin. A multikey sort: each word is
    only looked at where all before it are equal."""
    rows = np.argsort(group, kind="stable")
    values = group[rows]
    rows, begin = _several(rows, np.concatenate([[True], values[1:] != values[:-1]]) if len(rows) else np.empty(0, bool))
    for word in words:
        if not len(rows):
            break
        values, label = word(rows), np.cumsum(begin)
        same_all = values[1:] == values[:-1]
        if (same_all | begin[1:]).all():
            continue
        order = np.lexsort((values, label))
        rows, values, label = rows[order], values[order], label[order]
        begin = np.concatenate([[True], (values[1:] != values[:-1]) | (label[1:] != label[:-1])])
        rows, begin = _several(rows, begin)
    return rows, begin


def _several(rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the rows that are alone in their group."""
    if not len(rows):
        return rows, begin
    alone = begin & np.append(begin[1:], True)
    return rows[~alone], begin[~alone]


def repeats(rows: _Rows, length: int, edge: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The repeats inside one bucket: (document, key, start, end) of covered ranges; and for grams in `edge`, which other
    buckets hold too, (two digests, document, key, start) of the first occurrence of each string here."""
    order = np.lexsort((rows.before, rows.place, rows.key, rows.doc))
    # Copies of one row (same document, same place) are one.
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([getattr(rows, n)[order[1:]] != getattr(rows, n)[order[:-1]] for n in ("doc", "key", "place", "before")])
    order = order[new]
    on_edge = np.isin(rows.gram, edge)
    values, inverse, n = np.unique(rows.gram[order], return_inverse=True, return_counts=True)
    rows = rows.take(order[(n[inverse] > 1) | on_edge[order]])
    if not len(rows.gram):
        none = np.empty(0, np.int64)
        return (none,) * 4, (none,) * 5
    offsets = np.concatenate([[0], np.cumsum(rows.size, dtype=np.int64)])[:-1]
    padded = np.concatenate([rows.blocks, np.zeros(2 * length + 8, np.uint8)])
    view = np.ndarray((len(padded) - 7,), ">u8", buffer=padded, strides=(1,))
    _, gram = np.unique(rows.gram, return_inverse=True)

    # Equal blocks first: all strings of the later ones are covered. The last word of a block overlaps the one before.
    shape = gram * (1 << 28) + rows.before.astype(np.int64) * (1 << 14) + rows.size
    words = [lambda r, k=k: view[offsets[r] + np.minimum(k, rows.size[r] - 8)].astype(np.uint64)
             for k in range(0, int(rows.size.max()), 8)]
    grouped, begin = _equal_groups(shape, words)
    later = np.zeros(len(gram), bool)
    later[grouped[~begin]] = True
    start = rows.place - rows.before
    covered = [(np.flatnonzero(later), start[later], (start + rows.size)[later])]

    # What is left differs somewhere: string by string, those at one distance before the anchor together.
    on_edge = np.isin(rows.gram, edge)
    after = rows.before - (rows.size - length)  # distance of the last start from the anchor
    firsts = []
    left = np.flatnonzero(~later)
    _, back, n = np.unique(gram[left], return_inverse=True, return_counts=True)
    left = left[(n[back] > 1) | on_edge[left]]
    steps = [*range(0, length - 7, 8), length - 8]
    for distance in range(length - GRAM + 1):
        own = left[(rows.before[left] >= distance) & (after[left] <= distance)]
        if not len(own):
            continue
        at = offsets[own] + rows.before[own] - distance
        pick = [lambda r, k=k: view[at[r] + k].astype(np.uint64) for k in steps]
        grouped, begin = _equal_groups(gram[own], pick)
        again = np.zeros(len(own), bool)
        again[grouped[~begin]] = True
        hit = own[again]
        covered.append((hit, rows.place[hit] - distance, rows.place[hit] - distance + length))
        ask = own[~again & on_edge[own]]
        if len(ask):
            firsts.append((ask, *_digests(view, offsets[ask] + rows.before[ask] - distance, steps), rows.place[ask] - distance))
    row, lo, hi = (np.concatenate(c) for c in zip(*covered, strict=True))
    row, lo, hi = _merged(row, lo, hi)
    if firsts:
        ask, one, two, begin_at = (np.concatenate(c) for c in zip(*firsts, strict=True))
        edges = one, two, rows.doc[ask], rows.key[ask], begin_at
    else:
        edges = (np.empty(0, np.int64),) * 5
    return (rows.doc[row], rows.key[row], lo, hi), edges


def _digests(view: np.ndarray, at: np.ndarray, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each string, as two numbers."""
    one, two = np.zeros(len(at), np.uint64), np.full(len(at), _F3)
    for k in steps:
        word = view[at + k].astype(np.uint64)
        one, two = _mix((one + word) * _F1), _mix((two ^ word) * _F2 + _F1)
    return one.view(np.int64), two.view(np.int64)


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one row that touch, as one; ranges of a row are of one length but for whole blocks."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    begin = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])])
    first = np.flatnonzero(begin)
    return row[first], lo[first], np.maximum.reduceat(hi, first)


def _kept(raw: bytes, ranges: list) -> tuple[int, bytes, list[tuple[int, int]]]:
    """Number of removed bytes, the bytes that stay, and the removed runs."""
    runs: list[list[int]] = []
    for r in sorted((x["start"], x["end"]) for x in ranges or []):
        if runs and r[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], r[1])
        else:
            runs.append(list(r))
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return sum(b - a for a, b in runs), b"".join(kept), [(a, b) for a, b in runs]


def _given(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_NO_ID))))


def _splitters(given: DataFrame, length: int, buckets: int, rows: int) -> list[tuple[int, int, int]]:
    """buckets - 1 suffixes (gram, document, key) at equal distances in a sample of the order."""
    wanted = SAMPLE * buckets
    share = min(1.0, max(2_000, wanted // 8) / max(rows, 1))
    some = given.where(F.pmod(F.xxhash64("doc", "text_key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for part in _indexed(batch, length, blocks=False):
                pick = _mix(part.gram + part.place.astype(np.uint64) + part.key.view(np.uint64)) % np.uint64(8) == 0
                yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in (part.gram.view(np.int64), part.doc, part.key)],
                                                 ["gram", "doc", "key"])

    found = some.select("doc", "text_key", "text").mapInArrow(run, "gram bigint, doc bigint, key bigint")
    found = found.orderBy(F.xxhash64("gram", "doc", "key")).limit(wanted).toArrow()
    gram = found.column("gram").to_numpy().view(np.uint64)
    order = np.lexsort((found.column("key").to_numpy(), found.column("doc").to_numpy(), gram))
    picks = order[[len(order) * k // buckets for k in range(1, buckets)]] if len(order) else []
    return sorted({(int(gram[k]), found.column("doc")[int(k)].as_py(), found.column("key")[int(k)].as_py()) for k in picks})


def covered_ranges(docs: DataFrame, length: int = 100, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc, text_key, start, end: ranges of bytes covered by strings that also start earlier; ranges may overlap.

    doc is doc_id with the least number for null. Earlier is: smaller doc_id (null first), at equal ids the smaller
    text_key, in one document the smaller start. Rows that repeat id and text are one document."""
    given = _given(docs).select("doc", "text_key", "text")
    spark = docs.sparkSession
    sums = given.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sums.b // bucket_bytes + 1)
    splitters = spark.sparkContext.broadcast(_splitters(given, length, buckets, sums.n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = splitters.value
        grams = np.array([c[0] for c in cuts], np.uint64)
        held: list[_Rows] = []

        def flush() -> pa.RecordBatch:
            rows = _Rows.joined(held)
            held.clear()
            lo, hi = np.searchsorted(grams, rows.gram, "left"), np.searchsorted(grams, rows.gram, "right")
            bucket = lo.copy()
            for k in np.flatnonzero(lo < hi):
                bucket[k] = bisect_right(cuts, (int(rows.gram[k]), int(rows.doc[k]), int(rows.key[k])), int(lo[k]), int(hi[k]))
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows.take(order), bucket[order]
            ends = np.cumsum(rows.size, dtype=np.int64)
            ids, first = np.unique(bucket, return_index=True)
            packs = []
            for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True):
                part = _Rows(*(getattr(rows, n)[a:b] for n in _Rows.NUMBERS), rows.blocks[ends[a] - rows.size[a]:ends[b - 1]])
                packs.append(part.packed())
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(packs, pa.binary())], ["bucket", "pack"])

        size = 0
        for batch in slices(batches):
            for part in _indexed(batch, length):
                held.append(part)
                size += len(part.blocks)
                if size > _PACK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.unique(np.array([c[0] for c in splitters.value], np.uint64))
        names = ["one", "two", "doc", "text_key", "start", "end"]

        def close(parts: list[_Rows]) -> Iterator[pa.RecordBatch]:
            (doc, key, lo, hi), (one, two, d, k, s) = repeats(_Rows.joined(parts), length, edge)
            none = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x) for x in (doc, key, lo, hi))], names)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (one, two, d, k, s)), pa.array(s + length)], names)

        current, held = None, []
        for batch in batches:
            for bucket, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack"), strict=True):
                if bucket != current and held:
                    yield from close(held)
                    held = []
                current = bucket
                held.append(_Rows.unpacked(pack.as_py()))
        if held:
            yield from close(held)

    dealt = given.mapInArrow(deal, "bucket int, pack binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = written(dealt.mapInArrow(
        compare, "one bigint, two bigint, doc bigint, text_key bigint, start bigint, end bigint"), "ranges")
    # Rows with digests are firsts of strings whose gram lies in several buckets: at most one per bucket and string.
    across = Window.partitionBy("one", "two").orderBy("doc", "text_key", "start")
    firsts = found.where("one is not null").withColumn("n", F.row_number().over(across)).where("n > 1")
    columns = ["doc", "text_key", "start", "end"]
    return found.where("one is null").select(*columns).unionAll(firsts.select(*columns))


def remove_repeats(docs: DataFrame, length: int = 100, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, n_bytes, n_removed, runs (array of (start, end), the maximal removed
    runs) and kept (binary: the bytes that stay).

    Texts are UTF-8 bytes, null is empty; a text shorter than `length` loses nothing. A byte goes when a string of
    `length` bytes that covers it also starts earlier (see `covered_ranges`), judged on the input. Rows that repeat
    doc_id and text are one document and have the same row each. Other columns are left out."""
    ranges = covered_ranges(docs, length, bucket_bytes).groupBy(F.col("doc").alias("d"), F.col("text_key").alias("k")).agg(
        F.collect_list(F.struct("start", "end")).alias("ranges"))
    given = _given(docs)
    met = given.join(ranges, (F.col("doc") == F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(
        "doc_id", "text_key", F.col("text").cast("binary").alias("raw"), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = batch.column("raw").to_pylist()
            done = [_kept(raw, r) for raw, r in zip(raws, batch.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(r) for r in raws], pa.int64()),
                 pa.array([d[0] for d in done], pa.int64()),
                 pa.array([[{"start": a, "end": b} for a, b in d[2]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([d[1] for d in done], pa.binary())], ["doc_id", "text_key", "n_bytes", "n_removed", "runs", "kept"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(run, f"doc_id {kind}, text_key bigint, n_bytes bigint, n_removed bigint, "
                               "runs array<struct<start:bigint,end:bigint>>, kept binary")
