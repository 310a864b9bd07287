"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Texts over this many characters are encoded in pieces of about this size.
PIECE = 50_000
#: A cut before white space that follows something else never falls inside a match of the pattern: letters, digits
#: and signs do not take in white space, and a run of it starts anew there.
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """Loaded once per worker from the node's own copy of the rank file."""
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("local ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """`text` cut at safe boundaries, each piece at least `size` characters long but for the last."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, pattern: regex.Pattern, text: str, size: int = PIECE) -> list[int]:
    """Ids of the whole text. A piece that stays very long has a run without a boundary, which the library's own
    splitting may not take; its matches are found here and merged one by one."""
    ids: list[int] = []
    for piece in pieces(text, size):
        if len(piece) <= 2 * size:
            ids += enc.encode_ordinary(piece)
        else:
            for match in pattern.finditer(piece):
                ids += enc._encode_single_piece(match.group())
    return ids


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, piece: int = PIECE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, ids (array of int), and the columns named in `carry` as they were.

    Null and empty texts have no ids; repeated rows are encoded each; null doc_ids stay. Special tokens in a text are
    ordinary text. Other columns are left out, so their names cannot clash. The work is a map over rows: nothing is
    shuffled, and one task holds one small batch of texts."""
    small_batches(docs.sparkSession)
    given = docs.select(F.struct("doc_id", *carry).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pat = encoding(ranks_path, pattern), regex.compile(pattern)
        for batch in slices(batches):
            ids = [encode(enc, pat, text, piece) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])

    return given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, ids array<int>").select("row.*", "ids")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`encoded` with the column decoded (binary): the bytes of the ids, which need not be valid UTF-8. Null ids give
    no bytes."""
    columns = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in slices(batches):
            raw = [enc.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(raw, pa.binary())], [*columns, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*columns).schema)
    return encoded.select(*columns).mapInArrow(run, f"{schema}, decoded binary")
