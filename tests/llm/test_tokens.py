import hashlib

import public_tokenizers
import regex
import tiktoken

from belegwerk.llm import bpe, lengths
from belegwerk.llm.queries_tokens import RANKS
from conftest import by_row, make_docs

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def test_ids_are_those_of_the_library_and_decode_to_the_text(docs, none):
    enc = bpe.encoding(PATH, PATTERN)
    want = by_row((d[0], enc.encode_ordinary(d[1] or "")) for d in make_docs())
    encoded = bpe.encode_documents(docs, PATH, PATTERN, piece=100)
    assert by_row(encoded.collect()) == want
    raw = [r for r in bpe.decode_ids(encoded, PATH, PATTERN).collect()]
    assert by_row((r.doc_id, bytes(r.decoded)) for r in raw) == by_row((d[0], (d[1] or "").encode()) for d in make_docs())
    assert bpe.encode_documents(none, PATH, PATTERN).collect() == []


def test_carried_columns_stay(docs):
    row = bpe.encode_documents(docs, PATH, PATTERN, carry=("lang", "n")).where("doc_id = 4").first()
    assert (row.lang, row.n) == ("en", 4)


def test_pieces_are_safe_for_every_size():
    enc, pattern = bpe.encoding(PATH, PATTERN), regex.compile(PATTERN)
    text = "It's  we'll\n\n \t x1y2 'S don't!!  ...  " * 7 + "z" * 90 + " " * 50 + "end"
    for size in (1, 2, 3, 5, 8, 13, 40):
        assert "".join(bpe.pieces(text, size)) == text
        assert bpe.encode(enc, pattern, text, size) == enc.encode_ordinary(text)


def test_runs_that_the_library_cannot_split_are_encoded():
    enc, pattern = bpe.encoding(PATH, PATTERN), regex.compile(PATTERN)
    text = "x" + " " * 300_000 + "y"
    ids = bpe.encode(enc, pattern, text)
    assert enc.decode_bytes(ids) == text.encode()
    assert ids == tiktoken.Encoding._encode_single_piece(enc, b"x") + enc._encode_single_piece(" " * 299_999) + enc._encode_single_piece(b" y")
    assert hashlib.sha256(enc.decode_bytes(ids)).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_suffix_sums_answer_for_every_limit(spark):
    sizes = [0, 0, 1, 5, 5, 5, 7, 1023, 1024, 1025, 5000, 5000, None]
    rows = spark.createDataFrame([(s,) for s in sizes], "length int")
    known = [s or 0 for s in sizes]
    histogram = lengths.length_histogram(rows)
    answers = lengths.context_answers(histogram, block=4)
    got = {r["length"]: r for r in answers.collect()}
    assert set(got) == set(known)
    for limit, r in got.items():
        over = [s for s in known if s > limit]
        assert (r.docs, r.docs_over, r.tokens_over) == (known.count(limit), len(over), sum(over))
        assert (r.docs_total, r.tokens_total, r.truncated_tokens) == (len(known), sum(known), sum(min(s, limit) for s in known))
    at = {r.context: (r.docs_over, r.tokens_over, r.truncated_tokens) for r in lengths.at_limits(histogram, [0, 6, 4096, 9999]).collect()}
    assert at == {c: (sum(s > c for s in known), sum(s for s in known if s > c), sum(min(s, c) for s in known)) for c in (0, 6, 4096, 9999)}
    middle = {r.q: r["length"] for r in lengths.quantiles(answers, [0.5, 1.0]).collect()}
    assert middle == {0.5: sorted(known)[6], 1.0: 5000}


def test_histograms_by_group_and_empty(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 4), (None, 3)], "lang string, length int")
    got = lengths.context_answers(lengths.length_histogram(rows, ("lang",)), ("lang",)).collect()
    assert by_row((r.lang, r["length"], r.docs_over, r.tokens_total) for r in got) == by_row([("a", 3, 1, 7), ("a", 4, 0, 7), (None, 3, 0, 3)])
    assert lengths.context_answers(lengths.length_histogram(rows.limit(0).select("length"))).collect() == []
    assert lengths.at_limits(lengths.length_histogram(rows.limit(0).select("length")), [5]).collect()[0].docs_over == 0
