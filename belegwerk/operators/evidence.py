"""Is a fact really printed where it says? Tables: page(doc_id, page, text), fact(doc_id, path, value, quote, page)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import after_nfkc, canonical, contains_loosely, is_blank, nfkc, printed_once
from .ordering import join_in_order

ADDRESS_KEYS = ("street", "addressLine2", "city", "postcode", "electronicAddress")
# Where each address key of a party lives in the model.
KEY_PATH = {
    "name": "name",
    "street": "address.line1",
    "addressLine2": "address.line2",
    "city": "address.city",
    "postcode": "address.postcode",
    "electronicAddress": "electronicAddress.value",
}
PARTIES = ("seller", "buyer")


def canonical_pages(pages: DataFrame) -> DataFrame:
    """Canonical text, once per page; every text comparison starts here."""
    return pages.select("doc_id", "page", canonical("text").alias("text_c"))


def document_text(pages: DataFrame) -> DataFrame:
    """All pages of a document joined by a newline, in canonical form.

    One document is one text: the upload gate bounds it (pages and bytes) before this step.
    """
    # By document from the start, so that no text is shuffled twice.
    return canonical_document(join_in_order(pages.repartition("doc_id"), ["doc_id"], "page", "text", "\n", "text"))


def canonical_document(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", canonical("text").alias("text_c"))


#: Needles that one automaton holds; a text with more of them is read once per pack.
PACK = 4096


def search(needles: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """needles(keys, needle), texts(keys, text) -> keys, needle, n (how often it is in its text, overlaps counted) and
    loose (it is there when all spaces are taken out), one row per distinct needle that is not empty and has a text.

    All needles of a text are looked for in one pass over it, with one automaton (Aho and Corasick). The text meets its
    needles once, not once per needle; however many there are, a pack of them and one text are held at a time."""
    # One shuffle by key serves the distinct needles, their number and the packs, and the text meets them where they are.
    wanted = needles.select(*keys, "needle").where("needle <> ''").repartition(*keys).distinct()
    packs = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / PACK)
    packed = wanted.withColumn("__packs", packs).groupBy(*keys, F.pmod(F.xxhash64("needle"), F.col("__packs")).alias("__pack")).agg(
        F.collect_list("needle").alias("needles"))
    met = packed.join(texts.select(*keys, "text"), keys).select(*keys, "needles", "text")
    kinds = ", ".join(f"{k} {met.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        def tried(words: list[str], text: str) -> list[int]:
            """Occurrences of each word, which may repeat; none of an empty one."""
            automaton, counts = ahocorasick.Automaton(), dict.fromkeys(words, 0)
            for word in filter(None, counts):
                automaton.add_word(word, word)
            if len(automaton):
                automaton.make_automaton()
                for _, word in automaton.iter(text):
                    counts[word] += 1
            return [counts[word] for word in words]

        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                words, text = one.column("needles").to_pylist()[0], one.column("text").to_pylist()[0] or ""
                n, loose = tried(words, text), tried([w.replace(" ", "") for w in words], text.replace(" ", ""))
                own = [one.column(k).take(pa.array([0] * len(words))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words), pa.array(n, pa.int64()), pa.array([x > 0 for x in loose])],
                                                 [*keys, "needle", "n", "loose"])

    return met.mapInArrow(run, f"{kinds}, needle string, n bigint, loose boolean")


def _judged(marked: DataFrame, on_page: Column, in_text: Column) -> DataFrame:
    problem = (
        F.when(F.coalesce("quote_c", F.lit("")) == "", "empty-quote")
        .when(~on_page, "page-out-of-range")
        .when(~in_text, "quote-not-on-page")
        .when((F.coalesce("value_c", F.lit("")) != "") & ~contains_loosely(F.col("quote_c"), F.col("value_c")),
              "value-not-in-quote")
    )
    return marked.withColumn("problem", problem)


def evidence_problem(facts: DataFrame, pages_c: DataFrame) -> DataFrame:
    """Adds value_c, quote_c and problem (NULL when the quote is on its page and holds the value). For pages with a few
    short facts: each of them meets the page's text."""
    joined = with_canonical(facts).join(pages_c, ["doc_id", "page"], "left")
    return _judged(joined, F.col("text_c").isNotNull(), contains_loosely(F.col("text_c"), F.col("quote_c"))).drop("text_c")


def with_canonical(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"value_c": canonical("value"), "quote_c": canonical("quote")})


def marked_facts(facts: DataFrame) -> DataFrame:
    """facts + value_c, quote_c, value_head, quote_head: every canonical text that the checks below compare. A head is the
    first line of a party's text that has several, and null where it is the text itself."""
    party = F.col("path").isin(*[f"{p}.{KEY_PATH[k]}" for p in PARTIES for k in KEY_PATH])
    # A written line break becomes one, which is a space to the canonical form, so that one step to Python serves both.
    texts = {f"__{c}": nfkc(F.replace(F.col(c), F.lit("\\n"), F.lit("\n"))) for c in ("value", "quote")}
    whole = {f"{c}_c": after_nfkc(F.col(f"__{c}")) for c in ("value", "quote")}
    head = lambda c: F.when(party & F.contains(c, F.lit("\n")), after_nfkc(F.substring_index(c, "\n", 1)))
    return facts.withColumns(texts).withColumns(whole).withColumns({f"{c}_head": head(F.col(f"__{c}")) for c in ("value", "quote")}).drop(*texts)


def evidence_problem_by_document(marked: DataFrame, pages_c: DataFrame) -> DataFrame:
    """As `evidence_problem`, for marked facts that lie by document: the page is looked for among the few of its
    document, so that facts are sorted by one key."""
    page = pages_c.select("doc_id", F.col("page").alias("__page"), "text_c").alias("p")
    # Not an equality, by which the join would sort as well.
    same = (F.col("f.page") >= F.col("p.__page")) & (F.col("f.page") <= F.col("p.__page"))
    joined = marked.alias("f").join(page, (F.col("f.doc_id") == F.col("p.doc_id")) & same, "left").select("f.*", "p.text_c")
    return _judged(joined, F.col("text_c").isNotNull(), contains_loosely(F.col("text_c"), F.col("quote_c"))).drop("text_c")


def evidence_problem_searched(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """The same for long pages with many quotes: all quotes of a page in one pass over it (see `search`). Takes the
    pages as they are: which page there is needs no canonical form."""
    marked = facts.withColumns({"value_c": canonical("value"), "quote_c": canonical("quote")})
    keys = ["doc_id", "page"]
    found = search(marked.select(*keys, F.col("quote_c").alias("needle")), canonical_pages(pages).select(*keys, F.col("text_c").alias("text")), keys)
    found = found.select(*keys, F.col("needle").alias("quote_c"), ((F.col("n") > 0) | F.col("loose")).alias("__there"))
    there = pages.where("text is not null").select(*keys, F.lit(True).alias("__page"))
    joined = marked.join(there, keys, "left").join(found, [*keys, "quote_c"], "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    return _judged(joined, known("__page"), known("__there")).select(*marked.columns, "problem")


def check_evidence(facts: DataFrame, pages: DataFrame, blank_is_absent: bool = True, many_quotes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split into evidenced facts and rejected(doc_id, path, value, reason). Blank values count as absent. `many_quotes`
    chooses the plan for long pages of which very many places are quoted; the result is the same."""
    given = facts.where(~is_blank(F.col("value"))) if blank_is_absent else facts
    judged = evidence_problem_searched(given, pages) if many_quotes else evidence_problem(given, canonical_pages(pages))
    ok = judged.where("problem is null").drop("problem")
    rejected = judged.where("problem is not null").select("doc_id", "path", "value", F.col("problem").alias("reason"))
    return ok, rejected


def find_occurrences(quotes: DataFrame, texts_c: DataFrame) -> DataFrame:
    """quotes(doc_id, quote) + n: how often the quote is printed in the document, overlaps counted. All quotes of a
    document are counted in one pass over its text (see `search`)."""
    marked = quotes.withColumn("__q", canonical("quote"))
    found = search(marked.select("doc_id", F.col("__q").alias("needle")), texts_c.select("doc_id", F.col("text_c").alias("text")), ["doc_id"])
    found = found.select("doc_id", F.col("needle").alias("__q"), "n")
    return marked.join(found, ["doc_id", "__q"], "left").select(*quotes.columns, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def read_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, at (the place among the pages of its document), lines and text_c (canonical, null without a text),
    n_de, n_plain, eur_seen: all that the checks below ask of a page, so that its text is read once."""
    t, de, plain = F.col("__t"), *number_format_counts(F.col("text"))
    whole = pages.select("doc_id", "page", nfkc(F.replace(F.col("text"), F.lit("\\n"), F.lit(" "))).alias("__t"), de.alias("n_de"), plain.alias("n_plain"), _eur(F.col("text")).alias("eur_seen"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "__t"))
    lined = whole.withColumn("at", at).withColumn("lines", F.transform(F.split(F.coalesce(t, F.lit("")), "\n", -1), after_nfkc))
    return lined.withColumn("text_c", F.when(t.isNotNull(), _joined(F.col("lines")))).drop("__t")


def _joined(lines: Column) -> Column:
    """Canonical text from its canonical lines."""
    return F.array_join(F.filter(lines, lambda l: l != ""), " ")


def lines_of_pages(read: DataFrame) -> DataFrame:
    """As `document_lines`, from `read_pages`."""
    parts = read.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "lines"))).alias("__p"))
    return parts.select("doc_id", F.flatten(F.transform("__p", lambda p: p["lines"])).alias("lines"))


def text_of_pages(read: DataFrame) -> DataFrame:
    """As `document_text`, from `read_pages`."""
    return lines_of_pages(read).select("doc_id", _joined(F.col("lines")).alias("text_c"))


def number_format_counts(text: Column) -> tuple[Column, Column]:
    return (F.regexp_count(text, F.lit(r"[0-9],[0-9]{2}(?![0-9])")), F.regexp_count(text, F.lit(r"[0-9]\.[0-9]{2}(?![0-9])")))


def detect_number_format(pages: DataFrame) -> DataFrame:
    """doc_id, number_format: 'de' unless plain decimals are in the majority. No match can span two pages."""
    de, plain = number_format_counts(F.col("text"))
    return number_format(pages.select("doc_id", de.alias("n_de"), plain.alias("n_plain")))


def number_format(counts: DataFrame) -> DataFrame:
    return (
        counts.groupBy("doc_id").agg(F.sum("n_de").alias("n_de"), F.sum("n_plain").alias("n_plain"))
        .select("doc_id", F.when(F.col("n_de") >= F.col("n_plain"), "de").otherwise("plain").alias("number_format"))
    )


def currency_on_page(pages: DataFrame) -> DataFrame:
    """doc_id, eur_seen: the euro sign or the word EUR is printed somewhere."""
    return pages.groupBy("doc_id").agg(F.bool_or(_eur(F.col("text"))).alias("eur_seen"))


def _eur(text: Column) -> Column:
    return F.contains(text, F.lit("€")) | text.rlike("(?<![A-Za-z0-9_])EUR(?![A-Za-z0-9_])")


def city_follows_postcode(cities: DataFrame, texts_c: DataFrame) -> DataFrame:
    """cities(doc_id, city, postcode, ..) + follows: 'postcode city' is printed in the document."""
    wanted = canonical(F.concat("postcode", F.lit(" "), "city"))
    return (
        cities.withColumn("__w", wanted).join(texts_c, "doc_id", "left")
        .withColumn("follows", F.coalesce(F.contains(F.col("text_c"), F.col("__w")), F.lit(False)))
        .drop("__w", "text_c")
    )


def cities_after_postcodes(cities: DataFrame, texts_c: DataFrame) -> DataFrame:
    """The same for long texts with very many places in question, all in one pass over each text (see `search`)."""
    marked = cities.withColumn("__w", canonical(F.concat("postcode", F.lit(" "), "city")))
    found = search(marked.select("doc_id", F.col("__w").alias("needle")), texts_c.select("doc_id", F.col("text_c").alias("text")), ["doc_id"])
    found = found.select("doc_id", F.col("needle").alias("__w"), (F.col("n") > 0).alias("follows"))
    return marked.join(found, ["doc_id", "__w"], "left").select(*cities.columns, F.coalesce("follows", F.lit(False)).alias("follows"))


# --- whose line is it? ------------------------------------------------------------------------


def document_lines(pages: DataFrame) -> DataFrame:
    """doc_id, lines: the canonical lines of all pages in order, as one array.

    One document is one row: the upload gate bounds it (pages and bytes) before this step."""
    whole = pages.select("doc_id", "page", nfkc(F.replace(F.col("text"), F.lit("\\n"), F.lit(" "))).alias("text"))
    parts = whole.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    lines = F.flatten(F.transform("pages", lambda p: F.split(F.coalesce(p["text"], F.lit("")), "\n", -1)))
    return parts.select("doc_id", F.transform(lines, after_nfkc).alias("lines"))


def claim_evidence_text(value: Column, quote: Column) -> Column:
    """What the address rule compares: canonical value and quote, and the canonical first line of each."""
    return F.struct(
        canonical(value).alias("value"), canonical(quote).alias("quote"), canonical(_first_line(value)).alias("value_head"),
        canonical(_first_line(quote)).alias("quote_head"))


def _first_line(c: Column) -> Column:
    return F.get(F.split(c, r"\n|\\n", -1), F.lit(0))


def party_claims(facts: DataFrame, ids: list[str]) -> DataFrame:
    """One row per id with a struct of canonical texts per party and address key, from the long fact table, which may be
    marked already (see `marked_facts`)."""
    paths = {f"{p}.{KEY_PATH[k]}": f"{p}_{k}" for p in PARTIES for k in KEY_PATH}
    text = claim_evidence_text(F.col("value"), F.col("quote")) if "value_head" not in facts.columns else F.struct(
        F.col("value_c").alias("value"), F.col("quote_c").alias("quote"), F.coalesce("value_head", "value_c").alias("value_head"),
        F.coalesce("quote_head", "quote_c").alias("quote_head"))
    wanted = facts.where(F.col("path").isin(*paths)).select(*ids, "path", text.alias("__e"))
    return wanted.groupBy(*ids).agg(*[F.max(F.when(F.col("path") == p, F.col("__e"))).alias(c) for p, c in paths.items()])


def shared_address_losers(claims: DataFrame, pages: DataFrame, ids: list[str]) -> DataFrame:
    """As `losers_in_lines`, from the pages."""
    return losers_in_lines(claims, document_lines(pages), ids)


def losers_in_lines(claims: DataFrame, lines: DataFrame, ids: list[str]) -> DataFrame:
    """ids + (party, key) for every address fact whose printed line belongs to the other party.

    A line printed once goes to the party whose name or street is printed closest; a tie takes it from both.
    claims come from party_claims, lines(doc_id, lines) from document_lines. All is decided in one row per claim: the places of each needle are arrays of line
    numbers, and no line is paired with a claim."""
    c = claims.join(lines, "doc_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    # The canonical text of the document, from its lines.
    c = c.withColumn("text_c", _joined(F.col("lines")))
    once = lambda needle: printed_once(F.col("text_c"), needle)
    cols: dict[str, Column] = {}
    for key in ADDRESS_KEYS:
        s, b = F.col(f"seller_{key}"), F.col(f"buyer_{key}")
        both = s.isNotNull() & b.isNotNull()
        mine = F.coalesce(s, b)
        same_line = (s["quote"] == b["quote"]) & once(s["quote"])
        same_value = (s["value"] == b["value"]) & once(s["value"])
        cols[f"owner_{key}"] = F.when(both, "both").when(s.isNotNull(), "seller").when(b.isNotNull(), "buyer")
        # NULL: nothing to decide. An empty head is looked for nowhere, but still decided.
        cols[f"head_{key}"] = (
            F.when(both, F.when(same_line, s["quote_head"]).when(same_value, s["value_head"]))
            .when(mine.isNotNull() & once(mine["value"]), mine["value_head"])
        )
    for p in PARTIES:
        cols[f"{p}_at_name"] = F.nullif(F.col(f"{p}_name")["value"], F.lit(""))
        cols[f"{p}_at_street"] = F.nullif(F.col(f"{p}_street")["value"], F.lit(""))
    open_claims = c.select(*ids, "lines", *[v.alias(k) for k, v in cols.items()]).where(F.coalesce(*[f"head_{k}" for k in ADDRESS_KEYS]).isNotNull())

    # Written as SQL text: forty nested lambdas built one by one would cost the driver seconds.
    def places(needle: str) -> Column:
        return F.expr(f"filter(transform(lines, (l, i) -> if(contains(l, nullif({needle}, '')), i, null)), i -> i is not null)")

    heads = {f"at_{k}": F.get(places(f"head_{k}"), F.lit(0)) for k in ADDRESS_KEYS}
    anchors = {f"{p}_{a}": places(f"{p}_at_{a}") for p in PARTIES for a in ("name", "street")}
    placed = open_claims.withColumns(heads | anchors)
    far = F.lit(2**40)

    def distance(party: str, key: str) -> Column:
        gap = lambda anchor: f"array_min(transform({party}_{anchor}, i -> abs(i - at_{key})))"
        # The street is itself an anchor, so it is placed by the name alone.
        nearest = gap("name") if key == "street" else f"least({gap('name')}, {gap('street')})"
        return F.coalesce(F.expr(nearest).cast("long"), far)

    measured = placed.withColumns({f"d_{p}_{k}": distance(p, k) for p in PARTIES for k in ADDRESS_KEYS})
    decisions = []
    for k in ADDRESS_KEYS:
        d = {p: F.col(f"d_{p}_{k}") for p in PARTIES}
        open_, owner = F.col(f"head_{k}").isNotNull(), F.col(f"owner_{k}")
        for p, other in (("seller", "buyer"), ("buyer", "seller")):
            loses = open_ & (((owner == "both") & (d[p] >= d[other])) | ((owner == p) & (d[other] < d[p])))
            decisions.append(F.when(loses, F.struct(F.lit(p).alias("party"), F.lit(k).alias("key"))))
    return (
        measured.select(*ids, F.explode(F.array_compact(F.array(*decisions))).alias("lost"))
        .select(*ids, "lost.party", "lost.key")
    )


def resolve_shared_address(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, party, key of the address facts that count as missing."""
    return resolve_in_lines(facts, document_lines(pages))


def resolve_in_lines(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """The same, from the lines of the documents."""
    return losers_in_lines(party_claims(facts, ["doc_id"]), lines, ["doc_id"])
