"""Building a test corpus: dressing, splits, document defects, noisy variants, manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import printing as P
from ..functions.text import WS, strip


@dataclass(frozen=True)
class Pools:
    """What placeholders are filled with; invented, and any other names will do."""
    sellers: tuple[str, ...] = ("Mühlbach Druck GmbH", "Sandner Elektro KG", "Ostwerk Planung GmbH", "Falkner & Reuß OHG", "Tiefenthal Software UG")
    buyers: tuple[str, ...] = ("Stadt Rosenfurt", "Kreisamt Wiesengrund", "Landesarchiv Oberau", "Gemeindewerke Steinach")
    streets: tuple[str, ...] = ("Mühlweg 4", "Am Alten Hof 16", "Schulgasse 9", "Werftstraße 31b", "Gartenring 2")
    second_lines: tuple[str, ...] = ("Aufgang C", "2. Stock", "Postfach 88")
    cities: tuple[str, ...] = ("Rosenfurt", "Wiesengrund", "Oberau", "Steinach", "Kaltenbrunn")
    people: tuple[str, ...] = ("Ines Vogt", "Karim Daher", "Britta Loos", "Jonas Ahrens")
    registrations: tuple[str, ...] = ("HRB 7031 Amtsgericht Rosenfurt", "HRA 254 Amtsgericht Steinach")
    items: tuple[str, ...] = ("Wartungsvertrag Aufzug", "Schulung Brandschutz", "Lieferung Papier A4")


# --- Fixed values ---------------------------------------------------------------------------
PLACEHOLDER = r"(?iu)^\[[^\]]*\]\z|^…\z|^nicht vorhanden\z|^-\z"

# Document defects (id, expected outcome, fields, rule, accepted anyway, who it applies to).
MUTATIONS: tuple[tuple[str, str, str, str, bool, str], ...] = (
    ("missing-buyer-reference", "needs-input", "BT-10", "BR-DE-15", False, "any"),
    ("missing-seller-tax-ids", "needs-input", "BT-31,BT-32", "BR-CO-26", False, "all-standard"),
    ("missing-iban", "needs-input", "BT-84", "BR-DE-1", False, "paid"),
    ("missing-seller-phone", "needs-input", "BT-42", "BR-DE-6", False, "any"),
    ("missing-seller-email", "needs-input", "BT-43", "BR-DE-7", False, "any"),
    ("missing-buyer-electronic-address", "needs-input", "BT-49", "BR-63", False, "any"),
    ("missing-seller-electronic-address", "needs-input", "BT-34", "BR-62", False, "any"),
    ("missing-seller-city", "needs-input", "BT-37", "BR-DE-3", False, "any"),
    ("missing-buyer-city", "needs-input", "BT-52", "BR-DE-8", False, "any"),
    ("exempt-without-reason", "rejected", "BT-120", "BR-E-10", False, "all-standard-no-exemption"),
    ("grand-total-off", "warning", "BT-112", "none", False, "any"),
    ("vat-amount-off", "warning", "BT-110", "none", False, "any"),
    ("unit-as-german-word", "normalize", "BT-130", "BR-CL-23", True, "any"),
    ("invalid-currency-symbol", "normalize", "BT-5", "BR-CL-04", False, "any"),
)
BASES_PER_MUTATION = 2

# Fixed values: (set, name, number format, date format, label variant, shuffled blocks, split pages).
VARIANTS: tuple[tuple[str, str, str, str, int, bool, bool], ...] = (
    ("clean", "classic", "de", "de", 0, False, False),
    ("clean", "modern", "de", "de", 0, False, False),
    ("clean", "compact", "de", "de", 0, False, False),
    ("noisy", "noisy-a", "plain", "iso", 1, True, False),
    ("noisy", "noisy-b", "de", "long", 0, False, True),
)

# Single-field defects a good invoice must be refused for (case, rule).
NEGATIVE_CASES: tuple[tuple[str, str], ...] = (
    ("invalid currency code", "BR-CL-04"),
    ("grand total does not add up", "BR-CO-15"),
    ("missing buyer reference", "BR-DE-15"),
    ("invalid VAT category code", "BR-CL-18"),
)
# ---------------------------------------------------------------------------------------------


def _pick(pool: tuple[str, ...], seed: Column, salt: int) -> Column:
    values = F.array(*[F.lit(v) for v in pool])
    return F.get(values, ((seed * 7 + salt * 13) % len(pool)).cast("int"))


def _dress_text(col: Column, seed: Column, items: tuple[str, ...]) -> Column:
    bracketed = F.regexp_replace(col, F.lit(r"\[(?:\.\.\.|…)\]"), _pick(items, seed, 1))
    return F.replace(bracketed, F.lit("…"), _pick(items, seed, 2))


def dress_invoices(invoices: DataFrame, lines: DataFrame, pools: Pools = Pools()) -> tuple[DataFrame, DataFrame]:
    """Fill bracket placeholders from `pools`; invoices carry a seed column. Long line ids become positions."""
    seed = F.col("seed").cast("long")
    fill = lambda c, pool, salt: F.when(strip(F.col(c)).rlike(PLACEHOLDER), _pick(pool, seed, salt)).otherwise(F.col(c))
    number = F.when(
        strip(F.col("number")).rlike(r"(?i)^rechnungsnummer\z"),
        F.concat(F.lit("RE-"), F.substring("issue_date", 1, 4), F.lit("-"), (1000 + seed).cast("string"))).otherwise(F.col("number"))
    phone = F.when(
        F.col("seller.contact.phone").rlike(r"\[|…"),
        F.concat(F.lit("+49 30 "), (4400 + seed % 90).cast("string"), (100 + seed).cast("string"), F.lit("-0"))).otherwise(F.col("seller.contact.phone"))
    seller_name = fill("seller.name", pools.sellers, 0)

    def address(party: str, salts: tuple[int, int, int]) -> Column:
        a = F.col(f"{party}.address")
        for name, pool, salt in zip(("line1", "line2", "city"), (pools.streets, pools.second_lines, pools.cities), salts):
            a = a.withField(name, fill(f"{party}.address.{name}", pool, salt))
        return a

    holder = F.when(strip(F.col("payment.account_name")).rlike(PLACEHOLDER), seller_name).otherwise(F.col("payment.account_name"))
    dressed = invoices.withColumns({
        "number": number,
        "payment_terms": _dress_text(F.col("payment_terms"), seed, pools.items),
        "seller": F.col("seller").withField("name", seller_name)
        .withField("legal_registration_id", fill("seller.legal_registration_id", pools.registrations, 1))
        .withField("address", address("seller", (2, 3, 4)))
        .withField("contact.name", fill("seller.contact.name", pools.people, 5)).withField("contact.phone", phone),
        "buyer": F.col("buyer").withField("name", fill("buyer.name", pools.buyers, 6)).withField("address", address("buyer", (7, 8, 9))),
        "payment": F.when(F.col("payment").isNotNull(), F.col("payment").withField("account_name", holder)),
    })
    long_id = F.col("id").rlike(rf"[{WS}]|\[|…") | (F.length("id") > 4)
    new_lines = lines.join(invoices.select("doc_id", "seed"), "doc_id").withColumns({
        "name": _dress_text(F.col("name"), seed, pools.items),
        "id": F.when(long_id, (F.col("line_index") + 1).cast("string")).otherwise(F.col("id")),
    }).drop("seed")
    return dressed, new_lines


def holdout_split(ids: DataFrame, salt: str, n: int) -> DataFrame:
    """The n ids with the lowest sha256(salt:id). Only n rows per task travel."""
    ranked = ids.select("doc_id", F.sha2(F.concat(F.lit(salt + ":"), "doc_id"), 256).alias("rank_hash"))
    return ranked.orderBy("rank_hash").limit(n)


def diff_manifest(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Ids that are new or whose hash changed; removed ids are not reported."""
    before = previous.select("id", F.col("sha256").alias("before"))
    return current.join(before, "id", "left").where(~F.col("before").eqNullSafe(F.col("sha256"))).select("id")


def corpus_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("set", "holdout").agg(F.count(F.lit(1)).alias("n"))


def sort_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("id")


def select_entries(manifest: DataFrame, set_name: str, holdout: bool = False, limit: int | None = None, unlocked: bool = False) -> DataFrame:
    """Entries of one set, first N by id. The holdout is refused unless it is unlocked on purpose."""
    if holdout and not unlocked:
        raise PermissionError("the holdout is locked; unlock it deliberately")
    entries = manifest.where((F.col("set") == set_name) & (F.col("holdout") == holdout))
    return entries if limit is None else sort_manifest(entries).limit(limit)


def select_in_scope(invoices: DataFrame) -> DataFrame:
    """Commercial invoices in EUR by credit transfer or without means, with none of the amounts the model lacks."""
    zero = lambda c: F.coalesce(F.col(c).cast("decimal(18,2)"), F.lit(0)) == 0
    return invoices.where(
        (F.col("type_code") == "380") & (F.col("currency") == "EUR") & zero("allowances") & zero("charges")
        & zero("prepaid") & zero("rounding") & F.coalesce(F.col("means_code") == "58", F.lit(True)))


# --- defects ----------------------------------------------------------------------------------


def mutation_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, *m) for i, m in enumerate(MUTATIONS)],
        "k int, mutation_id string, expect string, fields string, detected_by string, accepted_anyway boolean, applies_to string")


def mutation_bases(invoices: DataFrame, lines: DataFrame, exemptions: DataFrame, holdout: DataFrame) -> DataFrame:
    """(mutation_id, doc_id): for mutation k the candidates (3k + j) mod n in id order, never from the holdout.

    Only as many candidates as the largest index asks for are ever ranked.
    """
    reach = 3 * (len(MUTATIONS) - 1) + BASES_PER_MUTATION
    standard = lines.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("vat_category") == "S", F.lit(False))).alias("standard"))
    exempted = exemptions.select("doc_id").distinct().withColumn("exempted", F.lit(True))
    known = (
        invoices.select("doc_id", F.col("payment").isNotNull().alias("paid")).join(holdout.select("doc_id"), "doc_id", "left_anti")
        .join(standard, "doc_id", "left").join(exempted, "doc_id", "left")
    )
    std = F.coalesce("standard", F.lit(True))
    fits = {"any": F.lit(True), "all-standard": std, "paid": F.col("paid"), "all-standard-no-exemption": std & F.col("exempted").isNull()}
    chosen: DataFrame | None = None
    for name, test in fits.items():
        pool = known.where(test).select("doc_id")
        first = pool.orderBy("doc_id").limit(reach).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
        wanted = mutation_table(invoices.sparkSession).where(F.col("applies_to") == name).select(
            "k", "mutation_id", F.explode(F.array(*[F.lit(j) for j in range(BASES_PER_MUTATION)])).alias("j"))
        # first holds at most `reach` ids, and there are at most as many only if the pool has no more.
        picked = wanted.join(F.broadcast(first)).where(F.size("ids") > 0).select(
            "mutation_id", "k", "j", F.get("ids", (F.col("k") * 3 + F.col("j")) % F.size("ids")).alias("doc_id"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return chosen


def mutate_invoices(invoices: DataFrame) -> DataFrame:
    """invoices(.., mutation_id) with the defect of the row applied. Empty text marks 'not on the document'."""
    m = F.col("mutation_id")
    none = F.lit(None).cast("string")
    is_ = lambda name: m == name
    seller, buyer = F.col("seller"), F.col("buyer")
    no_ids = seller.withField("vat_id", none).withField("tax_number", none).withField("id", none).withField("legal_registration_id", none)
    blank = F.lit("")
    new_seller = (
        F.when(is_("missing-seller-tax-ids"), no_ids)
        .when(is_("missing-seller-phone"), seller.withField("contact.phone", blank))
        .when(is_("missing-seller-email"), seller.withField("contact.email", blank))
        .when(is_("missing-seller-electronic-address"), seller.withField("electronic_address.value", blank))
        .when(is_("missing-seller-city"), seller.withField("address.city", blank))
        .otherwise(seller)
    )
    new_buyer = (
        F.when(is_("missing-buyer-electronic-address"), buyer.withField("electronic_address.value", blank))
        .when(is_("missing-buyer-city"), buyer.withField("address.city", blank))
        .otherwise(buyer)
    )
    return invoices.withColumns({
        "buyer_reference": F.when(is_("missing-buyer-reference"), blank).otherwise(F.col("buyer_reference")),
        "currency": F.when(is_("invalid-currency-symbol"), F.lit("€")).otherwise(F.col("currency")),
        "seller": new_seller, "buyer": new_buyer,
        "payment": F.when(~is_("missing-iban"), F.col("payment")),
    })


def mutate_lines(lines: DataFrame) -> DataFrame:
    """lines(.., mutation_id): exempt lines without a reason, or units as German words."""
    m = F.col("mutation_id")
    exempt = m == "exempt-without-reason"
    return lines.withColumns({
        "vat_category": F.when(exempt, F.lit("E")).otherwise(F.col("vat_category")),
        "vat_rate": F.when(exempt, F.lit("0")).otherwise(F.col("vat_rate")),
        "unit_code": F.when(m == "unit-as-german-word", F.when(F.col("line_index") % 2 == 0, "Stück").otherwise("Stunde")).otherwise(F.col("unit_code")),
    })


def printed_amounts(totals: DataFrame) -> DataFrame:
    """totals(.., mutation_id) as printed: some defects change the printed amount only."""
    m = F.col("mutation_id")
    money = lambda c, name, off: (F.col(c) + F.when(m == name, F.lit(off)).otherwise(F.lit("0.00")).cast("decimal(18,2)")).cast("decimal(18,2)").alias(c)
    return totals.select("doc_id", "mutation_id", "line_total", money("tax_total", "vat-amount-off", "0.10"), money("grand_total", "grand-total-off", "1.00"))


def mutate_corpus(invoices: DataFrame, lines: DataFrame, totals: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chosen base documents with their defects: (invoices, lines, printed totals), keyed by (doc_id, mutation_id)."""
    chosen = bases.select("doc_id", "mutation_id")
    return (
        mutate_invoices(invoices.join(chosen, "doc_id")), mutate_lines(lines.join(chosen, "doc_id")),
        printed_amounts(totals.join(chosen, "doc_id")))


def corpus_union(invoices: DataFrame, totals: DataFrame, mutated: DataFrame, printed: DataFrame) -> DataFrame:
    """The whole corpus as one table with its truth: every clean and noisy variant of `invoices` and every mutated one.

    mutated and printed come from `mutate_corpus`. Columns: id ('set/doc-name'), set, name, source_id, the truth as in the
    invoice table, and the printed tax_total and grand_total (null where a document has no lines). A mutated entry's
    truth is the mutated invoice; its printed amounts may differ from what the truth gives."""
    facts = [c for c in invoices.columns if c != "doc_id"]
    varied = variant_rows(invoices)
    pages = varied.select(F.col("doc_id").alias("id"), "set", F.col("variant").alias("name"), "source_id", *facts)
    amounts = totals.select(F.col("doc_id").alias("source_id"), "tax_total", "grand_total")
    plain = pages.join(amounts, "source_id", "left")
    hurt = mutated.join(printed.select("doc_id", "mutation_id", "tax_total", "grand_total"), ["doc_id", "mutation_id"], "left").select(
        F.concat(F.lit("mutated/"), F.col("doc_id").cast("string"), F.lit("-"), "mutation_id").alias("id"), F.lit("mutated").alias("set"),
        F.col("mutation_id").alias("name"), F.col("doc_id").alias("source_id"), *facts, "tax_total", "grand_total")
    return plain.unionByName(hurt)


def check_mutations(cases: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """cases(case_id, detected_by, accepted_anyway) -> hit, valid, ok. Rule 'none' has to stay valid."""
    hits = findings.select("case_id", "rule_id").distinct()
    joined = (
        cases.join(hits.withColumn("found", F.lit(True)), (hits.case_id == cases.case_id) & (hits.rule_id == cases.detected_by), "left")
        .select(cases["*"], F.col("found").isNotNull().alias("hit"))
        .join(decisions.select("case_id", "valid"), "case_id", "left")
    )
    valid = F.coalesce("valid", F.lit(False))
    ok = F.when(F.col("detected_by") == "none", valid).otherwise(F.col("hit") & (valid == F.col("accepted_anyway")))
    return joined.select("case_id", "detected_by", "hit", valid.alias("valid"), ok.alias("ok"))


def each_case(df: DataFrame) -> DataFrame:
    """Every row once per defect, with case_no; doc_id becomes 'doc|case number'."""
    return df.withColumn("case_no", F.explode(F.array(*[F.lit(i) for i in range(len(NEGATIVE_CASES))]))).withColumn(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("case_no").cast("string")))


def negative_cases(invoices: DataFrame, lines: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every good invoice with each single-field defect; doc_id becomes 'doc|case number'."""
    case = F.col("case_no")
    bad_invoices = each_case(invoices).withColumns({
        "currency": F.when(case == 0, F.lit("XYZ")).otherwise(F.col("currency")),
        "buyer_reference": F.when(case != 2, F.col("buyer_reference"))})
    bad_lines = each_case(lines).withColumn(
        "vat_category", F.when((case == 3) & (F.col("vat_category") == "S"), F.lit("Q")).otherwise(F.col("vat_category")))
    bad_totals = each_case(totals).withColumn(
        "grand_total", F.when(case == 1, F.lit("999999.99").cast("decimal(18,2)")).otherwise(F.col("grand_total")))
    return bad_invoices, bad_lines, bad_totals


# --- printed pages ----------------------------------------------------------------------------


def variant_rows(invoices: DataFrame) -> DataFrame:
    """One row per invoice (or any other row with a doc_id) and variant; doc_id becomes 'set/doc-name'."""
    rows = F.array(*[
        F.struct(F.lit(s).alias("set"), F.lit(n).alias("variant"), F.lit(nf).alias("number_format"), F.lit(df).alias("date_format"),
                 F.lit(lv).alias("label_variant"), F.lit(sh).alias("shuffled"), F.lit(sp).alias("split"))
        for s, n, nf, df, lv, sh, sp in VARIANTS])
    spread = invoices.withColumn("v", F.explode(rows)).withColumn("source_id", F.col("doc_id")).select("*", "v.*").drop("v")
    return spread.withColumn("doc_id", F.concat("set", F.lit("/"), F.col("source_id").cast("string"), F.lit("-"), "variant"))


def format_facts(invoices: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """invoices(.., number_format, date_format, label_variant) -> printed(doc_id, block, seq, text) of the header, with the
    columns `keep`, as below.

    Blocks: 0 seller, 1 buyer, 2 references, 6 bank, terms. An absent fact is not printed.
    """
    v, nf, df = F.col("label_variant"), F.col("number_format"), F.col("date_format")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    fact = lambda name, value: F.concat(P.label(name, v), F.lit(": "), value)
    electronic = lambda p: fact("electronicAddress", F.concat(
        given(f"{p}.electronic_address.value"),
        F.coalesce(F.concat(F.lit(" ("), P.label("scheme", v), F.lit(": "), given(f"{p}.electronic_address.scheme"), F.lit(")")), F.lit(""))))
    city_line = lambda p: F.nullif(F.concat_ws(" ", given(f"{p}.address.postcode"), given(f"{p}.address.city")), F.lit(""))
    address = lambda p: [given(f"{p}.address.line1"), given(f"{p}.address.line2"), city_line(p), given(f"{p}.address.country_code")]
    blocks = [
        (0, [given("seller.name"), *address("seller"), fact("contact", given("seller.contact.name")), fact("phone", given("seller.contact.phone")),
             fact("email", given("seller.contact.email")), electronic("seller"), fact("vatId", given("seller.vat_id")),
             fact("taxNumber", given("seller.tax_number")), fact("legalRegistrationId", given("seller.legal_registration_id")), fact("sellerId", given("seller.id"))]),
        (1, [given("buyer.name"), *address("buyer"), electronic("buyer")]),
        (2, [fact("number", given("number")), fact("issueDate", P.print_date(given("issue_date"), df)), fact("dueDate", P.print_date(given("due_date"), df)),
             fact("buyerReference", given("buyer_reference")), fact("orderReference", given("order_reference")), fact("currency", given("currency"))]),
        (6, [fact("iban", given("payment.iban")), fact("accountName", given("payment.account_name")), fact("paymentTerms", given("payment_terms"))]),
    ]
    rows = [
        F.when(text.isNotNull(), F.struct(F.lit(b).alias("block"), F.lit(i).alias("seq"), text.alias("text")))
        for b, texts in blocks for i, text in enumerate(texts)]
    return invoices.select("doc_id", *keep, F.explode(F.array_compact(F.array(*rows))).alias("r")).select("doc_id", *keep, "r.*")


def line_text() -> Column:
    """The printed line of a row as `format_lines` takes it."""
    v, nf = F.col("label_variant"), F.col("number_format")
    text = lambda c: F.coalesce(c, F.lit(""))
    unit = F.nullif(F.col("unit_code"), F.lit(""))
    base_unit = F.coalesce(F.concat(F.lit(" "), F.coalesce(P.unit_label(unit), unit)), F.lit(""))
    base = F.nullif(F.col("price_base_quantity"), F.lit(""))
    cells = [
        text(F.col("id")), text(F.col("name")), text(P.print_decimal(F.col("quantity"), nf)), text(P.print_unit(unit)),
        text(P.print_amount(F.col("net_price"), nf)), F.concat(P.label("per", v), F.lit(" "), P.print_decimal(base, nf), base_unit),
        P.print_line_vat(F.nullif(F.col("vat_category"), F.lit("")), F.nullif(F.col("vat_rate"), F.lit("")), nf, v),
        P.print_amount(F.col("net_amount").cast("string"), nf)]
    return F.concat_ws(" ", *cells)


def format_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """lines(.., net_amount, number_format, label_variant) -> printed(doc_id, block 3, seq, text), one row per line."""
    return lines.select("doc_id", *keep, F.lit(3).alias("block"), F.col("line_index").alias("seq"), line_text().alias("text"))


def format_totals(printed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """printed(doc_id, line_total, tax_total, grand_total, number_format, label_variant) -> block 5."""
    v, nf = F.col("label_variant"), F.col("number_format")
    rows = [
        F.struct(F.lit(5).alias("block"), F.lit(i).alias("seq"), F.concat(P.label(name, v), F.lit(": "), P.print_amount(F.col(c).cast("string"), nf)).alias("text"))
        for i, (name, c) in enumerate((("lineTotal", "line_total"), ("taxTotal", "tax_total"), ("grandTotal", "grand_total")))]
    return printed.select("doc_id", *keep, F.explode(F.array(*rows)).alias("r")).select("doc_id", *keep, "r.*")


def format_vat(breakdown: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """breakdown(.., number_format, label_variant) -> block 4, one row per VAT group."""
    v, nf = F.col("label_variant"), F.col("number_format")
    label = F.when(F.col("vat_category") == "O", F.concat(P.label("notTaxable", v), F.lit(" (O)"))).otherwise(
        F.concat(P.label("vatShort", v), F.lit(" "), P.print_rate(F.col("rate"), nf), F.lit(" ("), "vat_category", F.lit(")")))
    text = F.concat(label, F.lit(" "), P.label("taxableBase", v), F.lit(" "), P.print_amount(F.col("taxable_amount").cast("string"), nf),
                    F.lit(": "), P.print_amount(F.col("tax_amount").cast("string"), nf))
    return breakdown.select("doc_id", *keep, F.lit(4).alias("block"), F.col("first_line").alias("seq"), text.alias("text"))


def format_exemptions(exemptions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """exemptions(.., label_variant) -> block 7."""
    body = F.concat_ws(" ", F.nullif(F.col("reason"), F.lit("")), F.concat(F.lit("("), F.nullif(F.col("reason_code"), F.lit("")), F.lit(")")))
    text = F.concat(P.label("exemption", F.col("label_variant")), F.lit(" ("), "category", F.lit("): "), body)
    return exemptions.where("coalesce(reason,'') <> '' or coalesce(reason_code,'') <> ''").select(
        "doc_id", *keep, F.lit(7).alias("block"), F.col("ex_index").alias("seq"), text.alias("text"))


#: Rows of a block that are joined to one piece of text first.
CHUNK = 256


def _pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(doc_id, keys, block, seq, text, shuffled, split) -> doc_id, pieces: per document its pieces of text, each with its
    keys, its page and its place there. A piece is a chunk of one block; it is made first, so that only finished pieces
    meet. Rows that lie by document are not moved."""
    block, late = F.col("block"), F.col("split") & (F.col("block") >= 3)
    placed = rows.select(
        "doc_id", *keys, "text", F.when(late, 2).otherwise(1).alias("page"),
        (F.when(F.col("shuffled") & (block <= 2), 2 - block).otherwise(block).cast("long") * 1_000_000_000 + F.col("seq")).alias("at"))
    chunks = placed.groupBy("doc_id", *keys, "page", F.floor(F.col("at") / CHUNK).alias("c")).agg(
        F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda r: r["text"]), "\n")
    return chunks.groupBy("doc_id").agg(F.collect_list(F.struct(*keys, "page", "c", text.alias("t"))).alias("pieces"))


def _whole_pages(docs: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The pieces of all parts -> doc_id, keys, page, text."""
    met = docs
    for i, part in enumerate(parts):
        # Merged, not broadcast: a row per document, whose estimated size goes by compressed files.
        met = met.join(part.withColumnRenamed("pieces", f"__p{i}").hint("merge"), "doc_id", "left")
    met = met.select("doc_id", F.flatten(F.array_compact(F.array(*[f"__p{i}" for i in range(len(parts))]))).alias("pieces"))
    page = lambda p: F.struct(*[p[k].alias(k) for k in [*keys, "page"]])
    each = met.withColumn("g", F.explode(F.array_distinct(F.transform("pieces", page))))
    own = F.array_sort(F.transform(F.filter("pieces", lambda p: page(p) == F.col("g")), lambda p: F.struct(p["c"].alias("c"), p["t"].alias("t"))))
    return each.select("doc_id", "g.*", F.array_join(F.transform(own, lambda p: p["t"]), "\n").alias("text"))


def text_pages(blocks: list[DataFrame], options: DataFrame) -> DataFrame:
    """printed blocks, one table or several, + options(doc_id, shuffled, split) -> page(doc_id, page, text).

    Shuffled documents print their first three blocks in reverse; split ones start the line table on page 2. A block is in
    one table. Tables that lie by document are not moved: each is brought together apart, and only its pieces meet.
    """
    chosen = options.select("doc_id", "shuffled", "split").hint("merge")
    return _whole_pages(options.select("doc_id").distinct(), [_pieces(b.join(chosen, "doc_id"), []) for b in blocks], [])


#: Variants that print alike, by what decides how they print: a page of them is made once.
_STYLES = tuple({v[2:]: None for v in VARIANTS})
_STYLE = ("number_format", "date_format", "label_variant", "shuffled", "split")


def noise_variants(invoices: DataFrame, nets: DataFrame, breakdown: DataFrame, totals: DataFrame, exemptions: DataFrame) -> DataFrame:
    """All clean and noisy text pages of the given invoices, from tables by their number; doc_id becomes 'set/doc-name'."""
    styles = F.array(*[F.struct(F.lit(i).alias("style"), *[F.lit(v).alias(k) for k, v in zip(_STYLE, s)]) for i, s in enumerate(_STYLES)])
    given = invoices.select("doc_id").hint("merge")
    # An invoice that comes twice is printed twice, by each of its options.
    spread = lambda df: df.join(given, "doc_id").withColumn("s", F.explode(styles)).select("*", "s.*").drop("s")
    of = lambda df: spread(df.join(given, "doc_id"))
    keep = ("style", "shuffled", "split")
    parts = [
        format_facts(spread(invoices), keep), format_lines(of(nets), keep), format_vat(of(breakdown), keep), format_totals(of(totals), keep),
        format_exemptions(of(exemptions), keep)]
    pages = _whole_pages(invoices.select("doc_id").distinct(), [_pieces(p, ["style"]) for p in parts], ["style"])
    names = F.array(*[F.array(*[F.struct(F.lit(v[0]).alias("set"), F.lit(v[1]).alias("variant")) for v in VARIANTS if v[2:] == s]) for s in _STYLES])
    named = pages.withColumn("v", F.explode(F.get(names, F.col("style"))))
    return named.select(F.concat("v.set", F.lit("/"), F.col("doc_id").cast("string"), F.lit("-"), "v.variant").alias("doc_id"), "page", "text")
