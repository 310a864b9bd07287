"""Invoice model: schemas, field lists and the small fixed tables."""

from __future__ import annotations

from importlib import resources

# Canonical invoice row. Lines are kept in their own table, keyed (doc_id, line_index).
ADDRESS_DDL = "struct<line1:string,line2:string,city:string,postcode:string,country_code:string>"
EADDR_DDL = "struct<scheme:string,value:string>"
SELLER_DDL = (
    "struct<id:string,name:string,legal_registration_id:string,vat_id:string,tax_number:string,"
    f"electronic_address:{EADDR_DDL},address:{ADDRESS_DDL},contact:struct<name:string,phone:string,email:string>>"
)
BUYER_DDL = f"struct<name:string,electronic_address:{EADDR_DDL},address:{ADDRESS_DDL}>"
PAYMENT_DDL = "struct<means_code:string,iban:string,account_name:string>"
INVOICE_DDL = (
    "doc_id string, number string, issue_date string, type_code string, currency string, due_date string, "
    "buyer_reference string, order_reference string, payment_terms string, "
    f"seller {SELLER_DDL}, buyer {BUYER_DDL}, payment {PAYMENT_DDL}"
)
LINE_DDL = (
    "doc_id string, line_index int, id string, name string, quantity string, unit_code string, net_price string, "
    "price_base_quantity string, vat_category string, vat_rate string"
)
EXEMPTION_DDL = "doc_id string, ex_index int, category string, reason string, reason_code string"

EV = "struct<value:string,quote:string,page:int>"
PARTY_EV = ",".join(f"{f}:{EV}" for f in ("name", "street", "addressLine2", "city", "postcode", "country", "electronicAddress"))
EXTRACTION_DDL = (
    "header struct<" + ",".join(f"{f}:{EV}" for f in (
        "invoiceNumber", "issueDate", "dueDate", "buyerReference", "orderReference", "currency", "paymentTerms")) + ">, "
    "seller struct<" + PARTY_EV + "," + ",".join(f"{f}:{EV}" for f in (
        "sellerId", "legalRegistrationId", "vatId", "taxNumber", "contactName", "contactPhone", "contactEmail")) + ">, "
    f"buyer struct<{PARTY_EV}>, "
    f"payment struct<iban:{EV},accountName:{EV}>, "
    f"vatExemptions array<struct<category:{EV},reason:{EV},reasonCode:{EV}>>, "
    "lines array<struct<rowQuote:string,page:int,lineId:string,name:string,quantity:string,unit:string,netPrice:string,"
    "priceBaseQuantity:string,vatCategory:string,vatRate:string,lineAmount:string>>, "
    f"documentTotals struct<lineTotal:{EV},taxTotal:{EV},grandTotal:{EV}>"
)

# --- Fixed values: model path, business term, column of the canonical row ------------------
HEADER_FIELDS: tuple[tuple[str, str, str], ...] = (
    ("number", "BT-1", "number"),
    ("issueDate", "BT-2", "issue_date"),
    ("currency", "BT-5", "currency"),
    ("dueDate", "BT-9", "due_date"),
    ("buyerReference", "BT-10", "buyer_reference"),
    ("orderReference", "BT-13", "order_reference"),
    ("paymentTerms", "BT-20", "payment_terms"),
    ("seller.name", "BT-27", "seller.name"),
    ("seller.id", "BT-29", "seller.id"),
    ("seller.legalRegistrationId", "BT-30", "seller.legal_registration_id"),
    ("seller.vatId", "BT-31", "seller.vat_id"),
    ("seller.taxNumber", "BT-32", "seller.tax_number"),
    ("seller.electronicAddress.value", "BT-34", "seller.electronic_address.value"),
    ("seller.address.line1", "BT-35", "seller.address.line1"),
    ("seller.address.line2", "BT-36", "seller.address.line2"),
    ("seller.address.city", "BT-37", "seller.address.city"),
    ("seller.address.postcode", "BT-38", "seller.address.postcode"),
    ("seller.address.countryCode", "BT-40", "seller.address.country_code"),
    ("seller.contact.name", "BT-41", "seller.contact.name"),
    ("seller.contact.phone", "BT-42", "seller.contact.phone"),
    ("seller.contact.email", "BT-43", "seller.contact.email"),
    ("buyer.name", "BT-44", "buyer.name"),
    ("buyer.electronicAddress.value", "BT-49", "buyer.electronic_address.value"),
    ("buyer.address.line1", "BT-50", "buyer.address.line1"),
    ("buyer.address.line2", "BT-51", "buyer.address.line2"),
    ("buyer.address.city", "BT-52", "buyer.address.city"),
    ("buyer.address.postcode", "BT-53", "buyer.address.postcode"),
    ("buyer.address.countryCode", "BT-55", "buyer.address.country_code"),
    ("payment.iban", "BT-84", "payment.iban"),
    ("payment.accountName", "BT-85", "payment.account_name"),
)
LINE_FIELDS: tuple[tuple[str, str, str], ...] = (
    ("id", "BT-126", "id"),
    ("name", "BT-153", "name"),
    ("quantity", "BT-129", "quantity"),
    ("unitCode", "BT-130", "unit_code"),
    ("netPrice", "BT-146", "net_price"),
    ("priceBaseQuantity", "BT-149", "price_base_quantity"),
    ("vatCategory", "BT-151", "vat_category"),
    ("vatRate", "BT-152", "vat_rate"),
)
DECIMAL_LINE_FIELDS = ("quantity", "netPrice", "priceBaseQuantity", "vatRate")

# Fields that are not business terms of their own but belong to the model.
EXTRA_FIELDS: tuple[tuple[str, str], ...] = (
    ("typeCode", "type_code"),
    ("seller.electronicAddress.scheme", "seller.electronic_address.scheme"),
    ("buyer.electronicAddress.scheme", "buyer.electronic_address.scheme"),
    ("payment.meansCode", "payment.means_code"),
)

PATH_BT = {path: bt for path, bt, _ in HEADER_FIELDS}
LINE_BT = {name: bt for name, bt, _ in LINE_FIELDS}

# Fixed order in which facts claim their evidence; paths outside it never claim.
CLAIM_ORDER: tuple[str, ...] = (
    "seller.name", "buyer.name", "seller.electronicAddress.value", "buyer.electronicAddress.value",
    "number", "buyerReference", "orderReference", "paymentTerms",
    "seller.id", "seller.legalRegistrationId", "seller.vatId", "seller.taxNumber",
    "seller.address.line1", "seller.address.line2", "seller.address.city", "seller.address.postcode",
    "seller.contact.name", "seller.contact.phone", "seller.contact.email",
    "buyer.address.line1", "buyer.address.line2", "buyer.address.city", "buyer.address.postcode",
    "payment.accountName",
)
EXEMPTION_CLAIM_BASE = 1000

# VAT categories the model takes, and the longer official list.
MODEL_VAT_CATEGORIES = ("S", "Z", "E", "AE", "K", "G", "O")
VAT_CATEGORY_CODES = ("AE", "B", "E", "G", "K", "L", "M", "O", "S", "Z")

# Validator rule -> model field the user can supply.
RULE_FIELDS: tuple[tuple[str, str], ...] = (
    ("BR-DE-1", "payment.iban"),
    ("BR-DE-15", "buyerReference"),
    ("BR-DE-3", "seller.address.city"),
    ("BR-DE-4", "seller.address.postcode"),
    ("BR-DE-6", "seller.contact.phone"),
    ("BR-DE-7", "seller.contact.email"),
    ("BR-DE-8", "buyer.address.city"),
    ("BR-DE-9", "buyer.address.postcode"),
    ("BR-62", "seller.electronicAddress.value"),
    ("BR-63", "buyer.electronicAddress.value"),
    ("BR-CO-26", "seller.vatId"),
    ("BR-S-02", "seller.vatId"),
)

# USD per million tokens, (model, input, output).
MODEL_PRICES: tuple[tuple[str, str, str], ...] = (
    ("nvidia/NVIDIA-Nemotron-3-Nano-30B-A3B", "0.06", "0.24"),
    ("nvidia/Nemotron-3_5-Lightning", "0.06", "0.24"),
    ("nvidia/nemotron-3-super-120b-a12b", "0.30", "0.90"),
    ("nvidia/Nemotron-3-Ultra-550b-a55b", "1.00", "3.00"),
)

# Audit event type -> (label, initials, actor).
STATIONS: tuple[tuple[str, str, str, str], ...] = (
    ("INGEST", "Received", "IN", "core"),
    ("EXTRACT", "Read by Nemotron Super", "NEM·S", "model"),
    ("EVIDENCE_CHECK", "Quotes checked", "EVD", "core"),
    ("NORMALIZE", "Normalized", "NRM", "core"),
    ("DERIVE", "Amounts computed", "CALC", "core"),
    ("CONSISTENCY_CHECK", "Totals cross-checked", "CHK", "core"),
    ("BUILD_CII", "XRechnung written", "CII", "core"),
    ("VALIDATE", "Official KoSIT validator", "KoSIT", "verifier"),
    ("REPAIR_PLAN", "Repaired by Nemotron Ultra", "NEM·U", "model"),
    ("PATCH_GUARD", "Patch guard", "PG", "core"),
    ("NEEDS_INPUT", "Returned for your input", "RTN", "core"),
    ("REJECTED", "Rejected", "REJ", "core"),
    ("USER_INPUT", "Your answers recorded", "YOU", "user"),
    ("OUTPUT", "Issued", "OUT", "core"),
)

# Result view, (group, path, label, business term).
VIEW_FIELDS: tuple[tuple[str, str, str, str], ...] = (
    ("Invoice", "number", "Invoice number", "BT-1"),
    ("Invoice", "issueDate", "Issue date", "BT-2"),
    ("Invoice", "dueDate", "Due date", "BT-9"),
    ("Invoice", "buyerReference", "Leitweg-ID / buyer reference", "BT-10"),
    ("Invoice", "orderReference", "Order reference", "BT-13"),
    ("Invoice", "currency", "Currency", "BT-5"),
    ("Seller", "seller.name", "Name", "BT-27"),
    ("Seller", "seller.vatId", "VAT ID", "BT-31"),
    ("Seller", "seller.taxNumber", "Tax number", "BT-32"),
    ("Seller", "seller.legalRegistrationId", "Register entry", "BT-30"),
    ("Seller", "seller.address.line1", "Street", "BT-35"),
    ("Seller", "seller.address.postcode", "Postcode", "BT-38"),
    ("Seller", "seller.address.city", "City", "BT-37"),
    ("Seller", "seller.address.countryCode", "Country", "BT-40"),
    ("Seller", "seller.electronicAddress.value", "Electronic address", "BT-34"),
    ("Seller", "seller.contact.name", "Contact", "BT-41"),
    ("Seller", "seller.contact.phone", "Phone", "BT-42"),
    ("Seller", "seller.contact.email", "E-mail", "BT-43"),
    ("Buyer", "buyer.name", "Name", "BT-44"),
    ("Buyer", "buyer.address.line1", "Street", "BT-50"),
    ("Buyer", "buyer.address.postcode", "Postcode", "BT-53"),
    ("Buyer", "buyer.address.city", "City", "BT-52"),
    ("Buyer", "buyer.address.countryCode", "Country", "BT-55"),
    ("Buyer", "buyer.electronicAddress.value", "Electronic address", "BT-49"),
    ("Payment", "payment.iban", "IBAN", "BT-84"),
    ("Payment", "payment.accountName", "Account holder", "BT-85"),
    ("Payment", "paymentTerms", "Payment terms", "BT-20"),
)

# Document limits.
MAX_UPLOAD_BYTES = 5 * 1024 * 1024
MAX_PAGES = 5
MIN_PAGE_CHARS = 20

GENESIS_HASH = "sha256:" + "0" * 64
#: What is said of a line that did not come in time.
LOST_LINE = "line did not arrive"
DERIVED_O_CODE = "VATEX-EU-O"

# Identifiers written into every invoice XML.
CII_NAMESPACES: tuple[tuple[str, str], ...] = (
    ("rsm", "urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100"),
    ("ram", "urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100"),
    ("qdt", "urn:un:unece:uncefact:data:standard:QualifiedDataType:100"),
    ("udt", "urn:un:unece:uncefact:data:standard:UnqualifiedDataType:100"),
)
GUIDELINE_ID = "urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0"
PROCESS_ID = "urn:fdc:peppol.eu:2017:poacc:billing:01:1.0"


def iso_countries() -> tuple[str, ...]:
    """Alpha-2 codes from the public ISO 3166 table shipped with tzdata, as the invoice standard lists them."""
    table = resources.files("tzdata").joinpath("zoneinfo", "iso3166.tab").read_text(encoding="utf-8")
    codes = {line.split("\t")[0] for line in table.splitlines() if line and not line.startswith("#")}
    # Codes the invoice standard adds to and leaves out of the ISO table.
    return tuple(sorted((codes | {"1A", "AN", "XI"}) - {"SS"}))


def unit_codes() -> tuple[str, ...]:
    """Every code of rule BR-CL-23: the UN/ECE recommendations 20 and 21 (packagings, with an X before their code)."""
    table = resources.files("belegwerk").joinpath("units.csv").read_text(encoding="utf-8")
    return tuple(table.split()[1:])
