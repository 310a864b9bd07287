"""Printed value -> code or format. Every function returns struct(value, reason); one of both is NULL.

Unknown or ambiguous input gives a reason, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codelists import CodeLists, is_unit
from .text import WS, WS_CHARS, let, strip

# --- Fixed values ---------------------------------------------------------------------------
UNIT_WORDS = {
    "stück": "H87", "stk": "H87", "st": "H87", "piece": "H87", "pcs": "H87",
    "stunde": "HUR", "stunden": "HUR", "std": "HUR", "h": "HUR", "hour": "HUR", "hours": "HUR",
    "minute": "MIN", "minuten": "MIN", "min": "MIN",
    "tag": "DAY", "tage": "DAY", "day": "DAY", "days": "DAY",
    "woche": "WEE", "wochen": "WEE",
    "monat": "MON", "monate": "MON", "month": "MON",
    "jahr": "ANN", "jahre": "ANN", "year": "ANN",
    "kilogramm": "KGM", "kg": "KGM", "gramm": "GRM", "g": "GRM", "tonne": "TNE", "t": "TNE",
    "meter": "MTR", "m": "MTR", "kilometer": "KMT", "km": "KMT", "zentimeter": "CMT", "cm": "CMT",
    "quadratmeter": "MTK", "m²": "MTK", "qm": "MTK", "kubikmeter": "MTQ", "m³": "MTQ",
    "liter": "LTR", "l": "LTR",
    "pauschale": "LS", "pauschal": "LS", "pausch": "LS", "lump sum": "LS",
    "einheit": "C62", "eh": "C62",
    "packung": "XPK", "paket": "XPK", "karton": "XCT", "palette": "XPX", "rolle": "XRO", "satz": "SET",
}
COUNTRY_WORDS = {
    "deutschland": "DE", "germany": "DE", "bundesrepublik deutschland": "DE",
    "österreich": "AT", "austria": "AT", "schweiz": "CH", "switzerland": "CH",
    "frankreich": "FR", "niederlande": "NL", "belgien": "BE", "luxemburg": "LU", "italien": "IT",
    "spanien": "ES", "polen": "PL", "tschechien": "CZ", "dänemark": "DK",
}
VAT_WORDS = (
    ("reverse charge|steuerschuldnerschaft des leistungsempfängers|§ ?13b", "AE"),
    ("innergemeinschaftliche (lieferung|leistung)|intra-community", "K"),
    ("ausfuhr|export", "G"),
    ("nicht steuerbar|not subject to vat|außerhalb des anwendungsbereichs", "O"),
    ("steuerfrei|umsatzsteuerbefreit|exempt|§ ?4 ustg|§ ?19 ustg|kleinunternehmer", "E"),
    ("nullsatz|zero rated", "Z"),
)
MONTHS = {
    "januar": "01", "jänner": "01", "februar": "02", "märz": "03", "april": "04", "mai": "05", "juni": "06",
    "juli": "07", "august": "08", "september": "09", "oktober": "10", "november": "11", "dezember": "12",
}
IBAN_SHAPE = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\z"
VATEX_SHAPE = r"^(?i:VATEX-[A-Z0-9-]+)\z"
LEITWEG_SHAPE = r"^(?i:[0-9]{2,12}(-[A-Z0-9]{1,30})?-[0-9]{2})\z"
EMAIL_INSIDE = rf'[^{WS}@()<>,;:"]+@[^{WS}@()<>,;:"]+\.[A-Za-z]{{2,}}'
SCHEME_NOTE = rf"(?i)\(?[{WS}]*Schema[{WS}]*:?[{WS}]*[A-Z0-9]+[{WS}]*\)?[{WS}]*\z"
# ---------------------------------------------------------------------------------------------


def result(value: Column, reason: Column) -> Column:
    """Accepted when value is not NULL, else refused with the reason."""
    return F.struct(value.alias("value"), F.when(value.isNull(), reason).alias("reason"))


def _says(before: str, raw: Column) -> Column:
    return F.concat(F.lit(before + ' "'), raw, F.lit('"'))


def _word_key(col: Column) -> Column:
    low = F.lower(strip(col))
    return F.regexp_replace(F.regexp_replace(low, r"\.\z", ""), f"[{WS}]+", " ")


def _lookup(words: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in words.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def _if_in(code: Column, codes: tuple[str, ...]) -> Column:
    return F.when(code.isin(*codes), code)


def unit(raw: Column, lists: CodeLists) -> Column:
    def rule(text: Column) -> Column:
        bracketed = F.upper(F.regexp_extract(text, rf"\(([A-Za-z0-9]{{2,3}})\)[{WS}]*\z", 1))
        # One test for all three: the list is long, and each mention of it takes the driver time.
        known = F.filter(F.array(bracketed, text, F.upper(text)), lambda code: is_unit(code, lists))
        return F.coalesce(F.get(known, F.lit(0)), _lookup(UNIT_WORDS, _word_key(text)))

    return let(let(strip(raw), rule), lambda code: result(code, _says("unknown unit", raw)))


def country(raw: Column, lists: CodeLists) -> Column:
    def rule(text: Column) -> Column:
        code = F.when(F.length(text) == 2, _if_in(F.upper(text), lists.countries))
        return F.coalesce(code, _lookup(COUNTRY_WORDS, _word_key(text)))

    return let(let(strip(raw), rule), lambda code: result(code, _says("unknown country", raw)))


def vat_category(raw: Column, rate: Column | None, lists: CodeLists) -> Column:
    """raw may be NULL (nothing printed); rate is a normalised decimal string or NULL."""
    unknown = _says("unknown VAT category", F.coalesce(raw, F.lit("")))
    if rate is None:
        reason, by_rate = unknown, []
    else:
        reason = F.when(rate.isNotNull(), F.lit("0 % without a category is ambiguous")).otherwise(unknown)
        by_rate = [F.when(rate.try_cast("decimal(38,10)") > 0, F.lit("S"))]

    def rule(text: Column) -> Column:
        found = [F.when(F.length(text) <= 2, _if_in(F.upper(text), lists.vat_categories))]
        found += [F.when(text.rlike(f"(?iu){words}"), F.lit(code)) for words, code in VAT_WORDS]
        return F.coalesce(*found, *by_rate)

    return let(let(F.coalesce(strip(raw), F.lit("")), rule), lambda code: result(code, reason))


def electronic_address(raw: Column) -> Column:
    mail = F.nullif(F.regexp_extract(raw, EMAIL_INSIDE, 0), F.lit(""))
    bare = F.nullif(strip(F.regexp_replace(raw, SCHEME_NOTE, "")), F.lit(""))
    return let(F.coalesce(mail, bare), lambda v: result(v, F.lit("empty electronic address")))


def address_scheme(value: Column, is_buyer: Column) -> Column:
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("EM"))
        .when(is_buyer & value.rlike(LEITWEG_SHAPE), F.lit("0204"))
    )


def currency(raw: Column) -> Column:
    text = strip(raw)
    return result(
        F.when(F.lower(text).isin("eur", "€", "euro"), F.lit("EUR")).when(text.rlike(r"^[A-Z]{3}\z"), text),
        _says("unknown currency", raw),
    )


def date(raw: Column) -> Column:
    iso, dotted = r"^(\d{4})-(\d{2})-(\d{2})\z", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\z"
    worded = rf"^(\d{{1,2}})\.[{WS}]*([a-zäöüA-ZÄÖÜ]+)[{WS}]+(\d{{4}})\z"
    two = lambda c: F.lpad(c, 2, "0")

    def rebuilt(text: Column) -> Column:
        part = lambda pattern, n: F.regexp_extract(text, pattern, n)
        month = _lookup(MONTHS, F.lower(part(worded, 2)))
        return (
            F.when(text.rlike(iso), text)
            .when(text.rlike(dotted), F.concat_ws("-", part(dotted, 3), two(part(dotted, 2)), two(part(dotted, 1))))
            .when(text.rlike(worded), F.concat(part(worded, 3), F.lit("-"), month, F.lit("-"), two(part(worded, 1))))
        )

    def judged(built: Column) -> Column:
        y, m, d = (F.substring(built, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        real = m.between(1, 12) & (d >= 1) & (d <= days)
        reason = F.coalesce(F.concat(F.lit("invalid date "), built), _says("unrecognized date", raw))
        return result(F.when(built.isNotNull() & real, built), reason)

    return let(let(strip(raw), rebuilt), judged)


def decimal(raw: Column, number_format: Column) -> Column:
    """number_format is 'de', 'plain' or NULL (unknown: only unambiguous numbers pass)."""
    without = lambda c, sign: F.replace(c, F.lit(sign), F.lit(""))
    first_comma_to_dot = lambda c: F.regexp_replace(c, r"^([^,]*),", "$1.")
    is_de = F.coalesce(number_format == "de", F.lit(False))

    def measured(bare: Column) -> Column:
        t = F.regexp_replace(bare, r"^-|-\z", "")
        return F.struct(
            t.alias("t"), bare.rlike(r"^-|-\z").alias("negative"),
            (F.length(t) - F.length(without(t, "."))).alias("dots"), (F.length(t) - F.length(without(t, ","))).alias("commas"),
            (t.rlike(r"^[0-9.,]+\z") & t.rlike("[0-9]")).alias("numeric"))

    def unified(m: Column) -> Column:
        t, dots, commas = m["t"], m["dots"], m["commas"]
        three_after_dot = t.rlike(r"^[^.]*\.[^.]{3}\z")
        last_is_comma = t.rlike(r",[^.]*\z")
        unclear = (commas == 0) & (dots > 0) & (
            ((dots > 1) & ~is_de) | ((dots == 1) & three_after_dot & number_format.isNull())
        )
        plain = (
            F.when((dots > 0) & (commas > 0), F.when(last_is_comma, first_comma_to_dot(without(t, "."))).otherwise(without(t, ",")))
            .when(commas > 1, without(t, ","))
            .when(commas == 1, first_comma_to_dot(t))
            .when((dots > 1) | ((dots == 1) & three_after_dot & is_de), without(t, "."))
            .otherwise(t)
        )
        return F.struct(plain.alias("plain"), m["negative"].alias("negative"), m["numeric"].alias("numeric"), unclear.alias("unclear"))

    def judged(u: Column) -> Column:
        plain = u["plain"]
        signed = F.when(u["negative"] & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)
        good = u["numeric"] & ~u["unclear"] & plain.rlike(r"^[0-9]+(\.[0-9]+)?\z")
        reason = F.when(u["numeric"] & u["unclear"], _says("ambiguous number", raw)).otherwise(_says("not a number", raw))
        return result(F.when(good, signed), reason)

    bare = F.regexp_replace(F.regexp_replace(strip(raw), rf"(?i)[{WS}]|€|eur", ""), r"^\+", "")
    # Digits alone, or with one comma after all points, read the same in every format, with a euro sign after them or not.
    digits = F.rtrim(strip(raw), F.lit("€" + WS_CHARS))
    known = F.replace(without(digits, "."), F.lit(","), F.lit("."))
    plainly = F.struct(known.alias("value"), F.lit(None).cast("string").alias("reason"))
    return F.when(digits.rlike(r"^[0-9]+\z|^[0-9][0-9.]*,[0-9]+\z"), plainly).otherwise(let(let(let(bare, measured), unified), judged))


def rate(raw: Column, number_format: Column) -> Column:
    return decimal(F.replace(raw, F.lit("%"), F.lit("")), number_format)


def iban(raw: Column) -> Column:
    compact = F.upper(F.regexp_replace(raw, f"[{WS}]", ""))
    return let(compact, lambda t: result(F.when(t.rlike(IBAN_SHAPE), t), F.lit("not an IBAN")))


def exemption_code(raw: Column) -> Column:
    t = F.regexp_replace(raw, "[()]", "")
    return result(F.when(t.rlike(VATEX_SHAPE), t), F.lit("not a VATEX exemption code"))


def line_name(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"\\n|\n", " "), f"[{WS}]+", " ")


def payment_terms(raw: Column) -> Column:
    return F.replace(raw, F.lit("\\n"), F.lit("\n"))
