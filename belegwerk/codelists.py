"""Code lists as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import model

# The currency codes of ISO 4217.
CURRENCIES: tuple[str, ...] = tuple("""
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF
CHW CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL
HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD
MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF
SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU
UYW UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWG
""".split())


@dataclass(frozen=True)
class CodeLists:
    units: tuple[str, ...] = field(default_factory=model.unit_codes)
    countries: tuple[str, ...] = field(default_factory=model.iso_countries)
    vat_categories: tuple[str, ...] = model.VAT_CATEGORY_CODES
    currencies: tuple[str, ...] = CURRENCIES


@lru_cache(maxsize=8)
def _literals(codes: tuple[str, ...], application: str) -> tuple[Column, ...]:
    """Literals of one list, made once per application: thousands of them take seconds."""
    return tuple(F.lit(c) for c in codes)


def is_unit(code: Column, lists: CodeLists) -> Column:
    """Whether a text is a unit code; null stays null. A list of thousands of codes is one hash set in the plan."""
    return code.isin(*_literals(lists.units, SparkSession.active().sparkContext.applicationId))


def load_codes(spark: SparkSession, path: str, column: str = "code", fmt: str = "csv") -> tuple[str, ...]:
    """Read one official code list. The driver holds it: such a list has thousands of entries, whatever the corpus."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    rows = (
        reader.format(fmt).load(path)
        .select(F.trim(F.col(column)).alias("code")).where("code is not null and code <> ''").distinct().toLocalIterator()
    )
    return tuple(sorted(r.code for r in rows))
