"""Adapters: the test tables seen as invoices, lines, pages, audit events and model calls."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import amounts, ordering, tables
from ..session import materialise, materialise_by


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _pad(c: Column | str, n: int) -> Column:
    return F.lpad(_text(c), n, "0")


class Tables:
    """One folder of parquet tables, with the adapters built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- invoices -----------------------------------------------------------------------------

    @cached_property
    def flat_invoices(self) -> DataFrame:
        o, k = F.col("o_orderkey"), F.col("o_custkey")
        nation = self.table("nation")
        joined = (
            self.table("orders").withColumn("s_suppkey", F.expr("o_custkey div 15"))
            .join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
            .join(self.table("supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
            .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_nation")), "c_nationkey")
            .join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation")), "s_nationkey")
        )
        s = F.col("s_suppkey")
        unless = lambda n, value: F.when(o % n != 0, value)
        only = lambda n, value: F.when(o % n == 0, value)
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        mail = o % 2 == 1
        columns = {
            "doc_id": o,
            "number": unless(101, F.concat(F.lit("R-"), _text(o))),
            "issue_date": unless(103, day(F.col("o_orderdate"))),
            "type_code": F.lit("380"),
            "currency": F.when(o % 89 == 0, "USD").when(o % 97 == 0, "€").when(o % 107 == 0, None).otherwise("EUR"),
            "due_date": only(3, day(F.date_add(F.col("o_orderdate").cast("date"), 30))),
            "buyer_reference": unless(7, F.concat(F.lit("04011000-"), _pad(k, 5), F.lit("-"), _pad(o % 100, 2))),
            "order_reference": only(2, F.concat(F.lit("PO-"), _text(o))),
            "payment_terms": F.when(o % 5 == 0, "#SKONTO#TAGE=14#PROZENT=2.00#").otherwise("Zahlbar innerhalb von 30 Tagen"),
            "seller.id": only(3, F.concat(F.lit("L-"), _text(s))),
            "seller.name": F.when(o % 109 == 0, "").otherwise(F.col("s_name")),
            "seller.legal_registration_id": only(6, F.concat(F.lit("HRB "), _text(s), F.lit(" Amtsgericht"))),
            "seller.vat_id": unless(4, F.concat(F.lit("DE"), _pad(s, 9))),
            "seller.tax_number": only(8, F.concat(F.lit("12/345/"), _pad(s, 5))),
            "seller.electronic_address.scheme": F.when(o % 113 == 0, "").when(o % 11 != 0, "EM"),
            "seller.electronic_address.value": unless(11, F.concat(F.lit("rechnung@s"), _text(s), F.lit(".example"))),
            "seller.address.line1": F.concat(F.lit("Hafenstraße "), _text(s + 1)),
            "seller.address.line2": only(10, F.lit("Gebäude B")),
            "seller.address.city": unless(13, F.col("s_nation")),
            "seller.address.postcode": unless(37, _text(10000 + F.col("s_nationkey") * 37)),
            "seller.address.country_code": F.when(o % 71 == 0, "ZZ").otherwise("DE"),
            "seller.contact.name": unless(41, F.concat(F.lit("Kontakt "), _text(s))),
            "seller.contact.phone": unless(19, F.concat(F.lit("+49 30 "), _text(100000 + s))),
            "seller.contact.email": unless(23, F.concat(F.lit("kontakt@s"), _text(s), F.lit(".example"))),
            "buyer.name": F.col("c_name"),
            "buyer.electronic_address.scheme": unless(29, F.when(mail, "EM").otherwise("0204")),
            "buyer.electronic_address.value": unless(29, F.when(mail, F.concat(F.lit("c"), _text(k), F.lit("@kunde.example"))).otherwise("04011000-12345-03")),
            "buyer.address.line1": F.concat(F.lit("Am Markt "), _text(k + 1)),
            "buyer.address.line2": F.lit(None).cast("string"),
            "buyer.address.city": unless(31, F.col("c_nation")),
            "buyer.address.postcode": _text(20000 + F.col("c_nationkey") * 11),
            "buyer.address.country_code": F.when(F.col("c_nationkey") % 5 == 0, "AT").otherwise("DE"),
            "payment.means_code": unless(17, F.lit("58")),
            "payment.iban": unless(17, F.concat(F.lit("DE79"), _pad(k, 18))),
            "payment.account_name": F.when((o % 17 != 0) & mail, F.col("s_name")),
        }
        return joined.select(*[c.alias(n) for n, c in columns.items()])

    @cached_property
    def invoices(self) -> DataFrame:
        """Stored, like the invoice table of a real pipeline: many jobs below read it several times, and planning its
        joins and columns anew in each place costs more than the write."""
        return materialise(tables.nest_invoice(self.flat_invoices), "invoices")

    RAW = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_tax", "l_returnflag")

    @cached_property
    def _raw_lines(self) -> DataFrame:
        """Lines as they are stored: numbers, which take less room on the way than the texts made of them."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), *self.RAW)

    @cached_property
    def _line_facts(self) -> DataFrame:
        """Lines without a position."""
        return self._as_line(self._raw_lines)

    def _as_line(self, raw: DataFrame, *more: str) -> DataFrame:
        pct = F.round(F.col("l_tax") * 100).cast("int")
        number = F.col("l_linenumber")
        category = F.when(pct > 0, "S").when(F.col("l_returnflag") == "R", "O").when(F.col("l_returnflag") == "A", "E").otherwise("Z")
        units = F.array(*[F.lit(u) for u in ("H87", "HUR", "KGM", "C62", "XPP", "Stück", "MTR")])
        return raw.select(
            "doc_id", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
            F.concat(F.lit("Artikel "), _text("l_partkey")).alias("name"),
            _text(F.col("l_quantity").cast("int")).alias("quantity"),
            F.get(units, (number - 1) % 7).alias("unit_code"),
            _text(F.col("l_extendedprice").cast("decimal(18,2)")).alias("net_price"),
            F.when(number > 1, _text(number)).alias("price_base_quantity"),
            category.alias("vat_category"),
            F.when(category != "O", F.when(number % 2 == 0, F.concat(_text(pct), F.lit(".00"))).otherwise(_text(pct))).alias("vat_rate"),
            *more,
        )

    ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")

    @cached_property
    def unplaced_lines(self) -> DataFrame:
        """Lines whose position is the sort key itself: enough where only 'first' matters, and free of a window."""
        return self._line_facts.withColumn("line_index", F.struct(*self.ORDER)).drop(*self.ORDER)

    @cached_property
    def placed_facts(self) -> DataFrame:
        """An order has a handful of lines, so a window per order places them."""
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*self.ORDER)) - 1
        return self._as_line(self._raw_lines.withColumn("line_index", number.cast("int")), "line_index")

    @cached_property
    def lines(self) -> DataFrame:
        """Stored for the same reason; amounts alone are computed from `lazy_lines`."""
        return materialise(self.lazy_lines, "lines")

    @cached_property
    def keyed_invoices(self) -> DataFrame:
        """The same, stored by document: for jobs that join invoices with invoices."""
        return materialise_by(tables.nest_invoice(self.flat_invoices), "invoices", "doc_id")

    @cached_property
    def keyed_lines(self) -> DataFrame:
        """The same, stored by document and position: for jobs that join lines with lines."""
        return materialise_by(self.lazy_lines, "lines", "doc_id", "line_index")

    @cached_property
    def doc_lines(self) -> DataFrame:
        """The same, stored by document, where the window that places them leaves them: for jobs that bring all of a
        document together."""
        return materialise_by(self.lazy_lines, "lines", "doc_id", placed=True)

    @cached_property
    def lazy_lines(self) -> DataFrame:
        return self.placed_facts.drop(*self.ORDER).withColumn("id", _text(F.col("line_index") + 1))

    @cached_property
    def exemptions(self) -> DataFrame:
        return self._exempt(self._line_facts)

    @cached_property
    def doc_exemptions(self) -> DataFrame:
        return self._exempt(self.doc_lines)

    @staticmethod
    def _exempt(lines: DataFrame) -> DataFrame:
        kinds = lines.where("vat_category in ('E', 'O')").select("doc_id", "vat_category").distinct()
        even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
        return kinds.where(((F.col("vat_category") == "E") & even) | ((F.col("vat_category") == "O") & third)).select(
            "doc_id", F.when(F.col("vat_category") == "E", 0).otherwise(1).alias("ex_index"), F.col("vat_category").alias("category"),
            F.when(F.col("vat_category") == "E", "als gemeinnützig anerkannt").alias("reason"),
            F.when(F.col("vat_category") == "O", "VATEX-EU-O").when(F.col("doc_id") % 4 == 0, "VATEX-EU-132").alias("reason_code"))

    @cached_property
    def nets(self) -> DataFrame:
        return amounts.derive_line_net(self.unplaced_lines)

    @cached_property
    def placed_nets(self) -> DataFrame:
        return amounts.derive_line_net(self.lazy_lines)

    @cached_property
    def doc_nets(self) -> DataFrame:
        return amounts.derive_line_net(self.doc_lines)

    @cached_property
    def breakdown(self) -> DataFrame:
        return amounts.vat_breakdown(self.nets)

    @cached_property
    def placed_breakdown(self) -> DataFrame:
        return amounts.vat_breakdown(self.placed_nets)

    @cached_property
    def totals(self) -> DataFrame:
        return amounts.invoice_totals(self.breakdown)

    @cached_property
    def printed_totals(self) -> DataFrame:
        """Even documents print what was computed, plus a cent on every tenth; odd ones print the order total."""
        even = F.col("doc_id") % 2 == 0
        off = F.when(F.col("doc_id") % 10 == 0, F.lit("0.01")).otherwise("0.00").cast("decimal(18,2)")
        joined = self.totals.join(self.table("orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice"), "doc_id")
        return joined.select(
            "doc_id", F.when(even, F.col("line_total")).alias("line_total"),
            F.when(even, (F.col("tax_total") + off).cast("decimal(18,2)")).alias("tax_total"),
            F.when(even, F.col("grand_total")).otherwise(F.col("o_totalprice").cast("decimal(18,2)")).alias("grand_total"))

    # --- pages and quotes ---------------------------------------------------------------------

    @cached_property
    def pages(self) -> DataFrame:
        """Page 1 is the document; page 2 prints its size as an amount, German for two thirds of them."""
        n = F.col("n_chars").cast("decimal(12,2)")
        german = F.concat(_text(F.floor(F.col("n_chars") / 1000)), F.lit("."), _pad(F.col("n_chars") % 1000, 3), F.lit(",50 €"))
        plain = F.concat(_text(n), F.lit(" USD"))
        amount = F.when(F.col("doc_id") % 3 == 0, plain).otherwise(german)
        docs = self.table("documents")
        second = docs.select("doc_id", F.lit(2).alias("page"), F.concat(F.lit("Summe: "), amount, F.lit("\nDatum 04.04.2016")).alias("text"))
        return docs.select("doc_id", F.lit(1).alias("page"), "text").unionByName(second)

    @cached_property
    def quotes(self) -> DataFrame:
        """Quotes from all over the documents, one per thousand characters: some upper-cased, some reversed, some on the
        wrong page, some empty."""
        last = F.floor(F.greatest(F.length("text") - 10, F.lit(0)) / 1000).cast("int")
        # Cut before they become rows, so that no row carries its document's text.
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", F.lit(10) + F.lit(1000) * i, F.lit(40)))
        pieces = self.table("documents").select("doc_id", F.posexplode(cut).alias("i", "piece"))
        d, piece = F.col("doc_id") + F.col("i"), F.col("piece")
        quote = (
            F.when(d % 5 == 1, F.translate(piece, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(d % 5 == 2, F.reverse(piece)).when(d % 5 == 3, F.replace(piece, F.lit(" "), F.lit("  ")))
            .when(d % 50 == 4, F.lit("  ")).otherwise(piece)
        )
        page = F.when(d % 7 == 0, 3).when(d % 11 == 0, 2).otherwise(1)
        value = F.when(d % 13 == 0, F.lit("fehlt")).when(d % 17 == 0, F.lit(" ")).otherwise(F.substring(quote, 5, 12))
        return pieces.select("doc_id", F.lit("paymentTerms").alias("path"), value.alias("value"), quote.alias("quote"), page.alias("page"))

    @cached_property
    def text_items(self) -> DataFrame:
        """Conversation turns as positioned text items."""
        t = F.col("turn")
        return self.table("conversations").select(
            F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), t.alias("seq"),
            F.when(t % 5 == 4, F.lit("  ")).otherwise(F.col("text")).alias("str"),
            F.when(F.col("role") == "user", 700.0).otherwise(700.5 + F.col("conv_id") % 2).alias("y"), (t % 3 == 1).alias("has_eol"))

    # --- runs, calls, requests ----------------------------------------------------------------

    @cached_property
    def audit_events(self) -> DataFrame:
        kinds = F.create_map(*[F.lit(x) for kv in {
            "view": "INGEST", "signup": "DERIVE", "error": "REJECTED", "click": "EVIDENCE_CHECK", "purchase": "OUTPUT"}.items() for x in kv])
        ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        placed = ordering.index_rows(
            self.table("events").withColumn("run_id", _text("user_id")), ["run_id"], [F.col("ts"), F.col("event_id")], [F.to_date("ts")], "seq")
        none = F.lit(None).cast("string")
        return placed.select(
            "run_id", "seq", ts.alias("ts"), kinds[F.col("event_type")].alias("type"), F.lit('{"kind":"core","version":"0.1.0"}').alias("actor"),
            none.alias("input_hash"), none.alias("output_hash"), F.col("props").alias("data"), "event_id")

    @cached_property
    def model_calls(self) -> DataFrame:
        names = F.create_map(*[F.lit(x) for kv in {
            "view": "nvidia/NVIDIA-Nemotron-3-Nano-30B-A3B", "signup": "nvidia/Nemotron-3_5-Lightning", "click": "nvidia/nemotron-3-super-120b-a12b",
            "purchase": "nvidia/Nemotron-3-Ultra-550b-a55b", "error": "unknown/model"}.items() for x in kv])
        e = F.col("event_id")
        return self.table("events").select(
            e.alias("call_id"), _text("user_id").alias("run_id"), "ts", names[F.col("event_type")].alias("model"),
            (1000 + e * 37 % 5000).alias("prompt_tokens"), (100 + e * 11 % 900).alias("completion_tokens"))

    @cached_property
    def requests(self) -> DataFrame:
        ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
        return self.table("events").select(_text("user_id").alias("key"), F.col("event_id").alias("request_id"), ms.alias("at_ms"))

    @cached_property
    def got_invoices(self) -> DataFrame:
        """A perturbed reading of the invoices: some fields wrong, some lost, some invented."""
        d = F.col("doc_id")
        return self.keyed_invoices.withColumns({
            "number": F.when(d % 10 == 0, F.concat("number", F.lit("x"))).otherwise(F.col("number")),
            "buyer_reference": F.when(d % 14 == 0, F.lit("erfunden")).otherwise(F.col("buyer_reference")),
            "order_reference": F.when(d % 6 != 0, F.col("order_reference")),
        })

    @cached_property
    def got_lines(self) -> DataFrame:
        d, i = F.col("doc_id"), F.col("line_index")
        return self.keyed_lines.where((d % 9 != 0) | (i > 0)).withColumns({
            "quantity": F.when((d % 8 == 0) & (i == 1), F.lit("999")).otherwise(F.concat("quantity", F.lit(".0")))})
