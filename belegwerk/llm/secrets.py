"""Secret scans: strong patterns alone, weak candidates where complementary parts of a credential lie close by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

#: Fixed patterns of the strong kinds, in the order in which spans at one start are listed.
ASSIGN = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
          r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak kinds: an unnamed token, a login name, an address of a service.
OPAQUE = r"[A-Za-z0-9/+]{20,}"
#: Login names in either case, as env files write them.
LOGIN = (r"""([uU][sS][eE][rR][nN][aA][mM][eE]|[uU][sS][eE][rR]|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT]"""
         r"""|[cC][lL][iI][eE][nN][tT]_?[iI][dD])["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""")
ENDPOINT = r"""(https?|ftp|ssh|amqps?|jdbc:[a-z]+|postgres(ql)?|mysql|mongodb|redis|s3)://[^\x00-\x20"'<>]+"""

KINDS = ("assign", "access", "hex", "short", "opaque", "login", "endpoint")
STRONG = 3
#: Parts of one credential lie at most this many code points apart.
REACH = 200
_PART = "struct<n:int,kind:int,gap:int,len:int,ok:boolean>"


@dataclass(frozen=True)
class Roles:
    """Which kinds can be which part of a credential (positions in KINDS)."""
    identifier: tuple[int, ...] = (1, 5)
    secret: tuple[int, ...] = (0, 3, 4)
    endpoint: tuple[int, ...] = (6,)


def _hits(text: Column, pattern: str, group: int, kind: Column, ok) -> Column:
    """One struct per match of `pattern`: its rank, the code points since the last match, its own length."""
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda h, g: F.struct(F.lit(group).alias("n"), kind(h).cast("int").alias("kind"), F.length(g).alias("gap"),
                              F.length(h).alias("len"), ok(h).alias("ok")))
    # split() gives one piece more than there are matches; its struct has no length.
    found = F.filter(found, lambda p: p["len"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.lit(None).cast(f"array<{_PART}>"))


def _parts(docs: DataFrame) -> DataFrame:
    """Per document a marker row (kind -1) and one row per match: doc_id, text_key, kind, start, end, copies.

    The positions are running sums over the matches of one pattern in one document."""
    text = F.col("text")
    value = lambda h: F.length(F.regexp_extract(h, ASSIGN, 2))
    fixed = lambda k: (lambda h: F.lit(k))
    always = lambda h: F.lit(True)
    mixed = lambda h: h.rlike("[A-Z]") & h.rlike("[a-z]") & h.rlike("[0-9]")
    arrays = [
        _hits(text, ASSIGN, 0, lambda h: F.when(value(h) >= 12, 0).otherwise(3), lambda h: value(h) >= 6),
        _hits(text, ACCESS, 1, fixed(1), always), _hits(text, HEX, 2, fixed(2), always),
        _hits(text, OPAQUE, 3, fixed(4), mixed), _hits(text, LOGIN, 4, fixed(5), always),
        _hits(text, ENDPOINT, 5, fixed(6), always)]
    marker = F.array(F.struct(F.lit(-1).alias("n"), F.lit(-1).alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("len"),
                              F.lit(True).alias("ok")))
    every = F.flatten(F.array(marker.cast(f"array<{_PART}>"), *(F.coalesce(a, F.array().cast(f"array<{_PART}>")) for a in arrays)))
    rows = docs.select("doc_id", "text_key", F.posexplode(every).alias("at", "p")).select("doc_id", "text_key", "at", "p.*")
    # Keyed by whole rows, so that a document repeated without end is merged where it is read. Then by document, once.
    rows = rows.groupBy("doc_id", "text_key", "n", "at", "kind", "gap", "len", "ok").agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("doc_id", "text_key", "n").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(before)
    return (rows.withColumn("end", end).withColumn("start", end - F.col("len")).where("ok")
            .select("doc_id", "text_key", "kind", "start", "end", "copies"))


def _linked(parts: DataFrame, reach: int, roles: Roles) -> DataFrame:
    """`parts` with `reported`, and for secrets the nearest identifier and endpoint in scope.

    An interval join as one sorted pass per document and direction: for each role the greatest end before and the
    least start after a part say whether one lies within `reach`. No pairs are made, and both frames only grow (the
    later rows are the earlier ones of the reversed order), so dense documents stay linear."""
    doc, up, down = Window.partitionBy("doc_id", "text_key"), ("start", "end", "kind"), [F.desc(c) for c in ("start", "end", "kind")]
    prior, later = (doc.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (up, down))
    start, end = F.col("start"), F.col("end")

    def near(kinds: tuple[int, ...]) -> tuple[Column, Column]:
        mine = F.col("kind").isin(*kinds)
        last = F.max(F.when(mine, F.struct("end", "start"))).over(prior)
        following = F.min(F.when(mine, F.struct("start", "end"))).over(later)
        left = F.when(start - last["end"] <= reach, F.greatest(start - last["end"], F.lit(0)))
        right = F.when(following["start"] - end <= reach, F.greatest(following["start"] - end, F.lit(0)))
        at = (F.when(left.isNotNull() & (right.isNull() | (left <= right)), F.struct(last["start"].alias("start"), last["end"].alias("end")))
              .when(right.isNotNull(), F.struct(following["start"].alias("start"), following["end"].alias("end"))))
        return left.isNotNull() | right.isNotNull(), at

    strong = F.col("kind").between(0, STRONG - 1)
    # In this order a strong span around a part comes before it, or after it with the same start.
    covered = (F.coalesce(F.max(F.when(strong, end)).over(prior) >= end, F.lit(False))
               | F.coalesce(F.min(F.when(strong, start)).over(later) == start, F.lit(False)))
    # A weak candidate wholly inside a strong span is the same secret; it is neither reported nor a partner. One that
    # only overlaps or contains a strong span is a part of its own.
    parts = parts.withColumn("covered", covered).where("kind < 0 or kind < 3 or not covered").drop("covered")
    (has_id, at_id), (has_secret, _), (_, at_end) = (near(r) for r in (roles.identifier, roles.secret, roles.endpoint))
    rule = (F.when(strong, True).when(F.col("kind").isin(*roles.secret), has_id)
            .when(F.col("kind").isin(*roles.identifier), has_secret)
            .when(F.col("kind").isin(*roles.endpoint), has_id & has_secret).otherwise(False))
    secret = F.col("kind").isin(*roles.secret)
    return parts.withColumn("reported", rule).withColumn("identifier", F.when(secret, at_id)).withColumn("endpoint", F.when(secret, at_end))


def scan(docs: DataFrame, reach: int = REACH, roles: Roles = Roles()) -> DataFrame:
    """One row per row of `docs` (doc_id, text_key) with `spans`: array of (start, rank, end, kind), sorted.

    Positions are code points of the whole text, end exclusive. Strong kinds (assign, access, hex) are always
    reported. Weak ones are reported where their complement lies within `reach`: a short assigned value or an opaque
    token needs an identifier (access key or login), a login needs a secret, a service address needs both. Null and
    empty texts have no spans; repeated rows get the same row each; null doc_ids stay; other columns are left out."""
    parts = _linked(_parts(documents(docs)), reach, roles)
    names = F.array(*(F.lit(k) for k in KINDS))
    span = F.when(F.col("reported") & (F.col("kind") >= 0), F.struct(
        "start", F.col("kind").alias("rank"), "end", F.element_at(names, F.col("kind") + 1).alias("kind")))
    found = parts.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(span)).alias("spans"), F.max(F.when(F.col("kind") < 0, F.col("copies"))).alias("copies"))
    return found.select("doc_id", "text_key", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("c")).drop("c")


def credentials(docs: DataFrame, reach: int = REACH, roles: Roles = Roles()) -> DataFrame:
    """The reported secrets of each document with the span of the nearest identifier and endpoint within `reach`
    (null: none): doc_id, kind, start, end, identifier, endpoint. Repeated rows are one document here."""
    names = F.array(*(F.lit(k) for k in KINDS))
    found = _linked(_parts(documents(docs)), reach, roles).where(F.col("reported") & F.col("kind").isin(*roles.secret))
    return found.select("doc_id", F.element_at(names, F.col("kind") + 1).alias("kind"), "start", "end", "identifier", "endpoint")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]", reach: int = REACH) -> DataFrame:
    """`docs`, same rows and columns, with every reported span of `text` replaced by `mask` (touching and overlapping
    spans by one). Rows without spans keep their text, null included. `n_chars`, where there is one, is set anew
    where the text changed. Only documents with spans meet their text in a join; the others are passed on."""
    parts = _linked(_parts(documents(docs)), reach, Roles()).where("reported and kind >= 0")
    doc = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    open_to = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.coalesce(F.col("start") > F.col("open_to"), F.lit(True)), 1).otherwise(0)).over(
        doc.rowsBetween(Window.unboundedPreceding, 0))
    merged = (parts.withColumn("open_to", open_to).withColumn("island", island).groupBy("doc_id", "text_key", "island")
              .agg(F.min("start").alias("s"), F.max("end").alias("e")).groupBy("doc_id", "text_key")
              .agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__cuts")))
    merged = merged.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__cuts")
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    out = docs.withColumn("__text_key", key).join(
        merged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    cuts = F.col("__cuts")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["e"]))
    starts = F.concat(F.transform(cuts, lambda c: c["s"]), F.array(F.length("text").cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring("text", a.cast("int") + 1, (b - a).cast("int")))
    text = F.when(cuts.isNotNull(), F.array_join(kept, mask)).otherwise(F.col("text"))
    changed = out.withColumn("__new", text)
    columns = [F.col("__new").alias("text") if c == "text" else
               F.when(cuts.isNotNull(), F.length("__new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col(f"`{c}`") for c in docs.columns]
    return changed.select(*columns)
