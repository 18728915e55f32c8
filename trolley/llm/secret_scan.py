"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong parts are found by their own form: `assign` (a key word, = or :, a value of 6+ characters), `access`
(AKIA access identifiers, 20+ characters) and `hex` (24+ hex digits). Weak candidates say nothing alone:
`bare` (an unmarked word of exactly 40 base64 characters that holds a digit and both cases) and `endpoint`
(the host part of a URL or an IPv4 address). Scopes are windows of `reach` code points: an interval join links
a weak candidate to the parts near it, and it is reported only where complementary parts co-occur: a bare
secret with an access identifier or an endpoint, an endpoint with an access identifier, an assigned, bare or hex secret. The relation
holds both ways, so what one weak candidate is reported for is reported too.

Spans are start (inclusive) and end (exclusive) in code points of the whole text. A null text counts as empty. Every
row of the input gives one row, rows that repeat included; null ids stay null. An empty table gives no rows. A text of any length is searched in one
task, in time that grows with its length and its number of parts.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.common import stored, text_or_empty

#: The forms of the parts.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"(?:https?://[A-Za-z0-9.-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3})"

KINDS = ("assign", "access", "hex", "bare", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, BARE, ENDPOINT), strict=True))
#: What must be near a weak candidate, by kind.
PARTNERS = {"bare": ("access", "endpoint"), "endpoint": ("access", "assign", "hex", "bare")}
REACH = 400


def _found(kind: str, text: Column) -> Column:
    """Matches of one kind in order: the text before each (after the one before) and the match, as lengths.

    Gaps, matches and values are zipped, so each is found once for a text, however many matches there are.
    """
    pattern = PATTERNS[kind]
    all_of = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    hits = all_of(0)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), (all_of(2) if kind == "assign" else hits).alias("value"))
    good = {
        "assign": lambda z: F.length(z["value"]) >= 6, "access": lambda z: F.length(z["hit"]) >= 20,
        "bare": lambda z: (F.length(z["hit"]) == 40) & z["hit"].rlike("[0-9]") & z["hit"].rlike("[a-z]") & z["hit"].rlike("[A-Z]"),
    }.get(kind, lambda z: F.lit(True))
    each = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("length"), good(z).alias("good")))
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,length:int,good:boolean>>")
    return F.when(text.rlike(pattern), each).otherwise(none)


def find_parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end) of strong parts and weak candidates; a row without any has nulls there."""
    t = text_or_empty()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.concat(*[_found(k, t) for k in KINDS]).alias("found"))
    parts = rows.select("row", "doc_id", F.explode_outer("found").alias("x")).select("row", "doc_id", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(so_far)
    return parts.repartition("row").select("row", "doc_id", "kind", "good", (end - F.col("length")).alias("start"), end.alias("end"))


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """row, kind, start, end and the partner (kind, start) of the parts, without weak candidates that no complementary part starts within `reach` of.

    Interval join over cells of `reach` code points: a part in the same cell is near; of the cells beside it only the
    last start before and the first start after can be the nearest, so a cell is one row however full it is. The partner
    is the nearest of these, of equals the one of the kind that stands first in PARTNERS; strong parts have none of their own.
    """
    parts = parts.where(F.col("good")).withColumn("cell", F.floor(F.col("start") / reach))
    ends = [f(F.when(F.col("kind") == k, F.col("start"))).alias(f"{n}_{k}") for k in KINDS for n, f in (("first", F.min), ("last", F.max))]
    cells = parts.groupBy("row", "cell").agg(*ends)
    by_row = Window.partitionBy("row").orderBy("cell")
    for k in KINDS:
        for n, step in (("last", F.lag), ("first", F.lead)):
            beside = step("cell").over(by_row) == F.col("cell") + (-1 if n == "last" else 1)
            cells = cells.withColumn(f"beside_{n}_{k}", F.when(beside, step(f"{n}_{k}").over(by_row)))

    def partner(kinds: tuple[str, ...]) -> Column:
        starts = [(i, k, F.col(f"{n}_{k}")) for i, k in enumerate(kinds) for n in ("first", "last", "beside_last", "beside_first")]
        each = [F.when(F.abs(F.col("start") - at) <= reach, F.struct(F.abs(F.col("start") - at).alias("apart"), F.lit(i).alias("i"), F.lit(k).alias("kind"), at.alias("start"))) for i, k, at in starts]
        return F.array_min(F.array_compact(F.array(*each)))

    joined = parts.join(cells, ["row", "cell"])
    found = F.when(F.col("kind") == "bare", partner(PARTNERS["bare"])).when(F.col("kind") == "endpoint", partner(PARTNERS["endpoint"]))
    joined = joined.withColumn("partner", found).where(~F.col("kind").isin(*PARTNERS) | F.col("partner").isNotNull())
    return joined.select("row", "kind", "start", "end", F.col("partner.kind").alias("partner_kind"), F.col("partner.start").alias("partner_start"))


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id and spans (array of start, order, kind, end, partner_kind, partner_start; sorted) for every row of docs."""
    parts = stored(find_parts(docs), "secret-parts")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    linked = link_parts(parts, reach).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("rank"), "kind", "end", "partner_kind", "partner_start"))).alias("spans"))
    rows = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,partner_kind:string,partner_start:bigint>>")
    return rows.join(linked, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digests(scanned: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    link = lambda s: F.concat(F.concat_ws(":", s["kind"], s["start"]), F.lit(">"), F.concat_ws(":", s["partner_kind"], s["partner_start"]))
    links = F.array_join(F.transform(F.filter("spans", lambda s: s["partner_kind"].isNotNull()), link), ",")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"),
                          F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), links.alias("links"))
