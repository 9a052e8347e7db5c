"""Secret scans with DataFrame functions alone: fixed patterns, and windows of high entropy.

Matches and the gaps between them come from one split and one extraction of each pattern; a running
sum of their lengths within the document gives places. Candidate strings (long runs of one class
of characters) are folded over character by character: the counts of the last WINDOW characters change
by one that enters and one that leaves, and with them the sum of c * log2(c), in millionths. A run is
reported from the first window to the last one whose entropy reaches its class's threshold; windows that
reach into a part that the allow-list knows don't count, and runs that it knows as a whole don't either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_ids

# Patterns, least lengths, classes of characters, thresholds in bits, allow-list.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same matches as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # likewise: runs are taken whole
WINDOW = 20
CLASSES = {
    "entropy_hex": ("0123456789abcdef", r"[0-9A-Fa-f]{20,}", 3.0),
    "entropy_b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]{20,}", 3.7),
}
#: Bits that a run of letters of both cases and no digit has to reach; other runs without digits or without letters aren't looked at.
LETTERS_BITS = 4.1
ALLOWED_RUN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Parts of runs, in any case, that belong to no secret.
ALLOWED_PARTS = ("example", "0123456789", "abcdefghij")
MASK = "~"
ALLOWED_BEFORE = r"(?i)(md5|sha-?1|sha-?256|sha-?384|sha-?512)[\x20:=-]+$"

KINDS = ["assign", "access", "hex", *CLASSES]
PATTERNS = [ASSIGN, ACCESS, HEX, *(pattern for _, pattern, _ in CLASSES.values())]
#: c * log2(c) in millionths, for the counts that a window can have.
LOGS = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 2)]


def most_sum(bits: float) -> int:
    """Entropy is log2(WINDOW) - sum / WINDOW: it reaches bits if the sum in millionths is at most this."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1e6)


def _parts(kind: int) -> Column:
    """Each match of a pattern with the gap before it; a last gap without a match."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    found = F.zip_with(
        F.split(text, PATTERNS[kind], -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, match: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.right(gap, F.lit(12)).alias("before"), match.alias("match")),
    )
    return F.when(F.rlike(text, pattern), F.filter(found, lambda x: x["match"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,gap:int,before:string,match:string>>"))


def _window_hull(name: str) -> Column:
    """Places in match of the first window's begin and the last one's end that reach the threshold; -1, -1 for none."""
    alphabet, _, bits = CLASSES[name]
    masked = len(alphabet)
    logs = f"array({', '.join(f'{x}L' for x in LOGS)})"
    source = "lower(shown)" if name == "entropy_hex" else "shown"
    ids = f"transform(filter(split({source}, ''), ch -> ch <> ''), ch -> instr('{alphabet}{MASK}', ch) - 1)"
    # the state has the run's symbols, too: a lambda would compute them anew for each step
    start = f"named_struct('ids', {ids}, 'c', array_repeat(0, {masked + 1}), 's', 0L, 'a', -1, 'z', -1)"
    came, left = "get(st.ids, i - 1)", f"get(st.ids, i - 1 - {WINDOW})"
    more = f"{logs}[st.c[{came}] + 1] - {logs}[st.c[{came}]]"
    less = f"{logs}[st.c[{left}] - 1] - {logs}[st.c[{left}]]"
    delta = f"case when i <= {WINDOW} then {more} when {came} = {left} then 0L else {more} + {less} end"
    counts = f"transform(st.c, (x, k) -> x + if(k = {came}, 1, 0) - if(i > {WINDOW} and k = {left}, 1, 0))"
    plain = f"st.c[{masked}] + if({came} = {masked}, 1, 0) - if(i > {WINDOW} and {left} = {masked}, 1, 0) = 0"
    high = f"(i >= {WINDOW} and st.s + ({delta}) <= if(mixed, {most_sum(bits)}L, {most_sum(LETTERS_BITS)}L) and {plain})"
    step = f"named_struct('ids', st.ids, 'c', {counts}, 's', st.s + ({delta}), 'a', if(st.a < 0 and {high}, i - {WINDOW}, st.a), 'z', if({high}, i, st.z))"
    return F.expr(f"aggregate(sequence(1, length(match)), {start}, (st, i) -> {step}, st -> named_struct('a', st.a, 'z', st.z))")


def spans(docs: DataFrame) -> DataFrame:
    """One row per document and match that holds: _rid, doc_id, kind, start, end; documents without a match have one with null kind.

    Places are code points, end exclusive.
    """
    base = row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = base.select("_rid", "doc_id", F.posexplode_outer(F.concat(*[_parts(k) for k in range(len(KINDS))])).alias("at", "x")).select("_rid", "doc_id", "at", "x.*")
    size = F.length("match")
    is_kind = {name: F.col("kind") == k for k, name in enumerate(KINDS)}
    allowed = F.rlike("match", F.lit(ALLOWED_RUN)) | F.rlike("before", F.lit(ALLOWED_BEFORE))
    mixed = F.rlike("match", F.lit("[0-9]")) & F.rlike("match", F.lit("[A-Za-z]"))
    letters = ~F.rlike("match", F.lit("[0-9]")) & F.rlike("match", F.lit("[a-z]")) & F.rlike("match", F.lit("[A-Z]"))
    shown = F.col("match")
    for part in ALLOWED_PARTS:
        shown = F.regexp_replace(shown, f"(?i){part}", MASK * len(part))
    rows = rows.withColumns({"mixed": mixed, "shown": F.when(F.col("kind") >= 3, shown)})
    mixed = F.col("mixed")
    hull = F.when(is_kind["entropy_hex"] & mixed & ~allowed, _window_hull("entropy_hex"))
    hull = hull.when(is_kind["entropy_b64"] & (mixed | letters) & ~allowed & ~F.rlike("match", F.lit("^[0-9A-Fa-f]+$")), _window_hull("entropy_b64"))
    whole = F.struct(F.lit(0).alias("a"), size.alias("z"))
    nothing = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("z"))
    value = F.length(F.regexp_extract("match", ASSIGN, 2))
    part = hull.when(is_kind["assign"] & (value < LEAST_VALUE), nothing).when(F.col("kind") < 3, whole).otherwise(nothing)
    rows = rows.select("_rid", "doc_id", "kind", "at", F.col("gap").cast("long"), size.cast("long").alias("size"), part.alias("part"))
    before = Window.partitionBy("_rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    rows = rows.repartition("_rid").select("_rid", "doc_id", "kind", "part", start.alias("at"))
    holds = F.col("part.z") > 0
    return rows.select("_rid", "doc_id", F.when(holds, F.col("kind")).alias("kind"), (F.col("at") + F.col("part.a")).alias("start"), (F.col("at") + F.col("part.z")).alias("end"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: _rid, doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    docs has doc_id and text and comes from files; other columns are ignored. Null text counts as
    empty; a document without a match has zeros and empty lists. Repeated rows are scanned each; an
    empty table gives no rows. A document's matches are gathered with it.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.concat_ws(":", F.get(names, F.col("kind")), "start", "end")
    listed = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", shown.alias("shown")))))
    rows = spans(docs).groupBy("_rid").agg(F.first("doc_id").alias("doc_id"), listed.alias("all"))

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")

    base = F.array_join(F.filter("all", lambda x: x["kind"] < 3)["shown"], ",")
    return rows.select(
        "_rid", "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.col("all")["shown"], ",").alias("spans")
    )
