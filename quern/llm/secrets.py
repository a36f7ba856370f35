"""Secret scans, in DataFrame functions only.

Base rules find assignments, access keys and long hex strings. Beyond them, candidate strings are sought in the text
with those matches blanked (assignments, then access keys, then hex strings in what is left), so that what stands
beside a base span in one run of characters is still tested. Candidates are tested by Shannon entropy in a sliding
window: for the class of the candidate (hex, or base64-like) the window moves one character at a time over it, and the
counts of the entering and the leaving character alone are changed (twelve counts of five bits in a number). Entropy is
kept in whole numbers: with c of W characters alike, W log2 W - sum of c log2 c is W times the entropy, and c log2 c
comes from a table of thousandths. A candidate whose best window reaches its class's threshold is a span of kind
``entropy``, unless an allow-list pattern matches the candidate.

Work is in proportion to the text: running offsets and redaction go by blocks of ``BLOCK`` matches, so that no array
grows by one at a time beyond a block.

Offsets are code points, ends exclusive. Spans are ordered by start, then kind as listed.

A null or empty text has no spans, no matter how long a text is nothing is cut off, and null ids, repeated rows, empty
tables and other columns pass through unread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
LONG_ACCESS = "AKIA[A-Z0-9]{12,}"  # the same as matches of [A-Z0-9]+ with 16 characters: a match takes its whole run
LONG_HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy of the best window, in bits a character, by class.
HEX_BITS, BASE64_BITS = 2.9, 3.6
#: Candidates that are no secrets, and why.
ALLOWED = (
    "^[^0-9]*$",  # no digit: long words, paths and identifiers; a random string of 20 has one with a chance of 97 %
    "^[^A-Za-z]*$",  # no letter: numbers, dates, rulers of signs
    "^[A-Za-z+/_=-]*[0-9]{0,4}$",  # words and separators with a year or a version at the end
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs name, they do not admit
    # values that documentation marks as made up
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{4}|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]",
)
#: Matches that are taken together.
BLOCK = 256
#: Counts of five bits in a number.
PACKED = 12
_REST = 2**31 - 1


def parts(count: int) -> int:
    """c log2 c in thousandths."""
    return round(count * math.log2(count) * 1000) if count > 1 else 0


SPAN = "struct<start:int,end:int,rank:int,kind:string>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though it is used many times or inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(items: Column) -> Column:
    """An array in blocks of ``BLOCK``."""
    count = F.ceil(F.size(items) / BLOCK).cast("int")
    each = lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), each)).otherwise(F.array())


def pieces(text: Column, pattern: str, passes) -> Column:
    """(gap, hit, ok) of the leftmost non-overlapping matches of ``pattern`` in order; null where there is none.

    ok: ``passes`` holds for the hit. The last gap has no hit.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("hit"))
    each = lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), (x["hit"].isNotNull() & passes(x["hit"])).alias("ok"))
    return F.when(F.regexp(text, F.lit(pattern)), F.transform(pairs, each))


def spans_of(found: Column, kind: str) -> Column:
    """Spans of the hits that are ok: the lengths of gaps and hits give all offsets by adding up."""
    none = F.array().cast(f"array<{SPAN}>")

    def walk(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), walk)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    spans = let(found, lambda ps: F.aggregate(blocks(ps), start, block, lambda acc: F.flatten(acc["out"])))
    return F.when(found.isNotNull(), spans).otherwise(none)


def blanked(text: Column, found: Column) -> Column:
    """``text`` with as many spaces in place of each hit that is ok."""
    each = lambda x: F.concat(x["gap"], F.when(x["ok"], F.repeat(F.lit(" "), F.length(x["hit"]))).otherwise(F.coalesce(x["hit"], F.lit(""))))
    return F.when(found.isNotNull(), F.array_join(F.transform(found, each), "")).otherwise(text)


def least_parts(candidate: Column) -> Column:
    """The least sum of c log2 c, in thousandths, over the windows of a candidate: its most even window."""
    table = F.array(*[F.lit(parts(c)) for c in range(-1, WINDOW + 2)])  # of c at place c + 2
    numbers = -(-len(ALPHABET) // PACKED)

    def of(count: Column) -> Column:
        return F.element_at(table, count + 2)

    def count(packed: Column, char: Column) -> Column:
        number = F.element_at(packed, F.floor(char / PACKED).cast("int") + 1)
        return F.call_function("shiftright", number, char % PACKED * 5).bitwiseAND(F.lit(31)).cast("int")

    def added(number: Column, k: Column, char: Column) -> Column:
        return F.when(F.floor(char / PACKED).cast("int") == k, F.call_function("shiftleft", F.lit(1).cast("long"), char % PACKED * 5)).otherwise(F.lit(0).cast("long"))

    def walk(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            return let(F.struct(F.element_at(places, i).alias("in"), F.when(i > WINDOW, F.element_at(places, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(-1)).alias("out")), lambda c: moved(acc, i, c["in"], c["out"]))

        def moved(acc: Column, i: Column, coming: Column, going: Column) -> Column:
            same = coming == going
            gone = F.when(going >= 0, count(acc["counts"], F.greatest(going, F.lit(0)))).otherwise(F.lit(0))
            come = count(acc["counts"], coming)
            change = of(gone - 1) - of(gone) + of(come + 1) - of(come)
            total = acc["total"] + F.when(same, F.lit(0)).otherwise(change)
            both = lambda n, k: n + added(n, k, coming) - F.when(going >= 0, added(n, k, F.greatest(going, F.lit(0)))).otherwise(F.lit(0).cast("long"))
            counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], both))
            best = F.when(i < WINDOW, acc["best"]).otherwise(F.least(acc["best"], total))
            return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("counts"), F.lit(0).alias("total"), F.lit(1 << 30).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step, lambda acc: acc["best"])

    places = F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    return let(places, walk)


def is_secret(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.regexp(candidate, F.lit(pattern))
    bits = F.when(F.regexp(candidate, F.lit("^[0-9a-fA-F]+$")), F.lit(most_parts(HEX_BITS))).otherwise(F.lit(most_parts(BASE64_BITS)))
    return F.when(allowed, F.lit(False)).otherwise(least_parts(candidate) <= bits)


def most_parts(bits: float) -> int:
    """The sum of c log2 c, in thousandths, of a window with so many bits a character."""
    return math.floor(1000 * WINDOW * (math.log2(WINDOW) - bits))


def scan_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, spans) for every row of ``df``; spans holds (start, end, rank, kind) in order.

    ``keep`` names columns to return in place of the id alone, for callers that go on with the rows.
    """
    kept = keep or [id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    always = lambda hit: F.lit(True)
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    found = df.select(F.struct(*kept).alias("row"), text.alias("text"))
    found = found.select("row", "text", pieces(F.col("text"), ASSIGN, long_value).alias("assign"))
    found = found.select("row", "text", "assign", pieces(F.col("text"), LONG_ACCESS, always).alias("access"), pieces(F.col("text"), LONG_HEX, always).alias("hex"))
    base = F.concat(*[spans_of(F.col(kind), kind) for kind in KINDS[:3]])
    left = blanked(F.col("text"), F.col("assign"))
    for kind, again in (("access", lambda t: blanked(t, pieces(t, LONG_ACCESS, always))), ("hex", lambda t: blanked(t, pieces(t, LONG_HEX, always)))):
        left = F.when(F.col(kind).isNotNull(), let(left, again)).otherwise(left)  # seldom in a text at all
    found = found.select("row", base.alias("base"), left.alias("left"))
    found = found.select("row", "base", pieces(F.col("left"), CANDIDATE, is_secret).alias("more"))
    every = F.concat("base", spans_of(F.col("more"), "entropy"))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ordered, lambda s: F.struct(s["start"], s["end"], s["rank"], s["kind"])).cast(f"array<{SPAN}>")
    return found.select("row.*", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every span replaced; overlapping spans are one."""

    def walk(acc: Column, s: Column) -> Column:
        gap = F.substring(acc["rest"], F.lit(1), s["start"] - acc["at"])
        end = F.greatest(acc["at"], s["end"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(end.alias("at"), F.substring(acc["rest"], end - acc["at"] + 1, F.lit(_REST)).alias("rest"), out.alias("out"))

    none = F.array().cast("array<string>")

    def block(acc: Column, some: Column) -> Column:
        size = F.greatest(F.array_max(F.transform(some, lambda s: s["end"])) - acc["at"], F.lit(0))
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), F.substring(acc["rest"], F.lit(1), size).alias("rest"), none.alias("out")), walk)
        said = lambda d: F.struct(d["at"].alias("at"), F.substring(acc["rest"], size + 1, F.lit(_REST)).alias("rest"), F.concat(acc["out"], d["out"]).alias("out"))
        return let(done, said)

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), none.alias("out"))
    done = F.aggregate(blocks(spans), start, block, lambda acc: F.array_join(F.concat(acc["out"], F.array(acc["rest"])), ""))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _sql_pattern(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sql_spans(kind: str, pattern: str, passes: str, table: str = "t") -> str:
    """DuckDB text for the spans of one kind."""
    p = _sql_pattern(pattern)
    return f"""
  SELECT doc_id, {KINDS.index(kind)} AS rank, '{kind}' AS kind, pos - length(hit) AS start, pos AS stop, hit FROM (
    SELECT doc_id, hit, sum(length(gap) + length(coalesce(hit, ''))) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
      SELECT doc_id, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap, unnest(list_concat(hits, [NULL])) AS hit FROM (
        SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM {table})))
  WHERE hit IS NOT NULL AND {passes}"""


def _sql_blanked(pattern: str, passes: str, table: str) -> str:
    """DuckDB text for a table with as many spaces in place of each match."""
    p = _sql_pattern(pattern)
    return f"""
  SELECT doc_id, array_to_string([s.gap || CASE WHEN s.hit IS NULL THEN '' WHEN {passes} THEN repeat(' ', length(s.hit)) ELSE s.hit END
    FOR s IN [{{'gap': z[1], 'hit': z[2]}} FOR z IN list_zip(string_split_regex(text, '{p}'), regexp_extract_all(text, '{p}'))]], '') AS text FROM {table}"""


def oracle_sql() -> str:
    """DuckDB text of the query; windows are counted afresh there."""
    table = "[" + ", ".join(str(parts(c)) for c in range(WINDOW + 1)) + "]"
    allowed = " OR ".join(f"regexp_matches(hit, '{_sql_pattern(p)}')" for p in ALLOWED)
    assign = _sql_pattern(ASSIGN)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_sql_spans("assign", ASSIGN, f"length(regexp_extract(hit, '{assign}', 2)) >= 8")}
  UNION ALL {_sql_spans("access", LONG_ACCESS, "true")}
  UNION ALL {_sql_spans("hex", LONG_HEX, "true")}),
t1 AS ({_sql_blanked(ASSIGN, f"length(regexp_extract(s.hit, '{assign}', 2)) >= 8", "t")}),
t2 AS ({_sql_blanked(LONG_ACCESS, "true", "t1")}),
t3 AS ({_sql_blanked(LONG_HEX, "true", "t2")}),
candidates AS (SELECT * FROM ({_sql_spans("entropy", CANDIDATE, "true", "t3")}) WHERE NOT ({allowed})),
windows AS (SELECT doc_id, start, hit, unnest(range(1, length(hit) - {WINDOW} + 2)) AS w FROM candidates),
chars AS (SELECT doc_id, start, hit, w, unnest(string_split(substring(hit, w, {WINDOW}), '')) AS c FROM windows),
counts AS (SELECT doc_id, start, hit, w, c, count(*) AS n FROM chars GROUP BY ALL),
sums AS (SELECT doc_id, start, hit, w, sum({table}[n + 1]) AS total FROM counts GROUP BY ALL),
best AS (SELECT doc_id, start, hit, min(total) AS total FROM sums GROUP BY ALL),
more AS (
  SELECT c.doc_id, c.rank, c.kind, c.start, c.stop, c.hit FROM candidates c JOIN best USING (doc_id, start, hit)
  WHERE total <= CASE WHEN regexp_matches(c.hit, '^[0-9a-fA-F]+$') THEN {most_parts(HEX_BITS)} ELSE {most_parts(BASE64_BITS)} END),
spans AS (SELECT *, concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)) AS said FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
rows AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    count(*) FILTER (rank = 3) AS n_entropy, string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3) AS base_said,
    string_agg(said, ',' ORDER BY start, rank) AS said FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_said, '')) AS base_sha256, coalesce(said, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM t LEFT JOIN rows USING (doc_id)
"""
