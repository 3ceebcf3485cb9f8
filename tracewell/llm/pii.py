"""Personal data by patterns, checksums and context, in DataFrame functions only (operator 7).

A pattern's matches are put between MARKs and the text is split there, so that odd parts are matches and the
lengths of parts give positions in code points. Validators confirm: Luhn for cards, mod-97 for ibans, ranges
and digit counts for the rest. Words within CONTEXT characters raise or lower the score. The base kinds
(email, ip, card, phone) stay whatever their score; the added kinds (iban, ssn) need LEAST.

The patterns give the leftmost matches of the plain ones in their comments: possessive quantifiers where no
backtracking can help, and a look-behind that skips starts inside a run, which fail as its first start did;
\\G lets a match begin where the last one ended. So time is linear in the text.

Defined results. Null text: empty, no spans. A MARK in a text counts as another character that no pattern
holds. Overlapping spans of different kinds are all reported; `redact` merges them. Null and repeated doc_id:
each row for itself. Extra columns are ignored by `find`, and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

MARK, OTHER = "\uffff", "\ufffe"
CONTEXT = 40
#: Parts of a text, or spans, that are gone through with one array of results.
CHUNK = 128
LEAST = 0.5
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[ -]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # \b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b, for words in ASCII
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    # \b[0-9]{3}-[0-9]{2}-[0-9]{4}\b
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
#: Without this a text has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
RAISE = {
    "email": "e-?mail|contact|write|mail", "ip": r"(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server|login", "card": "card|visa|credit|master|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf|handy", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social|security",
}
LOWER = {"email": "example|noreply", "ip": "version|release|section", "card": "order|invoice|serial|isbn|tracking", "phone": "order|invoice|serial|isbn", "iban": "order|serial|part no", "ssn": "order|serial|part no"}
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _number(digits: Column, least: int, most: int) -> Column:
    return F.length(digits).between(least, most)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(_number(digits, 16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return _number(F.regexp_replace(match, "[^0-9]", ""), 8, 15)
    if kind == "iban":
        return mod97(F.translate(match, " ", ""))
    if kind == "ssn":
        return match.rlike("^(?!000|666|9)...-(?!00)..-(?!0000)")
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.substring(before, -CONTEXT, CONTEXT), F.lit(" "), F.substring(after, 1, CONTEXT)))
    up, down = F.when(near.rlike(RAISE[kind]), 0.2).otherwise(0.0), F.when(near.rlike(LOWER[kind]), 0.3).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(SCORES[kind]) + up - down)), 2)


def _chunked(values: Column, first: Column, total, run) -> Column:
    """The concatenated results of run(chunk, start, index) over chunks of CHUNK values; start: `total` of (start, chunk) over those before.

    Appending to an array copies it, so a chunk has an array of its own and time stays linear in the values.
    """
    chunk = lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK))
    last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    starts = F.when(last > 0, F.aggregate(F.sequence(F.lit(1), last), F.array(first), lambda acc, c: F.concat(acc, F.array(total(F.element_at(acc, -1), chunk(c - 1)))))).otherwise(F.array(first))
    many = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda c: run(chunk(c), F.element_at(starts, c + 1), c * CHUNK)))
    return F.when(last > 0, many).otherwise(run(values, first, F.lit(0)))


def _spans(kind: str, parts: Column) -> Column:
    """Spans of one kind from a text's parts."""
    none = F.expr(f"cast(array() as {SPAN})")

    def step(acc: Column, part: Column) -> Column:
        n = F.length(part).cast("bigint")
        before, after = F.element_at(parts, acc["i"]), F.element_at(parts, acc["i"] + 2)
        rated = score(kind, before, after)
        good = valid(kind, part) & (F.lit(True) if kind in BASE else rated >= LEAST)
        span = F.array(F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), (acc["at"] + n).alias("end"), rated.alias("score")))
        found = F.when(acc["i"] % 2 == 1, F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"])).otherwise(acc["spans"])
        return F.struct((acc["at"] + n).alias("at"), (acc["i"] + 1).alias("i"), found.cast(SPAN).alias("spans"))

    def run(chunk: Column, at: Column, i: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), i.alias("i"), none.alias("spans")), step, lambda acc: acc["spans"])

    zero = F.lit(0).cast("bigint")
    length = lambda at, chunk: F.aggregate(chunk, at, lambda n, part: n + F.length(part))
    return F.when(F.size(parts) > 1, _chunked(parts, zero, length, run)).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with one more column: all spans by kind as in KINDS, then start."""
    marked = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, OTHER)
    digit, names = fresh(docs, "__digit"), {kind: fresh(docs, f"__{kind}") for kind in KINDS}
    parts = {}
    for kind in KINDS:
        may = F.instr(marked, NEEDS[kind]) > 0 if kind in NEEDS else F.lit(True)
        if kind != "email":
            may = may & F.col(digit)
        parts[names[kind]] = F.split(F.when(may, F.regexp_replace(marked, PATTERNS[kind], f"{MARK}$0{MARK}")).otherwise(""), MARK)
    out = docs.withColumn(digit, F.coalesce(F.col(text), F.lit("")).rlike("[0-9]")).withColumns(parts)
    spans = F.concat(*(_spans(kind, F.col(names[kind])) for kind in KINDS))
    return out.withColumn(into, spans).drop(digit, *parts)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with [KIND] for each span; overlapping spans become one, under the kind of the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.expr("cast(array() as array<string>)")

    def step(acc: Column, s: Column) -> Column:
        # substring's positions are ints
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(kept, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def run(chunk: Column, at: Column, _: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    ends = lambda at, chunk: F.greatest(at, F.array_max(F.transform(chunk, lambda s: s["end"])))
    zero = F.lit(0).cast("bigint")
    tail = F.substring(text, (ends(zero, ordered) + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(_chunked(ordered, zero, ends, run), ""), tail)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, same columns, with personal data replaced; null texts stay null."""
    into = fresh(docs, "__pii")
    return with_spans(docs, text, into).withColumn(text, redacted(F.col(text), F.col(into))).drop(into)


def find(docs: DataFrame) -> DataFrame:
    found = with_spans(docs.select("doc_id", "text")).withColumn("base", F.filter("pii_spans", lambda s: s["kind"].isin(*BASE)))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"), F.array_join(F.transform("pii_spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    kinds = ", ".join(f"('{k}', {i}, '{plain[k]}', '{RAISE[k]}', '{LOWER[k]}', {SCORES[k]})" for i, k in enumerate(KINDS))
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return f"""
WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(65535), chr(65534)) AS t FROM documents),
k(kind, o, pattern, up, down, base) AS (VALUES {kinds}),
p AS (SELECT doc_id, kind, o, up, down, base, string_split(regexp_replace(t, pattern, chr(65535) || '\\0' || chr(65535), 'g'), chr(65535)) AS parts FROM t, k),
u AS (SELECT * EXCLUDE parts, unnest(parts) AS m, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM p),
s AS (SELECT *, CAST(sum(length(m)) OVER w - length(m) AS BIGINT) AS a, lower(right(lag(m) OVER w, 40) || ' ' || left(lead(m) OVER w, 40)) AS near FROM u WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
c AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS code,
  round(least(1, greatest(0, base + CASE WHEN regexp_matches(near, up) THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(near, down) THEN 0.3 ELSE 0 END)), 2) AS score FROM s WHERE i % 2 = 0),
f AS (SELECT doc_id, kind, o, a, kind || ':' || a || ':' || (a + length(m)) AS span, score FROM c WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN regexp_full_match(m, '{part}(?:\\.{part}){{3}}')
  WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(digits[length(digits) - j + 1] AS INT) WHEN CAST(digits[length(digits) - j + 1] AS INT) > 4 THEN CAST(digits[length(digits) - j + 1] AS INT) * 2 - 9 ELSE CAST(digits[length(digits) - j + 1] AS INT) * 2 END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
  WHEN 'iban' THEN score >= {LEAST} AND list_reduce(list_transform(string_split(code[5:] || code[:4], ''), lambda x: CAST(CASE WHEN ascii(x) < 58 THEN ascii(x) - 48 ELSE ascii(x) - 55 END AS BIGINT)), lambda r, x: (r * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97, CAST(0 AS BIGINT)) = 1
  WHEN 'ssn' THEN score >= {LEAST} AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') END),
g AS (SELECT doc_id, {count}, coalesce(string_agg(span, ',' ORDER BY o, a) FILTER (o < {len(BASE)}), '') AS base_spans, coalesce(string_agg(span, ',' ORDER BY o, a), '') AS spans, coalesce(string_agg(printf('%.2f', score), ',' ORDER BY o, a), '') AS scores FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE = _oracle()
