"""Personal data: spans proposed by patterns, confirmed by checksums, scored by their context.

Everything is a column expression.  A pattern is run twice over a text: once
for its matches and once to split the text there, so the lengths of matches and
gaps give every span's place in code points.  Patterns start only where a match
can start, and their loops are possessive, so a text is read once per pattern
however long a run of letters or digits is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.vectors import let
from strata.llm.common import text_of

# Kinds in the order of the result; the contract's first, then what this operator adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

# A match starts at the start of a run of its characters or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = r"\.[0-9]++"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?:\G|(?<![0-9]))[0-9]++{_PART}{_PART}{_PART}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Signs of an account number by its country.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
ACCOUNT_CODES = " ".join(ACCOUNT_LENGTHS.values()).split()
_SIGN = r"(?:\x20?[A-Z0-9])"
_BY_COUNTRY = "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}{_SIGN}{{{length - 4}}}" for length, codes in ACCOUNT_LENGTHS.items()
)
# The signs at every place where an account number can start, as group 1 of an empty match.  A code that no country
# of the list has must start a word; its signs are taken one further than the longest number.
ACCOUNT = (
    rf"(?=[A-Z]{{2}}[0-9]{{2}}{_SIGN}{{11}})"
    rf"(?=({_BY_COUNTRY}|(?<![A-Za-z0-9])(?!{'|'.join(ACCOUNT_CODES)})[A-Z]{{2}}[0-9]{{2}}{_SIGN}{{11,31}}))"
)
# A character sequence without which a text holds no match: texts without it are not searched.
NEEDED = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
}
# Words whose presence near a span makes its kind likelier or less likely.
CONTEXT_CHARS = 40
PIECE = 64
SUPPORTING = {
    "email": r"mail|contact|write|reply",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|credit|payment|kredit|tarjeta|carte",
    "phone": r"phone|call|tel|mobile|fax|anruf|llam",
    "iban": r"iban|bank|account|konto|cuenta|compte",
}
DOUBTING = r"version|example|order|isbn|serial|test"
CONFIRMED = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9}
STEP = 0.1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass Luhn's check."""
    digits = F.split(F.reverse(_digits(match)), "")
    values = F.transform(
        F.filter(digits, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")
        ),
    )
    return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether ``match``, its first four characters moved to the end, leaves 1 modulo 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    signs = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(rest: Column, sign: Column) -> Column:
        letter = sign.between("A", "Z")
        value = F.when(letter, F.ascii(sign) - 55).otherwise(sign.cast("int"))
        return (rest * F.when(letter, F.lit(100)).otherwise(10) + value) % 97

    return F.aggregate(signs, F.lit(0), step) == 1


def _ip_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, r"\."), small)


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _ip_parts(match)
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def proposals(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value) for all matches of the kind's pattern, left to right."""
    if kind == "iban":
        return _accounts(text)
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(
        F.transform(F.slice(gaps, F.lit(1), F.size(matches)), F.length),
        matches,
        lambda gap, match: F.struct(gap.alias("gap"), F.length(match).alias("length"), match.alias("value")),
    )

    def place(part: Column, end: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), (end - part["length"]).alias("start"), end.alias("end"), part["value"].alias("value")
        )

    def placed(parts: Column) -> Column:
        return F.zip_with(parts, _running(F.transform(parts, lambda p: p["gap"] + p["length"])), place)

    spans = let(lengths, placed)
    return F.when(text.rlike(NEEDED[kind]), F.filter(spans, lambda s: confirmed(kind, s["value"]))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")


def _parts_of(values: Column) -> Column:
    """An array cut into about as many parts as a part has values."""

    def cut(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        count = F.ceil(F.size(v) / width).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(v, i * width + 1, width))

    return let(values, cut)


def _sums(values: Column) -> Column:
    """Running sums by one fold, which copies what it has for every value."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("done"))

    def step(state: Column, value: Column) -> Column:
        at = state["at"] + value
        return F.struct(at.alias("at"), F.concat(state["done"], F.array(at)).alias("done"))

    return F.aggregate(values, start, step, lambda state: state["done"])


def _running(values: Column) -> Column:
    """Running sums of an array of any length: inside parts, and over the parts' totals."""

    def joined(parts: Column) -> Column:
        upto = _sums(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v)))
        before = F.concat(F.array(F.lit(0)), upto)
        return F.flatten(F.transform(parts, lambda p, i: let(F.get(before, i), lambda o: F.transform(_sums(p), lambda x: x + o))))

    return let(_parts_of(values), joined)


def _accounts(text: Column) -> Column:
    """Array of (kind, start, end, value) for the account numbers that pass, left to right.

    Every place is tried.  The country gives the length; without one it is the
    longest that passes of those that end with a word.
    """
    shifted = F.concat(F.lit(" "), text)  # an empty match at the very start would not split
    signs = F.regexp_extract_all(shifted, F.lit(ACCOUNT), F.lit(1))
    gaps = F.slice(F.split(shifted, ACCOUNT, -1), F.lit(1), F.size(signs))

    def value(signs: Column) -> Column:
        ends = [F.regexp_extract(signs, rf"^.{{4}}{_SIGN}{{{n - 4}}}(?![A-Z0-9])", 0) for n in range(34, 14, -1)]
        tried = F.when(F.substring(signs, 1, 2).isin(ACCOUNT_CODES), F.array(signs)).otherwise(F.array(*ends))
        return F.get(F.filter(tried, lambda v: (v != "") & mod97(v)), F.lit(0))

    def place(v: Column, begin: Column) -> Column:
        return F.struct(F.lit("iban").alias("kind"), begin.alias("start"), (begin + F.length(v)).alias("end"), v.alias("value"))

    begins = F.transform(_running(F.transform(gaps, F.length)), lambda end: end - 1)
    passed = F.filter(F.zip_with(F.transform(signs, value), begins, place), lambda s: s["value"].isNotNull())
    return F.when(text.rlike(NEEDED["iban"]), _apart(passed)).otherwise(_none())


def _apart(spans: Column) -> Column:
    """Spans, left to right, without those that begin inside one that stays."""

    def step(state: Column, span: Column) -> Column:
        new = span["start"] >= state["free"]
        return F.struct(
            F.when(new, span["end"]).otherwise(state["free"]).alias("free"),
            F.when(new, F.concat(state["kept"], F.array(span))).otherwise(state["kept"]).alias("kept"),
        )

    def through(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["free"].alias("free"), _none().alias("kept")), step)
        return let(inner, lambda i: F.struct(i["free"].alias("free"), F.concat(state["parts"], F.array(i["kept"])).alias("parts")))

    kind = "array<array<struct<kind:string,start:int,end:int,value:string>>>"
    start = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("parts"))
    return F.aggregate(_parts_of(spans), start, through, lambda state: F.flatten(state["parts"]))


def _scored(text: Column, spans: Column) -> Column:
    """Spans with their score.  Contexts are read from pieces of ``PIECE`` characters, wherever in the text they are."""

    def stretch(pieces: Column, begin: Column, length: Column) -> Column:
        """Characters of the text; at most ``PIECE`` of them, so two pieces hold them."""
        first = F.floor(begin / PIECE).cast("int")
        two = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
        return F.substring(two, begin - first * PIECE + 1, length)

    def score(span: Column, pieces: Column) -> Column:
        begin = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
        before = stretch(pieces, begin, span["start"] - begin)
        near = F.lower(F.concat(before, F.lit("\n"), stretch(pieces, span["end"], F.lit(CONTEXT_CHARS))))

        def total(near: Column) -> Column:
            value, supports = F.lit(None).cast("double"), F.lit(False)
            for kind in KINDS:
                mine = span["kind"] == kind
                value = F.when(mine, F.lit(CONFIRMED[kind])).otherwise(value)
                supports = F.when(mine, near.rlike(SUPPORTING[kind])).otherwise(supports)
            return value + F.when(supports, STEP).otherwise(0.0) - F.when(near.rlike(DOUBTING), STEP).otherwise(0.0)

        return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                        span["value"].alias("value"), F.round(let(near, total), 2).alias("score"))

    cut = F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return let(cut, lambda pieces: F.transform(spans, lambda s: score(s, pieces)))


def find_spans(docs: DataFrame) -> DataFrame:
    """Add ``pii``, an array of (kind, start, end, value, score), to ``docs`` (doc_id, text).

    Offsets are code points, the end is exclusive.  Matches of one kind do not
    overlap; those that fail their check are left out and not tried again inside,
    but account numbers are tried at every place.
    A null or empty text gives an empty array.  A column named pii is replaced.
    """
    docs = docs.drop("pii")
    text = text_of()
    found = docs.withColumn("__spans", F.concat(*[proposals(text, kind) for kind in KINDS]))
    return found.select(*docs.columns, _scored(text, F.col("__spans")).alias("pii"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Replace every span with a score of ``least`` or more by its kind in angle brackets.

    Spans that overlap an earlier one (by start, then the longer) are part of it.
    """
    spans = F.filter(F.array_sort(F.col("pii"), _by_place), lambda s: s["score"] >= least)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def cut(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        done = F.concat(state["done"], gap, F.lit("<"), span["kind"], F.lit(">"))
        inside = span["start"] < state["at"]
        return F.struct(
            F.when(inside, state["done"]).otherwise(done).alias("done"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    whole = F.aggregate(
        spans, start, cut, lambda state: F.concat(state["done"], F.substring(F.col("text"), state["at"] + 1, F.lit(2**31 - 1)))
    )
    return find_spans(docs).withColumn("text", F.when(F.size(spans) == 0, F.col("text")).otherwise(whole))


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])


# The contract's patterns as another engine writes them: without starts and possessive loops.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "[A-Z]{2}[0-9]{2}",  # places at which an account number can start; they do not overlap
}


def report_sql(table: str = "documents") -> str:
    """The rows of the query in DuckDB SQL."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    doubled = "list_transform(list_reverse(string_split({0}, '')), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT ELSE (2 * d::INT) % 10 + (2 * d::INT) // 10 END)"
    signs = "string_split(substr(replace({0}, ' ', ''), 5) || substr(replace({0}, ' ', ''), 1, 4), '')"
    values = f"list_transform({signs}, lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ord(c) - 55 ELSE try_cast(c AS INT) END::BIGINT)"
    rest = f"list_reduce(list_prepend(0::BIGINT, {values}), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum({doubled.format(digits)}) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    near = "lower(substr(text, greatest(s - {n}, 0) + 1, s - greatest(s - {n}, 0)) || chr(10) || substr(text, s + length(v) + 1, {n}))".format(n=CONTEXT_CHARS)
    steps = {
        kind: f"round({CONFIRMED[kind]}::DOUBLE + CASE WHEN regexp_matches({near}, '{SUPPORTING[kind]}') THEN {STEP} ELSE 0 END "
        f"- CASE WHEN regexp_matches({near}, '{DOUBTING}') THEN {STEP} ELSE 0 END, 2)"
        for kind in KINDS
    }
    parts = []
    for kind, pattern in _PLAIN.items():
        parts.append(f"""
{kind}_cut AS (SELECT row, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM told),
{kind}_each AS (SELECT row, text, m, unnest(range(1, len(m) + 1)) AS i, g FROM {kind}_cut),
{kind}_at AS (SELECT row, text, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM {kind}_each)""")
    sign = "(?: ?[A-Z0-9])"
    by_code = " ".join(
        f"WHEN v[1:2] IN ('{codes.replace(' ', chr(39) + ', ' + chr(39))}') THEN regexp_extract(tail, '^[A-Z0-9]{{4}}{sign}{{{length - 4}}}')"
        for length, codes in ACCOUNT_LENGTHS.items()
    )
    # A code of no listed country must start a word; the longest of its numbers that ends a word and passes is taken.
    tries = ", ".join(f"regexp_extract(signs, '^.{{4}}{sign}{{{n - 4}}}')" for n in range(34, 14, -1))
    passing = f"x <> '' AND NOT regexp_matches(substr(signs, length(x) + 1, 1), '[A-Z0-9]') AND {rest.format('x')}"
    parts.append(f"""
iban_tail AS (SELECT row, text, s, v, substr(text, s + 1, 70) AS tail, s > 0 AND regexp_matches(substr(text, s, 1), '[A-Za-z0-9]') AS inside FROM iban_at),
iban_signs AS (SELECT *, regexp_extract(tail, '^[A-Z0-9]{{4}}{sign}{{11,31}}') AS signs FROM iban_tail),
iban_tried AS (SELECT row, text, s, CASE {by_code} WHEN inside THEN '' ELSE coalesce(list_filter([{tries}], lambda x: {passing})[1], '') END AS v FROM iban_signs),
iban_passed AS (SELECT * FROM iban_tried WHERE CASE WHEN v = '' THEN false ELSE {rest.format('v')} END),
iban_found AS (SELECT * FROM (SELECT *, max(s + length(v)) OVER (PARTITION BY row ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
  FROM iban_passed) WHERE s >= coalesce(upto, 0))""")
    for kind in KINDS:
        source = "iban_found" if kind == "iban" else f"(SELECT * FROM {kind}_at WHERE {checks[kind]})"
        parts.append(f"""
{kind}_spans AS (SELECT row, count(*) AS n, string_agg('{kind}:' || s || ':' || (s + length(v)), ',' ORDER BY s) AS spans,
  string_agg(printf('%.2f', {steps[kind]}), ',' ORDER BY s) AS scores FROM {source} GROUP BY row)""")
    joins = " ".join(f"LEFT JOIN {k}_spans {k} ON {k}.row = told.row" for k in KINDS)
    base = ", ".join(f"{k}.spans" for k in BASE_KINDS)
    counts = ", ".join(f"coalesce({k}.n, 0) AS n_{k}" for k in KINDS)
    scores = ", ".join(f"{k}.scores" for k in KINDS)
    return f"""WITH told AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM {table}),{','.join(parts)}
SELECT doc_id, {counts}, sha256(concat_ws(',', {base})) AS base_sha256, concat_ws(',', {base}, iban.spans) AS spans,
  concat_ws(',', {scores}) AS scores FROM told {joins}"""


def report(docs: DataFrame) -> DataFrame:
    """Counts and places of the spans of every row of ``docs``, one row per row.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (see
    the query), n_iban and scores (in the order of spans, two decimals, joined by
    commas).  A null text is empty; empty texts have empty strings; rows that
    repeat are treated alike, other columns are not read, an empty table gives no
    rows.  Time grows in proportion to a text's length and n^1.5 of its n spans.
    """
    found = find_spans(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
