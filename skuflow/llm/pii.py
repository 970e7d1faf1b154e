"""Personal data by DataFrame functions only: patterns propose spans, checksums confirm them, nearby words adjust scores.

Spark returns the matches of a pattern but not their places. So each match is put between two marks (a private-use
character; where a text holds it, it is first replaced by another one that no pattern matches), and the text is
split there: every second part is a match, and the lengths of the parts before it give its place in code points.

Base kinds: ``email``, ``ip`` (parts up to 255), ``card`` (13 to 19 digits that pass Luhn), ``phone`` (9 to 15 digits).
They always stay. The method adds ``iban`` (mod-97), ``secret`` (long hexadecimal strings) and ``ssn``, which count
from a score of ``ACCEPT``: a pattern's own score, raised where a context word stands within ``NEAR`` code points.

The patterns are written so that no text, however long, makes the matcher recurse or start again within a run: a
run of characters is taken whole (possessively), and starts only at its first character or after a match.

Defined cases: a null text is an empty one, without spans; repeated rows get the same result; a null id is passed
through. Only the id and text columns are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, INSTEAD = "\ue000", "\ue001"
NEAR, ACCEPT, CONTEXT_GAIN = 40, 0.5, 0.3
#: Parts whose lengths are added up at a time; keeps the work for a text with many matches from growing with their square.
BLOCK = 64


class Kind(NamedTuple):
    name: str
    pattern: str
    may_hold: str
    score: float
    context: str
    base: bool


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digit", 0.6, "ip|address|host|server", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "digit", 0.7, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax", True),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}+(?: ?[A-Z0-9][A-Z0-9]?[A-Z0-9]?)?", "digit", 0.7, "iban|account|bank", False),
    Kind("secret", r"[0-9a-f]{32,}+", "digit", 0.3, "token|secret|password|key|auth", False),
    Kind("ssn", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", "digit", 0.3, "ssn|social security", False),
)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where ``use`` runs for each element of an array."""
    return F.transform(F.array(value), use)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _places(parts: Column) -> Column:
    """start, end, match and the text around it for every second part."""

    def with_sums(parts: Column, lengths: Column, sums: Column) -> Column:
        def place(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = sums[block] + _total(F.slice(lengths, block * BLOCK + 1, i % BLOCK))
            before, after = F.right(parts[i - 1], F.lit(NEAR)), F.left(parts[i + 1], F.lit(NEAR))
            return F.struct(start.alias("start"), (start + lengths[i]).alias("end"), parts[i].alias("match"), before.alias("before"), after.alias("after"))

        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), place)

    def with_lengths(parts: Column, lengths: Column) -> Column:
        block_sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
        before = lambda sums: F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: _total(F.slice(sums, F.lit(1), b)))
        return _let(_let(block_sums, before), lambda sums: with_sums(parts, lengths, sums))

    return _let(parts, lambda p: _let(F.transform(p, lambda x: F.length(x)), lambda lengths: with_lengths(p, lengths)))


def proposals(text: Column, kind: Kind) -> Column:
    """All matches of the kind's pattern, as an array of places."""
    holds = text.rlike("[0-9]") if kind.may_hold == "digit" else text.contains(kind.may_hold)
    marked = F.regexp_replace(text, F.lit(kind.pattern), F.lit(f"{MARK}$0{MARK}"))
    found = F.when(holds, _let(F.split(marked, MARK), lambda parts: F.when(F.size(parts) > 1, _places(parts))))
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,match:string,before:string,after:string>>)")
    return F.coalesce(found, nothing)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for at in range(20):
        digit = F.ascii(F.substring(padded, at + 1, 1)) - 48
        total = total + (digit if at % 2 else F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit))
    return total % 10 == 0


def mod_97(match: Column) -> Column:
    """Whether an account number gives 1 modulo 97 with its first four characters at the end and letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _apart(place: Column, characters: str) -> Column:
    return ~place["before"].rlike(f"[{characters}]$") & ~place["after"].rlike(f"^[{characters}]")


def valid(kind: str, place: Column) -> Column:
    match = place["match"]
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _apart(place, "A-Za-z0-9") & mod_97(match)
    if kind == "secret":
        return _apart(place, "A-Za-z0-9") & (F.length(match) <= 64)
    if kind == "ssn":
        return _apart(place, "0-9-") & ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def score(kind: Kind, place: Column) -> Column:
    near = F.lower(F.concat_ws(" ", place["before"], place["after"])).rlike(kind.context)
    return F.lit(kind.score) + F.when(near, CONTEXT_GAIN if not kind.base else 0.2).otherwise(0.0)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and, for each kind, an array of its spans: start, end, score. One pass, no shuffle."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, INSTEAD)
    out = docs.select(id_col, text.alias("__text"))
    out = out.select(id_col, *[proposals(F.col("__text"), kind).alias(kind.name) for kind in KINDS])
    return out.select(id_col, *[_confirmed(kind).alias(kind.name) for kind in KINDS])


def _confirmed(kind: Kind) -> Column:
    checked = F.filter(kind.name, lambda p: valid(kind.name, p))
    scored = F.transform(checked, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.round(score(kind, p), 2).alias("score")))
    return scored if kind.base else F.filter(scored, lambda s: s["score"] >= ACCEPT)


def span_text(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans of these kinds, comma-joined."""

    def of_kind(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(of_kind, kinds)), ",")
