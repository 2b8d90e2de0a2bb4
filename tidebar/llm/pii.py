"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Everything is a Column expression. A text is split once per kind at the proposals, so
the work is linear in its length; all patterns use possessive repeats behind a start
guard, which match what the plain ones match without trying a run from each of its
characters.

Edge cases: a null text counts as empty and has no spans; repeated rows each give a row;
an empty table gives an empty result; columns other than the id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.llm.common import let, prefix_sums

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

_LOCAL = r"[A-Za-z0-9._%+-]"
# fixed values: countries by the length of their account codes
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(size: int) -> str:
    """A code of one length after its first four characters, in groups of four or without blanks."""
    fours, rest = divmod(size - 4, 4)
    return rf"(?:\x20?[A-Z0-9]{{4}}){{{fours}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


# a code of its country's length first, so that it doesn't take in the word behind it; else any length
_IBANS = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}{_iban(n)}(?![A-Za-z0-9])" for n, names in IBAN_LENGTHS.items())
# \G: a match may also begin where the last one ended, inside a run of the class
PATTERNS = {
    "email": rf"(?={_LOCAL})(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))",
}
# a text without this cannot hold the kind
NEEDS = {"email": "@", "phone": "+"}
# fixed values: score before context, and words that raise it when they stand close to a span
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|login)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|payment|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2
_MARK = "\x01"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, d: Column) -> Column:
        v = F.when(acc["odd"], d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
        return F.struct((acc["sum"] + v).alias("sum"), (~acc["odd"]).alias("odd"))

    ints = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    return F.aggregate(ints, F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), add, lambda a: a["sum"] % 10 == 0)


def mod97(code: Column) -> Column:
    """Whether an account code without blanks passes the mod-97 check."""
    chars = F.split(F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4)), "")
    value = lambda c: F.when(F.ascii(c) < 65, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))))
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return let(F.regexp_replace(found, " ", ""), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(False))


def _pieces(text: Column, kind: str) -> Column:
    """The text cut at its proposals: pieces at even places stand between them, pieces at odd places are them."""
    whole = F.array(text)
    cut = F.split(F.regexp_replace(F.translate(text, _MARK, "\x02"), PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK, -1)
    return F.when(F.contains(text, F.lit(NEEDS[kind])), cut).otherwise(whole) if kind in NEEDS else cut


def kind_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind in order; code points, end exclusive."""
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")

    def last(s: Column) -> Column:
        return F.substr(s, F.greatest(F.length(s) - CONTEXT_CHARS + 1, F.lit(1)))

    def first(s: Column) -> Column:
        return F.substr(s, F.lit(1), F.lit(CONTEXT_CHARS))

    def spans(pieces: Column, at: Column, ends: Column, begins: Column) -> Column:
        def one(i: Column) -> Column:
            # pieces enough to hold the context: of two neighbours one at least isn't empty
            low = F.greatest(i - 2 * CONTEXT_CHARS, F.lit(0))
            before = last(F.array_join(F.slice(ends, low + 1, i - low), ""))
            after = first(F.array_join(F.slice(begins, i + 2, F.lit(2 * CONTEXT_CHARS)), ""))
            score = F.lit(PRIOR[kind]) + F.when(F.rlike(before, F.lit(CONTEXT[kind])) | F.rlike(after, F.lit(CONTEXT[kind])), CONTEXT_BONUS).otherwise(0.0)
            start = F.get(at, i)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(F.get(pieces, i))).alias("end"), score.alias("score"))

        odd = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
        return F.transform(F.filter(odd, lambda i: _valid(kind, F.get(pieces, i))), one)

    return let(_pieces(text, kind), lambda p: F.when(F.size(p) < 3, empty).otherwise(let(prefix_sums(F.transform(p, F.length)), lambda at: let(F.transform(p, last), lambda ends: let(F.transform(p, first), lambda begins: spans(p, at, ends, begins))))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and an array of spans per kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), *[kind_spans(text, k).alias(k) for k in KINDS])


@dataclass(frozen=True)
class Digest:
    """Columns the query shows in place of span arrays."""

    kinds: tuple[str, ...] = KINDS
    base: tuple[str, ...] = BASE

    def joined(self, kinds: tuple[str, ...]) -> Column:
        one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        return F.array_join(F.flatten(F.array(*[F.transform(k, one) for k in kinds])), ",")

    def apply(self, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
        return found.select(
            id_col,
            *[F.size(k).cast("long").alias(f"n_{k}") for k in self.kinds],
            F.sha2(self.joined(self.base), 256).alias("base_sha256"),
            self.joined(self.kinds).alias("spans"),
            F.array_join(F.transform(F.flatten(F.array(*self.kinds)), lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
        )


def redact(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; kinds in turn, so overlaps go to the first."""

    def drop(t: Column, kind: str) -> Column:
        tag = F.lit(f"[{kind.upper()}]")
        shown = lambda p, i: F.when((i % 2 == 1) & _valid(kind, p), tag).otherwise(p)
        return let(_pieces(t, kind), lambda p: F.when(F.size(p) < 3, t).otherwise(F.array_join(F.transform(p, shown), "")))

    def step(kind: str):
        return lambda t: drop(t, kind)

    for kind in ("email", "iban", "card", "ip", "phone"):
        text = let(text, step(kind))
    return text
