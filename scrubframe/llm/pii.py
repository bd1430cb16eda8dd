"""Personal data: patterns propose spans, checksums confirm them, words around them adjust a score. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The proposing patterns. Each repeated part is possessive, and a run of its characters is tried from its
#: first character only (or from the end of the match before), which finds the same spans in linear time on any text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}([\x20-])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
DNI = r"(?<![0-9A-Za-z])[0-9]{8}-?[A-HJ-NP-TV-Z](?![0-9A-Za-z])"
PASSPORT = r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6,8}(?![0-9A-Za-z])"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Fixed value: the check letter of a Spanish identity number, by its remainder of 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Context words count within this many characters, but never beyond the next match of the same kind.
CONTEXT = 40
#: What a context word adds to a score when it stands before the match, and when it only stands behind it.
BEFORE, AFTER = 0.2, 0.1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: float
    context: str
    least: float = 0.0


#: Kinds in the order in which spans at the same start are listed. ``least`` drops spans whose score stays below it: national
#: numbers look like many other numbers, so a word near them has to speak for them. Base kinds and IBANs stay in any context.
KINDS = (
    Kind("email", EMAIL, 0.9, r"e-?mail|contact|write|correo|courriel"),
    Kind("ip", IP, 0.6, r"\bip\b|address|host|server|adresse"),
    Kind("card", CARD, 0.7, r"card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", PHONE, 0.6, r"phone|call|mobile|\btel|\bfax|telefon|fono"),
    Kind("iban", IBAN, 0.8, r"iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", SSN, 0.45, r"\bssn\b|social security", 0.5),
    Kind("dni", DNI, 0.45, r"\bdni\b|\bnif\b|identidad|identity|national id", 0.5),
    Kind("passport", PASSPORT, 0.45, r"passport|passeport|pasaporte|reisepass", 0.5),
)
BASE_KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<start:bigint,kind_no:int,kind:string,end:bigint,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether letters and digits pass the check of ISO 7064 (remainder 1 with the first four moved to the end)."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" ")))
    if kind == "dni":
        return F.substring(F.lit(DNI_LETTERS), digits.cast("int") % 23 + 1, F.lit(1)) == F.right(match, F.lit(1))
    return F.lit(True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value that an expression uses many times, so that it is computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(kind: Kind, no: int, text: Column) -> Column:
    """Confirmed spans of one kind. Splitting by the pattern gives the gaps between its matches, hence their positions and
    the words next to them; only rows with a match are split."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def place(found: Column, gaps: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            match, before, after = found[i], gaps[i], gaps[i + 1]
            start = state["at"] + F.length(before)
            end = start + F.length(match)
            word = f"(?i){kind.context}"
            more = F.when(F.right(before, F.lit(CONTEXT)).rlike(word), BEFORE).when(F.left(after, F.lit(CONTEXT)).rlike(word), AFTER).otherwise(0.0)
            score = F.least(F.lit(1.0), F.lit(kind.base) + more)
            span = F.struct(start.cast("bigint").alias("start"), F.lit(no).alias("kind_no"), F.lit(kind.name).alias("kind"),
                            end.cast("bigint").alias("end"), score.alias("score"))
            good = confirmed(kind.name, match) & (score >= kind.least)
            return F.struct(end.cast("bigint").alias("at"),
                            F.when(good, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda s: s["out"])

    return once(matches, lambda found: F.when(F.size(found) > 0, once(F.split(text, kind.pattern, -1), lambda gaps: place(found, gaps)))
                .otherwise(F.array().cast(f"array<{SPAN}>")))


def personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``spans``: array of (start, kind_no, kind, end, score) by start, then kind; code points, end exclusive.

    Per kind, matches are leftmost and do not overlap; a match that fails its checksum is dropped without a retry, and one
    whose score stays below the least of its kind is dropped too. The score is the kind's own plus what a context word before
    or behind the match adds. Null and empty texts have no spans, an empty table gives an empty table, long texts are read whole; doc_id is not used, so null and repeated ids are fine and equal rows get equal spans.
    A column called ``spans`` is replaced. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [spans_of(kind, no, text) for no, kind in enumerate(kinds)]
    return docs.withColumn("spans", F.array_sort(F.concat(*found)))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first wins."""
    def step(state: Column, span: Column) -> Column:
        ahead = span["start"] >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(F.when(ahead, span["end"]).otherwise(state["at"]).alias("at"),
                        F.when(ahead, F.concat(state["out"], gap, F.lit("["), span["kind"], F.lit("]"))).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, first, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The scores of the spans in their order, with two places, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")
