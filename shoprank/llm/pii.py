"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

Only built-in SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoprank.llm.common import free_names

_LOCAL = r"[A-Za-z0-9._%+-]"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: length of an IBAN -> codes of the countries that have it
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_CODES = {n: codes.replace(" ", "|") for n, codes in IBAN_LENGTHS.items()}
#: codes without a known length take the longest run
_IBAN = "|".join([*[rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in _CODES.items()],
                  rf"(?!{'|'.join(_CODES.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"])
#: kind -> pattern, in the order of the output. Loops are possessive where giving back cannot help, and a
#: match begins where its first run begins (or where the last match ended), so that a long run without a
#: match is read once and no pattern recurses. An IBAN is looked up ahead (group 1) and only its first four
#: characters are consumed, so that one that fails its checksum hides none that begins within it.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": _PHONE,
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBAN})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: cheap tests that a text can hold the kind at all
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
BASE_KINDS = ("email", "ip", "card", "phone")
#: fixed values: prior score of a confirmed span and words nearby that raise it
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "mail|e-mail|contact|write|address", "ip": r"\bip\b|host|server|login|address", "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|fax|mobile|whatsapp|numéro|teléfono", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": r"\bssn\b|social|security|insurance",
}
BOOST, THRESHOLD, REACH = 0.3, 0.5, 40


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, k: acc + F.when(
        k % 2 == 0, F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), F.substring(digits, n - k + 1, 1).cast("int") + 1))
        .otherwise(F.substring(digits, n - k + 1, 1).cast("int")))
    return (n > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(
        c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Confirmed matches with their place: gaps and consumed texts alternate, so lengths add up to the places."""
    pattern, ahead = PATTERNS[kind], kind == "iban"
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if ahead else 0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start: int, text: string>>")

    def step(acc: Column, x: Column) -> Column:
        start, m = acc["at"] + F.length(x["g"]), x["m"]
        new = m.isNotNull() & _valid(kind, m)
        found = acc["found"]
        if ahead:
            over, known = start < acc["end"], m.rlike(f"^(?:{'|'.join(_CODES.values())})")
            new &= ~over | (known & ~acc["known"])
            found = F.when(new & over, F.slice(found, 1, F.size(found) - 1)).otherwise(found)
        return F.struct(
            (start + F.coalesce(F.least(F.length(m), F.lit(4)) if ahead else F.length(m), F.lit(0))).alias("at"),
            *([F.when(new, start + F.length(m)).otherwise(acc["end"]).alias("end"), F.when(new, known).otherwise(acc["known"]).alias("known")] if ahead else []),
            F.concat(found, F.when(new, F.array(F.struct(start.alias("start"), m.alias("text")))).otherwise(none)).alias("found"))

    placed = F.aggregate(
        F.arrays_zip(F.transform(matches, lambda m: m).alias("m"), F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(1))).alias("g")),
        F.struct(F.lit(0).alias("at"), *([F.lit(0).alias("end"), F.lit(True).alias("known")] if ahead else []), none.alias("found")), step)["found"]

    def scored(s: Column) -> Column:
        n = F.length(s["text"])
        near = F.lower(F.concat(F.substring(text, F.greatest(s["start"] - REACH + 1, F.lit(1)), F.least(s["start"], F.lit(REACH))), F.lit(" "),
                                F.substring(text, s["start"] + n + 1, F.lit(REACH))))
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(BOOST)).otherwise(F.lit(0.0)))
        return F.struct(F.lit(kind).alias("kind"), s["start"].cast("long").alias("start"), (s["start"] + n).cast("long").alias("end"), score.alias("score"))

    spans = F.transform(placed, scored)
    if kind not in BASE_KINDS:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]{2}" if kind == "iban" else "[0-9]")
    return F.when(need, spans).otherwise(F.array().cast("array<struct<kind: string, start: bigint, end: bigint, score: double>>"))


def find_spans(docs: DataFrame, name: str = "pii") -> DataFrame:
    """Adds the column `name`: array of (kind, start, end, score) over every whole text, places in code points, end exclusive.

    Kinds come in the order of PATTERNS, each from left to right. A match that fails its checksum or its
    bounds is dropped and not tried again shorter. An IBAN ends at its country's length; every place where one
    can begin is tried; of overlapping ones the first stays, but one of a code without a known length gives way. Kinds beyond the four base ones also need THRESHOLD, for
    which a word of CONTEXT within REACH characters counts BOOST. Null and empty texts have no spans. Rows
    are not shuffled and keep their columns; a column of that name is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(name, F.concat(*[_spans(k, text) for k in PATTERNS]))


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span of `find_spans` replaced by [KIND]; overlapping spans become one, named by the first.

    Columns and rows stay as they are; null texts stay null.
    """
    name, = free_names(docs, "__pii")
    found = find_spans(docs, name)
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    place = F.transform(F.array_sort(F.transform(F.col(name), lambda s: F.struct(s["start"], s["end"], s["kind"]))),
                        lambda s: F.struct(s["kind"], s["start"], s["end"]))
    merged = F.aggregate(place, none, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, F.when(F.size(acc) > 0, F.lit(-1)).otherwise(F.lit(1)))["end"] > s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["kind"].alias("kind"), F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    built = F.aggregate(merged, start, lambda acc, s: F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn("text", F.when(F.size(name) > 0, built).otherwise(text)).drop(name)
