"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Only built-in functions, so it runs in the JVM and in generated code. A kind's matches and the gaps
between them come from extracting and splitting by the same pattern; a fold over both gives each
match's place. The patterns are those of the contract, written so that a long run of characters is
read once: a possessive repeat where nothing follows that could take a character back, and a start
only where a run starts or the last match ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns by kind. The base kinds first, in the order in which spans are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}
#: Words that make a kind likelier when they stand before a match, and how many characters back they count.
CONTEXT = {
    "email": "e-?mail|mail|contact|write|correo|kontakt|courriel",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|konto|cuenta|compte",
}
REACH = 40
#: Matches that are folded at once.
GROUP = 500
#: Scores: of a match without a checksum, of one with, and what a context word adds.
PLAIN, CHECKED, NEARBY = 0.5, 0.8, 0.2


def luhn(value: F.Column) -> F.Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.reverse(F.translate(value, " -", ""))
    size = F.length(digits)

    def add(total: F.Column, i: F.Column) -> F.Column:
        digit = digits.substr(i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(False)


def mod97(value: F.Column) -> F.Column:
    """15 to 34 characters whose ISO 7064 remainder is one."""
    plain = F.translate(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    size = F.length(plain)

    def step(rest: F.Column, i: F.Column) -> F.Column:
        digit = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), turned.substr(i, F.lit(1))) - 1
        return (rest * F.when(digit > 9, 100).otherwise(10) + digit) % 97

    return F.when(size.between(15, 34), F.aggregate(F.sequence(F.lit(1), size), F.lit(0), step) == 1).otherwise(False)


def valid(kind: str, value: F.Column) -> F.Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.concat(F.lit("0"), F.substring(F.regexp_replace(part, "^0+", ""), 1, 4)).cast("int") <= 255)
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def spans(kind: str, text: F.Column) -> F.Column:
    """The kind's spans in a text: an array of (start, end, value), in code points, end exclusive.

    Pieces are folded in groups, and the groups in turn, so that what was found isn't copied for each match.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pieces = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hit"))

    def step(state: F.Column, piece: F.Column) -> F.Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("value"))
        kept = F.when(piece["hit"].isNotNull() & valid(kind, piece["hit"]), F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    def whole(pieces: F.Column) -> F.Column:
        def group(state: F.Column, n: F.Column) -> F.Column:
            part = F.aggregate(F.slice(pieces, n * GROUP + 1, F.lit(GROUP)), F.struct(state["at"].alias("at"), empty.alias("found")), step)
            # the part's struct is bound once, as the only element of an array
            return F.element_at(F.transform(F.array(part), lambda x: F.struct(x["at"].alias("at"), F.concat(state["found"], F.array(x["found"])).alias("found"))), 1)

        groups = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / GROUP).cast("int"))
        return F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array(empty).alias("found")), group, lambda state: F.flatten(state["found"]))

    found = F.element_at(F.transform(F.array(pieces), whole), 1)
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(empty)


def scored(kind: str, text: F.Column, found: F.Column) -> F.Column:
    """The spans with kind and score: a checksum counts, and so does a context word before the match."""
    base = CHECKED if kind in ("card", "iban") else PLAIN

    def rate(span: F.Column) -> F.Column:
        before = F.lower(text.substr(F.greatest(span["start"] - REACH, F.lit(0)) + 1, F.least(span["start"], F.lit(REACH))))
        near = before.rlike(rf"(?:^|[^a-z])(?:{CONTEXT[kind]})(?:$|[^a-z])")
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), F.when(near, base + NEARBY).otherwise(base).alias("score"))

    return F.transform(found, rate)


def detect(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id and spans, an array of (kind, start, end, value, score).

    Spans are listed by kind, then by start. A null or empty text has none. Null ids and repeated rows
    are kept; other columns, whatever their names, are not read.
    """
    text = F.col("text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.select("doc_id", "text", *(spans(k, text).alias(k) for k in PATTERNS))
    return out.select("doc_id", F.concat(*(scored(k, text, F.col(k)) for k in PATTERNS)).alias("spans"))


def listed(found: F.Column) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text), n_added, best_score of detect()."""
    found = detect(docs)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    added = F.filter("spans", lambda s: ~s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in BASE),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("best_score"),
    )
