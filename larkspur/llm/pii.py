"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their scores.

All of it is Spark SQL: a text is split at a kind's pattern, so that the lengths of the parts give every match's
position in code points, and the parts beside a match are its context. The patterns are possessive where the grammar
allows it and start only where a run of their characters starts (or the previous match ended), so that matching
takes time in proportion to the text and no recursion.

Kinds and scores: ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19 digits, Luhn) and ``phone`` (9 to 15
digits) are base kinds, whose confirmed spans always stay. The method adds ``iban`` (mod-97, and the country's length or
else the longest start that the checksum confirms, so that words in capitals and numbers behind it do no harm) and ``ssn`` (three,
two and four digits, which only a word of context beside it confirms). A span's score is its kind's prior, more by
``CONTEXT_GAIN`` if a word of its kind stands within ``CONTEXT`` code points (and before the next match of its kind),
less by ``CONTEXT_LOSS`` if a word against it does; added kinds stay at ``THRESHOLD`` or more. Positions are added up block by block, and what several
parts of an expression need is bound to a lambda's variable, so that it is computed once: a text with very many matches
takes time in proportion to it as well.

Defined results: a null text counts as empty and has no spans; matches that fail their check are dropped and not
tried again from within; spans of different kinds may overlap; texts are read whole; repeated rows give repeated
results; columns other than the text pass through ``redact`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fresh

CONTEXT, CONTEXT_GAIN, CONTEXT_LOSS, THRESHOLD = 32, 0.25, 0.25, 0.5
#: Matches that are added up at a time, and code points that are cut out of a text at a time.
BLOCK, CHUNK = 256, 1024


#: Characters of an account number by country.
_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
_OF_LENGTH: dict[int, list[str]] = {}
for _x in _LENGTHS.split():
    _OF_LENGTH.setdefault(int(_x[2:]), []).append(_x[:2])
#: A number of its country's length; the others have any length from 15 to 34.
_IBAN = "(?:" + "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _OF_LENGTH.items()) + ")(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Only texts in which this (cheaper) pattern is found are split; every match contains such a place.
    hint: str
    prior: float
    words: str
    against: str = ""
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]", 0.9, "e-?mail|mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server|from", "version|release|section"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}", 0.8, "card|visa|credit|debit|payment", "isbn|order|serial"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|mobile|fax|contact"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", 0.8, "iban|bank|account|transfer", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, "ssn|social security|taxpayer", "phone|order", base=False),
)


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(rows: Column, kind: str, after, made) -> Column:
    """For each row x in turn ``made(at, x)``, of type ``kind``; ``at`` is 0 and then ``after(at, x)``."""

    def step(a: Column, x: Column) -> Column:
        return F.struct(after(a["at"], x).alias("at"), F.concat(a["out"], F.array(made(a["at"], x))).alias("out"))

    def block(a: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(a["at"].alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out")), step)
        return _bound(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(a["out"], F.array(i["out"])).alias("out")))

    last = F.floor((F.size(rows) - 1) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    return F.flatten(F.aggregate(blocks, start, block)["out"])


_PLACED = "struct<start:bigint,stop:bigint,value:string,near:string>"


def _located(text: Column, kind: Kind) -> Column:
    """array<struct<start, stop, value, near>> of the pattern's matches, leftmost first, none overlapping."""

    def row(x: Column) -> Column:
        near = F.lower(F.concat(F.substring(x["gap"], -CONTEXT, CONTEXT), F.lit(" "), F.substring(x["next"], 1, CONTEXT)))
        return F.struct(F.length(x["gap"]).alias("gap"), F.length(x["value"]).alias("size"), x["value"].alias("value"), near.alias("near"))

    def rows(s: Column) -> Column:
        n = F.size(s["found"])
        return F.transform(F.arrays_zip(F.slice(s["parts"], F.lit(1), n).alias("gap"), s["found"].alias("value"), F.slice(s["parts"], F.lit(2), n).alias("next")), row)

    def place(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop"), x["value"].alias("value"), x["near"].alias("near"))

    both = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"), F.split(text, kind.pattern, -1).alias("parts"))
    return _bound(_bound(both, rows), lambda r: _running(r, _PLACED, lambda at, x: at + x["gap"] + x["size"], place))


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def part(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _mod97(value: Column) -> Column:
    """The remainder of an account number whose first four characters stand last, letters read as 10 to 35."""
    plain = F.translate(value, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)


def _trimmed(x: Column) -> Column:
    """The match of an account number without the words behind it: all of it if it has its country's length, else its
    longest start, up to a blank or the end, that the checksum confirms. What is cut off becomes context."""
    parts = F.split(x["value"], " ")
    starts = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " "))
    fine = F.filter(starts, lambda v: (F.length(F.translate(v, " ", "")) >= 15) & (_mod97(v) == 1))
    value = F.when(x["value"].rlike(f"^{_IBAN}"), x["value"]).otherwise(F.coalesce(F.get(fine, F.lit(0)), x["value"]))
    rest = F.substring(x["value"], F.length(value) + 1, F.length(x["value"]))
    return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).alias("stop"), value.alias("value"), F.concat(x["near"], F.lit(" "), F.lower(rest)).alias("near"))


def _confirmed(kind: Kind, value: Column) -> Column:
    if kind.name == "ip":
        small = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(small, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise(F.lit("999")).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind.name == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind.name == "phone":
        return F.length(digits).between(9, 15)
    if kind.name == "iban":
        return _mod97(value) == 1
    return F.lit(True)


def spans(text: Column) -> Column:
    """array<struct<kind, start, stop, value, score, base>> by kind as listed, then by start (code points)."""
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,stop:bigint,value:string,score:double,base:boolean>>)")

    def of(kind: Kind) -> Column:
        def scored(x: Column) -> Column:
            score = F.lit(kind.prior) + F.when(x["near"].rlike(rf"\b(?:{kind.words})\b"), CONTEXT_GAIN).otherwise(0.0)
            if kind.against:
                score = score - F.when(x["near"].rlike(rf"\b(?:{kind.against})\b"), CONTEXT_LOSS).otherwise(0.0)
            score = F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2)
            return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), score.alias("score"), F.lit(kind.base).alias("base"))

        located = _located(text, kind)
        if kind.name == "iban":
            located = F.transform(located, _trimmed)
        kept = F.transform(F.filter(located, lambda x: _confirmed(kind, x["value"])), scored)
        if not kind.base:
            kept = F.filter(kept, lambda x: x["score"] >= THRESHOLD)
        return F.when(text.rlike(kind.hint), kept).otherwise(none)

    return F.concat(*(of(kind) for kind in KINDS))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` of every document."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_pii_text")).select(key, spans(F.col("_pii_text")).alias("spans"))


def listing(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; of overlapping spans, the first to start
    (then the longest, then by kind) is replaced and what it covers goes with it. Null texts stay null."""
    name = fresh(docs, "spans")
    held = docs.withColumn(name, F.when(F.col(text).isNotNull(), spans(F.col(text))))
    ordered = F.array_sort(F.transform(F.col(name), lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["kind"].alias("kind"))))

    def between(chunks: Column, start: Column, stop: Column | None) -> Column:
        """The text from ``start`` to ``stop`` (or its end), out of chunks of ``CHUNK`` code points."""
        first, skipped = F.floor(start / CHUNK).cast("int"), (start % CHUNK).cast("int")
        if stop is None:
            rest = F.array_join(F.slice(chunks, first + 2, F.greatest(F.size(chunks) - first, F.lit(0))), "")
            return F.concat(F.coalesce(F.substring(F.get(chunks, first), skipped + 1, F.lit(CHUNK)), F.lit("")), rest)
        last, taken = F.floor(stop / CHUNK).cast("int"), (stop % CHUNK).cast("int")
        head = F.coalesce(F.substring(F.get(chunks, first), skipped + 1, F.when(last == first, taken - skipped).otherwise(CHUNK)), F.lit(""))
        middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        end = F.when(last > first, F.coalesce(F.substring(F.get(chunks, last), F.lit(1), taken), F.lit(""))).otherwise(F.lit(""))
        return F.concat(head, middle, end)

    def cleaned(s: Column) -> Column:
        def part(at: Column, x: Column) -> Column:
            new = F.concat(between(s["chunks"], at, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
            return F.when(x["start"] >= at, new).otherwise(F.lit(""))

        made = F.array_join(_running(s["ordered"], "string", lambda at, x: F.greatest(at, -x["back"]), part), "")
        return F.concat(made, between(s["chunks"], -F.array_min(F.transform(s["ordered"], lambda x: x["back"])), None))

    chunks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    clean = _bound(F.struct(chunks.alias("chunks"), ordered.alias("ordered")), cleaned)
    return held.withColumn(text, F.when(F.size(name) > 0, clean).otherwise(F.col(text))).drop(name)
