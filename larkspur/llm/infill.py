"""Fill-in-the-middle documents, cut between units of a text, by relational steps.

Matches of the unit's pattern become rows (posexplode); window sums of their lengths give the offset at which each begins;
cut requests, which name a number of units, join the rows by that number; a document's offsets come together in one
aggregate; and substrings of the text make the document. Only numbers pass through the window and the joins of units: a text
moves once, to meet its offsets (not at all where these are few enough to be broadcast).

Units are code points, or the matches of a pattern, each stretch outside of matches a unit a code point. A row holds up to
``RUN`` code points where these are the units, as each is as long as any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import fresh, stored

#: Code points in a row of units.
RUN = 512
#: Documents up to which their offsets are broadcast (some 80 bytes each); beyond, texts are joined by shuffle.
BROADCAST_DOCS = 500_000
#: The marks of prefix, suffix and middle (fixed values), and the shares in percent of documents left plain and of those
#: with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20


def _identity(key: Column, text: Column) -> Column:
    """Equal for rows of equal key and text alone: these have equal units, cuts and outputs."""
    return F.unhex(F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), text), 256))


def units(docs: DataFrame, key: str, text: str, pattern: str | None = None) -> DataFrame:
    """``_doc, key, pos, at_unit, at_char, n_units, n_chars``: each row of units, how many of each come before it in its text, and
    the text's totals. Repeated rows of ``docs`` count once. Empty texts have no units."""
    found = rf"(?s){pattern}|." if pattern else rf"(?s).{{1,{RUN}}}"
    body = F.coalesce(F.col(text), F.lit(""))
    told = docs.select(_identity(F.col(key), body).alias("_doc"), F.col(key).alias("key"), body.alias("body"))  # once a text, before it becomes rows
    rows = told.select("_doc", "key", F.posexplode(F.regexp_extract_all("body", F.lit(found), F.lit(0))).alias("pos", "match"))
    rows = rows.select("_doc", "key", "pos", F.length("match").cast("bigint").alias("chars"))
    rows = rows.repartition("_doc").dropDuplicates(["_doc", "pos"]).withColumn("units", F.lit(1).cast("bigint") if pattern else F.col("chars"))
    whole = Window.partitionBy("_doc")
    before = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"at_{c[:-1]}") for c in ("units", "chars")]
    return rows.select("_doc", "key", "pos", *sums, *(F.sum(c).over(whole).alias(f"n_{c}") for c in ("units", "chars")))


def offsets(docs: DataFrame, key: str, text: str, cuts: Callable[[Column, Column], list[Column]], pattern: str | None = None) -> DataFrame:
    """``_doc, n_units, cuts``: the offsets, in code points, of the ``cuts`` of each text with units. ``cuts(key, n)`` gives numbers of
    units, 0 to n each."""
    rows, per = stored(units(docs, key, text, pattern), "units"), 1 if pattern else RUN  # read twice: the texts are matched once
    asked = rows.where("pos = 0").select("_doc", "n_units", "n_chars", F.posexplode(F.array(*cuts(F.col("key"), F.col("n_units")))).alias("cut", "unit"))
    asked = asked.withColumn("pos", F.expr(f"unit div {per}").cast("int"))
    placed = asked.join(rows.select("_doc", "pos", "at_unit", "at_char"), ["_doc", "pos"], "left")
    # a cut behind the last unit has no row of its own, if that row is full
    offset = F.coalesce(F.col("at_char") + F.col("unit") - F.col("at_unit"), F.col("n_chars"))
    ordered = F.array_sort(F.collect_list(F.struct("cut", offset.alias("offset"))))
    return placed.groupBy("_doc").agg(F.first("n_units").alias("n_units"), F.transform(ordered, lambda c: c["offset"]).alias("cuts"))


def hashes(key: Column, seed: object = 1, n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight digits of the hexadecimal SHA-256 of seed and key, as numbers."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(n)]


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made."""

    def whole(parts: Column) -> Column:
        first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
        return F.when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))

    split = F.array(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1))
    return F.when(form == "plain", output).otherwise(F.get(F.transform(split, whole), F.lit(0)))  # the lambda's parts are split once


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: object = 1, pattern: str | None = None) -> DataFrame:
    """The columns of ``docs`` and ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars, middle_chars`` (code points, null if
    plain) and ``output``. Cuts and forms follow from ``seed`` and ``key``.

    Null texts count as empty; empty texts and those that contain a mark stay plain. A null key counts as an empty one.
    Repeated rows are answered each, alike; columns of ``docs`` with the names of new ones are replaced. Empty tables
    give no rows.
    """
    h1, h2, h3, h4 = hashes(F.col(key), seed)

    def cuts(name: Column, n: Column) -> list[Column]:
        one, two = (h % (n + 1) for h in hashes(name, seed, 2))
        return [F.least(one, two), F.greatest(one, two)]

    doc, body, made = fresh(docs, "_doc"), fresh(docs, "_body"), {"n", "form", "prefix_chars", "middle_chars", "output"}
    held = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(doc, _identity(F.col(key), F.col(body)))
    found = stored(offsets(docs, key, text, cuts, pattern), "offsets").select(F.col("_doc").alias(doc), "n_units", "cuts")
    few = found.count() <= BROADCAST_DOCS
    names = {c: fresh(docs, f"_{c}") for c in ("n_units", "cuts")}
    found = found.select(doc, *(F.col(c).alias(n) for c, n in names.items()))
    joined = held.join(F.broadcast(found) if few else found, doc, "left")
    whole, (low, high) = F.col(body), (F.get(F.col(names["cuts"]), F.lit(k)) for k in (0, 1))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = F.when(high.isNull() | marked | (h3 % 100 >= 100 - PLAIN_PERCENT), "plain").when(h4 % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    shape = fresh(docs, "_form")
    joined = joined.withColumn(shape, form)
    prefix, middle, suffix = F.substr(whole, F.lit(1), low.cast("int")), F.substr(whole, (low + 1).cast("int"), (high - low).cast("int")), F.substr(whole, (high + 1).cast("int"))
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    output = F.when(F.col(shape) == "plain", whole).when(F.col(shape) == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col(shape) != "plain"
    return joined.select(
        *(docs[c] for c in docs.columns if c not in made), F.coalesce(F.col(names["n_units"]), F.lit(0)).cast("bigint").alias("n"), F.col(shape).alias("form"),
        F.when(cut, low).alias("prefix_chars"), F.when(cut, high - low).alias("middle_chars"), output.alias("output"),
    )
