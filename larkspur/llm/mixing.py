"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) take the weights 5, 2, 1 in turn and share all words by weight; a
target stops at ``MOST`` times its source's words, and the excess is shared anew by weight until none is above.

Rates: a source's documents get the rates closest to 1 in relative entropy, counted by words, under two constraints on
its words: they reach the source's target, and their mean log document length is the corpus's (by ridge: an offset of
``RIDGE`` times the multiplier may stay, so that sources without such documents have a solution too). No rate exceeds
``MOST``. The dual of that problem is concave, with two multipliers for each source, and its solution tilts rates
exponentially: ``min(MOST, exp(a + b * (ln size - corpus mean)))``. It is found by Newton steps, halved where the
dual would fall. A step is one distributed aggregate of the moments over the table of (source, size, documents);
moments are added as decimals, so that reruns agree to the last digit.

Copies: a document is taken whole as often as its rate's whole part says. The rest of a source's target goes to
documents in ascending order of uniform hash over fractional part (sequential Poisson sampling), whole, but for the
one document in which the target is reached, of which a part is taken. The order is found in two steps, by buckets
of the hash, as many as make some ``BUCKET_ROWS`` documents each, and then inside one bucket, so no task ever sorts a
source. Sources are numbered by ranges; no window runs over all of them.

Defined results: a null text has size 0 and none taken; documents of equal order keys are told apart by identifier
and size; sources without words have target 0; repeated rows count each; an empty table gives no rows; further
columns are not read by ``mix`` and pass through ``apply_mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import fresh, stored

WEIGHTS, MOST, WORD = (5, 2, 1), 3, r"[^\x20\x09-\x0D]+"
RIDGE, ROUNDS, NEAR = 0.1, 80, 1e-11
BUCKET_ROWS, FEWEST_BUCKETS = 65_536, 64
#: Sources up to which their table is broadcast, and sources in a part of a stored table of them.
BROADCAST_SOURCES = 100_000
#: Documents up to which their numbers of copies are broadcast.
BROADCAST_KEYS = 1_000_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def _parts(n: int) -> int:
    return 1 + n // BROADCAST_SOURCES


def targets(sized: DataFrame) -> DataFrame:
    """``source, sid, n, source_size, target, filled`` from ``source, size``; sid numbers the sources in their order,
    filled tells those that stop at their limit."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = F.col("source").asc_nulls_last()
    ranged = stored(sums.repartitionByRange(order).select("*", F.spark_partition_id().alias("part")), "sources")
    before, at = {}, 0
    for r in sorted(ranged.groupBy("part").count().collect(), key=lambda r: r["part"]):
        before[r["part"]], at = at, at + r["count"]
    offset = F.element_at(F.array(*(F.lit(before.get(k, 0)) for k in range(max(before, default=0) + 1))), F.col("part") + 1)
    ranked = ranged.withColumn("sid", F.row_number().over(Window.partitionBy("part").orderBy(order)) + offset).drop("part")
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("sid") - 1) % len(WEIGHTS) + 1))
    ranked = stored(ranked.withColumn("limit", MOST * F.col("source_size").cast("double")).coalesce(_parts(at)), "weights")
    level, full, known = 0.0, F.lit(False), -1
    while True:  # a round fills the sources that the last one's level overflows
        r = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, 1).otherwise(0)).alias("n"),
            F.sum(F.when(full, F.col("limit").cast("decimal(38,3)"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if r["n"] is None or r["n"] == known:
            break
        known, level = r["n"], (r["all"] - float(r["held"] or 0)) / r["weight"] if r["weight"] else 0.0
        full = F.lit(level) * F.col("weight") > F.col("limit")
    target = F.when(full, F.col("limit")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "sid", "n", "source_size", target.alias("target"), (full | (target >= F.col("limit"))).alias("filled"))


def mean_log_size(histogram: DataFrame) -> float:
    """The mean of ln size over all words."""
    words = F.col("size").cast("double") * F.col("docs")
    r = histogram.where("size > 0").agg(F.sum((words * F.ln("size")).cast("decimal(38,10)")), F.sum(words.cast("decimal(38,3)"))).first()
    return float(r[0] / r[1]) if r[1] else 0.0


def tilted(a: Column, b: Column, size: Column, mean: float) -> Column:
    """The exponent of a rate."""
    return a + b * (F.ln(size.cast("double")) - F.lit(mean))


def balance(histogram: DataFrame, sources: DataFrame, mean: float) -> DataFrame:
    """``sid, a, b``: the multipliers of each source that is not filled. ``histogram`` has ``sid, size, docs``."""
    n, top = sources.count(), math.log(MOST)
    goal = sources.where("target > 0 and not filled").select("sid", F.col("target").alias("goal"))
    sizes = histogram.where("size > 0").join(_small(goal.select("sid"), n), "sid", "left_semi")
    start = F.ln(F.col("goal") / F.col("source_size"))
    dual = sources.where("target > 0 and not filled").select("sid", F.col("target").alias("goal"), "source_size")
    zero = F.lit(0.0)
    dual = dual.select("sid", "goal", start.alias("a"), zero.alias("b"), F.lit(float("-inf")).alias("value"), zero.alias("da"), zero.alias("db"), F.lit(1.0).alias("step"))

    def exact(c: Column) -> Column:
        return F.sum(c.cast("decimal(38,10)")).cast("double")

    for _ in range(ROUNDS):
        words, z = F.col("size").cast("double") * F.col("docs"), F.ln(F.col("size").cast("double")) - F.lit(mean)
        tried_a, tried_b = F.col("a") + F.col("step") * F.col("da"), F.col("b") + F.col("step") * F.col("db")
        slope = F.col("ta") + F.col("tb") * z
        inside = slope < F.lit(top)
        rate = F.when(inside, F.exp(slope)).otherwise(F.lit(float(MOST)))
        paid = F.when(inside, F.exp(slope)).otherwise(F.lit(float(MOST)) * (1 + slope - F.lit(top)))
        bent = F.when(inside, words * rate).otherwise(0.0)
        state = ["sid", "goal", "a", "b", "value", "da", "db", "step", "ta", "tb"]
        moments = (
            sizes.join(_small(dual.withColumn("ta", tried_a).withColumn("tb", tried_b), n), "sid")
            .groupBy(*state)
            .agg(exact(words * paid).alias("paid"), exact(words * rate).alias("f0"), exact(words * rate * z).alias("f1"), exact(bent).alias("h0"), exact(bent * z).alias("h1"), exact(bent * z * z).alias("h2"))
        )
        goal_, ta, tb = F.col("goal"), F.col("ta"), F.col("tb")
        value = goal_ * ta - F.col("paid") - 0.5 * RIDGE * goal_ * tb * tb
        g0, g1 = goal_ - F.col("f0"), -F.col("f1") - RIDGE * goal_ * tb
        # the dual's curvature, with a trifle more so that a source at its limit still moves
        h0, h2 = F.col("h0") + 1e-9 * goal_, F.col("h2") + RIDGE * goal_
        det = h0 * h2 - F.col("h1") * F.col("h1")
        taken = value >= F.col("value") - 1e-12 * F.abs(F.col("value"))
        new = {
            "a": (ta, F.col("a")), "b": (tb, F.col("b")), "value": (value, F.col("value")), "da": ((h2 * g0 - F.col("h1") * g1) / det, F.col("da")),
            "db": ((h0 * g1 - F.col("h1") * g0) / det, F.col("db")), "step": (F.lit(1.0), F.col("step") / 2),
            "gap": (F.greatest(F.abs(g0), F.abs(g1)) / goal_, F.lit(1.0)),
        }
        moved = moments.select("sid", "goal", *(F.when(taken, yes).otherwise(no).alias(c) for c, (yes, no) in new.items()))
        moved = stored(moved.coalesce(_parts(n)), "dual")
        dual = moved.drop("gap")
        if (moved.agg(F.max("gap")).first()[0] or 0.0) < NEAR:
            break
    return dual.select("sid", "a", "b")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``key, size, source_size, target, rate, copies, taken`` of every document: taken counts words, repeats included."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")), "sizes")
    sources = stored(targets(sized), "targets")
    n = sources.count()
    buckets = F.greatest(F.lit(FEWEST_BUCKETS), F.ceil(F.col("n") / F.lit(BUCKET_ROWS)))
    known = sources.withColumnRenamed("source", "_source").withColumn("buckets", buckets)
    tagged = sized.join(_small(known, n), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "n")
    histogram = stored(tagged.groupBy("sid", "size").agg(F.count("*").alias("docs")), "histogram")
    mean = mean_log_size(histogram)
    dual = balance(histogram, sources, mean)
    tilt = F.exp(F.least(F.lit(math.log(MOST)), tilted(F.col("a"), F.col("b"), F.col("size"), mean)))
    rate = F.when((F.col("target") <= 0) | (F.col("size") == 0), 0.0).when(F.col("filled"), float(MOST)).otherwise(F.least(F.lit(float(MOST)), F.round(tilt, 9)))
    u = F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit("mix")), 12) / F.lit(float(1 << 52))
    rated = tagged.join(_small(dual, n), "sid", "left").select("key", "sid", "size", "source_size", "target", "buckets", rate.alias("rate"), u.alias("u"))
    rated = rated.withColumn("copies", F.floor("rate"))
    part = F.col("rate") - F.col("copies")
    rank = F.when(part > 0, F.col("u") / part)
    rated = rated.withColumn("rank", rank / (1 + rank)).withColumn("bucket", F.floor(F.col("rank") * F.col("buckets")))
    sums = rated.groupBy("sid", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("copies")).alias("whole"), F.first("target").alias("target"))
    sums = stored(sums, "buckets")
    extra = sums.groupBy("sid").agg((F.round(F.first("target")).cast("bigint") - F.sum("whole")).alias("extra"))
    run = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sums.where(F.col("bucket").isNotNull())
        .select("sid", "bucket", "words", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("before"))
        .join(extra, "sid")
        .where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("words") >= F.col("extra")))
        .select("sid", F.col("bucket").alias("edge"), (F.col("extra") - F.col("before")).alias("left"))
    )
    # a source whose buckets hold less than its extra words takes them all; one without extra words takes none
    none = extra.where(F.col("extra") <= 0).select("sid", F.lit(-1).cast("bigint").alias("edge"), F.lit(0).cast("bigint").alias("left"))
    edges = stored(edge.unionByName(none).coalesce(_parts(n)), "edges")
    faced = rated.join(_small(edges, n), "sid", "left")
    at = F.coalesce("edge", F.lit((1 << 62)))
    clear = faced.where(F.col("bucket").isNull() | (F.col("bucket") != at))
    clear = clear.withColumn("more", F.when(F.col("bucket") < at, F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("sid").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = faced.where(F.col("bucket") == at)
    room = F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0))
    split = split.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    taken = (F.col("copies") * F.col("size") + F.col("more")).alias("taken")
    out = clear.unionByName(split).select("key", "size", "source_size", "target", "rate", "copies", taken)
    return out.withColumnRenamed("key", key)


def apply_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents, each as often as the mix takes it; a part of half a document or more counts as one copy. Rows that
    repeat an identifier are told apart by their sizes; those of one size share what the mix takes of them evenly."""
    found = mix(docs, key, source, text).where("taken > 0")
    at, many, copy, size = (fresh(docs, f"mix_{c}") for c in ("key", "times", "copy", "size"))
    number = F.round(F.sum("taken") / F.sum("size")).cast("int").alias(many)
    times = stored(found.groupBy(F.col(key).alias(at), F.col("size").alias(size)).agg(number).where(F.col(many) > 0), "times")
    times = F.broadcast(times) if times.count() <= BROADCAST_KEYS else times
    copies = docs.join(times, F.col(key).eqNullSafe(F.col(at)) & (F.regexp_count(F.col(text), F.lit(WORD)) == F.col(size)))
    return copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)
