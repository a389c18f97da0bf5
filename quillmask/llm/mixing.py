"""Mixing sources to target weights by entropy balancing.

Sizes are words. Sources get token targets; the rates r that meet sum(size * r) = target
in each source with the least relative entropy to "every document once" are
r = min(CAP, exp(lambda * size / scale)): exponentially tilted document rates. The convex
dual has one lambda a source, found by Newton steps kept inside a bracket. A step is one
grouped sum over the table (source, size, documents), a histogram that is combined before
its shuffle and holds no document, and the lambdas stay in a table as well, so neither
many documents nor many sources reach the driver.

Rates become whole copies: every size class takes floor(documents * rate) copies, evenly
spread over its documents in hash order; what is missing to the target is filled with one
more copy in classes drawn by their fractional parts, and the rest, less than a document,
greedily from the largest class that still fits. So a source ends within a few words of
its target where it has short documents. Ranks are counted inside hash bins of a class,
so no window holds a hot source or a large group of copies at once.

Defined cases: a null or empty text has size 0 and is never taken; null is a source of its
own and the last; equal rows are each a document; sources without words get target 0; an
empty table gives an empty result; a very long text is one large size like any other;
further columns, whatever their names, pass through untouched. Reruns give the same rows
because every order is one of hashes and column values; where ids are equal too, rows of
the same size are told apart by their number in a table that is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import common as C

CAP = 3
WEIGHTS = (1, 2, 3)
MAX_STEPS = 120
FAR = 1e12
BINS = 256


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): sources in code-point order,
    null last, weigh `weights` in turn and share the whole size; no target is above cap
    times its source's size, the excess goes by weight to the others."""
    per = C.settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # Water filling: order by size a weight; sources that reach their cap are a prefix of it.
    # With level t a unit of weight, target = min(cap * size, t * weight).
    one = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    turn = (F.row_number().over(one) - 1) % len(weights)
    rows = per.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") + 1).cast("int")))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("all_weight", F.sum("weight").over(all_rows))
        .withColumn("before_size", F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
        .withColumn("before_weight", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        # the level if exactly the sources before this one are capped
        .withColumn("level", (F.col("total") - cap * F.col("before_size")) / (F.col("all_weight") - F.col("before_weight")))
        .withColumn("free", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    )
    rows = rows.withColumn("t", F.min(F.when(F.col("free"), F.struct("before_weight", "level"))).over(all_rows).getField("level"))
    full = (cap * F.col("source_size")).cast("double")
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(full, F.coalesce(F.col("t") * F.col("weight"), full)))
    return rows.select("source", "source_size", target.alias("target"))


def _rate(lam: Column, z: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * z, F.lit(50.0))))


def _exact(x: Column) -> Column:
    """A sum that is the same in whatever order its rows come."""
    return F.sum(x.cast("decimal(38,10)")).cast("double")


def solve(classes: DataFrame, goal: DataFrame, cap: int = CAP, max_steps: int = MAX_STEPS) -> DataFrame:
    """(source, lam, scale) that meets goal's target in each source, by Newton steps on
    classes (source, size, n). A lambda of null stands for the cap. Raises if max_steps steps,
    of which bisection alone needs fewer, don't meet all targets."""
    same = F.col("source").eqNullSafe(F.col("s"))
    state = C.settle(
        classes.groupBy(F.col("source").alias("s"))
        .agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.sum(F.col("size") * F.col("n")).alias("whole"))
        .join(goal.select("source", "target"), same)
        .where((F.col("whole") > 0) & (F.col("target") < cap * F.col("whole") * (1 - 1e-12)))
        .select("s", "scale", "target", F.lit(0.0).alias("lam"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"), F.lit(False).alias("met")),
        "mix-state",
    )
    z = F.col("size") / F.col("scale")
    hint = F.broadcast if C.fits(state) else lambda df: df  # a row a source, in every step
    for _ in range(max_steps):
        r = _rate(F.col("lam"), z, cap)
        mass = F.col("n") * F.col("size") * r
        keep = ["s", "scale", "target", "lam", "low", "high"]
        sums = (
            classes.join(hint(state), same)
            .groupBy(*keep)
            .agg(_exact(mass).alias("got"), _exact(F.when(r < cap, mass * z).otherwise(0.0)).alias("slope"))
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - (F.col("got") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        # a side that has no bound yet is searched by doubling
        mid = F.when(F.col("nhigh") >= FAR, F.greatest(F.col("nlow") * 2, F.lit(1.0))).when(F.col("nlow") <= -FAR, F.least(F.col("nhigh") * 2, F.lit(-1.0)))
        mid = mid.otherwise((F.col("nlow") + F.col("nhigh")) / 2)
        met = F.abs(F.col("got") - F.col("target")) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-9)
        inside = (F.col("step") > F.col("nlow")) & (F.col("step") < F.col("nhigh"))
        seen = Observation()
        state = C.settle(
            sums.select(*keep, low.alias("nlow"), high.alias("nhigh"), step.alias("step"), met.alias("met")).select(
                "s", "scale", "target",
                F.when(F.col("met"), F.col("lam")).when(inside, F.col("step")).otherwise(mid).alias("lam"),
                F.col("nlow").alias("low"), F.col("nhigh").alias("high"), "met",
            ).observe(seen, F.count_if(~F.col("met")).alias("open")),
            "mix-state",
        )
        if not seen.get["open"]:
            break
    else:
        raise RuntimeError(f"no rates meet the targets after {max_steps} steps")
    return state.select(F.col("s").alias("source"), "lam", "scale")


def class_copies(classes: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, copies): whole copies of each class of equally long documents."""
    lam = solve(classes, goal, cap).select(F.col("source").alias("s"), "lam", "scale")
    c = classes.where(F.col("size") > 0).join(goal.select(F.col("source").alias("gs"), "target"), F.col("source").eqNullSafe(F.col("gs")))
    c = c.join(lam, F.col("source").eqNullSafe(F.col("s")), "left")
    want = F.col("n") * F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("scale"), cap))
    c = c.withColumn("want", want).withColumn("base", F.floor(F.col("want") + 1e-9)).withColumn("part", F.greatest(F.col("want") - F.col("base"), F.lit(0.0)))
    # one more copy for classes in the order of a hash over the fractional part, as long as it fits
    u = (F.pmod(F.xxhash64(F.lit("mix"), F.col("source"), F.col("size")), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    c = C.settle(
        c.select("source", "size", "n", "target", "base", F.when(F.col("part") > 1e-6, u / F.col("part")).alias("v")), "mix-classes"
    )
    per = Window.partitionBy("source")
    missing = F.col("target") - F.sum(F.col("base") * F.col("size")).over(per)
    running = F.sum(F.when(F.col("v").isNotNull(), F.col("size")).otherwise(0)).over(per.orderBy(F.col("v").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("missing", missing).withColumn("running", running)
    more = F.when(F.col("v").isNotNull() & (F.col("running") <= F.col("missing")), 1).otherwise(0)
    c = C.settle(c.select("source", "size", "n", "target", (F.col("base") + more).alias("copies")), "mix-classes")
    # the rest, greedily: the picks are few, so the folded state stays short
    room = F.struct(F.col("size"), (F.col("n") * cap - F.col("copies")).alias("room"))
    per_source = c.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"),
        F.sort_array(F.collect_list(room), asc=False).alias("rooms"),
    )
    picked = F.array().cast("array<struct<size:bigint,copies:bigint>>")
    start = F.struct(F.col("rest").cast("double").alias("rest"), picked.alias("picks"))

    def fill(a: Column, x: Column) -> Column:
        take = F.least(x.room, F.floor(a.rest / x.size + 1e-9)).cast("bigint")
        pick = F.struct(x.size.cast("bigint").alias("size"), take.alias("copies"))
        return F.when(
            take > 0, F.struct((a.rest - take * x.size).alias("rest"), F.concat(a.picks, F.array(pick)).alias("picks"))
        ).otherwise(a)

    picks = per_source.select(F.col("source").alias("ps"), F.explode(F.aggregate("rooms", start, fill).picks).alias("p"))
    picks = picks.select("ps", F.col("p.size").alias("psize"), F.col("p.copies").alias("extra"))
    joined = c.join(picks, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("psize")), "left")
    return C.settle(joined.select("source", "size", "n", (F.col("copies") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies")), "mix-copies")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, cap: int = CAP, rid: str | None = None) -> DataFrame:
    """For each row of docs: rid (the column of that name, else a fresh number), doc_id, source,
    size, source_size, target, copies."""
    C.bounded_memory(docs.sparkSession)
    sized = docs.select(
        (F.monotonically_increasing_id() if rid is None else docs[rid]).alias("rid"),
        docs[key].alias("key"),
        docs[source].cast("string").alias("source"),
        F.size(C.words_of(docs[text])).cast("long").alias("size"),
    )
    order = F.xxhash64(F.lit("copy"), F.col("key"))
    sized = C.settle(sized.withColumn("u", order).withColumn("bin", F.shiftrightunsigned("u", 56)), "mix-sizes")
    C.free_shuffles(docs.sparkSession)
    goal = C.settle(targets(sized, weights, cap), "mix-targets")
    classes = C.settle(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    copies = class_copies(classes, goal, cap)
    # spread a class's copies evenly: each document copies div n, and one more for the first ones in hash order
    bins = sized.groupBy("source", "size", "bin").agg(F.count("*").alias("n_bin"))
    before = F.coalesce(
        F.sum("n_bin").over(Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    plan = bins.withColumn("before", before).join(
        copies.select(F.col("source").alias("cs"), F.col("size").alias("csize"), "n", "copies"),
        F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("csize")),
    )
    plan = plan.select(F.col("source").alias("bs"), F.col("size").alias("bsize"), F.col("bin").alias("bbin"), "before", "n", "copies")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy("u", "key", "rid"))
    ranked = sized.withColumn("rank", rank).join(
        plan, F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bsize")) & (F.col("bin") == F.col("bbin")), "left"
    )
    each = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("before") + F.col("rank") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    g = C.checked_broadcast(goal).select(F.col("source").alias("gs"), "source_size", "target")
    out = ranked.join(g, F.col("source").eqNullSafe(F.col("gs")))
    return out.select("rid", F.col("key").alias(key), "source", "size", "source_size", "target", F.coalesce(each, F.lit(0)).cast("int").alias("copies"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    rows = C.numbered(docs, "mix-rows")
    parts = rows.select("rid", *[F.col("doc").getField(c).alias(n) for c, n in ((text, "text"), (source, "source"), (key, "key"))])
    copies = mix(parts, "text", "source", "key", weights, cap, "rid").where(F.col("copies") > 0).select("rid", "copies")
    taken = rows.join(copies, "rid")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
