"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be taken ``target / size of the source`` times. The whole part is certain; the fraction is
a probability. Two documents with fractions meet, and words move from one to the other, by chance and without changing the
expectation of either, until one of them is taken or left for certain. The other one goes on to meet the next. Words are
what moves, so the words taken stay equal to the target up to the one document that is left at the end.

Documents of a source are dealt by hash to blocks of about ``BLOCK``; a block leaves one residual document, residuals meet
in blocks of ``BLOCK`` again, and so on: a reduction tree whose tasks see a bounded number of documents, however large the
source is. Within a block the long documents meet first, so what is left at the end is a short one; the last document of a
source has nobody to meet and is rounded to the nearer side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexspark.llm.text import n_words
from simplexspark.operators.ranking import add_row_id
from simplexspark.sources.stages import cut

BLOCK = 256
#: One step of a block: ``s`` is the document with a fraction so far, ``x`` the next one; w words, m of them expected.
#: ``up`` moves words from x to s. What remains fractional is carried; a document that is taken is noted in ``ups``.
STEP = """
aggregate(slice(items, 2, size(items)), named_struct('pos', 0, 'w', items[0].w, 'm', items[0].m, 'h', items[0].h, 'ups', cast(array() as array<int>)),
 (s, x) -> transform(array(named_struct('up',
     (shiftrightunsigned(xxhash64(s.h, x.h, {seed}L), 11) / 9007199254740992D) * (least(s.w - s.m, x.m) + least(x.w - x.m, s.m)) < least(x.w - x.m, s.m))),
   t -> CASE
     WHEN t.up AND s.w - s.m <= x.m THEN named_struct('pos', x.pos, 'w', x.w, 'm', x.m - (s.w - s.m), 'h', x.h, 'ups', array_append(s.ups, s.pos))
     WHEN t.up THEN named_struct('pos', s.pos, 'w', s.w, 'm', s.m + x.m, 'h', s.h, 'ups', s.ups)
     WHEN x.w - x.m <= s.m THEN named_struct('pos', s.pos, 'w', s.w, 'm', s.m - (x.w - x.m), 'h', s.h, 'ups', array_append(s.ups, x.pos))
     ELSE named_struct('pos', x.pos, 'w', x.w, 'm', x.m + s.m, 'h', x.h, 'ups', s.ups) END)[0])
"""


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; none gets more than
    ``cap`` times its size, and what is cut off is shared again by weight until none is above. Only sums reach the driver.
    """
    ranked = cut(add_row_id(sizes, [F.col("source").asc_nulls_last()], "place"), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": F.col("source_size") * float(cap)}).drop("place")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, before = 0.0, None
    while share != before:
        above = F.col("weight") * share > F.col("most")
        full, free = ranked.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)),
                                F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        before, share = share, (total - full) / free if free else share
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * share).alias("target"))


def copy_counts(rows: DataFrame, id_cols: list[str], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0,
                seed: int = 7) -> DataFrame:
    """How often to take each document: ``rows`` holds ``id_cols``, source and size (words, long).

    Returns one row per distinct (id_cols, source, size): n_rows that are equal so, source_size, target, and ``copies``,
    the copies of all n_rows together. Equal rows are interchangeable; they are counted before the shuffle, so a row that
    is repeated without end is one row here. Documents without words are taken the whole part of their rate.
    The choice depends on the values and the seed only, never on partitions, so reruns agree. An empty table gives none.
    """
    spark = rows.sparkSession
    keys = [*id_cols, "source", "size"]
    units = cut(rows.groupBy(*keys).agg(F.count("*").alias("n_rows")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("units"))
    sizes = cut(sizes, "mix-sizes")
    targets = source_targets(sizes.select("source", "source_size"), weights, cap)
    targets = cut(targets.withColumnRenamed("source", "s").join(sizes.select("source", "units"), F.col("s").eqNullSafe(F.col("source"))).drop("s"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (units.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
               .withColumn("rate", rate).withColumn("whole", F.floor("rate"))
               .withColumn("rest", (F.col("rate") - F.col("whole")) * F.col("n_rows"))
               .withColumn("sure", F.col("whole") * F.col("n_rows") + F.when(F.col("size") > 0, F.floor("rest")).otherwise(0))
               .withColumn("rest", F.col("rest") - F.floor("rest")).withColumn("h", F.xxhash64(*keys, F.lit(seed))))
    out = [*keys, "n_rows", "source_size", "target", "sure"]
    uncertain = (F.col("rest") > 0) & (F.col("size") > 0)
    done = [planned.where(~uncertain).select(*out, F.lit(0).alias("more"))]
    blocks = F.ceil(F.col("units") / BLOCK)
    items = planned.where(uncertain).select(
        F.struct(*[F.col(c) for c in out]).alias("doc"), F.col("source").alias("s"), F.pmod(F.xxhash64("h", F.lit(1)), blocks).alias("block"),
        F.col("size").cast("double").alias("w"), (F.col("rest") * F.col("size")).alias("m"), "h")
    left = int(targets.agg(F.max(blocks)).first()[0] or 0)
    level = 0
    while left:
        level += 1
        block = items.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("by"), "h", "w", "m", "doc"))).alias("items"))
        block = block.withColumn("items", F.transform("items", lambda x, i: F.struct(i.alias("pos"), x["h"].alias("h"), x["w"].alias("w"), x["m"].alias("m"), x["doc"].alias("doc"))))
        stage = cut(block.withColumn("r", F.expr(STEP.format(seed=seed + level))).withColumn("r", F.struct("r.pos", "r.m", "r.ups")), f"mix-level{level}")
        met = stage.select(F.col("r.pos").alias("kept"), F.col("r.ups").alias("ups"), F.explode("items").alias("x")).where("x.pos <> kept")
        done.append(met.select("x.doc.*", F.array_contains("ups", F.col("x.pos")).cast("int").alias("more")))
        last = F.element_at("items", F.col("r.pos") + 1)
        residual = stage.select(last["doc"].alias("doc"), "s", "block", last["w"].alias("w"), F.col("r.m").alias("m"), last["h"].alias("h"))
        if left == 1:
            done.append(residual.select("doc.*", (F.col("m") * 2 >= F.col("w")).cast("int").alias("more")))
            break
        items = residual.withColumn("block", F.floor(F.col("block") / BLOCK).cast("long"))
        left = math.ceil(left / BLOCK)
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole.withColumn("copies", (F.col("sure") + F.col("more")).cast("long")).drop("sure", "more")


def mix_sources(docs: DataFrame, key_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
                weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0 to ``ceil(cap)`` times).

    ``size`` defaults to the words of column text. Null keys, sources and texts are values like others. Rows that are
    equal in every column are one group; all columns of ``docs`` come back, whatever their names. No column may be a map.
    """
    size = n_words(F.col("text")) if size is None else size
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{key_col}`").alias("key"),
                         F.col(f"`{source_col}`").alias("source"), size.cast("long").alias("size"))
    packed = packed.withColumn("row", F.xxhash64("doc"))
    plan = copy_counts(packed.select("key", "row", "source", "size"), ["key", "row"], weights, cap, seed)
    plan = plan.where("copies > 0").select(*[F.col(c).alias(f"p_{c}") for c in ("key", "row", "source", "size", "copies")])
    once = packed.groupBy("key", "row", "source", "size").agg(F.first("doc").alias("doc"))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("key", "row", "source", "size")]
    taken = once.join(plan, same[0] & same[1] & same[2] & same[3])
    step = 1024  # a row that is repeated without end must not become one endless array
    taken = taken.select("doc", "p_copies", F.explode(F.expr(f"sequence(0L, (p_copies - 1) div {step})")).alias("i"))
    taken = taken.select("doc", F.explode(F.expr(f"sequence(1L, least({step}L, p_copies - i * {step}))")).alias("i"))
    return taken.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
