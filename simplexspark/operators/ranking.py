"""Global row ids, exact random splits, autocorrelation of long ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplexspark.sources.stages import cut


def add_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Consecutive ids 1..n in the order of a unique key. Rows are range-partitioned and
    sorted; each partition numbers its own rows and a table of partition offsets, one row
    per partition, makes the numbers global. No window ever sees the whole table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id()
    numbered = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                .withColumns({"__pid": F.shiftright(local, 33), "__pos": local.bitwiseAND(F.lit((1 << 33) - 1))}))
    numbered = cut(numbered, "row-id")
    counts = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("c")).orderBy("__pid").collect()
    starts, seen = [], 0
    for row in counts:
        starts.append((row["__pid"], seen))
        seen += row["c"]
    # One row per partition: Spark broadcasts this table while it is small and joins it by shuffle beyond that.
    offsets = df.sparkSession.createDataFrame(starts, "__pid int, __start long")
    numbered = numbered.withColumn("__pid", F.col("__pid").cast("int")).join(offsets, "__pid")
    return numbered.withColumn(name, F.col("__start") + F.col("__pos") + 1).drop("__pid", "__pos", "__start")


def split_key(key: Sequence[str], seed: int) -> Column:
    """Pseudo-random order key of a row: the same on every run, engine and partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))


def split_exact(df: DataFrame, frac: float, seed: int, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Exactly floor(frac * n) rows drawn without replacement, and the rest. ``key`` must be
    unique. The drawn rows are the smallest hashes; the cut-off hash is found from counts of
    hash prefixes, so no global sort is needed and both halves are plain filters."""
    hashed = df.withColumn("__h", split_key(key, seed))
    n = df.count()
    want, prefix = int(frac * n), ""
    for width in (3, 6, 9):
        if want == 0:
            break
        # At most 4096 prefixes per pass reach the driver.
        counts = (hashed.filter(F.col("__h").startswith(prefix)).groupBy(F.substring("__h", 1, width).alias("p"))
                  .agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect())
        for row in counts:
            if want <= row["c"]:
                break
            want -= row["c"]
        prefix = row["p"]
        if row["c"] <= 1000:
            break
    if int(frac * n) == 0:
        return df.filter(F.lit(False)), df
    # What shares the last prefix is a handful of rows by the uniformity of the hash.
    tail = hashed.filter(F.col("__h").startswith(prefix)).select("__h").orderBy("__h").take(want)
    drawn = F.col("__h") <= F.lit(tail[-1][0])
    return hashed.filter(drawn).drop("__h"), hashed.filter(~drawn).drop("__h")


def acf(df: DataFrame, value: str, order: Sequence[str], max_lag: int = 23, by: Sequence[str] = (),
        chunk: int = 100_000) -> DataFrame:
    """Autocorrelation at lags 0..max_lag of one ordered series per ``by`` group: global mean,
    divisor n. Rows get a global position; positions are cut into chunks and each chunk also
    receives the ``max_lag`` rows that follow it, so lags are read by windows of bounded size
    even when one group holds most rows. ``order`` must be unique within a group."""
    by = list(by)
    rows = add_row_id(df.filter(F.col(value).isNotNull()).select(*by, *order, F.col(value).alias("__v")),
                      [*by, *order], "__i").select(*by, "__v", "__i")
    group = F.struct(*by) if by else F.lit(1)
    means = rows.groupBy(*by).agg(F.avg("__v").alias("__m"), F.count(F.lit(1)).alias("n"))
    if by:
        rows = rows.join(means, by)
    else:
        one = means.first()
        rows = rows.withColumns({"__m": F.lit(one["__m"]), "n": F.lit(one["n"])})
    rows = rows.select(*by, "n", "__i", F.struct(group.alias("g"), (F.col("__v") - F.col("__m")).alias("d")).alias("__x"))
    pos = F.col("__i") % chunk
    home = F.floor(F.col("__i") / chunk)
    homes = F.when((pos < max_lag) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    rows = rows.withColumn("__home", home).withColumn("__chunk", F.explode(homes))
    w = Window.partitionBy("__chunk").orderBy("__i")
    lags = range(max_lag + 1)
    seen = rows.select(*by, "n", "__home", "__chunk", "__x",
                       *[(F.lead("__x", l).over(w) if l else F.col("__x")).alias(f"__l{l}") for l in lags])
    own = seen.filter(F.col("__home") == F.col("__chunk"))
    sums = [F.sum(F.when(F.col(f"__l{l}.g") == F.col("__x.g"), F.col(f"__l{l}.d") * F.col("__x.d"))).alias(f"__s{l}")
            for l in lags]
    table = own.groupBy(*by, "n").agg(*sums) if by else own.groupBy("n").agg(*sums)
    rho = F.array(*[F.coalesce(F.try_divide(F.col(f"__s{l}"), F.col("__s0")), F.lit(0.0)) for l in lags])
    return (table.withColumn("__r", rho)
            .select(*by, "n", F.posexplode("__r").alias("lag", "acf"))
            .filter((F.col("lag") < F.col("n")) & F.col("acf").isNotNull()))


def pacf(acf_table: DataFrame, by: Sequence[str] = (), band: float = 1.0) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion on each group's short ACF
    row, with the +-band/sqrt(n) reference line."""
    by = list(by)
    rows = acf_table.groupBy(*by, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("__r"))
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.lit(1.0).alias("v"),
                     F.array().cast("array<double>").alias("out"))

    def step(state, k):
        phi, r = state["phi"], F.col("__r")
        back = F.transform(phi, lambda p, j: p * F.get(r, k - 1 - j))
        num = F.get(r, k) - F.aggregate(back, F.lit(0.0), lambda a, x: a + x)
        ref = F.coalesce(F.try_divide(num, state["v"]), F.lit(0.0))
        older = F.transform(phi, lambda p, j: p - ref * F.get(phi, F.size(phi) - 1 - j))
        return F.struct(F.array_append(older, ref).alias("phi"), (state["v"] * (1 - ref * ref)).alias("v"),
                        F.array_append(state["out"], ref).alias("out"))

    ks = F.when(F.size("__r") > 1, F.sequence(F.lit(1), F.size("__r") - 1)).otherwise(F.array().cast("array<int>"))
    out = rows.withColumn("__p", F.aggregate(ks, start, step)["out"])
    return (out.select(*by, "n", F.posexplode("__p").alias("lag", "pacf"))
            .withColumns({"lag": F.col("lag") + 1, "band": F.lit(band) / F.sqrt(F.col("n"))}))
