"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical without their ASCII white space. Three stages find the row of each group that stays,
and each of them compares the full content, never a digest alone, since the content is part of every grouping key:

1. Local: the rows of a task with one content become one row before anything is shuffled (the map side of the grouping).
2. Salted: those meet by digest. A hot digest, one with more than one row in ``HOT`` of all, is dealt to as many salts as there
   are partitions to a root, by the partition its rows were read in; every other digest has one salt, so it is complete here.
3. Global: the salt winners of the hot digests, at most one row a salt, are combined.

A first pass over the digests alone finds the hot ones; there are fewer than ``HOT`` of them, so they are broadcast. Every
content is shuffled once. Then each row learns its winner through the digest: by broadcast for the hot digests, by a shuffle
of (id, digest) for the others, none of which has more than one in ``HOT`` of the rows. Where stage 3 has shown that one digest
stands for several contents, its rows are matched on the content as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexspark.sources.stages import cut

#: A digest is hot if it has more than this share of all rows; fewer than ``HOT`` digests can be.
HOT = 1000
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256_of(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, n_chars (code points of the text), digest, content."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), normalised(text).alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def best_row() -> Column:
    """Order of the rows of a group, the last of it stays: most code points, then smallest id, null ids after all others."""
    return F.struct("n_chars", F.bitwise_not(F.col("doc_id")).alias("rank"))


def winners(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """(digest, best, n) of each content, by the three stages. Contents of one digest give several rows."""
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    dealt = dealt.withColumn("salt", salt).withColumn("hot", F.coalesce("hot", F.lit(False)))
    salted = dealt.groupBy("digest", "salt", "hot", "content").agg(F.max(best_row()).alias("best"), F.count("*").alias("n"))
    # The content is needed again for the hot digests only; the others are complete.
    salted = cut(salted.select("digest", "hot", F.when(F.col("hot"), F.col("content")).alias("content"), "best", "n"), "exact-salted")
    merged = salted.where("hot").groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return salted.where("not hot").select("digest", "best", "n").unionByName(merged.select("digest", "best", "n"))


def attached(rows: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """The rows with what their class knows, found by ``key``."""
    keep = F.bitwise_not(F.col("best.rank"))
    stays = F.col("doc_id").eqNullSafe(keep) & (F.col("n_chars") == F.col("best.n_chars"))
    return rows.join(classes, key).select("doc_id", "n_chars", "digest", keep.alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of,
                  hot_share: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, digest, keep_id, group_size, kept.

    Of equal texts the row with the most code points stays, then the smallest id; null ids come last, and a group of null
    ids only keeps a null id. Rows that repeat the id and the length of the one that stays cannot be told from it and are
    marked as kept, too; ``drop_exact_duplicates`` returns one of them. Null texts are empty ones, and all texts of white
    space are equal to these. Other columns are not read; an empty table gives none. ``digest`` may be any function of
    the content, also one that collides: equality is decided on contents.
    """
    rows = keyed(docs, id_col, text_col, digest)
    brief = cut(rows.select("doc_id", "n_chars", "digest"), "exact-digests")
    total = brief.count()
    salts = 1 + math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(cut(brief.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") * hot_share > total).select("digest"), "exact-hot"))
    classes = cut(winners(rows, hot, salts), "exact-classes")
    shared = cut(classes.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest"), "exact-collisions")
    if not shared.isEmpty():
        brief, classes = (t.join(shared, "digest", "left_anti") for t in (brief, classes))
    out = attached(brief.join(hot, "digest", "left_anti"), classes.join(hot, "digest", "left_anti"), ["digest"])
    out = out.unionByName(attached(brief, F.broadcast(classes.join(hot, "digest", "left_semi")), ["digest"]))
    if shared.isEmpty():
        return out
    doubtful = rows.join(shared, "digest", "left_semi")
    by_content = doubtful.groupBy("digest", "content").agg(F.max(best_row()).alias("best"), F.count("*").alias("n"))
    return out.unionByName(attached(doubtful, by_content, ["digest", "content"]))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the longest, then the one with the smallest id. All columns of
    ``docs`` come back; rows that only differ in other columns count as equal."""
    key = ["digest", "id", "n_chars"]
    stay = exact_classes(docs, id_col, text_col).where("kept").withColumnRenamed("doc_id", "id").groupBy(*key).agg(F.count("*").alias("times"))
    stay = cut(stay.select(*[F.col(c).alias(f"s_{c}") for c in key], "times"), "exact-stay")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.length(text).alias("n_chars"), sha256_of(normalised(text)).alias("digest"))
    rows = rows.join(stay, (F.col("digest") == F.col("s_digest")) & F.col("id").eqNullSafe(F.col("s_id")) & (F.col("n_chars") == F.col("s_n_chars")))
    once = rows.where("times > 1").dropDuplicates(["digest"])
    return rows.where("times = 1").unionByName(once).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
