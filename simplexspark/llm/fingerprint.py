"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A paragraph (a line) becomes a wide vector; a document's fingerprint is the sum of the vectors of its paragraphs, lane by
lane, modulo a power of two. The order of paragraphs does not matter, and a paragraph is put in or taken out by adding or
subtracting its vector (``add_fingerprints``, ``subtract_fingerprints``).

A vector has two parts. ``EXACT`` lanes of 32 bits are hashed from the whole paragraph: equal multisets have equal sums,
different ones differ but for a chance of 2^-256 or so. ``LIKE`` lanes of 32 bits too add, for each run of up to three words of
the paragraph, plus or minus one by a bit of the run's hash: the cosine of two such sums estimates how many runs two
documents share. They are signed numbers and hold for texts of fewer than 2^31 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, LIKE = 8, 128
MASK32 = 0xFFFFFFFF


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def word_runs(text: Column) -> Column:
    """Hashes of the runs of three words that begin at each word of each paragraph (shorter ones at its end)."""
    # Words are bound to a variable before their neighbours are taken: an expression would be split anew for every word.
    lines = F.transform(F.filter(paragraphs(text), lambda p: F.length(F.trim(p)) > 0), lambda p: F.split(p, r"[\x20\x09-\x0D]+"))
    return F.flatten(F.transform(lines, lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))))


def exact_lanes(text: Column) -> Column:
    """Sums over the paragraphs of 32-bit lanes, each cut to 32 bits as it is added."""
    def add(sums: Column, p: Column) -> Column:
        return F.transform(sums, lambda s, i: (s + F.xxhash64(p["a"], p["b"], i).bitwiseAND(F.lit(MASK32))).bitwiseAND(F.lit(MASK32)))
    hashed = F.transform(paragraphs(text), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(p, F.lit(1)).alias("b")))
    return F.aggregate(hashed, F.array_repeat(F.lit(0).cast("long"), EXACT), add)


def packed_lanes(df: DataFrame, keys: list[str], text: Column, name: str) -> DataFrame:
    """``df`` rows as ``keys`` with ``name``: the fingerprint as an array of EXACT + LIKE numbers, one row per key.

    Runs are exploded and summed by key: plain sums of single bits, combined on the map side, so a text of any length is
    a stream of rows and never an array of vectors.
    """
    hashed = df.select(*keys, exact_lanes(text).alias("exact"), word_runs(text).alias("runs"))
    # Lanes travel as plain numbers: an array among the sums would turn the hash aggregate into a sort of all runs.
    exact = [f"e{i}" for i in range(EXACT)]
    rows = hashed.select(*keys, *[F.get("exact", F.lit(i)).alias(e) for i, e in enumerate(exact)], F.explode_outer("runs").alias("run"))
    wide = rows.withColumn("run2", F.when(F.col("run").isNotNull(), F.xxhash64("run", F.lit(2))))
    # Bits i and i + 32 of a hash are summed in one number; neither half can overflow, as no text has 2^31 words.
    two = F.lit((1 << 32) | 1)
    sums = [F.coalesce(F.sum(F.shiftrightunsigned(c, i).bitwiseAND(two)), F.lit(0)).alias(f"{c}_{i}") for c in ("run", "run2") for i in range(32)]
    out = wide.groupBy(*keys).agg(*[F.max(e).alias(e) for e in exact], F.count("run").alias("n"), *sums)
    halves = [h for c in ("run", "run2") for i in range(32) for h in (F.col(f"{c}_{i}").bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned(f"{c}_{i}", 32))]
    return out.select(*keys, F.array(*exact, *[F.pmod(h * 2 - F.col("n"), F.lit(1 << 32)) for h in halves]).alias(name))


def to_hex(lanes: Column) -> Column:
    """Fixed width: 8 hex digits per lane."""
    return F.array_join(F.transform(lanes, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def from_hex(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(EXACT + LIKE - 1)), lambda i: F.conv(F.substr(text, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def add_fingerprints(a: Column, b: Column) -> Column:
    """Fingerprint (lanes) of the paragraphs of both."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.pmod(z["a"] + z["b"], F.lit(1 << 32)))


def subtract_fingerprints(a: Column, b: Column) -> Column:
    """Fingerprint (lanes) of a's paragraphs without b's."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.pmod(z["a"] - z["b"], F.lit(1 << 32)))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 for equal fingerprints (also of texts without words), else the cosine of the likeness lanes as
    signed numbers, not below 0; 0 if one side has no words."""
    def signed(c: Column) -> Column:
        return F.transform(F.slice(c, EXACT + 1, LIKE), lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sa, sb = signed(a), signed(b)
    norm = F.sqrt(dot(sa, sa) * dot(sb, sb))
    return F.when(a == b, 1.0).when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(sa, sb) / norm)))


def fingerprint(docs: DataFrame, keys: list[str], text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """One row per distinct ``keys``: the fingerprint as lanes. Rows that share a key must share the text; null is the
    empty text, whose one paragraph is empty. Columns other than keys and text are not read."""
    return packed_lanes(docs, keys, F.col(f"`{text_col}`"), name)


def following(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """``docs`` (key, text) with bucket, tie and the text of the next document by descending key; the first one follows
    the last. Ties in the key are ordered by a hash of the text, null keys come last.

    Documents are dealt to ``buckets`` ranges of the key, whose bounds are percentiles (at most ``buckets`` numbers); the
    first document of a range is dealt to the range before it too. So a text is shuffled once, no window sees more than a
    range, and the ranges are of like size however the keys are spread.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("tie", F.xxhash64("text"))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("key", shares, 10_000)).first()[0] if shares else []
    bounds = sorted(set(bounds or []), reverse=True)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # Binary search for the number of bounds above the key: descending keys have ascending buckets.
    steps = [1 << s for s in reversed(range(max(1, len(bounds)).bit_length()))]
    place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(limits, at + s - 1) > F.col("key")), at + s).otherwise(at))
    rows = rows.withColumn("bucket", F.when(F.col("key").isNull(), len(bounds) + 1).otherwise(place))
    heads = (rows.groupBy("bucket").agg(F.max(F.struct(F.col("key").isNotNull().alias("set"), "key", "tie")).alias("head"))
             .orderBy("bucket").collect())  # a row per bucket
    before = [(h["head"]["key"], h["head"]["tie"], h["bucket"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]
    if len(heads) == 1:  # the last document of the only bucket is followed by its first one
        before = [(before[0][0], before[0][1], before[0][2], before[0][2])]
    table = docs.sparkSession.createDataFrame(before, "h_key long, h_tie long, h_bucket int, to int")
    copies = (rows.join(F.broadcast(table), F.col("key").eqNullSafe(F.col("h_key")) & (F.col("tie") == F.col("h_tie")))
              .select("key", "text", "tie", F.col("to").alias("bucket"), F.lit(1).alias("copy")).dropDuplicates(["bucket"]))
    both = rows.withColumn("copy", F.lit(0)).unionByName(copies)
    # A copy comes after all that belong to the bucket.
    order = Window.partitionBy("bucket").orderBy("copy", F.col("key").desc_nulls_last(), F.col("tie").desc())
    return both.withColumn("next", F.lead("text").over(order)).withColumn("at", F.row_number().over(order))


def edited_pairs(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text.

    The edited text has the last floor(n/2) characters replaced by as many first ones (or all) of the next document. One
    document alone is followed by itself. Repeated rows are documents of their own. Returns key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, next_fingerprint (lanes).
    """
    rows = following(docs, key, text, buckets)
    own, nxt = F.coalesce("text", F.lit("")), F.coalesce("next", F.lit(""))
    half = F.floor(F.length(own) / 2).cast("int")
    edited = F.concat(F.substr(own, F.lit(1), F.length(own) - half), F.substr(nxt, F.lit(1), half))
    rows = rows.select("bucket", "at", "key", "copy", own.alias("text"), edited.alias("edited"))
    versions = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("t")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("t")))
    facts = [F.col("key"), F.col("copy"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")]
    each = rows.select("bucket", "at", *facts, F.explode(versions).alias("v"))
    keys = ["bucket", "at", "key", "copy", "n_chars", "edited_sha256", "version"]
    lanes = packed_lanes(each.select(*keys[:-1], F.col("v.version").alias("version"), F.col("v.t").alias("t")), keys, F.col("t"), "lanes")
    order = Window.partitionBy("bucket").orderBy("at", "version")
    # By place and version: each text is followed by its edited text, and that by the next document's text.
    seen = lanes.withColumn("one", F.lead("lanes", 1).over(order)).withColumn("two", F.lead("lanes", 2).over(order))
    return seen.where((F.col("version") == 0) & (F.col("copy") == 0)).select(
        "key", "n_chars", "edited_sha256", F.col("lanes").alias("fingerprint"), F.col("one").alias("edited_fingerprint"), F.col("two").alias("next_fingerprint"))
