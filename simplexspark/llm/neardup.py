"""Near-duplicate documents by b-bit MinHash.

1. Every whole text becomes its set of word shingles, ``MINIMA`` minima of it, ``BANDS`` band keys made of full minima, and
   a signature of the low ``BITS`` bits of each minimum, mixed first so that chance differs per minimum, packed into a few long numbers.
2. Equal sets are one class from here on, so exact copies cost one entry however many there are.
3. Classes that share a band key are candidates. Each bucket has two centres (the class that meets most others over all its
   buckets, and one chosen by hash), and a class first meets the centre that it shares most buckets with. What is linked by that is one component so far;
   buckets that are all one component are done. In the others one pair is tried for every two components, and what
   still lies in different ones is compared in tiles. No pair within a known component is formed again, and no link
   between components is lost: a link matters only if it joins two of them.
4. A candidate's similarity is estimated from bit counts of the packed signatures, corrected for low bits that agree by
   chance; only estimates within five standard errors of the threshold or above it go on, and only sets whose sizes allow
   the similarity at all. Pairs with a set of fewer than ``SMALL`` shingles go on without an estimate.
5. Those are confirmed on the full sets, and components of confirmed links are found by alternating stars.

Candidates are missed only where no band agrees: (1 - s^4)^32 for similarity s, 5 in a million at 0.75 and fewer above.
Sets are compared through 64-bit hashes of shingles, classes through two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexspark.llm.text import WordHashes, mix64, words_of
from simplexspark.sources.stages import cut

SHINGLE, MINIMA, ROWS, BITS = 5, 128, 4, 4
BANDS, LONGS = MINIMA // ROWS, MINIMA * BITS // 64
PERCENT = 75
#: Least number of agreeing low bits of a candidate: the threshold less five standard errors, with the chance 2^-BITS.
LEAST = int(MINIMA * ((PERCENT / 100 - 0.2) * (1 - 2.0**-BITS) + 2.0**-BITS))
TILE = 1024
#: Pairs with a set below this size are never estimated. Sets up to ``WITH_SMALL`` can resemble such a one.
SMALL = 64
WITH_SMALL = SMALL * 100 // PERCENT
#: Minima of the second signature, and the least number that agree: again five standard errors below the threshold.
FINE = 1024
FINE_LEAST = int(FINE * ((PERCENT / 100 - 0.2 * (MINIMA / FINE) ** 0.5) * (1 - 2.0**-BITS) + 2.0**-BITS))

_random = np.random.Generator(np.random.PCG64(20))
_factor = _random.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_offset = _random.integers(0, 2**63, MINIMA, dtype=np.uint64)
_fine_factor = _random.integers(1, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_fine_offset = _random.integers(0, 2**63, FINE, dtype=np.uint64)
_place = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; with fewer words than a shingle has, of the whole sequence."""
    h = hashes.of(words_of(text))
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mix64(np.array([np.sum(h * _place[: len(h)], dtype=np.uint64) ^ np.uint64(len(h))], np.uint64))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i:i + n] * _place[i]
    return np.unique(mix64(total))


def minima(shingles: np.ndarray, step: int = 1024, factor: np.ndarray = _factor, offset: np.ndarray = _offset) -> np.ndarray:
    best = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), step):
        part = shingles[i:i + step, None] * factor
        part += offset
        np.minimum(best, part.min(axis=0), out=best)
    return best


def sketch(text: str | None, hashes: WordHashes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Size and digest (two numbers) of the set, packed signature, band keys."""
    s = shingle_set(text, hashes)
    digest = np.array([np.sum(mix64(s), dtype=np.uint64), np.sum(mix64(s ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)], np.uint64)
    m = minima(s)
    low = (mix64(m) & np.uint64(2**BITS - 1)).reshape(LONGS, -1) << np.arange(0, 64, BITS, dtype=np.uint64)
    bands = np.arange(BANDS, dtype=np.uint64)
    for column in m.reshape(BANDS, ROWS).T:
        bands = mix64(bands + column)
    return len(s), digest.view(np.int64), np.bitwise_or.reduce(low, axis=1).view(np.int64), bands.view(np.int64)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = [sketch(t.as_py(), hashes) for t in batch.column(2)]
        size, digest, packed, bands = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()),
             pa.array(packed, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "th", "n", "set_a", "set_b", "packed", "bands"])


def agreeing(a: str, b: str) -> Column:
    """How many of the low-bit fields of two packed signatures agree."""
    unlike = None
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        n = F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        unlike = n if unlike is None else unlike + n
    return F.lit(MINIMA) - unlike


def similarity_estimate(a: str, b: str) -> Column:
    """Share of agreeing fields, corrected for those that agree by chance."""
    chance = 2.0**-BITS
    return (agreeing(a, b) / MINIMA - chance) / (1 - chance)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets are similar enough. The set of the centre is kept from one row to the next."""
    hashes = WordHashes()
    last, left = None, None
    for batch in batches:
        a, b = [], []
        for x, y, tx, ty in zip(*batch.columns):
            x = x.as_py()
            if x != last:
                last, left = x, shingle_set(tx.as_py(), hashes)
            right = shingle_set(ty.as_py(), hashes)
            both = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * both >= PERCENT * (len(left) + len(right) - both):
                a.append(x)
                b.append(y.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose ``texts`` (node, text) are links."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return cut(both.mapInArrow(confirmed, "a long, b long"), "near-links")


def candidate_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of ``nodes``, one row each. The list of nodes grows with the corpus, so it is never broadcast: each
    text is shuffled once, and only those asked for are written."""
    asked = nodes.select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th"))
    found = docs.hint("merge").join(asked, (F.col("th") == F.col("r_th")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
    return cut(found.select("node", "text").dropDuplicates(["node"]), "near-texts")


def possible(a: str, b: str) -> Column:
    """Whether two classes (structs of n and packed) can be similar enough: sizes allow it and one is small or the estimate is near."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((F.least(na, nb) < SMALL) | (agreeing(f"{a}.packed", f"{b}.packed") >= LEAST))


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose estimate is not too low."""
    left, right = (nodes.select(F.col("node").alias(c), F.struct("n", "packed").alias(f"s{c}")) for c in ("a", "b"))
    return cut(pairs.join(right, "b").join(left, "a").where(possible("sa", "sb")).select("a", "b"), "near-pairs")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node that can be reached.

    Large star: each node's larger neighbours are tied to its smallest one. Small star: so are the smaller ones and the
    node itself. Repeated until nothing changes, every component is a star around its root.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    while True:
        if edges.join(edges.select(F.col("u").alias("child")), F.col("v") == F.col("child"), "left_semi").isEmpty() and \
                edges.groupBy("u").count().where("count > 1").isEmpty():  # roots have no parent, others have one
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = cut(sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "near-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct(), "near-edges")


def rooted_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets with the component that each member is in so far."""
    return cut(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-placed")


def open_buckets(placed: DataFrame) -> DataFrame:
    """(bucket, main, seats) of the buckets that hold several components: the component of a member chosen by hash, so
    mostly the largest, and the centres with theirs."""
    seat = F.when(F.array_contains("centres", F.col("node")), F.struct(F.col("node").alias("c"), F.col("root").alias("c_root")))
    found = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", F.xxhash64("node")).alias("main"), F.collect_list(seat).alias("seats"))
    return cut(found.where("low <> high").select("bucket", "main", "seats"), "near-open")


def centre_links(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between members and the centres of their buckets, the members with the components they give, and the buckets
    that stay open.

    A member first meets the one centre that it shares most buckets with. Of families of near copies that leaves little open.
    In the buckets that hold several components, one pair is tried for every two components, the one that shares most."""
    touch = members.select(F.explode("centres").alias("c"), F.col("node").alias("m")).where("c <> m").groupBy("m", "c").agg(F.count("*").alias("shared"))
    best = touch.groupBy("m").agg(F.max(F.struct("shared", (-F.col("c")).alias("less"))).alias("best")).select("m", (-F.col("best.less")).alias("c"))

    def tried(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("m", "c").alias("a"), F.greatest("m", "c").alias("b")).distinct()
        return confirm(promising(ordered, nodes), texts)

    links = tried(best)
    for last in (False, True):
        placed = rooted_members(members, components(links))
        unsettled = open_buckets(placed)
        if last or unsettled.isEmpty():
            return links, placed, unsettled
        apart = placed.join(unsettled, "bucket").select(F.col("node").alias("m"), "root", F.inline("seats")).where("root <> c_root")
        shared = apart.groupBy("m", "c", F.least("root", "c_root").alias("r"), F.greatest("root", "c_root").alias("s")).agg(F.count("*").alias("shared"))
        one = shared.groupBy("r", "s").agg(F.max_by(F.struct("m", "c"), F.struct("shared", "m", "c")).alias("p")).select("p.*")
        links = links.union(tried(one))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text), n_shingles, component_id, kept, first.

    component_id is the smallest id reachable over links, the document's own included; ``kept`` is doc_id = component_id;
    ``first`` marks the one row value (doc_id, th) that stands for its component. Null and blank texts have no shingles,
    are linked with nothing and stand for themselves. Null ids are linked like others but never name a component that has
    another id; a component of null ids only has a null id and keeps all of them (one of them is first). Rows with equal
    ids are separate documents. Other columns are not read; an empty table gives none.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))
    drawn = cut(docs.mapInArrow(sketches, "doc_id long, th long, n long, set_a long, set_b long, packed array<long>, bands array<long>"), "near-sketches")
    same = ["n", "set_a", "set_b"]
    nodes = drawn.where("n > 0").groupBy(*same).agg(
        F.min(F.struct("doc_id", "th")).alias("rep"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("known"),
        F.first("packed").alias("packed"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")  # the ids are fixed by this write
    keyed = nodes.select("node", F.explode("bands").alias("bucket"))
    crowds = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    crowded = cut(keyed.join(crowds, "bucket"), "near-crowded")
    # What a family derives from lies in its largest buckets, so the sum of a class's bucket sizes shows how central it is.
    central = crowded.join(crowded.groupBy("node").agg(F.sum("size").alias("met")), "node")
    centre = F.max_by("node", F.struct("met", (-F.col("node")).alias("less")))
    centres = central.groupBy("bucket").agg(F.array_distinct(F.array(centre, F.min_by("node", F.xxhash64("node")))).alias("centres"))
    members = cut(crowded.join(centres, "bucket"), "near-members")
    asked = nodes.join(members.select("node").distinct(), "node", "left_semi")
    texts = candidate_texts(docs, asked)
    links, placed, unsettled = centre_links(members, nodes, texts)
    links = links.union(across(cut(placed.join(unsettled.select("bucket", "main"), "bucket").drop("centres"), "near-unsettled"), texts))
    roots = components(links)
    rooted = nodes.select("node", "known", "rep", *same).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted, "near-rooted")
    first = cut(rooted.groupBy("root").agg(F.coalesce(F.min("known"), F.min("rep")).alias("first")), "near-first")
    found = rooted.join(first, "root").select(*[F.col(c).alias(f"c_{c}") for c in same], "first")
    out = drawn.drop("packed", "bands").join(found, (F.col("n") == F.col("c_n")) & (F.col("set_a") == F.col("c_set_a")) & (F.col("set_b") == F.col("c_set_b")), "left")
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    stands = F.when(F.col("n") > 0, F.struct("doc_id", "th").eqNullSafe(F.col("first"))).otherwise(True)
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), stands.alias("first"))


def across(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of a bucket that lie in different components.

    Of two such members at least one lies outside the bucket's main component (that of a member chosen by hash, so mostly
    its largest one). Those stand on the left and meet all members. A large bucket is cut into tiles: the left side is
    dealt to them, the right one in halves to each. A family of texts that share much, but not enough, fills buckets
    with pairs just below the threshold, so here signatures of ``FINE`` minima, and for small sets the sets themselves, decide
    which pairs are confirmed. Two members
    share many buckets; the smallest of them alone gives the pair, so each pair is made once."""
    keys = placed.groupBy("node").agg(F.collect_set("bucket").alias("keys"))  # at most one a band
    asked = cut(texts.join(keys, "node").select("node", "text", "keys").mapInArrow(fine_signatures, "node long, n long, fine binary, few binary, keys array<long>"), "near-fine")
    signed = placed.join(asked, "node").withColumn("tiles", F.ceil(F.col("size") / TILE))
    cells = F.expr("sequence(0L, tiles - 1)")
    left = signed.where("root <> main").select("bucket", "node", "root", "n", "fine", "few", "keys", F.lit(False).alias("inside"), F.pmod(F.xxhash64("node"), F.col("tiles")).alias("i"), F.explode(cells).alias("j"))
    right = signed.select(*[F.col(c).alias(c) for c in ("bucket", "node", "root", "n", "fine", "few", "keys")], (F.col("root") == F.col("main")).alias("inside"), F.explode(cells).alias("i"), F.pmod(F.xxhash64("node"), F.col("tiles")).alias("j"))
    key = ["bucket", "i", "j"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(near_in_tile, "a long, b long")
    return confirm(cut(pairs, "near-pairs"), texts)


def fine_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes) for t in batch.column(1)]
        low = [(mix64(minima(s, 128, _fine_factor, _fine_offset)) & np.uint64(2**BITS - 1)).reshape(FINE * BITS // 64, -1) << np.arange(0, 64, BITS, dtype=np.uint64) for s in sets]
        packed = [np.bitwise_or.reduce(x, axis=1).tobytes() for x in low]
        few = [s.tobytes() if len(s) <= WITH_SMALL else b"" for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(packed, pa.binary()), pa.array(few, pa.binary()), batch.column(2)],
                                         names=["node", "n", "fine", "few", "keys"])


def near_in_tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of a tile from different components whose sizes and fine signatures allow a link, and that share no smaller
    bucket than this one. Pairs with a set of fewer than ``SMALL`` shingles are compared on the sets."""
    out_a, out_b = [], []
    if left.num_rows and right.num_rows:
        a, ra, na, b, rb, nb = (t[c].to_numpy() for t in (left, right) for c in ("node", "root", "n"))
        inside = right["inside"].to_numpy()
        here = left["bucket"][0].as_py()
        ka, kb = ([frozenset(k) for k in t["keys"].to_pylist()] for t in (left, right))
        sa, sb = (np.frombuffer(b"".join(t["fine"].to_pylist()), np.uint64).reshape(t.num_rows, -1) for t in (left, right))
        fa, fb = ([np.frombuffer(f, np.uint64) for f in t["few"].to_pylist()] for t in (left, right))
        shingle, row = np.concatenate(fb), np.repeat(np.arange(len(b)), [len(f) for f in fb])
        order = np.argsort(shingle, kind="stable")
        shingle, row = shingle[order], row[order]
        ones = np.uint64(0x1111111111111111)
        for i in range(len(a)):
            maybe = np.flatnonzero((rb != ra[i]) & (inside | (a[i] < b)) & (100 * np.minimum(nb, na[i]) >= PERCENT * np.maximum(nb, na[i])))
            x = sb[maybe] ^ sa[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            unlike = np.bitwise_count(x & ones).sum(axis=1, dtype=np.int64)
            likely = FINE - unlike >= FINE_LEAST
            if len(fa[i]) and len(maybe):
                spans = zip(np.searchsorted(shingle, fa[i], "left").tolist(), np.searchsorted(shingle, fa[i], "right").tolist())
                both = np.bincount(np.concatenate([row[x:y] for x, y in spans]), minlength=len(b))[maybe]
                small = np.minimum(nb[maybe], na[i]) < SMALL
                likely = np.where(small, 100 * both >= PERCENT * (nb[maybe] + na[i] - both), likely)
            near = maybe[likely]
            hit = b[np.array([j for j in near.tolist() if min(ka[i] & kb[j]) == here], np.int64)]
            out_a.append(np.minimum(hit, a[i]))
            out_b.append(np.maximum(hit, a[i]))
    return pa.table({"a": np.concatenate(out_a) if out_a else np.empty(0, np.int64), "b": np.concatenate(out_b) if out_b else np.empty(0, np.int64)})


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id, its first row value if the
    id or the row is repeated. Documents without words all stay. All columns of ``docs`` come back."""
    classes = near_classes(docs, id_col, text_col).where("first").groupBy("doc_id", "th").agg(F.count("*").alias("times"), F.max("n_shingles").alias("n"))
    chosen = cut(classes.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), ((F.col("times") > 1) & (F.col("n") > 0)).alias("again")), "near-chosen")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    rows = rows.join(chosen, (F.col("th") == F.col("c_th")) & F.col("id").eqNullSafe(F.col("c_id")))
    once = rows.where("again").dropDuplicates(["c_id", "c_th"])
    return rows.where("not again").unionByName(once).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
