"""Spelling variants by Bloom-guided neighbourhoods.

Words that differ by one inserted, deleted or replaced code point are near. The vocabulary is counted over all texts, and every
word generates its own deletions and replacements (an insertion is the deletion seen from the other word). Each edit
is probed against the Bloom filter of its length; only edits that the filter lets through become rows, and an exact join with
the vocabulary removes those that are no words.

The filters are blocked, one shard a length: a word sets one bit in each of the eight 64-bit lanes of one block. They are
built by an aggregate over the vocabulary and hold ``BITS`` bits a word, but never more than ``FILTER_BYTES`` in all, so they are
broadcast; beyond that size they are fuller and let more through, which costs rows in the join and changes no result.

The hash of a word is a sum over its places, so the hash of an edit is the sum of its unchanged parts and one term:
edits are probed as arrays of numbers, and only those let through are spelled out. A word has at most (length + 1) edits a
letter of the alphabet, so no word is hot, neither as a source nor as a key of the join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexspark.llm.text import mix64
from simplexspark.sources.stages import cut

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Lower-casing touches A-Z only, so these are the code points of a word.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
LANES, BITS, FILTER_BYTES = 8, 16, 32 << 20
#: A task hands on its counts at so many words or characters, and probes so many edits at once.
HELD_WORDS, HELD_CHARS, PROBED = 300_000, 32 << 20, 1 << 20
TIMES = 5

_lane = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: What an operator may do to a run before it is counted: (id, distinct runs) to the runs that change and what they become.
Change = Callable[[int | None, Counter], dict[str, str]]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, change: Change | None = None) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points that occur ``min_count`` times or more. Words are maximal
    runs of letters with A-Z lower-cased; ``change`` may replace runs of a text before they are counted, by shorter or
    equally long ones. Null texts have none; rows with equal ids are texts of their own."""
    runs = re.compile(f"{LETTERS}{{{min_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                own = Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                changed = change(doc, own) if change else {}
                for run, n in {run: own.pop(run) for run in changed}.items():
                    own[changed[run]] += n
                held.update(own)
                chars += len(text)
                if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                    yield as_batch(held)
                    held, chars = Counter(), 0
        yield as_batch(held)

    def as_batch(held: Counter) -> pa.RecordBatch:
        long = {w: n for w, n in held.items() if len(w) >= min_length}
        return pa.RecordBatch.from_arrays([pa.array(long.keys(), pa.string()), pa.array(long.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def place_terms(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Term of a code point at a place in the hash of a word."""
    return mix64(codes * np.uint64(0x9E3779B97F4A7C15) + mix64(places.astype(np.uint64)))


def bits_of(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the hash that the bits of its lanes are taken from."""
    h = mix64(hashes)
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), h


def lane_bit(h: np.ndarray, lane: int) -> np.ndarray:
    return np.uint64(1) << (h * _lane[lane] >> np.uint64(58))


def by_length(words: list[str]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Places of the words of each length, and their code points, in groups of bounded size."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, PROBED // (n * len(ALPHABET)))
        for i in range(0, len(at), step):
            part = at[i:i + step].tolist()
            text = "".join(words[j] for j in part).encode("utf-32-le", "surrogatepass")
            yield n, part, np.frombuffer(text, np.uint32).reshape(len(part), n).astype(np.uint64)


def filter_blocks(vocabulary: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(shard, block, l0 .. l7): the blocks of the filters that are not empty."""
    lanes = [f"l{i}" for i in range(LANES)]

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, codes in by_length(batch.column(0).to_pylist()):
                block, h = bits_of(place_terms(codes, np.arange(n)).sum(axis=1, dtype=np.uint64), blocks[n])
                bits = [pa.array(lane_bit(h, i).view(np.int64)) for i in range(LANES)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n)), pa.array(block), *bits], names=["shard", "block", *lanes])

    rows = vocabulary.select("word").mapInArrow(entered, "shard long, block long, " + ", ".join(f"{x} long" for x in lanes))
    return rows.groupBy("shard", "block").agg(*[F.bit_or(x).alias(x) for x in lanes])


def bloom_filters(vocabulary: DataFrame) -> dict[int, np.ndarray]:
    """Filter of each length that words have: an array of blocks by lanes, at most ``FILTER_BYTES`` in all and 64 bytes a
    length more. What reaches the driver is the filters themselves."""
    sizes = {r.length: r.n for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    bits = min(BITS, 8 * FILTER_BYTES / max(1, sum(sizes.values())))
    blocks = {n: max(1, int(count * bits / (64 * LANES)) + 1) for n, count in sizes.items()}
    filters = {n: np.zeros((count, LANES), np.uint64) for n, count in blocks.items()}
    table = filter_blocks(vocabulary, blocks).toArrow()
    shard, block, *lanes = (np.asarray(c) for c in table.columns)
    for n in np.unique(shard).tolist():
        mine = shard == n
        filters[n][block[mine]] = np.stack([x[mine].view(np.uint64) for x in lanes], axis=1)
    return {n: f for n, f in filters.items() if len(f)}


def let_through(hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Places of the hashes (of any shape, flattened) that the filter may hold."""
    block, h = bits_of(hashes.ravel(), len(shard))
    left = np.arange(len(h))
    for lane in range(LANES):
        left = left[(shard[block[left], lane] & lane_bit(h[left], lane)) != 0]
    return left


def probed_edits(filters: dict[int, np.ndarray], alone: set[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function from (word, n) to (word, n, edit, shorter): the edits that the filters let through. Lengths in ``alone`` have one
    word only, which has no replacement that is a word."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for n, part, codes in by_length(words):
                out = [*deletions(n, codes), *([] if n in alone else replacements(n, codes))]
                source = [part[i] for i, _, _ in out]
                edits = [words[j][:k] + c + words[j][k + 1:] for j, (_, k, c) in zip(source, out)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[j] for j in source], pa.string()), pa.array([counts[j] for j in source], pa.int64()), pa.array(edits, pa.string()), pa.array([not c for _, _, c in out], pa.bool_())],
                    names=["word", "n", "edit", "shorter"])

    def deletions(n: int, codes: np.ndarray) -> Iterator[tuple[int, int, str]]:
        if n - 1 not in filters:
            return
        places = np.arange(n)
        before = np.cumsum(place_terms(codes, places), axis=1, dtype=np.uint64)
        moved = np.cumsum(place_terms(codes, places - 1)[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]  # terms from here on, one place down
        nothing = np.zeros((len(codes), 1), np.uint64)
        hashes = np.hstack([nothing, before[:, :-1]]) + np.hstack([moved[:, 1:], nothing])
        for at in let_through(hashes, filters[n - 1]).tolist():
            i, k = divmod(at, n)
            if not k or codes[i, k] != codes[i, k - 1]:  # of equal neighbours, one deletion
                yield i, k, ""

    def replacements(n: int, codes: np.ndarray) -> Iterator[tuple[int, int, str]]:
        own = place_terms(codes, np.arange(n))
        total = own.sum(axis=1, dtype=np.uint64)
        step = max(1, PROBED // (len(codes) * len(ALPHABET)))
        for k in range(0, n, step):
            places = np.arange(k, min(n, k + step))
            new = place_terms(ALPHABET[None, :], places[:, None])
            hashes = (total[:, None] - own[:, places])[:, :, None] + new[None]
            for at in let_through(hashes, filters[n]).tolist():
                i, rest = divmod(at, len(places) * len(ALPHABET))
                place, letter = divmod(rest, len(ALPHABET))
                if ALPHABET[letter] != codes[i, k + place]:
                    yield i, k + place, chr(int(ALPHABET[letter]))

    return probe


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two words of ``vocabulary`` (word, n) that are near, each seen from both."""
    filters = bloom_filters(vocabulary)
    sizes = vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).where("n = 1").collect()
    shared = vocabulary.sparkSession.sparkContext.broadcast((filters, {r.length for r in sizes}))
    spread = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from probed_edits(*shared.value)(batches)

    # The vocabulary is small against the work of its edits, so it is spread over all tasks first.
    edits = vocabulary.repartition(spread, "word").mapInArrow(probe, "word string, n long, edit string, shorter boolean")
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("other_n"))
    pairs = cut(edits.join(known, "edit").select("word", "n", F.col("edit").alias("other"), "other_n", "shorter"), "spelling-pairs")
    back = pairs.where("shorter").select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.drop("shorter").unionByName(back)


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word of ``links`` (word, form): the last form of its chain. Forms never form a circle, since
    each occurs more often than its word. Every round doubles the steps that are taken at once."""
    found = links.select("word", F.col("form").alias("root"))
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(found.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        found = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return found


def spelling_forms(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per word of ``counts`` (word, n): word, form, root, n, n_near, form_n.

    The form of a word is its near word with the largest n (ties: the smallest in code-point order) if that n is at least
    ``times`` (more than 1) its own; else null, and form_n with it. The root is the last form that following the forms
    leads to, the word itself if it has none. n_near is the number of near words. ``counts`` has each word once, made
    of the letters of ``LETTERS`` with A-Z lower-cased; null words and other columns are left out, and an empty table gives none.
    """
    vocabulary = cut(counts.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = F.min(F.when(F.col("other_n") >= times * F.col("n"), F.struct((-F.col("other_n")).alias("less"), "other")))
    near = cut(near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "spelling-near")
    links = near.where("best is not null").select("word", F.col("best.other").alias("form"))
    out = vocabulary.join(near, "word", "left").join(roots(links), "word", "left")
    return out.select("word", F.col("best.other").alias("form"), F.coalesce("root", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n"))
