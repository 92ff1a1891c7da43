"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

A state is a context: the last words read, up to ``order`` less one, that training has seen together, or none (the root).
An arc is there for every n-gram seen in training, with weight log10((c(hw) + A * p(w|h')) / (c(h) + A)), h' being h without its
first word; every state h has a failure arc of weight log10(A / (c(h) + A)) to the state of h'. The root's arcs hold
p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), with one share for all words that training has not seen. These are
probabilities: over all words they sum to 1 in every state. A text begins in the state of its start; one pass from left
to right carries the state, follows an arc or as many failure arcs as it takes to find one, and adds the weights.

The counts cover all training texts and are as large as the corpus makes them, so no task holds the model. Texts are dealt
to blocks of about ``BLOCK_BYTES``. A block sends each of its distinct n-grams once, as sorted 64-bit hashes packed by
hash range, with its own training counts; a range adds up what the blocks sent and answers each with the totals in the
order of the question. With these the block builds the part of the automaton that its texts can reach. A word, or an
n-gram, that is in every text is one entry per block, so none is hot.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexspark.llm.text import WordHashes, mix64, words_of
from simplexspark.sources.stages import cut

BLOCK_BYTES = 8 << 20
ORDER = 2
RANGE_KEYS = 1 << 20
END, START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
PRIOR = 32.0
QUESTION = "bucket int, block int, kind int, held binary, counts binary"
ANSWER = "block int, bucket int, kind int, counts binary"


def tokens(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words and of the end."""
    return np.append(hashes.of(words_of(text)), END)


def ngrams(t: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n from 1 to ``order``. The start stands before the first token as often
    as needed. The lowest bit is left free."""
    keys, before = [t & ~np.uint64(1)], t
    for n in range(1, order):
        shifted = np.concatenate([np.full(min(n, len(t)), START), t[:-n]])
        before = mix64(shifted * np.uint64(0x9E3779B97F4A7C15) + before)
        keys.append(before & ~np.uint64(1))
    return keys


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how many of each have the lowest bit set, which marks those learned from."""
    keys.sort()
    held = keys & ~np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return held[first], np.add.reduceat((keys & np.uint64(1)).astype(np.int64), first)


def planes(values: np.ndarray) -> bytes:
    """Byte planes of numbers: like bytes stand together, so the shuffle's compression finds the small ones."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel() if data else np.empty(0, kind)


def pack(counts: np.ndarray) -> bytes:
    """Counts are mostly tiny: deflated planes of 64-bit numbers."""
    return zlib.compress(planes(counts.astype(np.int64)), 1)


def unpack(data: bytes) -> np.ndarray:
    return from_planes(zlib.decompress(data), "<i8")


def train_share(ids: str) -> Column:
    """True for the documents that are learned from: crc32 of the id as text, modulo 5, is not 1. A null id counts as the
    empty text."""
    return F.crc32(F.coalesce(F.col(ids).cast("string"), F.lit("")).cast("binary")) % 5 != 1


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and blank texts are the end token alone. Repeated rows are documents of their own and count as often as they
    occur. Without training texts every word has the share of unseen ones. Other columns are not read; an empty table
    gives none. ``prior`` is A above, the weight of the shorter context in counts; ``order`` is the length of the longest n-gram.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    ranges = max(1, math.ceil(size / 6 / RANGE_KEYS))  # a word is about six bytes
    shift = 64 - max(1, (ranges - 1).bit_length())
    dealt = docs.withColumn("train", train_share("doc_id")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        seen: list[list[np.ndarray]] = [[] for _ in range(order)]
        for text, train in zip(table["text"], table["train"]):
            learned = np.uint64(train.as_py())
            for kind, keys in enumerate(ngrams(tokens(text.as_py(), hashes), order)):
                seen[kind].append(keys | learned)
        rows, block = [], table["block"][0].as_py()
        for kind in range(order):
            keys, counts = counted(np.concatenate(seen[kind]))
            seen[kind] = []
            for bucket, part in split(keys, shift):
                rows.append((bucket, block, kind, planes(np.diff(keys[part], prepend=np.uint64(0))), pack(counts[part])))
        return pa.table(dict(zip(("bucket", "block", "kind", "held", "counts"), zip(*rows))), schema=pa.schema(
            [("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("held", pa.binary()), ("counts", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        held = [np.cumsum(from_planes(x.as_py(), "<u8"), dtype=np.uint64) for x in table["held"]]
        counts = [unpack(x.as_py()) for x in table["counts"]]
        keys, place = np.unique(np.concatenate(held), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate(counts))
        ends = np.cumsum([0, *map(len, held)])
        packed = [pack(total[place[a:b]]) for a, b in zip(ends, ends[1:])]
        # One row more, for no block: how many keys are known, and how often they occur.
        return pa.table({"block": pa.array([*table["block"].to_pylist(), -1], pa.int32()), "bucket": pa.array([*table["bucket"].to_pylist(), table["bucket"][0].as_py()], pa.int32()),
                         "kind": pa.array([*table["kind"].to_pylist(), table["kind"][0].as_py()], pa.int32()),
                         "counts": pa.array([*packed, pack(np.array([np.count_nonzero(total), total.sum()]))], pa.binary())})

    asked = dealt.groupBy("block").applyInArrow(ask, QUESTION)
    answers = cut(asked.groupBy("bucket", "kind").applyInArrow(answer, ANSWER), "lm-answers")
    sums = answers.where("block = -1 and kind = 0").mapInArrow(vocabulary, "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, total = int(sums[0]), int(sums[1])
    starts = int(docs.where(train_share("doc_id")).count())

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({n: pa.array([], t) for n, t in OUT.items()})
        hashes = WordHashes()
        each = [tokens(t.as_py(), hashes) for t in texts["text"]]
        ids, trains = texts["doc_id"].to_pylist(), texts["train"].to_pylist()
        del texts
        places, counts = [], []
        ends = np.cumsum([0, *map(len, each)])
        grams = [ngrams(t, order) for t in each]
        del each
        for kind in range(order):
            keys = np.concatenate([g[kind] for g in grams])
            held = counted(keys.copy())[0]
            mine = sorted((b, c.as_py()) for k, b, c in zip(found["kind"].to_pylist(), found["bucket"].to_pylist(), found["counts"]) if k == kind)
            counts.append(np.concatenate([unpack(c) for _, c in mine]) if mine else np.empty(0, np.int64))
            if len(held) != len(counts[kind]):
                raise ValueError("a block was answered for other texts than it asked about")
            places.append(np.searchsorted(held, keys))
            for g in grams:
                g[kind] = None
        root = np.log10((counts[0] + 0.5) / (total + 0.5 * (distinct + 1)))
        model = automaton(counts, places, ends, root, starts, prior)
        known = counts[0] > 0
        rows = []
        for doc, train, a, b in zip(ids, trains, ends.tolist(), ends[1:].tolist()):
            words = places[0][a:b]
            rows.append((doc, not train, b - a, int(known[words].sum()), total, math.fsum(root[words]), traverse([p[a:b] for p in places], model)))
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(OUT.items(), zip(*rows))})

    answered = answers.where("block >= 0")
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


OUT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def split(keys: np.ndarray, shift: int) -> list[tuple[int, slice]]:
    """Slices of ascending keys by their leading bits."""
    lead = (keys >> np.uint64(shift)).astype(np.int64)
    at = np.flatnonzero(np.diff(lead, prepend=-1))
    return [(int(lead[a]), slice(a, b)) for a, b in zip(at, [*at[1:], len(keys)])]


def vocabulary(batches):
    for batch in batches:
        rows = [unpack(x.as_py()) for x in batch.column(batch.schema.get_field_index("counts"))]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([int(r[1]) for r in rows], pa.int64())], names=["v", "n"])


@dataclass
class Automaton:
    """Arrays by n, of the n-grams of a block: the weight of the arc of each (NaN if training has not seen it), and the failure
    weight of the state that it leads to, by which contexts are left."""
    arcs: list[np.ndarray]
    fails: list[np.ndarray]
    start: float


def automaton(counts: list[np.ndarray], places: list[np.ndarray], ends: np.ndarray, root: np.ndarray, starts: int, prior: float) -> Automaton:
    """The automaton from the counts of the n-grams and their places in the texts. The start is a context of every length."""
    arcs, probability = [root], 10.0 ** root
    for n in range(1, len(counts)):
        # Context count and shorter probability of each n-gram, from any place where it stands.
        context, shorter = np.empty(len(counts[n]), np.int64), np.empty(len(counts[n]))
        before = np.concatenate([[0], counts[n - 1][places[n - 1]][:-1]])
        before[ends[:-1]] = starts
        context[places[n]] = before
        shorter[places[n]] = probability[places[n - 1]]
        held = shorter * prior / (context + prior) + counts[n] / (context + prior)
        arcs.append(np.where(counts[n] > 0, np.log10(held), np.nan))
        probability = held
    fails = [np.log10(prior / (c + prior)) for c in counts[:-1]]
    return Automaton(arcs, fails, float(np.log10(prior / (starts + prior))))


def traverse(places: list[np.ndarray], model: Automaton, step: int = 1 << 16) -> float:
    """Left to right from the start: failure arcs until a state has an arc for the word. A context that training has not seen is
    no state; its failure weight is 0 and no arc leaves it."""
    top, total = len(places) - 1, []
    state = (model.start,) * top  # failure weights of the contexts of one word, two words, ...
    for at in range(0, len(places[0]), step):
        grams = [p[at:at + step] for p in places]
        weights = zip(*[a[g].tolist() for a, g in zip(model.arcs, grams)])
        left = zip(*[f[g].tolist() for f, g in zip(model.fails, grams)]) if top else iter(lambda: (), None)
        added = []
        for arcs, following in zip(weights, left):
            n = top
            while arcs[n] != arcs[n]:
                n -= 1
                added.append(state[n])
            added.append(arcs[n])
            state = following
        total.append(math.fsum(added))
    return math.fsum(total)
