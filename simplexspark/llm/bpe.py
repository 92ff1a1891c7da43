"""Byte-pair encoding and decoding of whole texts.

A word is a doubly linked list of symbols. A heap holds the ranks of adjacent pairs; the lowest rank is merged first, and
entries whose symbols have changed since they were pushed are stale and skipped. Decoding joins vocabulary strings.

The tokenizer file is read once on the driver and broadcast: vocabulary and merges are a fixed few MB whatever the corpus.
Words that were met before come from a per-worker cache that starts anew at ``CACHE_WORDS`` entries, so memory is bounded.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 1_000_000
SPACE = r"[\t-\r \x85\xa0  -     　]+"  # white space as the tokenizer files mean it


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Bpe:
    """The model of one tokenizer file: NFC, white space folded, lower case, words split by the file's own pattern."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.pattern = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE[1:-2]}\p{{L}}\p{{N}}]"))
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.letters = byte_letters()
        self.cache: dict[str, list[int]] = {}

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word, by merges in order of rank over a linked list."""
        vocab, merges, letters = self.vocab, self.merges, self.letters
        text = [letters[b] for b in word.encode("utf-8")]
        text[-1] += self.suffix
        ids = [vocab[s] for s in text]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # an entry is rank * n + place of the pair's left symbol: the lowest rank first, then the leftmost
        heap = [found[0] * n + i for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, left = divmod(heapq.heappop(heap), n)
            right = after[left]
            if right < 0 or ids[left] < 0:
                continue
            found = merges.get((ids[left], ids[right]))
            if found is None or found[0] != rank:
                continue  # stale: one of the two symbols was merged meanwhile
            ids[left], ids[right] = found[1], -1
            far = after[left] = after[right]
            if far >= 0:
                before[far] = left
                if found := merges.get((ids[left], ids[far])):
                    heapq.heappush(heap, found[0] * n + left)
            near = before[left]
            if near >= 0 and (found := merges.get((ids[near], ids[left]))):
                heapq.heappush(heap, found[0] * n + near)
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Folding white space changes nothing here, since the pattern drops it. Lower case is taken character by
        # character, so a final sigma is an ordinary one.
        return self.pattern.findall(text.replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null is the empty text. Strings of special tokens give their ids."""
        out: list[int] = []
        cache = self.cache
        for part in self.split.split(text or "") if self.split else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word in self.words(part):
                ids = cache.get(word)
                if ids is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    ids = cache[word] = self.encode_word(word)
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, one space between two: the file names no decoder, so nothing else is undone."""
        return " ".join([self.strings[i] for i in ids])


_models: dict[int, Bpe] = {}


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids",
               decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>) and, if named, the decoded text.

    Null texts are empty and give no ids; repeated rows are encoded alike; other columns pass through, and a column that
    has the name of a new one is replaced. Rows leave in batches of bounded size, so long texts do not pile up.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    new = [c for c in (ids_col, decoded_col) if c]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new or c == text_col])
    source = kept.columns
    fields = [f for f in kept.schema.fields if f.name not in new]
    schema = kept.select(*[F.col(f"`{f.name}`") for f in fields], F.lit(None).cast("array<int>").alias(ids_col),
                         *([F.lit(None).cast("string").alias(decoded_col)] if decoded_col else [])).schema
    key = spec.id if hasattr(spec, "id") else id(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = Bpe(spec.value)
        model = _models[key]
        for batch in batches:
            table = batch.rename_columns(source)
            for part in slices(table, source.index(text_col)):
                ids = [model.encode(t.as_py()) for t in part.column(source.index(text_col))]
                columns = [part.column(source.index(f.name)) for f in fields]
                names = [f.name for f in fields] + new
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                if decoded_col:
                    columns.append(pa.array([model.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text_at: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, at least one row each."""
    start, size = 0, 0
    lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text_at)]
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def bpe_decode(df: DataFrame, tokenizer: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col``: null for null, empty for no ids. Unknown ids raise."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    fields = [f for f in df.schema.fields if f.name != text_col]
    kept = df.select(*[F.col(f"`{f.name}`") for f in fields])
    schema = kept.select("*", F.lit(None).cast("string").alias(text_col)).schema
    names = [*[f.name for f in fields], text_col]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Bpe(spec.value).strings
        for batch in batches:
            texts = [None if v is None else " ".join(strings[i] for i in v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return kept.mapInArrow(run, schema)
