"""Words of a text: A-Z lower-cased, parted by the ASCII white space characters 9 to 13 and 32."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def n_words(c: Column) -> Column:
    """Number of words; 0 for null. The marks left by the replacement are counted, not the words kept."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(c, WORD, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The same words in Python: ``bytes.lower`` and ``bytes.split`` know only ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to ``limit`` words of ordinary length."""

    LONGEST = 64

    def __init__(self, limit: int = 1_000_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (the constants are those of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
