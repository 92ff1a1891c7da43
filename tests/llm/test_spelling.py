"""Spelling variants against brute force: counts, planted typos, neighbours, ties, chains, very long words, filters that are full."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexspark.llm import spelling
from simplexspark.llm.queries import typos
from simplexspark.llm.spelling import ALPHABET, near_words, spelling_forms, word_counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, times=5):
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        form = min(around, key=lambda v: (-counts[v], v), default=None)
        out[w] = (form if form and counts[form] >= times * n else None, len(around))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, counts[w], k, form and counts[form]))
    return rows


def test_counts_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    stems = ["Straße×", "naïveté", "ÀÉÎõü÷", "banana", "bananas", "short", "Kitten", "sitting"]
    rows = [(i if i % 9 else None, "-".join(rng.choice(stems, 40))) for i in range(300)] + [(1, None), (2, ""), (3, "12 ab. abcdef\x00ghijkl"), (3, "abcdef")] * 5
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("word", F.lit("clash")).repartition(3)
    got = word_counts(d, change=typos).collect()
    assert {(r.word, r.n) for r in got} == {(w, n) for w, n in want.items() if len(w) >= 6 and n >= 5} and any(len(r.word) != len(r.word.strip("s")) for r in got)
    assert word_counts(d.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [16, 1])
def test_forms_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(spelling, "BITS", bits)  # with 1 the filters are full, and the join removes what they let through
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("abß÷"), rng.integers(6, 9))): int(rng.integers(5, 4000)) for _ in range(500)}
    words |= {"chain" + "x" * i: 5 * 6**i for i in range(6)} | {"tieaaa": 5, "tiebaa": 25, "tiecaa": 25, "justab": 5, "justac": 24}
    words |= {"y" * 20_000: 5, "y" * 19_999 + "z": 7, "y" * 19_999: 26}
    d = spark.createDataFrame(list(words.items()), "word string, n int").withColumn("form", F.lit("clash"))
    got = spelling_forms(d).collect()
    assert {tuple(r) for r in got} == brute(words) and len(got) == len(words)
    assert spelling_forms(d.limit(0)).count() == 0


def test_every_edit_is_probed(spark):
    letters = "".join(chr(int(c)) for c in ALPHABET)
    words = ["middle", *("mid" + c + "le" for c in letters if c != "d"), *("mid" + c + "dle" for c in letters if c != "d"), "iddle", "mddle"]
    got = near_words(spark.createDataFrame([(w, 5) for w in words] + [(None, 7)], "word string, n long").where("word is not null"))
    assert got.where("word = 'middle'").count() == len(words) - 1
