"""Exact duplicates against brute force: ties, repeated rows, nulls, hot groups, colliding digests."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from simplexspark.llm.exactdedup import drop_exact_duplicates, exact_classes

LONG = " ".join(f"word{i}" for i in range(50_000))
ROWS = ([(i, "the hot\ntext") for i in range(400, 100, -1)] + [(7, "the  hot text "), (6, "the hot  text "), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "x"), (4, "x"),
        (None, "y z"), (5, "yz"), (None, "n"), (None, "n "), (8, LONG), (9, LONG + "\n"), (10, " x"), (11, "X"), (12, "a b"), (12, "ab")])


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    best = {c: min(g) for c, g in groups.items()}
    out = Counter()
    for i, t in rows:
        c = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        out[(i, best[c][3], len(groups[c]), i == best[c][3] and len(t or "") == -best[c][0])] += 1
    return out, len(groups)


@pytest.mark.parametrize("digest, hot_share", [(None, 5), (None, 1000), (lambda c: F.crc32(c.cast("binary")) % 3, 5), (lambda c: F.lit(1), 1)])
def test_equal_to_brute_force(spark, digest, hot_share):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("digest", F.lit("clash")).repartition(7)
    more = {"digest": digest} if digest else {}
    got = exact_classes(d, hot_share=hot_share, **more).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute(ROWS)[0]
    assert exact_classes(d.limit(0), **more).count() == 0


def test_one_row_of_each_group_stays(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, best string")
    left = drop_exact_duplicates(d)
    want, groups = brute(ROWS)
    assert left.columns == d.columns and left.count() == groups
    assert {r.doc_id for r in left.collect()} == {i for i, _, _, kept in want if kept}
    assert drop_exact_duplicates(d.limit(0)).count() == 0
