"""The corpus pipeline, stage by stage and whole, against plain Python over a small folder of tables with planted rows."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from simplexspark.llm.quality import Features, grade_of, train
from simplexspark.llm.queries import KEEP_TAIL

DOC = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FIRST = 10_000_000


def planted(rows):
    """Copies, near copies, short, empty, null and repeated rows beside the given ones."""
    long = [r for r in rows if r[1] and len(r[1].split()) > 60][:12]
    out, i = [], FIRST
    for r in long:
        words = r[1].split()
        for text in (r[1], " ".join([*words, "tail"]), " ".join(["X", *words[1:]]).upper(), " ".join(words[: len(words) // 2])):
            out.append((i, text, r[2], r[3], len(text)))
            i += 1
    out += [(i, None, None, None, None), (i + 1, "", "en", "web", 0), (i + 2, " \n\t", "en", None, 3), (i + 3, "one two", "en", "web", 7),
            (i + 4, "one two", None, "books", 7), (i + 5, "same row", "en", "web", 8), (i + 5, "same row", "en", "web", 8)]
    return out


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(COLUMNS).collect()]
    spark.createDataFrame(rows + planted(rows), DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage takes and returns."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{name}.parquet")
        taken, docs = docs, spark.read.parquet(f"{folder}/{name}.parquet")
        out[name] = taken, docs
    return out


def rows_of(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_stages_keep_the_columns_of_documents(stages):
    for name, (taken, made) in list(stages.items())[:-1]:
        assert made.columns == COLUMNS, name
        assert made.count() > 0


def test_quality_stage_decides_every_row(spark, stages, folder):
    taken, made = stages["quality"]
    model, features = train(taken, spark.read.parquet(f"{folder}/labels.parquet"), grade_of(), 3), Features()

    def tail(text):
        return 1 / (1 + np.exp(model.thresholds[-1] - model.weights.astype(float)[features.of(text)].sum()))

    want = Counter(r for r in rows_of(taken) if tail(r[1]) >= KEEP_TAIL)
    assert Counter(rows_of(made)) == want and 0 < sum(want.values()) < taken.count()


def test_near_duplicate_stage_equals_all_pairs(stages):
    taken, made = stages["near_duplicates"]
    rows = rows_of(taken)
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {r[0] for r in rows_of(made)} == {i for i in sets if find(i) == i}
    assert len(sets) > made.count()


def test_mix_stage_takes_words_near_the_targets_and_changes_no_row(stages):
    taken, made = stages["mix"]
    rows, copies = rows_of(taken), Counter(rows_of(made))
    assert set(copies) <= set(rows)
    size, total, got = {}, defaultdict(int), defaultdict(int)
    for r in rows:
        size[r] = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        total[r[3]] += size[r]
    for r, n in copies.items():
        assert n <= 3 * max(1, rows.count(r))
        got[r[3]] += n * size[r]
    order = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight, left = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(total.values())
    target, open_ = {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        for s in full or open_:
            target[s] = 3.0 * total[s] if full else share[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    most = max(size.values())
    for s in order:
        assert abs(got[s] - target[s]) <= 2 * most, s


def test_encode_stage_equals_the_library(stages):
    taken, made = stages["encode"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    want = Counter()
    for r in rows_of(taken):
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], r[2], r[3], len(ids), tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["token_ids"]), r["decoded"]) for r in made.collect())
    assert got == want


def test_run_chains_the_stages(spark, stages, folder):
    digest = [F.count(F.lit(1)), F.sum("n_tokens"), F.sum(F.xxhash64("doc_id", "token_ids").cast("decimal(20)"))]
    assert pipeline.run(spark, folder).agg(*digest).first() == stages["encode"][1].agg(*digest).first()


def test_stages_take_empty_tables_and_clashing_columns(spark, stages, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(5)
    extra = docs.withColumns({"tail": F.lit("x"), "doc": F.lit(1), "expected_grade": F.lit(2), "grade": F.lit(3), "size": F.lit(4), "id": F.lit(5)})
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        made = stage(spark, extra, folder)
        assert made.columns == extra.columns and {r["tail"] for r in made.collect()} <= {"x"}, name
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
