"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import math
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from tokenizers import Tokenizer

from simplexspark.llm import warc
from simplexspark.llm.bpe import bpe_decode, bpe_encode
from simplexspark.llm.fingerprint import add_fingerprints, edited_pairs, fingerprint, from_hex, likeness, subtract_fingerprints, to_hex
from simplexspark.llm.html import ASK, DROP, KEEP, blocks_of, extract_text
from simplexspark.llm.lm import PRIOR, score_texts
from simplexspark.llm.mixing import copy_counts, mix_sources
from simplexspark.llm.neardup import drop_near_duplicates, fine_signatures, near_classes, near_in_tile, sketch
from simplexspark.llm.quality import grade_of, rate_quality, train
from simplexspark.llm.text import WordHashes
from simplexspark.llm.topk import exact_top_k
from simplexspark.llm.urls import filter_urls, pattern_rule, place_rule, word_rule
from simplexspark.llm.warc import read_warc, web_records, write_warc

FILE = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} of{i}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "one two", "The quick, brown fox\njumps over the lazy dog again and again today", LONG, "é ÀB <|endoftext|> x y ΑΣ"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC)


@pytest.fixture
def small(spark):
    return docs(spark, [(i, t, s) for i, (t, s) in enumerate(zip(TEXTS, ["a", None, "b", "a", "b", "a", "c"]))] + [(3, "one two", "a"), (None, "one two", None)])


def test_bpe_equals_library_and_round_trips(spark, small):
    library = Tokenizer.from_file(FILE)
    out = bpe_encode(small.withColumn("token_ids", F.lit("clash")), FILE, decoded_col="decoded").collect()
    assert len(out) == 9
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    back = bpe_decode(bpe_encode(small, FILE), FILE)
    assert all(r.decoded == library.decode(r.token_ids, skip_special_tokens=False) for r in back.collect())
    assert bpe_encode(small.limit(0), FILE).count() == 0


def test_mix_reaches_targets(spark):
    rows = [(i, " ".join("w" * (1 + i % 37)), "abc"[i % 3] if i % 7 else None) for i in range(1200)] + [(5000, None, "a"), (1, "w", "b")] * 3
    d = docs(spark, rows)
    sized = d.select("doc_id", "source", F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long").alias("size"))
    plan = copy_counts(sized, ["doc_id"])
    got = plan.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, copy_counts(sized.repartition(5), ["doc_id"]).collect()))
    taken, target, most = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 * r.n_rows
        most[r.source] = max(most[r.source], r["size"])
    assert math.isclose(sum(target.values()), sum(r["size"] * r.n_rows for r in got))
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    mixed = mix_sources(d)
    assert mixed.columns == d.columns and all(mixed.where(F.col("doc_id") == 5000).agg(F.count("*")).first()[0] <= 9 for _ in (0,))
    assert mix_sources(d.limit(0)).count() == 0


def test_mix_caps_targets(spark):
    d = spark.createDataFrame([(i, "tiny" if i < 2 else "big", 10) for i in range(200)], "doc_id long, source string, size long")
    target = {r.source: r.target for r in copy_counts(d, ["doc_id"], weights=(1, 50)).collect()}
    assert target["tiny"] == 60.0 and target["big"] == 1940.0  # big comes first and weighs 1, tiny stops at three times its size


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(150)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (None, [1.0] * 6), (7, vec := [9.0] * 6), (7, vec), (203, [1e17] * 6), (204, [1e17] * 6)]
    d = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    rows = sorted({(i, tuple(v)) for i, v in vectors if i is not None and v and None not in v and not any(map(math.isnan, v))})
    got = {}
    for r in exact_top_k(d.where("vec_id % 20 = 0 or vec_id = 203"), d, 5, "vec_id", "v").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, v in [(i, v) for i, v in rows if i % 20 == 0 or i == 203]:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)[:5]
        assert [(k + 1, i, min(-s, 2**63 - 1)) for k, (s, i) in enumerate(scores)] == sorted(got[q])
    assert exact_top_k(d.limit(0), d, 5, "vec_id", "v").count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_reader_skips_unwanted_blocks(spark, tmp_path, compression, monkeypatch):
    rows = [(i, f"http://h/{i % 3}", "<p>" + "ab" * (500 + i % 2) + str(i // 2)) for i in range(40)] + [(100, "http://h/0", "<p>" + "ab" * 500 + "0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    write_warc(web_records(pages, "page_id", "url", F.encode("html", "UTF-8"), "page"), path, compression)
    passed = []
    monkeypatch.setattr(warc, "pass_over", lambda source, n, packed, skip=warc.pass_over: (passed.append(n), skip(source, n, packed)))
    for wanted, payload in [(EqualTo(("record_type",), "revisit"), "true"), (In(("target_uri",), ("http://h/1", "http://h/2")), "true"),
                            (EqualTo(("record_type",), "response"), "false")]:
        reader, other = warc.WarcReader({"path": path, "payload": payload}), GreaterThan(("payload_length",), 3)
        assert list(reader.pushFilters([wanted, other])) == [other]
        passed.clear()
        got = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        fit = lambda r: r[wanted.attribute[0]] in (wanted.value if isinstance(wanted, In) else (wanted.value,))
        whole = [r.asDict() for r in read_warc(spark, path).collect()]
        assert sorted(r["record_id"] for r in got) == sorted(r["record_id"] for r in whole if fit(r)) and got
        # Blocks that no row needs are passed over, and only these.
        assert len(passed) == (len(whole) if payload == "false" else len(whole) - len(got))
        assert all((r["payload"] is None) == (payload == "false" or r["record_type"] == "revisit") for r in got)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    same = "<p>" + "x" * 200
    rows = [(3, "http://a/1", same), (1, "http://a/2", same), (2, None, same), (4, "http://b\r\n/", "short"), (5, "u", "short"), (6, "v", None), (None, "w", same), (7, "é", "ü" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    write_warc(web_records(pages, "page_id", "url", F.encode("html", "UTF-8"), "page"), path, compression)
    out = {r.record_id: r for r in read_warc(spark, path).collect()}
    assert len(out) == 8
    for i, url, text in rows:
        r, body = out[f"<urn:page:{'none' if i is None else i}>"], (text or "").encode()
        again = text == same and i != 1
        assert r.record_type == ("revisit" if again else "response") and r.payload_length == len(body)
        assert r.refers_to == ("<urn:page:1>" if again else None) and r.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
        assert (r.payload is None) if again else (bytes(r.payload) == body)
        assert r.target_uri == (url and url.replace("\r\n", "%0D%0A"))
    kept = read_warc(spark, path).where("record_type = 'revisit' and target_uri like 'http%'")
    assert sorted(r.target_uri for r in kept.collect()) == ["http://a/1"]
    # The source takes both filters: Spark's plan has none left. One on a column that is no header stays.
    left = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Filter " in x]
    assert not left(kept) and len(left(kept.where("payload_length > 3"))) == 1
    assert all(r.payload is None for r in read_warc(spark, path, payload=False).collect())
    assert web_records(pages.limit(0), "page_id", "url", F.encode("html", "UTF-8"), "page").count() == 0


def test_url_rules(spark):
    rules = [place_rule("com", "/", "allow"), place_rule("example.com", "/en/", "block"), place_rule("net", "/pre", "block"), word_rule("casino", "block"), pattern_rule(r"\d{6}", "block")]
    cases = {"http://www.Example.com/en/x": ("example.com/en/", "block"), "http://example.com/EN/": ("com/", "allow"), "http://notexample.com/en/": ("com/", "allow"),
             "http://com": (None, "allow"), "http://a.net/prefix": ("net/pre", "block"), "https://my-casino.org/": (None, "block"), "http://casinos.org": (None, "allow"),
             "http://x.org/123456": (None, "block"), "no scheme": (None, "allow"), "": (None, "allow"), None: (None, "allow"), "http://x.org?http://y.com/": (None, "allow")}
    d = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*cases, *cases])], "page_id long, url string, rule string")
    out = filter_urls(d, rules).collect()
    assert len(out) == 2 * len(cases) and all((r.rule, r.verdict) == cases[r.url] for r in out)
    assert {(r.host, r.path) for r in out if r.url == "http://x.org?http://y.com/"} == {("x.org", "")}
    assert filter_urls(d.limit(0), rules).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 4000, 60)] for _ in range(12)]
    rows = [(1000 + i, t, "a") for i, t in enumerate(TEXTS)] + [(None, " ".join(base[0]), "a"), (3, " ".join(base[1]), "a"), (3, " ".join(base[1]), "a")]
    for i in range(200):
        w = list(base[i % 12])
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            w[at] = "edit" + str(i)
        rows.append((10 + i, " ".join(w), "a"))
    got = near_classes(docs(spark, rows)).collect()
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    want = Counter()
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = d if not sets[i] else min(ids, default=None)
        want[(d, len(sets[i]), c, d == c)] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    left = drop_near_duplicates(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    groups = {find(i) for i in range(len(rows))}
    assert left.count() == len(groups)
    assert near_classes(docs(spark, rows).limit(0)).count() == 0


def test_low_bits_agree_by_chance_per_minimum():
    hashes = WordHashes()
    packed = np.array([sketch(f"one two three four w{i}", hashes)[2] for i in range(200)]).view(np.uint64)
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    fields = (packed[:, :, None] >> shifts & np.uint64(15)).reshape(200, -1)
    agree = (fields[:100] == fields[100:]).sum(axis=1)
    assert agree.max() < 30 and 6 < agree.mean() < 10  # 128 / 16


def test_small_sets_at_the_threshold_are_never_lost():
    n = 3000
    words = [[f"w{i}x{k}" for k in range(8)] for i in range(n)]

    def side(at, root, length):  # 4 and 3 shingles, 3 shared: exactly 75 %
        batch = pa.RecordBatch.from_arrays([pa.array(range(at, at + n)), pa.array([" ".join(w[:length]) for w in words]), pa.array([[5]] * n, pa.list_(pa.int64()))], names=["node", "text", "keys"])
        t = pa.Table.from_batches(fine_signatures(iter([batch])))
        for name, value in (("bucket", 5), ("root", root), ("inside", False)):
            t = t.append_column(name, pa.array([value] * n))
        return t
    got = near_in_tile(side(0, 1, 8), side(n, 2, 7))
    assert sorted(zip(got["a"].to_pylist(), got["b"].to_pylist())) == [(i, n + i) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_brute_force(spark, small, order):
    more = small.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, "a b c a b d a b c" if i % 2 else "b c a b c") for i in range(9)], "doc_id long, text string"))
    got = score_texts(more, order=order).collect()
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in more.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    grams = Counter()
    for i, t in rows:
        if not held(i):
            padded = [0] * (order - 1) + t
            grams.update(tuple(padded[k - n:k]) for k in range(order, len(padded) + 1) for n in range(1, order + 1))
            grams.update((0,) * n for n in range(1, order))
    words = {g: c for g, c in grams.items() if len(g) == 1 and g != (0,)}
    n, v = sum(words.values()), len(words)
    base = lambda w: (words.get((w,), 0) + 0.5) / (n + 0.5 * (v + 1))

    def p(context, w):
        return (grams[(*context, w)] + PRIOR * p(context[1:], w)) / (grams[context] + PRIOR) if context else base(w)
    want = []
    for i, t in rows:
        padded = [0] * (order - 1) + t
        score = sum(math.log10(p(tuple(padded[k:k + order - 1]), w)) for k, w in enumerate(t))
        want.append((i, held(i), len(t), sum((w,) in words for w in t), n, round(sum(math.log10(base(w)) for w in t), 5), round(score, 5)))
    order_of = lambda x: str(x)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got), key=order_of) == sorted(want, key=order_of)
    assert score_texts(small.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train(d, labels.where("doc_id % 4 <> 0"), grade_of(), 3)
    out = rate_quality(d.join(labels.where("doc_id % 4 = 0"), "doc_id"), model).collect()
    clean = [r.tail >= 0.5 for r in out if r.quality == 1 and r.toxic == 0]
    poor = [r.tail >= 0.5 for r in out if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(poor) <= 0.05 * len(poor)
    assert all(0 <= r.expected_grade <= 2 for r in out)


def test_quality_edge_cases(spark, small):
    model = train(small, spark.createDataFrame([], "doc_id long, quality int, toxic int"), grade_of(), 3)
    out = rate_quality(small.withColumn("tail", F.lit("clash")), model)
    assert out.count() == 9 and out.where("tail between 0 and 1").count() == 9 and rate_quality(small.limit(0), model).count() == 0


def test_main_text(spark):
    menu = "Subscribe to our great daily letter for more of this and that now"
    rows = [(1, "http://h/1", "<nav>Menu</nav><article><h1>T</h1><p>One &amp; two<br>three<div class='cookie-notice'>n</div><script>x='</p>'</script><p>four</article><footer>f"),
            (2, "http://h/2", f"<div>Only here stand words of page two</div><div>{menu}</div>"), (3, "http://h/3", f"<div>Other words are on page three, by chance</div><div>{menu}</div>"),
            (4, "http://q/", f"<div>{menu}</div>"), (5, None, None), (6, "x", ""), (7, "http://h/4", "<main>cut off <b>te"), (2, "http://h/2", f"<div>Only here stand words of page two</div><div>{menu}</div>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(d.withColumn("text", F.lit("clash"))).collect()}
    assert got == {1: "T\n\nOne & two three\n\nfour", 2: "Only here stand words of page two", 3: "Other words are on page three, by chance", 4: menu, 5: "", 6: "", 7: "cut off te"}
    assert extract_text(d.limit(0)).count() == 0


def test_main_text_beside_articles(spark):
    about = "All about our little house with its many old and new things"
    rows = [(i, f"http://h/{i}", f"<div>Lead {' '.join(f'l{i}x{k}' for k in range(12))}</div><article>{' '.join(f'a{i}x{k}' for k in range(20))}</article><div>{about}</div>") for i in range(3)]
    rows += [(3, "http://h/3", f"<main>{about}</main><div>{about}</div><p>{' '.join(f'b{k}' for k in range(30))}</p>")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Lead {' '.join(f'l{i}x{k}' for k in range(12))}\n\n{' '.join(f'a{i}x{k}' for k in range(20))}" for i in range(3)} | {3: f"{about}\n\n{' '.join(f'b{k}' for k in range(30))}"}


def test_main_text_of_copies_and_marked_wrappers(spark):
    words = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    menu = words("menu", 12)
    page = lambda text: f"<div>{menu}</div><div>{text}</div>"
    near = [words("n", 60).replace(f"n{i} ", f"edit{i} ") for i in (10, 30, 50)]
    quote = words("q", 10)
    rows = [("http://c/1", page(words("c", 40))), ("http://c/2", page(words("c", 40))),  # equal html under two urls
            *[(f"http://n/{i}", page(t)) for i, t in enumerate(near)], *[(f"http://n/o{i}", page(words(f"o{i}x", 40))) for i in range(6)],
            *[(f"http://s/{i}", f"<div>{words(f's{i}a', 15)} {quote} {words(f's{i}b', 15)}</div>") for i in range(2)],
            ("http://w/1", f"<div class='layout has-sidebar'><div class='sidebar'>side</div><article>{words('w', 9)}</article></div>"),
            ("http://w/2", f"<article class='post comments-open'>{words('v', 9)}<div class='share'>tell</div></article>")]
    got = {r.url: r.text for r in extract_text(spark.createDataFrame(rows, "url string, html string")).collect()}
    both = f"{menu}\n\n{words('c', 40)}"
    want = {"http://c/1": both, "http://c/2": both, **{f"http://n/{i}": t for i, t in enumerate(near)}, **{f"http://n/o{i}": words(f"o{i}x", 40) for i in range(6)},
            **{f"http://s/{i}": f"{words(f's{i}a', 15)} {quote} {words(f's{i}b', 15)}" for i in range(2)}, "http://w/1": words("w", 9), "http://w/2": words("v", 9)}
    assert got == want


def test_raw_elements_swallow_nothing():
    page = "<article><p>One</p>{}<p>Two</p></article>"
    for raw in ("<script>var a='<!--';</script>", "<script>if(a<b) x // don't</script>", "<style>p:before{content:'<!--'}</style>", "<SCRIPT>\"</SCRIPT >", "<textarea>'<p></textarea>"):
        assert [t for s, t in blocks_of(page.format(raw)) if s == KEEP] == ["One", "Two"]
    assert [t for s, t in blocks_of("<article>One<script>never closed <p>Two") if s == KEEP] == ["One"]


def test_deeply_nested_pages_take_linear_time():
    for opened in ("<div>", "<p><b>", "<b>", "<div><p>", "<ul><li>"):
        start = time.process_time()
        assert blocks_of(opened * (1_000_000 // len(opened)) + "text")[-1][1] == "text"
        assert time.process_time() - start < 20


def test_marks_settle_nothing_without_an_article():
    assert blocks_of("<p class='notice-board'>a</p><div class='related-work'><p>b</p></div><nav>c</nav>") == [(ASK, "a"), (ASK, "b"), (DROP, "c")]
    assert blocks_of("<p class='notice-board'>a<div>d</div><article>b<i class='ad'>x</i></article>") == [(DROP, "a"), (ASK, "d"), (KEEP, "b"), (DROP, "x")]


def test_fingerprints(spark, small):
    d = spark.createDataFrame([(1, "a b c\nd e f\ng"), (2, "g\na b c\nd e f"), (3, "a b c"), (4, "d e f\ng"), (5, None), (6, "")], "id long, text string")
    f = {r.id: r.fingerprint for r in fingerprint(d, ["id"]).collect()}
    assert f[1] == f[2] and f[1] != f[3] and f[5] == f[6]
    one = spark.createDataFrame([(f[1], f[3], f[4])], "w array<long>, a array<long>, b array<long>")
    assert one.select(add_fingerprints(F.col("a"), F.col("b")) == F.col("w"), subtract_fingerprints(F.col("w"), F.col("a")) == F.col("b"),
                      from_hex(to_hex(F.col("w"))) == F.col("w"), likeness(F.col("w"), F.col("w")) == 1.0).first() == (True,) * 4
    for buckets in (1, 3, 40):
        got = sorted(((r.key, r.n_chars, r.edited_sha256) for r in edited_pairs(small, "doc_id", "text", buckets).collect()), key=str)
        order = sorted(((r.doc_id, r.text or "") for r in small.collect()), key=lambda r: -1 if r[0] is None else r[0], reverse=True)
        want = [(i, len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][:len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
        assert got == sorted(want, key=str)
    assert edited_pairs(small.limit(0), "doc_id", "text", 4).count() == 0


def test_likeness_of_long_repetitive_texts(spark):
    d = spark.createDataFrame([(n, "na " * n) for n in (20_000, 32_768, 35_000, 40_000, 65_536, 70_000)], "id long, text string")
    f = fingerprint(d, ["id"])
    pairs = f.alias("a").join(f.alias("b"), F.col("a.id") == 2 * F.col("b.id")).select("a.id", likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("near"))
    got = {r.id: r.near for r in pairs.collect()}
    assert sorted(got) == [40_000, 65_536, 70_000] and min(got.values()) > 0.999
