"""The registered query of each operator, over its whole table, and its SQL twin where SQL can express it."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexspark.llm.bpe import bpe_encode
from simplexspark.llm.conversation import NUMBERS, repair_conversations
from simplexspark.llm.exactdedup import exact_classes
from simplexspark.llm.fingerprint import edited_pairs, likeness, to_hex
from simplexspark.llm.html import extract_text
from simplexspark.llm.lm import score_texts
from simplexspark.llm.mixing import copy_counts
from simplexspark.llm.neardup import near_classes
from simplexspark.llm.quality import grade_of, rate_quality, train
from simplexspark.llm.spelling import spelling_forms, word_counts
from simplexspark.llm.text import n_words, table
from simplexspark.llm.topk import exact_top_k
from simplexspark.llm.urls import JUNK_WORDS, filter_urls, place_rule, word_rule
from simplexspark.llm.warc import read_warc, web_records, write_warc
from simplexspark.sources.stages import scratch_root


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded")
    return coded.select("doc_id", "token_ids", "decoded").mapInArrow(token_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(1), batch.column(2)
        lengths = [len(v) for v in ids]
        digests = [hashlib.sha256(v.values.to_numpy().astype("<u4").tobytes()).hexdigest() for v in ids]
        decoded = [hashlib.sha256(v.as_buffer() or b"").hexdigest() for v in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(digests), pa.array(decoded)],
                                         names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op2_mix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    plan = copy_counts(rows, ["doc_id"])
    # Equal rows share their copies: the first ones get one more where the division leaves a rest.
    each = plan.withColumn("i", F.explode(F.expr("sequence(1L, n_rows)")))
    count = F.expr("copies div n_rows") + (F.col("i") <= F.col("copies") % F.col("n_rows")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (count * F.col("size")).alias("taken"), "source", count.alias("copies"))


def op3_topk(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**47, F.floor(x.cast("double") * 64).cast("double")).otherwise(x.cast("double") * 64))
    rows = table(spark, sf, "embeddings").select("vec_id", whole.alias("v"))
    return exact_top_k(rows.where("vec_id % 20 = 0"), rows, 20, "vec_id", "v")


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    write_warc(web_records(pages, "page_id", "url", F.encode("html", "UTF-8"), "page"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    # A revisit carries digest and length of the payload that it leaves out; a response is measured as it was read.
    again = F.col("record_type") == "revisit"
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"), F.when(again, F.col("payload_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.substring_index("payload_digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to FROM f
"""

#: The rules of the query.
PLACES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op5_urls(spark: SparkSession, sf: str) -> DataFrame:
    rules = [place_rule(*r) for r in PLACES] + [word_rule(w, "block") for w in JUNK_WORDS]
    pages = table(spark, sf, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({"|".join(JUNK_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op6_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return near_classes(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id
  JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*)))
"""
OP6_SQL = OP6_SQL.replace("WITH w", "WITH RECURSIVE w") + """, r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def op7_lm(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents").select("doc_id", "text"))


KEEP_TAIL = 0.5


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"), grade_of(), 3)
    return rate_quality(docs, model).select("doc_id", "expected_grade", "tail", (F.col("tail") >= KEEP_TAIL).alias("kept"))


def op9_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = extract_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = edited_pairs(docs, "doc_id", "text", buckets)
    like = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return pairs.select(F.col("key").alias("doc_id"), "n_chars", "edited_sha256", to_hex(F.col("fingerprint")).alias("fingerprint"),
                        to_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"), like("edited_fingerprint").alias("near_edited"),
                        like("next_fingerprint").alias("near_next"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The fixed damage of the query, by a hash of the turn's place. Nulls are one space first."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("h")
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), h).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(twice).alias("time")).drop("time")


def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    left = F.filter("turns", lambda t: t["edit"] != "D")
    said = F.array_join(F.transform(left, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pieces = repair_conversations(damaged(given)).select("conv_id", "piece", F.size(left).alias("left"), said.alias("said"), *NUMBERS, "audit")
    # One sha256 is one sequence of bytes: the pieces of a conversation, some hundred turns each, are read in order as a stream.
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    hashed = ordered.mapInArrow(digests_in_order, f"found long, {', '.join(f'{n} long' for n in NUMBERS)}, audit string, repaired_sha256 string")
    out = given.select("conv_id").distinct().join(hashed, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    return out.select("conv_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def digests_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["found", *NUMBERS, "audit", "repaired_sha256"]
    head, digest, left = None, None, 0
    for batch in batches:
        out = []
        for conv, piece, count, said, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if piece == 0:
                if head:
                    out.append([*head, digest.hexdigest()])
                head, digest, left = [conv, *rest], hashlib.sha256(), 0
            if count:
                digest.update((("\n" if left else "") + said).encode("utf-8", "surrogatepass"))
            left += count
        columns = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in names[-2:] else pa.int64()) for n, c in zip(names, columns)], names=names)
    if head:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if n in names[-2:] else pa.int64()) for n, v in zip(names, [*head, digest.hexdigest()])], names=names)


#: Fixed value of the query: one in so many runs of a text loses a code point.
TYPO_EVERY = 199


def typos(doc: int | None, runs: Counter) -> dict[str, str]:
    """The runs of a text that lose a code point, and what is left of them."""
    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    hit = {run: h for run in runs if not (h := zlib.crc32(run.encode(), head)) % TYPO_EVERY}
    return {run: run[:h % len(run)] + run[h % len(run) + 1:] for run, h in hit.items()}


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_forms(word_counts(table(spark, sf, "documents"), change=typos))


#: crc32 of a text in SQL: the table of its polynomial, then a step a byte.
CRC_SQL = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"""
CRC_OF = """xor(4294967295, list_reduce(list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substring(hex(encode({0})), 2 * i - 1, 2))::BIGINT),
  lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]), 4294967295))"""

OP12_SQL = rf"""
WITH RECURSIVE {CRC_SQL}, r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k, doc_id::VARCHAR || ':' || run AS s FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, k, {CRC_OF.format('s')} AS h FROM c, crc_table),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
e AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM e a JOIN e b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM e a JOIN v ON a.less = v.word UNION SELECT v.word, a.word, a.n FROM e a JOIN v ON a.less = v.word),
g AS (SELECT v.word, v.n, count(p.other) AS n_near, min(CASE WHEN m >= 5 * n THEN {{'less': -m, 'other': encode(other)}} END) AS best FROM v LEFT JOIN p ON v.word = p.word GROUP BY v.word, v.n),
f AS (SELECT word, n, n_near, decode(best.other) AS form, -best.less AS form_n FROM g),
roots AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT q.word, f.form, depth + 1 FROM roots q JOIN f ON f.word = q.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, depth) AS root, n, n_near, form_n FROM f JOIN roots ON roots.word = f.word GROUP BY f.word, form, n, n_near, form_n
"""


def op13_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    classes = exact_classes(table(spark, sf, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents),
k AS (SELECT doc_id, c, first_value(doc_id) OVER (PARTITION BY c ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY c) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(c) AS text_sha256 FROM k
"""

QUERIES = {
    "op1_bpe": (op1_bpe, None),
    "op2_mix": (op2_mix, None),
    "op3_topk": (op3_topk, OP3_SQL),
    "op4_warc": (op4_warc, OP4_SQL),
    "op5_urls": (op5_urls, OP5_SQL),
    "op6_neardup": (op6_neardup, OP6_SQL),
    "op7_lm": (op7_lm, None),
    "op8_quality": (op8_quality, None),
    "op9_html": (op9_html, None),
    "op10_fingerprint": (op10_fingerprint, None),
    "op11_conversations": (op11_conversations, None),
    "op12_spelling": (op12_spelling, OP12_SQL),
    "op13_exact_dedup": (op13_exact_dedup, OP13_SQL),
}
