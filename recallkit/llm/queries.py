"""The queries of the ten operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallkit.session import materialize

from . import bpe, exactsearch, linededup, lmscore, nearjoin, packing, qualityclassifier, qualityrules, sharding, toxicity

BYTE_RANKS, WORD_FILE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a bounded number of bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, path, pattern).drop("text"), path, pattern)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    narrow = materialize(docs.select("doc_id", "lang", "source", "n_chars", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")))
    out = sharding.shards(narrow, ["lang", "source", "n_chars"], 8, law="rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path(WORD_FILE))
    narrow = materialize(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rounded = {c: F.round(c, 6) for c in ("char_distance", "word_distance")}
    return qualityrules.judge(docs).withColumns(rounded).drop("lang")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return nearjoin.near_classes(table(spark, sf_dir, "documents")).drop("text_hash", "first")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    model = qualityclassifier.train(docs, table(spark, sf_dir, "labels"))
    return qualityclassifier.judge(docs, model, ["doc_id", "source", "lang"])


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lmscore.pseudo_likelihood(docs).drop("text")


def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", whole.alias("vector"))
    pivots = materialize(exactsearch.pivot_table(vectors))
    return exactsearch.top_k(pivots, pivots.where("vec_id % 50 = 0"), 5)


def op10_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.spans(docs, model)
    places = F.transform("offending", lambda s: F.struct(s["start"], s["length"], F.round(s["score"], 6).alias("score")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), places.alias("offending"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_vector_packing": op4_vector_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pseudo_likelihood": op7_pseudo_likelihood,
    "op8_quality_rules": op8_quality_rules,
    "op9_pivot_search": op9_pivot_search,
    "op10_noisy_or_toxicity": op10_noisy_or_toxicity,
}

BLANK = r"\x20\x09-\x0D"
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"list_filter(regexp_split_to_array({{0}}, '[{BLANK}]+'), lambda x: x <> '')"

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format("lower(coalesce(text, ''))")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r),
cl AS (SELECT id, min(r) AS class_id FROM reach GROUP BY 1),
cp AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(l.b), d.doc_id)) AS copy_id, 1 + count(l.b) AS copies FROM documents d LEFT JOIN l ON l.a = d.doc_id AND l.same GROUP BY 1),
ln AS (SELECT l.a, count(*) AS n_links, count(DISTINCT cp.copy_id) FILTER (NOT same) AS n_texts FROM l JOIN cp ON cp.doc_id = l.b GROUP BY 1)
SELECT cp.doc_id, class_id, copy_id, copies, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts FROM cp JOIN cl ON cl.id = cp.doc_id LEFT JOIN ln ON ln.a = cp.doc_id"""

_LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {ASCII_LOWER.format(f"trim(line, {STRIP})")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT doc_id, pos, line, h.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY 1"""

_SEARCH = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id)::INT AS rank, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 QUALIFY rank <= 5"""


def _rules_sql() -> str:
    listed = sorted({w for ws in qualityrules.COMMON.values() for w in ws})
    any_of = ", ".join(f"'{w}'" for w in listed)
    word = lambda w: f"len(list_filter(kn, lambda x: x = '{w}'))"
    per = " ".join(f"WHEN '{c}' THEN [{', '.join(map(word, ws))}]" for c, ws in qualityrules.COMMON.items())
    langs = ", ".join(f"'{c}'" for c in qualityrules.COMMON)
    kinds = ("a-z", "A-Z", "0-9", BLANK, ".,;:!?''\"()-", "#*$%&|<>", "/=@\\[\\\\\\]^_`{}~+\\x00-\\x08\\x0E-\\x1F\\x7F")
    chars = ", ".join(f"length(t) - length(regexp_replace(t, '[{k}]', '', 'g'))" for k in kinds)
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    jsd = lambda p, q, n: f"sqrt(greatest(0, list_sum(list_transform(range(1, {n} + 1), lambda i: {part.format(f'{p}[i]', f'{q}[i]')} + {part.format(f'{q}[i]', f'{p}[i]')})) / 2))"
    mean = lambda c, n: "[" + ", ".join(f"avg({c}[{k}])" for k in range(1, n + 1)) + "]"
    return f"""WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT *, list_filter(list_transform(list_filter(w, lambda x: length(x) <= 4), lambda x: lower(x)), lambda x: x IN ({any_of})) AS kn, list_filter(string_split(t, chr(10)), lambda x: trim(x, {STRIP}) <> '') AS ls,
  [{chars}] AS ca FROM a),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
g2 AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rp AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g2) GROUP BY 1),
m AS (SELECT doc_id, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS l, len(w) AS n_words, length(t) - ca[4] AS word_chars, ca[6] AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  list_append(ca, length(t) - list_sum(ca)::BIGINT) AS ch, length(t) AS nc, len(kn) AS k, CASE lang {per} ELSE [len(kn)] END AS cw FROM b LEFT JOIN rp USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN nc >= 200 THEN list_transform(ch, lambda x: x / nc) END AS p,
  CASE WHEN n_words >= 50 THEN list_transform(list_append(cw, n_words - list_sum(cw)::BIGINT), lambda x: x / n_words) END AS q FROM m),
g0 AS (SELECT *, CASE WHEN n_words >= 50 THEN k / n_words END AS a FROM f WHERE NOT base_failed AND l <> ''),
r AS (SELECT l, {mean('p', 8)} AS pr, {mean('q', 11)} AS qr FROM g0 GROUP BY 1 UNION ALL SELECT '', {mean('p', 8)}, [avg(a), avg(1 - a)] FROM g0),
x AS (SELECT f.*, CASE WHEN p IS NOT NULL AND pr[1] IS NOT NULL THEN {jsd('p', 'pr', 8)} END AS cd, CASE WHEN q IS NOT NULL AND qr[1] IS NOT NULL THEN {jsd('q', 'qr', 'len(q)')} END AS wd FROM f LEFT JOIN r USING (l))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance, NOT base_failed AND coalesce(cd, 0) <= 0.28 AND coalesce(wd, 0) <= 0.30 AS kept FROM x"""


ORACLE: dict[str, str] = {"op2_jaccard_join": _NEAR, "op5_line_dedup": _LINES, "op8_quality_rules": _rules_sql(), "op9_pivot_search": _SEARCH}
