"""Operator 8: quality rules with distribution divergence (DataFrame functions only).

Base rules: fewer than 50 words, or over half of the words inside 3-word windows that repeat in the text.
The method: a document's histogram over character classes, and its histogram over its language's common words
(and all others), are compared by Jensen-Shannon distance (base 2, so 0 to 1) to the language's references: the mean
histograms of all documents of that language in the table that pass the base rules (documents of no known language: of all known ones). Documents with too few characters or words for a
stable histogram are not judged by it. All metrics come from one pass over the texts; references
are one row per language known here, and one of them all.

Words are runs of [^\\x20\\x09-\\x0D]. Windows are told apart by 64-bit hashes.

Defined cases: null or empty text has no words and fails the base rules; a null or unknown lang is judged by
the mean over all languages known (lang `""`); a language without a document that passes the base rules has no reference and is not judged;
ties and repeated rows are independent; an empty table gives an empty table; other columns pass through
unless they bear the names of the outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallkit.session import materialize

#: The most common words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "on"),
    "de": ("der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "des"),
    "fr": ("de", "la", "le", "les", "et", "des", "en", "un", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "los", "se", "del", "las", "un"),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "wide")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*METRICS, "base_failed", "char_distance", "word_distance", "kept")
SYMBOLS = "#*$%&|<>"

_GROUPS = {"l": "abcdefghijklmnopqrstuvwxyz", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789", "_": " \t\n\x0b\f\r", ".": ".,;:!?'\"()-", "#": SYMBOLS}
_REST = "".join(chr(c) for c in range(128) if not any(chr(c) in g for g in _GROUPS.values()))
#: Each ASCII character and the sign of its class; all others stay as they are.
FROM = "".join(_GROUPS.values()) + _REST
TO = "".join(k * len(g) for k, g in _GROUPS.items()) + "~" * len(_REST)


def _count(signs: Column, sign: str) -> Column:
    return (F.octet_length(signs) - F.octet_length(F.replace(signs, F.lit(sign), F.lit("")))).cast("long")


def metrics(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df without the text, with METRICS, _chars (counts per class), _words (counts per common word of the language, then of all others) and _any (words that are common in any language).

    Steps are separate projections whose results are used more than once, so each is computed once.
    """
    rest = [c for c in df.columns if c not in (text, *OUTPUTS)]
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*rest, t.alias("_t"), F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"))
    windows = "if(size(_w) < 3, array(), array_sort(transform(sequence(0, greatest(size(_w) - 3, 0)), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) as h, i as i))))"
    df = df.select(*rest, "_t", "_w", F.translate("_t", FROM, TO).alias("_signs"), F.expr(windows).alias("_win"))
    # Positions of windows whose hash stands next to an equal one in sorted order.
    twice = "array_sort(transform(filter(_win, (x, k) -> coalesce(x.h = get(_win, k - 1).h, false) or coalesce(x.h = get(_win, k + 1).h, false)), x -> x.i))"
    nonblank = f"filter(split(_t, '\n', -1), x -> trim(both '{chr(9)}{chr(10)}{chr(11)}{chr(12)}{chr(13)} ' from x) != '')"
    df = df.select(*rest, "_w", "_signs", F.length("_t").cast("long").alias("_n"), F.expr(twice).alias("_twice"), F.expr(nonblank).alias("_lines"))
    known = F.transform(F.filter("_w", lambda w: F.length(w) <= 4), F.lower)
    listed = sorted({w for ws in COMMON.values() for w in ws})
    df = df.select(*rest, "_signs", "_n", "_twice", "_lines", F.size("_w").cast("long").alias("n_words"), F.filter(known, lambda w: w.isin(listed)).alias("_known"))
    counts = [_count(F.col("_signs"), sign) for sign in ("l", "U", "0", "_", ".", "#", "~")]
    per_lang = F.lit(None).cast("array<long>")
    for code, words in COMMON.items():
        each = [F.expr(f"cast(size(filter(_known, w -> w = '{x}')) as bigint)") for x in words]
        per_lang = F.when(F.col(lang) == code, F.array(*each)).otherwise(per_lang)
    anywhere = F.array(F.size("_known").cast("long"))
    df = df.select(*rest, "_n", "n_words", "_twice", "_lines", F.array(*counts).alias("_ascii"), F.coalesce(per_lang, anywhere).alias("_common"), F.size("_known").cast("long").alias("_any"))
    covered = F.expr("aggregate(transform(_twice, (x, k) -> least(3, coalesce(get(_twice, k + 1) - x, 3))), 0L, (a, x) -> a + x)")
    return df.select(
        *rest,
        "n_words",
        (F.col("_n") - F.col("_ascii")[3]).alias("word_chars"),
        F.col("_ascii")[5].alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.concat("_ascii", F.array(F.col("_n") - F.expr("aggregate(_ascii, 0L, (a, x) -> a + x)"))).alias("_chars"),
        F.concat("_common", F.array(F.col("n_words") - F.expr("aggregate(_common, 0L, (a, x) -> a + x)"))).alias("_words"),
        "_any",
    )


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null if either is."""
    part = "if(a > 0, a * log2(2 * a / (a + b)), 0D) + if(b > 0, b * log2(2 * b / (a + b)), 0D)"
    total = f"aggregate(zip_with({p}, {q}, (a, b) -> {part}), 0D, (s, x) -> s + x)"
    return F.sqrt(F.when(F.expr(total) < 0, 0.0).otherwise(F.expr(total) / 2))


def judge(df: DataFrame, text: str = "text", lang: str = "lang", max_char: float = 0.28, max_word: float = 0.30, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """df without the text, with OUTPUTS: the metrics, base_failed, both distances (null: not judged) and kept."""
    rest = [c for c in df.columns if c not in (text, *OUTPUTS)]
    rows = metrics(df, text, lang)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("_lang", F.when(F.col(lang).isin(list(COMMON)), F.col(lang)).otherwise(F.lit("")))
    rows = materialize(rows)
    share = "transform({0}, x -> x / {1})"
    judged = rows.withColumns({"_p": F.when(F.expr(f"aggregate(_chars, 0L, (a, x) -> a + x) >= {min_chars}"), F.expr(share.format("_chars", "aggregate(_chars, 0L, (a, x) -> a + x)"))), "_q": F.when(F.col("n_words") >= min_words, F.expr(share.format("_words", "n_words")))})
    good = judged.where(~F.col("base_failed") & (F.col("_lang") != ""))
    means = lambda c, n: F.array(*[F.avg(F.get(c, F.lit(k))) for k in range(n)])
    share_any = F.when(F.col("n_words") >= min_words, F.col("_any") / F.col("n_words"))
    refs = good.groupBy(F.col("_lang").alias("_l")).agg(means("_p", len(CLASSES)).alias("_pr"), means("_q", 11).alias("_qr"))
    every = good.agg(means("_p", len(CLASSES)).alias("_pr"), F.array(F.avg(share_any), F.avg(1 - share_any)).alias("_qr"))
    refs = refs.unionByName(every.withColumn("_l", F.lit("")))  # one row per known language, and one of them all
    refs = refs.withColumns({c: F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c)) for c in ("_pr", "_qr")})
    out = judged.join(F.broadcast(refs), F.col("_lang") == F.col("_l"), "left")
    out = out.withColumns({"char_distance": distance("_p", "_pr"), "word_distance": distance("_q", "_qr")})
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select(*rest, *OUTPUTS)
