"""Operator 5: exact line dedup by range-partitioned hashes, giving compressed keep bitmaps (DataFrame functions only).

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least min_chars
code points found in at least min_docs documents keep their lines only in the largest doc_id that holds them.

Per document, each long line becomes (hash, share, doc, position); these rows are written once without any text. They
are dealt out by ranges of (hash, share) and sorted inside them by document, last first, then position: the first
document of a hash is its first occurrence, which keeps its lines, and a running rank over the sorted rows counts the documents
behind it. Windows run over this one exchange and its sort (`ranked`); there is no join on hashes.

The share is 0, except for the hashes that a frequent-items sketch finds to hold more than 1 / SKETCH of all rows: these are cut by a hash
of the document into SHARES parts, each ranked by itself, and one row per part says how the parts of a hash
hang together (at most HOT * SHARES rows). So a line that a third of all documents hold is spread over many tasks. The
sketch steers only how rows are dealt, never the result.

Dropped positions come back as one bitmap per document: (word, bits) for each 64-line word that loses lines, by word (bit
set: keep); words that aren't listed keep all of theirs, and documents that lose nothing have none. The bitmaps are broadcast to the texts while
their measured size allows; beyond that both are sorted and merged.

Defined cases: null or empty text is one empty line, which stays; keys are told apart by two 64-bit hashes;
a key that repeats inside its largest document keeps all its lines there; repeated rows (same doc_id and
text) are one document and lose the same lines; with a null doc_id a row counts as no document of its own, loses
lines that documents with ids hold, and keeps the others; an empty table gives an empty table; other columns pass through, `dedup_lines` replaces those that
bear the names of its outputs, `reduce` leaves them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit.session import broadcast_if_small, materialize

OUTPUTS = ("keep_bitmap", "n_lines", "n_dropped", "kept")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
#: Counters of the frequent-items sketch, the hashes it gives out at most, and the parts that each of them is cut into.
SKETCH, HOT, SHARES = 4096, 256, 64


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(df: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """Rows (_h, _i, _doc, _same, _at) of all lines with a key of at least min_chars code points: its two hashes, the document, the hash of its text, the position."""
    lines = df.select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("_same"), F.posexplode(lines_of(F.col(text))).alias("_at", "_line"))
    lines = lines.where(F.octet_length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= min_chars)
    return lines.select(F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_i"), "_doc", "_same", "_at")


def frequent(lines: DataFrame) -> list[int]:
    """The hashes that hold more than 1 / SKETCH of all rows, at most HOT of them."""
    row = lines.agg(F.expr(f"approx_top_k(_h, {HOT}, {SKETCH})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [t["item"] for t in row["top"] or [] if t["item"] is not None and t["count"] * SKETCH > row["n"]]


def ranked(lines: DataFrame, hot: list[int]) -> DataFrame:
    """lines with _share, _last (the largest document of its hash and share) and _n (how many documents hold it there), by one range exchange and its sort."""
    share = F.when(F.col("_h").isin(hot), 1 + F.pmod(F.xxhash64("_doc"), F.lit(SHARES)).cast("int")).otherwise(0) if hot else F.lit(0)
    late = F.col("_doc").desc_nulls_last()
    ranged = lines.withColumn("_share", share).repartitionByRange("_h", "_i", "_share").sortWithinPartitions("_h", "_i", "_share", late, "_at")
    whole = Window.partitionBy("_h", "_i", "_share")  # dealt and sorted like that already
    stream = ranged.withColumns({"_last": F.first("_doc").over(whole.orderBy(late)), "_nth": F.dense_rank().over(whole.orderBy(late))})
    return stream.withColumn("_n", F.coalesce(F.max(F.when(F.col("_doc").isNotNull(), F.col("_nth"))).over(whole), F.lit(0))).drop("_nth")


def dropped(lines: DataFrame, min_docs: int) -> DataFrame:
    """The rows of lines that go."""
    hot = frequent(lines)
    rows = ranked(lines, hot)
    if hot:
        parts = lines.where(F.col("_h").isin(hot)).groupBy("_h", "_i", F.pmod(F.xxhash64("_doc"), F.lit(SHARES)).alias("_s")).agg(F.count_distinct("_doc").alias("_c"), F.max("_doc").alias("_m"))
        ends = parts.groupBy(F.col("_h").alias("_h0"), F.col("_i").alias("_i0")).agg(F.sum("_c").alias("_all"), F.max("_m").alias("_end"))
        rows = rows.join(F.broadcast(ends), (F.col("_h") == F.col("_h0")) & (F.col("_i") == F.col("_i0")) & (F.col("_share") > 0), "left")  # about HOT rows
        rows = rows.withColumns({"_n": F.coalesce("_all", "_n"), "_last": F.coalesce("_end", "_last")})
    return rows.where((F.col("_n") >= min_docs) & ~F.col("_doc").eqNullSafe(F.col("_last"))).select("_doc", "_same", "_at")


def bitmaps(df: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row (_doc, _same, keep_bitmap, n_dropped) for each document that loses lines; _same is the hash of its text."""
    lines = materialize(long_lines(df, doc, text, min_chars))
    gone = dropped(lines, min_docs).select("_doc", "_same", F.expr("_at div 64").cast("int").alias("_w"), F.expr("shiftleft(1L, _at % 64)").alias("_bit"))
    words = gone.repartition("_doc", "_same").groupBy("_doc", "_same", "_w").agg(F.bit_or("_bit").alias("_bits"))
    keep = F.struct(F.col("_w").alias("word"), F.bitwise_not("_bits").alias("bits"))
    return words.groupBy("_doc", "_same").agg(F.array_sort(F.collect_list(keep)).alias("keep_bitmap"), F.sum(F.bit_count("_bits")).alias("n_dropped"))


def _judged(df: DataFrame, doc: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """df with _ld_found (keep_bitmap and n_dropped, null: keeps all) and _ld_left, the text of the lines that stay."""
    found = broadcast_if_small(materialize(bitmaps(df, doc, text, min_chars, min_docs)))
    found = found.select(F.col("_doc").alias("_ld_doc"), F.col("_same").alias("_ld_same"), F.struct("keep_bitmap", "n_dropped").alias("_ld_found"))
    rows = df.withColumn("_ld_own", F.xxhash64(text))
    rows = rows.join(found, rows[doc].eqNullSafe(found["_ld_doc"]) & (F.col("_ld_own") == F.col("_ld_same")), "left").drop("_ld_doc", "_ld_same", "_ld_own")
    rows = rows.withColumn("_ld_bits", F.map_from_entries("_ld_found.keep_bitmap"))
    # Lines of words that aren't listed stay.
    bit = "shiftrightunsigned(try_element_at(_ld_bits, cast(i div 64 as int)), i % 64) & 1"
    left = F.expr(f"array_join(filter(split({_quoted(text)}, '\n', -1), (x, i) -> coalesce({bit}, 1) = 1), '\n')")
    return rows.withColumn("_ld_left", F.when(F.col("_ld_found").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(left))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def dedup_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """df with keep_bitmap (null: keep all), n_lines, n_dropped, and kept, the lines that stay joined by line feeds."""
    rest = [c for c in df.columns if c not in OUTPUTS]
    rows = _judged(df.select(*rest), doc, text, min_chars, min_docs)
    return rows.select(
        *rest,
        F.col("_ld_found.keep_bitmap").alias("keep_bitmap"),
        F.size(lines_of(F.col(text))).cast("long").alias("n_lines"),
        F.coalesce("_ld_found.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.col("_ld_left").alias("kept"),
    )


def reduce(df: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """df with the lines that stay as its text; a null text stays null."""
    rows = _judged(df, doc, text, min_chars, min_docs)
    return rows.select(*[F.when(F.col(text).isNotNull(), F.col("_ld_left")).alias(text) if c == text else F.col(c) for c in df.columns])
