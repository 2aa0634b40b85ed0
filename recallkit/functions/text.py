"""Text safety, tokenizing, keys and prompt rendering as Column expressions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from recallkit.config import DEFAULT, Settings

#: Labels that a prompt's own scaffold uses, phrases that pose as trusted instructions, tags of the
#: extraction prompt, invisible characters, characters with a meaning in keyword queries, and words that ask for recall.
#: Hosts add labels of their own by the argument of scrub().
SCAFFOLD = (
    r"\[(?:End of|Memories?|Long-term memory|Attached images|Current message|Trusted context|untrusted_user_input|trusted_user_input|History|End of history)[^\]\n]*\]"
    r"|</?retrieved_memories[^>]*>|</?history_search[^>]*>|</?untrusted_user_input[^>]*>|</?trusted_user_input[^>]*>"
)
FACT_LABELS = (
    "Message from", "End of", "Attached images", "Current message", "Thread:", "Channel recent", "Referenced message", "Replied-to message",
    "End of thread", "End of channel", "History", "End of history", "Trusted context", "untrusted_user_input",
)
FACT_TAGS = r"</?retrieved_memories[^>]*>|</?history_search[^>]*>|</?untrusted_user_input[^>]*>"
POWER = (
    r"(bypass[_\- ]permissions|all[_\- ]permissions|system[_\- ]prompt|root[_\- ]access|ignore (?:the )?(?:previous|above)"
    r"|disregard (?:the )?(?:previous|above)|</untrusted_user_input>|</trusted_user_input>)"
)
BREAKOUT_TAGS = ("</context_hint>", "</user_text>", "</assistant_text>")
INVISIBLE = "​‌‍⁠﻿­͏"
QUERY_MARKS = r'["\(\)\*\^:]'
QUERY_BREAKS = r"[\s、。？！,.?!:;~〜\-—]+"
RECALL_WORDS = r"(前に話した|前に言った|以前話した|覚えてる|覚えている|覚えてます|記憶|思い出|思い出して|remember|recall|do you remember|what do you remember)"
TIERS = ("Live", "Hot", "Warm", "Cold")
NOTHING_FOUND = "(このクエリに一致する具体的な記憶は見つからなかった。推測で補完しないこと)"


def normalize_name(c: Column) -> Column:
    """White space of any kind collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def resolve_appellation(c: Column, names: dict[str, str]) -> Column:
    """The person that a form of address stands for, else the name itself."""
    out = F.lit(None).cast("string")
    for form, person in names.items():
        out = F.when(c == form, person).otherwise(out)
    return F.coalesce(out, c)


def escape_braces(c: Column, limit: int) -> Column:
    return F.replace(F.replace(F.substring(F.coalesce(c, F.lit("")), 1, limit), F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def strip_fence(c: Column) -> Column:
    """The inside of a Markdown code fence that the text begins with, without the word json; else the trimmed text."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_replace(F.get(F.split(t, "```", -1), F.lit(1)), "^json", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")).otherwise(t)


def strip_breakouts(c: Column) -> Column:
    for tag in BREAKOUT_TAGS:
        c = F.regexp_replace(c, f"(?iu){tag}", "")
    return c


def sanitize(c: Column) -> Column:
    """Scaffold labels and power phrases replaced; twice gives the same as once."""
    return F.regexp_replace(F.regexp_replace(c, f"(?iu){SCAFFOLD}", "[redacted-marker]"), f"(?iu){POWER}", "[redacted]")


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no built-in function."""
    return c.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_untrusted(c: Column) -> Column:
    return F.translate(nfkc(c), INVISIBLE, "")


def filter_untrusted(c: Column) -> Column:
    return sanitize(normalize_untrusted(c))


def scrub(c: Column, labels: tuple[str, ...] = FACT_LABELS) -> Column:
    """A stored fact's text without labels that could close or forge the block it is shown in."""
    pattern = rf"\[(?:{'|'.join(labels)})[^\]\n]*\]|{FACT_TAGS}"
    return F.regexp_replace(F.regexp_replace(c, f"(?iu){pattern}", "[redacted-marker]"), f"(?iu){POWER}", "[redacted]")


def asks_recall(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(f"(?iu){RECALL_WORDS}")), F.lit(False))


def query_terms(c: Column, most: int = 10) -> Column:
    """The terms of a keyword query: marks dropped, cut at punctuation, two characters at least, the first `most`."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), QUERY_MARKS, " "), f"(?U){QUERY_BREAKS}", -1)
    return F.slice(F.filter(parts, lambda t: F.length(t) >= 2), 1, most)


def match_query(c: Column, most: int = 10) -> Column:
    """The terms as an OR of quoted phrases; empty if none is left."""
    return F.array_join(F.transform(query_terms(c, most), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def fact_key(user: Column, text: Column) -> Column:
    return F.md5(F.concat(user, F.lit("\u0000"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))


def line_id(channel: Column, ts: Column, role: Column, text: Column) -> Column:
    return F.concat_ws(":", channel, ts, role, F.substring(F.sha1(text.cast("binary")), 1, 12))


def safe_text(c: Column, limit: int = 4000) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, limit)


def epoch_date(t: Column) -> Column:
    """yyyy-MM-dd of an epoch second; null unless positive."""
    return F.when(t > 0, F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd"))


def tags_csv(tags: Column) -> Column:
    """Tags joined by commas; commas inside become spaces, blank ones are left out."""
    clean = F.transform(tags, lambda t: F.trim(F.replace(t, F.lit(","), F.lit(" "))))
    return F.array_join(F.filter(clean, lambda t: t != ""), ",")


def fact_suffix(importance: Column, tier: Column, when: Column, condition: Column, scope: Column) -> Column:
    """What is shown behind a fact: importance and tier, date, condition, scope, as far as they are known."""
    inner = F.concat_ws(" ", F.when(importance.isNotNull(), F.concat(F.lit("imp="), importance.cast("string"))), F.get(F.array(*map(F.lit, TIERS)), F.when(tier.between(0, 3), tier)))
    cond = F.regexp_replace(condition, r"(?U)^\s+|\s+$", "")
    pieces = F.concat_ws(
        " ",
        F.when(inner != "", F.concat(F.lit("["), inner, F.lit("]"))),
        F.concat(F.lit("["), epoch_date(when), F.lit("]")),
        F.when(cond != "", F.concat(F.lit("[条件: "), scrub(F.substring(cond, 1, 48)), F.lit("]"))),
        F.when(scope.startswith("conversation"), "[この会話限定]").when(scope == "meta", "[メタ情報]"),
    )
    return F.when(pieces != "", F.concat(F.lit(" "), pieces)).otherwise("")


def memory_block(hits: DataFrame, key: str, s: Settings = DEFAULT) -> DataFrame:
    """One prompt block per key: header, legend, facts (core first, then by ord), a line if nothing was found, footer.

    hits: key, ord, memory, is_core, no_memory (the row that says nothing was found), importance, tier, when, condition, scope.
    """
    line = F.concat(F.lit("- "), scrub(F.col("memory")), fact_suffix(*(F.col(c) for c in ("importance", "tier", "when", "condition", "scope"))))
    shown = F.when(~F.col("no_memory") & (F.coalesce("memory", F.lit("")) != ""), F.struct((~F.col("is_core")).alias("later"), "ord", line.alias("line")))
    grouped = hits.groupBy(key).agg(F.array_sort(F.collect_list(shown)).alias("_l"), F.max("no_memory").alias("_none"))
    lines = F.concat(
        F.array(F.lit(s.header), F.lit(s.legend)),
        F.transform("_l", lambda x: x["line"]),
        F.when(F.col("_none"), F.array(F.lit(NOTHING_FOUND))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(s.footer)),
    )
    return grouped.select(key, F.array_join(lines, "\n").alias("block"))


def history_block(hits: DataFrame, key: str) -> DataFrame:
    """One block of transcript hits per key, each named by its speaker. hits: key, ord, role, author, text."""
    author = F.trim(F.coalesce("author", F.lit("")))
    named = lambda other: F.when(author != "", author).otherwise(other)
    who = F.when(F.col("role") == "user", named(F.lit("過去の発言者"))).when(F.col("role") == "assistant", F.lit("私")).when(F.col("role") == "channel", named(F.lit("誰か"))).otherwise(named(F.col("role")))
    rows = hits.where(F.coalesce("text", F.lit("")) != "").select(key, F.struct("ord", F.concat(F.lit("- ("), who, F.lit(") "), scrub(F.col("text"))).alias("line")).alias("_l"))
    lines = F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"])
    head, foot = "[History — past log lines that matched the query keywords]", "[End of history]"
    return rows.groupBy(key).agg(F.array_join(F.concat(F.array(F.lit(head)), lines, F.array(F.lit(foot))), "\n").alias("block"))


def batch_summary(turns: Column, limit: int = DEFAULT.batch_turn_chars) -> Column:
    """Accumulated turns (array of struct user, assistant) as text, each side cut at the limit."""
    side = lambda name, c: F.concat(F.lit(f"{name}: "), safe_text(c, limit))
    return F.array_join(F.transform(turns, lambda t: F.concat(side("user", t["user"]), F.lit("\n"), side("assistant", t["assistant"]))), "\n")


def known_entities_text(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ("), e["type"], F.lit(")"))), "\n")


@F.pandas_udf(ArrayType(StringType()))
def salvage_objects(text: pd.Series, key: pd.Series) -> pd.Series:
    """The complete objects of the JSON array under a key, even if the text breaks off inside it; objects that don't parse are left out."""
    return pd.Series([_objects(t, k) for t, k in zip(text, key, strict=True)], dtype=object)


def _objects(text: str | None, key: str) -> list[str]:
    if not text:
        return []
    decoder, out = json.JSONDecoder(), []
    at = 0
    while (at := text.find(json.dumps(key), at)) >= 0:
        at += len(json.dumps(key))
        rest = text[at:].lstrip()
        if rest[:1] == ":" and rest[1:].lstrip()[:1] == "[":
            at = text.index("[", at) + 1
            break
    else:
        return []
    while at < len(text):
        c = text[at]
        if c == "]":
            break
        if c != "{":
            at += 1
            continue
        try:
            _, end = decoder.raw_decode(text, at)
            out.append(text[at:end])
        except json.JSONDecodeError:
            end = _closing(text, at)
            if end is None:
                break
        at = end
    return out


def _closing(text: str, at: int) -> int | None:
    """Behind the brace that closes the one at `at`; None if the text ends before."""
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return i + 1
    return None


def alias_resolution_text(names: Column) -> Column:
    """An alias map as lines "alias = person", in order of the aliases."""
    entries = F.array_sort(F.map_entries(names))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["key"], F.lit(" = "), e["value"])), "\n")
