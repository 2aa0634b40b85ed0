"""Small tables with every odd case, and brute-force forms."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, label int, piece string, shard string"
BLANKS = " \t\n\x0b\f\r"


def sentence(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + k * 104729) % 9973}" for k in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    base = sentence(1, 60)
    texts = [None, "", " ", base, base, base + " tail", sentence(2, 3), "a" * 30_000, " " * 9_000 + "x", "é ß\x1c\x85 日本語　テ 👩‍👧", "The end.\nThe end.\n" * 30, sentence(3, 20_000), "Don't 'store 12,5!! %%%***"]
    rows = [(i, t, ["en", None, "xx", "de"][i % 4], None if i % 5 == 0 else f"src{i % 2}", None if i % 3 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, base, "en", "src0", 3), (None, None, None, None, None)]
    return [(*r, "x", 7, "y", "z") for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def kept_lines(docs: list[tuple[int, str | None]], chars: int = 40, least: int = 5) -> dict[int, tuple[int, int, str]]:
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= chars and len(holders[key(x)]) >= least and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def shingles(text: str | None) -> frozenset:
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(docs: dict[int, str | None], least: float = 0.8) -> tuple[dict[int, int], dict[int, int]]:
    """Each document's class and number of links, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent, links = {i: i for i in docs}, Counter()

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= least * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}, {i: links[i] for i in ids}
