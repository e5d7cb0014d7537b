"""Phrase collocations against plain counting."""

import collections
import random
import re

import pytest

from codestrata.llm import phrases

from .test_documents_operators import LOWER

CASES = ("n", "k", "phrase", "a", "score", "w", "rank")


def plain(rows, min_count, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {x for x in f if len(x[1]) > 1 and f[x] >= min_count}
    inside = {(lang, p[i:j]) for lang, p in often for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[lang, p] >= f[lang, p[i:j]]}
    found = collections.defaultdict(list)
    for lang, p in often - inside:
        a = f[lang, p]
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = set()
    for lang, some in found.items():
        for i, (score, a, p, left, right) in enumerate(sorted(some)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return out


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "Ünd", "ONE"]
    stop = [" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]
    rows = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))]
        rows.append(("".join(w + rng.choice(stop) for w in words), [None, "en", "en", "de"][i % 4]))
    phrase = "alpha beta gamma delta epsilon zeta"
    rows += [(phrase, "en")] * 30 + [(phrase + ". alpha beta", None)] * 12
    rows += [("a a a a a a a a", "fr")] * 5 + [(None, "en"), ("", None), (" \n. ", "es"), ("only", "es"), ("x" * 4000 + " y", "de")]
    rows.append((" ".join(rng.choice(vocabulary) for _ in range(9000)), "en"))
    return rows


@pytest.mark.parametrize("max_bits", [phrases.MAX_BITS, 16, 6])
def test_against_plain_counting(spark, max_bits):
    rows = texts()
    docs = spark.createDataFrame([(t, g, *("x" for _ in CASES)) for t, g in rows], f"text string, lang string, {', '.join(c + ' string' for c in CASES)}").repartition(3)
    found = phrases.collocations(docs, min_count=10, max_bits=max_bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == plain(rows, 10)
    some = phrases.collocations(docs, min_count=10, top=7).collect()
    assert {tuple(r) for r in some} == plain(rows, 10, 7) and len(some) > 7


def test_scores_over_64_bits(spark):
    big = 9 * 10**16
    counts = [spark.createDataFrame([("en", "a", big), ("en", "b", big - 7)], "lang string, phrase string, a long"), spark.createDataFrame([("en", "a b", big // 3)], "lang string, phrase string, a long")]
    sizes = spark.createDataFrame([("en", 5 * big + 1)], "lang string, n long")
    [row] = phrases.scored(counts, sizes).collect()
    assert row.score == 1000 * (big // 3) * (5 * big + 1) // (big * (big - 7))


def test_empty_and_rare(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).collect() == []
    docs = spark.createDataFrame([("just a few words", "en")], "text string, lang string")
    assert phrases.collocations(docs).collect() == []
