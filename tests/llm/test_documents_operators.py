"""Operators over documents against plain Python on a small corpus with the awkward cases."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from codestrata.llm import license_scan, lm_scoring, mixing, ngram_join, packing, quality_rules, suffix_dedup, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ("key", "size", "tid", "sha", "n", "token", "part", "cls", "words", "taken", "features", "label", "uid", "shard", "copies")


def counted(frame, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_mix_targets_and_sums(documents, corpus):
    found = mixing.mix(documents(corpus, CLASHES)).collect()
    size = {s: sum(len(WORD.findall(t or "")) for _, t, x in corpus if x == s) for s in {r[2] for r in corpus}}
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:  # plain filling: cap, share the rest anew
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        level = rest / sum(weight[s] for s in size if s not in full)
        more = {s for s in size if s not in full and level * weight[s] > 2 * size[s] + 1e-9}
        if not more:
            break
        full |= more
    target = {s: 2.0 * size[s] if s in full else level * weight[s] for s in size}
    assert len(found) == len(corpus)
    taken, largest = collections.Counter(), collections.Counter()
    for r in found:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = counted(mixing.mix(documents(corpus[::-1])), "doc_id", "size", "taken")
    assert again == collections.Counter((r.doc_id, r.size, r.taken) for r in found)


def test_mixed_documents_repeat_as_taken(documents, corpus):
    docs = documents(corpus, ("key", "id", "times", "alike"))
    found = counted(mixing.mixed_documents(docs), "doc_id", "text")
    wanted = collections.Counter()
    for r in mixing.mix(docs).drop("text").join(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).distinct(), F.col("key") == F.col("k")).collect():
        wanted[(r[0], r["text"])] += r.copies
    assert found == collections.Counter({k: v for k, v in wanted.items() if v})


def test_quality_counts(documents, corpus, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    docs = documents([*corpus, (500, "a b c\na b c\n# $ | x\n\n a b c", "s0")], CLASHES)
    for r in quality_rules.quality(docs, labels).collect():
        text = r.text or ""
        w = WORD.findall(text)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base)
        assert not (base and r.kept)
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert counted(kept, "doc_id", "text") == counted(quality_rules.quality(docs, labels).where("kept"), "doc_id", "text")


def covered(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    return len({j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})


def test_repeat_words_where_hashes_collide(documents, corpus):
    docs = documents([*corpus, (500, "a b c a b d a b c d a b d", "s0"), (501, "a a a a", "s0")])
    found = docs.select("doc_id", "text", quality_rules._words(F.coalesce("text", F.lit(""))).alias("w"))
    for step in quality_rules._repeat_words("w", lambda *x: F.pmod(F.xxhash64(*x), F.lit(3))):
        found = found.withColumns(step)
    assert all(r["__covered"] == covered(r.text) for r in found.select("text", "__covered").collect())


def test_repeat_words_of_a_very_long_text(documents):
    texts = [" ".join(map(str, range(1_000_000))), " ".join(map(str, range(300_000))) + " 7 8 9"]
    labels = documents([]).selectExpr("doc_id", "0 AS quality")
    found = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.quality(documents(list(zip((0, 1), texts, "ab"))), labels).collect()}
    assert found == {0: (1_000_000, 0), 1: (300_003, 6)}


def test_quality_ratio_against_plain_counting(documents, spark, corpus):
    token = re.compile(r"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+")
    rows = [r for r in corpus if r[0] != 406]
    trusted = set(range(12))
    grams = lambda t: (lambda w: [(x,) for x in w] + list(zip(w, w[1:])))(token.findall((t or "").lower()))
    every = sorted({g for _, t, _ in rows for g in grams(t)})
    hashed = spark.createDataFrame([(list(g),) for g in every], "g array<string>").select("g", F.when(F.size("g") == 1, quality_rules._bucket(F.get("g", 0))).otherwise(quality_rules._bucket(F.get("g", 0), F.get("g", 1))).alias("b"))
    bucket = {tuple(r.g): r.b for r in hashed.collect()}
    raw = collections.Counter(bucket[g] for _, t, _ in rows for g in grams(t))
    good = collections.Counter(bucket[g] for i, t, _ in rows if i in trusted for g in grams(t))
    n_raw, n_good, n = sum(raw.values()), sum(good.values()), quality_rules.BUCKETS

    def ratio(g):
        share = raw[bucket[g]] / n_raw
        return math.log((good[bucket[g]] + n * share) / (n_good + n) / share)

    labels = spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int")
    found = quality_rules.quality(documents(rows), labels, threshold=0.0).collect()
    for r in found:
        mine = [ratio(g) for g in grams(r.text)]
        assert r.llr == pytest.approx(sum(mine) / len(mine) if mine else 0.0, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= 0)
    assert len({r.kept for r in found}) == 2


def test_quality_ratio_drops_what_trusted_texts_lack(documents, spark):
    import random

    rng = random.Random(9)
    good = [(i, " ".join(f"plain{rng.randrange(50)}" for _ in range(80)), "a") for i in range(1, 40)]
    bad = [(100 + i, " ".join(f"word{rng.randrange(50)}### %%%" for _ in range(80)), "a") for i in range(1, 30)]
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good[:30]], "doc_id long, quality int")
    docs = documents(good + bad)
    verdict = {r.doc_id: r.kept for r in quality_rules.quality(docs, labels).collect() if not r.base_failed}
    assert all(v == (k < 100) for k, v in verdict.items()) and len(verdict) > 20
    none = quality_rules.quality(docs, labels.limit(0)).collect()
    assert all(r.llr == 0 for r in none)


def repeated(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = collections.Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"pack_bytes": 3000, "passage": 240}, {"hot_runs": 2, "passage": 160}, {"hot_bytes": 5000, "passage": 240}])
def test_suffix_dedup(documents, corpus, options):
    rows = [*corpus, (600, "x" * 1000, "a"), (601, "yz" * 450, "a"), (602, "x" * 401 + "q", "b")]
    rows += [(603 + k, f"{k} " * k + corpus[12][1][:250] + f" {k}" * 9, "b") for k in range(3)]
    found = suffix_dedup.dedup(documents(rows, CLASHES), **options).collect()
    wanted = collections.Counter((r[0], *x) for r, x in zip(rows, repeated(rows, 400)))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == wanted
    texts = collections.Counter((r[0], x[1], t) for r, x, t in zip(rows, repeated(rows, options.get("passage", 400)), stripped(rows, options.get("passage", 400))))
    assert collections.Counter((r.doc_id, r.n_passage_bytes, r.text) for r in found) == texts


def stripped(rows, length):
    """What is left of each text, by plain Python."""
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = collections.Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        out.append(bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_suffix_dedup_shards_merge():
    import random

    import numpy as np

    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 123) for _ in range(300))
    pieces = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(1, 90))) + shared[k : k + 150 + k] + bytes([65 + k]) * 30 for k in range(20)]
    pieces = [p for p in pieces if len(p) >= 100]
    for shard in (64, 300, 1 << 20):
        starts = np.array([len(p) - 59 for p in pieces])
        for length, found in zip((60, 100), suffix_dedup.repeated_starts(pieces, np.ones(len(pieces)), starts, (60, 100), 20, shard)):
            seen = collections.Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
            for p, flags in zip(pieces, found):
                assert flags.tolist() == [i + length <= len(p) and seen[p[i : i + length]] > 1 for i in range(len(p) - 59)]


def test_suffix_dedup_merge_of_alike_pieces():
    """Rows of equal pieces all get the ranges, and writing them costs little beside the merge."""
    import random
    import time

    import numpy as np
    import pandas as pd

    rng = random.Random(8)
    passages = [bytes(rng.randrange(97, 123) for _ in range(240 + 60 * (k % 5))) for k in range(40)]
    pieces = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(5, 90))) + rng.choice(passages) + bytes([65 + k % 7]) * (k % 30 + 1) for k in range(2500)]
    rows = [(tid, k % 11, len(p) - 239, p) for tid, (k, p) in enumerate((k, p) for k, p in enumerate(pieces) for _ in range(1 + k % 6))]
    rng.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["tid", "first", "size", "piece"])

    seen = collections.Counter(p[i : i + n] for _, _, _, p in rows for n in (240, 400) for i in range(len(p) - n + 1))
    wanted = []
    for tid, first, size, p in rows:
        for n in (240, 400):
            starts = [i for i in range(size) if i + n <= len(p) and seen[p[i : i + n]] > 1]
            runs = [i for i in starts if i - 1 not in starts], [i for i in starts if i + 1 not in starts]
            wanted += [(tid, n, first + a, first + b + n) for a, b in zip(*runs)]
    merge = suffix_dedup._merge_pack((240, 400), 80)
    assert sorted(merge(frame).itertuples(index=False, name=None)) == sorted(wanted)

    one_each = list({(p, n): None for _, _, n, p in rows})
    starts, ones = np.array([n for _, n in one_each]), np.ones(len(one_each))
    works = {"all": lambda: merge(frame), "merge": lambda: suffix_dedup.repeated_starts([p for p, _ in one_each], ones, starts, (240, 400), 80)}
    spent = collections.defaultdict(list)
    for _ in range(4):
        for name, work in works.items():
            at = time.process_time()
            work()
            spent[name].append(time.process_time() - at)
    assert min(spent["all"]) < 1.15 * min(spent["merge"])


def test_window_hashes_are_span_hashes():
    import numpy as np

    block = suffix_dedup.Block(np.frombuffer(b"the quick brown fox" * 9, np.uint8), np.array([0, 171]), 0)
    sums = block.prefix_sums()
    for width in (1, 80, 171, 172, 400):
        at = np.arange(max(0, 172 - width))
        assert (block.window_hashes(sums, width) == block.span_hashes(sums, at, at + width)).all()


def test_stripped_documents(documents, corpus):
    docs = documents(corpus, ("sha", "rest"))
    out = suffix_dedup.stripped_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    wanted = collections.Counter(x[0] - x[1] for x in repeated(corpus, 400))
    assert collections.Counter(len((r.text or "").encode()) for r in out.collect()) == wanted


def components_of(rows, num=90, den=100):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc), doc)
    return [(rows[i][0], len(sets[i]), lowest.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


@pytest.mark.parametrize("options", [{}, {"group_rows": 2}, {"need": 1}])
def test_ngram_join(documents, corpus, options):
    found = ngram_join.jaccard_components(documents(corpus, CLASHES), **options)
    assert counted(found, "doc_id", "n_shingles", "component_id") == collections.Counter(components_of(corpus))


def test_one_of_each(documents, corpus):
    docs = documents(corpus, ("key", "id"))
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    groups = {c for _, n, c in components_of(corpus) if n}
    kept = [r.doc_id for r in out.collect()]
    empty = [r[0] for r in corpus if not WORD.search(r[1] or "")]
    assert sorted(kept, key=str) == sorted([*groups, *empty], key=str)


def test_one_of_each_where_components_share_an_id(documents):
    import random

    from .conftest import words

    rng = random.Random(8)
    texts = [words(rng, 80, 5000) for _ in range(9)]
    near = texts[0].rsplit(" ", 1)[0]
    rows = [(None, t, "a") for t in [*texts[:5], near]] + [(7, texts[5], "a"), (7, texts[6], "b"), (8, texts[6], "b"), (6, texts[7], "c"), (7, texts[7], "c"), (9, texts[8], None), (None, texts[8], None)]
    kept = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(documents(rows)).collect())
    first = [k for k in kept if k[1] in (texts[0], near)]
    assert len(first) == 1 and first[0][0] is None
    rest = [(None, t) for t in texts[1:5]] + [(7, texts[5]), (7, texts[6]), (6, texts[7]), (9, texts[8])]
    assert kept == collections.Counter(first + rest)


def test_token_counts_match_the_tokenizer(documents, corpus):
    from tokenizers import Tokenizer, models, normalizers

    pieces = token_counts.load_pieces()
    exact = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    exact.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rows = [*corpus, (700, "日本語 🎉🎉 é́ <s> <0x0A>\n\n  tail ", "a"), (701, "▁under▁ score", "b")]
    found = counted(token_counts.token_counts(documents(rows, CLASHES)), "doc_id", "n_tokens")
    assert found == collections.Counter((i, len(exact.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)


def test_token_counts_with_ties():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("abab", -4.0), ("c", -1.5)]
    exact = Tokenizer(models.Unigram(pieces, unk_id=0))
    counter = token_counts.Counter(pieces)
    for text in ("ababab", "abab", "bababa", "aabbaabb", "cabac"):
        assert counter.viterbi(text) == len(exact.encode(text).ids)


def test_license_scan(documents, corpus):
    notices = license_scan.TEMPLATES
    rows = [*corpus, *[(800 + k, corpus[5][1] + "\n" + text + ".\n" + corpus[6][1], "a") for k, (_, text) in enumerate(notices)]]
    edited = [" ".join(w if k % 60 else "changed" for k, w in enumerate(text.split(), 7)) for _, text in notices if len(text.split()) > 45]
    rows += [(850 + k, corpus[7][1] + " " + text + " " + corpus[8][1], "a") for k, text in enumerate(edited)]
    rows += [(900, notices[5][1].upper(), "a"), (901, "Licensed under the terms", "a"), (901, notices[1][1], "b"), (901, notices[1][1], "b")]
    found = license_scan.scan(documents(rows, CLASHES))
    texts = {(i, t): None for i, t, _ in rows}

    def contained(template, text):
        tokens = lambda x: re.findall("[a-z0-9]+", x.lower())
        sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        a, b = sh(tokens(template)), tokens(text or "")
        span = len(tokens(template))
        width = -(-3 * span // 2)
        return any(len(a & sh(b[i : i + width])) >= 0.8 * len(a) for i in range(len(b)))

    wanted = collections.Counter({(i, t, name) for i, t in texts for name, text in notices if contained(text, t)})
    wanted = collections.Counter((i, name) for i, _, name in wanted)
    assert counted(found, "doc_id", "license") == wanted
    assert len(wanted) >= len(notices) + 2 and len(edited) >= 4
    assert all((850 + k, name) in wanted for k, name in enumerate(n for n, text in notices if len(text.split()) > 45))
    assert license_scan.bands_needed(5) == 49 and license_scan.bands_needed(170) < 40


def test_packing(documents, corpus):
    sizes = (64, 128, 512)
    found = packing.pack(documents(corpus, CLASHES), sizes=sizes, shard_pieces=20).toPandas()
    wanted = collections.Counter()
    for i, t, _ in corpus:
        wanted[i] += len(WORD.findall(t or ""))
    assert found.groupby(found["doc_id"].fillna(-1))["length"].sum().to_dict() == {(-1 if k is None else k): v for k, v in wanted.items() if v}
    for _, bin_ in found.groupby("bin_id"):
        bin_ = bin_.sort_values("bin_offset")
        size = bin_["bin_size"].iloc[0]
        assert (bin_["bin_offset"].to_numpy()[1:] == bin_["length"].cumsum().to_numpy()[:-1]).all() and bin_["bin_offset"].iloc[0] == 0
        assert bin_["length"].sum() <= size and size in sizes
        assert all(s < bin_["length"].sum() for s in sizes if s < size)
    again = packing.pack(documents(corpus[::-1]), sizes=sizes, shard_pieces=20).toPandas()
    columns = ["doc_id", "copy", "piece", "bin_id", "bin_offset"]
    assert counted_frame(found[columns]) == counted_frame(again[columns])


@pytest.mark.parametrize("seed", range(6))
def test_pieces_go_where_a_plain_search_puts_them(seed):
    import random

    rng = random.Random(seed)
    sizes = (16, 32, 64)
    lengths = sorted((min(64, 1 + int(rng.expovariate(0.07))) for _ in range(200)), reverse=True)
    bins, offsets, final = packing.pack_pieces(lengths, sizes)
    used, capacity, wanted = [], [], []
    for nth, n in enumerate(lengths):
        fits = [(capacity[b] - used[b], b) for b in range(len(used)) if capacity[b] - used[b] >= n]
        if fits:
            b = min(fits)[1]
        else:
            later = lengths[nth + 1 :]
            per_word = {s: packing.sequence_cost(s) / (n + min(s - n, sum(x for x in later if x <= s - n))) for s in sizes if s >= n}
            b = len(used)
            used.append(0), capacity.append(min(per_word, key=per_word.get))
        wanted.append((b, used[b]))
        used[b] += n
    assert list(zip(bins, offsets)) == wanted
    assert final == [min(s for s in sizes if s >= u) for u in used]
    one_size = packing.pack_pieces(lengths, sizes[-1:])[2]
    assert sum(map(packing.sequence_cost, final)) <= sum(map(packing.sequence_cost, one_size))


def test_packing_of_equal_and_empty_documents(documents):
    rows = [(k, "a b c d", "x") for k in (1, 2, 2, None, None)] + [(3, "", "x"), (4, None, None), (5, " \n", "x"), (6, "w " * 50, "y")]
    found = packing.pack(documents(rows), sizes=(8, 16), shard_pieces=1000).collect()
    assert collections.Counter((r.doc_id, r.copy, r.length) for r in found if r.doc_id != 6) == collections.Counter([(1, 0, 4), (2, 0, 4), (2, 1, 4), (None, 0, 4), (None, 1, 4)])
    assert sorted((r.piece, r.length) for r in found if r.doc_id == 6) == [(0, 16), (1, 16), (2, 16), (3, 2)]
    assert all(r.bin_size in (8, 16) for r in found) and len({(r.bin_id, r.bin_offset) for r in found}) == len(found)


def counted_frame(frame):
    return collections.Counter(map(tuple, frame.fillna(-1).itertuples(index=False)))


def test_lm_scoring_base_and_gain(documents):
    import random

    rng = random.Random(1)
    sides = [["red", "green", "blue", "teal"], ["one", "two", "three", "four"]]
    rows = [(i, " ".join(rng.choice(sides[i % 2]) for _ in range(120)), "a") for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (None, "Red GREEN\tunseen", None), (5, rows[5][1], "a")]
    found = lm_scoring.score(documents(rows, CLASHES), top=5).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    count = collections.Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    total = sum(count.values())
    norm = math.log10(total + 0.1 * (len(count) + 1))
    wanted = collections.Counter()
    for i, t, _ in rows:
        w = tokens(t)
        wanted[(i, held(i), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10(count[x] + 0.1) - norm for x in w), 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == wanted
    mine = [r for r in found if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert all(r.score <= 0 for r in found)


def plain_log_probabilities(model, log_rest, count, text):
    """log10 of each token's probability, token by token, and the mass that the model gives to all words after each history."""
    import numpy as np

    def token(word):
        value, cls, _ = lm_scoring.tokens(next(lm_scoring.blocks(lm_scoring.pa.array([word]))))
        return value[0], int(cls[0])

    def choice(bias, table, hashed):
        logits = bias.astype(float) + sum(table[k][int(h) >> (64 - model.bits)] for k, h in enumerate(hashed))
        return np.exp(logits) / np.exp(logits).sum()

    slots = dict(zip(model.words.tolist(), model.word_slots.tolist()))
    vocabulary = {w: token(w) for w in count}
    history, out, masses = [(lm_scoring._BEGIN, 0), (lm_scoring._BEGIN, 0)], [], []
    for word in [*WORD.findall((text or "").translate(LOWER)), ""]:
        (two, c2), (one, c1) = history
        u = np.uint64
        hashed = [lm_scoring.mix(np.array([x], u))[0] for x in (one ^ u(1), two ^ u(2), one * u(3) + two * u(5), u(c1 * lm_scoring.CLASSES + c2 + (1 << 20)))]
        classes = choice(model.class_bias, model.classes, hashed)

        def probability(value, cls, n):
            within = choice(model.slot_bias[cls], model.slots, [h * u(2 * cls + 3) for h in hashed])
            slot = slots.get(int(value), 0)
            return classes[cls] * within[slot] * (1 if slot else (n + 0.1) / 10 ** log_rest[cls])

        value, cls = token(word)
        out.append(math.log10(probability(value, cls, count.get(word, 0))))
        if len(out) < 3:
            unknown = sum(classes[c] * choice(model.slot_bias[c], model.slots, [h * u(2 * c + 3) for h in hashed])[0] * 0.1 / 10 ** log_rest[c] for c in range(lm_scoring.CLASSES))
            masses.append(unknown + sum(probability(*vocabulary[w], n) for w, n in count.items()))
        history = [history[1], (value, cls)]
    return out, masses


def test_lm_scores_against_a_plain_model(documents, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(rng.randrange(900), rng.randrange(900))}" for _ in range(rng.randrange(1, 60))), "a") for i in range(60)] + [(100, None, "a"), (101, "", "b"), (102, "ALPHA beta", "b")]
    held, train = {}, lm_scoring.train
    start_model = lm_scoring.start_model
    monkeypatch.setattr(lm_scoring, "start_model", lambda *a: held.setdefault("start", start_model(*a)))
    monkeypatch.setattr(lm_scoring, "train", lambda *a: held.setdefault("model", train(*a)))
    found = {r.doc_id: r for r in lm_scoring.score(documents(rows), shard_tokens=400).collect()}
    learn = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for t in learn for w in [*WORD.findall((t or "").translate(LOWER)), ""])
    assert abs(held["model"].classes).max() > 0 and abs(held["model"].slots).max() > 0
    for i, t, _ in rows[::4] + rows[-3:]:
        logs, masses = plain_log_probabilities(held["model"], held["start"][1], count, t)
        assert found[i].score == pytest.approx(sum(logs), rel=1e-4)
        assert all(abs(x - 1) < 1e-3 for x in masses)


def test_lm_scores_do_not_depend_on_partitions(documents):
    import random

    rng = random.Random(7)
    docs = documents([(i, " ".join(f"w{rng.randrange(50)}" for _ in range(40)), "a") for i in range(80)])
    one, many = ({r.doc_id: r.score for r in lm_scoring.score(d, shard_tokens=300).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == pytest.approx(many, abs=1e-9)


def plain_step(weights, bias, state, rows, want, rate):
    """The step of ``lm_scoring`` with a softmax by row maxima and sums over sorted rows; also the log of each wanted share."""
    import numpy as np

    score = bias + sum(weights[k][rows[k]] for k in range(lm_scoring.KINDS))
    score -= score.max(1, keepdims=True)
    score -= np.log(np.exp(score).sum(1, keepdims=True))
    slope, nth = np.exp(score), np.arange(len(want))
    slope[nth, want] -= 1
    for k in range(lm_scoring.KINDS):
        order = np.argsort(rows[k], kind="stable")
        ordered = rows[k][order]
        begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        used, step = ordered[begin], np.add.reduceat(slope[order], begin, axis=0)
        state[k][used] += step * step
        weights[k][used] -= rate * step / np.sqrt(state[k][used] + 1)
    return score[nth, want]


def test_lm_step_equals_a_plain_step_in_less_time():
    import time

    import numpy as np

    rng, n = np.random.default_rng(3), lm_scoring.MINIBATCH
    for choices, far in ((lm_scoring.CLASSES, 0), (lm_scoring.SLOTS, 0), (lm_scoring.SLOTS, 150)):
        # Rows as words are: some in thousands of places, most in one or two; ``far``: a choice whose exponent overflows or vanishes.
        rows = np.stack([np.minimum(rng.zipf(1.3, n), 1 << 14) % (1 << 14), rng.integers(0, 1 << 14, n), rng.integers(0, 1 << 14, n), np.zeros(n, int)]).astype(np.uint16)
        want = rng.integers(0, choices, n)
        start = rng.normal(0, 1, (lm_scoring.KINDS, 1 << 14, choices)).astype(np.float32)
        start[3, :, 0] += far
        start[1, ::2] -= np.float32(far)
        bias, zero = np.log(np.full(choices, 1 / choices, np.float32)), np.zeros_like(start)
        spent, ends = {}, {}
        for step in (plain_step, lm_scoring._step):
            times = []
            for _ in range(5):
                weights, state = start.copy(), zero.copy()
                at = time.process_time()
                step(weights, bias, state, rows, want, 0.15)
                times.append(time.process_time() - at)
            spent[step], ends[step] = min(times), (weights, state)
        for plain, mine in zip(*ends.values()):
            assert np.allclose(plain, mine, rtol=1e-3, atol=1e-4)
        wanted = plain_step(start.copy(), bias, zero.copy(), rows, want, 0.15)
        assert np.allclose(lm_scoring.log_odds(start, bias, rows, want), wanted, rtol=1e-4, atol=1e-4)
        assert far or spent[lm_scoring._step] < 0.75 * spent[plain_step]
    few = lm_scoring.log_odds(start, bias, rows[:, :3], want[:3])
    assert (few == lm_scoring.log_odds(start, bias, rows, want)[:3]).all()


def test_sorted_hashes_are_found():
    import numpy as np

    from codestrata.llm.text_arrays import SortedHashes

    rng = np.random.default_rng(5)
    spread = rng.integers(0, 1 << 64, 3000, np.uint64)
    close = np.arange(700, dtype=np.uint64) * np.uint64(3)  # all in one range of high bits
    for values in (spread, close, np.r_[spread, close, np.uint64((1 << 64) - 1)], close[:1], close[:0]):
        values = np.unique(values)
        wanted = np.r_[values[::-1], values + np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]
        place = {v: i for i, v in enumerate(values.tolist())}
        assert SortedHashes(values).find(wanted).tolist() == [place.get(v, -1) for v in wanted.tolist()]


def test_toxicity_held_out(documents, spark):
    import random

    rng = random.Random(2)
    plain = [f"p{k}q" for k in range(200)]
    stem = [f"grubl{x}" for x in ("a", "e", "ino", "ux")]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) + rng.choice("abcdefgh") * 2 for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for at in rng.sample(range(60), 3):
                w[at] = rng.choice(stem if i % 8 else ["idiot", "moron", "stupid"])
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, "a"), (5001, "", "a"), (None, "you idiot", None)]
    labels += [(None, 1, 1), (5, None, None), (6, 0, 7)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.score(documents(rows, ("label", "features", "prediction", "p")), frame).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    right = sum((r.doc_id % 4 == 0) == bool(r.predicted) for r in held)
    assert right / len(held) > 0.95
    assert {r.held_out for r in found if r.doc_id == 1} == {zlib.crc32(b"1") % 3 == 1}
    assert all(r.score == 0 for r in toxicity.score(documents(rows[:5]), frame.limit(0)).collect())


@pytest.mark.parametrize("apply", [mixing.mix, mixing.mixed_documents, suffix_dedup.dedup, suffix_dedup.stripped_documents, ngram_join.jaccard_components, ngram_join.one_of_each, token_counts.token_counts, license_scan.scan, packing.pack, lm_scoring.score])
def test_empty_table(documents, apply):
    assert apply(documents([])).count() == 0


def test_empty_table_with_labels(documents, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality(documents([]), labels).count() == 0
    assert toxicity.score(documents([]), labels).count() == 0
