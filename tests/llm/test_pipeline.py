"""The pipeline against plain Python, stage by stage, with no labels (so that every n-gram ratio is 0)."""

import collections
import re

import corpus_pipeline
from codestrata.llm import queries

from .test_documents_operators import LOWER, WORD, components_of, repeated, stripped


def test_stages(spark, documents, corpus, tmp_path):
    rows = [*corpus, (700, corpus[20][1] + "\n" + corpus[21][1], "s3")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        out[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    def passes(text):
        w = WORD.findall(text or "")
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    kept = [r for r in rows if passes(r[1])]
    assert collections.Counter((r.doc_id, r.text) for r in out["quality_rules"]) == collections.Counter((i, t) for i, t, _ in kept)
    groups = {c for _, n, c in components_of(kept)}
    unique = out["ngram_jaccard_join"]
    assert sorted([r.doc_id for r in unique], key=str) == sorted(groups, key=str)
    single = [(r.doc_id, r.text, r.source) for r in unique]
    assert collections.Counter((r.doc_id, r.text) for r in out["suffix_dedup"]) == collections.Counter(zip([r[0] for r in single], stripped(single, 240)))
    assert sum(x[1] for x in repeated(single, 240)) > 0

    before = {r.doc_id: len(WORD.findall(r.text)) for r in out["suffix_dedup"]}
    taken = collections.Counter(r.doc_id for r in out["source_mixing"])
    assert all(n <= 2 for n in taken.values()) and set(taken) <= set(before)
    assert abs(sum(before[i] * n for i, n in taken.items()) - 1.5 * sum(before.values())) <= 5 * max(before.values())
    packed = collections.Counter()
    for r in out["best_fit_packing"]:
        packed[r.doc_id] += r.length
    assert packed == collections.Counter({i: before[i] * n for i, n in taken.items() if before[i]})
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(again) == collections.Counter(out["best_fit_packing"])


def test_pipeline_of_an_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "bin_id" in out.columns


def test_near_duplicates_at_five_words_and_four_fifths(spark, documents):
    import random

    from .conftest import words

    rng = random.Random(12)
    base = words(rng, 100, 5000).split()

    def changed(*places):
        return " ".join(f"new{k}" if k in places else w for k, w in enumerate(base))

    def shared(a, b, n):
        a, b = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    # Two edits: 86 of 106 shingles of five words are shared (0.81), 92 of 104 of three (0.88). Three: 81 of 111 (0.73).
    rows = [(1, " ".join(base), "a"), (2, changed(30, 60), "b"), (3, changed(20, 50, 80), "c")]
    assert 0.8 <= shared(rows[0][1], rows[1][1], 5) and shared(rows[0][1], rows[1][1], 3) < 0.9
    assert shared(rows[0][1], rows[2][1], 5) < 0.8 and shared(rows[1][1], rows[2][1], 5) < 0.8
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, documents(rows), "").collect()) == [1, 3]


def test_rows_alike_but_in_source_leave_the_first(spark, documents):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, s) for s in ("z", "b", None, "a", "b")] + [(2, text + " more", "a"), (3, None, "a"), (3, None, "b")]
    for some in (rows, rows[::-1]):
        left = corpus_pipeline.near_duplicate_stage(spark, documents(some).repartition(3), "").collect()
        assert sorted((r.doc_id, r.source or "") for r in left) == [(1, ""), (3, "a"), (3, "b")]


def test_repeated_passages_under_400_bytes_go(spark, documents):
    import random

    rng = random.Random(13)
    passage = " ".join(f"w{rng.randrange(10_000, 100_000)}" for _ in range(50))  # 349 bytes
    rows = [(k, f"head {k}\n{passage}\n{k} tail", "a") for k in range(3)] + [(3, passage[:230] + " but shorter", "a")]
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_text_stage(spark, documents(rows), "").collect()}
    assert left == {k: f"head {k}{k} tail" for k in range(3)} | {3: rows[3][1]}


def test_registered_queries_run(spark):
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(names, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))
    assert "AB".translate(LOWER) == "ab"
    small = ("op12_phrase_mining", "op13_conversation_repair")
    for name in ("op2_pivotal_mix", "op3_token_counts", "op9_best_fit_packing", "op11_personal_data", "op12_phrase_mining", "op13_conversation_repair"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() >= (20 if name in small else 200)
