"""Personal data: base spans against plain matching, added spans on forms that base patterns miss."""

import collections
import hashlib
import random
import re
import time

from codestrata.llm import personal_data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def card(rng, n=16, separator=""):
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(n - 2))
    number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
    return separator.join(number[i : i + 4] for i in range(0, n, 4))


def texts():
    rng = random.Random(4)
    alphabet = ["1", "2", "255", "256", "00", "4", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "é", "😀", "\n", "%", "_", "4111 1111 1111 1111", "10.0.0.1", "a@b.cd", "+1 (247) 555-0086"]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    rows += [f"word {card(rng, n, s)} word" for n in range(13, 21) for s in ("", " ", "-", ".")]
    rows += ["a@b.c-d+e@f.g", "a@b@c.d", "x@y..z", "1.2.3.4.5.6.7.8.9", "0001.2.3.4", "1.2.3.4000000000000000000000", "+1234567890 12345", "--1 2-3", None, "", " "]
    return rows


def test_base_spans_against_plain_matching(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, kind string, start int").repartition(3)
    found = personal_data.personal_data(docs)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        wanted = base_spans(rows[r.doc_id])
        kinds = collections.Counter(x.split(":")[0] for x in wanted)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in BASE], rows[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert set(wanted) <= set(filter(None, r.spans.split(",")))


def test_added_spans(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        rows += [f"see user{i}@mail{i % 5}.example.com for it", f"from {rng.randrange(1, 223)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(1, 255)} at noon"]
        rows += [f"the {card(rng)} was used", f"dial +1 (2{i:02d}) 555-{1000 + i} now", f"release 1.2.{i}.{300 + i}", f'token = "52c4f{rng.randrange(10**16, 10**17)}f8446fabf"', f"order 411122223333{4440 + i}9"]
    added = {"write to jane (at) example (dot) com today": "jane (at) example (dot) com", "or john at example dot org": "john at example dot org", "call (247) 555-0086 now": "(247) 555-0086", "from 10[.]20[.]30[.]40 we": "10[.]20[.]30[.]40"}
    clean = ["the cat sat at home. Then dot and all", "release 1.2.3.999", "chapter 10.11.12.1300 of it", "born 1999-2001 or 2002", 'key = "90819894045335504"', "meet at noon.then go", "ab" * 3000]
    rows += [*added, *clean]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    first = {r.doc_id: r.spans for r in personal_data.personal_data(docs).collect()}
    for text, span in added.items():
        at = text.index(span)
        assert first[rows.index(text)].split(":")[1:] == [str(at), str(at + len(span))], (text, first[rows.index(text)])
    assert not any(first[rows.index(t)] for t in clean)
    assert all(s == ",".join(base_spans(rows[i])) for i, s in first.items() if rows[i].startswith(("release", "token", "order")))
    assert {r.doc_id: r.spans for r in personal_data.personal_data(docs.repartition(5)).collect()} == first


def runs(n):
    return ["a" * n, "1" * n, "1 " * (n // 2), "a@b" + ".c" * (n // 2), "+1" * (n // 2), "1." * (n // 2), "4111 1111 1111 1111, " * (n // 20), "+1 (((" + " " * n]


def test_long_texts_repeats_nulls_and_nothing(spark):
    rows = [(1, "mail a@b.cd"), (1, "mail a@b.cd"), (None, "a@b.cd"), (2, None), *((10 + i, t) for i, t in enumerate(runs(3000)))]
    got = personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == collections.Counter((i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows)
    assert personal_data.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts_take_time_in_proportion(spark):
    began = time.time()
    got = personal_data.personal_data(spark.createDataFrame(list(enumerate(runs(300_000))), "doc_id long, text string")).collect()
    assert time.time() - began < 100
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got} == {0: (0,) * 4, 1: (0,) * 4, 2: (0,) * 4, 3: (1, 0, 0, 0), 4: (0,) * 4, 5: (0, 37_500, 0, 0), 6: (0, 0, 15_000, 0), 7: (0,) * 4}


def test_reliabilities_follow_the_labelers():
    table = {"22222": 500, "20222": 20, "00000": 300, "02000": 20, "12121": 50, "10101": 50}
    chance = personal_data.reliabilities(table)
    assert chance["22222"] > 0.95 > 0.8 > chance["10101"] and chance["00000"] < 0.05 and chance["12121"] > 0.8
    assert chance == personal_data.reliabilities(dict(reversed(table.items())))
