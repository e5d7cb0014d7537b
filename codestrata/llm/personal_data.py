"""Personal data in texts by weak supervision (DataFrame functions only).

Four kinds have a base pattern, whose valid matches always count. Wider patterns
and the base matches that fail their check are candidates: labelers that read the
string (pattern, checksum), lists (endings, prefixes) and the words around vote on
each, expectation-maximisation estimates how far each labeler is right, and a
logistic classifier over the shape and surroundings of a span learns from the
resulting probabilities which candidates are added.

Patterns start only where a run of their characters starts and never step back,
so a text of one endless run takes time in proportion to its length. Votes and
features are a few bits a span; only tables of distinct bits reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: A dot is part of a domain if a letter, digit or hyphen follows; a blank or hyphen of a card if a digit does.
_DOMAIN = rf"[{_HOST}]++\.(?=[{_HOST}])(?:(?!\.(?![{_HOST}]))[{_HOST}.])++"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_DOMAIN}",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?", r"\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?"
WIDE = {
    "email": rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+(?:{_AT}[{_HOST}]{{1,63}}+(?:(?:{_DOT}|\x20dot\x20|\.)[{_HOST}]{{2,63}}+){{1,5}}+|\x20at\x20[{_HOST}]{{1,63}}+(?:(?:{_DOT}|\x20dot\x20)[{_HOST}]{{2,63}}+){{1,5}}+)",
    "ip": rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:(?:{_DOT}|\x20dot\x20|\.)[0-9]{{1,3}}+){{3}}+(?![0-9])|(?<![0-9a-f:])(?:[0-9a-f]{{1,4}}+:){{7}}+[0-9a-f]{{1,4}}+(?![0-9a-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}+[0-9]{4}){3}+(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}+[\x20.-])?+(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words before a span that speak for a kind, in the languages at hand, and such as speak against all.
CUES = {
    "email": "e-?mail|mail|contact|correo|courriel|kontakt",
    "ip": "ip|host|server|address|login|adresse|direcci",
    "card": "card|visa|credit|payment|tarjeta|carte|karte",
    "phone": "phone|tel|call|fax|mobile|tel.f|appel|anruf|llam",
}
AGAINST = "version|release|chapter|section|isbn|issn|doi|sha|hash|token|order|serial|build|invoice|page|figure"
_ENDINGS = "com|org|net|edu|gov|mil|int|info|io|dev|app|co|ai|de|fr|es|uk|eu|us|ca|ch|at|it|nl|be|pl|pt|se|no|dk|fi|ie|jp|cn|in|br|au|mx|ar|ru"
#: Characters of a text that are read before and behind a span.
BEFORE, BEHIND = 40, 8
ROUNDS, STEPS, RATE = 40, 400, 1.0
THRESHOLD = 0.7
LABELERS = ("pattern", "check", "list", "words", "edges")
FEATURES = ("dense", "marked", "cue", "against", "inside", "listed", "checked", "repeated")


def _matches(text: Column, kind: str, pattern: str, wide: bool) -> Column:
    """The matches of a pattern with what lies before and behind each: ``gap`` code points since the last one."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def one(pair: Column, behind: Column) -> Column:
        m, before = pair["match"], pair["before"]
        fields = {"gap": F.length(before).cast("long"), "size": F.length(m).cast("long"), "match": m, "before": F.right(before, F.lit(BEFORE)), "behind": F.left(behind, F.lit(BEHIND))}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    # Zipped: inside a lambda the text would be split anew for every match.
    pairs = F.zip_with(found, pieces, lambda m, before: F.struct(m.alias("match"), before.alias("before")))
    each = F.filter(F.zip_with(pairs, F.slice(pieces, 2, 1 << 30), one), lambda x: x["match"].isNotNull())
    entry = F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(wide).alias("wide"), each.alias("found"))
    return F.when(F.size(found) > 0, entry)


def matches(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, hits``: each row of ``docs`` with the matches of all patterns in its text, in one scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # One scan for a digit spares most texts the patterns that need one.
    digit, at = F.col("__digit"), F.col("__text").contains("@")
    asked = [(k, p, False) for k, p in BASE.items()] + [(k, p, True) for k, p in WIDE.items()]
    rows = docs.select("doc_id", text.alias("__text"), text.rlike("[0-9]").alias("__digit"))
    each = [F.when(at if k == "email" and not wide else F.lit(True) if k == "email" else digit, _matches(F.col("__text"), k, p, wide)) for k, p, wide in asked]
    return rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.array_compact(F.array(*each)).alias("hits"))


def _digits(c: str = "match") -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1)) * d.cast("int"))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _by_kind(**columns: Column) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == KINDS.index(k), c) for k, c in columns.items()])


def _checked() -> Column:
    n = F.length(_digits())
    return _by_kind(
        email=F.lit(True),
        ip=F.coalesce(F.regexp_replace("match", r"(?i)[^0-9a-f:]+", ".").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$|:"), F.lit(False)),
        # Only of strings that can pass: a run of digits may be as long as a text.
        card=F.when(n.between(14, 19), luhn(_digits())).otherwise(False),
        phone=n.between(10, 15),
    )


def placed(found: DataFrame) -> DataFrame:
    """``rid, kind, wide, start, end, match, before, behind, checked``: a row for each match; offsets in code points, the end exclusive."""
    each = found.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.kind", "hit.wide", F.posexplode("hit.found").alias("i", "x")).select("rid", "kind", "wide", "i", "x.*")
    done = Window.partitionBy("rid", "kind", "wide").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(done)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    return each.select("rid", "kind", "wide", "start", "end", "match", "before", "behind", _checked().alias("checked"))


def candidates(spans: DataFrame) -> DataFrame:
    """Base spans, and other spans that overlap none of them."""
    base = ~F.col("wide") & F.col("checked")
    rows = spans.withColumn("base", base)
    left = Window.partitionBy("rid").orderBy("start", F.desc("base"))
    right = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("base"))
    rows = rows.withColumns({"__until": F.max(F.when(F.col("base"), F.col("end"))).over(left), "__from": F.min(F.when(F.col("base"), F.col("start"))).over(right)})
    free = (F.coalesce("__until", F.lit(0)) <= F.col("start")) & (F.coalesce("__from", F.col("end")) >= F.col("end"))
    rows = rows.where(F.col("base") | free).drop("__until", "__from")
    # A failed base match and a wide one may be the same string: the wide one stays.
    same = Window.partitionBy("rid", "kind", "start", "end").orderBy(F.desc("wide"))
    return rows.withColumn("__same", F.row_number().over(same)).where("__same = 1").drop("__same")


def voted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``votes`` (a digit for each labeler: 0 against, 1 none, 2 for) and ``bits`` (a bit for each feature)."""
    digits, before = _digits(), F.lower("before")
    cue = _by_kind(**{k: before.rlike(rf"\b(?:{c})[^\n]{{0,20}}$") for k, c in CUES.items()})
    against = before.rlike(rf"\b(?:{AGAINST})[^\n]{{0,12}}$|[=#/]\x20?[\"']?$")
    inside = before.rlike(r"[\p{L}\p{N}_]$") | F.col("behind").rlike(r"^[\p{L}\p{N}_]")
    repeated = digits.rlike(r"([0-9])\1{6}|01234567|98765432|^0+$")
    tail = F.lower(F.regexp_extract("match", r"([A-Za-z0-9-]+)$", 1))
    listed = _by_kind(
        email=tail.rlike(f"^(?:{_ENDINGS})$"),
        ip=~F.col("match").rlike(r"^(?:0|127|255)[^0-9]") & ~F.col("match").rlike(r"[^0-9](?:0|255)$"),
        card=digits.rlike("^(?:3[0-9]|4|5[1-5]|2[2-7]|6)"),
        phone=F.col("match").rlike(r"^\+") | digits.rlike(r"^(?:00[1-9]|[2-9][0-9]{2}[2-9])"),
    )
    given = F.when(F.col("base"), 2).when(~F.col("wide"), 0).otherwise(1)
    votes = {
        "pattern": given,
        "check": F.when(F.col("kind") == 0, 1).when(F.col("checked"), 2).otherwise(0),
        "list": F.when(repeated, 0).when(listed, 2).otherwise(0),
        "words": F.when(against, 0).when(cue, 2).otherwise(1),
        "edges": F.when(inside, 0).otherwise(2),
    }
    marked = F.col("match").rlike(r"[\[({]|(?i)\x20dot\x20")
    features = {"dense": ~F.col("match").rlike(r"[^0-9]"), "marked": marked, "cue": cue, "against": against, "inside": inside, "listed": listed, "checked": F.col("checked"), "repeated": repeated}
    bits = reduce(add, [F.coalesce(features[name], F.lit(False)).cast("int") * (1 << j) for j, name in enumerate(FEATURES)])
    return rows.withColumns({"votes": F.concat(*[votes[name].cast("string") for name in LABELERS]), "bits": bits})


def reliabilities(table: dict[str, int]) -> dict[str, float]:
    """Probability that a span with these votes is personal data, by expectation-maximisation over the counts of vote patterns.

    Each labeler is right with its own probability for either class; a vote of 1
    says nothing. One count of each vote is added, so nothing is certain. The
    start is the share of votes for; the order of ``table`` does not matter.
    """
    keys = sorted(table)
    weight = [table[k] for k in keys]
    yes = [(1 + k.count("2")) / (2 + k.count("2") + k.count("0")) for k in keys]
    for _ in range(ROUNDS):
        prior = (1 + math.fsum(w * p for w, p in zip(weight, yes))) / (2 + sum(weight))
        odds = []
        for j in range(len(LABELERS)):
            share = {}
            for vote in "02":
                # A labeler is held to be right three times in four before any count.
                share[vote] = [(1.5 if (vote == "2") == good else 0.5) + math.fsum(w * (p if good else 1 - p) for k, w, p in zip(keys, weight, yes) if k[j] == vote) for good in (True, False)]
            total = [share["0"][c] + share["2"][c] for c in (0, 1)]
            odds.append({v: math.log(share[v][0] / total[0]) - math.log(share[v][1] / total[1]) for v in "02"})
        now = []
        for k in keys:
            x = math.log(prior / (1 - prior)) + math.fsum(odds[j][v] for j, v in enumerate(k) if v != "1")
            now.append(1 / (1 + math.exp(-max(-60.0, min(60.0, x)))))
        yes = now
    return dict(zip(keys, yes))


def fitted(table: dict[int, tuple[int, float]]) -> list[float]:
    """Weights of a logistic classifier (the last is the constant) over feature bits with their count and sum of probabilities.

    Full gradient steps over the table of distinct bits, at most 2 to the number of
    features rows, with a small pull towards 0.
    """
    n, rows = len(FEATURES), sorted(table.items())
    weights, total = [0.0] * (n + 1), sum(count for count, _ in table.values()) or 1
    on = [[j for j in range(n) if bits >> j & 1] + [n] for bits, _ in rows]
    for _ in range(STEPS):
        slope = [1e-3 * w for w in weights]
        for places, (_, (count, good)) in zip(on, rows):
            x = math.fsum(weights[j] for j in places)
            miss = (count / (1 + math.exp(-max(-60.0, min(60.0, x)))) - good) / total
            for j in places:
                slope[j] += miss
        weights = [w - RATE * s for w, s in zip(weights, slope)]
    return weights


def learned(rows: DataFrame) -> list[list[float]]:
    """The classifier's weights for each kind. What reaches the driver are counts of distinct votes and bits: at most 4 * 3**5 * 2**8 rows."""
    counts = rows.groupBy("kind", "votes", "bits").agg(F.count("*").alias("n")).collect()
    out = []
    for kind in range(len(KINDS)):
        votes: dict[str, int] = {}
        for r in (r for r in counts if r["kind"] == kind):
            votes[r["votes"]] = votes.get(r["votes"], 0) + r["n"]
        chance = reliabilities(votes)
        sums: dict[int, list[tuple[int, float]]] = {}
        for r in (r for r in counts if r["kind"] == kind):
            sums.setdefault(r["bits"], []).append((r["n"], r["n"] * chance[r["votes"]]))
        out.append(fitted({b: (sum(n for n, _ in x), math.fsum(g for _, g in x)) for b, x in sums.items()}))
    return out


def scored(rows: DataFrame, weights: list[list[float]]) -> DataFrame:
    """``rows`` with ``chance``, the classifier's probability."""
    table = F.array(*[F.array(*[F.lit(x) for x in w]) for w in weights])
    own = F.get(table, F.col("kind"))
    on = [F.get(own, F.lit(j)) * F.col("bits").bitwiseAND(F.lit(1 << j)).cast("boolean").cast("double") for j in range(len(FEATURES))]
    return rows.withColumn("chance", 1 / (1 + F.exp(-reduce(add, on, F.get(own, F.lit(len(FEATURES)))))))


def _listed(which: Column) -> Column:
    """The spans of a document as text, by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.sort_array(F.collect_list(F.when(which, F.struct("start", "kind", "end"))))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: a row for each row of ``docs``.

    Counts and hash are of the base spans; ``spans`` has these and the added ones.
    A null or empty text has none, and a null id is kept; repeated rows count each; a
    very long text is read whole; candidates alike in votes and features are judged
    alike, and one on the threshold is added. Other columns are ignored. An empty
    table gives an empty result.
    """
    found = stored(matches(docs), "personal-matches")
    rows = stored(voted(candidates(placed(found.where(F.size("hits") > 0)))), "personal-candidates")
    rows = scored(rows, learned(rows))
    base = F.col("base")
    counts = [F.count(F.when(base & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = rows.groupBy(F.col("rid").alias("r")).agg(*counts, _listed(base).alias("base_spans"), _listed(base | (F.col("chance") >= F.lit(threshold))).alias("spans"))
    out = found.select("rid", "doc_id").join(spans, F.col("rid") == F.col("r"), "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))
