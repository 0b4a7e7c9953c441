"""Personal data and secrets by weak supervision, in DataFrame expressions only.

Patterns propose spans. Labelers (form, validity, gazetteer, context before, context after, placement) vote on each
span: personal (1), not (-1) or no opinion (0). Expectation-maximisation over the counts of equal votes estimates
how reliable each labeler is, without labels; its soft labels train a logistic span classifier, which looks at the
span itself and at what stands around it (kind, length, mix of characters, neighbours, cue words), not at the votes.
Spans of the four base kinds always stay; spans of the further kinds stay if the classifier gives them KEEP or more.

Only counts of votes and features reach the driver: at most len(KINDS) * 3 ** len(VOTES) * FEATURES rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import materialize

BASE = ("email", "ip", "card", "phone")
FURTHER = ("obfuscated_email", "local_phone", "national_id", "iban", "person", "secret")
KINDS = (*BASE, *FURTHER)
VOTES = ("form", "valid", "gazetteer", "before", "after", "placed")
KEEP = 0.5
ROUNDS, STEPS, RATE = 60, 400, 1.0
#: Characters looked at before and after a span, within the gap to its neighbours of the same kind; lengths summed at once.
WINDOW, AFTER, LOT = 32, 8, 64
#: Classes of a span's features: length, digits, character before, character after, cue word before.
CLASSES = (4, 4, 5, 4, 3)
FEATURES = math.prod(CLASSES)

# Possessive quantifiers and \G keep each scan linear and free of recursion; they match what the plain patterns
# match: a match never begins inside a run whose beginning failed, unless an earlier match ended there.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "obfuscated_email": r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63} ?[\[({]at[\])}] ?[a-z0-9-]{1,63}(?: ?[\[({]dot[\])}] ?[a-z0-9-]{1,63}){1,8}",
    "local_phone": r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[ .-])(?<![0-9][ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30}){0,2}",
    # tokens run to their end, whatever their length; a key's block runs to its END line, or as far as its characters are base64's
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|\bgh[opsur]_[0-9A-Za-z]{36,}+|\bxox[abprs]-[0-9A-Za-z-]{10,}+|\bsk-[0-9A-Za-z_-]{20,}+|\beyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+"
              r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[\r\n]++(?:Proc-Type|DEK-Info): [^\r\n]++){0,4}+[0-9A-Za-z+/=\r\n]*+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
              r"|(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)[\x22']?[\x20]?[:=]{1,2}[\x20]?[\x22']?)[0-9A-Za-z+/_.~-]{8,}+",
}
# A cheap test that holds whenever the pattern matches anywhere.
HINTS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.instr(t, "+") > 0,
    "obfuscated_email": lambda t: t.rlike(r"(?i)[\[({]at[\])}]"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}"),
    "national_id": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "person": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}"),
    "secret": lambda t: t.rlike(r"A[KS]IA[0-9A-Z]|gh[opsur]_|xox[abprs]-|sk-|eyJ|PRIVATE KEY|(?i:token|secret|password|passwd|pwd|key)[\x22']?[\x20]?[:=]"),
}

# Gazetteers and cue words.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91")
CARD_BEGINNINGS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "2")
KEY_BEGINNINGS = r"AKIA|ASIA|gh[opsur]_|xox[abprs]-|sk-|eyJ|-----BEGIN"
COUNTRIES = ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PL", "PT", "IE", "SE", "DK", "NO", "FI")
GIVEN_NAMES = ("James", "Mary", "John", "Anna", "Peter", "Maria", "Paul", "Laura", "Thomas", "Julia", "Michael", "Sarah", "Jean", "Marie", "Pierre", "Hans", "Carlos", "Ana", "Jose", "Carmen")
BEFORE = r"(?i)(e-?mail|mail|contact|phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone|address|adresse|server|host|client|login|card|visa|account|konto|iban|ssn|social security|name|patient|customer)[^\p{L}0-9]{0,4}\P{L}{0,8}$"
AGAINST = r"(?i)(version|release|section|chapter|fig|table|isbn|issn|order|no|nr|page|v)[.:# ]{0,2}$"


SPAN = "struct<s:int,e:int,m:string,head:string,tail:string>"


def running(lengths: Column) -> Column:
    """The sums of the elements before each one: LOT at a time, as a step of an aggregate copies the array it has."""
    lots = F.sequence(F.lit(0), F.floor(F.size(lengths) / LOT).cast("int"))

    def sums(of: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(of, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def lot(i: Column) -> Column:
        return F.slice(lengths, i * LOT + 1, F.lit(LOT))

    whole = F.transform(lots, lambda i: F.aggregate(lot(i), F.lit(0), lambda a, n: a + n))
    return F.flatten(F.transform(F.arrays_zip(lots.alias("i"), sums(whole, F.lit(0)).alias("at")), lambda x: sums(lot(x["i"]), x["at"])))


def matches(text: Column, kind: str) -> Column:
    """array<SPAN> of a kind's leftmost non-overlapping matches; places in code points, end exclusive; head and tail as far as the gaps go."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(gaps.alias("g"), found.alias("m"), running(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))).alias("at"),
                          F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("next"))
    spans = F.transform(F.filter(pieces, lambda x: x["m"].isNotNull()), lambda x: F.struct(
        (x["at"] + F.length(x["g"])).alias("s"), (x["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(WINDOW)).alias("head"), F.left(x["next"], F.lit(AFTER)).alias("tail")))
    return F.when(HINTS[kind](text), F.filter(spans, lambda x: stands(x["m"], kind))).otherwise(F.array().cast(f"array<{SPAN}>"))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits fits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def stands(m: Column, kind: str) -> Column:
    """What a match must fulfil besides the pattern."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?$"))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def votes(x: Column, kind: str) -> Column:
    """The labelers' votes on a span, as one integer in base 3 (digit 0: no opinion, 1: personal, 2: not)."""
    m, head, tail = x["m"], x["head"], x["tail"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    yes, no, none = F.lit(1), F.lit(2), F.lit(0)

    def when(c, a=yes, b=none):
        return F.when(c, a).otherwise(b)

    form = {
        "email": when(m.rlike(r"^[A-Za-z0-9][^@]{0,63}@[^@]{3,253}\.[A-Za-z]{2,24}$"), yes, no),
        "ip": when(m.rlike(r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"), yes, no),
        "card": when(m.rlike(r"^(?:[0-9]{4}[ -]?){4,5}"), yes, no),
        "phone": when(m.rlike(r"^\+[0-9]{1,3}[ (.-]"), yes, none),
        "person": when(m.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}"), yes, none),
        "secret": when(m.rlike(r"[0-9]") & m.rlike(r"[A-Za-z]{2}"), yes, no),
    }.get(kind, none)
    valid = {
        "ip": when(m.rlike(r"^(?:0|127|255)\."), no, yes),
        "card": when(digits.rlike(r"^([0-9])\1*$"), no, yes),
        "phone": when(F.length(digits) >= 10, yes, none),
        "national_id": when(m.rlike(r"^(?:000|666|9)|-00-|-0000$"), no, yes),
        "iban": when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), yes, no),
        "obfuscated_email": when(F.lower(m).rlike(r"dot[\])}] ?[a-z]{2,24}$"), yes, no),
        "secret": when(F.regexp_extract(m, r"([0-9A-Za-z+/_.~-]+)$", 1).rlike(r"^(?=.{16})(?!.*(.)\1{7})"), yes, no),
    }.get(kind, none)
    gazetteer = {
        "email": when(F.lower(F.substring_index(m, ".", -1)).isin(*DOMAINS), yes, none),
        "obfuscated_email": when(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), yes, no),
        "phone": when(F.regexp_extract(m, r"^\+([0-9]+)", 1).isin(*CALLING_CODES), yes, none),
        "card": when(digits.rlike("^(?:" + "|".join(CARD_BEGINNINGS) + ")"), yes, no),
        "iban": when(F.substring(m, 1, 2).isin(*COUNTRIES), yes, no),
        "person": when(m.rlike(r"\b(?:" + "|".join(GIVEN_NAMES) + r")\b"), yes, none),
        "secret": when(m.rlike(KEY_BEGINNINGS), yes, none),
    }.get(kind, none)
    before = F.when(head.rlike(BEFORE), yes).when(head.rlike(AGAINST), no).otherwise(none)
    after = F.when(tail.rlike(r"^[%€$£]|^[.][0-9]"), no).otherwise(none)
    placed = F.when(head.rlike(r"[\p{L}0-9_]$") | tail.rlike(r"^[\p{L}0-9_]"), no).otherwise(when(head.rlike(r"(^|[\s:<(\[,;])$"), yes, none))
    total = F.lit(0)
    for v in (form, valid, gazetteer, before, after, placed):
        total = total * 3 + v
    return total


def features(x: Column) -> Column:
    """The span's own look and its surroundings as one integer, mixed from CLASSES."""
    m, head, tail = x["m"], x["head"], x["tail"]
    length, digits = F.length(m), F.length(F.regexp_replace(m, "[^0-9]", ""))
    size = F.when(length < 12, 0).when(length < 20, 1).when(length < 40, 2).otherwise(3)
    mix = F.when(digits == 0, 0).when(digits * 2 < length, 1).when(digits < length, 2).otherwise(3)
    before = F.when(head == "", 0).when(head.rlike(r"\s$"), 1).when(head.rlike(r"[:=\x22'(<\[]$"), 2).when(head.rlike(r"[\p{L}0-9_]$"), 3).otherwise(4)
    after = F.when(F.coalesce(tail, F.lit("")) == "", 0).when(tail.rlike(r"^\s"), 1).when(tail.rlike(r"^[\p{L}0-9_]"), 2).otherwise(3)
    cue = F.when(head.rlike(BEFORE), 1).when(head.rlike(AGAINST), 2).otherwise(0)
    total = F.lit(0)
    for f, n in zip((size, mix, before, after, cue), CLASSES):
        total = total * n + f
    return total


def propose(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans array<struct<k, s, e, v, f>>): candidate spans of each row in the order of KINDS, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def span(k: int, kind: str):
        return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), votes(x, kind).alias("v"), features(x).alias("f"))

    spans = [F.transform(matches(text, kind), span(k, kind)) for k, kind in enumerate(KINDS)]
    return docs.select(F.col(id_col).alias("id"), F.concat(*spans).alias("spans"))


def _digits(v: int) -> list[int]:
    out = []
    for _ in VOTES:
        v, d = divmod(v, 3)
        out.append(d)
    return out[::-1]


def reliabilities(patterns: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """Probability that a span of (kind, votes) is personal, by EM over (kind, votes, count).

    Each labeler has a table P(vote | personal or not), each kind a share of personal spans; the start trusts
    every labeler a little.
    """
    share = {k: 0.7 for k, _, _ in patterns}
    tables = [[[0.5, 0.1, 0.4], [0.5, 0.4, 0.1]] for _ in VOTES]  # [not, personal][vote]
    soft: dict[tuple[int, int], float] = {}
    for _ in range(ROUNDS):
        for k, v, _ in patterns:
            odds = math.log(share[k] / (1 - share[k])) + sum(math.log(t[1][d] / t[0][d]) for t, d in zip(tables, _digits(v)))
            soft[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        counts = [[[1.0] * 3, [1.0] * 3] for _ in VOTES]
        per_kind: dict[int, list[float]] = {}
        for k, v, n in patterns:
            p = soft[k, v]
            s = per_kind.setdefault(k, [1.0, 2.0])
            s[0] += n * p
            s[1] += n
            for c, d in zip(counts, _digits(v)):
                c[1][d] += n * p
                c[0][d] += n * (1 - p)
        tables = [[[x / sum(row) for x in row] for row in c] for c in counts]
        share = {k: a / b for k, (a, b) in per_kind.items()}
    return soft


def looks(k: int, f: int) -> list[tuple]:
    """The classifier's active features of a span of kind k: the kind, and each class of f by kind."""
    out = [("kind", k)]
    for j in reversed(range(len(CLASSES))):
        f, c = divmod(f, CLASSES[j])
        out.append(("look", k, j, c))
    return out


def train(patterns: list[tuple[int, int, int, int]]) -> dict[tuple, float]:
    """Weights of the span classifier by logistic regression on EM's soft labels, from (kind, votes, features, count)."""
    by_votes: dict[tuple[int, int], int] = {}
    for k, v, _, n in patterns:
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    soft = reliabilities([(k, v, n) for (k, v), n in by_votes.items()])
    mass: dict[tuple[int, int], list[float]] = {}
    for k, v, f, n in patterns:
        m = mass.setdefault((k, f), [0.0, 0.0])
        m[0] += n * soft[k, v]
        m[1] += n
    per_kind = {k: sum(n for (j, _), (_, n) in mass.items() if j == k) for k, _ in mass}
    weights = {x: 0.0 for k, f in mass for x in looks(k, f)}
    for _ in range(STEPS):
        slope = {x: -1e-4 * w for x, w in weights.items()}
        for (k, f), (p, n) in mass.items():
            got = p - n * probability(k, f, weights)
            for x in looks(k, f):
                slope[x] += got / per_kind[k]  # kinds share no feature, so each learns at its own scale
        for x, s in slope.items():
            weights[x] += RATE * s
    return weights


def probability(k: int, f: int, weights: dict[tuple, float]) -> float:
    total = sum(weights.get(x, 0.0) for x in looks(k, f))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and spans, array<struct<kind string, s int, e int>>.

    Places are code points, end exclusive, ordered by kind and start. Null and empty texts have no spans; repeated
    rows are searched alike and count again in training; no rows give no rows; other columns are ignored, whatever
    their names. The work grows with a text's length, however many spans it holds.
    """
    found = materialize(propose(docs, id_col, text_col))
    patterns = found.select(F.explode("spans").alias("x")).groupBy("x.k", "x.v", "x.f").count().orderBy("k", "v", "f").collect()
    weights = train([(r["k"], r["v"], r["f"], r["count"]) for r in patterns])
    # the kept (kind, features) as a constant list: no more than there are
    fine = sorted({k * FEATURES + f for k, f in {(r["k"], r["f"]) for r in patterns} if k >= len(BASE) and probability(k, f, weights) >= KEEP})
    names = F.lit(list(KINDS))
    keep = F.filter("spans", lambda x: (x["k"] < len(BASE)) | ((x["k"] * FEATURES + x["f"]).isin(fine) if fine else F.lit(False)))
    return found.select(F.col("id").alias(id_col), F.transform(keep, lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (string) of find_pii; then n_secret and n_spans (all spans)."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def of(kind: str):
        return lambda x: x["kind"] == kind

    counts = [F.size(F.filter("spans", of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return find_pii(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                                 F.size(F.filter("spans", of("secret"))).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))
