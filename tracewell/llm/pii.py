"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are the base spans (fixed patterns with checks) and looser forms (written-out and defanged addresses, national and 00 phone numbers, cards with other
separators, longer internet addresses). Labelers vote on each: the strict pattern, gazetteers (top-level domains, dialling codes, issuer ranges, address
blocks, as tables) and the words before the span. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each
kind; its posteriors train a logistic span classifier on the votes and on features of the span and its surroundings that are no votes, again over counts of
feature patterns, whose weights become a SQL expression. Both fits see only those counts, whose number is bounded by the votes and features, not by the data. Base
spans always stay; the classifier adds looser ones.

Spans are code point offsets, end exclusive. Edge cases: null and empty texts have no spans; the patterns have possessive or
anchored repeats, so very long runs are read once, and places are folded in chunks; overlapping spans of different kinds all count, and redaction covers their
union; repeated rows get equal results; without candidates (an empty table) no classifier is fitted and the base spans are the result; extra columns pass
through redact() and are not read by find_spans().
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Workspace, fresh, once, walked

KINDS = ("email", "ip", "card", "phone")

_NAME, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base patterns. A match begins where its run of characters begins or where the match before it ended, which is the leftmost
#: place; repeats that giving back characters could not help are possessive.
BASE = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: The looser forms of each kind.
LOOSE = {
    "email": [
        rf"(?<!{_NAME}){_NAME}{{1,64}}+ ?(?:\[at\]|\(at\)| at ) ?{_HOST}{{1,63}}+(?: ?(?:\[dot\]|\(dot\)| dot ) ?{_HOST}{{1,63}}+)++",
        rf"(?<!{_NAME}){_NAME}{{1,64}}+@{_HOST}{{1,63}}+(?:\[\.\]{_HOST}{{1,63}}+)++",
    ],
    "ip": [r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])", r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9\[])"],
    "card": [r"(?<![0-9._/-])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/-])"],
    "phone": [r"(?<![0-9+().-])(?<![0-9] )\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"(?<![0-9+().-])00[1-9][0-9]{0,2}(?:[ ().-]{1,2}[0-9]{2,4}){2,5}(?![0-9.-])"],
}
#: What a text must hold for a pattern to be tried.
GATES = {
    "email": lambda t: F.instr(t, "@") > 0, "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9][0-9 -]{14}"), "phone": lambda t: F.instr(t, "+") > 0,
}
LOOSE_GATES = {
    "email": [lambda t: (F.instr(t, "dot") > 0) & (F.instr(t, "at") > 0), lambda t: (F.instr(t, "[.]") > 0) & (F.instr(t, "@") > 0)],
    "ip": [lambda t: (F.instr(t, ":") > 0) & t.rlike(":[0-9a-fA-F]{1,4}:"), lambda t: F.instr(t, "[.]") > 0], "card": [lambda t: t.rlike("[0-9]{4}[._/][0-9]{4}[._/]")],
    "phone": [lambda t: t.rlike("[0-9]{3}[ .-][0-9]{4}"), lambda t: F.instr(t, "00") > 0],
}
#: Characters before a span that the context labeler reads.
CONTEXT = 32
CONTEXT_FOR = {
    "email": "(?i)mail|contact|write|reach|correo|courriel|kontakt", "ip": "(?i)\\bip\\b|host|server|addr|login|from",
    "card": "(?i)card|visa|master|amex|pay|carte|karte|tarjeta|credit", "phone": "(?i)tel|phone|call|fax|mobile|ring|sms|ruf|appel|llam",
}
CONTEXT_AGAINST = r"(?i)version|isbn|order|serial|sku|build|invoice|\bno\.?\s*$|#\s*$"
#: Gazetteers, our own choice of common entries: top-level domains, country calling codes, first digits of issuers (ranges), first parts of address blocks in use.
DOMAINS = (
    "com org net edu gov mil int info biz name pro io dev app me tv co ai eu de fr es uk it nl ch at be se no dk fi pl cz sk hu ro bg gr pt ie lu ee lv lt si hr rs ua ru tr "
    "us ca mx br ar cl au nz jp cn kr in sg hk tw za il ae"
).split()
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 "
    "356 357 358 359 370 371 372 380 381 385 386 420 421 852 886 966 971 972"
).split()
ISSUERS = [("4", "4"), ("51", "55"), ("2221", "2720"), ("34", "34"), ("37", "37"), ("300", "305"), ("36", "36"), ("38", "39"), ("3528", "3589"), ("6011", "6011"), ("62", "62"), ("644", "659"), ("50", "50"), ("56", "58")]
BLOCKS = [(1, 9), (10, 126), (128, 191), (192, 223)]
#: Probability from which a looser candidate is taken.
ACCEPT = 0.8

_SPAN = "array<struct<p:int,s:int,e:int,v:string>>"


def located(df: DataFrame, text: str, name: str, patterns: list[tuple[str, Column]]) -> DataFrame:
    """df with a column of the matches of all patterns (pattern, gate), as an array of (p, s, e, v): p is the number of the pattern. The pieces between a pattern's
    matches give their places by their lengths; one walk over all of them places them."""
    none = F.array().cast("array<string>")
    found = F.array(*(F.when(g, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none) for p, g in patterns))
    df = once(df, _v=found)
    gaps = [F.when(F.size(F.get("_v", F.lit(i))) > 0, F.transform(F.split(F.col(text), p, -1), F.length)).otherwise(F.array().cast("array<int>")) for i, (p, _) in enumerate(patterns)]
    df = once(df, _g=F.array(*gaps))
    steps = F.flatten(F.transform("_v", lambda vs, p: F.transform(vs, lambda v, i: F.struct(p.alias("p"), (i == 0).alias("first"), F.get(F.get("_g", p), i).alias("g"), v.alias("v")))))
    df = once(df, _s=steps)

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        s = F.when(x["first"], 0).otherwise(at) + x["g"]
        e = s + F.length(x["v"])
        return e, F.struct(x["p"].alias("p"), s.alias("s"), e.alias("e"), x["v"].alias("v"))

    spans = F.when(F.size("_s") > 0, walked(F.col("_s"), F.lit(0), place).cast(_SPAN)).otherwise(F.array().cast(_SPAN))
    return once(df, **{name: spans}).drop("_v", "_g", "_s")


def _luhn(v: Column) -> Column:
    digits = F.reverse(F.regexp_replace(v, "[ -]", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str):
    """The check of a base match, as a function of the span."""
    octet = "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x["v"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(octet)),
        "card": lambda x: _luhn(x["v"]),
        "phone": lambda x: F.length(F.regexp_replace(x["v"], "[^0-9]", "")).between(8, 15),
    }[kind]


def _between(low: str, high: str) -> str:
    """A regex of the numbers of len(low) digits from low to high."""
    if low == high:
        return low
    return "(?:" + "|".join(str(n) for n in range(int(low), int(high) + 1)) + ")"


#: The gazetteers as regexes of a span's text (digits only for cards).
KNOWN = {
    "email": rf"(?i)[.\]) ](?:{'|'.join(DOMAINS)})$", "card": rf"^(?:{'|'.join(_between(*r) for r in ISSUERS)})",
    "ip": rf"^(?:[0-9a-fA-F]{{1,4}}:|(?:{'|'.join(str(n) for a, b in BLOCKS for n in range(a, b + 1))})[.\[])",
    "phone": rf"^(?:\+|00)(?:{'|'.join(CALLING)})|^\(?[2-9][0-9]{{2}}\)?[ .-]{{1,2}}[2-9]",
}


def _voted(spans: Column, text: Column) -> Column:
    """Spans (p: their pattern) with kind, votes (1, 0, -1) of the three labelers and features that are no votes (0 or 1)."""
    of = [KINDS.index(k) for k in KINDS] + [KINDS.index(k) for k in KINDS for _ in LOOSE[k]]
    kinds = F.array(*map(F.lit, of))

    def by_kind(k: Column, value: Column, patterns: dict[str, str]) -> Column:
        out = F.lit(False)
        for i, kind in enumerate(KINDS):
            out = F.when(k == i, value.rlike(patterns[kind])).otherwise(out)
        return out

    def one(x: Column) -> Column:
        return F.struct(
            x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["strict"].cast("int").alias("strict"),
            F.when(by_kind(x["k"], x["said"], KNOWN), 1).otherwise(-1).alias("known"),
            F.when(by_kind(x["k"], x["before"], CONTEXT_FOR), 1).when(x["before"].rlike(CONTEXT_AGAINST), -1).otherwise(0).alias("context"),
            flag(F.length(x["v"]) >= 14).alias("long"), flag(x["before"].rlike(r"(^|\n)[ \t]*$")).alias("heads_line"), flag(x["before"].rlike(r"[:=]\s*$")).alias("after_colon"),
            flag(x["after"].rlike(r"[A-Za-z0-9_]")).alias("runs_on"), flag(F.regexp_replace(x["v"], "[^0-9]", "").rlike(r"^([0-9])\1*$")).alias("one_digit"),
        )

    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    with_context = F.transform(spans, lambda x: F.struct(
        F.get(kinds, x["p"]).alias("k"), (x["p"] < len(KINDS)).alias("strict"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"),
        F.when(F.get(kinds, x["p"]) == KINDS.index("card"), F.regexp_replace(x["v"], "[^0-9]", "")).otherwise(x["v"]).alias("said"),
        F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT))).alias("before"), F.substring(text, x["e"] + 1, F.lit(1)).alias("after"),
    ))
    return F.transform(with_context, one)


#: Features of a span that are no votes.
TRAITS = ("long", "heads_line", "after_colon", "runs_on", "one_digit")


def with_candidates(df: DataFrame, text: str, base: str = "base", loose: str = "loose") -> DataFrame:
    """df with its base spans and looser candidates, with votes; looser ones never touch a base span or an earlier looser one of their kind."""
    t, own = fresh(df, "_said"), df.columns
    df = df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    patterns = [(BASE[k], GATES[k](F.col(t))) for k in KINDS]
    patterns += [(p, g(F.col(t))) for k in KINDS for p, g in zip(LOOSE[k], LOOSE_GATES[k])]
    df = located(df, t, "_all", patterns)
    fits = lambda x: reduce(lambda a, i: F.when(x["p"] == i, _valid(KINDS[i])(x)).otherwise(a), range(len(KINDS)), F.lit(True))
    df = once(df, _good=F.when(F.size("_all") > 0, F.filter("_all", fits)).otherwise(F.col("_all")))
    df = once(df, _voted=_voted(F.col("_good"), F.col(t)))
    df = once(df, **{base: F.filter("_voted", lambda x: x["strict"] == 1), "_more": F.filter("_voted", lambda x: x["strict"] == 0)})
    meets = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])
    apart = F.filter("_more", lambda x: ~F.exists(F.col(base), lambda y: meets(x, y)) & ~F.exists(F.col("_more"), lambda y: (y["k"] == x["k"]) & (y["s"] < x["s"]) & meets(x, y)))
    return once(df, **{loose: F.when(F.size("_more") > 0, apart).otherwise(F.col("_more"))}).select(*own, base, loose)


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation over (kind, votes, count): the probability of personal data for each vote pattern. Votes are 1, 0
    or -1; the labelers' reliabilities and the share of true spans are by kind."""
    kinds = {k for k, _, _ in patterns}
    share = dict.fromkeys(kinds, 0.5)
    width = len(patterns[0][1]) if patterns else 0
    # a labeler starts as better than chance
    rate = {(k, j, v, y): p for k in kinds for j in range(width) for v, (p1, p0) in {1: (0.6, 0.2), 0: (0.3, 0.4), -1: (0.1, 0.4)}.items() for y, p in ((1, p1), (0, p0))}
    post: dict = {}
    for _ in range(rounds):
        for k, votes, _ in patterns:
            yes = share[k] * math.prod(rate[k, j, v, 1] for j, v in enumerate(votes))
            no = (1 - share[k]) * math.prod(rate[k, j, v, 0] for j, v in enumerate(votes))
            post[k, votes] = yes / (yes + no)
        for k in kinds:
            own = [(post[k, v], n) for kk, v, n in patterns if kk == k]
            share[k] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for k in kinds:
            for j in range(width):
                for y in (0, 1):
                    # a weak prior keeps a labeler better than chance where a kind has few spans
                    mass = {1: 1.2, 0: 0.6, -1: 0.2} if y else {1: 0.4, 0: 0.8, -1: 0.8}
                    for kk, votes, n in patterns:
                        if kk == k:
                            mass[votes[j]] += n * (post[k, votes] if y else 1 - post[k, votes])
                    total = sum(mass.values())
                    for v, m in mass.items():
                        rate[k, j, v, y] = m / total
    return post


def fit_classifier(rows: list[tuple[list[float], float, int]], steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> list[float]:
    """Logistic weights from (features, soft label, count)."""
    if not rows:
        return []
    weights, total = [0.0] * len(rows[0][0]), float(sum(n for _, _, n in rows))
    for _ in range(steps):
        slope = [l2 * w for w in weights]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x))))))
            for i, v in enumerate(x):
                slope[i] += n / total * (p - y) * v
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return weights


def _features(k: int, strict: int, known: int, context: int, *traits: int) -> list[float]:
    return [1.0, float(strict), float(known), float(context), *map(float, traits), *(float(k == i) for i in range(len(KINDS)))]


def train(spans: DataFrame, column: str) -> list[float]:
    """Classifier weights from a column of voted candidates (array of structs)."""
    names = ("k", "strict", "known", "context", *TRAITS)
    counted = spans.select(F.explode(column).alias("x")).select("x.*").groupBy(*names).count().collect()
    votes: dict = {}
    for r in counted:
        at = (r["k"], (r["known"], r["context"]))
        votes[at] = votes.get(at, 0) + r["count"]
    post = estimate([(k, v, n) for (k, v), n in sorted(votes.items())])
    rows = [(_features(*(r[n] for n in names)), max(post[r["k"], (r["known"], r["context"])], 0.95 * r["strict"]), r["count"]) for r in counted]
    return fit_classifier(sorted(rows))


def accepted(loose: Column, weights: list[float], bound: float = ACCEPT) -> Column:
    """The looser candidates that the classifier takes."""
    if not weights:
        return F.filter(loose, lambda x: F.lit(False))

    def take(x: Column) -> Column:
        parts = [F.lit(1.0), x["strict"], x["known"], x["context"], *(x[t] for t in TRAITS), *((x["k"] == i).cast("int") for i in range(len(KINDS)))]
        margin = reduce(lambda a, b: a + b, (F.lit(w) * p for w, p in zip(weights, parts)))
        return margin >= math.log(bound / (1 - bound))

    return F.filter(loose, take)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, by kind as listed, then start."""
    names = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, base and added (arrays of spans with kind index k, start s and end e)."""
    space = Workspace(df.sparkSession, "pii")
    own = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    slim = space.save("spans", with_candidates(own, "_text").drop("_text"))
    weights = train(slim.select(F.concat("base", "loose").alias("all")), "all")
    return slim.select(F.col("_id").alias(key), "base", accepted(F.col("loose"), weights).alias("added"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span of personal data in the text replaced by its kind in brackets. Null texts stay null."""
    space = Workspace(df.sparkSession, "redact")
    seen = with_candidates(df.select(F.col(text).alias("_t")), "_t").drop("_t").where("size(base) + size(loose) > 0")
    weights = train(space.save("spans", seen).select(F.concat("base", "loose").alias("all")), "all")
    b, l, p = fresh(df, "_base"), fresh(df, "_loose"), fresh(df, "_pieces")
    rows = with_candidates(df, text, b, l)
    order = F.array_sort(F.transform(F.concat(F.col(b), accepted(F.col(l), weights)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    rows = once(rows, **{p: order})
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def piece(at: Column, x: Column) -> tuple[Column, Column]:  # what stands before a span, unless an earlier one covers it
        return F.greatest(at, x["e"]), F.struct(at.alias("from"), F.when(x["s"] >= at, x["s"] - at).alias("n"), x["k"].alias("k"), F.greatest(at, x["e"]).alias("to"))

    q = fresh(rows, "_walk")
    rows = once(rows, **{q: F.when(F.size(p) > 0, walked(F.col(p), F.lit(0), piece))})
    said = F.transform(F.filter(F.col(q), lambda x: x["n"].isNotNull()), lambda x: F.concat(F.substring(F.col(text), x["from"] + 1, x["n"]), F.element_at(names, x["k"] + 1)))
    end = F.array_max(F.transform(F.col(q), lambda x: x["to"]))
    clean = F.when(F.size(p) > 0, F.concat(F.array_join(said, ""), F.substring(F.col(text), end + 1, F.length(F.col(text))))).otherwise(F.col(text))
    return rows.withColumn(text, clean).select(*df.columns)
