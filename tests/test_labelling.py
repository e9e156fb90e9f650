"""Labelling functions, rules, verbs and spans against plain Python."""

import collections
import re

from pyspark.sql import functions as F

from tracewell.operators import labelling


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, before = [0], row
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[-1], before[j + 1]))
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


LEXICON = [
    ("DATA", "special", "credential"), ("DATA", "keyword", "system information"), ("DATA", "keyword", "file"), ("DATA", "regex", r"\bcreds?\b"), ("USER", "keyword", "user"),
    ("USER", "special", "local administrator account"), ("FUNCTION", "regex", r"\w+\(\)"), ("FUNCTION", "keyword", "api call"), ("DIRECTORY", "regex", r"[a-z]:\\"), ("DIRECTORY", "special", "%temp%"),
    ("REGISTRY", "regex", r"^hk(lm|cu)"), ("REGISTRY", "keyword", "registry key"), ("NETWORK", "keyword", "internationalization"), ("OTHER", "keyword", "thing"), ("OTHER", "regex", "(broken"),
    ("ACTOR", "special", "group"), ("ENCRYPTION", "keyword", "group"), ("ENCRYPTION", "regex", "aes"),
]
PHRASES = [
    "the credential", "stolen credentials", "Credential", "the  system information", "system informations", "systems information", "a file", "GetFile() file", "some user", "users", "aes file",
    "c:\\temp\\x", "HKLM\\Software c:\\x", "net  c:\\a", "a c:\\b.exe", "DIRECTORY3", "the REGISTRY4 key", "registry key", "internationalisation", "thing", "group", "threat actor thing",
    "local administrator accounts", "the attacker", "ENTITY1", "cred", "", "   ", None, "vunerabilities", "word " * 400 + "credential",
]


def plain_label(phrase):
    if phrase is None or not phrase.strip():
        return "OTHER"

    def term(kinds, label):
        low, words = phrase.lower(), phrase.lower().split()
        for lab, kind, t in LEXICON:
            k = len(t.split())
            if (lab, kind) == (label, kinds) and len(words) >= k:
                focus = low if len(words) == k else " ".join(words[-k:])
                if ratio(focus, t) > (0.95 if k == 1 else 0.9):
                    return True
        return False

    def regex(label):
        return any(re.search(t, phrase, re.I) for lab, kind, t in LEXICON if (lab, kind) == (label, "regex") and t != "(broken")

    score = collections.Counter()
    for label in labelling.LABELS:
        named = label in ("DIRECTORY", "REGISTRY") and label in phrase
        special, keyword, found = term("special", label), term("keyword", label), regex(label)
        if label == "DIRECTORY":
            found = not any(re.search(p, phrase, re.I) for p in labelling.NO_DIRECTORY) and not phrase.endswith(".exe") and (named or found)
        if label == "DATA" and (re.search(labelling.NO_DATA, phrase, re.I) and any(map(regex, ("FUNCTION", "REGISTRY", "ENCRYPTION"))) or phrase.endswith(("user", "users"))):
            keyword = False
        elif named:
            keyword = True
        score[label] = (named or special) + special + found + keyword
    top = [x for x, n in score.items() if n == max(score.values()) and n]
    label = top[0] if len(top) == 1 else "OTHER"
    for name in ("REGISTRY", "ENCRYPTION", "DIRECTORY", "NETWORK", "FUNCTION", "DATA"):
        if name in phrase:
            return name
    low, last = phrase.lower(), phrase.split()[-1].lower()
    return "ACTOR" if "threat actor" in low or "actor" in last or "attacker" in last else "VULNERABILITY" if "vunerabili" in low else label


def test_label_phrases(spark):
    lexicon = spark.createDataFrame(LEXICON, "label string, kind string, term string")
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(PHRASES)] + [(99, "thing", "x")], "id int, phrase string, votes string")
    got = {r.id: r.label for r in labelling.label_phrases(df, lexicon).collect()}
    assert got == {i: plain_label(p) for i, p in enumerate(PHRASES)} | {99: plain_label("thing")}
    assert len(set(got.values())) > 7
    assert {r.label for r in labelling.label_phrases(df.where("id = 19"), lexicon.limit(0)).collect()} == {"OTHER"}
    assert labelling.label_phrases(df.limit(0), lexicon).count() == 0


def test_routing(spark):
    rows = [("A", "strong_regex_1", "x"), ("A", "my special", "y"), ("A", "verbs", "z"), ("A", "strong_special", "w"), ("A", "verbs", None)]
    got = labelling.routed(spark.createDataFrame(rows, "label string, key string, term string"))
    assert sorted((r.kind, r.term) for r in got.collect()) == [("keyword", "z"), ("regex", "x"), ("special", "w"), ("special", "y"), ("strong_regex", "x"), ("strong_special", "w")]


def test_verbs(spark):
    groups = {"delete": ["delete", "erase"], "hide": ["hide"], "use": ["use", "run"]}
    rows = [(["erase"], ["delete"]), (["erase"], ["use"]), (["run"], ["use"]), ([], ["use"]), (["hide"], ["hide", "erase"]), (["go"], ["go"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select(labelling.strong_verbs(df.a, groups, ["delete", "hide"]).alias("s"), labelling.strong_mismatch(df.a, df.b, groups, ["delete", "hide"]).alias("m"), labelling.similar_verbs(df.a, df.b, groups).alias("v")).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (True, True, False), (False, False, True), (False, False, False), (True, True, True), (False, False, True)]


def test_spans(spark):
    lexicon = spark.createDataFrame([("DIRECTORY", "strong_special", "C:\\Win"), ("DIRECTORY", "strong_regex", r"c:\\win\\\w+"), ("NETWORK", "strong_regex", r"\d+\.\d+")], "label string, kind string, term string")
    df = spark.createDataFrame([(1, "at C:\\Win\\x and 1.2 or 1.25"), (2, ""), (3, None), (4, "aC:\\Win z")], "id int, t string")
    got = sorted((r.id, r.s, r.e, r.label) for r in labelling.special_spans(df, lexicon, "id", "t").collect())
    assert got == [(1, 3, 11, "DIRECTORY"), (1, 16, 19, "NETWORK"), (1, 23, 27, "NETWORK")]


def test_event_labels(spark):
    events = spark.createDataFrame([(1, "the group", "a file", False), (1, "ENTITY1", "a files", False), (1, "ANY", "thing", True), (1, "thing", "thing", False)], "s int, sub string, obj string, negated boolean")
    phrases = sorted(r.phrase for r in labelling.event_phrases(events, ["s"]).collect())
    assert phrases == sorted(["", "a file", "a files", "thing", "the group", "ANY"])
    labelled = spark.createDataFrame([(1, "the group", "ACTOR"), (1, "a file", "DATA"), (1, "a file", "OTHER"), (1, "thing", "OTHER")], "s int, phrase string, label string")
    got = sorted((r["sub"], r.obj, r.sub_label, r.obj_label) for r in labelling.end_labels(events, labelled, ["s"]).collect())
    assert got == [("ENTITY1", "a files", ["OTHER"], ["DATA"]), ("the group", "a file", ["ACTOR"], ["DATA"])]
    assert [r.x for r in spark.createDataFrame([(["OTHER", "DATA"],), (["ACTOR"],)], "l array<string>").select(labelling.first_real_label(F.col("l")).alias("x")).collect()] == ["DATA", None]
