"""Labels of phrases by lexicon and rules: term tables, special, regex and keyword votes, verbs, spans and the labels of event ends.

A lexicon is a table (label, kind, term) with kinds special, strong_special, regex, strong_regex and keyword. Terms meet phrases by their last words: a
phrase's last k words and the terms of k words are joined on k and on the length of the text, within the lengths that the ratio allows, and
what an edit distance rules out never reaches the ratio itself. Regexes are a small dimension (at most MOST_REGEXES, checked) and become one
alternation a label.

Edge cases: null or blank phrases get no votes and the label OTHER; an empty lexicon gives OTHER for all; invalid regexes are left out, as at load; a
tie of labels abstains (OTHER); repeated phrases are judged once and give a row each; extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import indel_ratio
from tracewell.operators.voting import majority

LABELS = ["OTHER", "DATA", "DIRECTORY", "ENCRYPTION", "FUNCTION", "NETWORK", "COMPONENT", "REGISTRY", "USER", "VULNERABILITY", "ACTOR"]
#: Fixed values of the rules: what a path must not start with, and ends of phrases that are no data.
NO_DIRECTORY = [
    r"^(HKEY_CLASSES_ROOT|KCU|HKCR|HKLM|HKCU|HKU|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKEY_CURRENT_USERS|HKCR|HKEY_USERS|KEY_CURRENT_USER|Registry)+",
    r"^(schtasks|odbcconf|net|netstat|sudo|dir|mmc|rundll32|chmod|cmd|wmic)(\.exe)?[\s]+",
]
NO_DATA = r"(file|attachment|document|item)[s]?$"
#: Ratios over which a term of one word and one of more words match.
ONE_WORD, MORE_WORDS = 0.95, 0.9
#: Regexes that become alternations.
MOST_REGEXES = 10_000


def routed(entries: DataFrame) -> DataFrame:
    """(label, kind, term) of dictionary entries (label, key, term): strong ones count as such and as plain ones, every key that names
    neither regex nor special holds keywords."""
    has = lambda part: F.contains("key", F.lit(part))
    kinds = F.array_compact(F.array(
        F.when(has("strong_regex"), "strong_regex"), F.when(has("strong_special"), "strong_special"),
        F.when(has("regex"), "regex").when(has("special"), "special").otherwise("keyword"),
    ))
    return entries.where("term is not null").select("label", F.explode(kinds).alias("kind"), "term").distinct()


def last_words(phrase: Column, k: Column) -> Column:
    """The last k words of a lower-cased phrase; the whole phrase as it stands if it has k words; null if it has fewer."""
    words = F.filter(F.split(F.lower(phrase), r"\s+"), lambda w: w != "")
    n = F.size(words)
    tail = F.array_join(F.slice(words, n - k + 1, k), " ")
    return F.when(n == k, F.lower(phrase)).when((n > k) & (k > 0), tail)


def term_hits(phrases: DataFrame, terms: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(phrase, label, kind, term) of the terms that the last words of a phrase match."""
    words = F.filter(F.split(F.lower("term"), r"\s+"), lambda w: w != "")
    t = terms.select("label", "kind", F.lower("term").alias("t"), "term", F.size(words).alias("k")).where("k > 0").distinct()
    rate = F.when(F.col("k") == 1, ONE_WORD).otherwise(MORE_WORDS)
    # a ratio over r needs lengths within a factor of r / (2 - r)
    n = F.length("t")
    low, high = F.ceil(n * rate / (2 - rate)).cast("int"), F.floor(n * (2 - rate) / rate).cast("int")
    t = t.withColumns({"rate": rate, "n": F.explode(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, low, F.lit(1))))})
    sizes = t.select("k").distinct()
    p = phrases.select(F.col(phrase).alias("phrase")).where("phrase is not null").distinct()
    size = F.size(F.filter(F.split("phrase", r"\s+"), lambda w: w != ""))
    listed = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(size, F.lit(1)))))
    focus = listed.join(sizes, "k", "left_semi").select("phrase", "k", last_words(F.col("phrase"), F.col("k")).alias("f")).where("f is not null").withColumn("n", F.length("f"))
    pairs = focus.join(t, ["k", "n"])
    most = F.floor((1 - F.col("rate")) * (F.length("f") + F.length("t"))).cast("int")
    near = pairs.where((F.col("f") == F.col("t")) | (F.levenshtein("f", "t") <= most))
    ratio = F.when(F.col("f") == F.col("t"), 1.0).otherwise(indel_ratio(F.col("f"), F.col("t")))
    return near.where(ratio > F.col("rate")).select("phrase", "label", "kind", "term").distinct()


def valid_regexes(lexicon: DataFrame, kinds: Iterable[str] = ("regex",)) -> dict[str, list[str]]:
    """Regexes by label, without those that do not compile."""
    rows = lexicon.where(F.col("kind").isin(list(kinds))).select("label", "term").distinct().limit(MOST_REGEXES + 1).collect()
    if len(rows) > MOST_REGEXES:
        raise ValueError(f"more than {MOST_REGEXES} regexes in a lexicon")
    pattern, out = lexicon.sparkSession._jvm.java.util.regex.Pattern, {}
    for r in sorted(rows):
        try:
            pattern.compile(r["term"])
        except Exception:  # noqa: BLE001 - the JVM's own error type
            continue
        out.setdefault(r["label"], []).append(r["term"])
    return out


def any_regex(phrase: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern is found in a phrase, in any case."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return phrase.rlike(f"(?i){joined}") if joined else F.lit(False)


def matched_text(phrase: Column, patterns: Iterable[str]) -> Column:
    """The text that the first matching pattern finds; null if none does."""
    found = [F.when(phrase.rlike(f"(?i){p}"), F.regexp_extract(phrase, f"(?i){p}", 0)) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def votes(phrases: DataFrame, lexicon: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(phrase, label, votes) by four labelling functions a label: special terms twice, regexes once, keywords once, each with its
    label's guards."""
    p = phrases.select(F.col(phrase).alias("phrase")).where("phrase is not null and trim(phrase) <> ''").distinct()
    hits = term_hits(p, lexicon.where("kind in ('special', 'keyword')"))
    kinds = hits.groupBy("phrase", "label").agg(F.bool_or(F.col("kind") == "special").alias("special"), F.bool_or(F.col("kind") == "keyword").alias("keyword"))
    regexes = valid_regexes(lexicon)
    hit = {label: any_regex(F.col("phrase"), r) for label, r in regexes.items()}
    never = F.lit(False)
    # placeholders vote for their own label without a lookup
    named = {label: F.contains("phrase", F.lit(label)) for label in ("DIRECTORY", "REGISTRY")}
    no_path = any_regex(F.col("phrase"), NO_DIRECTORY) | F.col("phrase").endswith(".exe")
    is_code = hit.get("FUNCTION", never) | hit.get("REGISTRY", never) | hit.get("ENCRYPTION", never)
    no_data = (any_regex(F.col("phrase"), [NO_DATA]) & is_code) | F.col("phrase").rlike("users?$")
    labels = sorted({*LABELS, *regexes})
    every = [
        F.struct(
            F.lit(label).alias("label"), named.get(label, never).alias("named"),
            (~no_path & (named[label] | hit.get(label, never)) if label == "DIRECTORY" else hit.get(label, never)).alias("regex"),
            (no_data if label == "DATA" else never).alias("barred"),
        )
        for label in labels
    ]
    marked = p.select("phrase", F.explode(F.filter(F.array(*every), lambda x: x["named"] | x["regex"] | x["barred"])).alias("m")).select("phrase", "m.*")
    both = marked.join(kinds, ["phrase", "label"], "full_outer")
    flag = lambda c: F.coalesce(F.col(c), never)
    as_int = lambda x: x.cast("long")
    n = as_int(flag("named") | flag("special")) + as_int(flag("special")) + as_int(flag("regex")) + as_int(~flag("barred") & (flag("named") | flag("keyword")))
    return both.select("phrase", "label", n.alias("votes")).where("votes > 0")


def ruled(phrase: Column, label: Column) -> Column:
    """The label after the rules on the phrase's own words: placeholders, then actors, then vulnerabilities; blank phrases keep theirs."""
    low = F.lower(phrase)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    last = F.get(words, F.size(words) - 1)
    out = F.when(F.trim(phrase) == "", label)
    for name in ("REGISTRY", "ENCRYPTION", "DIRECTORY", "NETWORK", "FUNCTION", "DATA"):
        out = out.when(F.contains(phrase, F.lit(name)), name)
    return (
        out.when(F.contains(low, F.lit("threat actor")), "ACTOR").when(F.contains(last, F.lit("actor")), "ACTOR")
        .when(F.contains(last, F.lit("attacker")), "ACTOR").when(F.contains(low, F.lit("vunerabili")), "VULNERABILITY").otherwise(label)
    )


def label_phrases(phrases: DataFrame, lexicon: DataFrame, phrase: str = "phrase") -> DataFrame:
    """The rows with a column label: the vote of the lexicon, then the rules."""
    voted = majority(votes(phrases, lexicon, phrase), "phrase").select(F.col("phrase").alias("_p"), F.col("label").alias("_l"))
    out = phrases.join(voted, F.col(phrase) == F.col("_p"), "left")
    return out.select(*phrases.columns, ruled(F.coalesce(F.col(phrase), F.lit("")), F.coalesce("_l", F.lit("OTHER"))).alias("label"))


def without_placeholders(text: Column) -> Column:
    """A phrase without ENTITYn words."""
    return F.trim(F.regexp_replace(text, r"\bENTITY[0-9]+\b", ""))


def event_phrases(events: DataFrame, sentence: list[str]) -> DataFrame:
    """(sentence..., phrase): the distinct texts of the ends of a sentence's events (sub, obj), without placeholders; bare placeholders go."""
    ends = events.select(*sentence, F.explode(F.array("sub", "obj")).alias("raw")).where("raw is not null").distinct()
    rows = ends.select(*sentence, without_placeholders(F.col("raw")).alias("phrase"))
    return rows.where(~((F.size(F.split("phrase", r"\s+")) == 1) & F.contains("phrase", F.lit("ENTITY")))).distinct()


def end_labels(events: DataFrame, labelled: DataFrame, sentence: list[str], least: float = 0.8) -> DataFrame:
    """Events with sub_label and obj_label (arrays): every label of the sentence whose phrase resembles the end; of two labels OTHER goes, else
    ACTOR. Negated events go (column negated), and those of which both ends are only OTHER. The end ANY is an ACTOR."""
    def attached(side: str) -> DataFrame:
        ends = events.select(*sentence, F.col(side).alias("end")).distinct()
        pairs = ends.join(labelled.select(*sentence, F.col("phrase").alias("said"), "label"), sentence)
        close = (F.col("said") == F.col("end")) | (indel_ratio(F.col("end"), F.col("said")) > least)
        found = pairs.where(close).groupBy(*sentence, "end").agg(F.array_sort(F.collect_set("label")).alias("ls"))
        two = F.when(F.array_contains("ls", "OTHER"), F.array_remove("ls", "OTHER")).otherwise(F.array_remove("ls", "ACTOR"))
        return found.select(*sentence, F.col("end").alias(side), F.when(F.size("ls") == 2, two).otherwise(F.col("ls")).alias(f"{side}_label"))

    rows = events.where("not coalesce(negated, false)") if "negated" in events.columns else events
    none = F.array(F.lit("OTHER"))
    for side in ("sub", "obj"):
        rows = rows.join(attached(side), [*sentence, side], "left")
        name = f"{side}_label"
        rows = rows.withColumn(name, F.when(F.col(side) == "ANY", F.array(F.lit("ACTOR"))).otherwise(F.coalesce(F.col(name), none)))
    return rows.where(~((F.col("sub_label") == none) & (F.col("obj_label") == none)))


def first_real_label(labels: Column) -> Column:
    """The first label that is neither ACTOR nor OTHER; null if there is none."""
    return F.get(F.filter(labels, lambda x: ~x.isin("ACTOR", "OTHER")), F.lit(0))


def verb_groups(verbs: Column, groups: dict[str, list[str]], only: Iterable[str] | None = None) -> Column:
    """The names of the groups that hold any of an array of verbs."""
    names = [g for g in groups if only is None or g in set(only)]
    held = [F.when(F.arrays_overlap(verbs, F.array(*map(F.lit, groups[g])).cast("array<string>")), g) for g in names]
    return F.array_compact(F.array(*held).cast("array<string>"))


def strong_verbs(verbs: Column, groups: dict[str, list[str]], strong: Iterable[str]) -> Column:
    """Whether any verb is of a strong group."""
    return F.size(verb_groups(verbs, groups, strong)) > 0


def strong_mismatch(a: Column, b: Column, groups: dict[str, list[str]], strong: Iterable[str]) -> Column:
    """Whether some strong group holds a verb of exactly one side; no if a side has no verbs."""
    strong = list(strong)
    x, y = verb_groups(a, groups, strong), verb_groups(b, groups, strong)
    one = (F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0)
    return (F.size(a) > 0) & (F.size(b) > 0) & one


def similar_verbs(a: Column, b: Column, groups: dict[str, list[str]]) -> Column:
    """Whether both sides share a verb or a group; no if a side has no verbs."""
    shared = F.arrays_overlap(a, b) | F.arrays_overlap(verb_groups(a, groups), verb_groups(b, groups))
    return (F.size(a) > 0) & (F.size(b) > 0) & F.coalesce(shared, F.lit(False))


def strong_spans(text: Column, label: str, specials: Iterable[str], regexes: Iterable[str]) -> Column:
    """Spans (text, s, e, label) of a label's strong terms: the first literal, in the given order, that stands alone where it is first found, and all
    places of the regexes in any case. As in the reference the right-hand check looks one character further."""
    kind = "array<struct<text:string,s:int,e:int,label:string>>"
    at = lambda i: F.substr(text, i + 1, F.lit(1))
    found = None
    for term in specials:
        s = F.instr(text, term) - 1
        e = s + len(term)
        alone = ~F.when(s > 0, at(s - 1)).otherwise(F.lit("")).rlike(r"^[\p{L}\p{N}]$") & ~at(e + 1).rlike(r"^[\p{L}\p{N}]$")
        span = F.struct(F.lit(term).alias("text"), s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(label).alias("label"))
        hit = F.when((s >= 0) & alone, span)
        found = hit if found is None else F.coalesce(found, hit)
    parts = [F.array_compact(F.array(found)).cast(kind)] if found is not None else []
    for r in regexes:
        pattern = f"(?i){r}"
        hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        # the lengths before a hit place it
        before = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda a, x: a + F.length(x))  # noqa: E731,B023
        spans = F.transform(hits, lambda h, i: F.struct(h.alias("text"), before(i).alias("s"), (before(i) + F.length(h)).alias("e"), F.lit(label).alias("label")))
        parts.append(F.filter(spans, lambda x: x["e"] > x["s"]).cast(kind))
    return F.concat(*parts) if parts else F.array().cast(kind)


def special_spans(texts: DataFrame, lexicon: DataFrame, key: str, text: str, labels: Iterable[str] = ("DIRECTORY", "REGISTRY", "NETWORK", "VULNERABILITY")) -> DataFrame:
    """(key, text, s, e, label): strong spans of labels, longest first, without those inside a longer or earlier one. A span's rank among those
    that cover its start decides, so spans meet only spans of their own text."""
    rows = lexicon.where("kind in ('strong_special', 'strong_regex')").select("label", "kind", "term").distinct().limit(MOST_REGEXES + 1).collect()
    if len(rows) > MOST_REGEXES:
        raise ValueError(f"more than {MOST_REGEXES} strong terms in a lexicon")
    regexes = valid_regexes(lexicon, ["strong_regex"])
    own = lambda label: sorted((r["term"] for r in rows if r["label"] == label and r["kind"] == "strong_special"), key=lambda x: (-len(x), x))
    found = F.concat(*(strong_spans(F.col(text), label, own(label), regexes.get(label, [])) for label in labels))
    turn = F.transform(found, lambda x, i: F.struct((x["s"] - x["e"]).alias("n"), i.alias("i"), x.alias("x")))
    ordered = F.array_sort(turn)
    kept = F.filter(ordered, lambda y: ~F.exists(ordered, lambda o: ((o["n"] < y["n"]) | ((o["n"] == y["n"]) & (o["i"] < y["i"]))) & (o["x"]["s"] <= y["x"]["s"]) & (o["x"]["e"] >= y["x"]["e"])))
    return texts.select(key, F.explode(F.transform(kept, lambda y: y["x"])).alias("x")).select(key, "x.*")
