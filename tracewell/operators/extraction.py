"""Events (who, does what, to whom) from sentences that an annotator has parsed.

Input: tokens (keys..., sentence, i, text, lemma, pos, dep, head) with i counted from 0 without gaps in each sentence. A sentence is one row of
arrays after a single shuffle, and every rule is an expression over that array, so no rule joins tokens with tokens. Sentences are short by
nature; the size of a document does not matter. Null texts or lemmas count as empty.

Edge cases: a sentence without tokens has no row; tokens with a null head hang on themselves; repeated tokens of one place stand one after the other and
shift the rest; equal events of a sentence are one; empty tables give no events; extra columns are not read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the dependency scheme and of the rules: roles, word classes, negations, prepositions that introduce a means, verbs whose
#: object acts in their complement, nouns that stand for an act with its verb and usual object.
SUBJECTS = ["nsubj", "nsubjpass", "csubj", "csubjpass", "agent", "expl"]
OBJECTS = ["dobj", "dative", "attr", "oprd", "pobj"]
NOUNS = ["NOUN", "PROPN", "PRON", "X", "NUM"]
NEGATIONS = ["no", "not", "n't", "never", "none", "without", "neither", "nor"]
MEANS = ["by", "via", "through", "over", "after", "before"]
LATER, EARLIER = ["before"], ["by", "via", "through", "after", "once"]
COMMANDS = [
    "make", "rely", "command", "ask", "lure", "persuade", "tell", "advice", "entice", "invite", "order", "recommend", "remind", "require", "suggest", "urge",
    "warn", "beg", "dare", "encourage", "expect", "force", "instruct", "need", "oblige", "permit", "request",
]
NOMINAL = {
    "exfiltration": "exfiltrate", "escalation": "escalate", "execution": "execute", "collection": "collect", "discovery": "discover", "access": "access", "evasion": "bypass",
}
USUAL = {
    "exfiltrate": "information", "escalate": "privilege", "execute": "command", "collect": "data", "discover": "information", "access": "credential", "bypass": "defense",
}
ALONE = ["execution", "collection", "discovery", "evasion", "exfiltration", "escalation"]
HEADS = ["exfiltration", "escalation", "execution", "collection", "discovery"]
PHRASES = ["credential access", "defense evasion"]
#: Our own choice: prepositions and participles that say two phrases mean the same, and dependents that belong to a phrase.
ALIKE, NAMING = ["like", "include", "contain"], ["named", "called"]
MODIFIERS = ["compound", "amod", "nummod", "nmod"]
ANY = -1


def sentences(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, toks): one row for each sentence, its tokens in order, each with the head of its coordination (`root`), its phrase (`np`), its
    own subjects, objects and agents (conjuncts included) and flags."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    token = F.struct(F.col("i").cast("int").alias("i"), blank("text"), F.lower(blank("lemma")).alias("lemma"), blank("pos"), blank("dep"), F.coalesce("head", "i").cast("int").alias("head"))
    rows = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(token)).alias("toks"))
    for made in (_chained(), _enriched()):  # a generator between them, so that no lambda computes an array again
        rows = rows.select(*keys, F.explode(F.array(made)).alias("toks"))
    return rows


def _at(i: Column) -> Column:
    return F.get("toks", i)


def _chained() -> Column:
    """Each token with the first member of its coordination, apposition or naming, in one pass from left to right."""
    plain = lambda t, root: F.struct(*(t[n].alias(n) for n in ("i", "text", "lemma", "pos", "dep", "head")), root.alias("root"))

    def step(done: Column, t: Column) -> Column:
        before = F.get(done, t["head"])
        named = (t["dep"] == "oprd") & (before["dep"] == "acl") & F.lower(before["text"]).isin(NAMING)
        joined = F.when(t["dep"].isin("conj", "appos"), before["root"]).when(named, F.get(done, before["head"])["root"])
        return F.concat(done, F.array(plain(t, F.when(t["head"] < t["i"], F.coalesce(joined, t["i"])).otherwise(t["i"]))))

    none = F.filter(F.transform("toks", lambda t: plain(t, t["i"])), lambda _: F.lit(False))
    return F.aggregate("toks", none, step)


def _with_conjuncts(found: Column) -> Column:
    """Indexes of tokens, and of those that continue their coordinations."""
    members = F.filter("toks", lambda m: F.exists(found, lambda c: (m["i"] == c["i"]) | ((m["root"] == c["root"]) & (m["i"] > c["i"]) & m["pos"].isin(NOUNS))))
    return F.transform(members, lambda m: m["i"])


def _child(t: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists("toks", lambda c: (c["head"] == t["i"]) & (c["i"] != t["i"]) & test(c))


def _enriched() -> Column:
    def one(t: Column) -> Column:
        of = lambda c: (c["head"] == t["i"]) & (c["i"] != t["i"])
        own = F.filter("toks", lambda c: of(c) & (c["i"] < t["i"]) & c["dep"].isin(SUBJECTS) & (c["pos"] != "DET"))
        antecedent = (t["dep"] == "relcl") & F.exists(own, lambda c: c["pos"] == "PRON")
        adjacent = lambda c: (_at(c["head"])["dep"] == "prep") & (_at(c["head"])["head"] == t["i"]) & (c["head"] == t["i"] + 1) & ~_at(c["head"])["lemma"].isin(*ALIKE, "as")
        objects = F.filter("toks", lambda c: c["dep"].isin(OBJECTS) & (c["i"] > t["i"]) & (c["text"] != "to") & (of(c) | adjacent(c)))
        agents = F.filter("toks", lambda c: (c["dep"] == "pobj") & (_at(c["head"])["dep"] == "agent") & (_at(c["head"])["head"] == t["i"]))
        phrase = F.filter("toks", lambda c: (c["i"] == t["i"]) | (of(c) & (c["i"] < t["i"]) & c["dep"].isin(MODIFIERS)))
        particles = F.filter("toks", lambda c: of(c) & (c["i"] > t["i"]) & (c["dep"] == "prt"))
        earlier, later = _child(t, lambda c: (c["i"] < t["i"]) & c["lemma"].isin("after", "once")), _child(t, lambda c: (c["i"] < t["i"]) & c["lemma"].isin(LATER))
        shift = F.when(earlier, -1).when(later, 1).otherwise(0)
        alike = ((t["dep"] == "prep") & t["lemma"].isin(ALIKE)) | ((t["dep"] == "prep") & (t["lemma"] == "as") & _child(t, lambda c: c["lemma"] == "such")) | ((t["dep"] == "acl") & F.lower(t["text"]).isin(NAMING))
        return F.struct(
            *(t[n].alias(n) for n in ("i", "text", "lemma", "pos", "dep", "head", "root")),
            F.when(antecedent, F.array(t["head"])).otherwise(_with_conjuncts(own)).alias("own"), _with_conjuncts(objects).alias("objects"),
            _with_conjuncts(agents).alias("agents"), _child(t, lambda c: (c["dep"] == "auxpass") & (c["i"] < t["i"])).alias("passive"),
            _child(t, lambda c: (c["dep"] == "neg") | c["lemma"].isin(NEGATIONS)).alias("negated"),
            F.array_join(F.transform(phrase, lambda c: c["text"]), " ").alias("np"),
            F.array_join(F.concat(F.array(t["lemma"]), F.transform(particles, lambda c: c["lemma"])), " ").alias("verb"),
            F.when((t["dep"] == "advcl") & (shift != 0), t["head"] + shift).otherwise(t["i"]).alias("index"), alike.cast("int").alias("flag"),
        )

    return F.transform("toks", one)


def _subjects(t: Column) -> Column:
    """A verb's own subjects, or those of the nearest verb that it continues, unless that one commands it."""

    def climb(a: Column, _: Column) -> Column:
        here = _at(a["at"])
        above = _at(here["head"])
        commanded = here["dep"].isin("advcl", "xcomp") & above["lemma"].isin(COMMANDS)
        up = here["dep"].isin("conj", "advcl", "xcomp") & ~commanded & above["pos"].isin("VERB", "AUX") & (here["head"] != a["at"])
        return F.when((F.size(a["found"]) > 0) | ~up, a).otherwise(F.struct(here["head"].alias("at"), _at(here["head"])["own"].alias("found")))

    return F.aggregate("toks", F.struct(t["i"].alias("at"), t["own"].alias("found")), climb, lambda a: a["found"])


def _name(i: Column) -> Column:
    return F.when(i == ANY, F.lit("ANY")).otherwise(_at(i)["np"])


def _events(subjects: Column, objects: Column, verb: Column, index: Column, negated: Column, flag: Column, rule: str, name: Callable[[Column], Column] = _name) -> Column:
    """All subjects with all objects of one verb. Element ids are token indexes + 1; 0 is the unnamed actor."""
    denied = lambda i: F.coalesce(_at(i)["negated"], F.lit(False))
    return F.flatten(F.transform(subjects, lambda s: F.transform(objects, lambda o: F.struct(
        index.cast("int").alias("verb_index"), (s + 1).alias("sub_id"), name(s).alias("sub"), verb.alias("verb"), (o + 1).alias("obj_id"), name(o).alias("obj"),
        (negated | denied(o)).alias("negated"), flag.cast("int").alias("flag"), F.lit(rule).alias("rule"),
    ))))


def _from(t: Column, subjects: Column, objects: Column, rule: str, negated: Column | None = None, verb: Column | None = None) -> Column:
    return _events(subjects, objects, t["verb"] if verb is None else verb, t["index"], t["negated"] if negated is None else negated, t["flag"], rule)


def _each(test: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(F.filter("toks", test), make))


def _somebody(found: Column) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ANY)))


def _is_verb(t: Column) -> Column:
    return (t["pos"] == "VERB") | (t["lemma"] == "be")


def _main(t: Column) -> Column:
    """Active verbs join subjects and objects; passive ones turn them, with nobody named where no agent is."""
    subjects = _subjects(t)
    return F.when(t["passive"], _from(t, _somebody(t["agents"]), subjects, "passive")).otherwise(_from(t, subjects, t["objects"], "active"))


def _complements(t: Column) -> Column:
    """The object of a commanding verb, else its subject, acts in the complement."""
    acting = F.when(F.size(t["objects"]) > 0, t["objects"]).otherwise(_subjects(t))
    direct = F.filter("toks", lambda x: (x["head"] == t["i"]) & (x["i"] > t["i"]) & x["dep"].isin("xcomp", "ccomp", "advcl") & (x["pos"] == "VERB"))
    under = lambda x: (_at(x["head"])["head"] == t["i"]) & (x["head"] > t["i"]) & (_at(x["head"])["dep"] == "prep") & (_at(x["head"])["pos"] == "ADP")
    nested = F.filter("toks", lambda x: under(x) & (x["i"] > x["head"]) & (x["dep"] == "pcomp") & (x["pos"] == "VERB"))
    below = F.when(F.size(direct) > 0, direct).otherwise(nested)
    return F.flatten(F.transform(below, lambda x: _from(x, acting, x["objects"], "complement", t["negated"] | x["negated"])))


def _prepositions(p: Column) -> Column:
    """A preposition joins what it hangs on (the noun; for a verb its object, or its subject if passive) with its own objects."""
    head = _at(p["head"])
    direct = F.transform(F.filter("toks", lambda c: (c["head"] == head["i"]) & c["dep"].isin("dobj", "nsubjpass")), lambda c: c["i"])
    carriers = F.when(head["pos"].isin(NOUNS), F.array(head["i"])).otherwise(direct)
    return _from(p, carriers, p["objects"], "preposition", p["negated"] | head["negated"])


def _means(p: Column) -> Column:
    """By, via or through doing something, or using a thing, before or after the main verb."""
    shift = F.when(p["lemma"].isin(EARLIER), -1).when(p["lemma"].isin(LATER), 1).otherwise(0)
    subjects = _somebody(_subjects(_at(p["head"])))
    doing = F.filter("toks", lambda x: (x["head"] == p["i"]) & (x["dep"] == "pcomp") & (x["pos"] == "VERB"))
    acts = F.flatten(F.transform(doing, lambda x: _events(subjects, x["objects"], x["verb"], x["i"] + shift, p["negated"] | x["negated"], F.lit(0), "means")))
    return F.concat(acts, _events(subjects, p["objects"], F.lit("use"), p["i"] + shift, p["negated"], F.lit(0), "means"))


def _participles(t: Column) -> Column:
    """A noun with a participle: it acts on the participle's objects, or is acted on by the agent or by nobody named."""
    noun = F.array(t["head"])
    active = _from(t, noun, t["objects"], "participle")
    return F.when(F.size(t["objects"]) > 0, active).otherwise(_from(t, _somebody(t["agents"]), noun, "participle"))


def _possessives(t: Column) -> Column:
    return _events(F.array(t["head"]), F.array(t["i"]), F.lit("of"), t["head"], t["negated"], F.lit(0), "possessive", lambda i: F.when(i == t["i"], _at(i)["np"]).otherwise(_name(i)))


def _based(t: Column) -> Column:
    """X-based Y is based on X."""
    stem = F.regexp_replace(t["text"], "-?based$", "")
    return _events(F.array(t["head"]), F.array(t["i"]), F.lit("basedon"), t["i"], t["negated"], F.lit(0), "based", lambda i: F.when(i == t["i"], stem).otherwise(_name(i)))


def _nominal(t: Column) -> Column:
    """Nouns that stand for an act: alone upon a usual object, as the head of a phrase of two nouns or more upon the rest of it."""
    verb = F.create_map(*(F.lit(x) for pair in NOMINAL.items() for x in pair))[t["text"]]
    usual = F.create_map(*(F.lit(x) for pair in USUAL.items() for x in pair))[verb]
    rest = F.trim(F.regexp_replace(t["np"], "[^ ]+$", ""))
    return _events(F.array(F.lit(ANY)), F.array(t["i"]), verb, t["i"], F.lit(False), F.lit(0), "nominal", lambda i: F.when(i == ANY, "ANY").when(t["np"].isin(ALONE), usual).otherwise(rest))


def _names_act(t: Column) -> Column:
    nouns = F.exists("toks", lambda c: (c["head"] == t["i"]) & (c["i"] < t["i"]) & c["dep"].isin(MODIFIERS) & c["pos"].isin("NOUN", "PROPN", "X", "NUM"))
    several = nouns & t["pos"].isin("NOUN", "PROPN", "X", "NUM") & (t["text"].isin(HEADS) | t["np"].isin(PHRASES))
    return t["np"].isin(ALONE) | several


def _as(t: Column) -> Column:
    """X as Y: the object (the subject of a passive verb, the noun of a participle) and Y."""
    verb = _at(t["head"])
    role = F.when(verb["passive"], "nsubjpass").otherwise("dobj")
    found = F.transform(F.filter("toks", lambda c: (c["head"] == verb["i"]) & (c["dep"] == role)), lambda c: c["i"])
    bearers = F.when((F.size(found) == 0) & (verb["dep"] == "acl"), F.array(verb["head"])).otherwise(found)
    return _from(t, bearers, t["objects"], "as", F.lit(False))


def _done_for(t: Column) -> Column:
    """Have or get something done."""
    return _from(t, F.array(F.lit(ANY)), t["own"], "done", F.lit(False))


def events(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq, verb_index, sub_id, sub, verb, obj_id, obj, negated, flag, rule), ordered by seq within a sentence: by the verb's place, then by
    rule. Of equal (sub, verb, obj) the first place stays with the last values."""
    done = lambda t: (t["dep"] == "ccomp") & _at(t["head"])["lemma"].isin("have", "get")
    means = lambda t: (t["dep"] == "prep") & t["lemma"].isin(MEANS) & _at(t["head"])["pos"].isin("VERB", "AUX")
    rules = [
        _each(lambda t: _is_verb(t) & done(t), _done_for),
        _each(lambda t: _is_verb(t) & ~done(t) & ~((t["dep"] == "prep") & t["lemma"].isin(*ALIKE, "as")) & (t["dep"] != "acl"), _main),
        _each(lambda t: t["lemma"].isin(COMMANDS) & (t["pos"] == "VERB"), _complements), _each(means, _means),
        _each(lambda t: (t["dep"] == "acl") & (t["pos"] == "VERB") & _at(t["head"])["pos"].isin(NOUNS), _participles),
        _each(lambda t: (t["dep"] == "prep") & ~means(t) & ~((t["lemma"] == "as") & (t["flag"] == 0)), _prepositions),
        _each(lambda t: (t["dep"] == "poss") & t["pos"].isin("NOUN", "PROPN", "X", "NUM"), _possessives),
        _each(lambda t: (t["pos"] == "VERB") & (t["i"] < t["head"]) & t["text"].endswith("based"), _based),
        _each(_names_act, _nominal),
        _each(lambda t: (t["dep"] == "prep") & (t["lemma"] == "as") & (t["flag"] == 0), _as),
    ]
    rows = parsed.select(*keys, F.posexplode(F.concat(*rules)).alias("_at", "_e")).select(*keys, "_at", "_e.*")
    values = [c for c in rows.columns if c not in (*keys, "_at", "sub", "verb", "obj")]
    kept = rows.groupBy(*keys, "sub", "verb", "obj").agg(F.max_by(F.struct(*values), "_at").alias("_v"), F.min_by(F.struct("verb_index", "_at"), "_at").alias("_p"))
    place = F.struct(F.col("_p.verb_index").alias("v"), F.col("_p._at").alias("a"))
    listed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "_v", "sub", "verb", "obj"))).alias("_l"))
    out = listed.select(*keys, F.posexplode("_l").alias("seq", "_r"))
    return out.select(*keys, "seq", "_r._v.verb_index", "_r._v.sub_id", "_r.sub", "_r.verb", "_r._v.obj_id", "_r.obj", "_r._v.negated", "_r._v.flag", "_r._v.rule")


def conjunct_chains(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, source, member): element ids of nouns and of the noun each continues, later members first."""
    pairs = F.filter("toks", lambda t: (t["dep"] == "conj") & t["pos"].isin(NOUNS))
    rows = F.reverse(F.transform(pairs, lambda t: F.struct((t["head"] + 1).alias("source"), (t["i"] + 1).alias("member"))))
    return parsed.select(*keys, F.explode(rows).alias("_c")).select(*keys, "_c.*")


def without_subject(parsed: DataFrame, *keys: str, actor: str = "Attacker") -> DataFrame:
    """(keys, text): sentences that begin with their main verb and name no subject get "<actor> can <lemma>" in front; others as they are."""
    first = _at(F.lit(0))
    bare = (first["pos"] == "VERB") & (first["head"] == 0) & (F.size(first["own"]) == 0)
    rest = F.array_join(F.transform(F.slice("toks", 2, F.greatest(F.size("toks") - 1, F.lit(0))), lambda t: t["text"]), " ")
    whole = F.array_join(F.transform("toks", lambda t: t["text"]), " ")
    return parsed.select(*keys, F.when(bare, F.trim(F.concat_ws(" ", F.lit(actor), F.lit("can"), first["lemma"], rest))).otherwise(whole).alias("text"))


def label_events(found: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """Adds sub_label and obj_label from labels (keys, phrase, label), one equi-join a side; unlabelled phrases are OTHER and nobody is ACTOR.
    Of two labels OTHER goes, of more ACTOR goes. Negated events, and those whose ends both are only OTHER, go."""
    sets = labels.groupBy(*keys, "phrase").agg(F.array_sort(F.collect_set("label")).alias("ls"))
    out = found.where(~F.col("negated"))
    for side in ("sub", "obj"):
        ls = sets.select(*keys, F.col("phrase").alias(side), F.col("ls").alias(f"_{side}"))
        out = out.join(ls, [*keys, side], "left")
        given = F.coalesce(F.col(f"_{side}"), F.array(F.lit("OTHER")))
        cut = F.when(F.size(given) == 2, F.array_except(given, F.array(F.lit("OTHER")))).when(F.size(given) > 2, F.array_except(given, F.array(F.lit("ACTOR")))).otherwise(given)
        out = out.withColumn(f"{side}_label", F.when(F.col(f"{side}_id") == 0, F.array(F.lit("ACTOR"))).otherwise(cut)).drop(f"_{side}")
    other = lambda c: (F.size(c) == 1) & (F.get(c, F.lit(0)) == "OTHER")
    return out.where(~(other("sub_label") & other("obj_label")))
