"""The preprocessing chain of report texts: entity links, enumerations, pronouns, sentences, and line rules of extracted pages.

Column expressions where built-in functions can say it; the one exception is compatibility decomposition (decomposed), which no SQL function offers and which runs as an
Arrow batch. Parses and mention chains are tables that an annotator supplies.

Edge cases: null texts stay null; empty texts stay empty; very long texts are read whole; repeated rows are independent; extra columns are kept."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T

#: Leading clauses of campaign links, bullets, pronouns that are replaced, words that stand for an attacker, verbs that lists begin with.
CAMPAIGN_LEADS = [r"^During.*?\(https://attack.mitre.org/campaigns/[\S]*\)\,", r"^For.*?\(https://attack.mitre.org/campaigns/[\S]*\)\,"]
BULLETS = "•◦∘"
REPLACED_PRONOUNS = ["it", "he", "she", "him", "her", "they", "them"]
ATTACKER_WORDS = ["it", "they"]
LIST_LEMMAS = ["browse", "move", "instal"]
SUBJECT_ROLES = ["nsubj", "nsubjpass", "csubj", "csubjpass"]
CAPTION = r"(?i)(\n|^)(Figure|Table)\s[0-9]{1,3}(.|:)\s"
STOPS = [".", "!", "?", ":"]
OPEN_ENDS = ["\\", "vs.", "i.e.", "e.g.", ",", "as"]


def homogenised(text: Column, variants: Mapping[str, Iterable[str]]) -> Column:
    """Variants by their canonical form, in order: a variant is looked for in any case and replaced as it is written."""
    def one(t: Column, pair: tuple[str, str]) -> Column:
        name, variant = pair
        return F.when(F.contains(F.lower(t), F.lit(variant.lower())), F.replace(t, F.lit(variant), F.lit(name))).otherwise(t)

    return reduce(one, [(k, v) for k, vs in variants.items() for v in vs if v], text)


def without_links(text: Column, patterns: Iterable[str]) -> Column:
    """Line ends and tabs as spaces, double spaces once, then the patterns of links and citations deleted in order."""
    flat = F.replace(F.regexp_replace(text, "[\n\t\r]+", " "), F.lit("  "), F.lit(" "))
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, flat)


def without_entity_links(text: Column, link: str = r"\[([^\]]*)\]\((?:[^()]|\([^()]*\))*\)") -> Column:
    """Leading campaign clauses deleted, and entity links as the text in their brackets. link: a pattern whose first group is that text."""
    bare = reduce(lambda t, p: F.regexp_replace(t, p, ""), CAMPAIGN_LEADS, text)
    return F.regexp_replace(bare, link, "$1")


def without_before_after(text: Column) -> Column:
    """Without "before ..." and "after ..." clauses up to a comma, a stop or a line end."""
    return F.regexp_replace(text, r"\b(before|after).*?(,|\.|\n)", "")


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD)."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))

    return F.when(text.rlike(r"[^\x00-\x7F]"), run(text)).otherwise(text)


def lacks_subject(tokens: Column) -> Column:
    """Whether a parsed line (array of tokens text, lemma, pos, dep, i, head) begins with a verb or noun and has no subject."""
    first = F.get(tokens, F.lit(0))
    return (first["pos"].isin("VERB", "NOUN") | first["lemma"].isin(LIST_LEMMAS)) & ~F.exists(tokens, lambda t: t["dep"].isin(SUBJECT_ROLES))


def with_attacker(text: Column, tokens: Column) -> Column:
    """A sentence whose root is a verb in the first place without a subject to its left, as "Attacker can <lemma> ..."; others as they are. tokens: those of
    the first sentence."""
    first, rest = F.get(tokens, F.lit(0)), F.array_join(F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: t["text"]), " ")
    is_root = (first["head"] == first["i"]) & (first["pos"] == "VERB")
    said = F.substr(text, F.length(first["text"]) + 2)
    return F.when(is_root & (F.size(tokens) > 0), F.concat_ws(" ", F.lit("Attacker can"), F.concat_ws(" ", first["lemma"], F.when(F.startswith(text, first["text"]), said).otherwise(rest)))).otherwise(text)


def enumeration_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, said, bullet): the decomposed lines of a text; said: without bullets, trimmed."""
    lines = docs.select(key, F.posexplode(F.split(decomposed(F.col(text)), "\n", -1)).alias("line", "raw"))
    trimmed = F.trim("raw")
    return lines.select(key, "line", F.when(trimmed.rlike(f"^[{BULLETS}]"), F.trim(F.regexp_replace(trimmed, f"[{BULLETS}]", ""))).otherwise(trimmed).alias("said"), trimmed.rlike(f"^[{BULLETS}]").alias("bullet"), trimmed.alias("raw"))


def fixed_enumerations(docs: DataFrame, parsed: DataFrame, key: str, text: str, base_form: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with bullet lines of more than two words that lack a subject told of the attacker. parsed: (key, line, tokens) of the lines in lower case.
    base_form: from a verb without its final s to its base form (the verb itself if not given)."""
    rows = enumeration_lines(docs, key, text).join(parsed.select(key, "line", "tokens"), [key, "line"], "left")
    words = F.split("said", " ", -1)
    fix = F.col("bullet") & (F.size(words) > 2) & F.coalesce(lacks_subject(F.col("tokens")), F.lit(False))
    lowered = F.concat(F.lower(F.substr("said", F.lit(1), F.lit(1))), F.substr("said", F.lit(2)))
    told = with_attacker(lowered, F.col("tokens"))
    first = F.get(words, F.lit(0))
    stem = F.lower(F.left(first, F.length(first) - 1))
    rest = F.array_join(F.slice(words, 2, F.size(words)), " ")
    by_s = F.concat(F.lit("Attacker can "), (base_form or (lambda x: x))(stem), F.lit(" "), rest)
    line = F.when(~fix, F.col("raw")).when(told != lowered, F.trim(told)).when(first.endswith("s"), F.trim(by_s)).otherwise(F.col("raw"))
    whole = rows.withColumn("_line", line).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "_line"))).alias("_l"))
    joined = whole.select(F.col(key).alias("_k"), F.trim(F.array_join(F.col("_l._line"), "\n")).alias("_t"))
    return docs.join(joined, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn(text, F.coalesce("_t", text)).drop("_k", "_t")


def main_phrase(phrase: Column) -> Column:
    """The phrase that a pronoun is replaced by: definite, and never a path."""
    low = F.lower(phrase)
    out = F.when(low.startswith("a "), F.replace(phrase, F.lit("a "), F.lit("the "))).when(low.startswith("an "), F.replace(phrase, F.lit("an "), F.lit("the "))).otherwise(phrase)
    return F.when(~F.contains(phrase, F.lit("\\")), out)


def resolved_pronouns(tokens: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): texts of tokens (keys, i, text, space) with the single-word pronouns of a chain replaced by its main phrase. mentions: (keys, chain, i, main
    (boolean), phrase of the main mention); mentions of more than one word are not in it."""
    main = mentions.where("main").groupBy(*keys, "chain").agg(F.min_by(F.struct("i", main_phrase(F.col("phrase")).alias("phrase")), "i").alias("m"))
    said = mentions.where("not main").select(*keys, "chain", "i").join(main, [*keys, "chain"]).where("m.phrase is not null and i <> m.i")
    by = said.groupBy(*keys, "i").agg(F.max_by("m.phrase", "chain").alias("by"))
    rows = tokens.join(by, [*keys, "i"], "left")
    word = F.when(F.lower("text").isin(REPLACED_PRONOUNS), F.coalesce("by", "text")).otherwise(F.col("text"))
    piece = F.concat(word, F.when(F.coalesce("space", F.lit(False)), " ").otherwise(""))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", piece.alias("p")))).alias("w"))
    return whole.select(*keys, F.array_join(F.col("w.p"), "").alias("text"))


def sentence_chain(text: Column, substitutions: Iterable[tuple[str, str]], channel_terms: Iterable[str], variants: Mapping[str, Iterable[str]], channel: str = "C2") -> Column:
    """The default chain of a sentence: punctuation made plain, substitutions, the name of the control channel, canonical names. The subject of an
    elliptic sentence comes last and needs its parse: with_attacker."""
    out = T.substitute(T.straighten(text), substitutions)
    return homogenised(T.substitute_any_case(out, channel_terms, channel), variants)


def preprocessed(
    docs: DataFrame, sentences: DataFrame, key: str, substitutions: Iterable[tuple[str, str]], channel_terms: Iterable[str], variants: Mapping[str, Iterable[str]]
) -> DataFrame:
    """(key, text) of documents, from their sentences (key, sentence, text[, tokens]) in order: each by sentence_chain and, where its tokens are given,
    with_attacker; joined with one space, double spaces collapsed once, trimmed. Texts come before that from without_links, without_entity_links,
    fixed_enumerations and, for reports, resolved_pronouns. Documents without sentences have an empty text."""
    said = sentence_chain(F.col("text"), substitutions, channel_terms, variants)
    if "tokens" in sentences.columns:
        said = F.when(F.size("tokens") > 0, with_attacker(said, F.col("tokens"))).otherwise(said)
    whole = sentences.select(key, "sentence", said.alias("s")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sentence", "s"))).alias("w"))
    out = F.trim(F.replace(F.array_join(F.transform("w", lambda x: F.coalesce(x["s"], F.lit(""))), " "), F.lit("  "), F.lit(" ")))
    return docs.select(key).distinct().join(whole, key, "left").select(key, F.coalesce(out, F.lit("")).alias("text"))


def true_text(text: Column, replaced: Column) -> Column:
    """A node's text: what its placeholder stands for, in lower case, and "attacker" for it and they. replaced: map from placeholder to text."""
    said = F.coalesce(F.lower(F.try_element_at(replaced, text)), text)
    return F.when(F.lower(said).isin(ATTACKER_WORDS), "attacker").otherwise(said)


def true_texts(texts: Column, replaced: Column) -> Column:
    return F.transform(texts, lambda t: true_text(t, replaced))


def joined_tokens(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), " ")


def lemma_of(phrase: Column, tokens: Column) -> Column:
    """The lemma of a phrase of one word, looked up in its tokens; others as they are."""
    hit = F.get(F.filter(tokens, lambda t: t["text"] == phrase), F.lit(0))["lemma"]
    return F.when(F.size(F.split(phrase, " ")) == 1, F.coalesce(hit, phrase)).otherwise(phrase)


def adverbial_clauses(toks: Column) -> Column:
    """The texts of a sentence's clauses: each adverbial clause's subtree, and what is left. toks: tokens in order with i and head."""
    roots = F.transform(F.filter(toks, lambda t: t["dep"] == "advcl"), lambda t: t["i"])

    def up(at: Column) -> Column:  # a token's clause: the first adverbial clause on the way to the root
        step = lambda i: F.when(F.array_contains(roots, i), i).otherwise(F.get(toks, i)["head"])
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))), at, lambda a, _: step(a))

    placed = F.transform(toks, lambda t: F.struct(t["text"].alias("text"), up(t["i"]).alias("of")))
    said = lambda keep: F.array_join(F.transform(F.filter(placed, keep), lambda x: x["text"]), " ")
    clauses = F.transform(roots, lambda r: said(lambda x: x["of"] == r))
    return F.filter(F.concat(F.array(said(lambda x: ~F.array_contains(roots, x["of"]))), clauses), lambda x: x != "")


def most_similar(a: Column, b: Column) -> Column:
    """The highest ratio of any pair of two arrays of texts, in any case; 0 without pairs."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: T.indel_ratio(F.lower(x), F.lower(y)))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def any_stands_in(phrases: Column, texts: Column) -> Column:
    """Whether any phrase, read as a regex in any case, stands between word boundaries in any of the texts. Phrases that do not compile must be left out
    before (labelling.valid_regexes)."""
    return F.exists(phrases, lambda p: F.exists(texts, lambda t: F.regexp_like(t, F.concat(F.lit(r"(?i)\b"), p, F.lit(r"\b")))))


def is_header(line: Column) -> Column:
    """A numbered heading, a line of more than two words at least half of which begin with a capital, or an upper-case line."""
    words = F.filter(F.split(line, " ", -1), lambda w: F.trim(w) != "")
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    upper = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    return F.coalesce(line.rlike(r"^[0-9]{1,3}\.([0-9]{1,3}\.?)?\s") | ((F.size(words) > 2) & (2 * capitals >= F.size(words))) | upper, F.lit(False))


def is_prose(line: Column, english: Column) -> Column:
    """Whether a line is running English text: no caption, under half of its words capitalised or not alphanumeric, at least half letters, over 64
    characters. Empty words count as not alphanumeric."""
    said = T.unescaped(line)
    words = F.split(said, " ", -1)
    odd = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}") | ~w.rlike(r"^[\p{L}\p{N}]+$")))
    letters = F.length(F.regexp_replace(said, r"[^\p{L}]", ""))
    return F.coalesce((said != "") & english & ~said.rlike(CAPTION) & (2 * odd < F.size(words)) & (2 * letters >= F.length(said)) & (F.length(said) > 64), F.lit(False))


def is_good(text: Column, english: Column) -> Column:
    """Prose, or what ends in a colon; under half of its words are single characters."""
    words = F.split(text, " ", -1)
    return F.coalesce(text.endswith(":") | (is_prose(text, english) & (2 * F.size(F.filter(words, lambda w: F.length(w) == 1)) < F.size(words))), F.lit(False))


def mostly_prose(text: Column, english: Column) -> Column:
    """Whether at least half of the lines are prose."""
    lines = F.split(text, "\n", -1)
    return 2 * F.size(F.filter(lines, lambda x: is_prose(x, english))) >= F.size(lines)


def prose_lines(text: Column, english: Column) -> Column:
    """The prose lines of a section, trimmed."""
    lines = F.split(F.replace(F.trim(text), F.lit("\n\n"), F.lit("\n")), "\n", -1)
    return F.trim(F.array_join(F.transform(F.filter(lines, lambda x: is_prose(x, english)), lambda x: F.trim(x)), "\n"))


def page_lines(text: Column) -> Column:
    """The lines of an extracted page: unescaped, trimmed, without empty and numeric ones, without those that stand more than five times."""
    lines = F.filter(F.transform(F.split(T.unescaped(text), "\n", -1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^\p{N}+$"))
    # of equal lines, neighbours once sorted, the sixth is five places behind the first
    ordered = F.array_sort(lines)
    return F.filter(lines, lambda x: ~(F.get(ordered, F.array_position(ordered, x).cast("int") + 4).eqNullSafe(x)))


def blocks(lines: Column) -> Column:
    """Lines glued to blocks, in one fold: captions without a final stop go, headings stand alone, a line goes on in the next one that is no bullet if it
    has no final stop, ends openly or the next begins in lower case (and is no heading); a bullet goes on in a capitalised line only if it ends
    openly. Bullets join the block before them."""
    kind = "struct<done:array<string>,open:string>"
    ends_openly = lambda x: reduce(lambda a, e: a | x.endswith(e), OPEN_ENDS, F.lit(False))
    stopped = lambda x: reduce(lambda a, e: a | x.endswith(e), STOPS, F.lit(False))
    bullet = lambda x: x.startswith("•")
    caption = lambda x: (x.startswith("Figure") | x.startswith("Table")) & ~stopped(x)
    plain = lambda x: ~is_header(x)

    def step(acc: Column, x: Column) -> Column:
        own = acc["open"]
        goes_on = own.isNotNull() & plain(own) & ~bullet(x) & (ends_openly(own) | (x.rlike(r"^\p{Ll}") & plain(x)) | ~stopped(own))
        goes_on = goes_on & ~(bullet(own) & x.rlike(r"^\p{Lu}") & ~ends_openly(own))
        shut = F.when(own.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(own)))
        return (
            F.when(own.isNull() & caption(x), acc).when(goes_on, F.struct(acc["done"].alias("done"), F.concat_ws(" ", own, x).alias("open")))
            .otherwise(F.struct(shut.alias("done"), F.when(~caption(x), x).alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")).cast(kind)
    made = F.aggregate(lines, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    join = lambda a, x: F.when((F.size(a) > 0) & bullet(x), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat_ws("\n", F.get(a, F.size(a) - 1), x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(made, F.array().cast("array<string>"), join)


def grouped_blocks(made: Column) -> Column:
    """Blocks joined to the one before, from the last to the first: under 256 characters, under 512 without a heading, or after one that ends in a colon. The first
    block stays first."""
    def step(acc: Column, x: Column) -> Column:
        own = F.when(acc["open"].isNull(), x).otherwise(F.concat_ws("\n", x, acc["open"]))
        return F.struct(acc["done"].alias("done"), own.alias("open"))

    def walk(acc: Column, pair: Column) -> Column:
        acc2 = step(acc, pair["x"])
        own = acc2["open"]
        joins = ((F.length(own) < 512) & ~is_header(F.substring_index(own, "\n", 1))) | pair["before"].endswith(":") | (F.length(own) < 256)
        return F.when(pair["before"].isNotNull() & joins, acc2).otherwise(F.struct(F.concat(F.array(own), acc2["done"]).alias("done"), F.lit(None).cast("string").alias("open")))

    pairs = F.reverse(F.transform(made, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(made, i - 1)).alias("before"))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(pairs, start, walk, lambda a: a["done"])


def fixed_page(text: Column) -> Column:
    """The blocks of an extracted page."""
    return blocks(page_lines(text))
