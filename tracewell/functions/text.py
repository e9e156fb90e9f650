"""Row-wise text rewrites and quality measures, as Column expressions that stay in code generation.

Edge cases: null texts stay null (measures of them are null); empty texts stay empty and have no words; very long texts are read whole; rows are
independent, so repeated ones get equal results; no expression reads another column."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def substitute(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements in order; later ones see what earlier ones made."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def substitute_any_case(text: Column, terms: Iterable[str], by: str) -> Column:
    """Replaces terms in any case, longest first, then collapses repeats of the replacement."""
    out = reduce(lambda t, x: F.regexp_replace(t, rf"(?iu)\Q{x}\E", by), sorted(terms, key=lambda x: (-len(x), x)), text)
    return F.regexp_replace(F.regexp_replace(out, rf"{by} \({by}\)", by), f"{by} {by}", by)


#: Typographic marks and what they become.
MARKS = [("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "-"), ("\u2026", "..."), ("\uf09f", " "), ("\u202e", ""), ("\ufeff", "")]


def straighten(text: Column, marks: Iterable[tuple[str, str]] = MARKS) -> Column:
    """Marks replaced in order; the default ones make quotes, dashes and ellipses ASCII and drop what has no width."""
    return substitute(text, marks)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def without_words(text: Column, words: list[str]) -> Column:
    """Drops space-separated words of a list."""
    return F.array_join(F.filter(F.split(text, " ", -1), lambda w: ~w.isin(words)), " ")


def capitalised(text: Column) -> Column:
    """Each space-separated word with an upper first letter (ASCII); the rest stays as it is."""
    return F.array_join(F.transform(F.split(text, " ", -1), lambda w: F.concat(F.translate(F.left(w, F.lit(1)), _LOWER, _UPPER), F.substr(w, F.lit(2)))), " ")


def flat(text: Column) -> Column:
    """Runs of line ends and tabs as one space, then double spaces once, trimmed."""
    return F.trim(F.replace(F.regexp_replace(text, "[\n\t\r]+", " "), F.lit("  "), F.lit(" ")))


def without_citations(text: Column, pattern: str = r"\[[0-9]{1,5}\]") -> Column:
    """Citations as a space, double spaces once, trimmed."""
    return F.trim(F.replace(F.regexp_replace(text, pattern, " "), F.lit("  "), F.lit(" ")))


def has_word(text: Column, word: str) -> Column:
    """Whether a lower-case ASCII word stands alone in a text, in any case."""
    return F.lower(text).rlike(f"(^|[^a-z0-9]){word}([^a-z0-9]|$)")


def words_in(text: Column, words: Iterable[str]) -> Column:
    """Those of a list of lower-case ASCII words that stand alone in a text, in any case; the text is split once for all of them."""
    return F.array_intersect(F.split(F.lower(text), "[^a-z0-9]+"), F.array(*map(F.lit, dict.fromkeys(words))))


def is_header(line: Column) -> Column:
    """A numbered heading, or a line whose letters are all upper-case ASCII."""
    return line.rlike(r"^[0-9]+(\.[0-9]+)* [A-Z]") | (line.rlike("[A-Z]") & ~line.rlike("[^A-Z0-9 !?.,]"))


def quality(text: Column) -> dict[str, Column]:
    """n_words, n_capitalised, n_single and n_letters (ASCII) of a line of text."""
    words = F.filter(F.split(text, " ", -1), lambda w: w != "")
    return {
        "n_words": F.size(words), "n_capitalised": F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))),
        "n_single": F.size(F.filter(words, lambda w: F.length(w) == 1)),
        "n_letters": F.length(F.regexp_replace(text, "[^A-Za-z]", "")),
    }


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (length of a + length of b). One row of the table a character of a: cells that meet an equal character come from the row before at once,
    and the running maximum over the row is taken in blocks, so that no array is copied a cell."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    y, n = chars(b), F.length(b)

    def row(before: Column, x: Column) -> Column:
        # a cell is the greatest of the cell above and of all matches up to it, each one more than the cell above and left of it
        met = F.transform(y, lambda c, j: F.when(c == x, F.get(before, j) + 1).otherwise(F.get(before, j + 1)))
        start = F.struct(F.lit(0).alias("top"), F.array(F.lit(0)).alias("row"))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / 16).cast("int"), F.lit(0))), lambda k: F.slice(met, k * 16 + 1, F.lit(16)))

        def block(acc: Column, part: Column) -> Column:
            inner = F.aggregate(part, F.struct(acc["top"].alias("top"), F.array().cast("array<int>").alias("cells")),
                                lambda s, v: F.struct(F.greatest(s["top"], v).alias("top"), F.concat(s["cells"], F.array(F.greatest(s["top"], v))).alias("cells")))
            return F.get(F.transform(F.array(inner), lambda i: F.struct(i["top"].alias("top"), F.concat(acc["row"], i["cells"]).alias("row"))), F.lit(0))

        return F.aggregate(blocks, start, block, lambda acc: acc["row"])

    first = F.transform(F.sequence(F.lit(0), n), lambda _: F.lit(0))
    lcs = F.element_at(F.aggregate(chars(a), first, row), -1)
    total = F.length(a) + n
    return F.when(total == 0, F.lit(1.0)).when((F.length(a) == 0) | (n == 0), F.lit(0.0)).otherwise(2.0 * lcs / total)


def restore(text: Column, replaced: Column) -> Column:
    """A text with its placeholders (a map from placeholder to text) put back, longest first so that none matches inside another."""
    longest = F.array_sort(F.map_entries(replaced), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(longest, text, lambda t, e: F.replace(t, e["key"], e["value"]))


#: Words that say nothing about what is meant.
VAGUE = ["any", "anyone", "anything", "anywhere", "that", "this", "these", "those"]


def phrase_rank(phrase: Column, vague: Iterable[str] = VAGUE, tokens: Column | None = None) -> Column:
    """4 for vague words and for a single pronoun, 1 for phrases with a proper noun or a capital letter, else 2. tokens: the phrase's parsed tokens."""
    low = F.lower(phrase).isin(list(vague))
    proper = phrase.rlike(r"\p{Lu}")
    if tokens is not None:
        low = low | ((F.size(tokens) == 1) & (F.get(tokens, F.lit(0))["pos"] == "PRON"))
        proper = proper | F.exists(tokens, lambda t: t["pos"] == "PROPN")
    return F.when(low, 4).when(proper, 1).otherwise(2)


def unescaped(text: Column) -> Column:
    """Written-out line ends and tabs as such, words broken at a line end joined, runs of line ends as one, trimmed."""
    out = text
    for mark, by in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("- ", "")):
        out = F.replace(out, F.lit(mark), F.lit(by))
    return F.trim(F.regexp_replace(out, "\n+", "\n"))


def good_line(line: Column) -> Column:
    """Whether a line is prose: it ends in a colon, or is long, mostly letters, with few capitalised and few one-letter words."""
    q = quality(line)
    prose = (F.length(line) > 64) & (2 * q["n_capitalised"] < q["n_words"]) & (2 * q["n_letters"] >= F.length(line))
    return line.endswith(":") | (prose & (2 * q["n_single"] < q["n_words"]))
