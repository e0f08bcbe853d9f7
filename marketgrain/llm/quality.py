"""Quality rules, line first, in DataFrame functions only.

Lines that break a rule are removed: navigation (several ``|`` or ``>`` separators), boilerplate phrases, symbols in
place of prose, and scraps of fewer than three words without closing punctuation. A document is kept if it passes
the base rules and its remaining lines hold enough of its words.

Nulls and edges: a null or empty text has no words, fails the base rules and isn't kept; rows are judged one by one,
so repeated rows give repeated results; texts of any length are read whole; any further columns are carried along whatever
their names, except those named as the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The share of a document's words that its remaining lines must hold.
MIN_KEPT_PERCENT = 50
#: Symbols a word from which a line counts as symbols rather than prose.
MAX_LINE_SYMBOLS_PERCENT = 50
#: Phrases of page furniture in the languages of the tables: the published C4 cleaning rules' (lorem ipsum, JavaScript
#: notices, terms of use, privacy and cookie policies, use of cookies), footers' and buttons', and what pages in the other languages say for them.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "use cookies", "use of cookies", "enable javascript", "lorem ipsum", "click here", "sign up for our", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookie-richtlinie", "verwendet cookies", "verwendung von cookies", "javascript aktivieren", "hier klicken", "newsletter abonnieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "utilisation de cookies", "activer javascript", "cliquez ici", "mentions légales",
    "todos los derechos reservados", "condiciones de uso", "términos de uso", "política de privacidad", "política de cookies", "uso de cookies", "activar javascript", "haga clic aquí", "aviso legal",
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _not_alone(ordered: Column, same) -> Column:
    """The elements of a sorted array that are the same as a neighbour."""
    return F.filter(ordered, lambda x, i: F.coalesce(same(x, F.get(ordered, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(ordered, i + 1)), F.lit(False)))


def _covered(starts: Column) -> Column:
    """How many places lie within three of the sorted starts."""
    three = F.lit(3).cast("long")
    gaps = F.transform(starts, lambda s, i: F.least(three, F.coalesce(F.get(starts, i + 1) - s, three)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)


def repeated_window_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the array column ``words``."""
    n = F.size(words)
    # the last two words start no window; windows are told apart by 64-bit hashes
    heads = F.slice(words, 1, F.greatest(n - 2, F.lit(0)))
    hashes = F.transform(heads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def starts(h: Column) -> Column:
        paired = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return F.sort_array(_let(paired, lambda p: F.transform(_not_alone(p, lambda a, b: a["h"] == b["h"]), lambda x: x["i"])))

    # most texts repeat no window: they need no sort
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(starts(h), _covered)))


def _boilerplate(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return found


def _count(text: Column, character: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


def line_fails(line: Column, symbols: Column, boilerplate: Column) -> Column:
    """Whether a line breaks a rule; lines without a word don't. ``symbols`` and ``boilerplate`` tell whether the
    document has any, so that most lines are spared those tests."""
    worded = line.rlike(r"[^\x20\x09-\x0D]")
    navigation = symbols & (_count(line, "|") + _count(line, "<") + _count(line, ">") >= 3)
    symbolic = symbols & (100 * (F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))) >= MAX_LINE_SYMBOLS_PERCENT * F.size(words_of(line)))
    three_words = line.rlike(r"[^\x20\x09-\x0D][\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]")
    scrap = ~three_words & worded & ~line.rlike(r"[.!?:;…\"'”’)]" + SPACE + "*$")
    return scrap | navigation | symbolic | (boilerplate & _boilerplate(line))


def quality_rules(docs: DataFrame, text_column: str = "text", with_text: bool = True) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words, base_failed, kept, and cleaned_text if asked for."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept", "cleaned_text")
    kept = [c for c in docs.columns if c not in names]
    # the document's own columns are one field, so none of theirs and ours can clash
    docs = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    split = docs.withColumns(
        {
            "words": words_of(text),
            "lines": F.split(text, "\n"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "boilerplate": _boilerplate(text),
        }
    )
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    fails = lambda x: line_fails(x, F.col("n_symbols") > 0, F.col("boilerplate"))
    lost = F.aggregate(F.filter(lines, fails), F.lit(0).cast("long"), lambda n, x: n + F.size(words_of(x)))
    counted = split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_dup_lines": _let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long"),
            "n_repeat_words": repeated_window_words(words),
            "n_kept_words": F.size(words) - lost,
        }
        | ({"cleaned_text": F.array_join(F.filter(lines, lambda x: ~fails(x)), "\n")} if with_text else {})
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_kept_words") >= MIN_KEPT_PERCENT * F.col("n_words")))
    return judged.select(*[F.col("row")[c].alias(c) for c in kept], *(c for c in names if with_text or c != "cleaned_text"))
