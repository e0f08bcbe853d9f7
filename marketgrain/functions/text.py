"""Text, name and money-text functions on columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols near prices and their currencies; the first one contained decides.
SYMBOLS = [
    ("€", "EUR"), ("$", "USD"), ("£", "GBP"), ("₴", "UAH"), ("₽", "RUB"), ("zł", "PLN"), ("₺", "TRY"), ("₸", "KZT"), ("₾", "GEL"), ("₼", "AZN"),
    ("лв", "BGN"), ("kč", "CZK"), ("kr", "SEK"), ("ft", "HUF"), ("lei", "RON"), ("din", "RSD"), ("ден", "MKD"), ("сўм", "UZS"), ("сом", "KGS"), ("br", "BYN"), ("sm", "TJS"),
]
#: Currency words near prices; the first one contained decides.
CODES = [
    ("usd", "USD"), ("eur", "EUR"), ("gbp", "GBP"), ("uah", "UAH"), ("грн", "UAH"), ("rub", "RUB"), ("руб", "RUB"), ("р.", "RUB"), ("pln", "PLN"), ("ron", "RON"),
    ("try", "TRY"), ("tl", "TRY"), ("kzt", "KZT"), ("тг", "KZT"), ("тенге", "KZT"), ("byn", "BYN"), ("бел.руб", "BYN"), ("gel", "GEL"), ("azn", "AZN"), ("man", "AZN"),
    ("bgn", "BGN"), ("czk", "CZK"), ("sek", "SEK"), ("nok", "NOK"), ("dkk", "DKK"), ("huf", "HUF"), ("hrk", "HRK"), ("rsd", "RSD"), ("mdl", "MDL"), ("лей", "MDL"),
    ("лэй", "MDL"), ("chf", "CHF"), ("uzs", "UZS"), ("kgs", "KGS"), ("tjs", "TJS"),
]
#: Words around a price that speak for it, and against it.
FOR_PRICE = ("price", "цена", "стоимость", "total", "итого", "sale", "our price")
AGAINST_PRICE = ("%", "cashback", "кэшбэк", "bonus", "бонус", "скидка", "discount", "save", "эконом")
#: The shape of amounts, the greatest price, how far context reaches, and what each finding counts.
AMOUNT = r"\d{1,3}(?:[ .,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
MAX_PRICE = 5_000_000.0
CONTEXT = 20
POINTS_MONEY, POINTS_FOR, POINTS_AGAINST, POINTS_BELOW_ONE, POINTS_TOO_LARGE = 8, 4, -6, -3, -20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` found once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_contained(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the table's first token that ``text`` contains, ignoring case; null if none."""

    def found_in(low: Column) -> Column:
        found = F.lit(None).cast("string")
        for token, value in reversed(table):
            found = F.when(low.contains(token), value).otherwise(found)
        return found

    # most texts hold no token at all, which one pattern tells
    return let(F.lower(text), lambda low: F.when(low.rlike(_any_of([t for t, _ in table])), found_in(low)))


def shows_symbol(text: Column) -> Column:
    """Whether ``currency_symbol`` finds one; null for null."""
    return F.lower(text).rlike(_any_of([t for t, _ in SYMBOLS]))


def currency_symbol(text: Column) -> Column:
    return first_contained(text, SYMBOLS)


def currency_code(text: Column) -> Column:
    return first_contained(text, CODES)


def currency(text: Column) -> Column:
    return F.coalesce(currency_symbol(text), currency_code(text))


def normal_name(name: Column) -> Column:
    """Lower case, single spaces, at most 500 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s+|\s+$", ""), r"\s+", " "), 1, 500)


def is_placeholder(name: Column, url: Column) -> Column:
    """Whether a product's name says nothing: none, "product", its own URL, or digits with blanks, dashes and underscores."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return (bare == "") | (F.lower(bare) == "product") | F.coalesce(bare == url, F.lit(False)) | F.regexp_replace(bare, "[ _-]", "").rlike(r"^\d+$")


def title_from_url(url: Column) -> Column:
    """The last path segment with blanks for dashes and underscores; without one, the URL; at most 500 characters."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    title = F.translate(last, "-_", "  ")
    return F.substring(F.when(title != "", title).when(url != "", url).otherwise("product"), 1, 500)


def relay_line(line: Column) -> Column:
    """Single spaces; lines over 480 characters end in three dots there."""
    one = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(F.length(one) > 480, F.concat(F.substring(one, 1, 477), F.lit("..."))).otherwise(one)


def masked_url(url: Column) -> Column:
    """The URL with its credentials starred out."""
    return F.regexp_replace(url, r"://[^/@]*@", "://***@")


def _any_of(words: list[str] | tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def amount(token: Column) -> Column:
    """The positive value of digits with marks: the last mark is the decimal one if both kinds occur, or if one or two digits
    follow a single mark, or a last comma; other marks group. Null for marks that are neither."""

    def marked(bare: Column) -> Column:
        marks, tail = F.regexp_replace(bare, r"\d", ""), F.regexp_extract(bare, r"(\d*)$", 1)
        last, both, short = F.right(marks, F.lit(1)), marks.contains(".") & marks.contains(","), F.length(tail) <= 2
        decimal = (marks != "") & (both | (short & ((F.length(marks) == 1) | (last == ","))))
        digits = F.regexp_replace(bare, "[.,]", "")
        whole = F.substring(digits, F.lit(1), F.length(digits) - F.length(tail))
        value = F.when(decimal, F.concat(whole, F.lit("."), tail)).otherwise(digits).try_cast("double")
        odd = (both & (F.length(F.replace(marks, last, F.lit(""))) < F.length(marks) - 1)) | (~both & (F.length(marks) > 1) & (last == ".") & short)
        return F.when(~F.coalesce(odd, F.lit(False)), value)

    # digits alone, or with one dot and one or two more, are read as they stand
    value = F.when(token.rlike(r"^\d+(\.\d{1,2})?$"), token.try_cast("double")).otherwise(let(F.replace(token, F.lit(" "), F.lit("")), marked))
    return let(value, lambda v: F.when(v > 0, v))


def price(text: Column | str) -> Column:
    """The most price-like amount of a text: a currency or a price word near it speaks for it, a discount word against; of
    equally good ones the greatest. Null if there is none, or if the best is over the limit."""
    spaced = F.translate(F.col(text) if isinstance(text, str) else text, "\u00a0\u202f\u2009", "   ")

    def scored(p: Column, i: Column) -> Column:
        """What counts for token i, from what stands around it: up to CONTEXT characters on either side."""
        token = F.get(p["tokens"], i)
        size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda k, p: k + F.length(p))
        start = size(p["between"], i + 1) + size(p["tokens"], i)
        near = lambda at: F.lower(F.substring(p["text"], F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT)) + F.length(token) + CONTEXT))
        around = let(start, lambda at: F.struct(amount(token).alias("value"), near(at).alias("near")))
        return let(around, lambda x: let(x["near"].rlike(_any_of([t for t, _ in SYMBOLS + CODES])), lambda money: points(x["value"], x["near"], money)))

    def points(value: Column, near: Column, money: Column) -> Column:
        found = F.when(money, POINTS_MONEY).otherwise(0) + F.when(near.rlike(_any_of(FOR_PRICE)), POINTS_FOR).otherwise(0) + F.when(near.rlike(_any_of(AGAINST_PRICE)), POINTS_AGAINST).otherwise(0) + F.when(value < 1, POINTS_BELOW_ONE).when(value > MAX_PRICE, POINTS_TOO_LARGE).otherwise(0)
        # an amount that is too large competes only beside a currency
        return F.when(value.isNotNull() & ((value <= MAX_PRICE) | money), F.struct(found.alias("points"), value.alias("value")))

    def best(text: Column, tokens: Column) -> Column:
        parts = F.struct(tokens.alias("tokens"), F.split(text, AMOUNT, -1).alias("between"), text.alias("text"))
        return let(parts, lambda p: F.array_max(F.transform(F.sequence(F.lit(0), F.size(p["tokens"]) - 1), lambda i: scored(p, i)))["value"])

    def found(x: Column) -> Column:
        # an only amount needs no rivals told apart
        value = F.when(F.size(x["tokens"]) == 1, amount(F.get(x["tokens"], F.lit(0)))).when(F.size(x["tokens"]) > 1, best(x["text"], x["tokens"]))
        return let(value, lambda v: F.when(v <= MAX_PRICE, v))

    return let(let(spaced, lambda t: F.struct(t.alias("text"), F.regexp_extract_all(t, F.lit(AMOUNT), 0).alias("tokens"))), found)
