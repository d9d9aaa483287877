"""Text of addresses as column expressions: folding, tokens, house numbers, similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and signs that fold to something else than their decomposition's first letter.
WIDE = {"œ": "oe", "æ": "ae", "ß": "ss", "½": " 1/2", "¼": " 1/4", "¾": " 3/4", "°": "deg", "²": "2", "³": "3", "¹": "1", "ª": "a", "º": "o", "þ": "th", "ŋ": "ng", "ĳ": "ij", "’": "'"}
PLAIN = {"ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t", "ſ": "s", "ĸ": "k"}
GREEK = dict(zip("αβγδεζηικλμνξοπρσςτυφω", "abgdeziiklmnxoprsstufo"))
GREEK_WIDE = {"θ": "th", "χ": "kh", "ψ": "ps"}
CYRILLIC = dict(zip("абвгдезийклмнопрстуфыэіўґ", "abvgdeziiklmnoprstufyeiug"))
CYRILLIC_WIDE = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "є": "ie", "ї": "yi", "ъ": "'", "ь": "'"}
ORDINALS = {"bis": "b", "ter": "t", "quater": "q", "quinquies": "c", "sexies": "s"}


def _folded_letters() -> dict[str, str]:
    """Lower-case letters that fold to one ASCII letter: Latin, Greek and Cyrillic ones with marks by their decomposition."""
    out = PLAIN | GREEK | CYRILLIC
    for block in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x386, 0x3CF), (0x450, 0x460)):
        for letter in map(chr, range(*block)):
            base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
            base = out.get(base, base)
            if letter == letter.lower() and letter not in out and letter not in WIDE and len(base) == 1 and "a" <= base <= "z":
                out[letter] = base
    return out


LETTERS = _folded_letters()
_SEVERAL = WIDE | GREEK_WIDE | CYRILLIC_WIDE


def transliterated(text: Column) -> Column:
    """Lower case; accents dropped from Latin, Greek and Cyrillic letters, which become Latin ones. Other scripts stay, and folding drops them."""
    low = F.lower(text)
    plain = F.translate(low, "".join(LETTERS), "".join(LETTERS.values()))
    spelt = plain
    for letter, several in _SEVERAL.items():
        spelt = F.replace(spelt, F.lit(letter), F.lit(several))
    return F.when(~low.rlike(r"[^\x00-\x7F]"), low).when(~plain.rlike(f"[{''.join(_SEVERAL)}]"), plain).otherwise(spelt)


def fold(text: Column) -> Column:
    """Lower-case ASCII words parted by one space."""
    return F.trim(F.regexp_replace(transliterated(text), "[^a-z0-9_]+", " "))


def tokens(text: Column) -> Column:
    """The words of the folded text; none for null or blank."""
    folded = fold(F.coalesce(text, F.lit("")))
    return F.when(folded == "", F.array().cast("array<string>")).otherwise(F.split(folded, " "))


def without_leading_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"\b0+(\d{1,3})\b", "$1")


def short_ordinal(suffix: Column) -> Column:
    """bis -> b and so on; a letter stays; anything else is null."""
    low = F.lower(suffix)
    out = F.when(low.rlike("^[a-z]$"), low)
    for word, short in ORDINALS.items():
        out = out.when(low == word, short)
    return out


def split_housenumber(number: Column) -> Column:
    """num, complement and short complement of a house number as written; empty parts are null."""
    part = F.trim(F.regexp_extract(number, r"^([0-9]*)(.*)$", 2))
    return F.struct(F.nullif(F.regexp_extract(number, r"^([0-9]*)(.*)$", 1), F.lit("")).alias("num"), F.nullif(part, F.lit("")).alias("complement"), short_ordinal(part).alias("short"))


def bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters, repeats included."""
    n = F.char_length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def gram_codes(text: Column) -> Column:
    """The bigrams of an ASCII text as numbers, each repeat of one with a number of its own: a multiset as a set."""
    n = F.char_length(text)
    codes = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.ascii(F.substring(text, i, F.lit(1))) * 128 + F.ascii(F.substring(text, i + 1, F.lit(1))))).otherwise(F.array().cast("array<int>"))
    earlier = lambda c, g, i: F.size(F.filter(F.slice(c, F.lit(1), i), lambda h: h == g))
    return let(codes, lambda c: F.transform(c, lambda g, i: F.when(F.array_position(c, g) == i + 1, g).otherwise(g + 16384 * earlier(c, g, i))))


def prefixed_codes(prefix: Column, text: Column, codes: Column) -> Column:
    """gram_codes of prefix and text with a space between, given those of the text."""
    raw = F.filter(gram_codes(F.concat(prefix, F.lit(" "), F.left(text, F.lit(1)))), lambda c: c >= 0)
    return let(raw, lambda own: F.concat(codes, F.transform(own, lambda g: g + 16384 * F.size(F.filter(codes, lambda c: c % 16384 == g % 16384)))))


def code_similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard similarity of two texts' gram_codes; 0 if they share none."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(n == 0, 0.0).otherwise(n / (F.size(a) + F.size(b) - n)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard similarity of the bigrams of two texts; two single characters compare as such.

    Pairs are counted one by one only where both texts repeat some; otherwise those in common are a set.
    """
    times = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))

    def shared(g: Column) -> Column:
        x, y = g["x"], g["y"]
        once = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
        counted = let(F.array_intersect(x, y), lambda common: F.when(once, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda s, p: s + F.least(times(x, p), times(y, p)))))
        return let(counted, lambda n: F.when(n == 0, 0.0).otherwise(n / (F.size(x) + F.size(y) - n)))

    short = (F.char_length(a) < 2) | (F.char_length(b) < 2)
    return F.when(short, (a == b).cast("double")).otherwise(let(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")), shared))


def rounded(x: Column) -> Column:
    """Two decimals, half to even on the exact binary value."""
    return F.call_function("format_number", x, F.lit("0.00")).cast("double")


def python_number(x: Column) -> Column:
    """A double as Python writes it, with an exponent below 1e-4 and from 1e16 on; the digits are those that the JVM finds, which for a few doubles are one more than the fewest."""
    written = x.cast("string")  # shortest digits too, but an exponent below 1e-3 and from 1e7 on
    digits = F.regexp_replace(F.regexp_replace(written, "E.*$|-|[.]", ""), "^0+(?=.)", "")
    digits = F.regexp_replace(digits, "(?<=.)0+$", "")
    exponent = F.when(written.contains("E"), F.regexp_extract(written, "E(-?[0-9]+)", 1).cast("int"))
    sign = F.when(written.startswith("-"), "-").otherwise("")
    n = F.length(digits)
    point = exponent + 1
    fixed = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    apart = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), power)
    named = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(named, F.when(exponent.isNull(), written), F.concat(sign, F.when((exponent >= -4) & (exponent < 16), fixed).otherwise(apart)))
