"""French addresses as column expressions: cleaning, ordinals, street types, synonyms, phonemes, misspellings."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

MAX_QUERY = 200

# Patterns of street types.
STREET_TYPES = (
    "aer(odrome)?", "all([ée]es?)?", "anc(ien(ne)?)?", "av(enue)?", "b(oulevar|l?v?)?d", "b(ou)?cle", "ber(ges?)?", "bois", "c(en)?tre", "c(ou)?rs?", "c[ôo]te", "carr?(efour)?", "ch(am)?p", "chauss[ée]e",
    "che?(m(in)?)?", "cit[ée]", "clos", "desserte", "devi(ation)?", "dig(ue)?", "dom(aine)?", "embr(anchement)?", "espl?(anade)?", "eta?ng", "éta?ng", "f(aubour|b|bour)?g", "giratoire", "gr(ande?)?",
    "gr(e|es|s)?", "ham(eau)?", "imp(asse)?", "j[ée]?t[ée]e", "jard(in)?", "l[ôo]t(issement)?", "mont", "mont[ée]e", "p(arvis|rvs?|vr)?", "p(asserel|l)?le", "p(lace)?tte", "p(or)?te", "parc", "pas(se)?",
    "pass(age)?", "pl(ace)?", "porte", "pr[ée]", "pro?m(enade)?", "q(uart(ier)?|ua|rt(ier)?)", "qu?(ai)?", "r(ou)?te", "r(uel|l)?le", "r(ue)?", "r[ée]s(idence)?", "rd?pt", "rocade", "rond[- ]point",
    "sent(e|ier)", "squ?(are)?", "t(erra)?sse", "taillis", "trav(erse)?", "tunn?(el)?", "v(il|l)?la", "via", "viad(uc)?", "voie", "[îi]lot",
)
# Ordinals after a house number.
ORDINAL = "bis|ter|quater|quinquies|sexies|[a-z]"
# What is rewritten in a query, in this order.
CLEAN = (
    (r"([\d]{5})", " $1 "),
    (r"(^| )(b\.?p\.?|cs|tsa|cidex) *(n(o|°|) *|)[\d]+ *", "$1"),
    (r"([\d]{2})[\d]{3}(.*)c(e|é)dex ?[\d]*", "$1$2"),
    (r"c(e|é)dex ?[\d]*", ""),
    (r"\d{0,2}(e|[eè]me) ([eé]tage)", ""),
    (r" {2,}", " "),
    (r"[ -]s/[ -]", " sur "),
    (r"[ -]s/s[ -]", " sous "),
    (r"^lieux?[ -]?dits?\b(?=.)", ""),
)
# Phonetic rewrites, in this order.
PHONEMES = (
    (r"(?<=a)(mp|nd|nt)s?$", "n"),
    (r"([aeiouy])mp(?=[^aeiouyr])", "$1n"),
    (r"ngt(?=[aeiouy])", "nt"),
    (r"ngt", "n"),
    (r"((?<=[^g])g|^g)(?=[eyi])", "j"),
    (r"(?<=g)u(?=[aeio])", ""),
    (r"(?<=ei)gn([aeiouy])", "ni$1"),
    (r"je([aeiouy])", "j$1"),
    (r"c(?=[^hieyw])", "k"),
    (r"anc$", "an"),
    (r"((?<=[^s])ch|(?<=[^0-9])c)$", "k"),
    (r"(?<=[aeiouy])s(?=[aeiouy])", "z"),
    (r"((?<=[^0-9])q|^q)u?", "k"),
    (r"cc(?=[ie])", "s"),
    (r"ck", "k"),
    (r"ph", "f"),
    (r"th$", "te"),
    (r"(?<=[^sc0-9])h", ""),
    (r"^h(?=.)", ""),
    (r"sc", "s"),
    (r"sh", "ch"),
    (r"((?<=[^0-9])w|^w)", "v"),
    (r"c(?=[eiy])", "s"),
    (r"((?<=[^0-9])y|^y)", "i"),
    (r"esn", "en"),
    (r"eim( |$)", "aim"),
    (r"(ae|ei)(?=\w)", "e"),
    (r"oeufs( |$)", "eu"),
    (r"oeu?(?=\w)", "eu"),
    (r"(?<=[^0-9])s$", ""),
    (r"(?<=u)l?x$", ""),
    (r"(?<=u)lt$", "t"),
    (r"(?<=[a-z])[dg]$", ""),
    (r"(?<=[^es0-9])t$", ""),
    (r"(?<=[aeiou])(m)(?=[pbgft])", "n"),
    (r"(?<=[a-z]{2})(e$)", ""),
    (r"(?<=[aeiouy])n[dt](?=[^aeiouyr])", "n"),
    (r"([a-z])\1+", "$1"),
)
# Words between a street type and the name after it.
LINKS = ("de", "du", "des", "d", "la", "le", "les", "l", "en")
# The keys around each key of an AZERTY keyboard.
KEYS = {
    "a": "ezqop", "z": "aqse", "e": "azsdryu", "r": "edft", "t": "rfgy", "y": "teghu", "u": "yehji", "i": "ujko", "o": "iaklp", "p": "oalm", "q": "azsw", "s": "qzedxw", "d": "serfcx",
    "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "j": "huikn", "k": "jil", "l": "kom", "m": "lpu", "w": "qsx", "x": "wsdc", "c": "xdfvio", "v": "cfgb", "b": "vghn", "n": "bhj",
}

_TYPES = "|".join(STREET_TYPES)
# An address within a query, and a house number written together with its ordinal.
_ADDRESS = rf"(?iu)(\b\d{{1,4}}( *({ORDINAL}))?,? +({_TYPES}) .*(\d{{5}})?).*"
_GLUED = rf"(?i)^(\d{{1,4}})({ORDINAL})$"


def _rewritten(text: Column, rules: Iterable[tuple[str, str]], flags: str = "") -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, flags + pattern, new)
    return text


def phonemes(word: Column) -> Column:
    """A folded word as it sounds. Costly: apply it to a vocabulary of distinct words and join."""
    return _rewritten(word, PHONEMES)


def is_street_type(word: Column) -> Column:
    return word.rlike(f"(?iu)^({_TYPES})$")


def extract_address(query: Column) -> Column:
    """From a house number before a street type to the end; the whole query without one."""
    return F.when(query.rlike(_ADDRESS), F.regexp_extract(query, _ADDRESS, 0)).otherwise(query)


def clean_query(query: Column) -> Column:
    """Without post boxes, CEDEX and floors; sur and sous spelt out."""
    return F.regexp_replace(_rewritten(query, CLEAN, "(?iu)"), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def read_synonyms(lines: Iterable[str]) -> dict[str, str]:
    """word -> words of lines "form, form => words"; the last line of a form holds. Blank and # lines don't count."""
    out = {}
    for line in lines:
        if line.strip() and not line.startswith("#"):
            forms, _, words = line.partition("=>")
            if not words.strip():
                raise ValueError(f"a synonym line holds =>: {line!r}")
            out |= {f.strip(): words.strip() for f in forms.split(",") if f.strip()}
    return out


def _glued(words: Column) -> Column:
    """(value, at): a short number and the ordinal after it become one word, where the text or a street type follows.

    A number waits for the word after it; of two numbers in a row the first is lost.
    """
    starts_type = lambda w: w.rlike(rf"(?iu)^\b({_TYPES})\b")
    waits = lambda i: F.coalesce(F.get(words, i).rlike("^[0-9]{1,4}$") & (F.get(words, i + 1) != ""), F.lit(False))
    pair = lambda value, at: F.struct(value.alias("value"), at.alias("at"))

    def emitted(word: Column, i: Column) -> Column:
        following, number = F.nullif(F.get(words, i + 1), F.lit("")), F.get(words, i - 1)
        glue = word.rlike(rf"(?i)^\b({ORDINAL})\b") & (following.isNull() | starts_type(following))
        joined = F.replace(F.concat(number, word), F.lit(" "), F.lit(""))
        return F.when(waits(i), F.array().cast("array<struct<value:string,at:int>>")).when(~waits(i - 1), F.array(pair(word, i))).when(glue, F.array(pair(joined, i - 1))).otherwise(F.array(pair(number, i - 1), pair(word, i)))

    return F.flatten(F.transform(words, emitted))


def _numbered(glued: Column) -> Column:
    """(value, at, housenumber): ordinals shortened; the first number that begins the text or precedes a street type is the house number."""
    short = lambda v: F.when(v.rlike(_GLUED), F.concat(F.regexp_extract(v, _GLUED, 1), T.short_ordinal(F.regexp_extract(v, _GLUED, 2)))).otherwise(v)
    folded = F.transform(glued, lambda x: F.struct(short(x["value"]).alias("value"), x["at"].alias("at")))

    def flagged(words: Column) -> Column:
        may = lambda x, j: x["value"].rlike(r"^\b\d{1,4}[a-z]?\b") & ((x["at"] == 0) | F.coalesce(F.get(words, j + 1)["value"].rlike(rf"(?iu)^\b({_TYPES})\b"), F.lit(False)))
        first = F.array_min(F.transform(words, lambda x, j: F.when(may(x, j), j)))
        return T.let(first, lambda f: F.transform(words, lambda x, j: F.struct(x["value"].alias("value"), x["at"].alias("at"), F.coalesce(j == f, F.lit(False)).alias("housenumber"))))

    return T.let(folded, flagged)


def _tokens(text: Column, synonyms: dict[str, str]) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{IsAlphabetic}\p{N}_]+)"), F.lit(1)), T.transliterated)
    table = F.from_json(F.lit(json.dumps(synonyms)), "map<string,string>") if synonyms else None  # a constant
    meant = lambda v: F.coalesce(F.try_element_at(table, v), v) if table is not None else v

    def spoken(x: Column) -> Column:
        parts = F.filter(F.split(meant(x["value"]), r"\s+"), lambda p: p != "")
        return F.transform(parts, lambda p, k: F.struct(phonemes(p).alias("value"), x["housenumber"].alias("housenumber"), x["at"].alias("at"), k.alias("part")))

    return F.flatten(F.transform(T.let(T.let(words, _glued), _numbered), spoken))


def index_tokens(text: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The words of a document's text as they are indexed; none for null."""
    return F.transform(_tokens(F.coalesce(text, F.lit("")), synonyms or {}), lambda x: x["value"])


def query_tokens(query: Column, synonyms: dict[str, str] | None = None) -> Column:
    """(value, housenumber, at, part) of a query's words; null for a query of over 200 characters, counted as it is given."""
    cleaned = T.without_leading_zeros(clean_query(extract_address(F.coalesce(query, F.lit("")))))
    return F.when(F.coalesce(F.char_length(query), F.lit(0)) <= MAX_QUERY, _tokens(cleaned, synonyms or {}))


def search_tokens(query: Column, synonyms: dict[str, str] | None = None) -> Column:
    """query_tokens of the folded query, as search sees it: punctuation is gone, and the limit counts folded characters."""
    return query_tokens(T.fold(F.coalesce(query, F.lit(""))), synonyms)


def housenumber_token(number: Column, synonyms: dict[str, str] | None = None) -> Column:
    return F.array_join(index_tokens(number, synonyms), "")


def misspellings(word: Column) -> Column:
    """Words one slip away, each once: neighbours swapped, keys beside, letters added, letters left out of over three."""
    n = F.char_length(word)
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    left, right = lambda i: F.substring(word, F.lit(1), i), lambda i: F.substring(word, i, n)
    at = lambda i: F.substring(word, i, F.lit(1))
    swapped = F.transform(F.filter(places, lambda i: i < n), lambda i: F.concat(left(i - 1), at(i + 1), at(i), right(i + 2)))
    keys = F.create_map(*(x for key, near in KEYS.items() for x in (F.lit(key), F.array(*map(F.lit, near)))))
    beside = F.flatten(F.transform(places, lambda i: F.transform(F.coalesce(F.try_element_at(keys, at(i)), F.array().cast("array<string>")), lambda k: F.concat(left(i - 1), k, right(i + 1)))))
    letters = F.array(*(F.lit(chr(97 + i)) for i in range(26)))
    added = F.flatten(F.transform(letters, lambda x: F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.concat(left(i - 1), x, right(i)))))
    dropped = F.when(n > 3, F.transform(places, lambda i: F.concat(left(i - 1), right(i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(swapped, beside, added, dropped))


def words(text: Column) -> Column:
    """The folded words of a commune's name or of a query; saint and sainte as they are shortened."""
    return F.transform(T.tokens(text), lambda w: F.when(w == "saint", "st").when(w == "sainte", "ste").otherwise(w))


def is_postcode(word: Column) -> Column:
    return word.rlike("^[0-9]{5}$")


def departement(postcode: Column) -> Column:
    """A postcode's first two digits, three overseas."""
    return F.left(postcode, F.when(F.startswith(postcode, F.lit("97")), 3).otherwise(2))


def spaced(text: Column) -> Column:
    """The words of a text as they are written, parted by blanks."""
    return F.filter(F.split(text, r"[\s\x1c-\x1f\x85\u00a0]+"), lambda w: w != "")


def postcodes(query: Column) -> Column:
    return F.filter(spaced(query), is_postcode)


def without_postcode(query: Column) -> Column:
    """The query without its words of five digits; null if it has none, or nothing else."""
    every = spaced(query)
    kept = F.filter(every, lambda w: ~is_postcode(w))
    return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(every)), F.array_join(kept, " "))


def after_street_type(before: Column) -> Column:
    """Whether the words of an array end with a street type, then any articles and prepositions."""
    others = F.filter(F.transform(before, lambda w, i: F.when(~w.isin(*LINKS), i)), lambda i: i.isNotNull())
    return F.coalesce(is_street_type(F.get(before, F.array_max(others))), F.lit(False))


def names(query: Column, name: Column) -> Column:
    """Whether a query's words hold a commune's: as neighbours, and not as a street's name, unless at the end or before a postcode."""
    n, m = F.size(query), F.size(name)
    places = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), F.greatest(n - m, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        ends = (i + m == n) | F.coalesce(is_postcode(F.get(query, i + m)), F.lit(False))
        return (F.slice(query, i + 1, m) == name) & (ends | ~after_street_type(F.slice(query, F.lit(1), i)))

    return F.exists(places, here)


def labels(names: Column, postcode: Column, cities: Column, number: Column, kind: Column) -> Column:
    """What a document may be called, the fullest first; each with the house number before it where there is one."""
    none = F.array().cast("array<string>")
    given = F.coalesce(postcode, F.lit("")) != ""

    def called(name: Column, city: Column) -> Column:
        apart = (F.coalesce(city, F.lit("")) != "") & (city != name)
        full = F.when(apart & given, F.array(F.concat_ws(" ", name, postcode, city), F.concat_ws(" ", name, postcode))).otherwise(none)
        town = F.when((kind == "municipality") & given, F.array(F.concat_ws(" ", postcode, name), F.concat_ws(" ", name, postcode))).otherwise(none)
        plain = F.concat(full, F.when(apart, F.array(F.concat_ws(" ", name, city))).otherwise(none), F.array(name), town)
        return F.when(number.isNull(), plain).otherwise(F.flatten(F.transform(plain, lambda x: F.array(F.concat_ws(" ", number, x), x))))

    listed = F.when(F.size(cities) > 0, cities).otherwise(F.array(F.lit("")))
    return F.flatten(F.transform(names, lambda name: F.flatten(F.transform(listed, lambda city: called(name, city)))))


def best_similarity(scores: Column, enough: float = 0.9) -> Column:
    """The first score that is enough, or else the largest."""
    return F.coalesce(F.get(F.filter(scores, lambda s: s >= enough), F.lit(0)), F.array_max(scores))


def best_of(labels_: Column, score, enough: float = 0.9) -> Column:
    """best_similarity of each label's score; labels after a good one are not looked at."""
    return F.aggregate(labels_, F.lit(0.0), lambda best, x: F.when(best >= enough, best).otherwise(F.greatest(best, score(x))))


def autocomplete_similarity(label: Column, query: Column) -> Column:
    """1 for the query itself, 0.9 where it begins the label, 0.7 where it is within, otherwise nine tenths of the bigrams' similarity; both folded."""
    return F.when(label == query, 1.0).when(F.startswith(label, query), 0.9).when(F.contains(label, query), 0.7).otherwise(T.similarity(label, query) * 0.9)
