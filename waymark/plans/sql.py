"""What the driver's queries return, in DuckDB's SQL, from the tables alone: nothing here reads the engine's rules or tables."""

from __future__ import annotations

_FOLD = "trim(regexp_replace(replace(strip_accents(lower({0})), 'ß', 'ss'), '[^a-z0-9_]+', ' ', 'g'))"

#: The phonetic rules without looking around: what a rule only looks at is captured and put back; twice where matches may overlap. Capitals are out of a rule's reach until it is done.
_RULES = (
    ("a(mp|nd|nt)s?$", "an", 1), ("([aeiouy])mp([^aeiouyr])", r"\1n\2", 1), ("ngt([aeiouy])", r"nt\1", 1), ("ngt", "n", 1), ("(^|[^g])g([eyi])", r"\1j\2", 2), ("gu([aeio])", r"g\1", 1), ("eign([aeiouy])", r"eini\1", 1),
    ("je([aeiouy])", r"j\1", 1), ("c([^hieyw])", r"k\1", 2), ("anc$", "an", 1), ("([^s])ch$", r"\1k", 1), ("([^0-9])c$", r"\1k", 1), ("([aeiouy])s([aeiouy])", r"\1z\2", 2), ("(^|[^0-9])qu?", r"\1k", 2), ("cc([ie])", r"s\1", 1),
    ("ck", "k", 1), ("ph", "f", 1), ("th$", "te", 1), ("([^sc0-9])h", r"\1", 2), ("^h(.)", r"\1", 1), ("sc", "s", 1), ("sh", "ch", 1), ("(^|[^0-9])w", r"\1v", 2), ("c([eiy])", r"s\1", 1), ("(^|[^0-9])y", r"\1i", 2),
    ("esn", "en", 1), ("eim$", "aim", 1), ("ae$", "AE", 1), ("ei$", "EI", 1), ("ae|ei", "e", 1), ("", "", -1), ("oeufs$", "eu", 1), ("oeu$", "EUU", 1), ("oe$", "OE", 1), ("oeu?", "eu", 1), ("", "", -1), ("([^0-9])s$", r"\1", 1), ("ul?x$", "u", 1), ("ult$", "ut", 1), ("([a-z])[dg]$", r"\1", 1),
    ("([^es0-9])t$", r"\1", 1), ("([aeiou])m([pbgft])", r"\1n\2", 1), ("([a-z]{2})e$", r"\1", 1), ("([aeiouy])n[dt]([^aeiouyr])", r"\1n\2", 1),
)


def _sound(x: str) -> str:
    """SQL for how a folded word sounds."""
    for pattern, new, times in _RULES:
        if times < 0:
            x = f"lower({x})"
        for _ in range(times):
            x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{letter}{{2,}}', '{letter}', 'g')"
    return x


_NUMBERS = "un,deux,trois,quatre,cinq,six,sept,huit,neuf,dix,onze,douze,treize,quatorze,quinze,seize,dix sept,dix huit,dix neuf,vingt".split(",")
_SPELT = ", ".join(f"('{n}', '{w}')" for n, w in enumerate(_NUMBERS, 1)) + ", ('av', 'avenue'), ('st', 'saint'), ('zi', 'zone industrielle'), ('100', 'cent'), ('pla', 'place'), ('col', 'colonel')"

_N = "p_size % 7"
_GAZ = f"""gaz AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 10 = 0 THEN 'municipality' ELSE 'street' END AS kind, p_name AS name, p_brand AS city, p_type AS context, {_N} AS k,
 lpad(CAST(p_size * 1000 AS VARCHAR), 5, '0') AS postcode, p_retailprice / 1000 AS importance, 42.0::DOUBLE + (p_partkey * 37 % 900)::DOUBLE / 100 AS lat, -1.0::DOUBLE + (p_partkey * 53 % 700)::DOUBLE / 100 AS lon,
 row_number() OVER (ORDER BY p_retailprice DESC, CAST(p_partkey AS VARCHAR)) - 1 AS doc FROM part)"""
_SPEECH = f"spelt(w, words) AS (VALUES {_SPELT})"
_TOKENS = f"""{_GAZ}, {_SPEECH}, f AS (SELECT doc, importance, 1 AS fld, name AS t, 4.0::DOUBLE AS boost FROM gaz UNION ALL SELECT doc, importance, 2, postcode, CASE WHEN kind = 'municipality' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END FROM gaz
 UNION ALL SELECT doc, importance, 3, city, 1.0::DOUBLE FROM gaz UNION ALL SELECT doc, importance, 4, context, 1.0::DOUBLE FROM gaz),
 r AS (SELECT doc, importance, fld, boost, unnest(string_split({_FOLD.format("t")}, ' ')) AS w FROM f),
 v AS (SELECT w, unnest(string_split(coalesce(words, w), ' ')) AS x FROM (SELECT DISTINCT w FROM r) LEFT JOIN spelt USING (w)), u AS MATERIALIZED (SELECT w, {_sound("x")} AS token FROM v),
 t AS (SELECT doc, importance, fld, boost, token, count(*) OVER (PARTITION BY doc, fld) AS n FROM r JOIN u USING (w)),
 p AS MATERIALIZED (SELECT token, doc, max((1.0::DOUBLE / n) * (boost + importance * 0.1::DOUBLE)) AS score FROM t WHERE token <> '' GROUP BY ALL), s AS MATERIALIZED (SELECT token, count(*) AS df, max(score) AS max_score FROM p GROUP BY token)"""


def _asked(query: str, condition: str = "p_partkey % 50 = 0", qid: str = "p_partkey") -> str:
    """CTEs q (qid, the folded query) and b: the documents with all of its words, ranked, of the query's own text or that without a number before it."""
    return f"""q AS MATERIALIZED (SELECT {qid} AS qid, p_partkey AS own, {_FOLD.format(query)} AS q FROM part WHERE {condition}), qw AS (SELECT qid, unnest(string_split(regexp_replace(q, '^[0-9]+b? ', ''), ' ')) AS w FROM q),
 qx AS (SELECT qid, unnest(string_split(coalesce(words, w), ' ')) AS x FROM qw LEFT JOIN spelt USING (w)), kk AS MATERIALIZED (SELECT DISTINCT qid, {_sound("x")} AS token FROM qx), nk AS (SELECT qid, count(*) AS n FROM kk GROUP BY qid),
 m AS (SELECT kk.qid, p.doc, count(*) AS c, list_sum(list(p.score ORDER BY s.df, p.token)) AS total FROM kk JOIN p USING (token) JOIN s USING (token) GROUP BY ALL),
 b AS MATERIALIZED (SELECT m.qid, m.doc, total, row_number() OVER (PARTITION BY m.qid ORDER BY round(total, 9) DESC, m.doc) AS rank FROM m JOIN nk ON m.qid = nk.qid AND m.c = nk.n)"""


_GRAMS = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"


def _bigram(a: str, b: str) -> str:
    x, y = _GRAMS.format(a), _GRAMS.format(b)
    shared = f"list_sum(list_transform(list_distinct({x}), lambda g: least(len(list_filter({x}, lambda h: h = g)), len(list_filter({y}, lambda h: h = g)))))"
    return f"coalesce({shared}, 0)::DOUBLE / (len({x}) + len({y}) - coalesce({shared}, 0))"


#: What a document may be called, in order; a number comes before each, the plain one after it.
_CALLED = "CASE WHEN no IS NULL THEN list_filter([name || ' ' || postcode || ' ' || city, name || ' ' || postcode, name || ' ' || city, name, CASE WHEN kind = 'municipality' THEN postcode || ' ' || name END, CASE WHEN kind = 'municipality' THEN name || ' ' || postcode END], lambda x: x IS NOT NULL) ELSE flatten(list_transform([name || ' ' || postcode || ' ' || city, name || ' ' || postcode, name || ' ' || city, name], lambda x: [no || ' ' || x, x])) END"
_NO = "CASE WHEN regexp_matches(q, '^[0-9]+ [a-z]') AND regexp_extract(q, '^([0-9]+) ', 1)::INT <= k THEN regexp_extract(q, '^([0-9]+) ', 1) END"


def _ranked(bucket: str, more: str = "", score: str = "(any_value(importance) * 0.1::DOUBLE + {near}) / 1.1::DOUBLE", limit: int = 5, auto: bool = False) -> str:
    """CTE z: the results of the buckets (qid, doc, q), ranked."""
    near = "coalesce(arg_min(near, nth) FILTER (WHERE near >= 0.9), max(near))"
    if auto:
        near = "coalesce(max(held), arg_min(near * 0.9::DOUBLE, nth) FILTER (WHERE near * 0.9::DOUBLE >= 0.9), max(near) * 0.9::DOUBLE)"
    held = "CASE WHEN x = y THEN 1.0::DOUBLE WHEN starts_with(x, y) THEN 0.9::DOUBLE WHEN contains(x, y) THEN 0.7::DOUBLE END" if auto else "NULL"
    return f"""h0 AS (SELECT w.qid, w.doc, w.q AS y, g.importance, {_CALLED.replace("no ", "w.no ")} AS ls, w.no {more} FROM ({bucket}) w JOIN gaz g USING (doc)),
 h AS (SELECT *, ls[1] AS label, unnest(ls) AS l, unnest(range(len(ls))) AS nth FROM h0), i AS (SELECT *, {_FOLD.format("l")} AS x FROM h), j AS (SELECT *, {_bigram("x", "y")} AS near, {held} AS held FROM i),
 c AS (SELECT qid, doc, any_value(label) AS label, any_value(no) AS no, {score.format(near=near)} AS score{", any_value(km) AS km" if "km" in more else ""} FROM j GROUP BY qid, doc),
 z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc) AS rank FROM c) WHERE rank <= {limit} AND score >= 0.1)"""


def _bucket(condition: str = "TRUE") -> str:
    return f"SELECT b.qid, b.doc, q.q, {_NO} AS no FROM b JOIN q USING (qid) JOIN gaz USING (doc) JOIN (SELECT doc AS o_doc, p_partkey AS o_key, kind AS o_kind, postcode AS o_postcode FROM gaz) o ON o_key = q.own WHERE rank <= 100 AND {condition}"


_QUERY = "p_name || ' ' || p_brand"
_NUMBERED = f"CASE WHEN {_N} > 0 THEN CAST(1 + p_partkey % ({_N}) AS VARCHAR) || ' ' ELSE '' END || p_name || ' ' || p_brand"
_KM = "2 * 6367.0 * asin(sqrt(pow(sin((radians({0}.lat) - radians({1}.lat)) / 2), 2) + cos(radians({1}.lat)) * cos(radians({0}.lat)) * pow(sin((radians({0}.lon) - radians({1}.lon)) / 2), 2)))"
_SPOTS = "e AS (SELECT event_id AS qid, 42.0::DOUBLE + (event_id * 37 % 900)::DOUBLE / 100 AS lat, -1.0::DOUBLE + (event_id * 53 % 700)::DOUBLE / 100 + 0.001::DOUBLE AS lon FROM events)"
_SPOKEN = f"spoken AS (SELECT i, {_sound('w')} AS token FROM (VALUES (1, 'un'), (2, 'deux'), (3, 'trois'), (4, 'quatre'), (5, 'cinq'), (6, 'six')) n(i, w))"
#: Every place that a document stands at: its house numbers and itself.
_PLACES = f"{_SPOKEN}, places AS (SELECT doc, id || '_' || i AS id, CAST(i AS VARCHAR) AS no, token, 0 AS own, lat + i::DOUBLE / 1000 AS lat, lon + i::DOUBLE / 1000 AS lon FROM gaz JOIN spoken ON i <= k UNION ALL SELECT doc, id, NULL, '', 1, lat, lon FROM gaz)"
_I, _O = "floor(({0}.lat + 90) / 180 * 131072)::BIGINT", "(floor(({0}.lon + 180) / 360 * 262144)::BIGINT % 262144)"
_CELL = "(SELECT sum((({1} >> b) & 1) << (2 * b))::BIGINT FROM range(18) t(b)) + (SELECT sum((({0} >> b) & 1) << (2 * b + 1))::BIGINT FROM range(17) t(b))"


def _cells(steps: str) -> str:
    return f"WITH {_SPOTS}, x AS (SELECT qid, {_I.format('e')} + y AS a, {_O.format('e')} + x AS o FROM e, range(-3, 4) r1(y), range(-3, 4) r2(x) WHERE {steps}) SELECT qid, {_CELL.format('a', 'o')} AS cell FROM x"


def _nearby() -> str:
    """CTE found: the nearest document in the nine cells, or in the ring around them."""
    ring = lambda low, high: f"SELECT DISTINCT n.qid, c.doc FROM (SELECT qid, {_I.format('e')} + y AS a, {_O.format('e')} + x AS o FROM e, range(-2, 3) r1(y), range(-2, 3) r2(x) WHERE greatest(abs(x), abs(y)) BETWEEN {low} AND {high}) n JOIN cells c USING (a, o)"
    return f"""{_GAZ}, {_SPOTS}, {_PLACES}, cells AS MATERIALIZED (SELECT DISTINCT doc, {_I.format("places")} AS a, {_O.format("places")} AS o FROM places), n1 AS MATERIALIZED ({ring(0, 1)}), n2 AS (SELECT * FROM ({ring(2, 2)}) WHERE qid NOT IN (SELECT qid FROM n1)),
 near AS (SELECT e.qid, p.doc, p.id, p.no, {_KM.format("p", "e")} AS km, p.own, p.token FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) n JOIN e USING (qid) JOIN places p USING (doc)), {_CLOSEST}"""


_CLOSEST = """closest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY km, own, token) AS nth FROM near) WHERE nth = 1),
 found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exp(-pow(km / 50, 2)) * 0.1::DOUBLE / 0.1::DOUBLE DESC, doc) AS rank FROM closest) WHERE rank = 1)"""

_BOX = "CASE p_partkey % 3 WHEN 0 THEN 'BP 123 ' WHEN 1 THEN '3ème étage ' ELSE 'lieu dit ' END || p_name || ' 75001 ' || p_brand || ' cedex 01'"


def _cleaned() -> str:
    """The post box, the floor, the place and CEDEX gone, whatever is left in single spaces."""
    x = _BOX
    for pattern, new in (("([0-9]{5})", r" \1 "), (r"(?i)(^| )(b\.?p\.?|cs|tsa|cidex) *(n(o|°|) *|)[0-9]+ *", r"\1"), ("(?i)([0-9]{2})[0-9]{3}(.*)c(e|é)dex ?[0-9]*", r"\1\2"), ("(?i)c(e|é)dex ?[0-9]*", ""), ("(?i)[0-9]{0,2}(e|[eè]me) ([eé]tage)", ""), (" {2,}", " "), ("(?i)^lieux?[ -]?dits? ", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"SELECT p_partkey, trim({x}) AS cleaned FROM part"


def oracle_sql() -> dict[str, str]:
    exact = f"WITH {_TOKENS}, {_asked(_QUERY)}, {_ranked(_bucket())}"
    words = "vocabulary AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS w FROM part)"
    top = "SELECT token, doc, score, row_number() OVER (PARTITION BY token ORDER BY round(score, 9) DESC, doc) AS rank FROM p"
    shown = "SELECT qid, rank, doc, label, round(score, 9) AS score FROM z"
    distance = f", {_KM.format('g', 'w')} AS km, w.lat AS w_lat"
    geo_score = "(any_value(importance) * 0.1::DOUBLE + {near} + CASE WHEN any_value(km) > 100 THEN 0 ELSE exp(-pow(any_value(km) / 50, 2)) * 0.1::DOUBLE END) / 1.2::DOUBLE"
    around = f"SELECT w.*, 42.0::DOUBLE + (qid * 37 % 900)::DOUBLE / 100 + 0.2::DOUBLE AS lat, -1.0::DOUBLE + (qid * 53 % 700)::DOUBLE / 100 AS lon FROM ({_bucket()}) w"
    batch = f"WITH {_TOKENS}, {_asked(_NUMBERED, 'TRUE', _NUMBERED).replace('SELECT ' + _NUMBERED + ' AS qid, p_partkey AS own', 'SELECT DISTINCT ' + _NUMBERED + ' AS qid, 0 AS own')}, {_ranked(_bucket(), limit=3)}"
    plain = "CAST(1 + p_partkey % (p_size % 7) AS VARCHAR) || 'b ' || p_name || ' ' || p_brand"
    completed = f"begun AS (SELECT DISTINCT left(w, 3) AS qid FROM vocabulary), spoke AS (SELECT qid, coalesce(words, qid) AS x FROM begun LEFT JOIN spelt ON w = qid), voiced AS (SELECT qid, {_sound('x')} AS sound FROM spoke), asked AS (SELECT * FROM voiced WHERE length(sound) >= 3 AND sound NOT IN (SELECT token FROM s))"
    fit = f"{completed}, cand AS (SELECT qid, token, df, row_number() OVER (PARTITION BY qid ORDER BY df DESC, token) AS nth FROM asked JOIN s ON length(token) > 3 AND starts_with(token, sound)), tops AS ({top})"
    # completions are tried while fewer than a hundred documents are found, each as far as the hundred goes
    step = lambda n: f"b{n} AS (SELECT * FROM b{n - 1} UNION SELECT c.qid, t.doc FROM cand c JOIN tops t USING (token) WHERE c.nth = {n} AND (SELECT count(*) FROM b{n - 1} x WHERE x.qid = c.qid) < 100 AND t.rank <= 100 - (SELECT count(*) FROM b{n - 1} x WHERE x.qid = c.qid))"
    relaxed = f"""nouns AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS w FROM part), sounds AS (SELECT w, {_sound("w")} AS token FROM nouns), two AS (SELECT a.w || ' ' || b.w AS qid, unnest([a.token, b.token]) AS token FROM sounds a JOIN sounds b ON a.w < b.w),
 ordered AS (SELECT qid, token, row_number() OVER (PARTITION BY qid ORDER BY df, length(token), strpos(qid, left(token, 2)) DESC) AS nth FROM two JOIN s USING (token)), tops AS ({top}),
 first AS (SELECT qid, doc FROM ordered JOIN tops USING (token) WHERE nth = 1 AND rank <= 100), room AS (SELECT qid, count(*) AS n FROM first GROUP BY qid), both_ AS (SELECT * FROM first UNION SELECT o.qid, t.doc FROM ordered o JOIN room USING (qid) JOIN tops t USING (token) WHERE o.nth = 2 AND n < 100 AND t.rank <= 100 - n)"""
    return {
        "text_fold": f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents",
        "text_tokens": f"SELECT doc_id, CASE WHEN coalesce({_FOLD.format('text')}, '') = '' THEN 0 ELSE len(string_split({_FOLD.format('text')}, ' ')) END AS n_tokens FROM documents",
        "text_leading_zeros": r"SELECT p_partkey, regexp_replace(lpad(CAST(p_size AS VARCHAR), 4, '0') || ' ' || p_name, '\b0+(\d{1,3})\b', '\1', 'g') AS cleaned FROM part",
        "text_clean": _cleaned(),
        "text_phonemes": f"SELECT w AS word, {_sound('w')} AS phonemes FROM (SELECT DISTINCT unnest(string_split({_FOLD.format('text')}, ' ')) AS w FROM documents) WHERE w <> ''",
        "text_synonyms": f"WITH {_SPEECH}, a AS (SELECT p_partkey, string_split('av ' || p_size || ' ' || p_name || ' st zi', ' ') AS ws FROM part), b AS (SELECT p_partkey, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM a), c AS (SELECT p_partkey, i, string_split(coalesce(words, w), ' ') AS xs FROM b LEFT JOIN spelt USING (w)), d AS (SELECT p_partkey, i, unnest(xs) AS x, unnest(range(len(xs))) AS j FROM c) SELECT p_partkey, string_agg({_sound('x')}, ' ' ORDER BY i, j) AS tokens FROM d GROUP BY p_partkey",
        "housenumber_split": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS num, CASE p_size % 3 WHEN 0 THEN 'bis' WHEN 1 THEN 'B' END AS complement, CASE WHEN p_size % 3 < 2 THEN 'b' END AS short FROM part",
        "bigram_similarity": f"WITH x AS (SELECT p_partkey, {_FOLD.format('p_name')} AS a, {_FOLD.format(chr(112) + '_name || chr(32) || p_brand')} AS b FROM part) SELECT p_partkey, round({_bigram('a', 'b')}, 9) AS similarity FROM x",
        "labels": f"WITH {_GAZ}, l AS (SELECT id, {_CALLED.replace('no IS NULL', 'TRUE').replace('[no ||', '[id ||')} AS l FROM gaz) SELECT id, (unnest(range(len(l))))::INTEGER AS nth, unnest(l) AS label FROM l",
        "label_best": f"WITH {_GAZ}, l AS (SELECT id, {_FOLD.format(chr(110) + 'ame || chr(32) || context')} AS y, {_CALLED.replace('no IS NULL', 'TRUE').replace('[no ||', '[id ||')} AS l FROM gaz), n AS (SELECT id, y, {_FOLD.format('unnest(l)')} AS x, unnest(range(len(l))) AS nth FROM l), j AS (SELECT id, nth, {_bigram('x', 'y')} AS near FROM n) SELECT id, round(coalesce(arg_min(near, nth) FILTER (WHERE near >= 0.9), max(near)), 9) AS similarity FROM j GROUP BY id",
        "index_numbering": f"WITH {_GAZ} SELECT id, doc FROM gaz",
        "index_postings": f"WITH {_TOKENS} SELECT token, doc, round(score, 9) AS score FROM p",
        "index_token_stats": f"WITH {_TOKENS} SELECT token, df, round(max_score, 9) AS max_score FROM s",
        "index_pairs": f"WITH {_TOKENS} SELECT DISTINCT a.token, b.token AS other FROM p a JOIN p b ON a.doc = b.doc AND a.token <> b.token",
        "index_edge_ngrams": f"WITH {_TOKENS} SELECT left(token, i) AS ngram, token FROM (SELECT token, unnest(range(3, least(length(token) - 1, 20) + 1)) AS i FROM s)",
        "index_filters": f"WITH {_GAZ} SELECT 'type' AS name, kind AS value, doc FROM gaz UNION SELECT 'type', 'housenumber', doc FROM gaz WHERE k > 0 UNION SELECT 'postcode', postcode, doc FROM gaz",
        "index_geocells": f"WITH {_GAZ}, {_PLACES}, i AS (SELECT DISTINCT doc, {_I.format('places')} AS a, {_O.format('places')} AS o FROM places) SELECT {_CELL.format('a', 'o')} AS cell, doc FROM i",
        "index_housenumbers": f"WITH {_GAZ}, {_PLACES} SELECT doc, token, no AS number, id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM places WHERE own = 0",
        "geo_expand": _cells("greatest(abs(x), abs(y)) <= 1"),
        "geo_ring": _cells("greatest(abs(x), abs(y)) = 3 AND qid % 20 = 0"),
        "set_intersect": "SELECT p_brand, coalesce(string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY p_size) FILTER (WHERE p_size % 2 = 0 AND p_size < 25), '') AS sizes FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand".replace("DISTINCT CAST", "CAST"),
        "set_union": "SELECT p_brand, coalesce(string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) FILTER (WHERE p_size % 2 = 0 OR p_size < 25), '') AS sizes FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand",
        "postings_intersect_topk": f"WITH {_TOKENS}, {_asked(_QUERY)} SELECT qid, doc, rank, round(total, 9) AS sum FROM b WHERE rank <= 10",
        "postings_with_ties": f"WITH {_TOKENS}, r0 AS (SELECT token AS qid, doc, rank() OVER (PARTITION BY token ORDER BY score DESC) AS lvl, row_number() OVER (PARTITION BY token ORDER BY score DESC, doc) AS rank FROM p JOIN s USING (token) WHERE df >= 5), r1 AS (SELECT * FROM r0 WHERE lvl <= 5), r2 AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, max(lvl) OVER (PARTITION BY qid) AS last FROM r1) SELECT qid, doc, rank, rank <= 5 AS kept, n > 5 AND lvl = last AS tied FROM r2",
        "manual_scan": f"WITH {_TOKENS}, {_asked(_QUERY)}, rare AS (SELECT qid, arg_min(token, (df, token)) AS token FROM kk JOIN s USING (token) GROUP BY qid), few AS (SELECT r.qid, p.doc, row_number() OVER (PARTITION BY r.qid ORDER BY p.score DESC, p.doc) AS nth FROM rare r JOIN p USING (token)), held AS (SELECT few.qid, few.doc, row_number() OVER (PARTITION BY few.qid ORDER BY nth) AS rank FROM few JOIN b ON b.qid = few.qid AND b.doc = few.doc) SELECT qid, doc, rank FROM held WHERE rank <= 5",
        "filter_docs": f"WITH {_GAZ} SELECT doc FROM gaz WHERE (kind = 'municipality' OR k > 0) AND postcode IN ('05000', '06000', '07000', '08000', '09000', '10000', '11000', '12000', '13000', '14000')",
        "housenumber_match": f"WITH {_GAZ}, {_SPOKEN}, a AS (SELECT doc, id, k, (doc % 6 + 1)::INT AS i, doc % 5 = 0 AS bis FROM gaz) SELECT doc, i || CASE WHEN bis THEN ' bis' ELSE '' END AS asked, CASE WHEN bis THEN i || 'b' ELSE token END AS token, CASE WHEN NOT bis AND i <= k THEN CAST(i AS VARCHAR) END AS number, CASE WHEN NOT bis AND i <= k THEN id || '_' || i END AS id FROM a JOIN spoken USING (i)",
        "autocomplete_words": f"""WITH {_TOKENS}, q AS (SELECT p_partkey AS qid, string_split(p_name, ' ') AS ws FROM part WHERE p_partkey % 50 = 0), l AS (SELECT qid, left({_sound("ws[-1]")}, 3) AS last, {_sound("ws[1]")} AS other FROM q),
 met AS (SELECT DISTINCT a.token AS other, b.token FROM p a JOIN p b ON a.doc = b.doc AND a.token <> b.token), r9 AS (SELECT l.qid, s.token, row_number() OVER (PARTITION BY l.qid ORDER BY s.df DESC, s.token) AS rank FROM l JOIN s ON length(s.token) > 3 AND length(l.last) = 3 AND starts_with(s.token, l.last) JOIN met ON met.token = s.token AND met.other = l.other) SELECT qid, rank, token FROM r9 WHERE rank <= 10""",
        "search_exact": f"{exact} {shown}",
        "search_filtered": f"WITH {_TOKENS}, {_asked(_QUERY)}, {_ranked(_bucket('kind = o_kind AND postcode = o_postcode').replace('rank <= 100', 'TRUE'))} {shown}",
        "search_around_point": f"WITH {_TOKENS}, {_asked(_QUERY)}, {_ranked(around, distance, geo_score)} SELECT qid, rank, doc, round(score, 9) AS score, round(km * 1000, 3) AS distance_m FROM z",
        "search_housenumbers": f"WITH {_TOKENS}, {_asked(_NUMBERED, 'p_partkey % 50 = 0 AND p_size % 7 > 0')}, {_ranked(_bucket())} SELECT qid, rank, z.doc, CASE WHEN no IS NULL THEN id ELSE id || '_' || no END AS id, CASE WHEN no IS NULL THEN kind ELSE 'housenumber' END AS kind, no AS housenumber, label, round(score, 9) AS score FROM z JOIN gaz USING (doc)",
        "search_fuzzy": f"WITH {_TOKENS}, {words}, slips AS (SELECT w, {_sound(chr(119) + ' || chr(113)')} AS slip FROM vocabulary), tops AS ({top}), {_ranked('SELECT w AS qid, doc, w || chr(113) AS q, NULL::VARCHAR AS no FROM slips JOIN tops ON token = left(slip, length(slip) - 1) AND length(slip) > 3 AND slip NOT IN (SELECT token FROM s) WHERE rank <= 100')} {shown}",
        "search_autocomplete": f"WITH {_TOKENS}, {words}, {fit}, b1 AS (SELECT c.qid, t.doc FROM cand c JOIN tops t USING (token) WHERE c.nth = 1 AND t.rank <= 100), {', '.join(map(step, (2, 3, 4)))}, {_ranked('SELECT qid, doc, qid AS q, NULL::VARCHAR AS no FROM b4', auto=True)} {shown}",
        "search_relaxed": f"WITH {_TOKENS}, {relaxed}, {_ranked('SELECT qid, doc, qid AS q, NULL::VARCHAR AS no FROM both_')} {shown}",
        "geocode_batch": f"""{batch}, a1 AS (SELECT qid, doc, label, no, printf('%.2f', score)::DOUBLE AS sc, printf('%.2f', coalesce(lead(score) OVER (PARTITION BY qid ORDER BY rank), 0))::DOUBLE AS nx, rank FROM z), a AS (SELECT * FROM a1 WHERE rank = 1 AND sc > 0.3)
 SELECT o.p_partkey, CASE WHEN a.no IS NULL THEN g.id ELSE g.id || '_' || a.no END AS result_id, a.label AS result_label, a.sc AS result_score, a.nx AS result_score_next, CASE WHEN a.no IS NULL THEN g.kind ELSE 'housenumber' END AS result_type, g.postcode AS result_postcode, a.no AS result_housenumber,
 round(g.lat + coalesce(a.no::DOUBLE / 1000, 0), 9) AS latitude, round(g.lon + coalesce(a.no::DOUBLE / 1000, 0), 9) AS longitude FROM (SELECT p_partkey, {_NUMBERED} AS qid FROM part) o LEFT JOIN a USING (qid) LEFT JOIN gaz g ON g.doc = a.doc""",
        "geocode_plain_number": f"""WITH {_TOKENS}, {_asked(plain, 'p_partkey % 10 = 0 AND p_size % 7 > 0')}, {_ranked(_bucket(), limit=1)}, a AS (SELECT qid, doc, label, printf('%.2f', score)::DOUBLE AS sc FROM z), n AS (SELECT a.*, g.*, CASE WHEN sc >= 0.62 AND 1 + qid % (o.p_size % 7) <= g.k THEN CAST(1 + qid % (o.p_size % 7) AS VARCHAR) END AS no FROM a JOIN gaz g USING (doc) JOIN part o ON o.p_partkey = a.qid)
 SELECT qid AS p_partkey, CASE WHEN no IS NULL THEN id ELSE id || '_' || no END AS result_id, CASE WHEN no IS NULL THEN label ELSE no || ' ' || name || ' ' || postcode || ' ' || city END AS result_label, CASE WHEN no IS NULL THEN kind ELSE 'housenumber' END AS result_type, no AS result_housenumber, no AS result_num, sc AS result_score FROM n""",
        "reverse": f"WITH {_nearby()} SELECT qid, doc, no AS housenumber, round(km * 1000, 3) AS distance_m FROM found",
        "reverse_batch": f"WITH {_nearby()} SELECT e.qid, f.id AS result_id, coalesce(f.no || ' ', '') || g.name || ' ' || g.postcode || ' ' || g.city AS result_label, f.no AS result_housenumber, CASE WHEN f.no IS NULL THEN g.kind ELSE 'housenumber' END AS result_type, trunc(f.km * 1000)::BIGINT AS result_distance FROM e LEFT JOIN found f USING (qid) LEFT JOIN gaz g USING (doc)",
        "reverse_nearest": f"WITH {_GAZ}, {_SPOTS}, {_PLACES}, near AS (SELECT e.qid, p.doc, p.id, p.no, {_KM.format('p', 'e')} AS km, p.own, p.token FROM e JOIN places p ON abs(p.lat - e.lat) < 0.05 AND abs(p.lon - e.lon) < 0.1), {_CLOSEST.replace('FROM closest', 'FROM closest WHERE km <= 5')} SELECT qid, doc, no AS housenumber, round(km * 1000, 3) AS distance_m FROM found",
        "geojson_features": f"{exact} SELECT qid, rank, 'Feature' AS type, 'Point' AS geometry, round(lon, 9) AS lon, round(lat, 9) AS lat, id, label, CASE WHEN kind = 'street' THEN name END AS street, CASE WHEN kind = 'municipality' THEN name END AS municipality, postcode FROM z JOIN gaz USING (doc)",
    }
