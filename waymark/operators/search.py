"""Search of addresses, set at a time: all queries of a table pass each step together.

A query's state is a row: its words with their frequencies, a bucket of candidate documents, and the results made of them so far. A step that needs
the index makes a table of candidates (sets of words, in the order in which they are to be tried), looks all of them up at once, and then folds what they
found into each query's bucket in order. That is the same as trying one after another, because the best n documents of a candidate are the
first n of its best hundred. Steps without a live query cost nothing but a count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import french, geo, text
from ..sources.store import numbered_questions, written
from . import postings
from .index import Index, named_values, of_docs

IMPORTANCE_WEIGHT, DISTANCE_WEIGHT, MAX_FILTER_VALUES = 0.1, 0.1, 10
#: What a query is told by; those that are alike in all of it are searched once.
ASKED = ("query", "limit", "autocomplete", "types", "citycodes", "postcodes", "lat", "lon")
_WORD = "struct<value:string,df:bigint,found:boolean,last:boolean>"
_RESULT = "struct<doc:bigint,str:double,score:double,distance:double,importance:double>"


@dataclass(frozen=True)
class Settings:
    """Limits of the search. common: a word of more documents is common; widest: a rarest word of as many is not intersected but scanned, the best `scan` documents of it."""

    least: int = 10
    most: int = 100
    common: int = 10_000
    widest: int = 100_000
    scan: int = 501
    close: float = 0.9
    min_score: float = 0.1
    meaningful: int = 10


def _by(words: Column, *keys) -> Column:
    """An array sorted by keys; equals keep their order."""
    dressed = F.transform(words, lambda w, i: F.struct(*(k(w).alias(f"k{n}") for n, k in enumerate(keys)), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(dressed), lambda x: x["w"])


def _values(words: Column) -> Column:
    return F.transform(words, lambda w: w["value"])


def _pairs(words: Column) -> Column:
    """Words as candidates know them."""
    return F.transform(words, lambda w: F.struct(w["df"].alias("df"), w["value"].alias("token")))


def _length(w: Column) -> Column:
    return -F.char_length(w["value"])


def _digits(w: Column) -> Column:
    return w["value"].rlike("^[0-9]+$")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def asked_values(values: Column) -> Column:
    """A filter's values: trimmed, blanks left out, the first ten that differ."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(values, _none("string")), lambda v: F.trim(v)), lambda v: v != "")), 1, MAX_FILTER_VALUES)


def housenumber_checks(types_: Column) -> tuple[Column, Column]:
    """Whether to match a query's house number, and whether a result must have one, by the type filter's values as they are given."""
    given = F.coalesce(types_, _none("string"))
    none = F.size(given) == 0
    return none | F.exists(given, lambda v: v == "housenumber"), ~none & F.forall(given, lambda v: v == "housenumber")


class _Search:
    def __init__(self, index: Index, settings: Settings) -> None:
        self.index, self.set = index, settings

    # ---- the state

    def analysed(self, queries: DataFrame) -> DataFrame:
        """The state of each query (qid, query, and whichever of limit, autocomplete, types, citycodes, postcodes, lat, lon there are); queries that are too long have none."""
        have = lambda name, kind, default=None: F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in queries.columns else F.lit(default).cast(kind)
        given = have("types", "array<string>")
        check, only = housenumber_checks(given)
        lat, lon = have("lat", "double"), have("lon", "double")
        center = lat.isNotNull() & lon.isNotNull()
        base = queries.select(
            "qid", F.coalesce(F.col("query").cast("string"), F.lit("")).alias("query"), have("limit", "int", 5).alias("wanted"), have("autocomplete", "boolean", False).alias("auto"),
            asked_values(given).alias("types"), asked_values(have("citycodes", "array<string>")).alias("citycodes"), asked_values(have("postcodes", "array<string>")).alias("postcodes"),
            check.alias("check"), only.alias("only"), F.when(center, lat).alias("c_lat"), F.when(center, lon).alias("c_lon"),
        )
        base = base.repartition(int(self.index.spark.conf.get("spark.sql.shuffle.partitions")), "qid").withColumn("q", text.fold(F.col("query"))).withColumn("toks", french.search_tokens(F.col("query"), self.index.synonyms)).filter("toks is not null").drop("query")
        base = written(base, "queries")
        each = base.select("qid", F.posexplode("toks").alias("pos", "t")).select("qid", "pos", F.col("t.value").alias("token"))
        known = each.join(self.index.tokens.select("token", "df"), "token", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("df", F.lit(0)).alias("df")))).alias("dfs"))
        joined = base.join(known, "qid", "left")
        all_ = F.transform("toks", lambda t, i: F.struct(t["value"].alias("value"), F.get("dfs", i)["df"].alias("df"), (F.get("dfs", i)["df"] > 0).alias("found"), (i == F.size("toks") - 1).alias("last"), t["housenumber"].alias("housenumber")))
        plain = lambda w: F.struct(*(w[c].alias(c) for c in ("value", "df", "found", "last")))
        joined = joined.withColumn("all", all_).withColumn("words", F.transform(F.filter(_by(F.col("all"), _length), lambda w: ~w["housenumber"]), plain))
        number = F.array_join(F.transform(F.filter("toks", lambda t: t["housenumber"]), lambda t: t["value"]), "")
        common, meant = F.filter("words", lambda w: w["df"] > self.set.common), F.filter("words", lambda w: w["found"] & (w["df"] <= self.set.common))
        df = lambda w: w["df"]
        state = joined.withColumn("number", number).withColumn("commons", _by(common, df)).withColumn("meant", _by(meant, df))
        last = F.get("all", F.size("all") - 1)["value"]
        cells = F.when((F.col("c_lat") != 0) & (F.col("c_lon") != 0), geo.ring(F.col("c_lat"), F.col("c_lon"), 0, 1))
        state = state.select(
            "qid", "q", text.gram_codes(F.col("q")).alias("q_grams"), "wanted", "auto", "types", "citycodes", "postcodes", "check", "only", "c_lat", "c_lon", "number", "words",
            F.slice("meant", 1, self.set.meaningful).alias("meaningful"), F.concat("commons", F.slice("meant", self.set.meaningful + 1, F.greatest(F.size("meant"), F.lit(1)))).alias("commons"),
            F.filter("words", lambda w: ~w["found"]).alias("unknown"), last.alias("last"), F.ceil(2.0 / 3.0 * F.size("words")).cast("int").alias("threshold"), cells.alias("cells"),
            ((F.size("types") > 0) | (F.size("citycodes") > 0) | (F.size("postcodes") > 0)).alias("filtered"), _none(_WORD).alias("keys"), F.lit(False).alias("key_filter"), _none("string").alias("matched"),
            _none("bigint").alias("bucket"), _none(_RESULT).alias("results"), F.lit(False).alias("done"),
        )
        if {"lat", "lon"} <= set(queries.columns):
            near = state.select("qid", F.explode("cells").alias("cell")).join(self.index.cells.hint("merge"), "cell").select("qid").distinct().withColumn("near", F.lit(True))
            state = state.join(near, "qid", "left").withColumn("near", F.coalesce("near", F.lit(False)))
        else:
            state = state.withColumn("near", F.lit(False))
        return written(state.withColumn("only_commons", (F.size("words") > 0) & (F.size("words") == F.size("commons"))), "state")

    def full(self) -> Column:
        return (F.size("bucket") >= F.col("wanted")) & (F.size("bucket") < self.set.most)

    def overflow(self) -> Column:
        return F.size("bucket") >= self.set.most

    @staticmethod
    def dry() -> Column:
        return F.size("bucket") < F.col("wanted")

    def cream(self) -> Column:
        return F.size(F.filter("results", lambda r: r["str"] >= self.set.close))

    def small(self) -> Column:
        return (F.size("bucket") > 0) & (F.size("bucket") <= self.set.least) & ~self.overflow()

    def has_cream(self) -> Column:
        """After convert(): whether a small bucket's query has a close result."""
        return self.small() & (self.cream() > 0)

    @staticmethod
    def any(state: DataFrame, *conditions: Column) -> list[bool]:
        got = state.agg(*(F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions))).first()
        return list(got)

    # ---- looking candidates up

    _ASKS = ("types", "citycodes", "postcodes")

    def looked_up(self, candidates: DataFrame) -> DataFrame:
        """qid, docs by ord: for each query the array of its candidates (ord, words, docs), docs the best max(wanted, most) in order.

        candidates: qid, ord, words (df, token), geo, wanted, and the filters. A candidate without words has documents only by its filters.
        """
        listed = candidates.select("qid", "ord", "words", "wanted", *self._ASKS, F.when(F.col("geo"), F.col("cells")).alias("cells"))
        ranked = postings.intersect(listed, self.index, F.greatest(F.col("wanted"), F.lit(self.set.most)))
        docs = ranked.groupBy("qid", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))
        return self.gathered(candidates.select("qid", "ord", _tokens_of("words").alias("words")).join(docs, ["qid", "ord"], "left"))

    @staticmethod
    def gathered(rows: DataFrame) -> DataFrame:
        each = F.struct("ord", F.coalesce("words", _none("string")).alias("words"), F.coalesce("docs", _none("bigint")).alias("docs"))
        return rows.groupBy("qid").agg(F.array_sort(F.collect_list(each)).alias("tried"))

    def candidates(self, state: DataFrame, words: Column, ord_: Column | None = None, geo_: Column | None = None) -> DataFrame:
        return state.select("qid", (F.lit(0) if ord_ is None else ord_).cast("int").alias("ord"), F.array_distinct(words).alias("words"), (F.lit(False) if geo_ is None else geo_).alias("geo"), "wanted", "cells", *self._ASKS)

    def taken(self, bucket: Column, docs: Column, limit: Column | None = None) -> Column:
        """The bucket with a candidate's best documents: as many as it still holds, or `limit`; where that is nothing, all that were looked up."""
        room = F.lit(self.set.most) - F.size(bucket) if limit is None else limit
        return F.array_union(bucket, F.when(room > 0, F.slice(docs, F.lit(1), F.greatest(room, F.lit(1)))).otherwise(docs))

    def folded(self, state: DataFrame, tried: DataFrame, when, until=None) -> DataFrame:
        """state with the candidates of `tried` taken in order while `when`(bucket) holds, stopping for good once `until`(bucket) does."""
        zero = F.struct(F.col("bucket").alias("b"), F.col("matched").alias("m"), F.lit(False).alias("stop"))

        def step(acc: Column, c: Column) -> Column:
            go = ~acc["stop"] & when(acc["b"])
            b = F.when(go, self.taken(acc["b"], c["docs"])).otherwise(acc["b"])
            stop = acc["stop"] | (go & until(b)) if until is not None else acc["stop"]
            return F.struct(b.alias("b"), F.when(go, F.array_union(acc["m"], c["words"])).otherwise(acc["m"]).alias("m"), stop.alias("stop"))

        joined = state.join(tried, "qid", "left").withColumn("acc", F.when(F.col("tried").isNotNull(), F.aggregate("tried", zero, step)))
        return joined.withColumn("bucket", F.coalesce("acc.b", "bucket")).withColumn("matched", F.coalesce("acc.m", "matched")).drop("acc", "tried")

    # ---- scoring

    def scored(self, rows: DataFrame) -> DataFrame:
        """qid, result of (qid, doc, q, q_grams, number, check, only, auto, c_lat, c_lon); documents without the house number that a query must have are left out."""
        documents, housenumbers = of_docs(rows, self.index.documents, self.index.housenumbers)
        docs = documents.select("doc", "kind", "importance", "lat", "lon", "folded", "folded_street", "grams", "grams_street")
        numbers = housenumbers.select("doc", F.col("token").alias("number"), F.col("number").alias("n_number"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
        met = rows.withColumn("number", F.when(F.col("check") & (F.col("number") != ""), F.col("number"))).join(numbers, ["doc", "number"], "left").filter(~F.col("only") | F.col("n_number").isNotNull()).join(docs, "doc")
        given = text.fold(F.col("n_number"))
        doubled = F.flatten(F.transform("folded_street", lambda x: F.array(F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(x, F.lit(""))), x)))
        called = met.withColumn("called", F.when(F.col("n_number").isNull(), F.col("folded")).otherwise(doubled))
        numbered = F.flatten(F.transform("folded_street", lambda x, i: F.array(F.when((given == "") | (x == ""), text.gram_codes(F.concat(given, x))).otherwise(text.prefixed_codes(given, x, F.get("grams_street", i))), F.get("grams_street", i))))
        called = called.withColumn("grams", F.when(F.col("n_number").isNull(), F.col("grams")).otherwise(numbered))
        held = F.array_max(F.transform("called", lambda x: F.when(x == F.col("q"), 1.0).when(F.startswith(x, F.col("q")), 0.9).when(F.contains(x, F.col("q")), 0.7)))
        single = F.array_contains("called", F.col("q")).cast("double")  # one character has no bigrams
        alike = lambda scale: F.when(F.char_length("q") < 2, single * scale).otherwise(french.best_of(F.col("grams"), lambda g: text.code_similarity(g, F.col("q_grams")) * scale, self.set.close))
        near = F.when(F.col("auto"), F.coalesce(held, alike(0.9))).otherwise(alike(1.0))
        importance = F.col("importance") * IMPORTANCE_WEIGHT
        km = geo.haversine_km(F.coalesce("n_lat", "lat"), F.coalesce("n_lon", "lon"), F.col("c_lat"), F.col("c_lon"))
        out = called.withColumn("str", near).withColumn("km", km).withColumn("importance", importance)
        around = geo.compensated_sum(F.col("importance"), F.col("str"), geo.km_to_score(F.col("km")) * DISTANCE_WEIGHT) / geo.compensated_sum(F.lit(IMPORTANCE_WEIGHT), F.lit(1.0), F.lit(DISTANCE_WEIGHT))
        score = F.when(F.col("c_lat").isNull(), (F.col("importance") + F.col("str")) / (IMPORTANCE_WEIGHT + 1.0)).otherwise(around)
        return out.select("qid", F.struct("doc", "str", score.alias("score"), (F.col("km") * 1000).alias("distance"), "importance").alias("result"))

    def convert(self, state: DataFrame, where: Column) -> DataFrame:
        """state with results made of the documents in the buckets `where` that have none yet. Results stay when a bucket is replaced."""
        fresh = F.array_except("bucket", F.transform("results", lambda r: r["doc"]))
        parts = int(self.index.spark.conf.get("spark.sql.shuffle.partitions"))  # dealt out by number: a query's row becomes up to a hundred to score
        rows = state.filter(where & (F.size(fresh) > 0)).repartition(parts, "qid").select("qid", "q", "q_grams", "number", "check", "only", "auto", "c_lat", "c_lon", F.explode(fresh).alias("doc"))
        made = self.scored(rows).groupBy("qid").agg(F.collect_list("result").cast(f"array<{_RESULT}>").alias("made"))
        return written(state.join(made, "qid", "left").withColumn("results", F.concat("results", F.coalesce("made", _none(_RESULT)))).drop("made"), "state")

    # ---- the steps

    def autocomplete(self, state: DataFrame, where: Column, column: str, skip_commons: bool = False, around: bool = False) -> DataFrame:
        """The words of a column with each word that the query's last one begins, while the bucket doesn't overflow, or, if the last word is unknown, all of them."""
        last_unknown = F.exists("unknown", lambda w: w["value"] == F.col("last"))
        chosen = state.filter(where & F.col("last").isNotNull())
        others = F.filter(column, lambda w: ~w["last"])
        ends = chosen.select("qid", "last", _values(others).alias("others"), (F.size(column) == 1).alias("alone"))
        words = postings.completions(ends, self.index)
        words = written(words.filter(F.col("df") <= self.set.common) if skip_commons else words, "completions")
        low, width = 0, 128
        while True:
            live = state.filter(where & (~self.overflow() | last_unknown))
            part = words.filter((F.col("ord") > low) & (F.col("ord") <= low + width))
            rows = live.join(part, "qid").withColumn("keys_", F.concat(_pairs(others), F.array(F.struct("df", "token"))))
            if rows.isEmpty():
                if not live.join(words.filter(F.col("ord") > low + width), "qid", "left_semi").limit(1).count():
                    return state
            else:
                tried = self.looked_up(self.candidates(rows, F.col("keys_"), F.col("ord"), F.lit(around) & F.col("near")))
                state = written(self.folded(state, tried, lambda b: (F.size(b) < self.set.most) | last_unknown), "state")
            low, width = low + width, width * 8

    def only_commons(self, state: DataFrame) -> DataFrame:
        here = F.col("only_commons") & ~F.col("done")
        alone = here & ((F.size("words") == 1) | F.col("near"))
        tried = self.looked_up(self.candidates(state.filter(alone), _pairs(F.col("words")), None, F.col("near")))
        state = written(self.folded(state, tried, lambda b: F.lit(True)), "state")
        n_keys = F.size("words") + F.col("near").cast("int") + (alone & F.col("filtered")).cast("int")
        again = here & self.dry() & (n_keys > 1)
        rarest = F.array_min(F.transform("words", lambda w: w["df"]))
        small, scans = again & (rarest < self.set.widest), again & (rarest >= self.set.widest)
        has_small, has_scans = self.any(state, small, scans)
        if has_small:
            state = written(self.folded(state, self.looked_up(self.candidates(state.filter(small), _pairs(F.col("words")))), lambda b: F.lit(True)), "state")
        if has_scans:
            wide = state.filter(scans)
            held = self.filter_sizes(wide.filter("filtered"))
            sized = wide.join(held, "qid", "left").withColumn("select", F.col("filtered") & (F.coalesce("held", F.lit(0)) < rarest))
            narrow = self.looked_up(self.candidates(sized.filter("select"), _pairs(F.col("words"))))
            rows = self.candidates(sized.filter("not select"), _pairs(F.col("words")))
            found = postings.scanned(rows.select("qid", "ord", "words", *self._ASKS, "wanted"), self.index, F.col("wanted"), self.set.scan)
            docs = found.groupBy("qid", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))
            scanned = self.gathered(rows.select("qid", "ord", F.lit(None).cast("array<string>").alias("words")).join(docs, ["qid", "ord"]))
            state = written(self.folded(state, narrow.unionByName(scanned), lambda b: F.lit(True)), "state")
        return state

    def filter_sizes(self, state: DataFrame) -> DataFrame:
        """qid, held: how many documents a query's filters hold."""
        asked = F.concat(*(named_values(n, F.col(c)) for c, n in (("types", "type"), ("citycodes", "citycode"), ("postcodes", "postcode"))))
        names = sum((F.size(c) > 0).cast("int") for c in self._ASKS)
        rows = state.select("qid", names.alias("names"), F.explode(asked).alias("f")).select("qid", "names", "f.*")
        docs = rows.join(self.index.filters.hint("merge"), ["name", "value"]).groupBy("qid", "doc", "names").agg(F.count_distinct("name").alias("n")).filter("n = names")
        return docs.groupBy("qid").agg(F.count("*").alias("held"))

    def with_meaningful(self, state: DataFrame) -> DataFrame:
        here = ~F.col("done") & (F.size("meaningful") > 0)
        other = F.get(F.filter("commons", lambda w: ~F.exists("meaningful", lambda m: m["value"] == w["value"])), F.lit(0))
        lone = here & (F.size("meaningful") == 1) & ~F.col("filtered") & other.isNotNull()
        state = state.withColumn("meaningful", F.when(lone, F.concat("meaningful", F.array(other))).otherwise(F.col("meaningful")))
        state = state.withColumn("keys", F.when(here, F.col("meaningful")).otherwise(F.col("keys"))).withColumn("key_filter", F.when(here, F.col("filtered")).otherwise(F.col("key_filter")))
        tried = self.looked_up(self.candidates(state.filter(here), _pairs(F.col("keys"))))
        joined = state.join(tried, "qid", "left").withColumn("docs", F.coalesce(F.get("tried", F.lit(0))["docs"], _none("bigint")))
        new = F.slice("docs", 1, self.set.least)
        # ten may be more: the bucket is filled again with all that were looked up
        fresh = F.when(F.size(new) == self.set.least, F.col("docs")).otherwise(new)
        empty = F.size("bucket") == 0
        state = joined.withColumn("begun", here & empty).withColumn("bucket", F.when(here & empty, F.array_distinct(fresh)).when(here, self.taken(F.col("bucket"), F.col("docs"))).otherwise(F.col("bucket"))).drop("tried", "docs")
        state = self.convert(written(state, "state"), here & F.col("begun") & ~F.col("auto") & self.small())
        enough = F.col("begun") & ~F.col("auto") & self.has_cream() & (self.cream() < self.set.least)
        return state.withColumn("done", F.col("done") | enough).drop("begun")

    def reduced(self, state: DataFrame, here: Column) -> DataFrame:
        """Common words join the meaningful ones, one after another, while the bucket overflows: each time it is made anew."""
        more = F.filter(F.transform("commons", lambda w, i: F.when(~F.exists("meaningful", lambda m: m["value"] == w["value"]) & (F.array_position(_values(F.col("commons")), w["value"]) == i + 1), w)), lambda w: w.isNotNull())
        chosen = state.filter(here).withColumn("more", more)
        each = chosen.select("*", F.posexplode("more").alias("nth", "word")).withColumn("set", F.concat("meaningful", F.slice("more", F.lit(1), F.col("nth") + 1)))
        tried = self.looked_up(self.candidates(each, _pairs(F.col("set")), F.col("nth")))

        def step(acc: Column, c: Column) -> Column:
            go = F.size(acc["b"]) >= self.set.most
            return F.struct(F.when(go, F.array_distinct(c["docs"])).otherwise(acc["b"]).alias("b"), F.when(go, c["ord"] + 1).otherwise(acc["n"]).alias("n"))

        joined = state.withColumn("more", more).join(tried, "qid", "left").withColumn("acc", F.when(F.col("tried").isNotNull(), F.aggregate("tried", F.struct(F.col("bucket").alias("b"), F.lit(0).alias("n")), step)))
        grown = F.concat("meaningful", F.slice("more", F.lit(1), F.greatest(F.coalesce("acc.n", F.lit(0)), F.lit(0))))
        joined = joined.withColumn("bucket", F.coalesce("acc.b", "bucket")).withColumn("keys", F.when(F.coalesce("acc.n", F.lit(0)) > 0, grown).otherwise(F.col("keys"))).withColumn("meaningful", F.when(F.coalesce("acc.n", F.lit(0)) > 0, grown).otherwise(F.col("meaningful")))
        return written(joined.drop("acc", "tried", "more"), "state")

    def fuzzy(self, state: DataFrame, where: Column, column: str, with_commons: bool) -> DataFrame:
        """A column's words, the longest first, each replaced by the known words one slip away that stand with all other keys, while too few documents are found."""
        here = where & self.dry() & (F.size(column) > 0)
        if not self.any(state, here)[0]:
            return state
        state = state.withColumn(column, F.when(here, _by(F.col(column), _length)).otherwise(F.col(column)))
        unused = F.filter("commons", lambda w: ~F.exists("keys", lambda k: k["value"] == w["value"]))
        every = F.concat("keys", unused) if with_commons else F.col("keys")
        each = state.filter(here).withColumn("every", every).select("*", F.posexplode(column).alias("nth", "word")).filter(~_digits(F.col("word")))
        at = F.when(F.col("word.found"), F.array_position(_values(F.col("every")), F.col("word.value"))).otherwise(F.lit(0).cast("long"))
        each = each.withColumn("at", at).withColumn("rest", F.filter("every", lambda w, i: i + 1 != F.col("at"))).filter(~F.col("key_filter"))  # a filter among the keys stands with no word
        slips = each.select("*", F.posexplode(french.misspellings(F.col("word.value"))).alias("slip", "token")).join(self.index.tokens.select("token", F.col("df").alias("t_df")), "token")
        slips = slips.withColumn("ord", F.col("nth") * 100_000 + F.col("slip")).withColumn("others", _values(F.col("rest")))
        fit = postings.paired(slips.select("qid", "ord", "token", "t_df", "others"), self.index, ("qid", "ord")).select("qid", "ord", "token", "t_df")
        fit = written(fit.join(slips.select("qid", "ord", "rest", "wanted", "cells", *self._ASKS), ["qid", "ord"]), "slips")
        if fit.isEmpty():
            return state
        rows = self.candidates(fit, F.concat(_pairs(F.col("rest")), F.array(F.struct(F.col("t_df").alias("df"), "token"))), F.col("ord"))
        return written(self.folded(state, self.looked_up(rows), lambda b: F.size(b) < F.col("wanted")), "state")

    def related(self, state: DataFrame, here: Column) -> DataFrame:
        """Groups of words that each share a document with all others of the group, by rising average frequency, while the bucket doesn't overflow."""
        both = _by(F.concat("meaningful", "commons"), lambda w: w["value"])
        words = F.filter(F.transform(both, lambda w, i: F.when((i == 0) | (F.get(both, i - 1)["value"] != w["value"]), w)), lambda w: w.isNotNull())
        chosen = written(state.filter(here).select("qid", words.alias("set"), "wanted", "cells", *self._ASKS), "related")
        links = chosen.select("qid", F.posexplode("set").alias("i", "a"), "set").select("qid", "i", F.col("a.value").alias("token"), F.posexplode("set").alias("j", "b")).select("qid", "i", "j", "token", F.col("b.value").alias("other")).filter("i <> j")
        links = links.join(self.index.pairs, ["token", "other"], "left_semi").groupBy("qid").agg(F.collect_set(F.col("i") * 1_000 + F.col("j")).alias("links"))
        rows = chosen.join(links, "qid").withColumn("groups", _groups(self.set.common))
        each = rows.select("*", F.posexplode("groups").alias("nth", "group"))
        tried = self.looked_up(self.candidates(each, _pairs(F.col("group")), F.col("nth")))
        return written(self.folded(state, tried, lambda b: F.lit(True), lambda b: F.size(b) >= self.set.most), "state")

    def without(self, state: DataFrame, here: Column, two: bool) -> DataFrame:
        """The keys less one of the meaningful words, or two, each way in turn, while the bucket doesn't overflow."""
        left = lambda words, w: text.let(F.array_position(_values(words), w["value"]), lambda at: F.filter(words, lambda x, i: i + 1 != at))
        each = state.filter(here).select("*", F.posexplode("meaningful").alias("nth", "word"))
        each = each.withColumn("rest", left(F.col("keys"), F.col("word")))
        if two:
            each = each.select("*", F.posexplode("meaningful").alias("mth", "second")).filter(F.col("second.value") != F.col("word.value"))
            each = each.withColumn("rest", left(F.col("rest"), F.col("second"))).withColumn("nth", F.col("nth") * 1_000 + F.col("mth"))
        # without a word left, only a filter among the keys still finds documents
        listed = self.looked_up(self.candidates(each.filter(F.size("rest") > 0), _pairs(F.col("rest")), F.col("nth")))
        bare = each.filter((F.size("rest") == 0) & F.col("key_filter")).select("qid", F.col("nth").alias("ord"), "wanted", *self._ASKS)
        tried = listed.unionByName(self.held(bare)).groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list("tried"))).alias("tried"))
        return written(self.folded(state, tried, lambda b: F.lit(True), lambda b: F.size(b) >= self.set.most), "state")

    def held(self, rows: DataFrame) -> DataFrame:
        """qid, tried: the first documents that filters alone hold."""
        asked = F.concat(*(named_values(n, F.col(c)) for c, n in (("types", "type"), ("citycodes", "citycode"), ("postcodes", "postcode"))))
        names = sum((F.size(c) > 0).cast("int") for c in self._ASKS)
        each = rows.select("qid", "ord", "wanted", names.alias("names"), F.explode(asked).alias("f")).select("qid", "ord", "wanted", "names", "f.*")
        docs = each.join(self.index.filters.hint("merge"), ["name", "value"]).groupBy("qid", "ord", "wanted", "names", "doc").agg(F.count_distinct("name").alias("n")).filter("n = names").withColumn("sum", F.lit(1.0))
        kept = postings.best(docs, F.greatest(F.col("wanted"), F.lit(self.set.most))).groupBy("qid", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))
        return self.gathered(kept.select("qid", "ord", F.lit(None).cast("array<string>").alias("words"), "docs"))

    def run(self, queries: DataFrame) -> DataFrame:
        """The state of every query when it is done, all of its bucket scored."""
        state = self.analysed(queries)
        live = ~F.col("done")
        number_only = (F.size("words") == 0) & (F.col("number") != "") & F.col("near")
        commons_near, numbers, commons, no_meaning = self.any(state, F.col("near") & F.col("only_commons"), number_only, F.col("only_commons"), (F.size("meaningful") == 0) & (F.size("commons") > 0))
        if commons_near:
            state = self.autocomplete(state, F.col("near") & F.col("only_commons"), "words", around=True)
        if numbers:
            docs = state.filter(number_only).select("qid", F.explode("cells").alias("cell")).join(self.index.cells.hint("merge"), "cell").groupBy("qid").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
            if self.any(state, number_only & F.col("filtered"))[0]:
                checked = state.filter(number_only).select("qid", *self._ASKS).join(docs.select("qid", F.explode("docs").alias("doc")), "qid").join(self.index.documents.select("doc", F.col("types").alias("held"), "citycode", "postcode").hint("merge"), "doc")
                for own, asked in (("held", "types"), ("citycode", "citycodes"), ("postcode", "postcodes")):
                    checked = checked.filter((F.size(asked) == 0) | F.arrays_overlap(own, asked))
                some = checked.groupBy("qid").agg(F.array_sort(F.collect_list("doc")).alias("some"))
                # with a filter there are two sets to intersect, and their cut holds
                docs = docs.join(some, "qid", "left").join(state.select("qid", "filtered"), "qid").select("qid", F.when(F.col("filtered"), F.slice(F.coalesce("some", _none("bigint")), 1, self.set.least)).otherwise(F.col("docs")).alias("docs"))
            state = written(state.join(docs, "qid", "left").withColumn("bucket", F.coalesce("docs", "bucket")).drop("docs"), "state")
        state = state.withColumn("done", F.size("words") == 0)
        if commons:
            state = self.only_commons(state)
        if no_meaning:
            here = live & (F.size("meaningful") == 0) & (F.size("commons") > 0)
            state = written(self.autocomplete(state, here, "commons").withColumn("lone", here), "state")
            passed = F.col("lone") & (F.size("matched") >= F.col("threshold"))
            state = self.convert(state.withColumn("meaningful", F.when(F.col("lone"), F.slice("commons", 1, 1)).otherwise(F.col("meaningful"))), passed & ~self.full() & self.small())
            state = state.withColumn("done", F.col("done") | (passed & (self.full() | self.overflow() | self.has_cream()))).drop("lone")
        if commons:
            here = live & F.col("only_commons")
            state = self.autocomplete(written(state, "state"), here, "words", skip_commons=True)
            state = state.withColumn("done", F.col("done") | (here & (F.size("bucket") > 0)))
        state = self.with_meaningful(state)
        over = live & self.overflow()
        reduces, nearby, completes, fuzzes = self.any(state, over & ~F.col("only_commons") & (F.size("commons") > 0), over & F.col("near"), live & ~self.overflow() & F.col("auto"), live & self.dry())
        if reduces:
            state = self.reduced(state, over & ~F.col("only_commons"))
        if nearby:
            rows = self.candidates(state.filter(over & F.col("near")), _pairs(F.col("keys")), None, F.lit(True))
            found = self.looked_up(rows).select("qid", F.get("tried", F.lit(0))["docs"].alias("docs"))
            room = F.greatest(F.col("wanted"), F.lit(self.set.least))
            state = written(state.join(found, "qid", "left").withColumn("bucket", F.when(F.col("docs").isNull(), F.col("bucket")).otherwise(self.taken(F.col("bucket"), F.coalesce("docs", _none("bigint")), room))).drop("docs"), "state")
        if completes:
            here = live & F.col("auto")
            state = written(state.withColumn("typed", here & ~self.overflow()), "state")
            if self.any(state, F.col("typed") & F.col("near"))[0]:
                state = self.autocomplete(state, F.col("typed") & F.col("near"), "meaningful", around=True)
            state = self.autocomplete(state, F.col("typed"), "meaningful").drop("typed")
        if completes or reduces:
            fuzzes, state = True, self.convert(state, live & self.small())
        if not fuzzes:  # every bucket that isn't done is full enough
            return self.convert(state, F.lit(True))
        state = written(state.withColumn("slips", live & ~self.has_cream()), "state")
        state = self.fuzzy(state, F.col("slips"), "unknown", True)
        for with_commons in (True, False):
            again = F.col("slips") & self.dry() & (F.lit(with_commons) | (F.size("commons") > 0))
            if self.any(state, again)[0]:
                state = self.convert(state, again & self.small())
                state = self.fuzzy(state, again & ~self.has_cream(), "meaningful", with_commons)
        state = state.drop("slips")
        here = live & self.dry()
        if self.any(state, here & (F.size(F.concat("meaningful", "commons")) > 1))[0]:
            state = self.related(state, here)
        state = self.convert(state, live & ~self.full() & self.small())
        state = state.withColumn("done", F.col("done") | self.full() | self.has_cream())
        few = live & self.dry() & ((F.size("bucket") == 0) | (F.size("meaningful") - 1 > F.col("threshold")))
        if self.any(state, few & (F.size("meaningful") > 0))[0]:
            order = lambda w: F.struct(F.when(_digits(w), -2).otherwise(-1), -w["df"])
            state = written(state.withColumn("few", few).withColumn("meaningful", F.when(few, _by(F.col("meaningful"), order)).otherwise(F.col("meaningful"))), "state")
            state = self.without(state, F.col("few"), two=False)
            rest = F.col("few") & (F.size("bucket") == 0) & (F.size("meaningful") > 3)
            if self.any(state, rest)[0]:
                state = self.without(state, rest, two=True)
        return self.convert(state, F.lit(True))

    def results(self, state: DataFrame) -> DataFrame:
        """qid, rank and all about the document and its house number: by falling score, then rising doc; the first `wanted`, of those the ones over the minimum."""
        rows = state.select("qid", "q", "wanted", "number", "check", F.explode("results").alias("r")).select("qid", "q", "wanted", "number", "check", "r.*")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
        top = rows.withColumn("rank", rank).filter((F.col("rank") <= F.col("wanted")) & (F.col("score") >= self.set.min_score))
        top = written(top, "top")
        documents, housenumbers = of_docs(top, self.index.documents, self.index.housenumbers)
        numbers = housenumbers.select("doc", F.col("token").alias("number"), F.struct(F.col("number"), "id", "ban_id", "x", "y", "lat", "lon").alias("housenumber"))
        whole = top.withColumn("number", F.when(F.col("check") & (F.col("number") != ""), F.col("number"))).join(numbers, ["doc", "number"], "left").join(documents.drop("words", "near", "types", "folded", "folded_street", "grams", "grams_street").withColumnRenamed("importance", "doc_importance"), "doc")
        return presented(whole)


def presented(rows: DataFrame) -> DataFrame:
    """Results as they are shown: id, kind, position and label are the house number's where there is one; labels holds all that the result is called."""
    rows = rows.withColumnRenamed("housenumber", "hn")
    kind = F.when(F.col("hn").isNotNull(), "housenumber").otherwise(F.col("kind"))
    named = F.when(F.size("name") > 0, F.col("name")).otherwise(F.array(F.lit("")))
    called = french.labels(named, F.get("postcode", F.lit(0)), F.col("city"), F.col("hn.number"), kind)
    own = lambda c: F.when(F.col("hn").isNotNull(), F.col(f"hn.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(
        "qid", "rank", "doc", own("id"), own("ban_id"), kind.alias("kind"), F.col("kind").alias("doc_kind"), F.col("hn.number").alias("housenumber"), F.get(called, F.lit(0)).alias("label"), called.alias("labels"), F.col("str").alias("str_distance"), "importance", "score", F.col("distance").alias("distance_m"),
        own("lat"), own("lon"), own("x"), own("y"), "name", "postcode", "city", "context", "citycode", "oldcitycode", "oldcity", "district", "doc_importance", "population", F.col("lat").alias("doc_lat"), F.col("lon").alias("doc_lon"),
    )


def _tokens_of(words: str) -> Column:
    return F.transform(words, lambda w: w["token"])


def _groups(common: int) -> Column:
    """The groups of words of `set` under `links` (i * 1000 + j for words i and j that share a document): greedy cliques, common words left out, none within another."""
    n = F.size("set")
    linked = lambda i, j: F.array_contains("links", i * 1_000 + j)
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def clique(origin: Column) -> Column:
        grown = F.aggregate(every, F.array(origin), lambda g, j: F.when((j != origin) & linked(origin, j) & F.forall(g, lambda m: linked(m, j)), F.concat(g, F.array(j))).otherwise(g))
        return F.array_sort(F.array_distinct(F.filter(grown, lambda m: F.get("set", m)["df"] <= common)))

    cliques = F.filter(F.transform(every, clique), lambda g: F.size(g) > 1)
    largest = F.transform(F.array_sort(F.transform(cliques, lambda g, i: F.struct((-F.size(g)).alias("s"), i.alias("i"), g.alias("g")))), lambda x: x["g"])
    unique = F.aggregate(largest, _none("array<int>"), lambda kept, g: F.when(F.exists(kept, lambda k: F.size(F.array_except(g, k)) == 0), kept).otherwise(F.concat(kept, F.array(g))))
    average = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda s, m: s + F.get("set", m)["df"]) / F.size(g)
    ordered = F.transform(F.array_sort(F.transform(unique, lambda g, i: F.struct(average(g).alias("a"), i.alias("i"), g.alias("g")))), lambda x: x["g"])
    return F.transform(ordered, lambda g: F.transform(g, lambda m: F.get("set", m)))


def search(queries: DataFrame, index: Index, settings: Settings | None = None) -> DataFrame:
    """The results of queries (qid, query, and whichever of limit, autocomplete, types, citycodes, postcodes, lat, lon there are): see presented().

    limit: 5 unless given. A null query is empty and finds nothing; one of over 200 folded characters finds nothing; qid must be unique. Filters are arrays of which a document must
    have any value, of each filter; lat and lon rank near documents first, and a coordinate of 0 fetches none.
    """
    have = [c for c in ASKED if c in queries.columns]
    members, asked = numbered_questions(queries.select("qid", *(F.col(c).alias(f"asks_{c}") for c in have)), {f"asks_{c}": c for c in have}, ("qid",))
    own = _Search(index, settings or Settings())
    found = own.results(own.run(asked.withColumnRenamed("question", "qid")))
    return members.join(found.withColumnRenamed("qid", "question"), "question").drop("question")


def allowed(filters: DataFrame, wanted: dict[str, list[str]]) -> DataFrame | None:
    """Documents with any of the values of each name; None without values. Blank values don't count, the first ten do."""
    out = None
    for name, values in wanted.items():
        kept = list(dict.fromkeys(v.strip() for v in values if v.strip()))[:MAX_FILTER_VALUES]
        if kept:
            docs = filters.filter((F.col("name") == name) & F.col("value").isin(kept)).select("doc").distinct()
            out = docs if out is None else out.join(docs, "doc", "left_semi")
    return out


def known_misspellings(words: DataFrame, index: Index) -> DataFrame:
    """token, nth, other: what words (token) may be misspelt for, in the order of the slips; numbers have none."""
    slips = words.select("token").distinct().filter(~F.col("token").rlike("^[0-9]+$")).select("token", F.posexplode(french.misspellings(F.col("token"))).alias("nth", "other"))
    return slips.join(index.tokens.select(F.col("token").alias("other")), "other").select("token", "nth", "other")
