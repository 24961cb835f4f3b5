"""Search over a written inverted index: a query reads its own terms' postings and the heads of the rows they name.

Words are stemmed lightly (`search.stem_of`), stop words aren't indexed but keep their place. The places of a row's
words run on over its fields, name, summary, path and type, as they do in a weighted document vector, so phrases are told by places and
nearness counts in the rank.

The text part of a rank follows the published weighting of such vectors. Of a word, w1, w2, ... are the field weights at its
first 255 places; one word, or alternatives: the mean over the query's words of (w_best + sum of w_j / j**2 -
w_best / best**2) / 1.64493406685. Words that must all be there: 1 - product of (1 - sqrt(w_a w_b d)) over all places a and b
of two different words, d = 1 / (1.005 + 0.05 exp(distance / 1.5 - 2)). All words that a prefix meets count as one.

Letters of scripts without blanks are indexed as pairs. A query with such letters reads the pairs of its words and then tests
the found rows' own texts, so a part of a word is found as a substring.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import postings, search
from tallyforge.sources.written import materialize

FIELDS = ("name", "summary", "path", "type")
WEIGHTS = tuple(search.FIELD_WEIGHTS[f] for f in FIELDS)
MOST_PLACES, SERIES = 255, 1.64493406685
#: Letters at the front of a word by which it is parted; prefixes in queries have as many at least.
LEAD = 3


@dataclass(frozen=True)
class Index:
    words: postings.Postings
    pairs: postings.Postings
    heads: DataFrame


def stemmed(word: Column) -> Column:
    """search.stem_of() as an expression."""
    plain = (F.length(word) < 4) | word.rlike("(ss|us|is)$")
    return F.when(plain, word).when(word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y"))).when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def placed_words(rows: DataFrame) -> DataFrame:
    """(term, lead, field, id, at): the places of each stem in each field of each row."""
    words = {f: F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)) for f in FIELDS}
    split = rows.select("id", *(w.alias(f) for f, w in words.items()))
    before = lambda k: sum((F.size(f) for f in FIELDS[:k]), F.lit(0))
    fields = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), before(k).alias("before"), F.col(f).alias("words")) for k, f in enumerate(FIELDS))))
    each = split.select("id", fields.alias("f")).select("id", "f.field", "f.before", F.posexplode("f.words").alias("k", "word")).where(~F.col("word").isin(*search.STOP_WORDS))
    found = each.select(stemmed(F.col("word")).alias("term"), "field", "id", (F.col("before") + F.col("k")).alias("at"))
    return found.groupBy("term", "field", "id").agg(F.array_sort(F.collect_list("at")).alias("at")).withColumn("lead", F.substring("term", 1, LEAD))


def _told(q: str) -> str:
    return regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), q)


def whole() -> Column:
    """The text that parts of words are looked for in."""
    return F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))


def letter_pairs(rows: DataFrame) -> DataFrame:
    """(term, lead, id): pairs of characters that begin or end with a letter of a script without blanks; the last one alone."""
    some = rows.select("id", whole().alias("text")).where(F.col("text").rlike(search.CJK_LETTER)).select("id", F.split("text", "").alias("c"))
    pairs = F.transform("c", lambda x, i: F.concat(x, F.coalesce(F.get("c", i + 1), F.lit(""))))
    return some.select("id", F.explode(F.array_distinct(pairs)).alias("term")).where(F.col("term").rlike(search.CJK_LETTER)).withColumn("lead", F.substring("term", 1, 1))


def build(rows: DataFrame, buckets: int = postings.BUCKETS) -> Index:
    """The index of rows (id, repository, type, name, summary, path, language, ...), written once. Hand over those that a search may
    show: live and listed ones."""
    heads = materialize(rows, "heads")
    return Index(postings.write(placed_words(heads), "words", buckets), postings.write(letter_pairs(heads), "pairs", buckets), heads)


@dataclass(frozen=True)
class Plan:
    """A query's alternatives of terms, and its different words: (stem, whether it may go on)."""

    alternatives: list[list[search.Term]]
    words: list[tuple[str, bool]]

    def parts(self, term: search.Term) -> list[tuple[int, int]]:
        """(place in the term, number of the word) of a term's words that say something."""
        kept = [(k, w) for k, w in enumerate(term.words) if w not in search.STOP_WORDS]
        return [(k, self.words.index((search.stem_of(w), term.prefix and k == len(term.words) - 1))) for k, w in kept]


def planned(query: str, mode: str = "all") -> Plan:
    told = search.parsed(query)
    if mode == "any" and search.plain_words(query) is not None:
        told = [[t] for terms in told for t in terms]
    words = [(search.stem_of(w), t.prefix and k == len(t.words) - 1) for terms in told for t in terms for k, w in enumerate(t.words) if w not in search.STOP_WORDS]
    return Plan(told, list(dict.fromkeys(words)))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def term_there(plan: Plan, term: search.Term, field: int | None = None) -> Column:
    """Whether a row's places hold the term: its words at their distances, in one field if that is named."""
    at = lambda i: F.transform(F.col(f"w{i}") if field is None else F.filter(f"w{i}", lambda x: x["field"] == field), lambda x: x["at"])
    back = lambda places, k: F.transform(places, lambda x: x - k)
    return F.size(reduce(F.array_intersect, [back(at(i), k) for k, i in plan.parts(term)])) > 0


def tree_there(plan: Plan, field: int | None = None) -> Column:
    one = lambda t: ~term_there(plan, t, field) if t.negated else term_there(plan, t, field)
    return _any([_all([one(t) for t in terms]) for terms in plan.alternatives])


def field_hit(plan: Plan, query: str, field: int) -> Column:
    """Whether a field has what was asked for: any term of a plain query, else the query as it is."""
    if search.plain_words(query) is None:
        return tree_there(plan, field)
    return _any([term_there(plan, t, field) for terms in plan.alternatives for t in terms])


def text_rank(plan: Plan, mode: str = "all") -> Column:
    if not plan.words:
        return F.lit(0.0)
    weights = F.array(*map(F.lit, WEIGHTS))
    first = [F.transform(F.slice(f"w{i}", 1, MOST_PLACES), lambda x: F.struct(x["at"].alias("at"), F.get(weights, x["field"]).alias("w"))) for i in range(len(plan.words))]
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    if len(plan.alternatives) == 1 and len(plan.words) > 1:
        near = lambda a, b: F.sqrt(a["w"] * b["w"] / (1.005 + 0.05 * F.exp(F.least(F.abs(a["at"] - b["at"]), F.lit(100)) / 1.5 - 2)))
        left = lambda p, q: F.aggregate(p, F.lit(1.0), lambda acc, a: F.aggregate(q, acc, lambda acc2, b: F.when(a["at"] == b["at"], acc2).otherwise(acc2 * (1 - near(a, b)))))
        apart = reduce(lambda x, y: x * y, [left(first[i], first[k]) for i in range(len(first)) for k in range(i)])
        return F.when(apart == 1, 1e-20).otherwise(1 - apart)

    def one(p: Column) -> Column:
        w = F.transform(p, lambda x: x["w"])
        best = F.array_max(w)
        at = F.array_position(w, best)
        return F.when(F.size(p) == 0, 0.0).otherwise((best + total(F.transform(w, lambda x, j: x / ((j + 1) * (j + 1)))) - best / (at * at)) / SERIES)

    return reduce(lambda x, y: x + y, map(one, first)) / len(first)


def placed(index: Index, plan: Plan, cut: bool) -> DataFrame:
    """(id, w0, w1, ...): where each word of the query is, for rows that have one. With `cut`, of several that must all be there
    the one with the shortest list goes first, and the others' lists are cut down to its rows before they are gathered."""
    terms, prefixes = [t for t, more in plan.words if not more], [t for t, more in plan.words if more]
    found = index.words.lookup(terms, prefixes, LEAD)
    if cut and len(plan.alternatives) == 1 and len(plan.words) > 1:
        needed = [w for t in plan.alternatives[0] if not t.negated for _, i in plan.parts(t) if not (w := plan.words[i])[1]]
        if needed:
            lengths = index.words.lengths([w for w, _ in needed])
            rarest = min((w for w, _ in needed), key=lambda w: lengths.get(w, 0))
            found = found.join(index.words.lookup([rarest], [], LEAD).select("id").distinct(), "id", "left_semi")
    places = F.transform("at", lambda x: F.struct(x.alias("at"), F.col("field").alias("field")))
    meets = [F.col("term").startswith(t) if more else F.col("term") == t for t, more in plan.words]
    return found.groupBy("id").agg(*(F.array_sort(F.flatten(F.collect_list(F.when(m, places)))).alias(f"w{i}") for i, m in enumerate(meets)))


def part_words(query: str) -> list[str]:
    """The words of a query with letters of scripts without blanks, else none."""
    return (search.plain_words(query) or []) if regex.search(_told(search.CJK_LETTER), query) else []


def parts_there(index: Index, query: str, mode: str) -> DataFrame:
    """(id): rows whose name and summary hold all (or any) of the query's words as parts."""
    words = part_words(query)
    tests = [F.instr(whole(), w) > 0 for w in words]
    verified = _all(tests) if mode == "all" else _any(tests)
    letter = regex.compile(_told(search.CJK_LETTER))
    pairs = lambda w: [p for p in ({w[i : i + 2] for i in range(len(w) - 1)} if len(w) > 1 else set()) if letter.search(p)]
    able = [w for w in words if letter.search(w)]
    if mode != "all" and len(able) < len(words):  # a word without such a letter may be part of any text
        return index.heads.where(verified).select("id")
    met = None
    for w in able:
        grams = pairs(w)
        have = index.pairs.lookup(grams, [] if grams else [w], 1).groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") >= max(1, len(grams))).select("id")
        met = have if met is None else met.join(have, "id", "left_semi") if mode == "all" else met.unionByName(have).distinct()
    return index.heads.join(met, "id", "left_semi").where(verified).select("id")


def matched(index: Index, query: str | None, mode: str = "all") -> DataFrame:
    """Heads of the rows that match, with the places of the query's words (empty where a row matches by its repository's
    name or by a part of a word alone). None asks for no words: all rows; a blank query finds nothing."""
    if query is None:
        return index.heads
    plan, q = planned(query, mode), query.strip().lower()
    empty = F.array().cast("array<struct<at:int,field:int>>")
    names = [f"w{i}" for i in range(len(plan.words))]
    others = []
    if len(q) >= 3:
        named = index.heads.select("repository").distinct().where(F.lower("repository").contains(q))
        others.append(index.heads.join(named, "repository", "left_semi").select("id"))
    if part_words(query):
        others.append(parts_there(index, query, mode))
    places = None
    if plan.words:
        places = placed(index, plan, cut=not part_words(query))
        if any(all(t.negated for t in terms) for terms in plan.alternatives):  # an exclusion alone finds rows without any word
            places = index.heads.select("id").join(places, "id", "left").select("id", *(F.coalesce(n, empty).alias(n) for n in names))
    if not others:
        return index.heads.limit(0) if places is None else index.heads.join(places.where(tree_there(plan)), "id")
    more = reduce(DataFrame.unionByName, others).distinct()
    if places is None:
        return index.heads.join(more, "id", "left_semi")
    joined = places.withColumn("hit", tree_there(plan)).join(more.withColumn("other", F.lit(True)), "id", "full_outer").where("hit or other")
    return index.heads.join(joined.select("id", *(F.coalesce(n, empty).alias(n) for n in names)), "id")


def ranked(rows: DataFrame, query: str | None, mode: str = "all") -> DataFrame:
    """Rows of matched() with their rank and the fields they matched in."""
    if query is None:
        return rows.withColumns({"rank": F.lit(0.0), "matched_in": F.array().cast("array<string>")})
    plan, q, name = planned(query, mode), query.strip().lower(), F.lower("name")
    when = lambda test, weight: F.when(F.coalesce(test, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))
    in_path = F.lower("path").contains(q) if "/" in q else F.lit(False)
    hits = [field_hit(plan, query, k) if plan.words else F.lit(False) for k in range(len(FIELDS))]
    part = lambda c: _any([F.instr(F.lower(c), w) > 0 for w in part_words(query)])
    repository = F.lower("repository").contains(q)
    rank = when(name == q, search.EXACT) + when(name.startswith(q), search.PREFIX) + when(hits[0], search.NAME_WORD) + text_rank(plan, mode) + when(repository, search.REPOSITORY) + when(in_path, search.PATH)
    fields = {"name": hits[0] | name.startswith(q) | part("name"), "path": hits[2] | in_path, "summary": hits[1] | part("summary"), "type": hits[3], "repository": repository if len(q) >= 3 else F.lit(False)}
    matched_in = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(f)) for f, test in fields.items())))
    return rows.withColumns({"rank": F.round(rank, 5), "matched_in": matched_in}).drop(*(f"w{i}" for i in range(len(plan.words))))


def mode_of(index: Index, query: str | None, filters: search.Filters) -> str:
    """`all`, or `any` for several plain words that no row within the filters has all of."""
    several = query is not None and search.plain_words(query) is not None and sum(map(len, search.parsed(query))) > 1
    return "any" if several and _within(index, query, "all", filters).isEmpty() else "all"


def _within(index: Index, query: str | None, mode: str, filters: search.Filters) -> DataFrame:
    return matched(index, query, mode).where(_all(list(filters.tests().values())))


def count(index: Index, query: str | None, mode: str | None = None, filters: search.Filters | None = None) -> DataFrame:
    """(n): how many rows find() pages through, by the same tests."""
    filters = filters or search.Filters()
    return _within(index, query, mode or mode_of(index, query, filters), filters).agg(F.count("*").alias("n"))


def find(index: Index, query: str | None, limit: int = 25, offset: int = 0, mode: str | None = None, filters: search.Filters | None = None, sort: str = "relevance") -> DataFrame:
    """A page of rows: rows are matched and filtered by their places and heads, and a page is cut before wide columns are read."""
    filters = filters or search.Filters()
    mode = mode or mode_of(index, query, filters)
    rows = ranked(_within(index, query, mode, filters), query, mode)
    return rows.orderBy(*search.sorted_by(sort)).offset(offset).limit(limit)
