"""Ranked search: query syntax, field vectors, matches, ranks, filters, sorts, trigram likeness and retrieval figures."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.capabilities import CAPABILITIES
from tallyforge.sources.written import materialize

EXACT, PREFIX, PATH, NAME_WORD, REPOSITORY = 2.0, 1.0, 1.0, 0.5, 0.1
#: Weight of a word by field, those of the classes A, B, C and D; the text part of a rank is the mean over words of the greatest.
FIELD_WEIGHTS = {"name": 1.0, "summary": 0.4, "path": 0.2, "type": 0.1}
#: Words that say nothing; a query of these alone finds nothing.
STOP_WORDS = frozenset("a an and are as at be but by for from has have he i if in into is it its no not of on or such that the their then there these they this to was we were will with you".split())
CJK_LETTER = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
TYPES = ("skill", "command", "agent", "plugin", "catalog", "mcp_server", "hook")
SORTS = ("relevance", "recent", "added", "changed", "name")


@dataclass(frozen=True)
class Term:
    """Neighbouring words; `prefix`: the last one may go on; `negated`: they must not be there."""

    words: tuple[str, ...]
    prefix: bool = False
    negated: bool = False


def plain_words(query: str) -> list[str] | None:
    """Lower-cased words of a query, or None if it uses phrases, exclusions or alternatives."""
    import regex

    if '"' in query or regex.search(r"(?:^|\s)-\S", query) or regex.search(r"\sor\s", query, regex.I):
        return None
    return [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", query)]


def parsed(query: str) -> list[list[Term]]:
    """Alternatives of terms that must all hold; `or` binds loosest.

    Words of a plain query are terms of their own, split at every mark but an inner dot: the parts of
    node.js are neighbours. The last one is a prefix from three letters on. With quotes, exclusions or `or` a
    phrase in quotes and a word with inner marks are neighbours. Stop words alone in a term are left out."""
    import regex

    if plain_words(query) is not None:
        chunks = [tuple(c.split(".")) for c in regex.findall(r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*", query.lower())]
        last = len(chunks) - 1
        terms = [Term(words, i == last and len(words[-1]) >= 3) for i, words in enumerate(chunks) if not all(w in STOP_WORDS for w in words)]
        return [terms] if terms else []
    out: list[list[Term]] = [[]]
    for minus, phrase, word in regex.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if not phrase and word.lower() == "or" and out[-1]:
            out.append([])
            continue
        words = tuple(w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", phrase or word))
        if words and not all(w in STOP_WORDS for w in words):
            out[-1].append(Term(words, False, bool(minus)))
    return [terms for terms in out if terms]


def normalize_query(raw: str | list[str] | None, most: int = 200) -> str:
    """First of a list, trimmed, white space as one blank, cut at `most` UTF-16 units."""
    q = (raw[0] if raw else "") if isinstance(raw, list) else raw or ""
    return " ".join(q.split()).encode("utf-16-le")[: 2 * most].decode("utf-16-le", errors="ignore")


def known(values: list[str] | None, allowed: tuple[str, ...]) -> list[str] | None:
    """Those of the values that exist. None (all) and an empty list (none) stay apart."""
    return None if values is None else [v for v in values if v in allowed]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stems(text: Column) -> Column:
    """The words of a text with light stems, between blanks: plural endings only (ies to y, s but not
    ss, us, is), from four letters on. Whole-text replacements, not a function a word."""
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(spaced, "([^ ])ies(?= )", "$1y"), "([^ ]{2}[^ sui])s(?= )", "$1")


def stem_of(word: str) -> str:
    return word if len(word) < 4 or word.endswith(("ss", "us", "is")) else word[:-3] + "y" if word.endswith("ies") else word.removesuffix("s")


def with_vector(packages: DataFrame) -> DataFrame:
    """Adds `vector`: the stems of each field, in order, each between blanks. Made once a row, however
    many words and weights look at it; rows of indexed() have it already."""
    if "vector" in packages.columns:
        return packages
    return packages.withColumn("vector", F.struct(*(stems(F.col(f)).alias(f) for f in FIELD_WEIGHTS)))


def indexed(packages: DataFrame) -> DataFrame:
    """The rows with their vectors, written once as a table that any number of searches read."""
    return materialize(with_vector(packages), "search-index")


def holds(text: Column, term: Term, least: int = 0) -> Column:
    """Whether a field of the vector has the term's words one after another."""
    words = [stem_of(w) for w in term.words]
    return text.contains(" " + " ".join(words) + ("" if term.prefix else " "))


def _every(tests: list[Column], mode: str = "all") -> Column:
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), tests) if tests else F.lit(False)


def term_hit(term: Term) -> Column:
    there = _every([holds(F.col(f"vector.{f}"), term) for f in FIELD_WEIGHTS], "any")
    return ~there if term.negated else there


def matches(query: str, mode: str = "all") -> Column:
    """The match predicate: all (or any) terms of an alternative in some field; or the repository's
    name holds the query, from three characters on; or, with letters of scripts without blanks, name and
    summary hold all (or any) of its parts. A query without a usable word matches by these two alone."""
    import regex

    found = [_every([term_hit(t) for t in terms], mode) for terms in parsed(query)]
    q = query.strip().lower()
    if len(q) >= 3:
        found.append(F.lower("repository").contains(q))
    if regex.search(regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK_LETTER), query):
        whole = F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
        found.append(_every([whole.contains(w) for w in q.split()], mode))
    return F.coalesce(_every(found, "any"), F.lit(False))


def rank(query: str) -> Column:
    """Exact name 2 (and 1, as it is a prefix too), name prefix 1, a word of the name 0.5, the mean over
    terms of the greatest field weight, repository 0.1, and for a query with a slash a path 1."""
    q, name = query.strip().lower(), F.lower("name")
    when = lambda test, weight: F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    terms = [t for some in parsed(query) for t in some if not t.negated]
    best = [F.greatest(*(when(holds(F.col(f"vector.{f}"), t), w) for f, w in FIELD_WEIGHTS.items())) for t in terms]
    share = reduce(lambda a, b: a + b, best) / len(best) if best else F.lit(0.0)
    some = _every([holds(F.col("vector.name"), t) for t in terms], "any")
    path = when(F.lower("path").contains(q), PATH) if "/" in q else F.lit(0.0)
    return when(name == q, EXACT) + when(name.startswith(q), PREFIX) + when(some, NAME_WORD) + share + when(F.lower("repository").contains(q), REPOSITORY) + path if q else F.lit(0.0)


def matched_in(query: str) -> Column:
    """array<string>: which of name, path, summary, type and repository have a term of the query."""
    terms = [t for some in parsed(query) for t in some if not t.negated]
    fields = {f: _every([holds(F.col(f"vector.{f}"), t) for t in terms], "any") for f in ("name", "path", "summary", "type")}
    q = query.strip().lower()
    fields["repository"] = F.lower("repository").contains(q) if len(q) >= 3 else F.lit(False)
    return F.array_compact(F.array(*(F.when(test, F.lit(f)) for f, test in fields.items())))


@dataclass
class Filters:
    """What a reader chose. None means all, an empty list none. `languages` names classes to show;
    without it those in `hidden` aren't shown; "any" shows all. All of `capabilities` must have been observed
    (capabilities.with_capabilities)."""

    types: list[str] | None = None
    languages: list[str] | None = None
    hidden: list[str] = field(default_factory=list)
    capabilities: list[str] = field(default_factory=list)

    def tests(self) -> dict[str, Column]:
        out = {}
        if (types := known(self.types, TYPES)) is not None:
            out["types"] = F.col("type").isin(*types) if types else F.lit(False)
        if self.languages is not None and "any" not in self.languages:
            out["languages"] = F.coalesce(F.col("language").isin(*self.languages), F.lit(False)) if self.languages else F.lit(False)
        elif self.languages is None and self.hidden:
            out["languages"] = F.col("language").isNull() | ~F.col("language").isin(*self.hidden)
        for name in known(self.capabilities, CAPABILITIES) or ():
            out[name] = F.array_contains("capabilities", name)
        return out


def where(query: str, filters: Filters, mode: str = "all") -> Column:
    """One predicate for the rows and for their number: text and filters."""
    tests = list(filters.tests().values())
    return _every([*tests, *([matches(query, mode)] if query.strip() else [])]) if tests or query.strip() else F.lit(True)


def sorted_by(sort: str) -> list[Column]:
    """Each order ends in the id, so it is total."""
    first = {"relevance": [F.desc("rank")], "recent": [F.desc_nulls_last("updated_at")], "added": [F.desc_nulls_last("created_at")], "changed": [F.desc_nulls_last("changed_at")], "name": [F.asc(F.lower("name"))]}
    return [*first[sort if sort in SORTS else "relevance"], F.desc("id")]


def mode_of(packages: DataFrame, query: str, filters: Filters) -> str:
    """`all`, or `any` for several plain words that no row has all of."""
    several = plain_words(query) is not None and sum(map(len, parsed(query))) > 1
    return "any" if several and with_vector(packages).where(where(query, filters)).isEmpty() else "all"


def search(packages: DataFrame, query: str, limit: int = 25, offset: int = 0, mode: str | None = None, filters: Filters | None = None, sort: str = "relevance") -> DataFrame:
    """A page of rows that match, with rank and matched_in."""
    filters = filters or Filters()
    mode = mode or mode_of(packages, query, filters)
    found = with_vector(packages).where(where(query, filters, mode)).withColumn("rank", F.round(rank(query), 6)).withColumn("matched_in", matched_in(query))
    return found.drop("vector").orderBy(*sorted_by(sort)).offset(offset).limit(limit)


def relaxed_counts(packages: DataFrame, query: str, filters: Filters, mode: str = "all") -> DataFrame:
    """(without, n): how many rows match with all filters (null), and with each one taken away, in one pass."""
    tests = filters.tests() | ({"query": matches(query, mode)} if query.strip() else {})
    counts = {None: _every(list(tests.values())) if tests else F.lit(True)} | {k: _every([t for o, t in tests.items() if o != k]) if len(tests) > 1 else F.lit(True) for k in tests}
    one = with_vector(packages).agg(*(F.count_if(t).alias(f"n{i}") for i, t in enumerate(counts.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).cast("string").alias("without"), F.col(f"n{i}").alias("n")) for i, k in enumerate(counts)))).alias("r")).select("r.*")


def marked(text: Column, query: str, opening: str = "\x02", closing: str = "\x03") -> Column:
    """text with every word of the query (any ending for a prefix or a plural) between two control
    characters; those that stand in the text are taken out first."""
    words = sorted({stem_of(w) for some in parsed(query) for t in some if not t.negated for w in t.words}, key=len, reverse=True)
    clean = F.regexp_replace(text, f"[{opening}{closing}]", "")
    if not words:
        return clean
    any_of = "|".join(re.escape(w[:-1]) + "(?:y|ies)" if w.endswith("y") else re.escape(w) + "s?" for w in words)
    return F.regexp_replace(clean, rf"(?i)(?<![\p{{L}}\p{{N}}])({any_of})(?![\p{{L}}\p{{N}}])", f"{opening}$1{closing}")


def segments(marked_text: Column, opening: str = "\x02", closing: str = "\x03") -> Column:
    """array<struct<text, marked>> of a marked text; one plain segment, without the marks, if they don't pair."""
    paired = marked_text.rlike(rf"(?s)\A[^{opening}{closing}]*(?:{opening}[^{opening}{closing}]*{closing}[^{opening}{closing}]*)*\z")
    parts = F.split(F.regexp_replace(marked_text, closing, opening), opening, -1)
    told = F.transform(parts, lambda x, i: F.struct(x.alias("text"), (i % 2 == 1).alias("marked")))
    plain = F.array(F.struct(F.regexp_replace(marked_text, f"[{opening}{closing}]", "").alias("text"), F.lit(False).alias("marked")))
    return F.when(paired, F.filter(told, lambda x: x["text"] != "")).otherwise(plain)


def mark_substring(text: Column, needle: str, opening: str = "\x02", closing: str = "\x03") -> Column:
    """text with each case-insensitive occurrence of the needle marked; unmarked where lower case has another length."""
    if not needle:
        return text
    same = F.length(F.lower(text)) == F.length(text)
    return F.when(same, F.regexp_replace(text, "(?iu)" + re.escape(needle), f"{opening}$0{closing}")).otherwise(text)


def trigrams(text: Column) -> Column:
    """array<string>: distinct trigrams of words padded with two blanks before and one after."""
    words = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def retrieval_figures(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query: precision at 5 and k, recall at k, reciprocal rank, NDCG at k and whether the first hit is relevant, from (query, rank, doc)."""
    judged = hits.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), ["query", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    gains = judged.groupBy("query").agg(F.sum("rel").alias("found"), F.sum(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)).alias("found5"), F.max(F.when(F.col("rel") == 1, 1 / F.col("rank"))).alias("rr"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    total = relevant.groupBy("query").agg(F.countDistinct("doc").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return total.join(gains, "query", "left").select(
        "query",
        F.round(zero("found5") / 5, 6).alias("precision_at_5"),
        F.round(zero("found") / k, 6).alias("precision_at_k"),
        F.round(zero("found") / F.col("n"), 6).alias("recall_at_k"),
        F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_at_k"),
        (zero("rr") == 1).alias("top_1"),
    )
