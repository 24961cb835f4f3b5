"""Source divergence audit: how far the word shares of the sources of a language lie apart.

An inverted index with baseline correction. Every source gives a term that it hasn't the share p0 of
zero counts, so a pair of sources starts at V * f(p0, q0), as if neither had any of the V kept terms.
The postings of the terms, rows (lang, term, source, share), then emit corrections:

* where one source has the term, f(p, q0) - f(p0, q0). It depends on the term by p alone, so the terms of a
  source are counted by p first and each different p is met with every other source once, not once a term;
* where both have it, what is then still missing: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

Corrections of zero aren't emitted. Their sum is the sum of f over all kept terms, exactly: whole
numbers throughout, products beyond 64 bits as decimals.

The result holds every ordered pair of sources of a language, as it must by its definition, so it grows with the
square of the sources (not of the documents). Pairs are dealt out by blocks of sources, so that a language or
a term that all sources share is work for many tasks.

A row of docs is a document, whatever its id; repeated rows count as often as they occur. Null text, lang and source
are read as ''. Ties in value go by the item's UTF-8 bytes. An empty table gives an empty result. Other columns aren't
read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .shared import discard, materialize, slices

LEAST_DOCUMENTS, TOP_TERMS, BILLION = 10, 10, 1_000_000_000
#: Sources of a language that meet in one block.
BLOCK = 256
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32
_IN_TERM = np.arange(256) >= 128
_IN_TERM[ord("a") : ord("z") + 1] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): partial counts of a slice of documents each; and every
    (lang, source) with a null term, so that groups without terms are known too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            lang, langs = spans.codes(batch.column("lang").fill_null(""))
            source, sources = spans.codes(batch.column("source").fill_null(""))
            groups, group = np.unique(lang * len(sources) + source, return_inverse=True)
            data, offsets = spans.utf8(batch.column("text"))
            data = _FOLDED[data]
            inside = _IN_TERM[data]
            found = spans.runs(inside, offsets)
            code, terms = spans.codes(spans.strings(data, inside, found))
            many = max(1, len(terms))
            at, n = np.unique(found.text * many + code, return_counts=True)  # once a document and term
            at, which = np.unique(group[at // many] * many + at % many, return_inverse=True)
            of = np.concatenate([at // many, np.arange(len(groups))])
            none = np.zeros(len(groups), np.int64)
            words = pa.concat_arrays([terms.cast(pa.string()).take(pa.array(at % many)), pa.nulls(len(groups), pa.string())])
            yield pa.RecordBatch.from_arrays(
                [
                    langs.cast(pa.string()).take(pa.array(groups[of] // len(sources))),
                    sources.cast(pa.string()).take(pa.array(groups[of] % len(sources))),
                    words,
                    pa.array(np.concatenate([np.bincount(which, n, len(at)).astype(np.int64), none])),
                    pa.array(np.concatenate([np.bincount(which, minlength=len(at)), none])),
                ],
                names=["lang", "source", "term", "n", "documents"],
            )

    return docs.select(F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, "lang string, source string, term string, n long, documents long")


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept))."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(20,0)) * {BILLION}) div (cast({total} as decimal(20,0)) + 2 * {kept})")


def gap(p: str, q: str) -> str:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so the square is a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def kept_terms(counted: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): terms in at least `least` documents of their lang; `first` is true once a
    term. A window's rows are the sources that have one term."""
    term = Window.partitionBy("lang", "term")
    rows = counted.where("term is not null").withColumns({"in_all": F.sum("documents").over(term), "lang_n": F.sum("n").over(term), "least": F.min("source").over(term)})
    return rows.where(F.col("in_all") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("first"))


def indexed(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the sources (lang, source, kept, p0) with the number of kept terms and the share of a
    term without counts (null if none is kept), and the postings (lang, term, source, p, p0, q), q the lang's share."""
    counted = materialize(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "audit-counts")
    kept = materialize(kept_terms(counted, least), "audit-kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    every = materialize(every.withColumn("p0", F.when(F.col("kept") > 0, share("0", "total", "kept"))), "audit-sources")
    postings = kept.join(every, ["lang", "source"]).select("lang", "term", "source", share("n", "total", "kept").alias("p"), "p0", share("lang_n", "lang_total", "kept").alias("q"))
    postings = materialize(postings, "audit-postings")
    discard(counted, kept)
    return every.select("lang", "source", "kept", "p0"), postings


def pair_values(sources: DataFrame, postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a lang."""
    most = sources.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-most // block) or 1
    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    in_every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = lambda rows: rows.withColumn("block", own)
    other = sources.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), in_every.alias("block"))
    pair = ["lang", F.least("source", "item").alias("one"), F.greatest("source", "item").alias("other")]

    base = dealt(sources).join(other, ["lang", "block"]).where("source < item").select(*pair, F.coalesce(F.expr(f"kept * {gap('p0', 'q0')}"), F.lit(0)).alias("value"))
    counted = postings.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    one_has = dealt(counted).join(other, ["lang", "block"]).where("source <> item").select(*pair, F.expr(f"terms * ({gap('p', 'q0')} - {gap('p0', 'q0')})").alias("value"))
    others = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q1"), F.col("p0").alias("q0"), in_every.alias("block"))
    rest = f"{gap('p', 'q1')} - {gap('p', 'q0')} - {gap('p0', 'q1')} + {gap('p0', 'q0')}"
    both_have = dealt(postings.drop("q")).join(others, ["lang", "term", "block"]).where("source < item").select(*pair, F.expr(rest).alias("value"))

    corrections = one_has.unionByName(both_have).where("value <> 0")
    summed = base.unionByName(corrections).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    return summed.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("s"), "value").select("lang", "s.*", "value")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the divergence from each other source of the lang,
    part `term` the terms (at most `top`) that are most over the lang's own share."""
    sources, postings = indexed(docs, least)
    order = [F.desc("value"), F.asc("item")]
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    pairs = pair_values(sources, postings, block).withColumn("rank", place)
    terms = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value")).withColumn("rank", place).where(F.col("rank") <= top)
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


ORACLE_SQL = r"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
t as (select lang, source, r, unnest(words) as term from d),
k as (select lang, term from t group by all having count(distinct r) >= 10),
g as (select distinct lang, source from d),
v as (select l.lang, count(term) as v from (select distinct lang from d) l left join k on k.lang = l.lang group by 1),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
  1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) + 2 * v.v) as p
  from g join v on v.lang = g.lang join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (sum(sum(n)) over (partition by lang) + 2 * count(*) over (partition by lang)) as q from p group by 1, 2),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
  on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select p.lang, p.source, p.term as item, ((p - q) * (p - q)) // (p + q) as value from p join q on q.lang = p.lang and q.term = p.term where n > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10"""
