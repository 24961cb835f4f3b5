"""The written indexes against plain computation over every row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import fuzzy, indexed_search, postings, search

COLUMNS = "id long, repository string, type string, name string, summary string, path string, language string, stars int, updated_at int, term string, bucket string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    words = ["pdf", "reader", "the", "reviews", "node.js", "of", "Tools", "files", "代码审查", "コード", "x-y"]
    made = [(i, f"o/r{i % 7}", r.choice(["skill", "mcp_server"]), r.choice(words), " ".join(r.choices(words, k=r.randint(0, 12))), r.choice(["a/SKILL.md", "pdf/b.c"]), None, i, i % 3, "t", "b") for i in range(120)]
    return made + [(900, None, None, None, None, None, None, None, None, None, None), (901, "o/long", "skill", "", "pdf reader " * 4000, "", "zh", 1, 1, "", ""), (902, "o/long", "skill", "", "pdf reader " * 4000, "", "zh", 1, 1, "", "")]


@pytest.fixture(scope="module")
def index(spark, rows):
    return indexed_search.build(spark.createDataFrame(rows, COLUMNS).repartition(3), buckets=5)


def plain_words(row):
    """(stem, place, field) of every word of a row that isn't a stop word."""
    import regex

    out, at = [], 0
    for field, text in enumerate((row[3], row[4], row[5], row[2])):
        for w in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()):
            if w not in search.STOP_WORDS:
                out.append((search.stem_of(w), at, field))
            at += 1
    return out


def plain_search(rows, alternatives, repository=None, parts=()):
    """ids of rows with an alternative of (sign, [(place, stem, prefix)]) terms."""
    out = set()
    for row in rows:
        words = plain_words(row)
        spots = {(s, p) for s, p, _ in words}
        last = lambda stem, p: any(q == p and s.startswith(stem) for s, q in spots)
        there = lambda term: any(all(last(s, p - term[0][0] + k) if more else (s, p - term[0][0] + k) in spots for k, s, more in term) for p in {p for _, p in spots})
        text = f"{row[3] or ''} {row[4] or ''}".lower()
        if any(all(there(t) != (sign == "-") for sign, t in terms) for terms in alternatives) or (repository and repository in (row[1] or "")) or (parts and all(p in text for p in parts)):
            out.add(row[0])
    return out


def test_matches(index, rows):
    w = lambda s, more=False: ("", [(0, s, more)])
    cases = {
        "pdf": ([[w("pdf", True)]], "pdf", ()),
        "pdf reader": ([[w("pdf"), w("reader", True)]], None, ()),
        '"pdf reader"': ([[("", [(0, "pdf", False), (1, "reader", False)])]], None, ()),
        '"reader of the pdf"': ([[("", [(0, "reader", False), (3, "pdf", False)])]], None, ()),
        "tool review": ([[w("tool"), w("review", True)]], None, ()),
        "node.js": ([[("", [(0, "node", False), (1, "js", False)])]], None, ()),
        "a/SKILL": ([[w("skill", True)]], None, ()),
        "-pdf": ([[("-", [(0, "pdf", False)])]], None, ()),
        "files -reader or 代码审查": ([[w("file"), ("-", [(0, "reader", False)])], [w("代码审查")]], None, ()),
        "o/r3": ([[w("o"), w("r3", False)]], "o/r3", ()),
        "码审": ([[w("码审")]], None, ("码審".replace("審", "审"),)),
        "ド": ([[w("ド")]], None, ("ド",)),
        "コード pdf": ([[w("コード"), w("pdf", True)]], None, ("コード", "pdf")),
    }
    for q, (alternatives, repository, parts) in cases.items():
        got = {r["id"] for r in indexed_search.matched(index, q).select("id").collect()}
        assert got == plain_search(rows, alternatives, repository, parts), q
    assert {r["id"] for r in indexed_search.find(index, "tool review", limit=500, mode="all").collect()} == plain_search(rows, [[w("tool"), w("review", True)]])
    for q in ("", "the", "!!!", "the of"):
        assert indexed_search.find(index, q).count() == 0
    both = indexed_search.matched(index, "node zzz", "any")
    assert indexed_search.mode_of(index, "node zzz", search.Filters()) == "any" and indexed_search.mode_of(index, "pdf reader", search.Filters()) == "all"
    assert {r["id"] for r in both.select("id").collect()} == plain_search(rows, [[w("node")], [w("zzz", True)]])
    # what is within the filters decides
    assert indexed_search.mode_of(index, "pdf reader", search.Filters(types=[])) == "any"


def test_ranks(index, rows):
    got = {r["id"]: (r["rank"], r["matched_in"]) for r in indexed_search.find(index, "pdf tool", limit=500, mode="all").collect()}
    for row in rows:
        if row[0] not in got:
            continue
        at = {k: [(p, indexed_search.WEIGHTS[f]) for s, p, f in plain_words(row) if (s == stem if k == 0 else s.startswith(stem))][:255] for k, stem in enumerate(("pdf", "tool"))}
        apart = math.prod(1 - math.sqrt(a * b / (1.005 + 0.05 * math.exp(min(abs(p - q), 100) / 1.5 - 2))) for p, a in at[0] for q, b in at[1] if p != q)
        named = bool({"pdf", "tool"} & {s for s, _, f in plain_words(row) if f == 0})
        assert abs(got[row[0]][0] - ((1 - apart if apart != 1 else 1e-20) + 0.5 * named)) < 1.1e-5
        assert ("name" in got[row[0]][1]) == named
    assert len(got) > 10
    fields = {r["id"]: r["matched_in"] for r in indexed_search.find(index, "代码审查", limit=500).collect()}
    assert fields and all(("name" in m) == ("代码审查" in rows[i][3]) and ("summary" in m) == ("代码审查" in rows[i][4]) for i, m in fields.items())
    by_path = indexed_search.find(index, "a/skill.md", limit=500).collect()
    assert by_path and all("path" in r["matched_in"] and r["rank"] >= 1 for r in by_path if r["path"] == "a/SKILL.md")


def test_an_unknown_or_empty_table(spark, index):
    assert indexed_search.find(index, "nowhere").count() == 0
    none = indexed_search.build(index.heads.limit(0), buckets=3)
    assert indexed_search.find(none, "pdf").count() == 0 and indexed_search.find(none, "代码").count() == 0


def test_a_lookup_reads_its_buckets_only(spark, index):
    look = index.words.lookup(["pdf"], ["rea"])
    plan = look._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [Or(" in plan
    names = lambda df: {f.split("bucket=")[1].split("/")[0] for f in df.inputFiles()}
    assert names(look) == {str(index.words.bucket_of("pdf")), str(index.words.bucket_of("rea"))} or len(names(look)) <= 5
    assert {r["term"] for r in look.select("term").distinct().collect()} == {"pdf", "reader"}
    assert index.words.lengths(["pdf", "nowhere"])["pdf"] == index.words.rows().where("term = 'pdf'").select("id").distinct().count()


def test_trigrams(spark, rows):
    r = random.Random(3)
    texts = ["".join(r.choices("abc de", k=r.randint(0, 30))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, None if i % 5 else t[::-1], "x") for i, t in enumerate(texts)] + [(500, None, None, None)], "id long, name string, summary string, term string")
    index = fuzzy.build(df, buckets=4)
    for q in ("abc", "bad cab", "dddd", "e", "zzz", "the"):
        wanted = fuzzy.trigrams_of(q)
        full = {i: fuzzy.likeness(wanted, fuzzy.trigrams_of(" ".join(x for x in (t, None if i % 5 else t[::-1]) if x is not None)), 0.5) for i, t in enumerate(texts)} if q != "the" else {}
        want = {i: round(s, 6) for i, s in full.items() if s >= 0.5}
        assert {r["id"]: r["similarity"] for r in fuzzy.find(index, q, limit=500, least=0.5).collect()} == want, q
        if q == "the":
            continue
        n = {i: len(set(wanted) & set(fuzzy.trigrams_of(" ".join(x for x in (t, None if i % 5 else t[::-1]) if x is not None)))) for i, t in enumerate(texts)}
        for needed in (1, 2, len(set(wanted))):
            got = {x["id"]: x["shared"] for x in fuzzy.sharing(index, sorted(set(wanted)), needed).collect()}
            assert got == {i: k for i, k in n.items() if k >= needed}, (q, needed)


def test_write_parts_a_long_list(spark):
    rows = spark.range(5000).select(F.lit("the").alias("term"), F.lit("the").alias("lead"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    try:
        index = postings.write(rows, "long", buckets=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.lookup(["the"]).count() == 5000 and index.lengths(["the"]) == {"the": 5000} and len(index.rows().inputFiles()) > 1
