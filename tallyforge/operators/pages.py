"""What a detail page asks of the index: the package, its relatives, its other sources, its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_candidates(tail: Column) -> Column:
    """array<string>: the path a page address names, as written and as a skill's folder; + is no blank in a path."""
    plain = F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B")))
    return F.when(plain.isNull() | (plain == ""), F.array().cast("array<string>")).otherwise(F.array(plain, F.concat(plain, F.lit("/SKILL.md"))))


def detail(targets: DataFrame, packages: DataFrame, repositories: DataFrame, versions: DataFrame) -> DataFrame:
    """One row a target (target, full_name, tail) that names a package: the literal path before the
    folder's file, with its repository and newest version. A repository's name is matched in any case."""
    asked = targets.select("target", F.lower("full_name").alias("asked"), F.posexplode(path_candidates(F.col("tail"))).alias("nth", "source_path"))
    named = repositories.withColumn("asked", F.lower("full_name"))
    met = asked.join(named, "asked").join(packages, ["repository_id", "source_path"])
    one = met.groupBy("target").agg(F.min_by(F.struct("package_id", "full_name", "source_path"), F.struct("nth", "package_id")).alias("p")).select("target", "p.*")
    newest = versions.groupBy("package_id").agg(F.max_by("version", F.struct("ingested_at", "version")).alias("version"))
    return one.join(newest, "package_id", "left")


def related(packages: DataFrame, k: int = 12) -> DataFrame:
    """For each package (id, repository_id, parent_path, type, name) up to k others of its repository,
    siblings first, then by type, name in any case and id; with the numbers of all others and of all
    siblings. Packages without a parent have no siblings.

    No pairs of a repository's packages are formed: a package meets the first k + 1 siblings and the
    first 2 k + 1 of its repository, which hold its first k others."""
    place = F.struct(F.col("type").alias("t"), F.lower("name").alias("n"), F.col("id").alias("id"))
    placed = packages.withColumn("place", place)

    def first(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
        top = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where(F.col("nth") <= n)
        return top.groupBy(*keys).agg(F.sort_array(F.collect_list("place")).alias(name)).join(rows.groupBy(*keys).agg(F.count("*").alias(f"n_{name}")), keys)

    kin, home = first(placed.where("parent_path is not null"), ["repository_id", "parent_path"], k + 1, "near"), first(placed, ["repository_id"], 2 * k + 1, "far")
    met = placed.join(kin, ["repository_id", "parent_path"], "left").join(home, "repository_id")
    both = F.concat(F.coalesce("near", F.filter("far", lambda x: F.lit(False))), F.col("far"))
    listed = F.transform(F.slice(F.array_remove(F.array_distinct(both), F.col("place")), 1, k), lambda x: x["id"])
    return met.select("id", listed.alias("related"), (F.col("n_far") - 1).alias("total"), F.coalesce(F.col("n_near") - 1, F.lit(0)).alias("siblings"))


def other_sources(packages: DataFrame, k: int = 20) -> DataFrame:
    """For each package (id, content_hash, kin, stars) how many others have its content or are its
    variants, and the first k of them by stars, then id.

    The number is that of the two groups less their common part, and the first k are among the first
    k + 1 of either group: a group of copies forms no pairs."""
    order = lambda key: Window.partitionBy(key).orderBy(F.desc("stars"), "id")
    place = F.struct((-F.col("stars")).alias("s"), F.col("id").alias("id"))

    def first(key: str, name: str) -> DataFrame:
        top = packages.where(F.col(key).isNotNull()).withColumn("n", F.row_number().over(order(key))).where(F.col("n") <= k + 1)
        sizes = packages.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"n_{name}"))
        return top.groupBy(key).agg(F.collect_list(place).alias(name)).join(sizes, key)

    both = packages.where("content_hash is not null and kin is not null").groupBy("content_hash", "kin").agg(F.count("*").alias("n_both"))
    met = packages.join(first("content_hash", "copies"), "content_hash", "left").join(first("kin", "variants"), "kin", "left").join(both, ["content_hash", "kin"], "left")
    none = F.array().cast("array<struct<s:bigint,id:bigint>>")
    merged = F.transform(F.array_sort(F.array_distinct(F.concat(F.coalesce("copies", none), F.coalesce("variants", none)))), lambda x: x["id"])
    zero = F.lit(0)
    total = F.greatest(zero, F.coalesce("n_copies", zero) + F.coalesce("n_variants", zero) - F.coalesce("n_both", zero) - F.when(F.col("content_hash").isNotNull() | F.col("kin").isNotNull(), 1).otherwise(0))
    return met.select("id", total.alias("n_sources"), F.slice(F.array_remove(merged, F.col("id")), 1, k).alias("sources"))


def history(versions: DataFrame, k: int = 20) -> DataFrame:
    """The newest k versions (package_id, version, ingested_at) of each package, with their whole number."""
    total = versions.groupBy("package_id").agg(F.count("*").alias("total"))
    newest = Window.partitionBy("package_id").orderBy(F.desc("ingested_at"), F.desc("version"))
    return versions.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= k).join(total, "package_id")


def random_listed(rows: DataFrame, draw: float) -> DataFrame:
    """Of each type the first id from draw * greatest id on, else the first (draw below 1: always one)."""
    top = rows.groupBy("type").agg(F.max("id").alias("most"), F.min("id").alias("least"))
    from_here = rows.join(top, "type").where(F.col("id") >= F.floor(F.lit(draw) * F.col("most")))
    return top.join(from_here.groupBy("type").agg(F.min("id").alias("found")), "type", "left").select("type", F.coalesce("found", "least").alias("id"))


def cut_utf16(text: Column, most: int = 160) -> Column:
    """text, or its first `most` UTF-16 units and an ellipsis; half of a surrogate pair isn't kept."""
    wide = F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10ffff}]", ""))
    kept = F.substring(text, 1, most)
    spare = F.length(F.regexp_replace(kept, r"[^\x{10000}-\x{10ffff}]", ""))
    simple = F.concat(kept, F.lit("…"))
    fitting = F.filter(F.sequence(F.lit(most // 2), F.lit(most)), lambda n: n + F.length(F.regexp_replace(F.substr(text, F.lit(1), n), r"[^\x{10000}-\x{10ffff}]", "")) <= most)
    careful = F.concat(F.substr(text, F.lit(1), F.array_max(fitting)), F.lit("…"))
    return F.when(wide <= most, text).when(spare == 0, simple).otherwise(careful)


def first_of_distinct(rows: DataFrame, key: str, order: list[Column], read: int = 12, keep: int = 3) -> DataFrame:
    """Of the first `read` rows the first one of each key, `keep` in all. At most `read` rows reach the windows."""
    head = rows.orderBy(*order).limit(read).withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    return head.withColumn("again", F.row_number().over(Window.partitionBy(key).orderBy("nth"))).where("again = 1").orderBy("nth").limit(keep).drop("nth", "again")


def page_numbers(page: int, pages: int, reach: int = 2) -> list[int | None]:
    """Numbers of a page bar: the first, the last, those within reach; None stands for what is left out."""
    shown = sorted({1, pages, *range(max(1, page - reach), min(pages, page + reach) + 1)} & set(range(1, pages + 1)))
    out: list[int | None] = []
    for n in shown:
        if out and n > out[-1] + 1:
            out.append(None if n > out[-1] + 2 else n - 1)
        out.append(n)
    return out


def plugin_root(source_path: Column, shape_only: Column) -> Column:
    """The folder of a plugin: its path if only its shape tells of it, else what its manifest is in."""
    return F.when(shape_only, source_path).otherwise(F.regexp_replace(source_path, r"(\A|/)\.claude-plugin/plugin\.json\z", ""))


def encoded_path(path: Column) -> Column:
    """A path for an address: each segment percent-encoded, a blank as %20."""
    encoded = F.transform(F.split(path, "/"), lambda x: F.url_encode(x))
    # url_encode writes forms: + for a blank, and it encodes ! ' ( ) ~ which addresses keep
    keep = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    out = F.array_join(encoded, "/")
    for a, b in keep.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def permalink(full_name: Column, sha: Column, path: Column, line: Column) -> Column:
    """Address of a file at a commit, at a line if there is one."""
    base = F.concat(F.lit("https://github.com/"), full_name, F.lit("/blob/"), sha, F.lit("/"), encoded_path(path))
    return F.when(line.isNull(), base).otherwise(F.concat(base, F.lit("#L"), line.cast("string")))


def search_address(q: Column, types: Column, languages: Column, capabilities: Column, sort: Column, page: Column) -> Column:
    """The one address of a state of the search page: parameters in fixed order, defaults left out, of
    several types or languages the last."""
    pair = lambda name, value: F.concat(F.lit(f"{name}="), F.url_encode(value))
    last = lambda name, values: F.when(F.size(values) > 0, pair(name, F.element_at(values, -1)))
    asked = F.coalesce(q, F.lit("")) != ""
    usual = F.when(asked, "relevance").otherwise("recent")
    every = F.when(F.size(capabilities) > 0, F.array_join(F.transform(capabilities, lambda c: pair("cap", c)), "&"))
    sorted_ = F.when((F.coalesce(sort, F.lit("")) != "") & (sort != usual), pair("sort", sort))
    told = F.concat_ws("&", F.when(asked, pair("q", q)), last("type", types), last("lang", languages), every, sorted_, F.when(page > 1, pair("page", page.cast("string"))))
    return F.when(told == "", "/artifacts").otherwise(F.concat(F.lit("/artifacts?"), told))


def only_or_none(values: Column, value: Column) -> Column:
    """The filter behind a type's or language's link: that one alone, or none where it is set already."""
    return F.when(value.isNull() | F.array_contains(values, value), F.array().cast("array<string>")).otherwise(F.array(value))


def toggled(values: Column, value: Column) -> Column:
    """The filter behind a capability's link: it goes in or out, and the others stay."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


# What a reader is told of a description's class.
CLASS_LABELS = {"latin": "Latin alphabet", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "mixed": "Mixed languages", "other": "Other scripts", "unknown": "Unknown"}


def html_language(writing: Column) -> Column:
    """The language that a script names by itself, or null."""
    return F.when(writing.isin("zh", "ja", "ko"), writing)


def class_note(writing: Column) -> Column:
    """The label of a class that a reader of English wouldn't expect, or null."""
    return F.when(~writing.isin("latin", "unknown"), F.create_map(*[F.lit(x) for kv in CLASS_LABELS.items() for x in kv])[writing])


def report_lines(rows: DataFrame, width: int = 46) -> DataFrame:
    """(section, as_text, as_markdown) of a report's rows (section, title, position, label, value). Leading
    blanks of a label, two a level, are kept in the text and become dots in a table's cell, where marks of
    Markdown are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(c, r"([|\\`*_<>\[\]])", r"\\$1"), r"\s+", " ")
    label, value = F.col("label"), F.col("value")
    plain = F.concat(F.lit("  "), F.rpad(label, F.greatest(F.lit(width), F.length(label)), F.lit(" ")), value)
    level = F.floor((F.length(label) - F.length(F.ltrim(label))) / 2).cast("int")
    marked = F.concat(F.lit("| "), F.repeat(F.lit("· "), level), cell(F.trim(label)), F.lit(" | "), cell(value), F.lit(" |"))
    each = rows.groupBy("section", "title").agg(F.array_sort(F.collect_list(F.struct("position", plain.alias("t"), marked.alias("m")))).alias("r"))
    lines = lambda key: F.array_join(F.transform("r", lambda x: x[key]), "\n")
    return each.select("section", F.concat("title", F.lit("\n"), lines("t")).alias("as_text"), F.concat(F.lit("### "), cell(F.col("title")), F.lit("\n\n| | |\n|---|---|\n"), lines("m")).alias("as_markdown"))
