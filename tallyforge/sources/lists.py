"""Seeds from an operator's list and from curated Markdown lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T

# Fixed value: how many repositories one Markdown list may name.
MOST_LINKS = 1000


def full_name(written: Column) -> Column:
    """owner/name as written, lower-cased and without `.git`; null if it isn't one."""
    cut = F.regexp_replace(F.trim(written), r"\.git\z", "")
    shape = r"\A[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})/[A-Za-z0-9._-]{1,100}\z"
    return F.when(~written.rlike(r"[\r\n]") & (F.length(F.trim(written)) <= 200) & cut.rlike(shape), F.lower(cut))


def operator_seeds(files: DataFrame, key: str = "seeds") -> DataFrame:
    """(file, position, full_name, note, path) of files (file, body), JSON objects with lists `seeds` and
    `linkLists`; their order is kept, other keys count for nothing. A name that isn't owner/name is an
    error: the list is written by hand, so a slip must not pass."""
    listed = F.from_json(F.get_json_object("body", f"$.{key}"), "array<struct<fullName:string,note:string,path:string>>")
    rows = files.select("file", F.posexplode(listed).alias("position", "s"))
    name = F.coalesce(full_name(F.col("s.fullName")), F.raise_error(F.concat(F.col("file"), F.lit(": no owner/name: "), F.coalesce(F.col("s.fullName"), F.lit("nothing")))))
    return rows.select("file", "position", name.alias("full_name"), F.col("s.note").alias("note"), F.col("s.path").alias("path"))


def linked_seeds(lists: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(full_name, discovered_from, discovered_path, position) of lists (full_name, path, markdown): each
    repository that a list names once, in the order of first mention, the list itself left out. Lists
    without a text or a proper name give none; what is over `most` in a list is counted by overflow()."""
    return _placed(lists).where(F.col("position") <= most).where("full_name <> discovered_from").select("full_name", "discovered_from", "discovered_path", "position")


def overflow(lists: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(discovered_from, discovered_path, n, overflow) of each list that names any repository."""
    per = _placed(lists).groupBy("discovered_from", "discovered_path").agg(F.count("*").alias("n"))
    return per.withColumn("overflow", F.greatest(F.col("n") - most, F.lit(0).cast("long")))


def _placed(lists: DataFrame) -> DataFrame:
    named = F.array_distinct(F.array_compact(F.transform(T.links(F.col("markdown")), T.repository_of)))
    home = full_name(F.col("full_name"))
    rows = lists.where(home.isNotNull()).select(home.alias("discovered_from"), F.concat("path", F.lit("@HEAD")).alias("discovered_path"), F.posexplode(named).alias("position", "full_name"))
    return rows.withColumn("position", F.col("position") + 1)


def first_seen(found: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """found with one row a key, the first in `order` among all sources."""
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("r")).select(key, "r.*").select(found.columns)
