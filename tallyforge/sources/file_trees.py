"""Captured file trees: folders <owner>/<repository>/<commit>/<path> on any store that Spark reads, as rows.

Trees are listed without opening a file (`binaryFile` reads no content that isn't asked for), and a body is read only if
its length, known from the listing, is within the cap. File sources pass over names that begin with a dot or an underscore, so a
capture writes these, like % itself, percent-encoded (%2Eclaude/agents/x.md), and names are decoded here. Commits that aren't 40 hexadecimal digits are set apart, not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import artifacts, ingest, manifests, trees

#: Bytes of a body.
LONGEST_BODY = 1 << 20
#: Three folders, each perhaps named as in column=value, and the rest.
LAYOUT = r"\A/?(?:\w+=)?([^/]+)/(?:\w+=)?([^/]+)/(?:\w+=)?([^/]+)/(.+)\z"
KEY = ["repo", "sha"]


def _files(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """(file, length, content, owner/repository, sha, path) of every file below root."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    inner = F.substring(F.regexp_replace("path", r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""), F.lit(len(at) + 1), F.length("path"))
    part = lambda k: F.url_decode(F.replace(F.regexp_extract(inner, LAYOUT, k), F.lit("+"), F.lit("%2B")))
    return read.where(inner.rlike(LAYOUT)).select(F.col("path").alias("file"), "length", "content", F.concat(part(1), F.lit("/"), part(2)).alias("repo"), part(3).alias("sha"), part(4).alias("path"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(file, length, repo, sha, path, readable): every file; `readable` where the commit is one."""
    return _files(spark, root).drop("content").withColumn("readable", F.col("sha").rlike(r"\A[0-9a-f]{40}\z"))


def bounded(files: DataFrame, most: int = ingest.MOST_ENTRIES, depth: int = ingest.MOST_DEPTH) -> DataFrame:
    """The readable files with their `position` in the order of paths: the first `most` of a tree, and of those none deeper than
    `depth`. `truncated` tells that the tree holds more than `most`."""
    tree = Window.partitionBy(*KEY)
    placed = files.where("readable").withColumn("position", (F.row_number().over(tree.orderBy("path")) - 1).cast("long")).where(F.col("position") <= most)
    counted = placed.withColumn("truncated", F.max("position").over(tree) == most)
    return counted.where((F.col("position") < most) & (F.size(F.split("path", "/")) <= depth))


def bodies(spark: SparkSession, root: str, needs: DataFrame, most: int = LONGEST_BODY, names: str = "*") -> DataFrame:
    """needs (file, length, status, ...) with `body` where the status is `read`; files over `most` bytes get the status `too large`
    and are never opened. Bytes that aren't UTF-8 and NUL become U+FFFD."""
    told = needs.withColumn("status", F.when((F.col("status") == "read") & (F.col("length") > most), "too large").otherwise(F.col("status")))
    held = _files(spark, root, names).where(F.col("length") <= most).select("file", F.translate(F.make_valid_utf8(F.col("content").cast("string")), "\x00", "�").alias("body"))
    return told.join(held.join(told.where("status = 'read'").select("file"), "file", "left_semi"), "file", "left")


def scan(spark: SparkSession, root: str, known: DataFrame | None = None, most_files: int = ingest.MOST_FILES, most: int = LONGEST_BODY) -> DataFrame:
    """From folders to artifacts: (repo, sha, path, type, status, truncated, body) of what each tree's shape makes an artifact.

    Trees whose commit is `known` (repo, sha, partial) from a whole read aren't read again. The first `most_files` needs of a tree, the
    detectors taking turns, are read; the rest are `skipped`, which makes the scan partial."""
    tree = bounded(listing(spark, root))
    if known is not None:
        tree = tree.join(ingest.changed_only(tree.select(*KEY).distinct(), known).select(*KEY), KEY, "left_semi")
    one = F.concat_ws("@", "repo", "sha")  # a tree is a repository at a commit
    named = tree.withColumn("tree", one)
    found = trees.detected(named.select(F.col("tree").alias("repo"), "path")).select(F.col("repo").alias("tree"), "path", "type")
    wanted = found.join(named, ["tree", "path"]).select("*", F.col("type").alias("detector"))
    turns = trees.round_robin(wanted.drop("repo").withColumnRenamed("tree", "repo"), 1 << 30).select(F.col("repo").alias("tree"), "path", "type", "file", "length", "sha", "truncated", F.col("place").alias("position"))
    needs = ingest.needed_files(turns.withColumnRenamed("tree", "repo"), most_files)
    read = bodies(spark, root, needs, most)
    return read.select(F.regexp_extract("repo", r"\A(.*)@[^@]*\z", 1).alias("repo"), "sha", "path", "type", "status", "truncated", "body")


def parsed(found: DataFrame) -> DataFrame:
    """(repo, sha, path, type, name, description, parse_status) of scan() rows that were read; `none` rows are no artifacts."""
    at = ["repo", "sha", "path", "type"]
    read = found.where("status = 'read'").select(*at, "body")
    shown = lambda rows: rows.select(*at, "name", "description", "parse_status")
    matter = lambda kind: manifests.front_matter(read.where(F.col("type") == kind))
    objects = manifests.json_manifest(read.where(F.col("type").isin("plugin", "mcp_server", "catalog", "hook")))
    servers = artifacts.server_manifests(objects.where("type = 'mcp_server'")).withColumn("description", F.lit(None).cast("string"))
    out = shown(artifacts.skills(matter("skill"))).unionByName(shown(artifacts.commands(matter("command")))).unionByName(shown(artifacts.agents(matter("agent"))))
    return out.unionByName(shown(artifacts.plugins(objects.where("type = 'plugin'")))).unionByName(shown(servers)).where("parse_status <> 'none'")
