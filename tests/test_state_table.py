"""Scans merged into a table in buckets, against a dictionary; buckets that aren't touched keep their files."""

import os
import random

from pyspark.sql import functions as F

from tallyforge.sources.state_table import StateTable

SCHEMA = "repo string, path string, name string, content_hash string, parse_status string, created_at timestamp, updated_at timestamp, delisted_at timestamp, earlier array<string>"
BATCH = "repo string, path string, name string, content_hash string, parse_status string"


def moment(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp")


def files(folder):
    return {(b, f) for b in os.listdir(folder) if b.startswith("bucket=") for f in os.listdir(f"{folder}/{b}") if f.endswith(".parquet")}


def test_scans(spark, tmp_path):
    r, held, folder = random.Random(1), {}, f"{tmp_path}/state"
    table = StateTable(spark, folder, SCHEMA, "repo", ("path",), 8)
    table.create(spark.createDataFrame([], SCHEMA))
    os.makedirs(folder, exist_ok=True)
    for day in range(2, 9):
        repos = r.sample([f"r{i}" for i in range(6)] + [None], 5)
        seen = {(repo, f"p{r.randint(0, 4)}"): (f"n{day}", f"h{r.randint(0, 2)}", r.choice(["ok", "failed"])) for repo in repos[1:] for _ in range(4)}  # the first has nothing any more
        before = files(folder)
        got = table.apply(spark.createDataFrame([(*k, *v) for k, v in seen.items()], BATCH), spark.createDataFrame([(x,) for x in repos], "repo string"), moment(day))
        want = dict.fromkeys(["new", "updated", "unchanged", "reverted", "removed"], 0) | {"parse_failed": sum(v[2] == "failed" for v in seen.values())}
        for key, (name, content, status) in seen.items():
            old = held.get(key)
            kind = "new" if old is None else "unchanged" if old["content"] == content else "reverted" if content in old["earlier"] else "updated"
            want[kind] += 1
            earlier = set() if old is None else old["earlier"] | ({old["content"]} if old["content"] != content else set())
            held[key] = {"name": name, "content": content, "status": status, "created": old["created"] if old else day, "updated": old["updated"] if kind == "unchanged" else day, "gone": None, "earlier": earlier}
        for key, row in held.items():
            if key[0] in repos and key not in seen and row["gone"] is None:
                row["gone"] = day
                want["removed"] += 1
        assert got == want
        rows = {(x["repo"], x["path"]): x for x in table.rows().collect()}
        day_of = lambda t: t and t.day
        assert {k: (x["name"], x["content_hash"], day_of(x["created_at"]), day_of(x["updated_at"]), day_of(x["delisted_at"]), set(x["earlier"])) for k, x in rows.items()} == {k: (v["name"], v["content"], v["created"], v["updated"], v["gone"], v["earlier"]) for k, v in held.items()}
        touched = {f"bucket={x['bucket']}" for x in spark.createDataFrame([(x,) for x in repos], "repo string").select(table.bucket().alias("bucket")).collect()}
        assert {f for f in before if f[0] not in touched} == {f for f in files(folder) if f[0] not in touched}
    assert sum(v["gone"] is not None for v in held.values()) and any(len(v["earlier"]) > 1 for v in held.values())
    table.reset()
    assert not os.path.exists(folder)
