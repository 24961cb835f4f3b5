"""Captured pages in batch, as a stream, and gone on with after a stop."""

import json
from urllib.parse import quote

import pytest

from tallyforge.sources import registry_pages
from tallyforge.streaming import attempts


def server(name, url="https://github.com/o/r", when="2024-01-05T00:00:00Z"):
    return {"server": {"name": name, "repository": {"url": url} if url else {}}, "_meta": {"x/official": {"updatedAt": when}}}


@pytest.fixture()
def folder(tmp_path):
    bodies, cursors = [], ["", *(f"a/b:{k} %" for k in range(1, 45))]
    for k in range(45):
        entries = [server(f"n{k}"), server(f"twice{k % 2}", f"https://github.com/o/{k}", f"2024-01-{1 + k % 28:02d}T00:00:00Z"), server("bare", None), {"server": {"repository": "x"}}, 7]
        bodies.append({"servers": entries, "metadata": {"nextCursor": cursors[k + 1]} if k < 44 else {}})
    for c, b in zip(cursors, bodies):
        text = json.dumps(b)
        (tmp_path / f"{quote(c, safe='') or 'start'}.json").write_text(text.replace("n3\"", "n3\u0001\"") if '"n3"' in text else text)
    return str(tmp_path)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batch_and_stream_agree(spark, folder, tmp_path):
    batch = registry_pages.pages(spark, folder)
    assert batch.rdd.getNumPartitions() == 3 and batch.count() == 45 * 6
    streamed = attempts.run_to_end(registry_pages.stream(spark, folder, "2024-01-01"), ["page", "entry"], "append")
    assert plain(streamed) == plain(batch)
    # a sweep cut into stretches takes each page once
    first = registry_pages.pages(spark, folder, most_pages=17)
    after = first.where("entry = -1").orderBy("page", ascending=False).first()
    rest = registry_pages.pages(spark, folder, after["next_cursor"], after["page"] + 1)
    assert plain(first.unionByName(rest)) == plain(batch)


def test_a_stopped_stream_goes_on(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sweep"))

    def run():
        registry_pages.stream(spark, folder, most_pages=20).writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").format("parquet").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()

    taken = []
    for _ in range(4):  # stopped after each batch
        run()
        taken.append(spark.read.parquet(f"{at}/out").where("entry = -1").count())
    assert taken == [20, 40, 45, 45] and plain(spark.read.parquet(f"{at}/out")) == plain(registry_pages.pages(spark, folder))


def test_sweeps(spark, folder):
    every = registry_pages.pages(spark, folder)
    assert registry_pages.sweep(every, "2024-01-20T00:00:00Z", "2023").first().asDict() == {
        "n_pages": 45, "n_valid": 90, "n_invalid": 90, "n_no_repository": 45, "n_sanitized": 1, "stopped_by": "exhausted", "next_cursor": None, "watermark": "2024-01-20T00:00:00Z",
    }
    some = registry_pages.pages(spark, folder, most_pages=4)
    got = registry_pages.sweep(some, "2024-01-20T00:00:00Z", "2023").first()
    assert (got["stopped_by"], got["watermark"], got["n_pages"]) == ("page_cap", "2023", 4)
    got = registry_pages.sweep(every, "2024-01-20T00:00:00Z", "2023", most_seeds=7).first()
    assert (got["stopped_by"], got["watermark"], got["n_pages"], got["n_valid"]) == ("seed_cap", "2023", 4, 8)
    named = {r["name"]: r["repository"] for r in registry_pages.seeds(every).collect()}
    assert len(named) == 47 and named["twice0"] == "https://github.com/o/44" and len(registry_pages.seeds(every, 7).collect()) == 6
    with open(f"{folder}/start.json", "w") as f:
        f.write("{broken")
    got = registry_pages.sweep(registry_pages.pages(spark, folder), "2024-01-20T00:00:00Z", "2023").first()
    assert (got["stopped_by"], got["watermark"], got["n_pages"]) == ("parse_failure", "2023", 1)
    with open(f"{folder}/start.json", "w") as f:
        f.write('{"servers": []}')
    got = registry_pages.sweep(registry_pages.pages(spark, folder), "2024-01-20T00:00:00Z", "2023").first()
    assert (got["stopped_by"], got["watermark"]) == ("exhausted", "2024-01-20T00:00:00Z")
