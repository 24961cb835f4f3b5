"""Observed absences on rows chosen by hand."""

from tallyforge.operators import capabilities, indexed_search, search


def test_capabilities(spark):
    packages = spark.createDataFrame([(1, "skill", 5), (2, "command", 5), (3, "agent", 5), (4, "plugin", 5), (5, "skill", 5), (6, "skill", 5), (7, None, 5), (8, "skill", 5)], "id long, type string, _network int")
    day = "2024-01-0{} 00:00:00".format
    versions = spark.createDataFrame(
        [(1, 10, day(1), day(1)), (1, 11, day(2), day(2)), (2, 20, day(1), day(1)), (3, 30, day(1), day(1)), (5, 50, day(1), day(1)), (5, 51, day(2), None), (6, 60, day(1), day(1)), (6, 61, day(1), day(1)), (7, 70, day(1), day(1))],
        "id long, version long, ingested_at string, analyzed_at string",
    )
    findings = spark.createDataFrame([(10, "network_request", "curl"), (11, "declared", "Read"), (20, "declared", "bash(git *)"), (20, "declared", None), (20, None, "Bash"), (61, "network_request", None), (60, "declared", "Bash"), (99, "declared", "Bash")], "version long, category string, signal string")
    inventories = spark.createDataFrame([(1, 199, 0), (2, 1, 0), (4, 200, 0), (5, 3, 1), (6, 0, 0), (7, 1, 0), (8, None, None)], "id long, n_files int, n_scripts int")
    told = capabilities.with_capabilities(packages, versions, findings, inventories)
    assert told.columns == ["id", "type", "_network", "capabilities"]
    assert {r["id"]: r["capabilities"] for r in told.collect()} == {
        1: ["no_network", "no_scripts", "no_shell"],  # the older version's request doesn't count
        2: ["no_network"],
        3: [],  # a type that isn't read
        4: [],  # as many files as are listed at most
        5: [],  # the newest version wasn't analysed; a script
        6: ["no_scripts", "no_shell"],  # of one time the greater version counts
        7: [],
        8: [],
    }
    assert {r["id"]: r["capabilities"] for r in capabilities.with_capabilities(packages, versions.limit(0), findings.limit(0), inventories.limit(0)).collect()} == dict.fromkeys(range(1, 9), [])


def test_filtered_search(spark):
    rows = spark.createDataFrame(
        [(1, "o/a", "skill", "pdf", "reads files", "a", None, ["no_network"]), (2, "o/b", "skill", "pdf-tools", "tools", "b", None, []), (3, "o/c", "plugin", "pdf", "makes", "c", "zh", ["no_network", "no_scripts"])],
        "id long, repository string, type string, name string, summary string, path string, language string, capabilities array<string>",
    )
    index = indexed_search.build(rows, 4)
    ids = lambda q, **k: [r["id"] for r in indexed_search.find(index, q, filters=search.Filters(**k)).collect()]
    assert ids("pdf", capabilities=["no_network"]) == [3, 1] and ids("pdf", capabilities=["no_network", "no_scripts"]) == [3]
    assert ids("tools", capabilities=["no_network"]) == [] and set(ids("pdf", capabilities=["unheard"])) == {1, 2, 3}
    # no row within the filter has both words, so that any will do
    assert ids("pdf tools", capabilities=["no_network"]) == [3, 1]
    assert ids(None) == [3, 2, 1] and ids(None, hidden=["zh"], capabilities=["no_network"]) == [1] and ids("the and") == ids("") == []
    n = lambda q, **k: indexed_search.count(index, q, filters=search.Filters(**k)).first()["n"]
    assert n(None) == 3 and n("") == 0 and n("pdf", capabilities=["no_scripts"]) == 1 and n(None, types=[]) == 0
