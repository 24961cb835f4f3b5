"""What a package was seen not to do: absences that a reader can filter by, told once a package when an index is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import listing
from tallyforge.operators.trees import MOST_FILES

# Ids of the filters, the types whose absences can be told, and the findings that speak against them.
NO_NETWORK, NO_SHELL, NO_SCRIPTS = "no_network", "no_shell", "no_scripts"
CAPABILITIES = (NO_NETWORK, NO_SHELL, NO_SCRIPTS)
READ_TYPES, LISTED_TYPES = ("skill", "command"), ("skill", "plugin")
NETWORK, DECLARED, SHELL = "network_request", "declared", "bash"


def with_capabilities(packages: DataFrame, versions: DataFrame, findings: DataFrame, inventories: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """packages (id, type, ...) with `capabilities`, a sorted array of those absences that were observed.

    versions (id, version, ingested_at, analyzed_at), findings (version, category, signal), inventories (id, n_files, n_scripts).
    Only the newest version counts (ties: the greatest version), and only if it was analysed: of what nobody looked at nothing is
    known, so that it is in no filter. The same holds for packages without an inventory, or with one that its cap may have cut. A
    null category or signal speaks against nothing. Findings become two flags a version before they are shuffled."""
    told, category, signal = findings.select(F.col("version").alias("of"), "category", "signal"), F.col("category"), F.lower(F.coalesce("signal", F.lit("")))
    against = told.where(category.isin(NETWORK, DECLARED)).groupBy("of").agg(F.max(category == NETWORK).alias("network"), F.max((category == DECLARED) & signal.startswith(SHELL)).alias("shell"))
    newest = listing.latest(versions.select("id", "version", "ingested_at", F.col("analyzed_at").isNotNull().alias("analyzed")), "id", "ingested_at", "version")
    # one column each beside the package's own, under names it doesn't have
    seen, held = (next(n for n in (f"{c}{i}" for i in range(len(packages.columns) + 1)) if n not in packages.columns) for c in ("seen", "held"))
    read_of = newest.join(against, newest["version"] == against["of"], "left").select("id", F.struct("analyzed", "network", "shell").alias(seen))
    bare_of = inventories.select("id", F.struct(((F.col("n_files") < most) & (F.col("n_scripts") == 0)).alias("bare")).alias(held))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    read = F.col("type").isin(*READ_TYPES) & yes(f"{seen}.analyzed")
    cases: dict[str, Column] = {NO_NETWORK: read & ~yes(f"{seen}.network"), NO_SHELL: read & ~yes(f"{seen}.shell"), NO_SCRIPTS: F.col("type").isin(*LISTED_TYPES) & yes(f"{held}.bare")}
    shown = F.array_sort(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in cases.items()))))
    joined = packages.join(read_of, "id", "left").join(bare_of, "id", "left")
    return joined.select(*(c for c in packages.columns if c != "capabilities"), shown.alias("capabilities"))
