"""Embedding near-dedup as an exact metric range join.

Vectors are scaled to length one, where a cosine of at least c is a distance of at most
r = sqrt(2 - 2c). Pivots, far from one another, part the vectors into cells of the nearest pivot. By
the triangle inequality a vector can only have partners in another pivot's cell if its distance to
the bounding hyperplane of the two pivots is at most r; it is copied to such cells, and each cell
then joins independently. A cell is dealt out as blocks of its own rows against blocks of its own and
copied rows, so a crowded cell is many tasks of bounded size. Its rows are written once, one file a
block, in the shared folder, and the tasks read the blocks that they compare: what is written grows
with the vectors, and only comparing with their square. The folder may be any that Arrow's file systems
know (file, hdfs, s3, gs, abfs). Two blocks of own rows are compared once, for both. Exact copies are one
entry with a count, so a group of copies forms no pairs. A task reports, for each of its rows that
have links, with how many vectors, and a spanning forest of the links.

Most pairs are told apart by a bound in single precision: the product of the first coordinates along the
main axes of a task's rows, and of the lengths of the rests, is never less than the cosine. What may reach
the cosine by it is multiplied out in double precision, which decides.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows
without vec_id (component null, not kept). Vectors link with vectors of their own dimension only.
Rows that repeat a vec_id are judged each by its own vector; of equal ids
all rows whose id is the least of their component are kept. An empty table gives an empty
result; other columns aren't read, so they may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, delete_folder, discard, local_labels, materialize, shared_folder

COSINE, SAMPLE, BLOCK, MOST_PIVOTS = 0.9, 4096, 4096, 256
#: Blocks on either side of a task, at most, and their bytes in double precision.
SIDE, SIDE_BYTES = 8, 32 << 20
#: Rows on either side of a tile; products of a row whose greatest is looked at first; tiles whose links are counted together; links gathered before they are joined to groups.
TILE, RUN, TOGETHER, GATHERED = (512, 2048), 512, 4, 1 << 20
#: Cells that are parted once more, and rows of each that their pivots come from.
CROWDED, CELL_SAMPLE = 256, 256
#: Slack for rounding when rows are copied; the cosine itself decides about links.
_SLACK = 1e-6
#: Comparisons (of the sample's size) that moving a row costs as much as.
COPY = 20.0
#: Rows that a parting may make of one on the average: what is written is bounded, and blocks do the rest.
MOST_COPIES = 2


def usable(vectors: DataFrame) -> DataFrame:
    """vectors with a boolean column `usable`."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))


def scaled(vectors: DataFrame, *carried: str) -> DataFrame:
    """(vec_id, dim, unit binary, carried columns): usable vectors. `unit` holds the components in the precision that they came in;
    `matrix` scales them to length one, in double precision."""
    vectors = vectors.where("usable").select("vec_id", "embedding", *carried)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.list_value_length(lists)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            units = [x.tobytes() for x in np.split(flat, np.cumsum(sizes.to_numpy(zero_copy_only=False))[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), sizes.cast(pa.int32()), pa.array(units, pa.binary()), *(batch.column(c) for c in carried)], names=["vec_id", "dim", "unit", *carried])

    return vectors.mapInArrow(pack, ", ".join(["vec_id long, dim int, unit binary", *(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in carried)]))


def matrix(units, dim: int) -> np.ndarray:
    """Rows of length one from the components of vectors."""
    return unit_rows(b"".join(units), len(units), dim)


def unit_rows(data: bytes, count: int, dim: int) -> np.ndarray:
    x = np.frombuffer(data, np.float32 if len(data) == 4 * dim * count else np.float64).reshape(count, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def choose_pivots(sample: np.ndarray, radius: float, most: int = MOST_PIVOTS) -> np.ndarray:
    """Farthest-first choice: each pivot is the vector farthest from those before, until none is over two radii away."""
    chosen, far = [0], np.sqrt(np.maximum(0, 2 - 2 * sample @ sample[0]))
    while len(chosen) < most and far.max() > 2 * radius:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * sample @ sample[chosen[-1]])))
    return best_prefix(sample, sample[chosen], radius)


def best_prefix(sample: np.ndarray, pivots: np.ndarray, radius: float) -> np.ndarray:
    """As many of the pivots, in their order, as promise the least work: comparisons within cells,
    and `COPY` of them for each copied row. Vectors without clusters are all copied to all cells, where
    more pivots save nothing; then few remain and the blocks do the parting. So it is where a row would be copied `MOST_COPIES` times."""

    def work(count: int) -> float:
        row, cell, own = placements(sample, pivots[:count], radius)
        if len(row) > MOST_COPIES * len(sample):
            return np.inf
        inside = np.bincount(cell, minlength=count), np.bincount(cell[own], minlength=count)
        return float(inside[0] @ inside[1]) / len(sample) + COPY * len(row) / len(sample)

    return pivots[: min((c for c in (1, 2, 4, 8, 16, 32, 64, 128, MOST_PIVOTS) if c == 1 or c <= len(pivots)), key=work)]


def placements(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own cell) for all cells a row must be in."""
    squares = np.maximum(0, 2 - 2 * units @ pivots.T)
    home = squares.argmin(axis=1)
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    gap = squares - squares[np.arange(len(units)), home][:, None]
    row, cell = np.nonzero((gap <= 2 * between * (radius + _SLACK)) | (np.arange(len(pivots)) == home[:, None]))
    return row, cell, cell == home[row]


_PLACED = "dim int, cell int, own boolean, node long, n long, unit binary"


def _placed(rows: DataFrame, pivots: dict[tuple[int, int], np.ndarray], radius: float) -> DataFrame:
    """rows in all cells that they must be in, by the pivots of their (dim, cell) now; the cells of a
    cell are numbered anew. Rows of a cell without pivots stay there. A row is a cell's own only if it was before."""
    base, numbers = max((c for _, c in pivots), default=0) + 1, {}
    for key in sorted(pivots):
        numbers[key] = base
        base += len(pivots[key])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, g in batch.groupby(["dim", "cell"]):
                if key in pivots:
                    row, cell, own = placements(matrix(list(g["unit"]), key[0]), pivots[key], radius)
                    g = g.iloc[row]
                    g = g.assign(cell=cell + numbers[key], own=g["own"].to_numpy() & own)
                out.append(g)
            yield pd.concat(out) if out else batch

    return rows.mapInPandas(run, _PLACED)


def cells(distinct: DataFrame, radius: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows in their cells, (dim, cell, own_blocks, copy_blocks)): the latter a written table, and so the former unless all rows
    are in the cell of one pivot.

    Cells over a block are parted once more by pivots of their own, the `CROWDED` largest of them."""
    count = lambda t: t.groupBy("dim", "cell").agg(F.count("*").alias("rows"), F.count_if("own").alias("own_rows"))
    sample = distinct.orderBy(F.xxhash64("unit"), "node").limit(SAMPLE).select("dim", "unit").toPandas()  # SAMPLE rows
    pivots = {(int(d), 0): choose_pivots(matrix(list(g["unit"]), int(d)), radius) for d, g in sample.groupby("dim")}
    placed = distinct.select("dim", F.lit(0).alias("cell"), F.lit(True).alias("own"), "node", "n", "unit")
    if any(len(p) > 1 for p in pivots.values()):
        placed = materialize(_placed(placed, pivots, radius), "placed")
    if any(len(p) > 1 for p in pivots.values()):
        crowded = count(placed).where(F.col("own_rows") > block).orderBy(F.desc("own_rows"), "dim", "cell").limit(CROWDED).toPandas()  # CROWDED rows
        share = {(int(d), int(c)): min(1.0, 2 * CELL_SAMPLE / n) for d, c, n in zip(crowded["dim"], crowded["cell"], crowded["own_rows"], strict=True)}

        def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                part = np.array([share.get(k, 0.0) for k in zip(batch["dim"], batch["cell"], strict=True)])
                yield batch[batch["own"].to_numpy() & ((batch["node"].to_numpy() * 0x9E3779B1 % 65536) / 65536 < part)][["dim", "cell", "unit"]]

        if share:
            some = placed.mapInPandas(drawn, "dim int, cell int, unit binary").toPandas()  # about 2 CELL_SAMPLE rows a crowded cell
            finer = {(int(d), int(c)): choose_pivots(matrix(list(g["unit"])[:CELL_SAMPLE], int(d)), radius, 32) for (d, c), g in some.groupby(["dim", "cell"])}
            old, placed = placed, materialize(_placed(placed, {k: p for k, p in finer.items() if len(p) > 1}, radius), "placed")
            discard(old)
    blocks = lambda n: F.ceil(n / block).cast("int")
    return placed, materialize(count(placed).select("dim", "cell", blocks(F.col("own_rows")).alias("own_blocks"), blocks(F.col("rows") - F.col("own_rows")).alias("copy_blocks")), "cells")


def bound(x: np.ndarray, cosine: float) -> tuple[Callable[[np.ndarray], np.ndarray], float]:
    """(f, floor): rows a and b of length one with a cosine of at least `cosine` have f(a) @ f(b) >= floor. f gives narrow rows in
    single precision, as narrow as promises the least work on a part of x."""
    d = x.shape[1]
    axes = np.linalg.eigh(x[:SAMPLE].T @ x[:SAMPLE])[1][:, ::-1]
    some = x[:: max(1, len(x) // 512)][:512]
    rounding = lambda p: 1e-6 + 2e-7 * (p + 9)

    def narrow(rows: np.ndarray, p: int) -> np.ndarray:
        z = rows @ axes[:, :p]
        return np.column_stack([z, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", z, z)))]).astype(np.float32)

    def work(p: int) -> float:  # nanoseconds a pair: a product's, and what runs and pairs cost that are looked at again
        z = narrow(some, p)
        share = (np.count_nonzero(z @ z.T >= cosine - rounding(p)) - len(z)) / len(z) ** 2
        return 0.03 * p + 5 * min(1, RUN * share) + 150 * share

    p = min([*(p for p in (7, 11, 15, 19, 23, 31, 47, 63, 95, 127, 191, 255, 383, 511) if p < d), d], key=work)
    return lambda rows: narrow(rows, p), cosine - rounding(p)


def linked(x: np.ndarray, y: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, float], cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) that link, a tile at a time; bounds: what bound() gives for both, and its floor."""
    narrow_x, narrow_y, floor = bounds
    turned = np.zeros((narrow_y.shape[1], -(-len(y) // RUN) * RUN), np.float32)  # whole runs
    turned[:, : len(y)] = narrow_y.T
    room = np.empty(TILE, np.float32)
    for a in range(0, len(x), TILE[0]):
        for b in range(0, len(y), TILE[1]):
            p, q = narrow_x[a : a + TILE[0]], turned[:, b : b + TILE[1]]
            tile = np.matmul(p, q, out=room) if (len(p), q.shape[1]) == TILE else p @ q
            runs = tile.reshape(-1, RUN)
            some = np.flatnonzero(runs.max(axis=1) >= floor)
            if not len(some):
                continue
            i, j = np.nonzero(runs[some] >= floor)
            i, j = np.divmod(some[i] * RUN + j, q.shape[1])
            if len(i) > tile.size >> 5:  # so many that whole products cost less
                i, j = np.nonzero(x[a : a + TILE[0]] @ y[b : b + TILE[1]].T >= cosine)
                yield a + i, b + j
                continue
            real = b + j < len(y)
            i, j, most = a + i[real], b + j[real], max(1, (1 << 20) // x.shape[1])
            for k in range(0, len(i), most):
                u, v = i[k : k + most], j[k : k + most]
                sure = np.einsum("ij,ij->i", x[u], y[v]) >= cosine
                yield u[sure], v[sure]


class Links:
    """How many vectors each node links with, and which nodes links connect."""

    def __init__(self, *nodes: np.ndarray):
        self.nodes = np.unique(np.concatenate(nodes))
        self.counts, self.root = np.zeros(len(self.nodes), np.int64), np.arange(len(self.nodes))
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []
        self.gathered = 0

    def places(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, nodes)

    def add(self, i: np.ndarray, n: np.ndarray) -> None:
        """Nodes at the places i link with others that stand for n vectors each."""
        self.counts += np.rint(np.bincount(i, n, len(self.nodes))).astype(np.int64)

    def connect(self, i: np.ndarray, j: np.ndarray) -> None:
        new = self.root[i] != self.root[j]
        if new.any():
            self.ends.append((i[new], j[new]))
            self.gathered += len(self.ends[-1][0])
            if self.gathered > GATHERED:
                self.settle()

    def settle(self) -> None:
        if self.ends:
            a, b = (np.concatenate(x) for x in zip(*self.ends, strict=True))
            every = np.arange(len(self.nodes))
            self.root = local_labels(len(self.nodes), np.concatenate([every, a]), np.concatenate([self.root, b]))
            self.ends, self.gathered = [], 0

    def told(self) -> pd.DataFrame:
        self.settle()
        some = (self.counts > 0) | (self.root != np.arange(len(self.nodes)))
        return pd.DataFrame({"node": self.nodes[some], "linked": self.counts[some], "root": self.nodes[self.root[some]]})


_TOLD = "node long, linked long, root long"
#: Cells of more than two blocks are compared by many tasks. Cells without own rows report nothing.
_WHOLE, _CROWDED = "own_blocks > 0 and own_blocks + copy_blocks <= 2", "own_blocks > 0 and own_blocks + copy_blocks > 2"
#: Nodes, vectors that each stands for, rows of length one.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def compared(links: Links, x: Rows, y: Rows, narrow_x: np.ndarray, narrow_y: np.ndarray, floor: float, cosine: float, both: bool) -> None:
    """Links of x's nodes with y's; `both`: counted for y's nodes too."""
    at_x, at_y = links.places(x[0]), links.places(y[0])
    met: list[tuple[np.ndarray, np.ndarray]] = []

    def keep() -> None:
        i, j = (np.concatenate(side) for side in zip(*met, strict=True))
        links.add(at_x[i], y[1][j])
        if both:
            links.add(at_y[j], x[1][i])
        links.connect(at_x[i], at_y[j])
        met.clear()

    for pairs in linked(x[2], y[2], (narrow_x, narrow_y, floor), cosine):
        met.append(pairs)
        if len(met) >= TOGETHER:
            keep()
    if met:
        keep()


def _whole_cells(cosine: float):
    """Cells of two blocks at most are compared by one task each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        unit = matrix(list(rows["unit"]), int(rows["dim"].iloc[0]))
        node, n, own = rows["node"].to_numpy(), rows["n"].to_numpy(np.float64), rows["own"].to_numpy()
        links = Links(node)
        f, floor = bound(unit, cosine)
        narrow = f(unit)
        compared(links, (node[own], n[own], unit[own]), (node, n, unit), narrow[own], narrow, floor, cosine, False)
        return links.told()

    return run


def _write_block(folder: str):
    """One file a block: its nodes, the vectors each stands for, and their components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{path}/{name}") as out:
            for c in ("node", "n"):
                out.write(rows[c].to_numpy(np.int64).tobytes())
            for u in rows["unit"]:
                out.write(u)
        return rows[["dim", "cell", "own", "b"]].head(1).assign(name=name, rows=len(rows))

    return run


def _pairs(written: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The tasks and the written table that they are read from: (dim, cell, x, y, same, both): a row a task, x and y the names of blocks and their rows; `same`: x is y, `both`: y's rows are own ones, too."""
    # a sixteenth of a cell at most, so that there are tasks enough for all
    most = F.least(F.lit(SIDE), F.expr(f"{SIDE_BYTES} div (8l * {block} * dim)"), F.col("own_blocks") / 16)
    sides = written.withColumn("s", F.floor(F.col("b") / F.greatest(F.lit(1), F.floor(most)))).groupBy("dim", "cell", "own", "s").agg(F.sort_array(F.collect_list(F.struct("b", "name", "rows"))).alias("blocks"))
    sides = materialize(sides, "sides")
    left = sides.where("own").select("dim", "cell", F.col("s").alias("i"), F.col("blocks").alias("x"))
    right = sides.select("dim", "cell", "own", "s", F.col("blocks").alias("y"))
    met = left.join(right, ["dim", "cell"]).where("not own or s >= i")
    return met.select("dim", "cell", "x", "y", (F.col("own") & (F.col("s") == F.col("i"))).alias("same"), F.col("own").alias("both")), sides


def _block_pairs(folder: str, cosine: float):
    """Blocks of x are held, those of y read one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pa.fs.FileSystem.from_uri(folder)

        def nodes(block) -> np.ndarray:
            with store.open_input_file(f"{path}/{block['name']}") as f:
                return np.frombuffer(f.read(8 * block["rows"]), np.int64)

        def read(block, dim: int) -> Rows:
            with store.open_input_file(f"{path}/{block['name']}") as f:
                data, k = f.read(), block["rows"]
            return np.frombuffer(data, np.int64, k), np.frombuffer(data, np.int64, k, 8 * k).astype(np.float64), unit_rows(data[16 * k :], k, dim)

        for batch in batches:
            for t in batch.to_pylist():
                dim, same = t["dim"], t["same"]
                x = [read(b, dim) for b in t["x"]]
                f, floor = bound(np.concatenate([r[2][: max(1, SAMPLE // len(x))] for r in x]), cosine)
                narrow = [f(r[2]) for r in x]
                links = Links(*(r[0] for r in x), *(() if same else (nodes(b) for b in t["y"])))
                for k, b in enumerate(t["y"]):
                    y = x[k] if same else read(b, dim)
                    narrow_y = narrow[k] if same else f(y[2])
                    for m in range(k + 1 if same else len(x)):
                        compared(links, x[m], y, narrow[m], narrow_y, floor, cosine, t["both"] and not (same and m == k))
                yield pa.RecordBatch.from_pandas(links.told(), preserve_index=False)

    return run


def joined(distinct: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(links per node: node, linked), (edges a, b) of the exact range join."""
    spark = distinct.sparkSession
    placed, sizes = cells(distinct, float(np.sqrt(2 - 2 * cosine)), block)
    n_cells, crowded = sizes.agg(F.count("*"), F.sum(F.when(F.expr(_CROWDED), F.col("own_blocks") + F.col("copy_blocks")))).first()
    sized = placed.join(F.broadcast(sizes) if n_cells <= 1 << 16 else sizes, ["dim", "cell"])
    # so many parts, as few bytes may be much work: merging small parts would put many cells into one task
    small = sized.where(_WHOLE).select("dim", "cell", "own", "node", "n", "unit").repartition(max(1, min(4 * n_cells, 8192)), "dim", "cell")
    met = small.groupBy("dim", "cell").applyInPandas(_whole_cells(cosine), _TOLD)
    if crowded:
        folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        dealt = sized.where(_CROWDED).withColumn("b", F.pmod(F.xxhash64("node", "unit"), F.when(F.col("own"), F.col("own_blocks")).otherwise(F.col("copy_blocks"))).cast("int"))
        keys = ["dim", "cell", "own", "b"]
        written = dealt.select(*keys, "node", "n", "unit").repartition(min(4 * crowded, 8192), *keys).groupBy(*keys).applyInPandas(_write_block(folder), "dim int, cell int, own boolean, b int, name string, rows int")
        written = materialize(written, "blocks")
        pairs, sides = _pairs(written.join(sizes, ["dim", "cell"]), block)
        n_pairs = pairs.count()
        met = met.unionByName(pairs.repartition(min(n_pairs, 8192)).mapInArrow(_block_pairs(folder, cosine), _TOLD))
    met = materialize(met, "embedding-links")
    if crowded:
        delete_folder(spark, folder)
        discard(written, sides)
    discard(sizes, *(() if set(placed.inputFiles()) & set(distinct.inputFiles()) else (placed,)))
    return met.groupBy("node").agg(F.sum("linked").alias("linked")), met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a vector."""
    named = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    # equal vectors share 128 bits of hashes, by which narrow rows find their class again
    key = ["dim", "low", "high"]
    hashed = named.where("usable").select("vec_id", "embedding", "usable", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("low"), F.xxhash64(F.lit("high"), "embedding").alias("high"))
    each = hashed.groupBy(key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"), F.lit(True).alias("usable"))
    classes = scaled(each, "low", "high", "n").withColumnRenamed("vec_id", "first_id")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links, edges = joined(classes, cosine)
    rooted = materialize(classes.select("node", "first_id").join(components(edges), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")  # written: see components()
    met = rooted.join(least, "root").select("node", "component_id").join(links, "node").select("node", (F.col("linked") - 1).alias("n_links"), "component_id")
    told = materialize(classes.select(*key, "node").join(met, "node").drop("node"), "told")
    discard(rooted, least, classes)
    alone = named.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = hashed.select("vec_id", *key).join(told, key).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
