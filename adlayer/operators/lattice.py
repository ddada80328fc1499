"""Lattices as rows (site_idx, state): patches, neighbours, and counts of what reactions need.

A patch is a band of whole rows. Sites, neighbours and hash classes are
numbered within the patch, and pairs across its edge don't count.

Pairs of neighbours are found where the sites are: a task takes the rows of its
partition in blocks, looks each neighbour up in the block's arrays, and gives
out only what is open at the block's edges, which alone is shuffled and joined.
Where partitions hold runs of whole rows, as files and tables in the order of
sites do, that is a row of sites or two for each block; by_site() makes it so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import splitmix
from ..schemas import BUCKETS, MAX_SPECIES, VACANT
from ..staging import stage

PATCH_SEED = 0x5EED000000000000


def bands(height: int, patches: int) -> tuple[int, int]:
    """(rows of a band, bands): patches is at least 1 and at most height; there may be fewer bands than patches."""
    rows = -(-height // min(max(patches, 1), height))
    return rows, -(-height // rows)


def with_patches(lattice: DataFrame, width: int, height: int, patches: int = 1) -> DataFrame:
    """lattice with patch_id, and with site, row and col within the patch, and the patch's rows."""
    rows, _ = bands(height, patches)
    row, col = X.row_col(F.col("site_idx"), width)
    placed = lattice.withColumn("patch_id", F.floor(row / rows).cast("int")).withColumn("row", row - F.col("patch_id") * rows).withColumn("col", col)
    return placed.withColumn("site", F.col("row") * width + F.col("col")).withColumn("rows", F.least(F.lit(rows), F.lit(height) - F.col("patch_id") * rows).cast("long"))


def edges(placed: DataFrame, width: int, forward: bool = True) -> DataFrame:
    """(patch_id, a, ord, b): neighbouring sites; forward: each pair once."""
    near = X.neighbours(F.col("row"), F.col("col"), width, F.col("rows"), forward)
    return placed.select("patch_id", F.col("site").alias("a"), F.explode(near).alias("n")).select("patch_id", "a", F.col("n.ord").alias("ord"), F.col("n.site").alias("b"))


#: Sites of a block; where rows of sites are long, so many rows instead.
BLOCK, BLOCK_ROWS = 1 << 17, 16
#: The neighbours of a site by their order: rows down, columns right in even and in odd rows; those counted once for each pair.
_STEPS = [(0, -1, -1), (0, 1, 1), (-1, -1, 0), (-1, 0, 1), (1, -1, 0), (1, 0, 1)]
_FORWARD = (1, 4, 5)


def by_site(placed: DataFrame) -> DataFrame:
    """placed, dealt so that each partition has a run of sites."""
    return placed.repartitionByRange("patch_id", "site").sortWithinPartitions("patch_id", "site")


class _Block:
    """Sites of a partition, sorted; near(ord): where each site's neighbour stands, -1 outside the lattice, -2 outside the block."""

    def __init__(self, batches: list[pa.RecordBatch], width: int) -> None:
        take = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
        patch, site = take("patch_id").astype(np.int64), take("site").astype(np.int64)
        order = np.lexsort((site, patch))
        self.patch, self.site, self.width = patch[order], site[order], width
        self.state, self.rows = take("state").astype(np.int64)[order], take("rows").astype(np.int64)[order]
        self.number = np.cumsum(np.r_[0, self.patch[1:] != self.patch[:-1]])  # of the patch in the block
        self.base = self.number * (max(int((self.rows * width).max()), int(self.site.max())) + 1)

    def near(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(where, site) of the neighbour of that order."""
        down, even, odd = _STEPS[order]
        row, col = np.divmod(self.site, self.width)
        r, c = row + down, col + np.where(row % 2 == 1, odd, even)
        inside = (r >= 0) & (r < self.rows) & (c >= 0) & (c < self.width)
        to = np.where(inside, r * self.width + c, 0)
        key, wanted = self.base + self.site, self.base + to
        found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return np.where(inside, np.where(key[found] == wanted, found, -2), -1), to

    def open_sites(self, orders: tuple[int, ...]) -> np.ndarray:
        """Sites that have a neighbour of these orders outside the block."""
        return np.flatnonzero(np.logical_or.reduce([self.near(i)[0] == -2 for i in orders]))


_HALO = "patch_id long, kind long, site long, other long, x long, y long, n long"


def _blocks(width: int, inner):
    """Rows of _HALO from each block: what inner(block) gives, as columns of arrays."""

    most = max(BLOCK, BLOCK_ROWS * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            for columns in inner(_Block(held, width)):
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, len(columns[0])).astype(np.int64)) for x in columns], [c.split(" ")[0] for c in _HALO.split(", ")])

        for batch in batches:
            while batch.num_rows:  # a large batch is cut too
                part = batch.slice(0, most - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n >= most:
                    yield from done()
                    held, n = [], 0
        if held:
            yield from done()

    return run


def _halo(placed: DataFrame, width: int, inner) -> DataFrame:
    return placed.select("patch_id", "site", "state", "rows").mapInArrow(_blocks(width, inner), _HALO)


def _counted(block: _Block) -> Iterator[tuple]:
    """kind 0: pairs by patch and states (x, y); 1: pairs with a neighbour (other) that isn't there; 2: sites that others look for."""
    states, code = np.unique(block.state, return_inverse=True)
    first = np.unique(block.number, return_index=True)[1]  # of each patch
    for i in _FORWARD:
        at, to = block.near(i)
        known, lost = np.flatnonzero(at >= 0), np.flatnonzero(at == -2)
        a, b = code[known], code[at[known]]
        pair, n = np.unique((block.number[known] * len(states) + np.minimum(a, b)) * len(states) + np.maximum(a, b), return_counts=True)
        patch, low, high = pair // len(states) ** 2, pair // len(states) % len(states), pair % len(states)
        yield block.patch[first[patch]], 0, 0, 0, states[low], states[high], n
        yield block.patch[lost], 1, block.site[lost], to[lost], block.state[lost], 0, 1
    back = block.open_sites(tuple(i for i in range(len(_STEPS)) if i not in _FORWARD))
    yield block.patch[back], 2, block.site[back], 0, block.state[back], 0, 1


def pair_counts(placed: DataFrame, width: int) -> DataFrame:
    """(patch_id, low, high, n): neighbouring pairs by their two states."""
    halo = stage(_halo(placed, width, _counted), "halo")
    lost = halo.where("kind = 1").select("patch_id", F.col("other").alias("site"), "x")
    across = lost.join(halo.where("kind = 2").select("patch_id", "site", F.col("x").alias("y")), ["patch_id", "site"])
    low, high = X.canonical_pair(F.col("x"), F.col("y"))
    every = halo.where("kind = 0").select("patch_id", F.col("x").alias("low"), F.col("y").alias("high"), "n").unionByName(across.select("patch_id", low.alias("low"), high.alias("high"), F.lit(1).cast("long").alias("n")))
    sums = every.groupBy("patch_id", "low", "high").agg(F.sum("n").alias("n"))
    kinds = dict(placed.dtypes)
    return sums.select(F.col("patch_id").cast(kinds["patch_id"]), F.col("low").cast(kinds["state"]), F.col("high").cast(kinds["state"]), "n")


def template_pairs(reactions: DataFrame) -> DataFrame:
    """(low, high): the reactant pairs that two-site reactions name."""
    a, b = X.reactant_of(F.col("transition_a")), X.reactant_of(F.col("transition_b"))
    low, high = X.canonical_pair(a, b)
    return reactions.where("is_bimolecular").select(low.alias("low"), high.alias("high")).distinct()


def site_counts(placed: DataFrame, species: DataFrame) -> DataFrame:
    """(patch_id, bit, vacant, bucket, n): vacant sites by each species' hash class, occupied ones by their own species'.

    species: (bit), eight rows at most. Corrupt sites count nowhere.
    """
    known = [r["bit"] for r in species.select("bit").distinct().limit(MAX_SPECIES + 1).collect()]
    if len(known) > MAX_SPECIES:
        raise ValueError(f"a lattice has at most {MAX_SPECIES} species")
    bits = F.broadcast(species.select("bit").distinct())  # eight rows
    both = placed.join(bits, (F.col("state") == VACANT) | (F.col("state") == F.col("bit")))
    seeded = both.withColumn("_seed", F.lit(splitmix.signed(PATCH_SEED)).cast("long").bitwiseXOR(F.col("patch_id").cast("long")))
    hashed = splitmix.with_site_bucket(seeded, "bucket", F.col("site"), F.col("bit"), F.col("_seed"))
    return hashed.groupBy("patch_id", "bit", (F.col("state") == VACANT).alias("vacant"), "bucket").agg(F.count("*").alias("n"))


def live_counts(placed: DataFrame, width: int, reactions: DataFrame, species: DataFrame) -> DataFrame:
    """(patch_id, reaction columns, live): places in each patch where each reaction can happen; none is 0.

    One-site reactions take a hash class of a species' vacant or occupied
    sites, two-site ones a pair of neighbours.
    """
    a, b = X.reactant_of(F.col("transition_a")), X.reactant_of(F.col("transition_b"))
    low, high = X.canonical_pair(a, b)
    wanted = reactions.withColumn("_vacant", a == VACANT).withColumn("_bit", F.when(a == VACANT, X.product_of(F.col("transition_a"))).otherwise(a)).withColumn("_low", low).withColumn("_high", high)
    wanted = placed.select("patch_id").distinct().crossJoin(wanted)  # a row for each patch and reaction is the result
    sites = site_counts(placed, species).select("patch_id", F.col("bit").alias("_bit"), F.col("vacant").alias("_vacant"), F.col("bucket").alias("bin_id"), F.col("n").alias("_sites"))
    pairs = pair_counts(placed, width).select("patch_id", F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("n").alias("_pairs"))
    joined = wanted.join(sites, ["patch_id", "_bit", "_vacant", "bin_id"], "left").join(pairs, ["patch_id", "_low", "_high"], "left")
    live = F.when(F.col("is_bimolecular"), F.coalesce("_pairs", F.lit(0))).when(F.col("bin_id") < BUCKETS, F.coalesce("_sites", F.lit(0))).otherwise(0)
    return joined.select("patch_id", *reactions.columns, live.cast("long").alias("live"))


def propensities(live: DataFrame, pressures: dict[int, float] | None = None) -> DataFrame:
    """live_counts with weight: rate x live x pressure. pressures: by species bit, 1 by default."""
    a, pa, pb = X.reactant_of(F.col("transition_a")), X.product_of(F.col("transition_a")), X.product_of(F.col("transition_b"))
    of = F.lit(None).cast("double")
    for bit, p in (pressures or {}).items():
        of = F.when(pa == bit, F.lit(float(p))).otherwise(of)
    return live.withColumn("weight", F.col("rate_q16") * F.col("live") * X.pressure_factor(a, pa, pb, F.col("is_bimolecular"), of))


def _looked_for(state_a: int, state_b: int):
    """kind 0: a site in state_a, its first neighbour (other) in state_b within the block, and its order (n); 1: neighbours that aren't there; 2: sites in state_b that others look for."""

    def inner(block: _Block) -> Iterator[tuple]:
        own = block.state == state_a
        for i in range(len(_STEPS)):
            at, to = block.near(i)
            hit = np.flatnonzero(own & (at >= 0) & (block.state[at] == state_b))
            lost = np.flatnonzero(own & (at == -2))
            yield block.patch[hit], 0, block.site[hit], to[hit], 0, 0, i
            yield block.patch[lost], 1, block.site[lost], to[lost], 0, 0, i
            own = own & ~((at >= 0) & (block.state[at] == state_b))
        edge = block.open_sites(tuple(range(len(_STEPS))))
        edge = edge[block.state[edge] == state_b]
        yield block.patch[edge], 2, block.site[edge], 0, 0, 0, 0

    return inner


def pair_candidates(placed: DataFrame, width: int, state_a: int, state_b: int) -> DataFrame:
    """(patch_id, a, b): sites in state_a with their first neighbour, in neighbour order, in state_b."""
    halo = stage(_halo(placed, width, _looked_for(state_a, state_b)), "halo")
    there = halo.where("kind = 2").select("patch_id", F.col("site").alias("other"))
    across = halo.where("kind = 1").join(there, ["patch_id", "other"], "left_semi")
    every = halo.where("kind = 0").unionByName(across)
    found = every.groupBy("patch_id", F.col("site").alias("a")).agg(F.min_by("other", "n").alias("b"))
    return found.select(F.col("patch_id").cast(dict(placed.dtypes)["patch_id"]), "a", "b")


def histogram(lattice: DataFrame) -> DataFrame:
    return lattice.groupBy("state").agg(F.count("*").alias("sites"))


def corrupt_sites(lattice: DataFrame, mask: int) -> DataFrame:
    return lattice.where(X.is_corrupt(F.col("state"), mask))
