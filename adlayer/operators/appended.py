"""Coverage of a log that grows: what stands at its end is kept, and new events cost their own number.

Kept are the lattice after the last event, how many events there were, the last
time, and the coverage rows so far. An append replays its events from that
lattice and adds rows at the places where samples of the whole log are due; it
reads the kept lattice, and no event of old. The coverage at any sample is then
a lookup.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VACANT
from ..staging import stage
from .ordered import numbered, running_sums
from .replay import final_lattice, states


class Coverage:
    """The log's coverage in the folder path; species: (name, bit); bits: all that may occur."""

    def __init__(self, spark: SparkSession, path: str, species: list[tuple[str, int]], sites: int, every: int, bits: list[int] | None = None) -> None:
        self.spark, self.path, self.species, self.sites, self.every = spark, path, species, sites, every
        self.bits = bits or [b for _, b in species]
        self.wanted = [("vacant", VACANT), *species]
        self.names = [n for n, _ in self.wanted]

    def _kept(self) -> dict:
        """What stands at the end: the last append's row; nothing before the first."""
        try:
            rows = self.spark.read.schema("version int, kept string").json(f"{self.path}/versions")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = None
        last = rows.orderBy(F.desc("version")).first() if rows is not None else None  # a row for each append
        if last is None:
            return {"version": 0, "events": 0, "time": None, "counts": [self.sites if s == VACANT else 0 for _, s in self.wanted], "lattice": None, "rows": []}
        return json.loads(last["kept"]) | {"version": last["version"]}

    def append(self, events: DataFrame) -> None:
        """Adds events (ord, sim_time, site_idx, transition), none of which may be earlier than the last of before; of equal times they come later."""
        kept = self._kept()
        placed = stage(numbered(events.select("ord", "sim_time", "site_idx", "transition"), ["sim_time", "ord"]), "placed")
        ends = placed.agg(F.count("*").alias("n"), F.min("sim_time").alias("first"), F.max("sim_time").alias("last")).first()
        if not ends["n"]:
            return
        if kept["time"] is not None and ends["first"] < kept["time"]:
            raise ValueError(f"an event of time {ends['first']} comes after the log has come to {kept['time']}")
        placed = placed.withColumn("n", F.col("n") + kept["events"])
        inside = placed.where((F.col("site_idx") >= 0) & (F.col("site_idx") < self.sites))
        initial = self.spark.read.parquet(kept["lattice"]) if kept["lattice"] else None
        replayed = stage(states(inside, ["n"], self.bits, initial), "replayed")
        change = lambda s: (F.col("state_after") == s).cast("long") - (F.col("state_before") == s).cast("long")
        sample = F.ceil(F.col("n") / self.every).cast("long")
        deltas = replayed.groupBy(sample.alias("sample")).agg(*(F.sum(change(s)).alias(f"_{n}") for n, s in self.wanted))
        due = placed.groupBy(sample.alias("sample")).agg(F.max("n").alias("event"), F.max_by("sim_time", "n").alias("sim_time"))
        rows = due.join(deltas, "sample", "left").fillna(0, [f"_{n}" for n in self.names])
        summed = running_sums(rows, [], ["sample"], {n: f"_{n}" for n in self.names})
        counts = [(F.col(n) + c).cast("long").alias(n) for n, c in zip(self.names, kept["counts"])]
        name = uuid.uuid4().hex
        summed.select("event", "sim_time", *counts).write.parquet(f"{self.path}/rows/{name}")
        own = final_lattice(replayed, ["n"])
        if initial is not None:
            own = own.unionByName(initial.join(own, "site_idx", "left_anti"))
        own.write.parquet(f"{self.path}/lattice/{name}")
        end = self.spark.read.parquet(f"{self.path}/rows/{name}").orderBy(F.desc("event")).first()
        # a sample that isn't full is given again, fuller, by the next append
        stated = {"events": kept["events"] + ends["n"], "time": ends["last"], "counts": [end[n] for n in self.names], "lattice": f"{self.path}/lattice/{name}", "rows": [*kept["rows"], f"{self.path}/rows/{name}"]}
        self.spark.range(1).select(F.lit(kept["version"] + 1).alias("version"), F.lit(json.dumps(stated)).alias("kept")).write.mode("append").json(f"{self.path}/versions")

    def rows(self) -> DataFrame:
        """(event, sim_time, vacant, species..., other) at the start, after each `every` events and after the last."""
        kept = self._kept()
        start = self.spark.range(1).select(F.lit(0).cast("long").alias("event"), F.lit(0.0).alias("sim_time"), *(F.lit(self.sites if s == VACANT else 0).cast("long").alias(n) for n, s in self.wanted))
        found = start
        if kept["rows"]:
            full = (F.col("event") % self.every == 0) | (F.col("event") == kept["events"])
            found = start.unionByName(self.spark.read.parquet(*kept["rows"]).where(full))
        return found.withColumn("other", F.lit(self.sites).cast("long") - sum(F.col(n) for n in self.names))

    def at(self, event: int) -> DataFrame:
        """The row of the last sample up to an event."""
        return self.rows().where(F.col("event") <= event).orderBy(F.desc("event")).limit(1)
