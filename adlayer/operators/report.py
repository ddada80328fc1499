"""What plots and logs are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schemas import VACANT
from ..sources.placed import shared, write_placed
from .lattice import histogram
from .ordered import running_sums


def coverage_percent(rows: DataFrame, series: list[str]) -> DataFrame:
    """Coverage rows (event, sim_time, counts) with each count as a percentage of all sites, which the first row sums to, and the time in microseconds."""
    total = rows.agg(F.min_by(sum(F.col(s) for s in series), "event").alias("_total"))
    shares = rows.crossJoin(F.broadcast(total))  # one row
    return shares.select("event", (F.col("sim_time") * 1e6).alias("time_us"), *(X.percent(F.col(s), F.col("_total")).alias(s) for s in series))


def hex_layout(lattice: DataFrame, width: int, species: dict[int, str]) -> DataFrame:
    """(site_idx, x, y, label, is_corrupt): tile centres, with the species' name, vacant, or corrupt."""
    row, col = X.row_col(F.col("site_idx"), width)
    mask = sum(species)
    label = F.when(F.col("state") == VACANT, "vacant")
    for bit, name in species.items():
        label = label.when(F.col("state") == bit, name)
    corrupt = X.is_corrupt(F.col("state"), mask)
    return lattice.select("site_idx", X.hex_x(row, col).alias("x"), X.hex_y(row).alias("y"), label.otherwise("corrupt").alias("label"), corrupt.alias("is_corrupt"))


def summary(lattice: DataFrame, species: dict[int, str]) -> DataFrame:
    """(label, sites) of a lattice."""
    label = F.when(F.col("state") == VACANT, "vacant")
    for bit, name in species.items():
        label = label.when(F.col("state") == bit, name)
    return histogram(lattice).groupBy(label.otherwise("corrupt").alias("label")).agg(F.sum("sites").alias("sites"))


def write_coverage_csv(rows: DataFrame, path: str, parts: str = "auto") -> None:
    """One CSV file with a header, in the order of events; a row for each sample. Each task puts its lines at their own places.

    Where tasks can't write into one file, or with parts, a folder of CSV files in order.
    """
    if parts == "parts" or parts == "auto" and not shared(path):
        rows.repartitionByRange("event").sortWithinPartitions("event").write.mode("overwrite").csv(path, header=True)
        return
    head = (",".join(rows.columns) + "\n").encode()
    lines = rows.select("event", F.concat(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit("\n")).cast("binary").alias("data"))
    ends = running_sums(lines.withColumn("size", F.octet_length("data")), [], ["event"], {"end": "size"})
    size = len(head) + (ends.agg(F.max("end")).first()[0] or 0)
    at, none = F.col("end") - F.col("size"), F.lit([]).cast("array<double>")
    placed = ends.select((at + len(head)).cast("long").alias("at"), "data", at.cast("long").alias("first"), F.col("size").cast("long").alias("count"), none.alias("lows"), none.alias("highs"))
    write_placed(placed, path, head, size, size - len(head), layout="one")
