"""Global order: row numbers, edge order, locality order, sortedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import bloom_positions
from ..plans.lineage import cut


def numbered(df: DataFrame, *order: Column | str, name: str = "row", size: str | None = None) -> DataFrame:
    """Adds the place of each row in the order, from 0, without one task that sees all rows.

    Rows are dealt by ranges and written; each range numbers its own and starts after those before it. With a column
    ``size``, a row stands for as many rows that follow each other, and gets the place of the first.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    sizes = ranged.groupBy("_range").agg((F.sum(size) if size else F.count("*")).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sizes = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(*order)
    last = F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) if size else F.row_number().over(own)
    rows = ranged.withColumn("_last", last).join(F.broadcast(sizes), "_range")
    return rows.withColumn(name, F.col("_before") + F.col("_last") - (F.col(size) if size else F.lit(1))).drop("_range", "_last", "_before")


def sort_edges(edges: DataFrame) -> DataFrame:
    """Edges by source and target; each partition is a run of the order."""
    return edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")


#: Bits of a packed sort key.
KEY_BITS = 62


def source_keys(bits: int, levels: int = 3) -> list[Column]:
    """Sort keys that bring sources which share filter bits together.

    The bits of a source's filter are compared at growing fineness (their leading part first), then the ids.
    With as many levels as a position has bits, every prefix is a key. Positions are packed side by side into
    as few numbers as hold them, which lie in the order of the sorted lists of positions.
    """
    at = F.sort_array(bloom_positions(F.col("src"), bits))
    width = bits.bit_length() - 1
    keys, used = [], KEY_BITS
    for shift in sorted({width * (levels - i) // (levels + 1) for i in range(levels)}, reverse=True):
        for i in range(4):  # shifted positions lie in the order of the positions
            place, used = F.shiftright(at[i], shift).cast("long"), used + width - shift
            if used > KEY_BITS:
                keys, used = [*keys, place], width - shift
            else:
                keys[-1] = F.shiftleft(keys[-1], width - shift).bitwiseOR(place)
    return [*keys, F.col("src")]


def locality_keys(bits: int, levels: int = 3) -> list[Column]:
    """Sort keys for edges: sources that share filter bits lie together (see ``source_keys``), and the edges of a source by target."""
    return [*source_keys(bits, levels), F.col("dst")]


def locality_sort(edges: DataFrame, bits: int = 4096, levels: int = 3) -> DataFrame:
    keys = locality_keys(bits, levels)
    return edges.repartitionByRange(*keys).sortWithinPartitions(*keys)


def is_sorted(df: DataFrame, row: str, *order: str) -> DataFrame:
    """n, out_of_order: rows that are less than the one before them in the order of ``row``."""
    here = F.struct(*order)
    ahead = df.select((F.col(row) + 1).alias("_row"), here.alias("_before"))
    return df.join(ahead, df[row] == F.col("_row"), "left").agg(F.count("*").alias("n"), F.coalesce(F.sum((here < F.col("_before")).cast("int")), F.lit(0)).cast("long").alias("out_of_order"))
