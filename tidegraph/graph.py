"""A graph: an edge list and its vertices, isolated ones included."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.lineage import counted, cut


#: Edges of a source from which on it is a hub, and edges of each part that a hub's are dealt over. Hubs whose list may be broadcast.
HUB, BROADCAST_HUBS = 100_000, 1_000_000


@dataclass(frozen=True)
class GraphMeta:
    """What a graph is, counted from its data."""

    name: str
    weighted: bool
    n_vertices: int
    n_edges: int


class Graph:
    """``edges``: src, dst and maybe weight; ``vertices``: id. Without vertices, the ends of the edges are taken."""

    #: Whether every edge is known to be there in both directions.
    symmetric = False

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, name: str = "graph"):
        columns = [F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")]
        self.weighted = "weight" in edges.columns
        if self.weighted:
            columns.append(F.col("weight").cast("double").alias("weight"))
        self.edges = edges.select(*columns)
        if vertices is None:
            vertices = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        self.vertices = vertices.select(F.col("id").cast("long").alias("id"))
        self.name = name

    @classmethod
    def from_parquet(cls, spark: SparkSession, edges: str, vertices: str | None = None, name: str = "graph") -> "Graph":
        return cls(spark.read.parquet(edges), spark.read.parquet(vertices) if vertices else None, name)

    @classmethod
    def dense(cls, edges: DataFrame, n_vertices: int, name: str = "graph") -> "Graph":
        """Ids 0 to n - 1 are the vertices, named by an edge or not."""
        return cls(edges, edges.sparkSession.range(n_vertices), name)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def meta(self) -> GraphMeta:
        return GraphMeta(self.name, self.weighted, self.vertices.count(), self.edges.count())

    def with_edges(self, edges: DataFrame) -> "Graph":
        return Graph(edges, self.vertices, self.name)

    def unweighted(self) -> "Graph":
        out = self.with_edges(self.edges.select("src", "dst"))
        out.symmetric = self.symmetric
        return out

    def need_weights(self, what: str) -> None:
        if not self.weighted:
            raise ValueError(f"{what} needs a weight for every edge")

    def symmetrize(self) -> "Graph":
        """Both directions of every edge, each once; of repeated ones the least weight."""
        keys = ["src", "dst"]
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if self.weighted else []))
        both = self.edges.unionByName(back)
        out = self.with_edges(both.groupBy(*keys).agg(F.min("weight").alias("weight")) if self.weighted else both.distinct())
        out.symmetric = True
        return out

    def reverse(self) -> "Graph":
        return self.with_edges(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if self.weighted else [])))

    def by_source(self) -> DataFrame:
        """Edges dealt by ``src`` and cached in its order: joins of an iteration shuffle only what joins them, and a filter on ``src`` passes over batches."""
        return self.edges.repartition("src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)

    def vertex_cut(self, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
        """Edges (src, dst, part) dealt by source and part and cached, and vertices (id, deg, parts).

        The edges of a source with more than ``hub`` of them are dealt over several parts by their targets, so that no
        task holds them all; ``mirrored`` hands its value to each part. Sums by target are right whatever the parts,
        since each edge is in one of them.
        """
        degrees = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
        known = self.vertices.join(degrees, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))
        known = cut(known.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("deg") / hub)).cast("int")), "degrees")
        hubs, n = counted(known.where("parts > 1").select(F.col("id").alias("hub"), "parts"), "hubs")
        edges = self.edges.select("src", "dst")
        if n:
            held = edges.join(F.broadcast(hubs) if n <= BROADCAST_HUBS else hubs, edges.src == F.col("hub"), "left")
            edges = held.select("src", "dst", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
        else:
            edges = edges.withColumn("part", F.lit(0))
        return edges.repartition("src", "part").persist(StorageLevel.MEMORY_AND_DISK), known


def mirrored(values: DataFrame) -> DataFrame:
    """A row for each part that the edges of an id are dealt over. ``values``: id, parts and more."""
    return values.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
