"""Belief propagation over messages that go back and forth along the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import cut, drop


def belief_propagation(graph: Graph, rounds: int = 4) -> DataFrame:
    """id, product0, product1: the product of the two-state messages that a vertex gets in the last round, and their logarithms.

    An edge of weight w (0 < w < 1) sends a message each way, at first (w, w); the potential of all state
    pairs is w towards the larger id and 1 - w towards the smaller. A round takes the products and sends
    every message back: for each state, the sum over states of half the potential times product over message,
    normalised. Products are kept as sums of logarithms, so that a vertex of any degree sends right messages;
    ``product0`` itself is 0 once it is below what a double holds, ``log_product0`` is not.
    """
    graph.need_weights("belief propagation")
    if not graph.edges.where("weight is null or weight <= 0 or weight >= 1").isEmpty():
        raise ValueError("weights must lie between 0 and 1")
    w = F.col("weight")
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    messages = graph.edges.select(F.explode(ways).alias("e"), w.alias("w")).select("e.a", "e.b", "w", F.col("w").alias("m0"), F.col("w").alias("m1"))
    products, before = None, None
    for k in range(rounds):
        messages = cut(_sent_back(messages, products) if k else messages)
        if before is not None:
            drop(before)
        before = messages
        products = messages.groupBy(F.col("b").alias("id")).agg(*(F.sum(F.log(f"m{i}")).alias(f"l{i}") for i in (0, 1)))
    logs = graph.vertices.withColumns({f"l{i}": F.lit(0.0) for i in (0, 1)}) if products is None else graph.vertices.join(products, "id", "left")
    logs = cut(logs.select("id", *(F.coalesce(f"l{i}", F.lit(0.0)).alias(f"log_product{i}") for i in (0, 1))), "products")
    if before is not None:
        drop(before)
    return logs.select("id", *(F.exp(f"log_product{i}").alias(f"product{i}") for i in (0, 1)), "log_product0", "log_product1")


def _sent_back(messages: DataFrame, products: DataFrame) -> DataFrame:
    got = messages.join(products, messages.b == products.id)
    potential = F.when(F.col("b") < F.col("a"), F.col("w")).otherwise(1 - F.col("w"))  # from b to a
    rest = [F.col(f"l{i}") - F.log(f"m{i}") for i in (0, 1)]  # products without the message itself
    most = F.greatest(*rest)
    got = got.withColumn("t", most + F.log(F.exp(rest[0] - most) + F.exp(rest[1] - most)))
    to = [F.log(0.5 * potential) + F.col("t")] * 2  # the potential is the same for both states
    shares = [F.exp(x - F.greatest(*to)) for x in to]
    return got.select(F.col("b").alias("x"), F.col("a").alias("y"), "w", *((s / (shares[0] + shares[1])).alias(f"m{i}") for i, s in enumerate(shares))).withColumnsRenamed({"x": "a", "y": "b"})


#: Couplings of the states of neighbours, and the bounds of beliefs and messages.
PHI = ((0.95, 0.05), (0.5, 0.5))
LOW, HIGH = 1e-4, 0.9999


def _rule(v: Column) -> Column:
    return (F.pmod(v, F.lit(100)) + 17) * 3428971 % 100


def prior(v: Column) -> Column:
    """Belief in state 0: 0.05 for good seeds, 0.95 for bad ones, else even. Seeds are fixed by a rule on the id."""
    rule = _rule(v)
    return F.when(rule == 1, F.lit(0.95)).when(rule == 0, F.lit(0.05)).otherwise(F.lit(0.5))


def is_seed(v: Column) -> Column:
    return _rule(v) <= 1


def belief_propagation_seeded(graph: Graph, rounds: int = 4) -> DataFrame:
    """id, belief0, belief1 after the last round. Seeds keep their prior."""
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    messages = graph.edges.select(F.explode(ways).alias("e")).select("e.a", "e.b", prior(F.col("e.a")).alias("m"))
    states, before = None, []
    for k in range(rounds):
        if k:
            got = messages.join(states, messages.b == states.id)
            to0 = F.col("belief0") * PHI[0][0] / F.col("m") + F.col("belief1") * PHI[1][0] / (1 - F.col("m"))
            to1 = F.col("belief0") * PHI[0][1] / F.col("m") + F.col("belief1") * PHI[1][1] / (1 - F.col("m"))
            m = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), to0 / (to0 + to1)))
            messages = got.select(F.col("b").alias("x"), F.col("a").alias("y"), m.alias("m")).select(F.col("x").alias("a"), F.col("y").alias("b"), "m")
        messages = cut(messages)
        drop(*before)
        sums = messages.groupBy(F.col("b").alias("to")).agg(F.sum(F.log("m")).alias("l0"), F.sum(F.log(1 - F.col("m"))).alias("l1"))
        held = graph.vertices.join(sums, F.col("id") == F.col("to"), "left").select("id", prior(F.col("id")).alias("p"), F.coalesce("l0", F.lit(0.0)).alias("l0"), F.coalesce("l1", F.lit(0.0)).alias("l1"))
        most = F.greatest("l0", "l1")
        held = held.select("id", "p", F.greatest(F.lit(LOW), F.col("p") * F.exp(F.col("l0") - most)).alias("b0"), F.greatest(F.lit(LOW), (1 - F.col("p")) * F.exp(F.col("l1") - most)).alias("b1"))
        share = F.when(is_seed(F.col("id")), F.col("p")).otherwise(F.col("b0") / (F.col("b0") + F.col("b1")))
        states = cut(held.select("id", share.alias("belief0"), (1 - share).alias("belief1")))
        before = [messages, states]
    drop(*before[:1])
    if states is None:
        p = prior(F.col("id"))
        return graph.vertices.select("id", p.alias("belief0"), (1 - p).alias("belief1"))
    return states
