"""Connected components of a links table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionforge.llm.common import keep


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node and comp (the least node of its component) for every node of ``links`` (columns a and b, long).

    Each round every node takes the least label among its neighbours and then its label's own label, so the rounds
    grow with the logarithm of a component's diameter. Labels and links stay distributed; each round is written.
    """
    edges = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{label}-edges")
    state = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), f"{label}-state")
    small = state.count() * 24 <= 32 << 20  # checked: labels of that many nodes may be broadcast, else the joins shuffle
    side = F.broadcast if small else lambda x: x
    while True:
        near = edges.join(side(state.select(F.col("node").alias("b"), "comp")), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        stepped = near.join(side(state), "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        onward = side(state.select(F.col("node").alias("comp"), F.col("comp").alias("onward")))
        state = keep(stepped.join(onward, "comp", "left").select("node", F.least("comp", "onward").alias("comp"), "old"), f"{label}-state")
        if state.filter(F.col("comp") != F.col("old")).isEmpty():
            return state.select("node", "comp")
        state = state.select("node", "comp")
