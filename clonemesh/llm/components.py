"""Connected components of links between documents or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import contract


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable over the undirected ``edges``, found
    by contraction on executors; nothing is collected, and a hub is no hot task.

    Rows with a null end and loops are ignored; repeated rows count once; an empty table
    gives an empty result. Nodes without edges do not appear.
    """
    return contract(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
