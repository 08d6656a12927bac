"""Connected components of a table of links, by repeated contraction.

In each round every node takes the least node of its neighbourhood, itself
included, as its new name, and the links are renamed. With names in random
order (hashes) a constant share of the nodes goes in each round. Each round is
written to the shared folder; nothing is gathered on the driver but a count. The
last ``FEW`` links, whatever the input's size, are joined by one task, as they
would take most of the rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settled

#: So many links (some 200 kB) are left to one task.
FEW = 10_000


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n nodes' component under links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [[x.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)] for x in batches]
    if not found:
        return
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(at[: len(a)], at[len(a) :], len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b); the root is one node of its component."""
    kind = links.schema["a"].dataType
    links = settled(links.filter("a <> b").select("a", "b"), "links")
    names: DataFrame | None = None
    while many := links.count():
        if many <= FEW:
            step = settled(links.coalesce(1).mapInArrow(lean(_last), f"node {kind.simpleString()}, root {kind.simpleString()}"), "names")
        else:
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = settled(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "names")
            left = links.join(step.toDF("a", "x"), "a").select("b", "x").join(step.toDF("b", "y"), "b").filter("x <> y")
            links = settled(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if names is None:
            names = step
        else:
            names = settled(names.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "names")
        if many <= FEW:
            break
    if names is None:
        return links.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    return names
