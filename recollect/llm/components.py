"""Connected components of a distributed edge list: contracted task by task, then by least labels with pointer jumping.

Tasks of at most ``EDGES`` edges each first replace their edges by stars around the least node of each
component that they see, which leaves one edge for each node and task. Then every node starts with
the least of its own and its neighbours' ids, and a round replaces each label by its label's label and then by the
least label among the neighbours, until nothing changes: one round where one task saw all edges, else
about the logarithm of the depth of what the stars leave. Rounds are written to the shared folder, so
lineage stays short; hubs meet their label in joins that adaptive execution can split, and leave them
through partial aggregation. Nodes are longs, or structs of longs, which are ordered by their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.staging import Staged

EDGES = 1_000_000


def least_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches along edges u, v."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _contracted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Stars (u_0.., v_0..) around the least node of each component of the edges of this task."""
    rows = [np.stack([c.to_numpy() for c in batch.columns], 1) for batch in batches if batch.num_rows]
    if not rows:
        return
    both = np.concatenate(rows)
    nodes, at = np.unique(np.concatenate([both[:, :parts], both[:, parts:]]), axis=0, return_inverse=True)
    at = at.ravel()
    least = least_reached(at[: len(both)], at[len(both) :], len(nodes))
    stars = np.flatnonzero(least != np.arange(len(nodes)))
    columns = [pa.array(x) for x in (*nodes[stars].T, *nodes[least[stars]].T)]
    yield pa.RecordBatch.from_arrays(columns, names=[f"{side}_{k}" for side in "uv" for k in range(parts)])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root the least node of its component."""
    kind = edges.schema["u"].dataType
    fields = [f.name for f in kind.fields] if isinstance(kind, T.StructType) else None
    part = lambda c: [F.col(f"{c}.{f}") for f in fields] if fields else [F.col(c)]
    n = len(fields or [1])
    flat = Staged(edges.filter("u <> v").select(*(x.cast("long").alias(f"{c}_{k}") for c in "uv" for k, x in enumerate(part(c)))), "cc-edges").df
    names = ", ".join(f"{side}_{k} long" for side in "uv" for k in range(n))
    stars = flat.coalesce(max(1, -(-flat.count() // EDGES))).mapInArrow(lambda it: _contracted(it, n), names)
    node = lambda c: F.struct(*(F.col(f"{c}_{k}").alias(f) for k, f in enumerate(fields))) if fields else F.col(f"{c}_0")
    stars = stars.select(node("u").alias("u"), node("v").alias("v"))
    both = Staged(stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-stars").df
    now = Staged(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "cc-labels")
    for _ in range(rounds):
        up = now.df.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = now.df.withColumn("was", F.col("root")).join(up, "root").select("node", "was", "far")
        seen = both.join(jumped.select(F.col("node").alias("v"), "far"), "v").groupBy("u").agg(F.min("far").alias("near")).withColumnRenamed("u", "node")
        label = F.least("far", "near")
        after = Staged(jumped.join(seen, "node").select("node", label.alias("root"), (label < F.col("was")).alias("moved")), "cc-labels")
        settled = after.df.filter("moved").isEmpty()
        now.drop()
        now = after
        if settled:
            return now.df.select("node", "root")
    raise RuntimeError("components did not settle")
