"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.llm.frames import join_counted, small, staged

#: Links that a task connects at a time.
HELD = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The least of the numbers below ``count`` that each is connected with by links."""
    labels = np.arange(count)
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def stars(batches: Iterable[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """``node`` and ``least``, the smallest node it is connected with by some ``held`` links at
    a time; one row for each node of them, the smallest itself included."""
    waiting: list[pa.RecordBatch] = []
    rows = 0

    def connected() -> pa.RecordBatch:
        links = pa.Table.from_batches(waiting).combine_chunks()
        ends = pa.concat_arrays([c for i in (0, 1) for c in links.column(i).chunks])
        nodes = ends.unique().sort()
        place = pc.index_in(ends, nodes).to_numpy(zero_copy_only=False).astype(np.int64)
        labels = least_labels(place[: len(links)], place[len(links) :], len(nodes))
        return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(labels))], ["node", "least"])

    for batch in batches:
        if len(batch):
            waiting.append(batch)
            rows += len(batch)
        if rows >= held:
            yield connected()
            waiting, rows = [], 0
    if waiting:
        yield connected()


def components(links: DataFrame, a: str = "a", b: str = "b", held: int = HELD) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with, for all nodes with a link.

    Each task connects its own links, so that a cluster it knows is a star around its smallest
    node. A node that is in clusters of several tasks connects their smallest nodes: these
    links, which are few, are solved in the same way, and name the roots of the stars. A path of
    n links, dealt at random, takes about log n rounds, a dense group one or two.
    """
    kind = links.schema[a].dataType.simpleString()
    given = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    found = given.mapInArrow(lambda batches: stars(batches, held), f"node {kind}, least {kind}")
    per_node = staged(
        found.groupBy("node").agg(F.min("least").alias("low"), F.collect_set("least").alias("lows"))
    )
    between = per_node.where(F.size("lows") > 1).select(F.explode("lows").alias("a"), F.col("low").alias("b"))
    between = staged(between.where("a <> b").distinct())
    if between.isEmpty():
        return per_node.select("node", F.col("low").alias("root"))
    above = components(between, held=held).withColumnRenamed("node", "low")
    if small(above, 64):
        joined = per_node.select("node", "low").join(F.broadcast(above), "low", "left")
    else:  # a node that many have as their smallest is joined by its number of rows
        counts = per_node.groupBy("low").agg(F.count("*").alias("n")).join(above, "low")
        joined = join_counted(per_node.select("node", "low"), staged(counts), ["low"], "n")
    return staged(joined.select("node", F.coalesce("root", "low").alias("root")))
