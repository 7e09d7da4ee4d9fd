"""Circular environments of graph rows, in Arrow batches."""

from __future__ import annotations

from hashlib import sha256
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_FEATURES = "array<struct<iteration:int,label:string>>"


def environments(labels: list[str | None], bonds: list[tuple[int, int, str]], radius: int) -> list[tuple[int, str | None]]:
    """(round, label) of the environments that count, in rounds by bonds, label and node; a bond is (node, node, its text).

    Bonds whose ends are not both nodes are left out.
    """
    found: list[tuple[int, str | None]] = [(0, x) for x in labels]
    ends: list[list[tuple[int, str, int]]] = [[] for _ in labels]
    for k, (a, b, text) in enumerate(bonds):
        if a is None or b is None or not (0 <= a < len(labels) and 0 <= b < len(labels)):
            continue
        ends[a].append((k, text, b))
        if a != b:
            ends[b].append((k, text, a))
    held: list[tuple[int, ...]] = [()] * len(labels)
    seen: set[tuple[int, ...]] = set()
    grows = list(range(len(labels)))
    for r in range(1, radius + 1):
        tried = []
        for i in grows:
            own = {*held[i], *(k for k, _, _ in ends[i])}.union(*(held[j] for _, _, j in ends[i]))
            near = ";".join(sorted(f"{text},{labels[j]}" if labels[j] is not None else text for _, text, j in ends[i]))
            label = near if labels[i] is None else f"{labels[i]}|{near}"
            tried.append((tuple(sorted(own)), sha256(label.encode()).hexdigest(), i))
        tried.sort()
        labels, grows = list(labels), []
        for own, label, i in tried:
            labels[i], held[i] = label, own
            if own not in seen:
                seen.add(own)
                found.append((r, label))
                grows.append(i)
    return found


def with_environments(invariants: Column, bonds: Column, radius: int) -> Column:
    """array<struct<iteration, label>> from the texts of a row's nodes and its bonds; null without nodes, round 0 only without bonds."""

    def run(nodes: pa.Array, edges: pa.Array) -> pa.Array:
        sizes, widths = (pc.list_value_length(x).to_pylist() for x in (nodes, edges))
        texts = iter(nodes.flatten().to_pylist())
        flat = dict(zip(("a", "b", "type", "ring"), (x.to_pylist() for x in edges.flatten().flatten()), strict=True))
        kinds = [",".join(x for x in (kind, None if ring is None else str(int(ring))) if x is not None) for kind, ring in zip(flat["type"], flat["ring"], strict=True)]
        ties = iter(zip(flat["a"], flat["b"], kinds, strict=True))
        rounds, labels, begins = [], [], [0]
        for n, m in zip(sizes, widths, strict=True):
            for r, label in environments(list(islice(texts, n or 0)), list(islice(ties, m or 0)), 0 if m is None else radius):
                rounds.append(r)
                labels.append(label)
            begins.append(len(rounds))
        values = pa.StructArray.from_arrays([pa.array(rounds, pa.int32()), pa.array(labels, pa.string())], names=["iteration", "label"])
        return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), values, mask=pa.array([n is None for n in sizes], pa.bool_()))

    kept = F.transform(bonds, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), e["type"].alias("type"), e["ring"].alias("ring")))
    return F.arrow_udf(run, _FEATURES)(invariants, kept)
