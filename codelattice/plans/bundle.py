"""The full graph as four tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from codelattice.operators import edges as E
from codelattice.operators import nodes as N


@dataclass(frozen=True)
class GraphBundle:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    directories: DataFrame


def graph_bundle(
    symbols: DataFrame,
    virtual: DataFrame,
    annotations: DataFrame,
    calls: DataFrame,
    edge_annotations: DataFrame,
    directories: DataFrame,
) -> GraphBundle:
    """Nodes with parents, planned directories among them; annotated edges; files; folders."""
    nodes = N.graph_nodes(symbols, virtual, annotations)
    files = N.files_of(N.real_nodes(symbols))
    shown = N.with_parents(nodes).select("id", "label", "type", "file_path", "line", "is_virtual", "parent_id")
    return GraphBundle(
        nodes=shown.unionByName(N.directory_nodes(directories)),
        edges=E.edge_rollup(calls, nodes, directories, edge_annotations),
        files=files,
        directories=N.directories_of(files),
    )
