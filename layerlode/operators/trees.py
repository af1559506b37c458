"""The tree of topics: labels, pruning of repeated names, text, HTML, treemap and nested forms."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Node = tuple[int, int]


def topic_label(layer: Column, cluster: Column, name: Column, size: Column, n_objects: Column, with_id: bool = True, with_size: bool = True, with_share: bool = True) -> Column:
    """A node's name with its id, size and share of all objects as asked for."""
    parts = [F.coalesce(name, F.format_string("Unnamed topic from layer %d cluster %d", layer, cluster))]
    if with_id:
        parts.insert(0, F.concat(layer.cast("string"), F.lit("_"), cluster.cast("string"), F.lit(": ")))
    if with_size:
        parts.append(F.concat(F.lit(" ("), size.cast("string"), F.lit(" objects)")))
    if with_share:
        parts.append(F.concat(F.lit(" ["), F.format_string("%.2f", size / n_objects * 100), F.lit("%]")))
    return F.concat(*parts)


def treemap(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, parent, label, value): a row for each node, the root first of all parents with the clustered objects of the top
    layer; ``topics(layer, cluster, name, size, n_objects)``."""
    top = topics.agg((F.max("layer") + 1).cast("int").alias("l"))
    node = F.concat(F.lit("L"), F.col("child_layer").cast("string"), F.lit("_C"), F.col("child_cluster").cast("string"))
    above = F.concat(F.lit("L"), F.col("parent_layer").cast("string"), F.lit("_C"), F.col("parent_cluster").cast("string"))
    own = topics.select(F.col("layer").alias("child_layer"), F.col("cluster").alias("child_cluster"), "name", "size")
    rows = edges.join(own, ["child_layer", "child_cluster"]).select(node.alias("id"), above.alias("parent"), F.coalesce("name", F.format_string("Layer %d, Cluster %d", "child_layer", "child_cluster")).alias("label"), F.col("size").alias("value"))
    last = topics.crossJoin(F.broadcast(top)).where(F.col("layer") == F.col("l") - 1).groupBy("l").agg(F.sum("size").alias("s"), F.first("n_objects").alias("n"))
    label = F.concat(F.lit("Everything | "), F.col("s").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" clustered ("), F.format_string("%.2f", F.col("s") / F.col("n") * 100), F.lit("%)"))
    root = last.select(F.concat(F.lit("L"), F.col("l").cast("string"), F.lit("_C0")).alias("id"), F.lit("").alias("parent"), label.alias("label"), F.col("s").alias("value"))
    return rows.unionByName(root)


#: Preorder walk as a recursive query over the views ``edges`` and ``labels(layer, cluster, label)``. Runs in both engines.
TREE_SQL = """
with recursive walk(layer, cluster, depth, path) as (
    select child_layer, child_cluster, 1, concat(lpad(cast(99 - child_layer as varchar(9)), 2, '0'), '.', lpad(cast(child_cluster as varchar(9)), 6, '0'))
    from edges where parent_layer = (select max(parent_layer) from edges)
    union all
    select e.child_layer, e.child_cluster, w.depth + 1,
        concat(w.path, '/', lpad(cast(99 - e.child_layer as varchar(9)), 2, '0'), '.', lpad(cast(e.child_cluster as varchar(9)), 6, '0'))
    from walk w join edges e on e.parent_layer = w.layer and e.parent_cluster = w.cluster
)
select w.path, w.depth, concat(repeat(' ', 2 * w.depth), ' - ', l.label) as line from walk w join labels l on l.layer = w.layer and l.cluster = w.cluster
"""


def tree_lines(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, depth, line) of every node; ordered by path they are the text of the tree."""
    spark = edges.sparkSession
    return spark.sql(TREE_SQL.replace("from edges", "from {edges}").replace("join edges", "join {edges}").replace("join labels", "join {labels}").replace("varchar(9)", "string"), edges=edges, labels=labels)


def prune(tree: dict[Node, list[Node]], names: dict[Node, str]) -> dict[Node, list[Node]]:
    """``tree`` without children that have their parent's name; their other descendants move up. The root isn't compared,
    and a pruned node's own entry stays as it was."""

    def same(a: Node, b: Node) -> bool:
        return a in names and names[a] == names.get(b)

    def kept(parent: Node) -> list[Node]:
        out: list[Node] = []
        for child in tree.get(parent, []):
            if not same(parent, child):
                out.append(child)
            elif child[0] > 0 and child in tree:
                out += kept(child)
        return out

    gone = {c for p, children in tree.items() for c in children if same(p, c)}
    return {p: (kept(p) if p in names and p not in gone else list(children)) for p, children in tree.items()}


@dataclass
class TopicTree:
    """A tree of topics on the driver, as large as the number of topics. Its root is the highest node."""

    tree: dict[Node, list[Node]]
    names: dict[Node, str]
    sizes: dict[Node, int]
    n_objects: int
    prune_duplicates: bool = True
    shown: dict[Node, list[Node]] = field(init=False)

    def __post_init__(self) -> None:
        self.shown = prune(self.tree, self.names) if self.prune_duplicates else self.tree

    @classmethod
    def of(cls, edges: DataFrame, topics: DataFrame, n_objects: int, prune_duplicates: bool = True) -> TopicTree:
        tree: dict[Node, list[Node]] = {}
        for r in edges.orderBy("parent_layer", "parent_cluster", F.desc("child_layer"), "child_cluster").collect():
            tree.setdefault((r["parent_layer"], r["parent_cluster"]), []).append((r["child_layer"], r["child_cluster"]))
        rows = topics.select("layer", "cluster", "name", "size").collect()
        return cls(tree, {(r["layer"], r["cluster"]): r["name"] for r in rows}, {(r["layer"], r["cluster"]): r["size"] for r in rows}, n_objects, prune_duplicates)

    @property
    def root(self) -> Node:
        return max(self.shown, default=(0, 0))

    def label(self, node: Node, with_id: bool = False, with_size: bool = False, with_share: bool = False) -> str:
        text = self.names.get(node) or f"Unnamed topic from layer {node[0]} cluster {node[1]}"
        size = self.sizes.get(node, 0)
        return (f"{node[0]}_{node[1]}: " if with_id else "") + text + (f" ({size} objects)" if with_size else "") + (f" [{size / max(self.n_objects, 1) * 100:.2f}%]" if with_share else "")

    def _walk(self) -> list[tuple[Node, int]]:
        out, todo = [], [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            out.append((node, depth))
            todo += [(c, depth + 1) for c in reversed(self.shown.get(node, []))]
        return out

    def text(self, indent: int = 2, **shown: bool) -> str:
        head, *rest = self._walk()
        return "Topic tree:\n" + "".join(f"{' ' * (indent * d)} - {self.label(n, **shown)}\n" for n, d in rest)

    __str__ = text

    def html(self, **shown: bool) -> str:
        """Nested details elements; the coarser a layer, the bolder and darker its names."""
        top = max(self.root[0], 1)
        out: list[str] = []
        todo: list[tuple[Node, bool]] = [(c, False) for c in reversed(self.shown.get(self.root, []))]
        while todo:
            node, end = todo.pop()
            if end:
                out.append("</details>")
                continue
            share = (node[0] + 1) / top
            style = f"margin-left:1em;color:rgb({int(140 - 140 * share)},{int(140 - 140 * share)},{int(140 - 140 * share)});font-weight:{400 + 100 * round(3 * share)}"
            name = html.escape(self.label(node, **shown))
            below = self.shown.get(node, [])
            if not below:
                out.append(f'<div style="{style}">{name}</div>')
                continue
            out.append(f'<details style="{style}"><summary>{name}</summary>')
            todo.append((node, True))
            todo += [(c, False) for c in reversed(below)]
        return '<div class="topic-tree">' + "".join(out) + "</div>"

    _repr_html_ = html

    def hierarchy(self) -> dict:
        """Nested names, sizes and children; a node without children has the size 1."""
        built: dict[Node, dict] = {}
        for node, _ in reversed(self._walk()):
            children = [built[c] for c in self.shown.get(node, [])]
            own = {"name": self.names.get(node, "Topics"), "size": self.sizes.get(node, 0) if children else 1}
            built[node] = own | ({"children": children} if children else {})
        return built[self.root]

    def json(self) -> str:
        return json.dumps(self.hierarchy(), ensure_ascii=False)
