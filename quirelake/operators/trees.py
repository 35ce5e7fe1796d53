"""Trees in the object graph: nodes in document order, with what they inherit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runs import by_key


def preorder(nodes: DataFrame, inherited: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """``file_id, node, parent, place, depth, *inherited, path``: the nodes that roots reach, in document order from 0.

    ``nodes`` has ``file_id, node, root`` (order among the roots, else null),
    ``kids`` (ids in order), the ``inherited`` columns and, for ``path``, a
    column of names. A node takes a null value of an inherited column from its
    parent; ``path`` joins the names from the root down with dots, without
    empty ones. A node met again is not visited again, so cycles end; of two
    rows of one node the first counts. Kids that are no nodes are left out.

    At scale: one shuffle by file; a group is the tree of one file, without
    stream data.
    """
    columns = [T.StructField("file_id", nodes.schema["file_id"].dataType), T.StructField("node", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("place", T.LongType()), T.StructField("depth", T.IntegerType())]
    columns += [T.StructField(c, T.StringType()) for c in (*inherited, *(["path"] if path else []))]

    def walk(group: list[dict]) -> list[tuple]:
        known: dict[str, dict] = {}
        for row in group:
            known.setdefault(row["node"], row)
        roots = sorted((r for r in known.values() if r["root"] is not None), key=lambda r: r["root"])
        waiting = [(r["node"], None, 0, (None,) * len(inherited), "") for r in reversed(roots)]
        seen: set[str] = set()
        found = []
        while waiting:
            node, parent, depth, given, above = waiting.pop()
            if node in seen or node not in known:
                continue
            seen.add(node)
            row = known[node]
            own = tuple(given[i] if row[c] is None else row[c] for i, c in enumerate(inherited))
            name = ".".join(x for x in (above, row[path] or "") if x) if path else ""
            found.append((row["file_id"], node, parent, len(found), depth, *own, *([name] if path else [])))
            waiting += [(k, node, depth + 1, own, name) for k in reversed(row["kids"] or [])]
        return found

    kept = nodes.select("file_id", "node", "root", "kids", *inherited, *([path] if path else []))
    return by_key(kept, "file_id", walk, T.StructType(columns))
