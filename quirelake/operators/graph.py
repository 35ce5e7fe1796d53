"""What the references of a file reach from its trailer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.functions.values import refs_within

from .objects import edges, value_of
from .runs import by_key


def trailer_references(trailers: DataFrame) -> DataFrame:
    """``file_id, object_id``: what a trailer's entries refer to, its ``/Root`` and ``/Info`` among them."""
    values = F.array_compact(F.array(*[value_of(F.col("entries"), k) for k in ("Root", "Info", "Encrypt")]))
    return trailers.select("file_id", F.explode(refs_within(F.array_join(values, " "))).alias("object_id")).distinct()


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``file_id, object_id, distance``: everything that ``links(file_id, src_id, dst_id)`` lead to from ``roots(file_id, object_id)``, with the fewest steps.

    A file's references are followed in breadth, each once, so cycles end and
    the work does not grow with the depth. At scale: one shuffle of references
    by file; a group is the references of one file, which are pairs of ids.
    """
    from_roots = roots.select("file_id", F.lit(None).cast("string").alias("src_id"), F.col("object_id").alias("dst_id"))
    rows = links.select("file_id", "src_id", "dst_id").unionByName(from_roots)

    def walk(group: list[dict]) -> list[tuple]:
        leads: dict[str | None, list[str]] = {}
        for row in group:
            leads.setdefault(row["src_id"], []).append(row["dst_id"])
        found: dict[str, int] = {}
        near, distance = leads.get(None, []), 0
        while near:
            new = [x for x in dict.fromkeys(near) if x not in found]
            found |= dict.fromkeys(new, distance)
            near, distance = [to for x in new for to in leads.get(x, ())], distance + 1
        return [(group[0]["file_id"], node, steps) for node, steps in found.items()]

    fields = [T.StructField("file_id", links.schema["file_id"].dataType), T.StructField("object_id", T.StringType()), T.StructField("distance", T.IntegerType())]
    return by_key(rows, "file_id", walk, T.StructType(fields))


def object_distances(found: DataFrame, trailers: DataFrame) -> DataFrame:
    """``file_id, object_id, distance`` of the live objects ``found``: steps from the trailer, null for those that nothing there leads to."""
    reached = reachable(edges(found), trailer_references(trailers))
    return found.select("file_id", "object_id").join(reached, ["file_id", "object_id"], "left")
