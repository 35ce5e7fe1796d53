"""Cross-reference tables and streams, their chain of revisions, object streams, and what they make of a file's objects."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.functions import latin1, object_id
from quirelake.functions.scan import stream_members, table_places
from quirelake.functions.syntax import entries
from quirelake.session import checkpointed

from .objects import classified, decoded, definitions, int_of, name_of, numbers_of
from .places import resolved
from .runs import by_key

_E = "entries"
_ENTRY = r"^(\d{10}) (\d{5}) ([nf])"
_HEAD = r"^[ \t]*(\d{1,15})[ \t]+(\d{1,15})[ \t]*$"
ROWS = ("file_id", "section", "source", "ordinal", "number", "type", "offset", "generation", "compressed_in", "index_in_stream", "malformed")


def tables(files: DataFrame) -> DataFrame:
    """Classic tables: ``file_id, section`` (its offset), ``rows`` (text), ``entries`` of the trailer, ``clear`` (blanks before it)."""
    places = files.select("file_id", F.explode(table_places("content")).alias("t"))
    return places.select("file_id", F.col("t.offset").alias("section"), F.col("t.rows").alias("rows"), entries("t.trailer").alias("entries"), F.col("t.clear").alias("clear"))


def _table_lines(found: DataFrame) -> DataFrame:
    """Lines of classic tables: ``file_id, section, ordinal, line, what``.

    A header ``first count`` takes the ``count`` lines after it as entries; any
    other line where a header must stand is ``lost``.
    """
    lines = found.select("file_id", "section", F.posexplode(F.filter(F.split(F.btrim("rows", F.lit(" \t\r\n\x00\x0c")), r"[ ]*(?:\r\n|\n|\r)"), lambda x: x != "")).alias("ordinal", "line"))
    order = W.partitionBy("file_id", "section").orderBy("ordinal")
    head = F.when(
        F.col("line").rlike(_HEAD),
        F.struct(F.regexp_extract("line", _HEAD, 1).try_cast("long").alias("number"), F.regexp_extract("line", _HEAD, 2).try_cast("long").alias("count"), F.col("ordinal").alias("at")),
    )
    held = lines.withColumn("_before", F.last(head, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    left = F.col("_before.at") + F.col("_before.count") - F.col("ordinal")  # entries that the header before has from here on, less one
    what = F.when(left >= 0, "entry").when(head.isNotNull(), "head").otherwise("lost")
    return held.withColumns({"what": what, "left": left})


def table_rows(found: DataFrame) -> DataFrame:
    """Entries of classic tables; a row that is none in form is a free one of generation 65535 and ``malformed``, rows beyond a count are counted on."""
    rows, fits = _table_lines(found).filter("what <> 'head' AND _before IS NOT NULL"), F.col("line").rlike(_ENTRY)
    return rows.select(
        "file_id", "section", F.lit("table").alias("source"), "ordinal", (F.col("_before.number") + F.col("ordinal") - F.col("_before.at") - 1).alias("number"),
        F.when(fits, F.regexp_extract("line", _ENTRY, 3)).otherwise("f").alias("type"), F.coalesce(F.regexp_extract("line", _ENTRY, 1).try_cast("long"), F.lit(0)).alias("offset"),
        F.when(fits, F.regexp_extract("line", _ENTRY, 2).try_cast("int")).otherwise(65535).alias("generation"), F.lit(None).cast("long").alias("compressed_in"), F.lit(None).cast("long").alias("index_in_stream"), (~fits).alias("malformed"),
    )


def table_faults(found: DataFrame) -> DataFrame:
    """``file_id, section, fault, ordinal``: a line where a header must stand, or entries that are missing where a table runs to the end of its file."""
    lines = _table_lines(found)
    lost = lines.filter("what = 'lost'").groupBy("file_id", "section").agg(F.min("ordinal").alias("ordinal")).withColumn("fault", F.lit("xref-subsection-header"))
    ends = lines.groupBy("file_id", "section").agg(F.max_by(F.struct("what", "left", "ordinal", F.regexp_extract("line", _HEAD, 2).try_cast("long").alias("count")), "ordinal").alias("_e"))
    short = found.filter("entries IS NULL").select("file_id", "section").join(ends, ["file_id", "section"])
    missing = ((F.col("_e.what") == "entry") & (F.col("_e.left") > 0)) | ((F.col("_e.what") == "head") & (F.col("_e.count") > 0))
    cut_off = short.filter(missing).select("file_id", "section", (F.col("_e.ordinal") + 1).alias("ordinal"), F.lit("xref-entry-truncated").alias("fault"))
    return lost.unionByName(cut_off)


def xref_streams(found: DataFrame) -> DataFrame:
    """Cross-reference streams among ``definitions``: ``file_id, section, object_id, entries, clear, decoded, error``."""
    kind = found.filter((name_of(_E, "Type") == "XRef") & F.col("stream").isNotNull())
    return decoded(kind).select("file_id", F.col("start").alias("section"), "object_id", "entries", "clear", "decoded", "error")


def _field(data: Column, at: Column, width: Column) -> Column:
    """A big-endian number of ``width`` bytes at ``at`` (from 0); fields over eight bytes are null."""
    return F.when(width == 0, F.lit(0)).when(width <= 8, F.conv(F.hex(F.substring(data, (at + 1).cast("int"), width.cast("int"))), 16, 10).try_cast("long"))


def _stream_ranges(found: DataFrame) -> DataFrame:
    """Ranges of ``/Index`` with the rows that the data have of each (``_whole`` of ``_n``)."""
    w = F.transform(numbers_of(_E, "W"), lambda x: x.cast("long"))
    index = F.coalesce(F.transform(numbers_of(_E, "Index"), lambda x: x.cast("long")), F.array(F.lit(0).cast("long"), F.coalesce(int_of(_E, "Size"), F.lit(0).cast("long"))))
    shaped = found.select("file_id", "section", "decoded", w.alias("_w"), index.alias("_index")).filter("decoded IS NOT NULL AND size(_w) = 3 AND size(_index) >= 2 AND forall(_w, x -> x >= 0) AND _w[0] + _w[1] + _w[2] > 0")
    ranges = shaped.select("*", F.explode(F.sequence(F.lit(0), F.size("_index") - 2, F.lit(2))).alias("_k")).withColumns({"_first": F.col("_index")[F.col("_k")], "_n": F.col("_index")[F.col("_k") + 1]}).drop("_index")
    earlier = W.partitionBy("file_id", "section").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    width = F.col("_w")[0] + F.col("_w")[1] + F.col("_w")[2]
    return ranges.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_whole", F.greatest(F.least(F.col("_n"), F.floor(F.octet_length("decoded") / width) - F.col("_skip")), F.lit(0)))


def stream_rows(found: DataFrame) -> DataFrame:
    """Entries of cross-reference streams: rows of ``/W`` bytes, numbered by the ranges of ``/Index`` (else 0 to ``/Size``).

    A first width of 0 means type 1. Rows that the data do not reach are left
    out; types other than 0, 1 and 2 are free entries of generation 65535.
    """
    placed = _stream_ranges(found).filter("_whole > 0")
    width = F.col("_w")[0] + F.col("_w")[1] + F.col("_w")[2]
    values = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1),
        lambda i: F.struct(i.alias("i"), *[_field(F.col("decoded"), (F.col("_skip") + i) * width + before, F.col("_w")[k]).alias(f"f{k}") for k, before in enumerate((F.lit(0), F.col("_w")[0], F.col("_w")[0] + F.col("_w")[1]))]),
    )
    rows = placed.select("file_id", "section", "_first", "_skip", F.col("_w")[0].alias("_w0"), F.explode(values).alias("v"))
    kind = F.when(F.col("_w0") == 0, F.lit(1)).otherwise(F.col("v.f0"))
    return rows.select(
        "file_id", "section", F.lit("stream").alias("source"), (F.col("_skip") + F.col("v.i")).alias("ordinal"), (F.col("_first") + F.col("v.i")).alias("number"),
        F.when(kind == 1, "n").when(kind == 2, "compressed").otherwise("f").alias("type"), F.when(kind == 1, F.col("v.f1")).otherwise(F.lit(0)).alias("offset"),
        F.when(kind == 2, F.lit(0)).when(kind.isin(0, 1), F.col("v.f2")).otherwise(65535).try_cast("int").alias("generation"),
        F.when(kind == 2, F.col("v.f1")).alias("compressed_in"), F.when(kind == 2, F.col("v.f2")).alias("index_in_stream"), F.lit(False).alias("malformed"),
    )


def cut_off_streams(found: DataFrame) -> DataFrame:
    """``file_id, section, row``: the first row that the data of a cross-reference stream do not reach; 0 where they can't be decoded."""
    short = _stream_ranges(found).filter("_whole < _n").groupBy("file_id", "section").agg(F.min(F.col("_skip") + F.col("_whole")).alias("row"))
    return short.unionByName(found.filter("decoded IS NULL").select("file_id", "section", F.lit(0).cast("long").alias("row")))


def _walk(group: list[dict]) -> list[tuple]:
    """The chain of one file's sections from ``startxref`` on; a place without a section ends it and is marked as failed."""
    known = {r["section"]: r for r in group if r["section"] is not None}
    first = group[0]
    found, seen, revision = [], set(), 0
    at, place = first["_start"], first["startxref"]
    while place is not None and (at is None or at not in seen):
        failed = at is None
        found.append((first["file_id"], place if failed else at, revision, 0, failed))
        if failed:
            break
        seen.add(at)
        row = known[at]
        if row["extra"] is not None and (row["extra_section"] is None or row["extra_section"] not in seen):
            lost = row["extra_section"] is None
            to = row["extra"] if lost else row["extra_section"]
            seen.add(to)
            found.append((first["file_id"], to, revision, 1, lost))
        at, place, revision = row["prev_section"], row["prev"], revision + 1
    return found


def starts(files: DataFrame) -> DataFrame:
    """``file_id, startxref``: the place that the end of each file names, or null."""
    tail = latin1(F.substring("content", -4096, 4096))
    return files.select("file_id", F.regexp_extract(tail, r"(?s).*startxref[\x00\t\n\x0c\r ]+(\d+)", 1).try_cast("long").alias("startxref"))


def chain(starts: DataFrame, sections: DataFrame) -> DataFrame:
    """``file_id, section, revision`` (0 is the newest), ``extra`` (1 for an ``/XRefStm``), ``failed`` of the sections that ``/Prev`` links.

    ``starts`` has ``file_id, startxref``, ``sections`` ``file_id, section, entries, clear`` of tables and streams.
    A place may stand in the blanks before its section. At scale: all places
    are resolved by one as-of join, then one shuffle of these few numbers by file.
    """
    links = sections.select("file_id", "section", int_of(_E, "Prev").alias("prev"), int_of(_E, "XRefStm").alias("extra"))
    asked = starts.select("file_id", F.lit(None).cast("long").alias("of"), F.lit("start").alias("link"), F.col("startxref").alias("place"))
    for link in ("prev", "extra"):
        asked = asked.unionByName(links.select("file_id", F.col("section").alias("of"), F.lit(link).alias("link"), F.col(link).alias("place")))
    found = resolved(asked.filter("place IS NOT NULL"), sections, "place", "section").select("file_id", "of", "link", F.col("section").alias("to"))
    by_link = {link: found.filter(F.col("link") == link) for link in ("start", "prev", "extra")}
    rows = starts.join(by_link["start"].select("file_id", F.col("to").alias("_start")), "file_id", "left").join(links, "file_id", "left")
    for link in ("prev", "extra"):
        rows = rows.join(by_link[link].select("file_id", F.col("of").alias("section"), F.col("to").alias(f"{link}_section")), ["file_id", "section"], "left")
    kinds = (("section", T.LongType()), ("revision", T.IntegerType()), ("extra", T.IntegerType()), ("failed", T.BooleanType()))
    return by_key(rows, "file_id", _walk, T.StructType([T.StructField("file_id", starts.schema["file_id"].dataType), *[T.StructField(*kind) for kind in kinds]]))


def xref_rows(files: DataFrame) -> DataFrame:
    """Entries of all classic tables of a file, whether linked or not; sections count from 0 in file order."""
    rows = table_rows(tables(files))
    section = F.dense_rank().over(W.partitionBy("file_id").orderBy("section")) - 1
    return rows.withColumn("section", section).select("file_id", "section", "ordinal", "number", "type", "offset", "generation", "malformed")


class Structure:
    """What the cross-reference data of ``files`` say: every member is a DataFrame.

    What several members read is computed once: definitions, tables and entries
    are persisted, the chain, the entries that count, the members of object streams and the
    live objects go to the checkpoint folder when they are first asked for. Definitions of
    files in which the word ``stream`` stands are kept apart: only they can hold
    cross-reference streams, so the chain of other files is known without their objects.
    """

    def __init__(self, files: DataFrame) -> None:
        streamed = F.contains("content", F.lit(b"stream"))
        with_streams, without = definitions(files.filter(streamed)).persist(), definitions(files.filter(~streamed)).persist()
        self.files, self.definitions = files, with_streams.unionByName(without)
        self.tables, self.streams = tables(files).persist(), xref_streams(with_streams)
        self.sections = checkpointed(self.tables.select("file_id", "section", "entries", "clear").unionByName(self.streams.select("file_id", "section", "entries", "clear")))
        self.starts = checkpointed(starts(files))
        self.chain = checkpointed(chain(self.starts, self.sections))

    def bodies(self) -> DataFrame:
        """``file_id, revision, section, entries``: trailers of the chain, 0 the newest."""
        return self.chain.filter("extra = 0 AND NOT failed").join(self.sections, ["file_id", "section"]).select("file_id", "revision", "section", "entries")

    def trailers(self) -> DataFrame:
        """``file_id, entries`` of the newest trailer."""
        return self.bodies().filter("revision = 0").select("file_id", "entries")

    @functools.cache  # noqa: B019
    def entries(self) -> DataFrame:
        """All entries of the chain with their revision."""
        rows = table_rows(self.tables).unionByName(stream_rows(self.streams))
        return rows.join(self.chain.filter("NOT failed").select("file_id", "section", "revision", "extra"), ["file_id", "section"]).persist()

    @functools.cache  # noqa: B019
    def newest_entries(self) -> DataFrame:
        """The entry that counts for each number: of the newest revision, where a free row does not hide one of the ``/XRefStm``."""
        order = W.partitionBy("file_id", "number").orderBy("revision", (F.col("type") == "f").cast("int"), "extra", F.col("ordinal").desc())
        return checkpointed(self.entries().withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k"))

    @functools.cache  # noqa: B019
    def recovery(self) -> DataFrame:
        """``file_id, recovery``: none, no-startxref, empty-xref or partial-scan."""
        walked = self.chain.groupBy("file_id").agg(F.count_if(~F.col("failed")).alias("read"), F.count_if("failed").alias("failed"))
        counted = self.entries().groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
        known = self.starts.select("file_id").join(walked, "file_id", "left").join(counted, "file_id", "left")
        mode = F.when(F.col("read").isNull(), "no-startxref").when(F.coalesce("n", F.lit(0)) == 0, "empty-xref").when(F.col("failed") > 0, "partial-scan").otherwise("none")
        return checkpointed(known.select("file_id", mode.alias("recovery")))

    @functools.cache  # noqa: B019
    def unpacked(self) -> DataFrame:
        """``members`` and, ``broken``, what could not be read: a stream, a pair, or a value."""
        packed = decoded(self.definitions.filter((name_of(_E, "Type") == "ObjStm") & F.col("newest") & F.col("stream").isNotNull()))
        rows = packed.select("file_id", F.col("number").alias("parent"), F.explode_outer(stream_members("decoded", int_of(_E, "N"), int_of(_E, "First"))).alias("m"))
        return checkpointed(rows.select("file_id", "parent", "m.index", "m.number", F.col("m.value").alias("dictionary"), F.coalesce("m.broken", F.lit(True)).alias("broken")))

    def members(self) -> DataFrame:
        """Objects in object streams: ``file_id, parent, index, number, dictionary``; ``parent`` is the stream's object number."""
        return self.unpacked().filter("NOT broken").drop("broken")

    def claimed(self) -> DataFrame:
        """Members that the entry of their number points to."""
        wanted = self.newest_entries().filter("type = 'compressed'").select("file_id", F.col("compressed_in").alias("parent"), "number")
        return self.members().join(wanted, ["file_id", "parent", "number"], "left_semi")

    def skipped(self) -> DataFrame:
        """``file_id, parent, n``: members of object streams that no entry claims."""
        wanted = self.newest_entries().filter("type = 'compressed'").select("file_id", F.col("compressed_in").alias("parent"), "number")
        return self.members().join(wanted, ["file_id", "parent", "number"], "left_anti").groupBy("file_id", "parent").agg(F.count(F.lit(1)).alias("n"))

    def allowed_numbers(self) -> DataFrame:
        """``file_id, parent, numbers``: what entries expect in each object stream."""
        wanted = self.newest_entries().filter("type = 'compressed'")
        return wanted.groupBy("file_id", F.col("compressed_in").alias("parent")).agg(F.array_sort(F.collect_set("number")).alias("numbers"))

    @functools.cache  # noqa: B019
    def direct(self) -> DataFrame:
        """Entries in use with the header that their offset leads to: ``file_id, number, generation, start, found_number, broken`` (null where there is none)."""
        asked = self.newest_entries().filter("type = 'n'").select("file_id", "number", "generation", "offset")
        headers = self.definitions.select("file_id", F.struct("start", F.col("number").alias("found_number"), "broken").alias("header"), "clear")
        return checkpointed(resolved(asked, headers, "offset", "header").select("file_id", "number", "generation", "header.*"))

    @functools.cache  # noqa: B019
    def live_objects(self) -> DataFrame:
        """Objects by the tables: in use at their place, or claimed in an object stream; where the chain is damaged, scanned ones fill what no entry names.

        A place leads to the next header if only blanks and comments lie
        between; the object has the number that stands there. Objects without
        an end of their own can't be read and are none.
        """
        named = self.newest_entries()
        columns = ["file_id", "number", "generation", "object_id", "start", "end", "dictionary", "entries", "stream", "in_object_stream"]
        direct = self.definitions.join(self.direct().filter("NOT broken").select("file_id", "start"), ["file_id", "start"], "left_semi").withColumn("in_object_stream", F.lit(None).cast("string"))
        packed = self.claimed().select(
            "file_id", "number", F.lit(0).alias("generation"), object_id(F.col("number"), F.lit(0)).alias("object_id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"),
            "dictionary", entries("dictionary").alias("entries"), F.lit(None).cast("binary").alias("stream"), object_id(F.col("parent"), F.lit(0)).alias("in_object_stream"),
        )
        damaged = self.recovery().filter("recovery <> 'none'").select("file_id")
        filled = self.definitions.filter("newest").join(damaged, "file_id", "left_semi").join(named.select("file_id", "number"), ["file_id", "number"], "left_anti").withColumn("in_object_stream", F.lit(None).cast("string"))
        return checkpointed(classified(direct.select(columns).unionByName(packed.select(columns)).unionByName(filled.select(columns))))

    def warnings(self) -> DataFrame:
        """``file_id, warning_id, severity, category`` of damaged tables, chains, objects and object streams."""

        def named(rows: DataFrame, what: str, severity: str, category: str, key: Column | None = None) -> DataFrame:
            text = F.lit(f"warn:{what}") if key is None else F.concat(F.lit(f"warn:{what}:"), key)
            return rows.select("file_id", text.alias("warning_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"))

        hexadecimal = F.lower(F.hex("section"))
        entries_read, modes = self.entries(), self.recovery()
        parents = self.allowed_numbers().join(self.definitions.filter("newest").select("file_id", F.col("number").alias("parent")), ["file_id", "parent"], "left_anti")
        broken = self.unpacked().filter("broken").select("file_id", "parent").distinct()
        wrong = self.direct().filter("broken IS NULL OR broken")
        other = self.direct().filter("NOT broken AND found_number <> number")
        entry = F.concat_ws(":", "number", "generation")
        linked = self.tables.join(self.chain.select("file_id", "section"), ["file_id", "section"], "left_semi")
        faults = table_faults(linked)
        parts = [
            named(self.chain.filter("failed AND extra = 0"), "xref-failed", "error", "xref", hexadecimal),
            named(self.chain.filter("failed AND extra = 1"), "xrefstm-failed", "warn", "xref", hexadecimal),
            named(modes.filter("recovery = 'empty-xref'"), "xref-empty", "warn", "xref"),
            named(modes.filter("recovery = 'partial-scan'"), "xref-partial-recovery", "info", "xref"),
            named(entries_read.filter("malformed"), "xref-entry-malformed", "warn", "xref", F.concat_ws(":", hexadecimal, "ordinal")),
            named(faults.filter("fault = 'xref-subsection-header'"), "xref-subsection-header", "error", "xref", hexadecimal),
            named(faults.filter("fault = 'xref-entry-truncated'"), "xref-entry-truncated", "error", "xref", hexadecimal),
            named(cut_off_streams(self.streams), "xrefstream-truncated", "warn", "xref", F.concat_ws("-", "section", "row")),
            named(wrong, "object-parse", "warn", "structure", entry),
            named(other, "xref-mismatch", "warn", "xref", entry),
            named(self.definitions.filter("NOT closed"), "endobj-missing", "warn", "structure", F.concat_ws(":", "number", "generation")),
            named(parents, "objstm-missing", "warn", "structure", object_id(F.col("parent"), F.lit(0))),
            named(self.skipped(), "objstm-skipped", "info", "structure", object_id(F.col("parent"), F.lit(0))),
            named(broken, "objstm-parse", "warn", "structure", object_id(F.col("parent"), F.lit(0))),
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole


def live_objects(files: DataFrame) -> DataFrame:
    return Structure(files).live_objects()

