"""Content streams: operations, nesting, marked content, and how they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.functions import latin1, operation_id, operator_category
from quirelake.functions.syntax import content_faults, content_operations, entries, int_value, name_value, number_value, string_bytes, tokens

from .objects import lookup

#: What operators do.
EXPLANATIONS = {
    "q": "Save the graphics state.", "Q": "Restore the graphics state.", "cm": "Multiply the transformation matrix by %s.", "w": "Set the line width to %s.", "J": "Set the line cap to %s.", "j": "Set the line join to %s.",
    "m": "Begin a subpath.", "l": "Add a line.", "h": "Close the subpath.", "re": "Add a rectangle.", "S": "Stroke the path.", "s": "Close and stroke the path.", "f": "Fill the path.", "F": "Fill the path (old form).",
    "f*": "Fill the path by the even-odd rule.", "B": "Fill and stroke the path.", "B*": "Fill by the even-odd rule and stroke the path.", "n": "End the path without painting.", "W": "Clip to the path.", "W*": "Clip to the path by the even-odd rule.",
    "BT": "Begin a text object.", "ET": "End the text object.", "Tc": "Set the character spacing to %s.", "Tw": "Set the word spacing to %s.", "Tz": "Set the horizontal scale to %s.", "TL": "Set the leading to %s.", "Tf": "Set the font %s.",
    "Tr": "Set the text rendering mode to %s.", "Ts": "Set the text rise to %s.", "Td": "Move to the next line.", "TD": "Move to the next line and set the leading.", "Tm": "Set the text matrix to %s.", "T*": "Move to the start of the next line.",
    "Tj": "Show the text %s.", "TJ": "Show text with spacing.", "'": "Move to the next line and show the text %s.", '"': "Set the spacing, move to the next line and show text.", "CS": "Set the stroking colour space %s.", "cs": "Set the colour space %s.",
    "SCN": "Set the stroking colour.", "scn": "Set the colour.", "G": "Set the stroking grey to %s.", "g": "Set the grey to %s.", "RG": "Set the stroking RGB colour.", "rg": "Set the RGB colour.", "K": "Set the stroking CMYK colour.", "k": "Set the CMYK colour.",
    "Do": "Draw the XObject %s.", "BI/EI": "Draw an inline image.", "sh": "Paint the shading %s.", "BMC": "Begin marked content %s.", "BDC": "Begin marked content %s with properties.", "EMC": "End marked content.", "MP": "Mark a point %s.", "DP": "Mark a point %s with properties.",
}


def operations(contents: DataFrame) -> DataFrame:
    """``file_id, page_number, sequence, op_id, operator, operands, category, start, end`` of ``contents(file_id, page_number, content)``.

    Operands are values as they stand in the stream; an array or a dictionary is
    one of them. Sequences count from 0; an inline image is one ``BI/EI``.
    """
    rows = contents.select("file_id", "page_number", F.posexplode(content_operations(latin1(F.col("content")))).alias("sequence", "o"))
    return rows.select(
        "file_id", "page_number", "sequence", operation_id(F.col("page_number"), F.col("sequence")).alias("op_id"), "o.operator", "o.operands", operator_category(F.col("o.operator")).alias("category"), "o.start", "o.end"
    )


def tokens_of(contents: DataFrame) -> DataFrame:
    """``file_id, page_number, ordinal, kind, start, end, token`` of content streams, damaged bytes as ``error``."""
    return contents.select("file_id", "page_number", F.posexplode(tokens(latin1(F.col("content")))).alias("ordinal", "t")).select("file_id", "page_number", "ordinal", "t.*")


def nesting(ops: DataFrame) -> DataFrame:
    """``ops`` with ``depth``: how many of ``q BT BMC BDC`` are open at a row, closers before their row, never below 0."""
    return _depths(ops, ("q", "BT", "BMC", "BDC"), ("Q", "ET", "EMC"), "depth")


def _depths(ops: DataFrame, openers: tuple[str, ...], closers: tuple[str, ...], name: str) -> DataFrame:
    order = W.partitionBy("file_id", "page_number").orderBy("sequence")
    opens, closes = F.col("operator").isin(*openers).cast("int"), F.col("operator").isin(*closers).cast("int")
    leveled = ops.withColumns({"_opens": opens, "_closes": closes}).withColumn("_step", F.coalesce(F.lag("_opens").over(order), F.lit(0)) - F.col("_closes")).withColumn("_level", F.sum("_step").over(order))
    return leveled.withColumn(name, F.col("_level") - F.least(F.lit(0), F.min("_level").over(order))).drop("_opens", "_closes", "_step", "_level")


def scoped(ops: DataFrame, setting: Column, name: str) -> DataFrame:
    """``ops`` with ``name``: the latest non-null ``setting`` before a row that ``Q`` has not taken back.

    A setting holds from its row to the ``Q`` that closes the level of ``q`` that
    it stands on. Such stretches nest, so at each row they are a stack: the one
    on top is the last whose opening made the stack as high as it is there. At
    scale: sorted passes over a page, no pairs of settings and rows.
    """
    keys = ["file_id", "page_number"]
    page = W.partitionBy(*keys).orderBy("sequence")
    leveled = _depths(ops, ("q",), ("Q",), "_now").withColumn("_set", setting)
    opened = F.lag(F.when(F.col("operator") == "q", 1).otherwise(0)).over(page)
    leveled = leveled.withColumn("_before", F.coalesce(F.lag("_now").over(page) + opened, F.lit(0)))
    closes = (F.col("operator") == "Q") & (F.col("_before") > F.col("_now"))
    # a closer's level is the one that it ends, so the next closer of a setting's own level ends it
    after = W.partitionBy(*keys, "_level").orderBy(F.desc("sequence")).rowsBetween(W.unboundedPreceding, 0)
    placed = leveled.withColumn("_level", F.when(closes, F.col("_before")).otherwise(F.col("_now"))).withColumn("_end", F.min(F.when(closes, F.col("sequence"))).over(after))
    settings = placed.filter(F.col("_set").isNotNull())
    ends = settings.filter(F.col("_end").isNotNull()).groupBy(*keys, F.col("_end").alias("sequence")).agg(F.count(F.lit(1)).alias("_ended"))
    rows = placed.select(*keys, "sequence", "_set").join(ends, [*keys, "sequence"], "left")
    step = F.when(F.col("_set").isNotNull(), 1).otherwise(0) - F.coalesce(F.col("_ended"), F.lit(0))
    high = rows.withColumn("_high", F.sum(step).over(page))
    same = W.partitionBy(*keys, "_high").orderBy("sequence")
    found = high.withColumn("_top", F.last("_set", ignorenulls=True).over(same)).select(*keys, "sequence", F.when(F.col("_high") > 0, F.col("_top")).alias(name))
    return ops.join(found, [*keys, "sequence"])


def stream_faults(contents: DataFrame) -> DataFrame:
    """``file_id, warning_id, severity, category`` of damaged tokens and of inline images without an end in ``contents(file_id, page_number, content)``."""
    rows = contents.select("file_id", "page_number", F.explode(content_faults(latin1(F.col("content")))).alias("f"))
    named = F.concat(F.lit("warn:"), "f.fault", F.lit(":"), "page_number", F.lit(":"), "f.start")
    return rows.select("file_id", named.alias("warning_id"), F.lit("warn").alias("severity"), F.lit("structure").alias("category"))


def marked_content(ops: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """``ops`` with ``mcid``, the innermost marked-content id that is open at a row.

    A ``BDC`` carries the id around it, an ``EMC`` the one that it ends; ``BMC``
    opens a sequence without one. A property's name is looked up in
    ``properties(file_id, page_number, name, entries)``. A row's opener is the
    last one before it that is one level further out.
    """
    depth = _depths(ops, ("BMC", "BDC"), ("EMC",), "_after")
    closing = (F.col("operator") == "EMC") & (F.coalesce(F.col("_before"), F.lit(0)) > F.col("_after"))
    order = W.partitionBy("file_id", "page_number").orderBy("sequence")
    opened = F.lag(F.col("operator").isin("BMC", "BDC").cast("int")).over(order)
    around = depth.withColumn("_before", F.lag("_after").over(order) + opened).withColumn("_around", F.col("_after") + closing.cast("int"))
    given = F.when(F.col("operator") == "BDC", F.col("operands")[1])
    rows = around.withColumns({"_given": given, "_name": name_value(given)})
    if properties is not None:
        named = properties.select("file_id", "page_number", F.col("name").alias("_name"), F.try_element_at("entries", F.lit("MCID")).alias("_named"))
        rows = rows.join(named, ["file_id", "page_number", "_name"], "left")
    else:
        rows = rows.withColumn("_named", F.lit(None).cast("string"))
    own = int_value(F.coalesce(F.try_element_at(entries("_given"), F.lit("MCID")), F.col("_named")))
    rows = rows.withColumn("_own", own)
    keys = ["file_id", "page_number", "sequence"]
    members = rows.select(*keys, F.col("_around").alias("_level"), F.lit(None).cast("struct<v:bigint>").alias("_opens"), F.lit(0).alias("_role"))
    openers = rows.filter(F.col("operator").isin("BMC", "BDC")).select(*keys, (F.col("_after") + 1).alias("_level"), F.struct(F.col("_own").alias("v")).alias("_opens"), F.lit(1).alias("_role"))
    last = F.last("_opens", ignorenulls=True).over(W.partitionBy("file_id", "page_number", "_level").orderBy("sequence", "_role"))
    found = members.unionByName(openers).withColumn("_v", last).filter("_role = 0").select(*keys, F.when(F.col("_level") > 0, F.col("_v.v")).alias("mcid"))
    return ops.join(found, keys)


def operand_text(operands: Column, most: int = 4) -> Column:
    """The first operands as they are listed: strings, arrays and dictionaries only by their brackets, dots where more follow."""
    short = F.transform(
        F.slice(operands, 1, most),
        lambda x: F.when(x.startswith("<<"), "<<…>>").when(x.startswith("[") , "[…]").when(x.startswith("(") | x.startswith("<"), "(…)").otherwise(x),
    )
    return F.array_join(F.concat(short, F.when(F.size(operands) > most, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>"))), " ")


def printable(data: Column, most: int = 64) -> Column:
    """Up to ``most`` bytes in parentheses, others than printable ones as dots."""
    text = F.regexp_replace(latin1(F.substring(data, 1, most)), r"(?s)[^\x20-\x7E]", "·")
    return F.concat(F.lit("("), text, F.when(F.octet_length(data) > most, "…").otherwise(""), F.lit(")"))


def string_literal(data: Column) -> Column:
    """A string as a value is shown: in parentheses if all of it is printable, else up to 64 hexadecimal digits."""
    text = latin1(data)
    digits = F.lower(F.hex(data))
    shown = F.concat(F.lit("<"), F.substring(digits, 1, 64), F.when(F.octet_length(data) > 32, "…").otherwise(""), F.lit(">"))
    return F.when(text.rlike(r"^[\x20-\x7E]*$"), F.concat(F.lit("("), F.regexp_replace(text, r"([\\()])", r"\\$1"), F.lit(")"))).otherwise(shown)


def explained(ops: DataFrame) -> DataFrame:
    """``ops`` with ``explanation``, the operator's sentence with what its operands say filled in."""
    first = F.try_element_at("operands", F.lit(1))
    matrix = F.when(F.size("operands") < 6, "[?]").otherwise(F.concat(F.lit("["), F.array_join(F.transform(F.slice("operands", 1, 6), lambda x: F.when(number_value(x).isNotNull(), x).otherwise("?")), " "), F.lit("]")))
    filled = (
        F.when(F.col("operator").isin("cm", "Tm"), matrix)
        .when(F.col("operator").isin("Tj", "'"), F.coalesce(printable(string_bytes(first)), F.lit("(?)")))
        .when(F.col("operator").isin("Tf", "CS", "cs", "Do", "sh", "BMC", "BDC", "MP", "DP"), F.when(first.startswith("/"), first).otherwise("?"))
        .otherwise(F.when(number_value(first).isNotNull(), first).otherwise("?"))
    )
    sentence = lookup(EXPLANATIONS, F.col("operator"))
    return ops.withColumn("explanation", F.coalesce(F.replace(sentence, F.lit("%s"), filled), F.concat(F.lit("Operator "), F.col("operator"), F.lit(" is not documented."))))
