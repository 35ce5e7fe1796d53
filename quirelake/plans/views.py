"""A corpus of PDF files as SQL views and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.syntax import lex, operations_of, string_of
from quirelake.operators.content import explained, marked_content, nesting, operations
from quirelake.operators.files import all_warnings, file_info
from quirelake.operators.forms import form_fields
from quirelake.operators.history import entry_intervals
from quirelake.operators.objects import edges, nested_values, streams
from quirelake.operators.pages import document_tree, embedded_files, page_contents, pages
from quirelake.operators.resources import fonts, page_resources, properties, xobjects
from quirelake.operators.structure import struct_children, struct_nodes
from quirelake.operators.text import cmaps, shown_strings, string_texts, text_runs, visual_elements
from quirelake.operators.xref import Structure
from quirelake.session import checkpointed


class Corpus:
    """The tables of a corpus, each a DataFrame keyed by ``file_id``.

    Objects, pages and their resources are computed at once and read from the
    checkpoint folder by what builds on them; the rest when it is read.
    """

    def __init__(self, files: DataFrame) -> None:
        self.files = files
        self.structure = Structure(files)
        self.objects = self.structure.live_objects()
        self.trailers = self.structure.trailers()
        self.document_tree = document_tree(self.objects, self.trailers)
        self.pages = checkpointed(pages(self.objects, self.trailers))
        self.resources = checkpointed(page_resources(self.objects, self.pages))
        self.fonts = fonts(self.objects, self.resources)
        self.xobjects = xobjects(self.objects, self.resources)
        self.contents = page_contents(self.objects, self.pages)
        self.operations = operations(self.contents)

    def tables(self) -> dict[str, DataFrame]:
        maps = cmaps(self.objects, self.fonts)
        runs = text_runs(string_texts(shown_strings(self.operations), self.fonts, maps))
        return {
            "pdf_files": file_info(self.files, self.structure), "pdf_objects": self.objects.drop("stream"), "pdf_edges": edges(self.objects), "pdf_values": nested_values(self.objects), "pdf_entry_intervals": entry_intervals(self.structure.entries()), "pdf_streams": streams(self.objects), "pdf_xref_entries": self.structure.newest_entries(),
            "pdf_bodies": self.structure.bodies(), "pdf_document_tree": self.document_tree, "pdf_embedded_files": embedded_files(self.objects, self.document_tree), "pdf_pages": self.pages, "pdf_fonts": self.fonts,
            "pdf_xobjects": self.xobjects, "pdf_operations": explained(marked_content(nesting(self.operations), properties(self.objects, self.resources))), "pdf_text_runs": runs,
            "pdf_visual_elements": visual_elements(runs, self.operations, self.xobjects), "pdf_form_fields": form_fields(self.objects, self.document_tree), "pdf_struct_nodes": struct_nodes(self.objects, self.document_tree),
            "pdf_struct_children": struct_children(self.objects), "pdf_warnings": all_warnings(self.files, self.structure),
        }

    def create_views(self) -> list[str]:
        """Temporary views ``pdf_*`` of all tables."""
        found = self.tables()
        for name, table in found.items():
            table.createOrReplaceTempView(name)
        return list(found)


def _token_rows() -> type:
    class Tokens:
        def eval(self, content: bytes) -> Iterator[tuple]:
            text = (content or b"").decode("latin-1")
            for kind, a, b in lex(text):
                yield kind, a, b, text[a:b]

    return Tokens


def _operation_rows() -> type:
    class Operations:
        def eval(self, content: bytes) -> Iterator[tuple]:
            for i, (operator, operands, _, _) in enumerate(operations_of((content or b"").decode("latin-1"))):
                yield i, operator, operands

    return Operations


def register_functions(spark: SparkSession) -> None:
    """SQL table functions ``pdf_tokens(content)`` and ``pdf_operations(content)``, and ``pdf_string(token)``."""
    spark.udtf.register("pdf_tokens", F.udtf(_token_rows(), returnType="kind string, start int, end int, token string", useArrow=True))
    spark.udtf.register("pdf_operations", F.udtf(_operation_rows(), returnType="sequence int, operator string, operands array<string>", useArrow=True))

    @F.pandas_udf("binary")
    def pdf_string(tokens: pd.Series) -> pd.Series:
        return pd.Series([string_of(x) for x in tokens], dtype=object)

    spark.udf.register("pdf_string", pdf_string)
