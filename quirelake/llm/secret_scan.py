"""Secret scan with multipart credential linking (DataFrame functions only).

Certain secrets are found by pattern. Weak candidates (identifiers, secrets and
endpoints that alone mean little) are joined by interval to the scope that they
stand in, and reported only where parts that complete each other come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored

#: Characters from one part to another that may belong together, and characters in a bin of the interval join.
REACH, BIN = 400, 4096

_IS = r"""["']?\x20*[:=]\x20*["']?"""


def _either(words: str) -> str:
    """A pattern with ASCII letters in either case (``(?i)`` takes in other letters in some engines)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = f"({_either('password|passwd|secret|token|api_?key')}){_IS}([A-Za-z0-9+/_.=-]+)"
#: A run of 20 or 24 characters or more is the run that the shorter pattern finds, if that is long enough.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ENDPOINT = (
    r"(?:(?:https?|s?ftp|ssh|amqps?|rediss?|mysql|postgres(?:ql)?|mongodb(?:\+srv)?|jdbc:[a-z0-9]+)://[^\x20\x09-\x0D\"'<>]+"
    rf"|(?:{_either('host|server|endpoint')}){_IS}[A-Za-z0-9.:/_-]{{3,}})"
)
KEY = rf"(?:(?:{_either('secret_?access_?key|pass|pwd|pw|key|auth|credential')}){_IS}[A-Za-z0-9+/_.=-]{{6,}})"
IDENT = rf"(?:(?:{_either('user_?name|user|login|account|client_?id|access_?key_?id|access_?key|key_?id')}){_IS}[A-Za-z0-9@+._-]{{3,}})"
BLOB = "[A-Za-z0-9+/_-]{20,}"
WEAK = f"{ENDPOINT}|{KEY}|{IDENT}|{BLOB}"
BREAK = r"\n[\x20\x09\x0B-\x0D]*\n"

#: Kinds in the order that spans of one start stand in; those from the fourth on are weak.
KINDS = ("assign", "access", "hex", "ident", "key", "blob", "endpoint")
_STRONG_IDS, _STRONG_SECRETS = ("access",), ("assign", "hex")
_WEAK_IDS, _WEAK_SECRETS, _ENDPOINTS = ("ident",), ("key", "blob"), ("endpoint",)


def _weak_kind(match: Column) -> Column:
    mixed = match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return (
        F.when(match.rlike(f"^{ENDPOINT}$"), "endpoint").when(match.rlike(f"^{KEY}$"), "key").when(match.rlike(f"^{IDENT}$"), "ident").when(mixed, "blob")
    )


def _hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row, _id, _chars, _hits``: for each match of a pattern its kind (null: none of worth) and the characters before and in it."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak": WEAK}
    text = F.col("_text")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in patterns.items()])
    rows = rows.withColumn("_break", F.when(F.size("_weak") > 0, F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))).otherwise(F.array().cast("array<string>")))
    patterns["break"] = BREAK
    gaps = {k: F.when(F.size(f"_{k}") > 0, F.transform(F.split(text, p, -1), F.length)).otherwise(F.array().cast("array<int>")) for k, p in patterns.items()}
    rows = rows.select("*", *[F.arrays_zip(F.col(f"_{k}").alias("match"), F.slice(g, F.lit(1), F.size(f"_{k}")).alias("gap")).alias(f"_{k}s") for k, g in gaps.items()])

    def kind(name: str, match: Column) -> Column:
        if name == "assign":
            return F.when(F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6, F.lit(name))
        return _weak_kind(match) if name == "weak" else F.lit(name)

    def hit(name: str) -> Column:
        parts = lambda x, i: (F.lit(name).alias("pattern"), i.alias("nth"), x["gap"].alias("gap"), F.length(x["match"]).alias("size"), kind(name, x["match"]).alias("kind"))
        return F.transform(f"_{name}s", lambda x, i: F.struct(*parts(x, i)))

    return stored(rows.select("_row", "_id", F.length(text).alias("_chars"), F.concat(*map(hit, patterns)).alias("_hits")))


def _scopes(places: DataFrame, chars: DataFrame) -> DataFrame:
    """``_row, _scope, _open, _close, _bin``: stretches without an empty line, once for each bin that they touch."""
    breaks = places.filter("kind = 'break'").select("_row", "start", "end")
    edges = breaks.select("_row", F.col("start").alias("_close"), F.col("end").alias("_next")).unionByName(chars.select("_row", F.col("_chars").alias("_close"), F.lit(None).cast("long").alias("_next")))
    ordered = W.partitionBy("_row").orderBy("_close", F.desc_nulls_last("_next"))
    scopes = edges.select("_row", F.coalesce(F.lag("_next").over(ordered), F.lit(0)).alias("_open"), "_close").filter("_open < _close")
    return scopes.select("_row", F.col("_open").alias("_scope"), "_close", F.explode(F.sequence(F.expr(f"_open div {BIN}"), F.expr(f"_close div {BIN}"))).alias("_bin"))


def _linked(places: DataFrame, chars: DataFrame) -> DataFrame:
    """The weak parts among ``places`` that others complete.

    An identifier and a secret within ``REACH`` characters of one scope complete
    each other if one of them is certain or an endpoint is near, too; an
    endpoint is completed by both. Weak parts that overlap certain ones are none.
    """
    parts = places.filter("kind <> 'break'").withColumn("_bin", F.expr(f"start div {BIN}"))
    inside = (F.col("start") >= F.col("_scope")) & (F.col("end") <= F.col("_close"))
    parts = parts.join(_scopes(places, chars), ["_row", "_bin"]).filter(inside).select("_row", "_scope", "start", "end", "kind", "_order")
    weak = F.col("_order") >= 3
    forth = W.partitionBy("_row", "_scope").orderBy("start", "_order", "end").rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy("_row", "_scope").orderBy(F.desc("start"), F.desc("_order"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    covered = (F.max(F.when(~weak, F.col("end"))).over(forth) > F.col("start")) | (F.min(F.when(~weak, F.col("start"))).over(back) < F.col("end"))
    parts = parts.withColumn("_covered", F.coalesce(covered, F.lit(False))).filter(~(weak & F.col("_covered")))
    groups = {"_i": _STRONG_IDS, "_s": _STRONG_SECRETS, "_wi": _WEAK_IDS, "_ws": _WEAK_SECRETS, "_e": _ENDPOINTS}

    def near(kinds: tuple[str, ...]) -> Column:
        one = F.col("kind").isin(*kinds)
        before = F.col("start") - F.max(F.when(one, F.col("end"))).over(forth) <= REACH
        after = F.min(F.when(one, F.col("start"))).over(back) - F.col("end") <= REACH
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    seen = parts.select("*", *[near(kinds).alias(name) for name, kinds in groups.items()])
    completed = (
        F.when(F.col("kind").isin(*_WEAK_IDS), F.expr("_s OR (_ws AND _e)"))
        .when(F.col("kind").isin(*_WEAK_SECRETS), F.expr("_i OR (_wi AND _e)"))
        .when(F.col("kind").isin(*_ENDPOINTS), F.expr("(_i OR _wi) AND (_s OR _ws)"))
        .otherwise(F.lit(False))
    )
    return seen.filter(completed).select("_row", "start", "end", "kind", "_order")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of secrets in each text: ``id, n_assign, n_access, n_hex, n_linked, base, spans``, one row for each input row.

    ``base`` has the certain ones (``assign``: a named value of six characters
    or more, ``access``: ``AKIA`` and 16 capitals or digits or more, ``hex``: 24
    digits or more), ``spans`` these and the weak parts that complete each other
    (``ident``, ``key``, ``blob``, ``endpoint``): arrays of ``start, order, end,
    kind`` in code points, end exclusive, by start and then kind.

    Edge cases: a null or empty text has none; rows stand for themselves, so
    repeated ids and null ids give a row each; an empty table gives an empty
    table; columns not named are ignored.

    At scale: texts are read once and written nowhere, only lengths of matches
    are. Places are running sums within a text; a part finds its scope by bins
    of ``BIN`` characters and not by pairs, and its neighbours by two sorted
    passes over the scope. All groups are parts of one text.
    """
    found = _hits(docs, id_col, text_col)
    hits = found.select("_row", F.explode("_hits").alias("_h")).select("_row", "_h.*")
    ends = W.partitionBy("_row", "pattern").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    places = (
        hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(ends)).filter("kind IS NOT NULL")
        .select("_row", "kind", order.alias("_order"), (F.col("end") - F.col("size")).alias("start"), "end")
    )
    suspects = found.filter(F.exists("_hits", lambda h: (h["pattern"] == "weak") & h["kind"].isNotNull()))
    of_suspects = places.join(suspects.select("_row"), "_row", "left_semi")
    every = places.filter(F.col("_order").between(0, 2)).unionByName(_linked(of_suspects, suspects.select("_row", F.col("_chars").cast("long"))))
    lists = every.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", F.col("_order").alias("order"), "end", "kind"))).alias("_spans"))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    spans = F.coalesce(F.col("_spans"), none)

    def count(first: int, last: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["order"].between(first, last))).cast("long")

    return found.select("_row", "_id").join(lists, "_row", "left").select(
        F.col("_id").alias(id_col),
        *[count(k, k).alias(f"n_{KINDS[k]}") for k in range(3)],
        count(3, len(KINDS)).alias("n_linked"),
        F.filter(spans, lambda s: s["order"] < 3).alias("base"),
        spans.alias("spans"),
    )


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
