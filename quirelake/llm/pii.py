"""Personal data replaced by surrogates: keyed, of the same kind, gender, script and format.

Digits stay digits, vowels vowels, capitals capitals: the characters of an
entity that may vary are read as one number, which a keyed Feistel network
permutes. Entities that differ get different surrogates, equal ones get equal
ones in every document. A check over all entities of the corpus finds those
whose surrogate is taken or is a real entity; they get the next draw.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import ipaddress
import itertools
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Given names by gender and script.
GIVEN_NAMES = {
    ("female", "Latin"): "Anna Maria Emma Sofia Laura Julia Clara Elena Alice Sarah Mary Linda Susan Karen Emily Olivia Claire Camille Sophie Louise Ingrid Greta Helga Carmen Lucia Isabel Rosa Marta Jane Grace".split(),
    ("male", "Latin"): "John James Robert Michael David Thomas Peter Paul Mark Daniel Martin Oliver Henry Louis Pierre Jean Hans Karl Stefan Jürgen Carlos Juan Pedro Diego Luis Antonio George Edward Frank Simon".split(),
    ("female", "Cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия".split(),
    ("male", "Cyrillic"): "Иван Алексей Сергей Дмитрий Андрей Михаил Николай Павел Виктор Юрий".split(),
    ("female", "Greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Δήμητρα Ειρήνη".split(),
    ("male", "Greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Αλέξης Μιχάλης".split(),
}
#: What may vary in a surrogate, by class; other characters stay.
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèâêîôûäöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")

_CLASS_OF = {ch: alphabet for alphabet in CLASSES for ch in alphabet}
_POOL_OF = {name: key for key, names in GIVEN_NAMES.items() for name in names}
_TITLES = set("Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme".split())
_CAP = r"\p{Lu}\p{Ll}[\p{L}'’-]*"

#: What may stand between the digits of a telephone number.
_GAP = r"[ ./\u00a0\u2009\u202f\u2010-\u2013-]"

#: In order of precedence (by the last pattern of a kind, then the place); the group ``v`` is what is replaced.
PATTERNS = [
    ("key_block", regex.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<v>.*?)-----END [A-Z ]*PRIVATE KEY-----", regex.S)),
    ("secret", regex.compile(r"""(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b\s*[:=]\s*["']?(?P<v>[^\s"']{6,})""")),
    ("secret", regex.compile(r"\b(?P<v>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|eyJ[\w-]+\.[\w-]+\.[\w-]+|[0-9a-f]{32,128})\b")),
    ("email", regex.compile(r"(?P<v>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)")),
    ("iban", regex.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("card", regex.compile(r"(?<![\w.-])(?P<v>\d(?:[ -]?\d){12,18})(?![\w-])")),
    ("ipv6", regex.compile(r"(?P<v>(?:(?<!\w)[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{0,4}){2,8}(?:(?:\.\d{1,3}){3})?)(?!\w|\.\d)")),
    ("ip", regex.compile(r"(?<![\w.])(?P<v>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\w]|\.\d)")),
    ("ssn", regex.compile(r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("phone", regex.compile(r"(?<![\w.])(?P<v>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3})(?![\w-])")),
    ("phone", regex.compile(rf"(?P<v>(?:\+{_GAP}?|(?<![\w.,+-])00(?=[1-9]))\(?\d(?:(?:{_GAP}|\){_GAP}?|{_GAP}?\()?\d){{6,14}})(?!\d)")),
    ("phone", regex.compile(r"(?<![\w.,+-])(?P<v>1?[2-9]\d{9}|0[1-9]\d{8,9}|[2-9]\d\d-\d{4})(?![\w-]|[.,]\d)")),
]
_GROUPED = next(pattern for kind, pattern in PATTERNS if kind == "phone")
_HINT = regex.compile(r"[\d@]|::|(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|private key)")
#: Words after which a person is named.
CUES = ("my name is", "name is", "name:", "i am", "i'm", "this is", "dear", "contact", "contact person:", "attn:", "attn.", "signed,", "regards,", "sincerely,", "from:", "to:", "author:", "written by", "mein name ist", "ich heiße", "sehr geehrter", "sehr geehrte", "liebe", "lieber", "je m'appelle", "mon nom est", "cher", "chère", "me llamo", "mi nombre es", "estimado", "estimada", "меня зовут", "με λένε")
_CAPITALISED = regex.compile(_CAP)


def _after_cue(text: str, at: int) -> bool:
    """Whether a cue and a blank end at ``at``."""
    before = text[max(0, at - 24) : at]
    if not before or before[-1] not in " \t":
        return False
    before = before.rstrip(" \t").lower()
    return before.endswith(CUES) and any(before.endswith(c) and not before[: -len(c)][-1:].isalnum() for c in CUES)


def _names(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of given names and surnames; the capitalised words of a text are looked at once."""
    words = [(*m.span(), m[0]) for m in _CAPITALISED.finditer(text)]
    words = [x for x in words if not text[x[0] - 1 : x[0]].isalnum()]
    follows = lambda k, gaps: k + 1 < len(words) and text[words[k][1] : words[k + 1][0]] in gaps
    found, surnames = [], set()
    for k, (a, b, word) in enumerate(words):
        named: list[int] = []
        if word in _POOL_OF:
            found.append((a, b, "given"))
            named = [k + 1] if follows(k, (" ",)) else []
        elif word in _TITLES and follows(k, (" ", ". ")):
            named = [k + 2] if follows(k + 1, (" ",)) else [k + 1]
        elif follows(k, (" ",)) and _after_cue(text, a):
            named = [k, k + 1]
        for j in named:
            if words[j][2] not in _POOL_OF:
                found.append((words[j][0], words[j][1], "surname"))
                surnames.add(words[j][2])
    if surnames:
        for a, _, word in words:
            at = 0
            for part in regex.split("(['’-])", word) if word not in surnames else [word]:
                if part in surnames:
                    found.append((a + at, a + at + len(part), "surname"))
                at += len(part)
    return found


def entities(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the entities of a text, in order, none overlapping.

    A name is a known given name with the capitalised word after it, a
    capitalised word after a title, or two of them after a cue such as ``my
    name is``; a name found so is found wherever else it stands in the
    document, so that short mentions go with the full one.
    """
    found: list[tuple[int, int, str]] = []
    if _HINT.search(text):
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                digits = sum(c.isdigit() for c in m["v"])
                if pattern is _GROUPED and not (7 <= digits <= 15 and (m["v"][0] in "+(" or digits >= 9)):
                    continue
                if kind == "card" and digits <= 15 and (text[m.start() - 1 : m.start()] == "+" or m["v"].startswith("00")):  # a phone number's
                    continue
                if kind == "ipv6":
                    found += _ipv6_spans(m)
                    continue
                if not (kind == "iban" and not _iban_valid(m["v"])):
                    found.append((*m.span("v"), kind))
    found += _names(text)
    rank = {kind: i for i, (kind, _) in enumerate(PATTERNS)}
    taken: list[tuple[int, int, str]] = []  # apart and in order, so only the two around a span can overlap it
    for span in sorted(set(found), key=lambda x: (rank.get(x[2], 99), x[0], -x[1])):
        at = bisect.bisect(taken, span)
        if (not at or taken[at - 1][1] <= span[0]) and (at == len(taken) or taken[at][0] >= span[1]):
            taken.insert(at, span)
    return taken


def _iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return len(v) >= 15 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _ipv6_spans(m: regex.Match) -> list[tuple[int, int, str]]:
    """The address in a run of hexadecimal groups, without a colon of the sentence around it.

    Two groups count only with a digit and a group of three characters, as
    ``a::b`` and ``[1::2]`` are code.
    """
    a, b = m.span("v")
    v = m["v"]
    if v[0] == ":" and (v[1] != ":" or v[2:3] == ":"):
        a, v = a + 1, v[1:]
    if v[-1] == ":" and (v[-2] != ":" or v[-3:-2] == ":"):
        b, v = b - 1, v[:-1]
    try:
        ipaddress.IPv6Address(v)
    except ValueError:
        return []
    groups = [g for g in v.split(":") if g]
    plain = len(groups) > 2 or "." in v or len(groups) == 2 and any(c.isdigit() for c in v) and max(map(len, groups)) > 2
    return [(a, b, "ipv6")] if plain else []


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def permuted(number: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): Feistel rounds on two halves, walked until the number fits."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while size > 1:
        left, right = number >> half, number & mask
        for r in range(8):
            digest = hmac.new(key, f"{tweak}|{r}|{right:x}".encode(), hashlib.sha256).digest()
            while len(digest) * 8 < half:
                digest += hashlib.sha256(digest).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        number = left << half | right
        if number < size:
            return number
    return number


@functools.cache
def class_of(character: str) -> str:
    """The characters that may stand for one: its class, or for letters of other scripts those like it nearby; "" for none."""
    if character in _CLASS_OF or not character.isalpha():
        return _CLASS_OF.get(character, "")
    first, kind = ord(character) & ~63, unicodedata.category(character)
    return "".join(c for c in map(chr, range(first, first + 64)) if unicodedata.category(c) == kind and c not in _CLASS_OF)


def _reformatted(value: str, free: list[bool], key: bytes, tweak: str) -> str:
    """``value`` with its free characters permuted within their classes."""
    places = [(i, class_of(c)) for i, c in enumerate(value) if free[i] and class_of(c)]
    number, size = 0, 1
    for i, alphabet in places:
        number, size = number * len(alphabet) + alphabet.index(value[i]), size * len(alphabet)
    shape = "".join(class_of(c)[0] if f and class_of(c) else c for c, f in zip(value, free, strict=True))
    number = permuted(number, size, key, f"{tweak}|{shape}")
    out = list(value)
    for i, alphabet in reversed(places):
        number, at = divmod(number, len(alphabet))
        out[i] = alphabet[at]
    return "".join(out)


def surrogate(kind: str, value: str, key: bytes, draw: int = 0) -> str:
    """The ``draw``-th surrogate of an entity; from the ninth on it grows by a letter, so some draw is free."""
    tweak = f"{kind}|{draw}"
    free = [True] * len(value)
    if kind == "given":
        # the next one in a keyed cycle of the pool, so that no name stands for itself and no two for one
        pool = sorted(GIVEN_NAMES[_POOL_OF[value]])
        cycle = sorted(pool, key=lambda x: permuted(pool.index(x), len(pool), key, f"given|{_POOL_OF[value]}"))
        return cycle[(cycle.index(value) + 1) % len(cycle)]
    if kind == "ip":
        n = permuted(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32, key, tweak)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "ipv6":
        if draw > 8:
            return str(ipaddress.IPv6Address(permuted(int(ipaddress.IPv6Address(value)), 1 << 128, key, tweak)))
        head, _, tail = value.rpartition(":") if "." in value else (value, "", "")
        hexadecimal = "".join(c for c in head if c != ":")
        drawn = f"{permuted(int(hexadecimal or '0', 16), 16 ** len(hexadecimal), key, f'{tweak}|' + regex.sub('[^:]', '0', head)):0{len(hexadecimal)}x}"
        digits = iter(drawn.upper() if any(c.isupper() for c in head) else drawn)
        head = "".join(c if c == ":" else next(digits) for c in head)
        return f"{head}:{surrogate('ip', tail, key, draw)}" if tail else head
    if kind == "secret" and regex.fullmatch("[0-9a-f]{16,}", value):
        return f"{permuted(int(value, 16), 16 ** len(value), key, f'{tweak}|{len(value)}'):0{len(value)}x}"
    if kind == "email":
        free = [i < value.rindex(".") for i in range(len(value))]
    elif kind == "iban":
        free = [i >= 4 and c.isdigit() for i, c in enumerate(value)]
    elif kind == "phone" and value[0] == "+":
        code = regex.match(rf"\+\D*\d{{1,3}}(?={_GAP}|[()])|\+\D*\d", value).end()
        free = [i >= code for i in range(len(value))]
    elif kind == "card":
        free = [0 < i < len(value) - 1 for i in range(len(value))]
    out = _reformatted(value, free, key, tweak)
    if kind == "card":
        digits = [c for c in value if c.isdigit()]
        if luhn_digit("".join(digits[:-1])) == digits[-1]:
            out = out[:-1] + luhn_digit("".join(c for c in out[:-1] if c.isdigit()))
    elif kind == "iban":
        body = out.replace(" ", "")[4:]
        check = 98 - int("".join(str(int(c, 36)) for c in body + out[:2] + "00")) % 97
        out = out[:2] + f"{check:02d}" + out[4:]
    if draw > 8 and kind in ("email", "surname", "secret", "key_block"):
        out = "abcdefghijklmnopqrstuvwxyz"[draw % 26] * (draw // 8) + out
    return out


def _final_surrogates(found: DataFrame, key: bytes, plain_draws: int, max_draws: int | None) -> DataFrame:
    """``kind, value, surrogate`` of the entities whose first draw is taken, over the whole corpus.

    Given names need no check: each stands for the next one in a keyed cycle of
    its pool. Entities that ``plain_draws`` draws leave without a surrogate of
    their own get one that is longer by ``#`` and a keyed digest, so the forms
    of a kind can't run out. Where ``max_draws`` is given, more than that many
    are an error instead.
    """

    def draws(n: int):
        def one(kind: str, value: str) -> str:
            tag = "" if n < plain_draws else "#" + hmac.new(key, f"{n}|{kind}|{value}".encode(), "sha256").hexdigest()[:16]
            return surrogate(kind, value, key, n) + tag

        @F.pandas_udf("string")
        def draw(kind: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([one(k, v) for k, v in zip(kind, value, strict=True)], dtype=object)

        return draw("kind", "value")

    originals = cut(found.filter("kind <> 'given'").select("kind", "value").distinct())
    current = cut(originals.withColumn("surrogate", draws(0)).withColumn("draw", F.lit(0)))
    real = originals.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("_real"))
    for n in itertools.count(1):
        first = current.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "value")).alias("_first"))
        held = current.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = cut(held.filter("_real OR value <> _first.value").select("kind", "value"))
        if clash.isEmpty():
            break
        if max_draws is not None and n > max_draws:
            raise ValueError(f"{clash.count()} surrogates are still taken after {max_draws} draws")
        again = clash.withColumn("surrogate", draws(n)).withColumn("draw", F.lit(n))
        current = cut(current.join(clash, ["kind", "value"], "left_anti").unionByName(again))
    return current.filter("draw > 0").select("kind", "value", "surrogate")


def replace_pii(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", plain_draws: int = 32, max_draws: int | None = None) -> DataFrame:
    """``id, text, n_replaced``: every entity of every text replaced by its surrogate.

    ``key`` decides the surrogates; the same key gives the same ones in every run.

    Edge cases: a null text stays null with 0 replaced; an empty one stays
    empty; repeated rows are replaced alike; texts are read whole; null ids
    pass through, as rows are told apart by id and text; an empty table gives an
    empty table; columns not named are ignored.

    At scale: two passes over the texts. Between them only distinct entities
    are shuffled; documents are joined with replacement lists only if any
    entity needed a second draw.
    """
    secret = key.encode()
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    id_kind = base.schema["_id"].dataType.simpleString()

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, fp, kind, text[a:b]) for i, text, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a, b, kind in entities(text or "")]
            rows = list(dict.fromkeys(rows))
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["_id", "_fp", "kind", "value"])

    found = cut(base.mapInArrow(detect, f"_id {id_kind}, _fp long, kind string, value string"))
    redrawn = cut(_final_surrogates(found, secret, plain_draws, max_draws))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            others = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for text, other in zip(batch.column(1).to_pylist(), others, strict=True):
                known = {(x["kind"], x["value"]): x["surrogate"] for x in other or ()}
                spans = entities(text or "")
                out, last = [], 0
                for a, b, kind in spans:
                    out += [text[last:a], known.get((kind, text[a:b])) or surrogate(kind, text[a:b], secret)]
                    last = b
                texts.append(None if text is None else "".join(out) + text[last:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["_id", "_text", "n_replaced"])

    if not redrawn.isEmpty():
        lists = found.join(redrawn, ["kind", "value"]).groupBy(F.col("_id").alias("_of"), F.col("_fp").alias("_with")).agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("_others"))
        base = base.join(lists, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_fp") == F.col("_with")), "left").select("_id", "_text", "_fp", "_others")
    done = base.mapInArrow(replaced, f"_id {id_kind}, _text string, n_replaced long")
    return done.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "n_replaced")
