"""Secrets in whole texts: keyword automaton, anchored expressions near its hits, checksums.

1. Prefilter: an Aho-Corasick automaton of the kinds' keywords reads each chunk of texts once, letters folded. Runs of
   hexadecimal digits have no keyword; their hits are runs of one character class, found in the text mapped to classes.
2. An expression is matched at the hits only, anchored there and bounded by its row, from left to right and behind the
   match before it, which is what a search of the whole text for leftmost matches that do not overlap gives.
3. Matches that fail their rule (length, checksum) are dropped; they still end where they end. ``github`` and ``npm``
   tokens carry a checksum: their last six characters are the CRC-32 of the thirty before, in base 62.

Places count code points, ends are exclusive. Null and empty texts have no spans. Rows that repeat another are scanned
alike, null ids included. Columns other than the id and the text are not read, so their names cannot clash.
A task holds one chunk of texts (2 MB, or one longer text) at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Kind:
    """pattern: an expression over UTF-8 bytes. keywords: folded; each match starts with one of them. Or run: each match
    is a run of at least so many characters of the pattern's class, which is the expression [class]+."""

    name: str
    pattern: str
    keywords: tuple[str, ...] = ()
    sound: Callable[[re.Match], bool] = lambda m: True
    run: int = 0


def base62_crc(token: bytes) -> bool:
    """The last six of the 36 characters after the mark are the checksum of the others."""
    body = token.rpartition(b"_")[2]
    n, digits = zlib.crc32(body[:-6]), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return len(body) == 36 and digits.encode() == body[-6:]


# The expressions of secrets.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
GITHUB = r"gh[oprsu]_[0-9A-Za-z]+"
NPM = r"npm_[0-9A-Za-z]+"

KINDS = (
    Kind("assign", ASSIGN, ("password", "passwd", "secret", "token", "apikey", "api_key"), lambda m: len(m[2]) >= 6),
    Kind("access", ACCESS, ("akia",), lambda m: len(m[0]) >= 20),
    Kind("hex", HEX, run=24),
    Kind("github", GITHUB, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_"), lambda m: base62_crc(m[0])),
    Kind("npm", NPM, ("npm_",), lambda m: base62_crc(m[0])),
)

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def _automaton(kinds: tuple[Kind, ...]) -> ahocorasick.Automaton:
    words: dict[str, list[int]] = {}
    for i, kind in enumerate(kinds):
        for word in kind.keywords:
            words.setdefault(word, []).append(i)
    found = ahocorasick.Automaton()
    for word, owners in words.items():
        found.add_word(word, (len(word), owners))
    if words:
        found.make_automaton()
    return found


def _matches(expression: re.Pattern, at: list[int], flat: bytes, offs: np.ndarray) -> Iterator[re.Match]:
    """Leftmost matches at hits, which ascend; none crosses the end of its row."""
    upto = 0
    ends = offs[np.searchsorted(offs, at, "right")].tolist() if at else []
    for place, end in zip(at, ends, strict=True):
        if place >= upto and (m := expression.match(flat, place, end)):
            upto = m.end()
            yield m


def _runs(expression: re.Pattern, least: int, classes: bytes, flat: bytes, offs: np.ndarray) -> Iterator[re.Match]:
    """Runs of a class of at least so many bytes; a run that goes on in the next row is one run in each."""
    mark, place = b"\x01" * least, classes.find(b"\x01" * least)
    while place >= 0:
        m = expression.match(flat, place, int(offs[np.searchsorted(offs, place, "right")]))
        if m.end() - place >= least:
            yield m
        place = classes.find(mark, m.end())


def _scan(kinds: tuple[Kind, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(kinds)
        expressions = [re.compile(k.pattern.encode()) for k in kinds]
        classes = [bytes(e.fullmatch(bytes([b])) is not None for b in range(256)) if k.run else b"" for k, e in zip(kinds, expressions, strict=True)]
        for batch in batches:
            ids, null = T.ints(batch, "doc_id")
            for rows, data, offs in T.chunks(batch):
                flat = data.tobytes()
                hits: list[list[int]] = [[] for _ in kinds]
                if len(automaton):
                    # One character a byte, so that places are places in the bytes.
                    for last, (size, owners) in automaton.iter(flat.translate(_FOLD).decode("latin-1")):
                        for i in owners:
                            hits[i].append(last + 1 - size)
                spans = []
                for i, (kind, expression) in enumerate(zip(kinds, expressions, strict=True)):
                    found = _runs(expression, kind.run, flat.translate(classes[i]), flat, offs) if kind.run else _matches(expression, sorted(hits[i]), flat, offs)
                    spans += [(m.start(), i, m.end()) for m in found if kind.sound(m)]
                spans.sort()
                start, kind, end = np.array(spans, np.int64).reshape(-1, 3).T
                row = np.searchsorted(offs, start, "right") - 1
                if len(spans):
                    # Bytes that go on a code point, before each place.
                    inner = np.append(0, np.cumsum((data & 0xC0) == 0x80))
                    start, end = (x - offs[row] - (inner[x] - inner[offs[row]]) for x in (start, end))
                upto = np.searchsorted(row, np.arange(len(offs)))
                struct = pa.StructArray.from_arrays([pa.array([kinds[i].name for i in kind.tolist()], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["kind", "start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([T.long_array(ids[rows], null[rows]), lists], names=["doc_id", "spans"])

    return scan


def secrets(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and spans, (kind, start, end) by start and then by the order of kinds: one row per document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(kinds), FOUND)


def listed(spans):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: Either case of ASCII letters only: elsewhere (?i:) folds further letters into s and k.
_ASSIGN_SQL = re.sub(r"\(\?i:(.*?\))\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]), ASSIGN)


def _sql(kind: str, order: int, pattern: str, sound: str) -> str:
    """Places of a kind's matches: what stands between matches and the matches before it, counted."""
    p = pattern.replace("'", "''")
    return f"""
SELECT rid, '{kind}' AS kind, {order} AS place, m[i] AS match,
       (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS start
FROM (SELECT rid, m, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT rid, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS gaps FROM d))
WHERE {sound.replace("PATTERN", p)}"""


_CRC = f"""(SELECT list_reduce(list_transform(range(6), lambda k: substr('{BASE62}', ((v // (62 ** (5 - k))::BIGINT) % 62 + 1)::INT, 1)), lambda a, b: a || b) FROM (
  SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(30), lambda k: unicode(substr(m[i], length(m[i]) - 35 + k::INT, 1))::BIGINT)),
         lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda s, j: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295) AS v)) = right(m[i], 6)"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql(*x) for x in (("assign", 1, _ASSIGN_SQL, "length(regexp_extract(m[i], 'PATTERN', 2)) >= 6"), ("access", 2, ACCESS, "length(m[i]) >= 20"), ("hex", 3, HEX, "length(m[i]) >= 24"), ("github", 4, GITHUB, f"length(m[i]) = 40 AND {_CRC}"), ("npm", 5, NPM, f"length(m[i]) = 40 AND {_CRC}")))}),
s AS (SELECT *, kind || ':' || start || ':' || (start + length(match)) AS span FROM f)
SELECT doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access, count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place <= 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id
"""
