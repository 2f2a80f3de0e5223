"""Secret scans: base patterns and dictionary-primed zstandard novelty.

The base patterns find assignments, access keys and long hexadecimal strings. The
method then looks at values in sensitive context (a name such as ``credential`` or
``auth`` before a separator) that no base span covers. What such a value costs is
the growth of the compressed size when it is added to the text around it, with a
compressor primed by a dictionary of identifiers: words, paths and names that occur
nearby or in code cost little, keys cost nearly all their bytes and are reported.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import ship, slices, whole_text

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Names that make a value sensitive (fixed values).
SENSITIVE = ("access", "auth", "bearer", "cert", "client_id", "connection", "cookie", "credential", "encryption", "hmac", "key", "login", "oauth", "passphrase", "password", "passwd", "pin", "private", "pwd", "secret", "session", "signature", "signing", "ssh", "token", "webhook")
_CONTEXT = re.compile(r"""((?:%s)[A-Za-z0-9_]{0,24})["']?\x20{0,8}([:=]|\x20)\x20{0,8}["']?([A-Za-z0-9+/_.=~!@#$%%^&*-]{8,})""" % "|".join(SENSITIVE), re.I | re.A)
#: Identifiers and words of code and configuration (fixed values).
IDENTIFIERS = (
    "access account action address api application args array async auth authorization backend base64 bearer binary boolean bucket buffer build cache callback "
    "certificate class client client_id client_secret cluster column commit config configuration connection connection_string console const container content "
    "context cookie count create credential credentials data database date debug default delete dependency deploy description developer directory disable docker "
    "document domain double email enable encoding encryption endpoint environment error event example exception export extends false field file filename float "
    "format function gateway generate github global group handler hash header headers host hostname http https identifier image import index input instance int "
    "integer interface internal json key keystore label language length level library license list listener local localhost location log logger login main manager "
    "map master message metadata method model module name namespace network node null number object option options organization output package parameter params "
    "parent parse password path permission placeholder platform plugin pointer policy port postgres prefix primary private process production profile project "
    "property protected protocol provider proxy public query queue random read redis region register release remote replace repository request required resource "
    "response result return role root route runtime sample schema script secret security select server service session setting settings shared signature size "
    "source ssh staging start state static status storage store stream string struct subject suffix support system table target task template temporary test "
    "thread throw timeout timestamp title token transaction transport true tuple type undefined unique update upload url user user_id username utf-8 value values "
    "variable vector version void volume webhook window workspace write xml yaml your-key-here changeme none nil www.example.com example.org"
)
AROUND = 256


def novelty(value: str, before: str, after: str) -> float:
    """The compressed bytes that value adds to an empty frame, a byte of it, with a
    dictionary of the identifiers and of what stands around it. A value this short
    is not entropy-coded: what no match in the dictionary covers costs its bytes."""
    primed = zstandard.ZstdCompressionDict("\n".join((IDENTIFIERS, before, after)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False)
    raw = value.encode()
    return max(0.0, (len(compressor.compress(raw)) - len(compressor.compress(b""))) / len(raw))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in code points."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINT):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _prose(value: str) -> bool:
    """Whether a value after a blank can be a word or a number of running text:
    letters and digits are not both in it, and its case is not mixed."""
    kinds = any(c.isdigit() for c in value) + any(c.isalpha() for c in value)
    tail = value[1:]
    return kinds < 2 and (tail == tail.lower() or value == value.upper())


def novel_spans(text: str, base: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int]]:
    """Values in sensitive context that no base span touches, with a novelty of at
    least threshold. Other occurrences of a value do not explain it, and behind a
    name whose value is none the search goes on: the value may be a name itself."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    found, at = [], 0
    while m := _CONTEXT.search(text, at):
        start, end = m.span(3)
        value, wide = m[3], AROUND + len(m[3])
        at = m.end(1)
        if any(s < end and start < e for s, _, e in base) or (m[2] == " " and _prose(value)):
            continue
        before = text[max(0, start - wide) : start].replace(value, " " * len(value))[-AROUND:]
        after = text[end : end + wide].replace(value, " " * len(value))[:AROUND]
        if novelty(value, before, after) >= threshold:
            found.append((start, 3, end))
            at = end
    return found


def scan(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans (kind:start:end
    by start, then kind) of every document, over its whole text. A null text is
    empty: no spans, the hash of the empty string. Rows of equal doc_id are each
    scanned; an empty table has no rows. Map only: no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, 4 << 20):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, threshold))
                said = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x) for x in (base, spans)]
                kinds = [k for _, k, _ in spans]
                rows.append((doc, *map(kinds.count, range(4)), hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
