"""Secret scan: fixed patterns, and novelty of strings under a dictionary-primed zstandard.

Patterns, leftmost and without overlap per kind: ``assign`` (a telling name, then : or =, then six or more characters),
``access`` (AKIA and on, 20 characters at least), ``hex`` (24 hex digits at least). The method adds ``novel``: a long
unbroken string near a sensitive word whose marginal compressed size, given the text around it and a dictionary of
identifiers, comes close to a byte each, as for random characters. Ordinary identifiers and prose compress much
further, so only strings that nothing around them explains are reported.

Spans are code points, end exclusive, in order of start and then of kind. Defined cases: a null or empty text has no
spans; a row with a null id is scanned like any other; a very long text is read whole, in one task; repeated rows and
rows of one id give a result each; other columns play no part.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import free_name, map_arrow, table

KINDS = ("assign", "access", "hex", "novel")
#: fixed values: the patterns of the contract
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: fixed values: names without which ASSIGN can't match, and words that make a context sensitive
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "private key", "bearer", "authorization", "access key", "signature")
SENSITIVE_BYTES = tuple(w.encode() for w in SENSITIVE)
_NEAR = re.compile("|".join(map(re.escape, SENSITIVE)), re.I | re.A)
LEAST = 16
_STRING = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
BEFORE, AROUND, NOVEL = 64, 512, 0.9


#: fixed values: parts of identifiers, from which the dictionary is made
PARTS = (
    "abstract account action active address admin agent allow app argument array async attribute auth backup base batch block body bool buffer build byte cache call callback certificate channel check class client close "
    "cloud code collection column command commit compare component config configuration connect connection const constant container content context control convert cookie copy count create credential current cursor data database date "
    "debug decode default delete deploy description device directory disable document domain download driver duration element email enable encode encrypt endpoint engine entry environment error event exception execute exit export expression "
    "extension factory field file filter find format frame function generate global graph group handle handler hash header host identifier image implementation import include index info initialize input insert instance integer interface "
    "internal item iterator json keyword label language layout length level library limit line list listener load local location lock log logger login manager map match message metadata method migration mode model module name namespace network node"
).split()


#: fixed values: parts of identifiers from n on, and words of prose and of comments
MORE_PARTS = (
    "notification number object offset operation option order output owner package page parameter parent parse partition path pattern payload permission pipeline platform plugin pointer policy pool port position prefix print priority "
    "private process profile project property protocol provider proxy public query queue random range record redirect reference region register registry release remote remove render replace report repository request require reset resource "
    "response result retry return role root route row rule runtime sample scale schedule schema scope script search section select sequence serialize server service session setting shape share signal size socket sort source span stack "
    "standard start state static status step storage store stream string structure style submit success suffix summary support switch symbol sync system table tag target task team template tenant test text thread threshold time timeout title "
    "trace transaction transform tree trigger type unit update upload url user util valid value variable vector version view volume warning widget window worker workspace write zone"
).split()
PROSE = "the of and to in is that for it as was with be by on not but at are this have from or had an they which one you were all there would their we been has when who will more if out so what about into than them can only other new some could these two may then do first any my now such like our over me even most made after also did many before must through years where much your way well down should because each just those people how too little good very make still own see here work long get between both under never same another know while last might us great old year off come since against go came right used take three".split()


def _dictionary() -> bytes:
    """Identifiers as code has them: parts alone and joined in three styles, words of prose, alphabets, sensitive words. The same on every machine."""
    parts = [*PARTS, *MORE_PARTS]
    neighbours = list(zip(parts, parts[7:] + parts[:7], strict=True))
    runs = f"{string.ascii_uppercase}{string.digits}{string.ascii_lowercase}0123456789abcdef9876543210"
    joined = ["_".join(parts), " ".join(f"{a}_{b}" for a, b in neighbours), " ".join(f"{a}{b.capitalize()}" for a, b in neighbours), "".join(p.capitalize() for p in parts), "_".join(parts).upper(), " ".join(PROSE)]
    return "\n".join([*joined, runs, *SENSITIVE]).encode()


_COMPRESSOR: list = []


def marginal_bytes(around: str, text: str) -> int:
    """Compressed bytes that `text` adds to the text around it, under the identifier dictionary."""
    if not _COMPRESSOR:
        words = _dictionary()
        how = zstandard.ZstdCompressionParameters.from_level(12, source_size=2 * AROUND, dict_size=len(words), min_match=5, write_checksum=False, write_content_size=False)  # shorter matches occur by chance
        _COMPRESSOR.append(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
    size = lambda t: len(_COMPRESSOR[0].compress(t.encode("utf-8", "surrogatepass")))
    return size(around + text) - size(around)


def is_novel(around: str, text: str) -> bool:
    """Random characters cost a byte each in so short a text; what the dictionaries explain costs far less."""
    return marginal_bytes(around, text) >= NOVEL * len(text)


def base_spans(text: str, raw: bytes, lower: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the patterns; raw and lower: the text in UTF-8, and with A-Z lower-cased."""
    spans = []
    if any(n in lower for n in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"h" * HEX_LEAST in raw.translate(_HEX_MAP):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(spans)


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings that begin or end within BEFORE characters of a sensitive word; one that holds such words, from its first on and piece by piece."""
    near = [m.span() for m in _NEAR.finditer(text)]
    starts, ends = [a for a, _ in near], [b for _, b in near]
    for m in _STRING.finditer(text):
        a, b = m.span()
        i, j = bisect_left(starts, a), bisect_right(ends, b)  # the words in near[i:j] lie in the string
        if i >= j:
            if (i and a - ends[i - 1] <= BEFORE) or (i < len(starts) and starts[i] - b <= BEFORE):
                yield a, b
            continue
        if i and a - ends[i - 1] <= BEFORE:
            yield a, b
        yield ends[i], b
        for x, y in zip([a, *ends[i:j]], [*starts[i:j], b], strict=True):
            yield x, y


def novel_spans(text: str, lower: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings near a sensitive word, on either side, but for those in base spans."""
    if not any(w in lower for w in SENSITIVE_BYTES):
        return []
    spans: list[tuple[int, int, int]] = []
    for a, b in _candidates(text):
        if b - a < LEAST or any(x < b and a < y for x, _, y in spans[-2:]):
            continue
        if not any(x < b and a < y for x, _, y in base) and is_novel(text[max(0, a - AROUND) : a] + text[b : b + AROUND], text[a:b]):
            spans.append((a, 3, b))
    return spans


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text: (start, kind's number, end), sorted."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower()
    base = base_spans(text, raw, lower)
    return sorted(base + novel_spans(text, lower, base))


def secrets(docs: DataFrame, *, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """docs with a column of spans (kind, start, end); its name gets underscores in front until it is free. No shuffle."""
    name = free_name(docs, name)

    def run(batch: pa.RecordBatch) -> list:
        return [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]]

    return map_arrow(docs, run, f"`{name}` array<struct<kind:string,start:int,end:int>>", keep=True)


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text_col replaced by a mark."""

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for a, _, b in scan(text):
            if b > at:
                out += [text[at:a], mark] if a >= at else []
                at = b
        return text if not at else "".join(out) + text[at:]

    new = free_name(docs, "redacted")
    got = map_arrow(docs, lambda b: [[clean(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]], f"`{new}` string", keep=True)
    return got.select([F.col(f"`{new}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    s = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), name="s")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("s", lambda x: x["kind"] != "novel")
    return s.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"), count("novel"))
