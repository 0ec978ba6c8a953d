"""Secret scans: fixed patterns, and zstandard novelty primed with dictionaries.

Patterns find assigned values, access keys and long hexadecimal runs. The novelty method
then looks at every further string in a sensitive context (a word such as ``key`` or
``bearer`` shortly before): a compressor primed with a dictionary of common identifiers
compresses ordinary text and the text around the candidate, without and with the candidate
at its end. The difference is what the candidate adds; it is a whole number of bytes and
depends on what stands there, so it is measured in several surroundings and the mean is
taken. Words that the surroundings or the dictionary hold become matches, and other words are
spelt in the letters that the text is made of, so they add little; a random string adds
nearly a byte or more for each character. How many bytes are asked for depends on the length
and on the letters: a bound for each kind is set so that of ordinary words, compound names
and names with numbers of that kind and length about one in fifty is above it.

Defined results: a null or empty text has no spans; positions are code points of the
whole text, end exclusive; a candidate that a base span holds whole is not reported again,
one that goes beyond a base span is if the rest of it is novel, and both stay; spans that start
together are in the order of their kinds; very long texts are scanned whole; repeated rows give repeated results;
other columns are kept by :func:`redact` and ignored by :func:`scan`; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
#: Kinds in the order that breaks ties between equal starts.
KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words after which a string may be a secret.
_SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|credential|authorization|bearer|signature)", re.ASCII | re.IGNORECASE)
#: Runs of token characters, and dotted groups of them.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
#: Identifiers that code and configuration use everywhere.
IDENTIFIERS = (
    "access account address api application array authorization authentication base64 bearer boolean buffer bytes client "
    "config configuration connection content context cookie count credential data database default digest document "
    "domain element encode endpoint environment error event export false file filename format function hash header hex "
    "host http https id identifier image import index input integer interface json key label length level license "
    "list local log login main message method model module name namespace null number object option output package "
    "parameter parse password path port private property protocol public query random read request resource response "
    "result return role schema secret select server service session sha256 signature source start state static status "
    "string style system table target template test text time timestamp title token true type update url user username "
    "utf-8 uuid value variable version void window write www"
)
#: Ordinary text whose letters a candidate's are measured against where it has few surroundings.
ORDINARY = (
    "if the connection was closed before all of the data were sent, then open it again and try once more; the caller should not have to know about this. "
    "def load_settings(self, folder, name): values = read_lines(folder / name); return {key.strip(): text for key, text in values if not key.startswith('#')} "
    "For each of the tables we first count the rows and then write a short summary to the journal, which will be kept for about thirty days or until it is removed by hand. "
    "public void setTimeout(long millis) { this.millis = millis; notifyListeners(); } The quick, exact way of doing so needs 2 or 3 steps, such as (1) and (2) below.\n"
)
#: Surroundings that a candidate is measured in: code points before and after it, and the part of the ordinary text.
SURROUNDINGS = ((1024, 1024, ORDINARY), (2048, 0, ORDINARY), (0, 1500, ORDINARY), (300, 300, ORDINARY), (100, 800, ORDINARY))
SURROUNDINGS += ((1500, 0, ORDINARY[: len(ORDINARY) // 2]), (512, 512, ORDINARY[len(ORDINARY) // 2 :]), (800, 100, ORDINARY[len(ORDINARY) // 2 :]))
#: Code points after a sensitive word, or after the end of a reported string, in which a candidate may start.
REACH = 64
#: Bytes that a candidate must add for each character, and once, by its kind: letters of one case, these with digits,
#: letters of both cases, and hardly any letters (dates and numbers are the ordinary ones there).
BOUNDS = {"letters": (0.60, 1.45), "digits": (0.62, 2.9), "cases": (0.78, 2.2), "numbers": (0.80, 8.0)}
#: Bytes more for each sign between the words of a name.
JOINED = 0.8
#: Shorter strings cannot be told from words.
LEAST = 8


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False)


def kind_of(candidate: str) -> str:
    """Which ordinary strings a candidate must be told from."""
    letters = sum(c.isalpha() for c in candidate)
    if letters <= 2 or 5 * letters < len(candidate):
        return "numbers"
    if candidate != candidate.upper() and candidate != candidate.lower():
        return "cases"
    return "digits" if any(c.isdigit() for c in candidate) else "letters"


def added(text: str, start: int, end: int, candidate: str) -> float:
    """Compressed bytes that a candidate adds at ``text[start:end]``, as the mean over several surroundings; capitals alone count as small letters."""
    candidate = (candidate.lower() if candidate == candidate.upper() else candidate).encode()
    compress, total = _compressor().compress, 0
    for before, after, ordinary in SURROUNDINGS:
        around = f"{ordinary}{text[max(0, start - before) : start]}\n{text[end : end + after]}\n".encode("utf-8", "surrogatepass")
        total += len(compress(around + candidate)) - len(compress(around))
    return total / len(SURROUNDINGS)


def _novel(text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether a candidate is novel; what a base span in it holds is one already and isn't measured again."""
    kept, at = [], start
    for begin, _, stop in base:
        if begin >= end:
            break
        if stop > at:
            kept.append(text[at : max(at, begin)])
            at = stop
    rest = "".join(kept) + text[at:end]
    if len(rest) < LEAST:
        return False
    each, once = BOUNDS[kind_of(rest)]
    signs = sum(not c.isalnum() for c in rest)
    return added(text, start, end, rest) > once + each * len(rest) + JOINED * signs


def find(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, kind's index, end) of one text, sorted."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base, done = sorted(spans), 0
    base_ends = list(accumulate((end for _, _, end in base), max))
    for word in _SENSITIVE.finditer(text):
        # the word itself may be the start of a longer run
        at, limit = max(word.end(), done), word.end() + REACH
        while (m := _CANDIDATE.search(text, at)) and m.start() <= limit:
            start, end = m.span()
            at = done = end
            before = bisect_right(base, (start, len(KINDS)))  # base spans that start at the candidate's start or before
            if (not before or base_ends[before - 1] < end) and _novel(text, start, end, base):
                spans.append((start, 3, end))
                limit = end + REACH
    return sorted(spans)


@F.arrow_udf(SPANS)
def spans_of(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(_SPAN))


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array, mark: pa.Array) -> pa.Array:
    out = []
    for text, by in zip(texts.to_pylist(), mark.to_pylist(), strict=True):
        if text is not None:
            kept, at = [], 0
            for start, _, end in find(text):
                if start >= at:
                    kept += [text[at:start], by]
                at = max(at, end)
            text = "".join(kept) + text[at:]
        out.append(text)
    return pa.array(out, pa.string())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)``: the secrets of each row's whole text."""
    return df.select(F.col(id_col), spans_of(F.col(text_col)).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with each secret replaced by a mark; nulls stay null."""
    return df.withColumn(text_col, _redacted(F.col(text_col), F.lit(mark)))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
