"""Problem 3: cutting oversized texts at natural boundaries, with an overlap.

A text is cut by a hierarchy of separators (section, paragraph, line, sentence, word, character): a span that is still too
long is cut by the next finer separator. The spans are then packed greedily; each piece repeats the last `overlap`
characters of the piece before. The pieces without their overlaps, joined, are exactly the text.

Null, empty and short texts (up to the limit) give no rows; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.session import spread

LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")
#: A cut lies at the end of each match; a section starts at a heading line or after a form feed.
CUTS = (
    re.compile(r"\n(?=#{1,6} )|\f"),
    re.compile(r"\n(?:[ \t\r]*\n)+"),
    re.compile(r"\n"),
    re.compile(r"[.!?][ \t]+"),
    re.compile(r"\s+"),
)
BLANK = " \t\r\n"
PARAGRAPH, LINE, SENTENCE = CUTS[1], CUTS[2], re.compile(r"(?<=[.!?])[ \t]+")


def sufficient_boundary(text: str, limit: int) -> str:
    """The coarsest of paragraph, line and sentence all of whose units fit the limit, or none."""
    long = [u for u in PARAGRAPH.split(text) if len(u) > limit and len(u.strip(BLANK)) > limit]
    if not long:
        return "paragraph"
    long = [u for p in long for u in LINE.split(p) if len(u) > limit and len(u.strip(BLANK)) > limit]
    if not long:
        return "line"
    return "sentence" if all(len(u.strip(BLANK)) <= limit for line in long for u in SENTENCE.split(line)) else "none"


def spans(text: str, start: int, end: int, most: int, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, end, level of the cut at the end) of spans of at most `most` characters that cover start..end."""
    if level == len(CUTS):
        while end - start > most:
            cut = start + most
            while cut > start + 1 and unicodedata.combining(text[cut]):
                cut -= 1
            cut = cut if cut > start + 1 else start + most
            yield start, cut, level
            start = cut
        yield start, end, level
        return
    stops = [m.end() for m in CUTS[level].finditer(text, start, end)]
    for stop in [*(s for s in stops if s < end), end]:
        if stop - start <= most:
            yield start, stop, level
        else:
            yield from spans(text, start, stop, most, level + 1)
        start = stop


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of the pieces of a text; the last piece's kind is `end`."""
    out: list[tuple[int, int, str]] = []
    begin, fill, kind = 0, 0, 0
    for start, end, level in spans(text, 0, len(text), limit - overlap):
        if end - begin > limit:
            out.append((begin, fill, LEVELS[kind]))
            begin = max(0, fill - overlap)
        fill, kind = end, level
    return [*out, (begin, fill, "end")]


def split_oversized(docs: DataFrame, limit: int = 2000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, piece_no, start, length, cut, boundary[, piece]) of every text of more than `limit` characters; 0 <= overlap < limit.
    `boundary` is the same in all pieces of a text: the coarsest boundary that suffices by itself. Narrow: no shuffle."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece_no int, start int, length int, cut string, boundary string" + ", piece string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                boundary = sufficient_boundary(text, limit)
                for n, (a, b, cut) in enumerate(pieces(text, limit, overlap)):
                    rows.append((key, n, a, b - a, cut, boundary, *([text[a:b]] if with_text else [])))
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * (6 + with_text)
            names = [id_col, "piece_no", "start", "length", "cut", "boundary", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[: len(columns)])

    long = docs.select(id_col, text_col).where(F.length(text_col) > limit)
    return spread(long).mapInArrow(run, schema)
