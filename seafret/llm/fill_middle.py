"""Fill-in-middle transformation: chunks of documents sorted into the order of the output, digested as they stream by.

A text is a sequence of units (`[A-Za-z]+|[^A-Za-z]`, left to right). Hashes of a salted id choose two cuts and a form. Each
row becomes pieces of at most `CHUNK` bytes, keyed by row and by their place in the output; one exchange by row with a sort
inside its partitions (the DataFrame form of repartitionAndSortWithinPartitions, so that rows stay in the JVM and spill there)
lets one task read every output from its first to its last byte. For restoration the same partitions are sorted again, by the
places that sentinels and form give: no second exchange.

Null counts as empty. A null id is hashed as the empty string after the salt. Repeated rows are told apart by a number given to
each row, so each gives its own output; an empty table gives an empty result; other columns are not read. A very long text is
cut into chunks in the scan and never joined again unless whole outputs are asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seafret.llm.common import text_of

#: Sentinels of prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SALT = "1"
#: Of 100 texts so many keep their form; of 100 others so many start with the suffix.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Bytes of a piece.
CHUNK = 1 << 15
#: Order of the segments in the output of a form.
ORDERS = {"plain": ((b"", "prefix"),), "psm": ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")), "spm": ((SUFFIX, "suffix"), (PREFIX, "prefix"), (MIDDLE, "middle"))}
#: Where a segment starts in the sort key of the original text.
RANKS = {"prefix": 0, "middle": 1, "suffix": 2}

PIECES = "row_id long, doc_id long, n long, form string, prefix_chars long, middle_chars long, place long, piece binary"
#: Place of the row that carries the digest of an output through the second sort.
HEADER = -1


def unit_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text start."""
    b = np.frombuffer(text, np.uint8)
    small = b | 0x20
    letter = (small >= ord("a")) & (small <= ord("z")) & (b < 0x80)
    inside = (b & 0xC0) == 0x80
    inside[1:] |= letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def hashes(doc_id: int | None, salt: str = SALT) -> list[int]:
    hexed = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]


def plan(doc_id: int | None, text: bytes, salt: str = SALT) -> tuple[int, str, int, int]:
    """Units, form and the byte offsets at which prefix and middle end."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = hashes(doc_id, salt)
    if not n or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", len(text), len(text)
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (len(text) if c == n else int(starts[c]) for c in cuts)
    return n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", first, second


def chunks(text: bytes, size: int) -> Iterator[bytes]:
    for i in range(0, len(text), size):
        yield text[i : i + size]


def _cut(salt: str, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(PIECES)
        for batch in batches:
            texts = batch.column(2)
            for i, (row, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = texts[i].as_py()
                n, form, first, second = plan(doc, text, salt)
                parts = {"prefix": text[:first], "middle": text[first:second], "suffix": text[second:]}
                chars = (None, None) if form == "plain" else (code_points(parts["prefix"]), code_points(parts["middle"]))
                place = 0
                for mark, name in ORDERS[form]:
                    # a sentinel is the start of its segment's first piece
                    pieces = list(chunks(parts[name], size)) or [b""]
                    pieces[0] = mark + pieces[0]
                    for piece in pieces:
                        out.add((row, doc, n, form, *chars, place, piece), len(piece))
                        place += 1
                        if out.full():
                            yield out.batch()
        if out.rows:
            yield out.batch()

    return run


class _Rows:
    """Rows gathered into record batches of bounded bytes."""

    LIMIT = 1 << 22

    def __init__(self, ddl: str):
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        self.schema = pa.schema([(c, types[t]) for c, t in (f.split() for f in ddl.split(", "))])
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size + 64

    def full(self) -> bool:
        return self.bytes >= self.LIMIT

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return made


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        # a piece is turned into Python bytes when its turn comes
        for i in range(0, len(batch), 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 256).columns))


def _read_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams outputs in order: digests each, and gives its pieces the places of the original text.

    Segments are told by the sentinels met in the output, as a reader of the output would; a row's pieces
    go on at once and its digest follows as a header.
    """
    out = _Rows(PIECES)
    row, digest, last, part, at = None, None, None, 0, 0

    def header() -> None:
        out.add((*last[:6], HEADER, digest.hexdigest().encode()))

    for got in _rows(batches):
        if got[0] != row:
            if row is not None:
                header()
            row, digest, part, at = got[0], hashlib.sha256(), 0, 0
        last, piece = got, got[7]
        digest.update(piece)
        if got[3] != "plain":
            name = next((n for mark, n in ORDERS[got[3]] if piece.startswith(mark)), None)
            if name is not None:
                part, at, piece = RANKS[name], 0, piece[3:]
        out.add((*got[:6], (part << 40) + at, piece), len(piece))
        at += 1
        if out.full():
            yield out.batch()
    if row is not None:
        header()
    if out.rows:
        yield out.batch()


DIGESTS = "row_id long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _read_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams originals in order behind their header and digests them."""
    out = _Rows(DIGESTS)
    head, digest = None, None
    for got in _rows(batches):
        if got[6] == HEADER:
            if head is not None:
                out.add((*head[:6], head[7].decode(), digest.hexdigest()))
                if out.full():
                    yield out.batch()
            head, digest = got, hashlib.sha256()
        else:
            digest.update(got[7])
    if head is not None:
        out.add((*head[:6], head[7].decode(), digest.hexdigest()))
    if out.rows:
        yield out.batch()


def pieces(docs: DataFrame, salt: str = SALT, chunk: int = CHUNK) -> DataFrame:
    """row_id, doc_id, n, form, prefix_chars, middle_chars, place, piece: the output of every row in chunks, in no order."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().cast("binary").alias("text"),
    )
    return rows.mapInArrow(_cut(salt, chunk), PIECES)


def assembled(cut: DataFrame) -> DataFrame:
    """All pieces of a row in one partition and in the order of its output."""
    return cut.repartition("row_id").sortWithinPartitions("row_id", "place")


def digests(docs: DataFrame, salt: str = SALT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row; no text is ever whole."""
    streamed = assembled(pieces(docs, salt, chunk)).mapInArrow(_read_output, PIECES)
    restored = streamed.sortWithinPartitions("row_id", "place").mapInArrow(_read_restored, DIGESTS)
    return restored.drop("row_id")


def _whole(ddl: str, keep: Callable[[tuple], tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(ddl)
        last, parts = None, []
        for got in _rows(batches):
            if last is not None and got[0] != last[0]:
                text = b"".join(parts)
                out.add((*keep(last), text.decode("utf-8")), len(text))
                parts = []
                if out.full():
                    yield out.batch()
            last = got
            parts.append(got[7])
        if last is not None:
            out.add((*keep(last), b"".join(parts).decode("utf-8")))
        if out.rows:
            yield out.batch()

    return run


OUTPUTS = "row_id long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, salt: str = SALT, chunk: int = CHUNK) -> DataFrame:
    """row_id, doc_id, n, form, prefix_chars, middle_chars, output: whole output texts, for training."""
    return assembled(pieces(docs, salt, chunk)).mapInArrow(_whole(OUTPUTS, lambda r: r[:6]), OUTPUTS)


RESTORED = "row_id long, doc_id long, text string"


def restore(outputs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """row_id, doc_id, text rebuilt from row_id, doc_id, form, output of `transform` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(PIECES)
        for batch in batches:
            for i, (row, doc, form) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                for place, piece in original_places(form, batch.column(3)[i].as_py(), chunk):
                    out.add((row, doc, None, form, None, None, place, piece), len(piece))
                    if out.full():
                        yield out.batch()
        if out.rows:
            yield out.batch()

    rows = outputs.select("row_id", "doc_id", "form", F.col("output").cast("binary"))
    return assembled(rows.mapInArrow(run, PIECES)).mapInArrow(_whole(RESTORED, lambda r: r[:2]), RESTORED)


def original_places(form: str, output: bytes, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Pieces of an output with their places in the original text."""
    marks = [(output.index(mark) if mark else 0, mark, name) for mark, name in ORDERS[form]]
    ends = [m[0] for m in marks[1:]] + [len(output)]
    for (start, mark, name), end in zip(marks, ends):
        for at, piece in enumerate(list(chunks(output[start + len(mark) : end], chunk)) or [b""]):
            yield (RANKS[name] << 40) + at, piece
