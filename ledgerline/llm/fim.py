"""Fill-in-the-middle transformation by secondary sort, in pieces of bounded size.

A text is cut at two places drawn from the document's id; prefix, middle and suffix get a mark each and change places, as
psm (prefix, suffix, middle) or spm (suffix, prefix, middle), or the text stays plain. A text becomes pieces of at most
CHUNK code points, keyed by document and place in the output. repartition by document and sortWithinPartitions by both
keys (the DataFrame form of repartitionAndSortWithinPartitions: one exchange that sorts as it reads) bring them together
in order, so that a task streams them and never holds a text again once it is cut. restore() finds the marks in the
output stream alone, gives each piece its place in the text, and sorts again inside the same partitions: nothing moves.

A row is a document whatever its id: ids may repeat or be null (a null id draws as the empty string does). Null texts
count as empty and stay plain. Texts that hold a mark stay plain, since they could not be told from marked ones. Extra
columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from hashlib import sha256
from json import dumps, loads

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Marks of a form in the order of the output.
FORMS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Place in the text of what follows a mark.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Percent of documents that are transformed, and of those the percent in the form spm.
TRANSFORMED, SPM = 90, 20
#: Code points in a piece; bytes of text in a partition; a number above that of any piece of a text.
CHUNK, PART, MOST = 1 << 16, 16 << 20, 1 << 40
#: Rows and code points that a worker hands on in one go.
BATCH_ROWS, BATCH_CHARS = 1_000, 4 << 20
#: row: a number of the document; head: what is known of it, with its first piece and, in a restored stream, at its end.
PIECES = "row long, place long, head string, piece string"
SEED = 1


@dataclass(frozen=True)
class Head:
    """What is known of a document besides its text."""

    doc_id: int | None
    n: int
    form: str
    prefix: int | None
    middle: int | None


def plan(doc_id: int | None, text: str) -> Head:
    """Form and cuts of a document, drawn from its id."""
    n = len(text)
    digest = sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or any(mark in text for mark in PLACE) or h3 % 100 >= TRANSFORMED:
        return Head(doc_id, n, "plain", None, None)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Head(doc_id, n, "spm" if h4 % 100 < SPM else "psm", low, high - low)


def pieces(row: int, doc_id: int | None, text: str) -> Iterator[tuple]:
    """(row, place in the output, head, piece): the head goes with the first piece."""
    head = plan(doc_id, text)
    if head.form == "plain":
        parts = [("", 0, head.n)]
    else:
        low, high = head.prefix, head.prefix + head.middle
        where = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, head.n)}
        parts = [(mark, *where[mark]) for mark in FORMS[head.form]]
    place = 0
    for mark, start, end in parts:
        for at in range(start, max(end, start + 1), CHUNK):
            yield row, place, None if place else dumps(asdict(head)), (mark if at == start else "") + text[at : min(end, at + CHUNK)]
            place += 1


def batched(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows whose last value is a text, in frames of bounded size."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1] or "")
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pd.DataFrame(held, columns=columns)
            held, chars = [], 0
    yield pd.DataFrame(held, columns=columns)


def streamed(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames:
        yield from frame.itertuples(index=False, name=None)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def assemble(docs: DataFrame) -> DataFrame:
    """row, place, head, piece: the pieces of the outputs, a document's in one partition and in order."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").cast("string").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents = ((row, None if doc_id is None else int(doc_id), text) for row, doc_id, text in streamed(frames))
        return batched((p for one in documents for p in pieces(*one)), names(PIECES))

    return rows.mapInPandas(cut, PIECES).repartition(common.parts(rows, PART), "row").sortWithinPartitions("row", "place")


def by_document(stream: Iterable[tuple]) -> Iterator[tuple[int, Head, Iterator[str]]]:
    """row, head and pieces of one document after the other. The pieces must be taken before the next document."""
    stream = iter(stream)
    following = next(stream, None)
    while following is not None:
        row, head = following[0], Head(**loads(following[2]))

        def own() -> Iterator[str]:
            nonlocal following
            while following is not None and following[0] == row:
                yield following[3]
                following = next(stream, None)

        yield row, head, own()


def texts(assembled: DataFrame) -> DataFrame:
    """doc_id, form, output: the whole text of the output in a row, as it came in one."""
    schema = "doc_id string, form string, output string"

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((None if head.doc_id is None else str(head.doc_id), head.form, "".join(own)) for _, head, own in by_document(streamed(frames)))
        return batched(rows, names(schema))

    return assembled.mapInPandas(join, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def unmarked(form: str, stream: Iterable[str]) -> Iterator[tuple[int, str]]:
    """(place in the text, piece) from the pieces of an output, of which only the form is known; marks may lie across pieces."""
    due, place, rest = list(FORMS[form]), 0, ""
    for piece in stream:
        rest += piece
        while due and (at := rest.find(due[0])) >= 0:
            if at:
                yield place, rest[:at]
            place, rest = PLACE[due[0]], rest[at + len(due[0]) :]
            del due[0]
        keep = len(due[0]) - 1 if due else 0  # may be the beginning of a mark
        if len(rest) > keep:
            yield place, rest[: len(rest) - keep]
            rest = rest[len(rest) - keep :]
    if rest:
        yield place, rest


def restore(assembled: DataFrame) -> DataFrame:
    """The pieces in the order of the text; at each document's end its head, with the digest of the output as piece."""

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for row, head, own in by_document(streamed(frames)):
            digest, counts = sha256(), [0, 0, 0]

            def read() -> Iterator[str]:
                for piece in own:
                    digest.update(piece.encode())
                    yield piece

            for place, piece in unmarked(head.form, read()):
                yield row, place * MOST + counts[place], None, piece
                counts[place] += 1
            yield row, 3 * MOST, dumps(asdict(head)), digest.hexdigest()

    found = assembled.mapInPandas(lambda frames: batched(placed(frames), names(PIECES)), PIECES)
    return found.sortWithinPartitions("row", "place")


def digests(assembled: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it."""
    schema = "head string, output_sha256 string, restored_sha256 string"

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        restored = sha256()
        for _, _, head, piece in streamed(frames):
            if head is None:
                restored.update(piece.encode())
                continue
            yield head, piece, restored.hexdigest()
            restored = sha256()

    done = restore(assembled).mapInPandas(lambda frames: batched(digest(frames), names(schema)), schema)
    head = F.from_json("head", "doc_id long, n long, form string, prefix long, middle long")
    return done.select(head.alias("h"), "output_sha256", "restored_sha256").select("h.doc_id", "h.n", "h.form", F.col("h.prefix").alias("prefix_chars"), F.col("h.middle").alias("middle_chars"), "output_sha256", "restored_sha256")
