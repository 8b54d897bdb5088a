"""Delimited text with line breaks inside quotes, read by splits.

Only quotes tell whether a line break ends a record, and whether a quote opens a field depends on all of the file before
it. But what a line does is a function of one bit, whether the line begins inside quotes; so is what a split does, the
composition of its lines. A first pass over the splits finds these functions, their running composition tells where each
split begins, and a second pass cuts every split into records by itself. Only the record that runs over a split's end
leaves it: the fragments of such records, two a split at most, are joined afterwards.

A field is quoted if it begins with a quote; doubled quotes inside stand for one; what follows the closing quote belongs
to the field up to the separator, as does any other quote. A line break inside quotes becomes "\\n". Records of white
space only are left out. A last record that no quote closes ends with its file. Files without a line give no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTE = '"'


def walk(line: str, inside: bool, sep: str) -> tuple[bool, int]:
    """Does the next line begin inside quotes, if this one does or does not, and how many separators stand outside them?"""
    if QUOTE not in line:
        return inside, 0 if inside else line.count(sep)
    at, start, found = 0, not inside, 0
    while True:
        if start:
            if line.startswith(QUOTE, at):
                at, inside = at + 1, True
            start = False
        if inside:
            end = line.find(QUOTE, at)
            if end < 0:
                return True, found
            at = end + 1
            if line.startswith(QUOTE, at):
                at += 1
                continue
            inside = False
        end = line.find(sep, at)
        if end < 0:
            return False, found
        at, start, found = end + len(sep), True, found + 1


def after(line: str, inside: bool, sep: str) -> bool:
    """Does the next line begin inside quotes, if this one does or does not?"""
    return walk(line, inside, sep)[0]


def effects(lines: DataFrame, sep: str) -> list:
    """A row for each split, in the order of the files, with what its lines make of beginning outside (0) or inside (1) quotes:
    how it ends, and separators: of the record that is open at its start and closed in it (none closed: null), at most of one
    record closed after that, and of what is open at its end."""

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], list[list]] = {}
        for frame in frames:
            for file, block, line in zip(frame["_file"], frame["_block"], frame["line"]):
                for own in found.setdefault((file, block), [[False, None, 0, 0], [True, None, 0, 0]]):
                    own[0], more = walk(line, own[0], sep)
                    own[3] += more
                    if not own[0]:
                        if own[1] is None:
                            own[1] = own[3]
                        else:
                            own[2] = max(own[2], own[3])
                        own[3] = 0
        own = pd.DataFrame([(*k, *outside, *inside) for k, (outside, inside) in found.items()], columns=["_file", "_block", *ways])
        yield own.astype({c: "Int64" for c in ways if "ends" not in c})

    ways = [f"{c}{i}" for i in (0, 1) for c in ("ends", "head", "most", "tail")]
    schema = "_file string, _block long, " + ", ".join(f"{c} {'boolean' if 'ends' in c else 'long'}" for c in ways)
    return lines.select("_file", "_block", "line").mapInPandas(compose, schema).orderBy("_file", "_block").collect()


def begun(lines: DataFrame, sep: str) -> tuple[set[tuple[str, int]], int]:
    """The splits that begin inside quotes, and the fields of the widest record. A few numbers a split reach the driver."""
    begins: set[tuple[str, int]] = set()
    state, last, open_, most = False, None, 0, 0
    for r in effects(lines, sep):
        if r._file != last:
            most, state, open_ = max(most, open_), False, 0
        if state:
            begins.add((r._file, r._block))
        ends, head, more, tail = (r[f"{c}{int(state)}"] for c in ("ends", "head", "most", "tail"))
        if head is not None:
            most, open_ = max(most, open_ + head, more), 0
        state, last, open_ = ends, r._file, open_ + tail
    return begins, max(most, open_) + 1


def records(lines: DataFrame, sep: str) -> DataFrame:
    """_file, _block, _id, record from lines (_file, _block, _id, line) as a scan gives them: each split in one partition, in order."""
    return _records(lines, sep, begun(lines, sep)[0])


def _records(lines: DataFrame, sep: str, begins: set[tuple[str, int]]) -> DataFrame:
    """The names of the splits that begin inside quotes go to all tasks."""
    columns = ["_file", "_block", "_id", "part", "record"]

    def cut(frames: Iterator[pd.DataFrame], fragments: bool) -> Iterator[pd.DataFrame]:
        """part: whole; first (goes on in the next split); more (began in an earlier split), closed or not. Fragments, or whole records."""
        split, held, inside, kind = None, [], False, ""
        for frame in frames:
            out = []
            for file, block, number, line in zip(frame["_file"], frame["_block"], frame["_id"], frame["line"]):
                if split != (file, block):
                    if held and fragments:
                        out.append((*split, held[0], "first" if kind == "whole" else "more", "\n".join(held[1:])))
                    split, held, inside = (file, block), [], (file, block) in begins
                    kind = "more closed" if inside else "whole"
                held = held or [number]
                held.append(line)
                inside = after(line, inside, sep)
                if not inside:
                    if fragments == (kind != "whole"):
                        out.append((*split, held[0], kind, "\n".join(held[1:])))
                    held, kind = [], "whole"
            yield pd.DataFrame(out, columns=columns)
        if held and fragments:
            yield pd.DataFrame([(*split, held[0], "first" if kind == "whole" else "more", "\n".join(held[1:]))], columns=columns)

    own, schema = lines.select("_file", "_block", "_id", "line"), "_file string, _block long, _id long, part string, record string"
    whole = own.mapInPandas(lambda frames: cut(frames, False), schema).drop("part")
    number = F.sum(F.when(F.col("part") == "first", 1).otherwise(0)).over(W.partitionBy("_file").orderBy("_block", "_id"))
    fragments = own.mapInPandas(lambda frames: cut(frames, True), schema).withColumn("_of", number)
    joined = fragments.groupBy("_file", "_of").agg(F.sort_array(F.collect_list(F.struct("_block", "_id", "record"))).alias("f"))
    stitched = joined.select("_file", F.col("f")[0]["_block"].alias("_block"), F.col("f")[0]["_id"].alias("_id"), F.array_join("f.record", "\n").alias("record"))
    return whole.unionByName(stitched).where(F.trim("record") != "")


def parsed(lines: DataFrame, sep: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """keep and the fields _c0, _c1 ... of each record, as many as the widest record has, and their names.

    Separators inside quotes make no field: texts with a thousand commas would make each record that wide otherwise.
    """
    begins, width = begun(lines, sep)
    rows = _records(lines, sep, begins)
    names = [f"_c{i}" for i in range(width)]
    options = {"sep": sep, "escape": QUOTE, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, width + 1))}
    fields = F.from_csv("record", ", ".join(f"{c} string" for c in names), options)
    return rows.select(*keep, fields.alias("_f")).select(*keep, *(F.col("_f")[c].alias(c) for c in names)), names
