"""License notices with bounded edits (operator 2).

A notice matches where a stretch of the text is within ``k`` edits (insertions, deletions, substitutions) of it, after
lower-casing. By the pigeonhole principle one of ``k + 1`` pieces of the notice is then there unchanged: an Aho-Corasick
automaton over all pieces of all notices finds these seeds in one pass, each seed gives the window in which its notice can
lie, windows that touch are joined, and bounded-error regular expressions verify the edits and report spans. Matches of a
notice don't overlap: they are reported from the left.

Scale: a map over the scan, one automaton a task; no shuffle, no state. Cost follows the text, and windows are rare because
every piece has at least four characters.

Edge cases: null and empty texts give no rows; a null id is kept; repeated rows give repeated results; texts are searched
whole, whatever their length; two notices may report the same stretch; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (name, licence class, notice, edits)
NOTICES = (
    ("agpl", "copyleft", "licensed under the GNU Affero General Public License", 5),
    ("gpl", "copyleft", "licensed under the GNU General Public License", 4),
    ("lgpl", "copyleft", "licensed under the GNU Lesser General Public License", 5),
    ("gpl_3", "copyleft", "GNU General Public License, version 3", 3),
    ("gpl_2", "copyleft", "GNU General Public License, version 2", 3),
    ("mpl_2", "copyleft", "Mozilla Public License, version 2.0", 3),
    ("apache_2", "permissive", "Licensed under the Apache License, Version 2.0", 4),
    ("mit", "permissive", "Released under the MIT License", 3),
    ("mit_grant", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy", 6),
    ("bsd", "permissive", "Redistribution and use in source and binary forms, with or without modification", 6),
    ("cc_by_nc", "noncommercial", "Licensed under CC BY-NC 4.0", 2),
    ("cc_by_sa", "copyleft", "Licensed under CC BY-SA 4.0", 2),
    ("cc_by", "permissive", "Licensed under CC BY 4.0", 2),
    ("cc_zero", "permissive", "CC0 1.0 Universal", 1),
    ("reserved", "proprietary", "All rights reserved", 2),
    ("public_domain", "permissive", "dedicated to the public domain", 3),
)


def lower(text: str) -> str:
    """Lower case of the same length, so that offsets hold."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(y if len(y := x.lower()) == 1 else x for x in text)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of about equal length, with their places."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def _machine(notices: tuple) -> tuple[ahocorasick.Automaton, list]:
    found: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (_, _, notice, k) in enumerate(notices):
        n = lower(notice)
        if len(n) < 4 * (k + 1):
            raise ValueError(f"{notice!r} is too short for {k} edits: its pieces need four characters")
        for at, piece in pieces(n, k):
            found.setdefault(piece, []).append((i, at))
        patterns.append((len(n), k, regex.compile(f"(?e)(?:{regex.escape(n, special_only=True, literal_spaces=True)}){{e<={k}}}")))
    a = ahocorasick.Automaton()
    for piece, where in found.items():
        a.add_word(piece, (len(piece), where))
    a.make_automaton()
    return a, patterns


def scan(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """``(notice, start, end, edits)`` of every match in ``text``."""
    machine, patterns = _machine(notices)
    low = lower(text)
    windows: dict[int, list[list[int]]] = {}
    for last, (size, where) in machine.iter(low):
        first = last - size + 1
        for i, at in where:
            n, k, _ = patterns[i]
            a, b = max(0, first - at - k), min(len(low), first - at + n + k)
            own = windows.setdefault(i, [])
            if own and a <= own[-1][1]:
                own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
            else:
                own.append([a, b])
    out = []
    for i, own in windows.items():
        own.sort()
        joined: list[list[int]] = []
        for a, b in own:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        for a, b in joined:
            for m in patterns[i][2].finditer(low, a, b):
                if m.end() > m.start():
                    out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _scan(notices: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    for i, a, b, edits in scan(text, notices):
                        for column, x in zip(rows, (doc, notices[i][0], notices[i][1], a, b, edits, text[a:b])):
                            column.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], ["doc_id", "notice", "license_class", "start", "stop", "edits", "matched"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """``(doc_id, notice, license_class, start, stop, edits, matched)``, one row a match; places count characters from 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, notice string, license_class string, start int, stop int, edits int, matched string"
    return rows.mapInArrow(_scan(tuple(notices)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
