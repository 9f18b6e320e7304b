"""Licenses in texts: exact phrases, and short notices with a few edits.

Texts are lower-cased (A-Z) and become words parted by single spaces. A phrase of the base is found where its words stand
consecutively. A notice may be damaged by up to `edits` insertions, deletions or substitutions: it is split into one
piece more than that, so one piece at least is intact (the pigeonhole principle). One Aho-Corasick pass finds all pieces;
around each, the `regex` library verifies the notice with bounded errors, at word bounds, and gives the edits. So only
places that hold a piece are verified, and none within the bound is missed.

Spans are (label, first word, last word, edits). The score is 1 for an exact phrase, else the best share of a notice's
characters that stand unedited, 0 without any. Notices and bounds are parameters. One scan of each text in one stage, no shuffle.

Null texts are empty. Repeated rows get their own result. Very long texts are scanned whole. An empty table gives an
empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base's phrases and labels
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_OTHER = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Notice(NamedTuple):
    label: str
    text: str
    edits: int


#: Short notices in words as above, each with its own bound of about a tenth of its length.
NOTICES = (
    Notice("gpl", "gnu general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license", 3),
    Notice("apache", "apache license version 2 0", 2),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl", "mozilla public license", 2),
)
SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())])


def words_of(text: str) -> str:
    """The words of a text in small letters, parted and enclosed by single spaces; one space if there are none."""
    inner = _OTHER.sub(" ", text.translate(_LOWER)).strip(" ")
    return f" {inner} " if inner else " "


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 parts of about the same length; any match within the bound holds one intact."""
    n, k = len(notice.text), notice.edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=8)
def _machine(notices: tuple[Notice, ...]):
    """Automaton of all pieces, a fuzzy pattern for each notice, and its patterns for each number of edits."""
    import ahocorasick
    import regex

    found, machine = {}, ahocorasick.Automaton()
    for i, n in enumerate(notices):
        for offset, piece in pieces(n):
            found.setdefault(piece, []).append((i, offset))
    for piece, where in found.items():
        machine.add_word(piece, (len(piece), where))
    machine.make_automaton()
    body = [regex.escape(n.text, special_only=True, literal_spaces=True) for n in notices]
    search = [regex.compile(rf"(?e)(?<= )(?:{x}){{e<={n.edits}}}(?= )") for x, n in zip(body, notices, strict=True)]
    exact = [[regex.compile(f"(?:{x}){{e<={k}}}") for k in range(n.edits + 1)] for x, n in zip(body, notices, strict=True)]
    return machine, search, exact


def base_places(words: str) -> list[tuple[int, str]]:
    """(place in words, label) of the base's phrases, every one."""
    out = []
    for phrase, label in BASE:
        needle, at = f" {phrase} ", words.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = words.find(needle, at + 1)
    return sorted(out)


def fuzzy_places(words: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of places in words that a notice fits with at most its edits, those of a notice apart."""
    machine, search, exact = _machine(notices)
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, (size, where) in machine.iter(words):
        for i, offset in where:
            a = max(0, end + 1 - size - offset - notices[i].edits)
            b = min(a + len(notices[i].text) + 2 * notices[i].edits, len(words) - 1)
            # to the spaces on both sides, so that word bounds are real ones
            windows.setdefault(i, []).append((max(0, words.rfind(" ", 0, a + 1)), words.find(" ", b)))
    for i, spans in windows.items():
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        windows[i] = merged
    out = []
    for i, spans in windows.items():
        for a, b in spans:
            for m in search[i].finditer(words, a, b + 1):
                edits = next(k for k, p in enumerate(exact[i]) if p.fullmatch(words, m.start(), m.end()))
                out.append((i, m.start(), m.end(), edits))
    return out


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, places, spans) of each row: places are (word, label) of the base's phrases, spans (label, first,
    last, edits, similarity) of notices found with edits or without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, places, spans = [], [], []
            for x in b.column(1):
                words = words_of(x.as_py() or "")
                n.append(words.count(" ") - 1)
                base, fuzzy = base_places(words), fuzzy_places(words, notices)
                ends = [m.start() for m in re.finditer(" ", words)] if base or fuzzy else []
                word = lambda at: bisect_right(ends, at) - 1  # noqa: E731, B023
                places.append([{"word": word(at), "label": label} for at, label in base])
                spans.append([{"label": notices[i].label, "first": word(s), "last": word(e - 1), "edits": k, "similarity": 1 - k / len(notices[i].text)} for i, s, e, k in fuzzy])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "n_words", "places", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, places array<struct<word:long,label:string>>, spans array<struct<label:string,first:long,last:long,edits:int,similarity:double>>")


def labels(found: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(found)), ",")


def find_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, places, spans, base_labels, labels, score) of each row."""
    rows = scan(docs, notices)
    best = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0)))
    return rows.select("*", labels(F.col("places.label")).alias("base_labels"), labels(F.concat("places.label", "spans.label")).alias("labels"), best.alias("score"))
