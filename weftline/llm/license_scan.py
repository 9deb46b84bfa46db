"""License scans: phrases exactly, short notices with a bounded number of edits.

The text is lower-cased (A-Z), cut into words and joined again with single blanks. Base labels
come from phrases whose words stand consecutively. Notices are searched with up to k edits: a
notice is split into k + 1 pieces, so a place with at most k edits holds one piece unchanged
(pigeonhole). Aho-Corasick finds all pieces of all notices in one pass; around each hit, the
regex library's bounded-error matching verifies the notice and gives its span and edits.

Cases: a null or empty text has no words, no labels and score 0; ids and other columns don't
matter; long texts are scanned whole; each row has its own result.
"""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_columns

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Short notices, their labels and the edits (characters) that a match may have.
NOTICES = (
    ("licensed under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "all-rights-reserved", 2),
)

_WORDS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.lower() changes A-Z alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORDS).split()


def pieces_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of about the same length, with their places."""
    n = len(notice)
    cuts = [round(i * n / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.cache
def _searcher(notices: tuple[tuple[str, str, int], ...]):
    machine = ahocorasick.Automaton()
    by_piece: dict[str, list[tuple[int, int]]] = {}
    for which, (notice, _, edits) in enumerate(notices):
        for at, piece in pieces_of(notice, edits):
            by_piece.setdefault(piece, []).append((which, at))
    for piece, where in by_piece.items():
        machine.add_word(piece, (len(piece), tuple(where)))
    machine.make_automaton()
    # no neighbour of a match may be part of a word; the first match counts, with its edits made few
    # (a search for the best match would leave out the ones before it)
    patterns = [
        regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?![^ ])")
        for notice, _, edits in notices
    ]
    return machine, patterns


def fuzzy_spans(joined: str, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> list[tuple[str, int, int, int]]:
    """All matches as (label, start, end, edits) in the joined words, at most one for each place and notice."""
    machine, patterns = _searcher(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (length, where) in machine.iter(joined):
        for which, at in where:
            notice, _, edits = notices[which]
            begin = end + 1 - length - at
            low, high = max(0, begin - 2 * edits - 1), begin + len(notice) + 2 * edits + 1
            spans = windows.setdefault(which, [])
            if spans and low <= spans[-1][1]:
                spans[-1][0], spans[-1][1] = min(low, spans[-1][0]), max(high, spans[-1][1])
            else:
                spans.append([low, high])
    found = []
    for which, spans in windows.items():
        for low, high in spans:
            low = joined.rfind(" ", 0, low) + 1 if low else 0
            for m in patterns[which].finditer(joined, low, min(len(joined), high)):
                found.append((notices[which][1], m.start(), m.end(), sum(m.fuzzy_counts)))
    return found


def words_before(joined: str, places: list[int]) -> list[int]:
    """How many words end before each place, with one pass over the text however many places there are."""
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += joined.count(" ", at, place)
        out[place], at = n, place
    return [out[p] for p in places]


def scan_text(text: str | None, phrases: dict[str, str], notices: tuple) -> dict:
    """What one text holds."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # the word k follows blanks[k]
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            starts.append(int(np.searchsorted(blanks, at)))
            base.add(label)
            at = line.find(needle, at + 1)
    joined = line[1:-1].decode("utf-8", "surrogatepass")
    spans = fuzzy_spans(joined, notices) if words else []
    close = max((1 - edits / max(1, end - start) for _, start, end, edits in spans), default=0.0)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s[0] for s in spans})),
        "score": 1.0 if base else max(0.0, close),
        "spans": [
            {"label": a, "start_word": k, "n_words": len(joined[s:e].split(" ")), "edits": edits}
            for (a, s, e, edits), k in zip(spans, words_before(joined, [x[1] for x in spans]), strict=True)
        ],
    }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start_word: long, n_words: long, edits: int>>"
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    notices: tuple[tuple[str, str, int], ...] = NOTICES,
) -> DataFrame:
    """One row a document with its labels, score and the spans of notices (in words)."""
    phrases = PHRASES if phrases is None else phrases
    names = [c.split()[0] for c in SCHEMA.split(" array<")[0].split(", ")[1:]]

    def run(columns: dict[str, list]) -> dict[str, list]:
        rows = [scan_text(t, phrases, notices) for t in columns["text"]]
        return {"doc_id": columns["doc_id"]} | {c: [r[c] for r in rows] for c in names}

    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)
