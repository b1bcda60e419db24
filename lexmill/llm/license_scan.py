"""Licence scan: exact phrases, and short notices with a bounded number of edits.

A notice of m characters may have k = m // `EDIT_SHARE` edits. Cut into k + 1 parts, at least one part of any such
match is unedited (the pigeonhole principle), so exact hits of the parts, found by one Aho-Corasick automaton
for all notices, locate every candidate. The regex library's bounded-error matching then verifies each
candidate window and reports the span and the number of edits. Texts are normalised first: A-Z lower-cased,
words of letters, digits and what is beyond ASCII, single spaces between them.

Base labels come from phrases whose words stand consecutively; the notices add labels, and base ones stay.

Cases: a null or empty text has no words, no places and score 0; places are null without a phrase; repeated rows
are returned one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import pick
from lexmill.session import table

#: Phrases and their labels, by words.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices in normalised form, with the label that each adds.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution", "cc"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "proprietary"),
)
EDIT_SHARE = 10

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def normalised_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Scanner:
    """Built once per worker: the automaton of the parts and a bounded-error pattern per notice."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, edit_share: int = EDIT_SHARE) -> None:
        self.notices = [(text, label, len(text) // edit_share) for text, label in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}") for text, _, k in self.notices]
        parts: dict[str, list[tuple[int, int]]] = {}
        for number, (text, _, k) in enumerate(self.notices):
            bounds = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                parts.setdefault(text[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for part, uses in parts.items():
            self.automaton.add_word(part, (len(part), uses))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in the normalised text, in order and without overlaps.

        Every hit of a part fixes where its notice would start, up to k characters; that window is verified, each
        different window text once. Of matches that overlap, the one with the fewest edits counts, then the longest."""
        seen: set[tuple[int, int]] = set()
        known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        found = set()
        for end, (size, uses) in self.automaton.iter(text):
            for number, offset in uses:
                notice, _, k = self.notices[number]
                start = end + 1 - size - offset
                if (number, start) in seen:
                    continue
                seen.add((number, start))
                low = max(0, start - k)
                window = text[low : max(0, start + len(notice) + k)]
                key = (number, window)
                if key not in known:
                    at = window.find(notice)
                    if at >= 0:
                        known[key] = (at, at + len(notice), 0)
                    else:
                        match = self.patterns[number].search(window)
                        known[key] = (match.start(), match.end(), sum(match.fuzzy_counts)) if match else None
                hit = known[key]
                if hit:
                    found.add((hit[2], hit[0] - hit[1], low + hit[0], number))
        taken, best = bytearray(len(text)), []
        for edits, less, start, number in sorted(found):
            end = start - less
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\x01" * (end - start)
                best.append((number, start, end, edits))
        return sorted(best, key=lambda x: x[1:3])


def phrase_places(joined: bytes, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place; joined has a space before each word and at the end."""
    found = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, before, words = joined.find(needle), 0, 0
        while at >= 0:
            words += joined.count(b" ", before, at)
            before = at
            found.append((words, label))
            at = joined.find(needle, at + 1)
    return found


def scan(text: str | None, scanner: Scanner) -> dict:
    """All that is found in one text: n_words, places, spans (by words: label, start, end, edits), labels, score."""
    words = normalised_words(text)
    joined = b" " + b" ".join(words) + b" " if words else b""
    places = phrase_places(joined) if b"license" in joined else []
    plain = joined.decode("utf-8", "replace")
    spans, score, at, spaces = [], 1.0 if places else 0.0, 0, 0
    for number, a, b, edits in scanner.spans(plain) if words else ():
        notice, label, _ = scanner.notices[number]
        spaces += plain.count(" ", at, a)
        at = a
        first = spaces if plain[a] == " " else spaces - 1  # the word that holds the first character
        spans.append((label, max(first, 0), spaces + plain.count(" ", a, b) - (plain[b - 1] == " "), edits))
        score = max(score, 1 - edits / len(notice))
    base = {label for _, label in places}
    return {
        "n_words": len(words), "places": places, "spans": spans, "base": base,
        "labels": base | {s[0] for s in spans}, "score": score,
    }


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())])


def _scanner(notices: tuple[tuple[str, str], ...], edit_share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, edit_share)
        for batch in batches:
            found = [scan(t.as_py(), scanner) for t in batch.column("text")]
            starts = [[p for p, _ in f["places"]] for f in found]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([f["n_words"] for f in found], pa.int64()),
                "n_base": pa.array([len(s) for s in starts], pa.int64()),
                "first_word": pa.array([min(s, default=None) for s in starts], pa.int64()),
                "last_word": pa.array([max(s, default=None) for s in starts], pa.int64()),
                "base_labels": pa.array([",".join(sorted(f["base"])) for f in found], pa.string()),
                "labels": pa.array([",".join(sorted(f["labels"])) for f in found], pa.string()),
                "score": pa.array([f["score"] for f in found], pa.float64()),
                "spans": pa.array([[dict(zip(("label", "first_word", "end_word", "edits"), s, strict=True)) for s in f["spans"]] for f in found], pa.list_(SPAN)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def license_scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, edit_share: int = EDIT_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row per document."""
    docs = pick(docs, doc_id="doc_id", text="text")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(
        _scanner(notices, edit_share),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first_word:long,end_word:long,edits:long>>",
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
