"""Fuzzy search for short licence notices.

A notice with at most e edits is cut into e + 1 pieces, one of which must occur unchanged. An
Aho-Corasick automaton finds the pieces, and the `regex` library verifies the surrounding window
with bounded errors. Texts are compared as lower-case words joined by single spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases found word for word, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices found with edits. The second part must be present unchanged.
FUZZY = [
    ("under the mit license", "", "mit"),
    ("apache license version ", "2", "apache-2"),
    ("mit license permission is hereby granted", "", "mit"),
    ("gnu general public license", "", "gpl"),
    ("gnu lesser general public license", "", "lgpl"),
    ("mozilla public license", "", "mpl"),
    ("redistribution and use in source and binary forms", "", "bsd"),
    ("creative commons attribution", "", "cc-by"),
    ("licensed under cc by nc ", "", "cc-by-nc"),
    ("all rights reserved", "", "all-rights-reserved"),
]
EDIT_SHARE = 10  # one edit for so many characters

_UPPER = bytes(range(65, 91))
#: Bytes of words become lower case, all others a blank; bytes above 127 belong to words.
WORD_BYTES = bytes(
    b + 32 if b in _UPPER else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Notices:
    """Compiled notices; `edits` of a notice grow with its length."""

    def __init__(self, fuzzy: list[tuple[str, str, str]]) -> None:
        self.found = ahocorasick.Automaton()
        self.rules = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for rule, (body, exact, label) in enumerate(fuzzy):
            edits = len(body) // EDIT_SHARE
            pattern = regex.compile(
                rf"(?e)(?<![^ ])(?:{regex.escape(body, special_only=True)}){{e<={edits}}}{exact}(?![^ ])")
            self.rules.append((pattern, len(body), len(body) + len(exact), edits, label))
            cuts = [round(i * len(body) / (edits + 1)) for i in range(edits + 2)]
            for start, end in zip(cuts, cuts[1:]):
                seeds.setdefault(body[start:end], []).append((rule, start))
        for seed, places in seeds.items():
            self.found.add_word(seed, (len(seed), places))
        self.found.make_automaton()

    def search(self, words: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first character, end, edits, similarity) of every verified notice.

        Windows reach to whole words, so what is found in one does not depend on where it was cut. Of
        spans of one rule that overlap, the one with fewest edits (the first of equals) stands. Letters
        stuck to the front of a notice's first word make another word and are no edit.
        """
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.found.iter(words):
            for rule, start in places:
                _, body, whole, edits, _ = self.rules[rule]
                at = last + 1 - size - start
                lo, hi = words.rfind(" ", 0, max(0, at - edits)) + 1, words.find(" ", min(len(words), at + whole + edits))
                hi = len(words) if hi < 0 else hi
                held = windows.setdefault(rule, [])
                if held and lo <= held[-1][1]:
                    held[-1][0], held[-1][1] = min(lo, held[-1][0]), max(hi, held[-1][1])
                else:
                    held.append([lo, hi])
        out = []
        for rule, held in windows.items():
            pattern, body, whole, _, label = self.rules[rule]
            for lo, hi in held:
                hits = sorted((sum(m.fuzzy_counts), m.start(), m.end()) for m in pattern.finditer(words, lo, hi, overlapped=True))
                taken: list[tuple[int, int]] = []
                for edits, start, end in hits:
                    if all(end <= a or start >= b for a, b in taken):
                        taken.append((start, end))
                        out.append((label, start, end, edits, 1 - edits / body))
        return out


def scan_notices(docs: DataFrame, base: dict[str, str] | None = None,
                 fuzzy: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Words, exact places and fuzzy spans of licence notices in every whole text.

    Returns doc_id, n_words, places array<struct<label, word>> (every place of an exact phrase, by
    its first word) and spans array<struct<label, first_word, n_words, edits, similarity, text>>.
    Null and empty texts have no words and empty lists. Every row gives one row.
    """
    base, fuzzy = base or BASE, fuzzy or FUZZY

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notices = Notices(fuzzy)
        phrases = [(f" {phrase} ".encode(), label) for phrase, label in base.items()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
                padded = b" ".join([b"", *words, b""]) if words else b""
                places = []
                for phrase, label in phrases:
                    at = padded.find(phrase)
                    while at >= 0:
                        places.append({"label": label, "word": padded.count(b" ", 0, at)})
                        at = padded.find(phrase, at + 1)
                line = padded[1:-1].decode("utf-8", "replace")
                spans = [
                    {"label": label, "first_word": line.count(" ", 0, start), "n_words": line.count(" ", start, end) + 1,
                     "edits": edits, "similarity": near, "text": line[start:end]}
                    for label, start, end, edits, near in notices.search(line)]
                rows.append((doc_id, len(words), places, spans))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "places", "spans"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(
        scan, "doc_id long, n_words long, places array<struct<label string, word long>>, spans array<struct<label string, "
              "first_word long, n_words long, edits int, similarity double, text string>>")


def notice_digest(found: DataFrame) -> DataFrame:
    """One row of counts and labels per document of `scan_notices`."""
    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    exact, near = F.col("places.label"), F.col("spans.label")
    best = F.array_max(F.concat(F.array(F.lit(0.0)), F.col("spans.similarity")))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"), joined(exact).alias("base_labels"),
        joined(F.concat(exact, near)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.greatest(best, F.lit(0.0))).alias("score"))
