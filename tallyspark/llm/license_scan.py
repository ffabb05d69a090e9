"""License scans by conditional compression.

Words that license notices use mark candidate blocks in a text: from a few words before such a word to as many after
it as the longest template has; overlapping blocks are one.  A block's words are compressed alone and with each
template's as zstandard raw dictionary.  The size reductions, as shares of the template's own compressed size, say which templates
are aligned with the block word by word: all that reach a least share, and all whose words stand there as they are.
An alignment goes from place to place until one's wording differs little and in no version, number or distinguishing
word; that confirms it.  What lies before and after a confirmed notice is searched again.  A long block is searched by
windows of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import schema_with

#: Fixed wording of notices: license, text.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Every template has such a word.  Between two words stands whatever may part words.
CUES = r"(?i)licen[sc]e|licensed|permission|redistribut|public[\W_]+domain"
#: Words that tell licenses from each other: a difference in one of them rejects the template.
TELLING = frozenset("mit apache gnu lesser affero general mozilla cc by by-sa by-nc by-nd cc0 bsd isc public".split())


@dataclass(frozen=True)
class Settings:
    """``before``: words of a block before its first cue.  ``least_reduction``: of a template's compressed size, to
    be aligned.  ``least_match``: share of a template's words found in order.  ``room``: words more than the template
    has that a place may have."""

    templates: tuple = TEMPLATES
    before: int = 24
    least_reduction: float = 0.2
    least_match: float = 0.85
    room: int = 6


WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
FOUND = "license string, template int, start int, end int, reduction double, match double, differences string"


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORDS.finditer(text)]


class Scanner:
    def __init__(self, s: Settings):
        import zstandard

        self.s, self.cues = s, re.compile(CUES)
        self.words = [[w for w, _, _ in _words(t)] for _, t in s.templates]
        self.after = max(map(len, self.words))
        self.reach = self.after + s.room
        self.alone = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            " ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for own in self.words]
        self.size = [self.bits(self.alone, " ".join(own)) for own in self.words]

    @staticmethod
    def bits(compressor, text: str) -> int:
        return len(compressor.compress(text.encode()))

    def blocks(self, text: str, words: list) -> list[tuple[int, int]]:
        """First and last word of each block."""
        out, at = [], 0
        for cue in self.cues.finditer(text):
            while at < len(words) and words[at][2] <= cue.start():
                at += 1
            low, high = max(0, at - self.s.before), min(len(words), at + self.after)
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def rooms(self, template: int, there: list[str]) -> list[tuple[int, int]]:
        """Ranges that hold every place with as many of the template's words as a match needs, in any order."""
        own = self.words[template]
        left, wide, need = Counter(own), len(own) + self.s.room, self.s.least_match * len(own)
        out, shared, high = [], 0, 0
        for low in range(len(there)):
            while high < min(len(there), low + wide):
                if (w := there[high]) in left:
                    shared += left[w] > 0
                    left[w] -= 1
                high += 1
            enough = shared >= need
            if (w := there[low]) in left:
                left[w] += 1
                shared -= left[w] > 0
            if not enough:
                continue
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def align(self, template: int, there: list[str]) -> tuple[int, int, float, str] | None:
        """First and last word of the notice, the share of the template's words matched, and the differences; None if
        the wording is another's at every place."""
        own = self.words[template]
        matcher = SequenceMatcher(None, own, there, autojunk=False)
        open_ = self.rooms(template, there)[::-1]
        while open_:
            low, high = open_.pop()
            run = matcher.find_longest_match(0, len(own), low, high)
            if not run.size:
                continue
            if found := self.confirmed(own, there, run):
                return found
            open_ += [(run.b + run.size, high), (low, run.b)]
        return None

    def confirmed(self, own: list[str], there: list[str], run) -> tuple[int, int, float, str] | None:
        """What ``align`` gives, for the place around a common run."""
        margin = self.s.room // 2
        low, high = max(0, run.b - run.a - margin), min(len(there), run.b + len(own) - run.a + margin)
        matcher = SequenceMatcher(None, own, there[low:high], autojunk=False)
        same = [m for m in matcher.get_matching_blocks() if m.size]
        matched = sum(m.size for m in same) / len(own)
        if matched < self.s.least_match:
            return None
        first, last = low + same[0].b, low + same[-1].b + same[-1].size
        span = there[first:last]
        diff = [(own[a:b], span[c:d]) for op, a, b, c, d in SequenceMatcher(None, own, span, autojunk=False).get_opcodes()
                if op != "equal"]
        for old, new in diff:
            if any(w in TELLING or any(c.isdigit() for c in w) for w in {*old} ^ {*new}):
                return None
        return first, last, matched, "; ".join(f"{' '.join(a) or '-'} > {' '.join(b) or '-'}" for a, b in diff)

    def best(self, words: list) -> tuple | None:
        """Of the notices in a block, the one that matches best: first and last word, and the row."""
        there = [w for w, _, _ in words]
        # line breaks, comment marks and punctuation between words do not count
        block = " ".join(there)
        alone = self.bits(self.alone, block)
        hits = []
        for i, (own, c, size) in enumerate(zip(self.words, self.given, self.size, strict=True)):
            reduction = (alone - self.bits(c, block)) / size
            if reduction < self.s.least_reduction and f" {' '.join(own)} " not in f" {block} ":
                continue
            if found := self.align(i, there):
                hits.append((found[2], found[1] - found[0], reduction, -i, found))
        if not hits:
            return None
        _, _, reduction, i, (first, last, matched, diff) = max(hits)
        return first, last, (self.s.templates[-i][0], -i, words[first][1], words[last - 1][2], reduction, matched, diff)

    def window(self, words: list, low: int, high: int) -> list[tuple[int, int, tuple]]:
        """Notices between two words, each as ``best`` gives it, in order."""
        out, open_ = [], [(low, high)]
        while open_:
            low, high = open_.pop()
            if low < high and (found := self.best(words[low:high])):
                first, last, own = low + found[0], low + found[1], found[2]
                out.append((first, last, own))
                open_ += [(low, first), (last, high)]
        return sorted(out)

    def search(self, words: list, low: int, high: int) -> list[tuple]:
        """Notices in a block, by windows that overlap by the longest notice."""
        out = []
        while low < high:
            end = min(high, low + 4 * self.reach)
            # what starts before this word ends in the window
            low, found = high if end == high else end - self.reach, self.window(words, low, end)
            for first, last, own in found:
                if first < low:
                    out.append((last, own))
            low = max([low, *(last for last, _ in out[-1:])])
        return [own for _, own in out]

    def scan(self, text: str) -> list[tuple]:
        words = _words(text)
        return [f for low, high in self.blocks(text, words) for f in self.search(words, low, high)]


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """One row per notice found in whole texts: the id, ``license``, ``template`` (its number), ``start`` and ``end``
    (code points, end exclusive), ``reduction``, ``match`` and ``differences`` ("template's words > text's words").

    Null and empty texts have none; repeated rows give repeated notices; other columns are not read.  An empty table
    gives an empty one.
    """
    names = [f.split()[0] for f in FOUND.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(s)
        types = pa.schema([("license", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                           ("reduction", pa.float64()), ("match", pa.float64()), ("differences", pa.string())])
        for batch in batches:
            found = [(i, f) for i, text in enumerate(batch.column(1)) for f in scanner.scan(text.as_py())]
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at)] + [
                pa.array([f[j] for _, f in found], t.type) for j, t in enumerate(types)], [id_col, *names])

    marked = docs.select(id_col, text_col).where(F.col(text_col).rlike(CUES))
    return marked.mapInArrow(scan, schema_with(docs, [id_col], FOUND))
