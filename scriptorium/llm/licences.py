"""License scans: a trained paragraph classifier, confirmed by templates.

Texts are cut into paragraphs at blank lines (also such as hold only a comment sign), and these into lines, long ones at
sentence ends. A line that holds a whole template stands alone; the others are judged alone and joined in overlapping windows of at
most WINDOW words, so that wrapped notices are found whole; of those that overlap, the one with the largest share of a template
counts. Comment signs do not count as words. Sparse word n-grams of a paragraph go through a logistic
regression with a class for each licence family and one for unknown text. It is trained on paragraphs made from TEMPLATES by a
rule (names, years and versions filled in, openings and endings varied) against paragraphs of the input that hold no licence
word, at most UNKNOWN of them, and against near misses. The temperature that calibrates its probabilities, and so the
unknown class, is set on examples that training left out. A family stands only where its probability is the highest, at least
LEAST, and at least CONTAINED of the n-grams of one of its templates are in the paragraph.

Null and empty texts have no spans; repeated rows each give their row; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import by_batch, least_by_hash

LEAST, CONTAINED, UNKNOWN, SLOTS, WINDOW = 0.6, 0.5, 2000, 1 << 16, 100

#: Notices as they stand in public licence texts; {n} is a number, {y} a year, {w} a name.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT License Copyright (c) {y} {w}", "SPDX-License-Identifier: MIT"),
    "Apache": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version {n}.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version {n}.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version {n}.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": ("Released under the BSD {n}-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY": ("Licensed under CC BY {n}.0.", "This work is licensed under a Creative Commons Attribution {n}.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA {n}.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike {n}.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC {n}.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial {n}.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-ND": ("Licensed under CC BY-ND {n}.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives {n}.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "Proprietary": ("All rights reserved.", "Copyright (c) {y} {w}. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: Text with words of licences that grants nothing.
NEAR_MISSES = ("The driver must carry a valid license at all times.", "His driving license expired in {y}.", "The general public was not permitted to enter.", "She studied at MIT before joining {w}.", "The Apache helicopter was seen over {w}.", "Fishing licenses are sold at the town hall.", "Free of charge for children under {n}.", "The right of way was reserved for buses.", "We reserved {n} rooms in {w}.", "The copyright debate goes on in {w}.", "The commons were enclosed in {y}.")

CLASSES = ("unknown", *TEMPLATES)
_TERM = re.compile(r"licen[cs]|copyright|rights reserved|spdx|creative commons|public domain|\bcc[ -]?(?:by|0)|hereby granted|redistribut|free software|strictly prohibited|waived", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_LEADER = re.compile(r"^[^\S\n]*(?:dnl|rem)\b", re.M | re.I)


def paragraphs(text: str | None) -> list[list[tuple[int, int]]]:
    """The lines of each paragraph."""
    out, last = [], None
    for span in lines(text):
        if not re.search(r"\w", _LEADER.sub("", text[slice(*span)])):
            last = None
        elif last is None or text.count("\n", last, span[0]) > 1:
            out.append([span])
            last = span[1]
        else:
            out[-1].append(span)
            last = span[1]
    return out


def lines(text: str | None) -> list[tuple[int, int]]:
    """Spans of lines; of lines over 400 characters, their sentences."""
    spans = []
    for m in re.finditer(r"[^\n]+", text or ""):
        if m.end() - m.start() <= 400:
            spans.append(m.span())
        else:
            spans += [(m.start() + s.start(), m.start() + s.end()) for s in re.finditer(r".+?(?:[.!?](?=\s)|$)", m[0])]
    return spans


def grams(text: str) -> set[str]:
    """Word n-grams of 1 to 3 words; numbers are alike."""
    words = ["0" if w.isdigit() else w for w in _WORD.findall(text.lower())]
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def examples(templates: dict = TEMPLATES, near_misses: tuple = NEAR_MISSES) -> list[tuple[str, str]]:
    """(paragraph, class) by a rule: every template in every frame and with every filling."""
    frames = ("{}", "{} See LICENSE for details.", "Copyright (c) {y} {w}. {}", "This file is part of {w}. {}", "{} {w}", "The code below comes from {w} and is old. {}")
    out = []
    for family, texts in [*templates.items(), ("unknown", near_misses)]:
        for text in texts:
            for i, frame in enumerate(frames):
                for k in range(3):
                    made = frame.replace("{}", text).replace("{n}", str(k + 2)).replace("{y}", str(1999 + 7 * k + i)).replace("{w}", ("Example Authors", "ACME", "the contributors")[k])
                    out.append((made, family))
    return out


class Classifier:
    """Multinomial logistic regression on hashed n-grams, by full-batch gradient steps."""

    def __init__(self, labelled: list[tuple[str, str]], steps: int = 150, rate: float = 1.0, decay: float = 1e-4):
        held = [x for x in labelled if zlib.crc32(x[0].encode()) % 5 == 0]
        used = [x for x in labelled if zlib.crc32(x[0].encode()) % 5]
        self.known = {g for text, c in used if c != "unknown" for g in grams(text)}
        self.weights = np.zeros((SLOTS + 1, len(CLASSES)), np.float32)
        self.temperature = 1.0
        x = [self.slots(text) for text, _ in used]
        y = np.array([CLASSES.index(c) for _, c in used])
        flat, rows = np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])
        need = np.unique(flat)
        at = np.searchsorted(need, flat)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        w, goal = np.zeros((len(need), len(CLASSES))), np.eye(len(CLASSES))[y]
        starts = np.cumsum([0, *(len(s) for s in x)])[:-1]
        for _ in range(steps):
            g = (_softmax(np.add.reduceat(w[at], starts)) - goal) / len(x)
            w -= rate * (np.add.reduceat(g[rows[order]], cuts) * 20 + decay * w)
        self.weights[need] = w
        scores = np.array([self.scores(text) for text, _ in held])
        truth = np.array([CLASSES.index(c) for _, c in held])
        self.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: -np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).sum())
        self.held_out = float((scores.argmax(1) == truth).mean())
        self.templates = {c: [grams(t.replace("{n}", "0").replace("{y}", "0").replace("{w}", "")) for t in texts] for c, texts in TEMPLATES.items()}

    def slots(self, text: str) -> np.ndarray:
        """Slots of known n-grams, the last for the bias, and one for how much of the text is unknown."""
        found = grams(text)
        mine = [zlib.crc32(g.encode()) % SLOTS for g in found if g in self.known]
        return np.array(sorted({*mine, zlib.crc32(b"\0%d" % (4 * len(mine) // max(1, len(found)))) % SLOTS, SLOTS}), np.int64)

    def scores(self, text: str) -> np.ndarray:
        return self.weights[self.slots(text)].sum(axis=0)

    def family(self, text: str) -> tuple[str, float, float]:
        """Class, its probability and the share of the nearest template that is in the text."""
        p = _softmax(self.scores(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        name = CLASSES[best]
        own = grams(text)
        share = max((len(t & own) / len(t) for t in self.templates.get(name, ()) if t), default=0.0)
        if name == "unknown" or p[best] < LEAST or share < CONTAINED:
            return "unknown", float(p[best]), share
        return name, float(p[best]), share


    def contained(self, text: str) -> bool:
        own = grams(text)
        return any(len(t & own) >= CONTAINED * len(t) for of in self.templates.values() for t in of if t)

    def stated(self, text: str | None) -> list[tuple[int, int, str, float, float]]:
        """Start, end, class, probability and share of all that states a licence: lines with a whole template, and the best of what is between."""
        if not text:
            return []
        out = []
        for spans in paragraphs(text):
            if not _TERM.search(" ".join(" ".join(_words(text[a:b])) for a, b in spans)) and not any(_TERM.search(text, *x) for x in spans):
                continue
            run: list[tuple[int, int]] = []
            for span in spans:
                found = self.family(text[slice(*span)]) if _TERM.search(text, *span) else ("unknown",)
                if found[0] == "unknown" or found[2] < 1:
                    run.append(span)
                else:
                    out += [*self._joined(text, run), (*span, *found)]
                    run = []
            out += self._joined(text, run)
        return out

    def _joined(self, text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, str, float, float]]:
        """The best windows of a run, none over another."""
        said = [_LEADER.sub("", text[a:b]) for a, b in run]
        sizes = [len(_WORD.findall(x.lower())) for x in said]
        # a term may be wrapped too, so it is looked for across each line's end
        near = [bool(_TERM.search(" ".join(" ".join(_words(x)) for x in said[i : i + 2]))) for i in range(len(said))]
        found = []
        for i in range(len(run)):
            words, term = 0, False
            for j in range(i, len(run)):
                words += sizes[j]
                if words > WINDOW and j > i:
                    break
                term = term or near[j]
                joined = "\n".join(said[i : j + 1])
                if term and self.contained(joined) and (told := self.family(joined))[0] != "unknown":
                    found.append((i, j, told))
        taken, out = set(), []
        for i, j, told in sorted(found, key=lambda x: (-x[2][2], x[1] - x[0], -x[2][1], x[0])):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                out.append((run[i][0], run[j][1], *told))
        return sorted(out)


def _words(text: str) -> list[str]:
    return re.findall(r"[\w-]+", text)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame) -> Classifier:
    """Trained on the rule's examples and the first paragraphs, at most UNKNOWN, of documents without licence words (the least by
    a hash of doc_id)."""
    plain = docs.select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("line")).where(F.col("line").isNotNull() & (F.length("line") <= 400) & ~F.col("line").rlike("(?i)" + _TERM.pattern))
    rows = least_by_hash(plain, UNKNOWN, "doc_id", "line").collect()
    return Classifier(examples() + [(r.line, "unknown") for r in rows])


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("licences", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("share", T.DoubleType())])))])


def licences(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id and the paragraphs of its whole text that state a licence. No shuffle but for the training sample."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier or fit(docs))

    def work(columns: dict) -> dict:
        names = ("start", "end", "family", "p", "share")
        out = [[dict(zip(names, x, strict=True)) for x in shared.value.stated(text)] for text in columns["text"]]
        return columns | {"licences": out}

    return by_batch(docs.select("doc_id", "text"), _FOUND, work)


def licence_report(docs: DataFrame) -> DataFrame:
    found = licences(docs)
    said = F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"), F.array_join(said, ",").alias("spans"))
