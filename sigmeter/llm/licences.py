"""Licence notices by Dice coefficient over word bigrams.

Every sentence, line, paragraph, whole text and stretch of words that begins and ends like a template is
normalised to lower-case words and compared with templates. With m and t bigrams the coefficient 2 * shared / (m + t) reaches the threshold only if the
sizes are within a fixed ratio, which prunes templates; and only if enough of the unit's words occur in
templates at all, which ends most units after one count.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import small
from .common import documents

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
BLANK = re.compile(r"\n\s*\n")

# Short notices by which public licences are named, and the opening grants of a few.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

GNU = [("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Library General Public License", ("2",)),
       ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))]
GNU_NOTICES = [  # suffix of the name, notice
    ("", "This work is licensed under the {0}, version {1}."),
    ("", "Licensed under the {0} v{1}."),
    ("", "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, version {1} of the License."),
    ("", "This program is free software: you can redistribute it and/or modify it under the terms of the {0} version {1} as published by the Free Software Foundation."),
    ("-or-later", "This work is licensed under the {0}, version {1} or later."),
    ("-or-later", "This work is licensed under the {0}, version {1}, or (at your option) any later version."),
    ("-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."),
    ("-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."),
]
CC_PARTS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-ND", "Attribution-NoDerivs"),
            ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs")]
CC_NOTICES = ["Licensed under CC {0} {2}.", "This work is licensed under a Creative Commons {1} {2} {3} License.", "This work is licensed under the Creative Commons {1} {2} {3} License."]
TEMPLATES += [(f"{n}-{v if '.' in v else v + '.0'}{suffix}", notice.format(title, v)) for n, title, versions in GNU for v in versions for suffix, notice in GNU_NOTICES]
TEMPLATES += [(f"CC-{short}-{v}", notice.format(short, title, v, kind)) for short, title in CC_PARTS for v, kind in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))
              for notice in CC_NOTICES]
TEMPLATES = list(dict.fromkeys(TEMPLATES))

# Words that tell one licence from its siblings: those of a template must be present, as must its version numbers.
NAMES = {"mit", "apache", "bsd", "isc", "mozilla", "cc", "attribution"}
VARIANTS = {"affero", "lesser", "later", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives", "noderivs"}  # and no others of these
REACH = sorted(((i, j) for i in range(4) for j in range(4)), key=sum)
VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


def telling(words: list[str]) -> tuple[set[str], set[str]]:
    """Names and versions, and variants, among ``words``; 3, v3 and 3.0 are one version."""
    versions = {m[1] for w in words if (m := VERSION.fullmatch(w))}
    library = {"library"} if ("library", "general") in zip(words, words[1:]) else set()  # not "this library is"
    return versions | (NAMES & set(words)), (VARIANTS & set(words)) | library


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        made = sorted(((len(w) - 1, name, bigrams(w)) for name, w in ((n, WORD.findall(t.lower())) for n, t in templates) if len(w) > 1), key=lambda x: x[:2])
        self.sizes, self.made = [m[0] for m in made], made
        told = {(n, frozenset(bigrams(w).items())): telling(w) for n, w in ((n, WORD.findall(t.lower())) for n, t in templates)}
        self.told = [told[name, frozenset(grams.items())] for _, name, grams in made]
        self.opens = {a for _, _, grams in made for a, _ in grams}

        self.index: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, grams) in enumerate(made):
            for g in grams:
                self.index.setdefault(g, []).append(k)

    def accepts(self, k: int, words: list[str]) -> bool:
        """Whether ``words`` hold what tells template ``k`` from its siblings."""
        (need, variants), (own, other) = self.told[k], telling(words)
        return need <= own and variants == other

    def windows(self, words: list[str]) -> list[tuple[float, str, tuple[str, ...]]]:
        """Stretches of words close to a template: coefficient, name and words. Of overlapping ones that with most shared bigrams.

        A best stretch begins and ends with a shared bigram, since cutting others off raises the coefficient.
        """
        hits: dict[int, list[int]] = {}
        grams = list(zip(words, words[1:]))
        for i, g in enumerate(grams):
            for k in self.index.get(g, ()):
                hits.setdefault(k, []).append(i)
        close = []
        for k, at in hits.items():
            t, name, wanted = self.made[k]
            least, most = max(1, math.ceil(t * self.ratio - 1e-9)), t / self.ratio + 1e-9
            for a in range(len(at) - least + 1):
                if at[a + least - 1] - at[a] + 1 > most:
                    continue
                shared, used, top = 0, Counter(), None
                for b in range(a, len(at)):
                    m = at[b] - at[a] + 1
                    if m > most:
                        break
                    g = grams[at[b]]
                    used[g] += 1
                    shared += used[g] <= wanted[g]
                    if 2 * shared / (m + t) < self.threshold or (top and 2 * shared / (m + t) <= top[1]):
                        continue
                    # A telling word that is written otherwise (3.0 for 3) may stand just outside the shared bigrams.
                    for before, after in REACH:
                        d, lo, hi = 2 * shared / (m + before + after + t), at[a] - before, at[b] + 2 + after
                        if d >= self.threshold and 0 <= lo and hi <= len(words) and (top is None or d > top[1]) and self.accepts(k, words[lo:hi]):
                            top = (shared, d, name, lo, hi)
                            break
                if top:
                    close.append(top)
        out, covered = [], bytearray(len(words))
        for _, d, name, a, b in sorted(close, reverse=True):
            if 1 not in covered[a:b]:
                covered[a:b] = b"\1" * (b - a)
                out.append((d, name, tuple(words[a:b])))
        return out

    def named(self, words: list[str]) -> tuple[float, str] | None:
        """The closest template that ``words`` also name."""
        if self.best(words) is None:
            return None
        own, m = bigrams(words), len(words) - 1
        lo, hi = bisect.bisect_left(self.sizes, m * self.ratio - 1e-9), bisect.bisect_right(self.sizes, m / self.ratio + 1e-9)
        return max(((d, self.made[k][1]) for k in range(lo, hi) if (d := dice(own, self.made[k][2])) >= self.threshold and self.accepts(k, words)), default=None)

    def best(self, words: list[str]) -> tuple[float, str] | None:
        m = len(words) - 1
        if m < 1:
            return None
        lo, hi = bisect.bisect_left(self.sizes, m * self.ratio - 1e-9), bisect.bisect_right(self.sizes, m / self.ratio + 1e-9)
        if lo == hi or sum(w in self.opens for w in words[:-1]) < m * self.ratio - 1e-9:
            return None
        own = bigrams(words)
        found = [(d, name) for _, name, grams in self.made[lo:hi] if (d := dice(own, grams)) >= self.threshold]
        return max(found, key=lambda x: (x[0], x[1])) if found else None

    def scan(self, text: str) -> tuple[list[tuple[float, str]], list[str]]:
        """Matches of all units and of stretches outside them, each text once, and the licences named."""
        units = [text, *BLANK.split(text)]
        for line in text.split("\n"):
            units.append(line)
            units += SENTENCE.split(line)
        out, seen, matched = [], set(), set()
        for unit in units:
            if unit not in seen:
                seen.add(unit)
                words = WORD.findall(unit.lower())
                got = self.named(words)
                if got:
                    out.append(got)
                    matched.add((got[1], f" {' '.join(words)} "))
        for d, name, words in self.windows(WORD.findall(text.lower())):
            own = f" {' '.join(words)} "
            if not any(name == n and own in unit for n, unit in matched):
                matched.add((name, own))
                out.append((d, name))
        return out, sorted({name for _, name in out})


def _scan(templates: list[tuple[str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in small(batches):
            best, score, names, n = [], [], [], []
            for text in batch.column("text").to_pylist():
                found, own = scanner.scan(text or "")
                top = max(found, key=lambda x: (x[0], x[1]), default=(None, None))
                score.append(top[0])
                best.append(top[1])
                names.append(own)
                n.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(n, pa.int64())],
                                             names=["doc_id", "licence", "dice", "licences", "n_matches"])

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, best licence and its coefficient (null without a match), all licences named, number of matching units.

    Null and empty texts match nothing. Ties go to the later name. Repeated rows give repeated rows; other
    columns are not read; an empty table gives no rows. Templates travel with the task, so they are a
    configured list, not a table that grows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan(templates, threshold), f"doc_id {kind}, licence string, dice double, licences array<string>, n_matches long")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
