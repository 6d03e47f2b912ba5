"""Operator 6: licence scan with a positional rare-token index.

Templates are passages of licence texts: phrases, titles, headers, grants and SPDX lines.  Each template word has an
inverse document frequency over the whole corpus.  The index holds postings (template, place) of each template's
rarest words, so many that a text good enough for the template has two of them at least.  A file's highest-IDF
licence words are looked up; each posting votes for the place where the template would begin, and places where
postings of two words meet, give or take SLACK, are kept.  There the mandatory phrases must stand within the span,
none of the excluded ones, and enough of the template's weight at its relative places.  Where passages of different
licences overlap, as a shorter one stands inside a longer one, the one that explains the most weight counts.  An SPDX
line is read to the end of its expression.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store

#: Label and phrase.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

_GNU = "gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
#: Label, words, mandatory phrases and, if any, excluded phrases of passages; {} of _GNU names the licence and the version.
TEXTS = (
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "except in compliance with the license")),
    ("apache-2", "apache license version 2 0 january 2004", ("apache license version 2 0",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", _GNU.format("", "3"), ("gnu general public license", "version 3")),
    ("gpl-2", _GNU.format("", "2"), ("gnu general public license", "version 2")),
    ("gpl-3", "gnu general public license version 3 29 june 2007", ("gnu general public license version 3",)),
    ("gpl-2", "gnu general public license version 2 june 1991", ("gnu general public license version 2",)),
    ("lgpl", _GNU.format("lesser ", "2 1"), ("gnu lesser general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007", ("gnu lesser general public license version",)),
    ("agpl-3", _GNU.format("affero ", "3"), ("gnu affero general public license", "version 3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", ("gnu affero general public license version 3",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla public license version 2",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", ("bsd style license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", ("with or without fee is hereby granted", "provided that the above copyright notice")),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",), ("provided that",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    ("boost-1", "boost software license version 1 0 17 august 2003", ("boost software license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike license", ("creative commons attribution noncommercial sharealike",)),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives license", ("creative commons attribution noncommercial noderivatives",)),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives license", ("creative commons attribution noderivatives",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ("creative commons attribution noncommercial",), ("sharealike", "noderivatives")),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",), ("sharealike", "noncommercial", "noderivatives")),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
)
#: Label, and the words of the identifier in a line "SPDX-License-Identifier: ...".
SPDX = (
    ("apache-2", "apache 2 0"), ("mit", "mit"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"), ("zlib", "zlib"), ("boost-1", "bsl 1 0"),
    ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("epl-2", "epl 2 0"),
    ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("cc-by-nc-sa", "cc by nc sa 4 0"), ("cc-by-nc-nd", "cc by nc nd 4 0"), ("cc-by-nd", "cc by nd 4 0"), ("0bsd", "0bsd"), ("cc0", "cc0 1 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
)
#: A longer text needs this share of its words' weight within its span.
ENOUGH = 0.6
#: Words may be missing or added between parts of a longer text.
SLACK = 3
#: What an SPDX expression puts between and after identifiers; an exception has a few words.
SPDX_LINE, JOINS, SUFFIXES, EXCEPTION = (b"spdx", b"license", b"identifier"), (b"or", b"and"), (b"only", b"later"), 6
#: What "not" goes before, and how many words before a passage it may stand.
DENIED, DENIAL = (b"licensed", b"released", b"distributed", b"covered", b"governed", b"available", b"subject"), 5
#: Spellings that count as one, but for base phrases.
SPELLINGS = {b"licence": b"license", b"licenced": b"licensed", b"licences": b"licenses"}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased runs of 0-9, a-z and all beyond ASCII, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def templates() -> list[tuple[str, list[bytes], list[list[bytes]], bool]]:
    """(label, words, mandatory phrases, is it a base phrase)."""
    lines = [(a, f"spdx license identifier {t}", (f"spdx license identifier {t}",)) for a, t in SPDX]
    return [(a, words_of(t), [words_of(t)], True) for a, t in BASE] + [(a, words_of(t), [words_of(p) for p in must], False) for a, t, must, *_ in (*TEXTS, *lines)]


def excluded() -> list[list[list[bytes]]]:
    """Excluded phrases of each of the templates."""
    return [[words_of(p) for p in (row[3] if len(row) > 3 else ())] for row in (*BASE, *TEXTS, *SPDX)]


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Rows of docs, and how many of them have each template word.  Every task counts, only its counts are summed."""
    vocabulary = sorted({w for _, words, _, _ in templates() for w in words})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, n, seen = frozenset(vocabulary), 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0):
                n += 1
                words = words_of(text.as_py())
                for w in among.intersection(words).union(SPELLINGS[w] for w in SPELLINGS.keys() & words if SPELLINGS[w] in among):
                    seen[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [b"", *seen], "n": pa.array([n, *seen.values()], pa.int64())})

    sums = docs.select("text").mapInArrow(store.tidied(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r["word"]): r["n"] for r in sums.collect()}
    return found.pop(b"", 0), found


class Index:
    """Postings of the rare words of each template, and the weights of all template words."""

    def __init__(self, n: int, frequencies: dict[bytes, int]):
        self.templates, self.excluded = templates(), excluded()
        #: SPDX identifiers, longest first
        self.identifiers = sorted(((tuple(words_of(t)), label) for label, t in SPDX), key=lambda x: -len(x[0]))
        self.weight = {w: math.log((n + 1) / (frequencies.get(w, 0) + 1)) + 1 for _, words, _, _ in self.templates for w in words}
        self.required = [frozenset(w for p in must for w in p) for _, _, must, _ in self.templates]
        self.phrases: dict[bytes, list[tuple[int, int]]] = {}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        #: how many different places of a template must vote for a beginning
        self.votes = [1] * len(self.templates)
        for t, (_, words, _, phrase) in enumerate(self.templates):
            if phrase:
                place = min(range(len(words)), key=lambda i: (-self.weight[words[i]], i))
                self.phrases.setdefault(words[place], []).append((t, place))
                continue
            telling, self.votes[t] = self._telling(words)
            for i in telling:
                self.postings.setdefault(words[i], []).append((t, i))

    def _telling(self, words: list[bytes]) -> tuple[list[int], int]:
        """A template's rarest places, and how many of them any text that is enough has: two, if any two can tell.

        All places of a word are in or out.  Without the places, and but for the heaviest of them, less than the
        weight that is enough is left.
        """
        weights = [self.weight[w] for w in words]
        enough, order = ENOUGH * sum(weights) * (1 - 1e-9), sorted(set(words), key=lambda w: (-self.weight[w], w))
        for votes, spare in ((2, max(weights)), (1, 0.0)):
            left, telling = sum(weights), set()
            for w in order:
                if left + spare < enough:
                    break
                telling.add(w)
                left -= self.weight[w] * words.count(w)
            if left + spare < enough:
                return [i for i, w in enumerate(words) if w in telling], votes
        return list(range(len(words))), 1

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """Base places, first and last of them, base labels, all labels, score."""
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.weight:
                at.setdefault(w, []).append(i)
        starts: list[int] = []
        base: set[str] = set()
        for w in at.keys() & self.phrases.keys():
            for t, place in self.phrases[w]:
                label, text, _, _ = self.templates[t]
                if self.required[t] <= at.keys():
                    found = [i - place for i in at[w] if i >= place and words[i - place : i - place + len(text)] == text]
                    starts += found
                    base |= {label} if found else set()
        if not SPELLINGS.keys().isdisjoint(words):
            words = [SPELLINGS.get(w, w) for w in words]
            for old in SPELLINGS:
                at.pop(old, None)
            for new in set(SPELLINGS.values()) & self.weight.keys():
                at[new] = [i for i, w in enumerate(words) if w == new]
            at = {w: places for w, places in at.items() if places}
        more, best = self._passages(words, at)
        more |= self._expressions(words, at)
        return len(starts), min(starts, default=None), max(starts, default=None), base, base | more, 1.0 if base else best

    def _passages(self, words: list[bytes], at: dict[bytes, list[int]]) -> tuple[set[str], float]:
        """Labels of the passages that stand in a text, and the best share."""
        found: list[tuple[float, int, int, str, float]] = []
        for t, places in self._beginnings(at).items():
            label, text, must, _ = self.templates[t]
            for start in places:
                share, end = self._share(at, start, t), start + len(text)
                low, high = max(0, start - SLACK), end + SLACK
                if share < ENOUGH or self._denied(words, start):
                    continue
                if all(self._has(words, at, low, high, p) for p in must) and not any(self._says(words, low, high + SLACK, p) for p in self.excluded[t]):
                    found.append((share * sum(map(self.weight.__getitem__, text)), start, end, label, share))
        found.sort(key=lambda x: (-x[0], x[1], x[3]))
        kept: list[tuple[float, int, int, str, float]] = []
        for one in found:
            _, start, end, label, _ = one
            hidden = (k for k in kept if k[3] != label and 2 * (min(end, k[2]) - max(start, k[1])) > min(end - start, k[2] - k[1]))
            if not any(hidden) and (label, start) not in {(k[3], k[1]) for k in kept}:
                kept.append(one)
        return {k[3] for k in kept}, max((k[4] for k in kept), default=0.0)

    @staticmethod
    def _denied(words: list[bytes], start: int) -> bool:
        """True if "not licensed" or the like leads to the passage."""
        return any(words[i] == b"not" and words[i + 1] in DENIED for i in range(max(0, start - DENIAL - SLACK), min(start + SLACK + 1, len(words) - 1)))

    def _expressions(self, words: list[bytes], at: dict[bytes, list[int]]) -> set[str]:
        """Labels of all identifiers in SPDX lines, whatever joins them."""
        labels: set[str] = set()
        for i in at.get(SPDX_LINE[0], ()):
            if tuple(words[i : i + 3]) != SPDX_LINE:
                continue
            i += 3
            while one := next(((ids, label) for ids, label in self.identifiers if tuple(words[i : i + len(ids)]) == ids), None):
                labels.add(one[1])
                i += len(one[0])
                if words[i : i + 2] == [b"or", b"later"]:
                    i += 1
                i += words[i : i + 1] in ([x] for x in SUFFIXES)
                if words[i : i + 1] == [b"with"]:
                    i = next((k for k in range(i + 1, min(i + 2 + EXCEPTION, len(words))) if words[k] in JOINS), len(words))
                if words[i : i + 1] not in ([x] for x in JOINS):
                    break
                i += 1
        return labels

    def _beginnings(self, at: dict[bytes, list[int]]) -> dict[int, list[int]]:
        """For each template that can be there, the beginnings for which enough of its telling places vote."""
        can = {t for t, needed in enumerate(self.required) if needed <= at.keys()}
        votes: dict[int, dict[int, set[int]]] = {}
        for w in sorted(at.keys() & self.postings.keys(), key=lambda w: -self.weight[w]) if can else ():
            for t, place in self.postings[w]:
                if t in can:
                    by_start = votes.setdefault(t, {})
                    for i in at[w]:
                        for start in range(i - place - SLACK, i - place + SLACK + 1):
                            by_start.setdefault(start, set()).add(place)
        return {t: [s for s, places in by_start.items() if len(places) >= self.votes[t]] for t, by_start in votes.items()}

    def _share(self, at: dict[bytes, list[int]], start: int, t: int) -> float:
        """Share of the template's weight that stands at its relative places, give or take SLACK."""
        got = total = 0.0
        for place, w in enumerate(self.templates[t][1]):
            total += self.weight[w]
            here = at.get(w, ())
            k = bisect_left(here, start + place - SLACK)
            if k < len(here) and here[k] <= start + place + SLACK:
                got += self.weight[w]
        return got / total

    @staticmethod
    def _has(words: list[bytes], at: dict[bytes, list[int]], low: int, high: int, phrase: list[bytes]) -> bool:
        """True if the phrase stands in words[low:high]."""
        here = at.get(phrase[0], ())
        return any(words[i : i + len(phrase)] == phrase for i in here[bisect_left(here, low) : bisect_left(here, high - len(phrase) + 1)])


    @staticmethod
    def _says(words: list[bytes], low: int, high: int, phrase: list[bytes]) -> bool:
        """True if the phrase, of any words, stands in words[low:high]."""
        return any(words[i : i + len(phrase)] == phrase for i in range(low, min(high, len(words)) - len(phrase) + 1))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text).

    Null texts are empty: no words, no labels (empty strings), score 0.  Equal rows give equal results, very long
    texts are scanned whole, and further columns of any name are ignored.  An empty table gives an empty result.
    """
    index = Index(*document_frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                n, first, last, base, labels, score = index.scan(words)
                rows.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(store.tidied(run), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
