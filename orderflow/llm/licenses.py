"""License scans with ordered signature rules.

Hundreds of regular expressions: names of license families in sentence forms, and sentences of license texts
and notices written by hand (SIGNATURES), each gated by a word of its own that every match holds. A version may be glued to the name (GPLv2). A detection has a byte interval; one that lies inside the interval
of a detection of higher priority, or of equal priority and greater length, is suppressed. A detection up
to four words after a negation ("not licensed under the ...") counts for nothing. Base
phrases (PHRASES) are places where a phrase's words stand consecutively; no rule suppresses them.

Defined results: a null or empty text has no words, no places and no labels, null first_word and
last_word and score 0; repeated rows are scanned one by one; equal intervals of equal priority go to
the rule that stands first; an empty table gives an empty one; other columns stay untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import as_bytes, buffer_of, map_arrow, word_spans

#: Phrases and labels of the base scan.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

_SEP, _EDGE_A, _EDGE_B = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"


def _words(text: str) -> bytes:
    """Words of a name with any separators between them; `?` after a word makes it optional."""
    out = b""
    for i, w in enumerate(text.split()):
        one, optional = re.escape(w.rstrip("?").encode()), w.endswith("?")
        out += (b"(?:" + one + _SEP + b")?") if optional else one + (_SEP if i < len(text.split()) - 1 else b"")
    return out


#: (label, keyword preferred as gate, names, versions). Names are written as words; a version is written as its digits.
FAMILIES = [
    ("apache", "apache", ["apache software? license", "apache"], ["1 0", "1 1", "2 0"]),
    ("mit", "mit", ["mit x11? license", "mit"], []),
    ("expat", "expat", ["expat license"], []),
    ("bsd-2-clause", "bsd", ["bsd 2 clause license?", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", "bsd", ["bsd 3 clause license?", "new bsd license", "modified bsd license", "revised bsd license"], []),
    ("bsd-4-clause", "bsd", ["bsd 4 clause license?", "original bsd license"], []),
    ("bsd", "bsd", ["bsd license", "bsd style license"], []),
    ("0bsd", "bsd", ["zero clause bsd license?", "0bsd"], []),
    ("isc", "isc", ["isc license"], []),
    ("gpl", "gnu", ["gnu general public license", "gnu gpl"], ["1", "2", "3"]),
    ("gpl", "gpl", ["gpl"], ["1", "2", "3"]),
    ("lgpl", "gnu", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"], ["2", "2 1", "3"]),
    ("lgpl", "lgpl", ["lgpl"], ["2", "2 1", "3"]),
    ("agpl", "affero", ["gnu? affero general public license"], ["1", "3"]),
    ("agpl", "agpl", ["agpl"], ["1", "3"]),
    ("gfdl", "gnu", ["gnu free documentation license"], ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", ["mozilla public license"], ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", ["eclipse public license"], ["1 0", "2 0"]),
    ("edl", "eclipse", ["eclipse distribution license"], ["1 0"]),
    ("cddl", "common", ["common development and distribution license"], ["1 0", "1 1"]),
    ("cpl", "common", ["common public license"], ["1 0"]),
    ("eupl", "european", ["european union public license"], ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", ["perl? artistic license"], ["1 0", "2 0"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"], []),
    ("libpng", "libpng", ["libpng license"], []),
    ("boost", "boost", ["boost software license"], ["1 0"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["2"]),
    ("psf", "python", ["python software foundation license", "psf license"], ["2"]),
    ("ofl", "font", ["sil? open font license"], ["1 0", "1 1"]),
    ("ms-pl", "microsoft", ["microsoft public license"], []),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"], []),
    ("odbl", "database", ["open database license"], ["1 0"]),
    ("odc-by", "commons", ["open data commons attribution license"], ["1 0"]),
    ("pddl", "domain", ["public domain dedication and license"], ["1 0"]),
    ("cc0", "cc0", ["cc0"], ["1 0"]),
    ("cc-by", "cc", ["cc by"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "cc", ["cc by sa"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "cc", ["cc by nd"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "cc", ["cc by nc"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "creative", ["creative commons attribution license?"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "creative", ["creative commons attribution sharealike license?", "creative commons attribution share alike license?"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "creative", ["creative commons attribution noderivatives license?", "creative commons attribution noderivs license?"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "creative", ["creative commons attribution noncommercial license?", "creative commons attribution non commercial license?"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", "creative", ["creative commons attribution noncommercial sharealike license?"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "creative", ["creative commons attribution noncommercial noderivatives license?"], ["2 0", "2 5", "3 0", "4 0"]),
    ("public-domain", "domain", ["released into the public domain", "dedicated to the public domain", "in the public domain"], []),
    ("all-rights-reserved", "rights", ["all rights reserved"], []),
    ("proprietary", "proprietary", ["proprietary and confidential", "proprietary license"], []),
]
#: Sentence forms around a name: (words before, priority, confidence). A bare name is the weakest.
FORMS = [
    (["licensed under the", "licensed under", "released under the", "released under", "distributed under the terms of the", "distributed under the", "under the terms of the", "available under the"], 3, 0.98),
    (["under the", "under", "subject to the", "governed by the"], 2, 0.9),
    (["spdx license identifier"], 3, 0.99),
    ([], 1, 0.6),
]
#: Names that are ordinary words or short marks count only in a sentence form or with a version.
WEAK = {"mit", "apache", "gpl", "mpl", "lgpl", "agpl", "unlicense", "cc0", "cc by"}


#: Sentences of license texts and notices: (label, keyword that every match holds, words, priority,
#: confidence). `*` stands for up to four words, `a|b` for either.
SIGNATURES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6, 0.99),
    ("mit-0", "hereby", "permission is hereby granted free of charge to any person obtaining a copy * to deal in the software without restriction", 7, 0.95),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement in no event shall the authors", 4, 0.8),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 5, 0.95),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", 6, 0.95),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 7, 0.98),
    ("bsd-2-clause", "conclusions", "views and conclusions contained in the software and documentation are those of the authors", 5, 0.85),
    ("isc", "purpose", "permission to use copy modify and|or distribute this software for any purpose with or without fee is hereby granted", 6, 0.97),
    ("0bsd", "purpose", "permission to use copy modify and|or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 7, 0.9),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license", 5, 0.95),
    ("apache-2", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements", 6, 0.98),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 5, 0.85),
    ("apache", "apache", "apache software foundation", 1, 0.4),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 6, 0.98),
    ("gpl-2", "version", "gnu general public license as published by the free software foundation either version 2 of the license", 8, 0.98),
    ("gpl-2", "version", "gnu general public license as published by the free software foundation version 2", 7, 0.97),
    ("gpl-3", "version", "gnu general public license as published by the free software foundation either version 3 of the license", 8, 0.98),
    ("gpl-3", "version", "gnu general public license as published by the free software foundation version 3", 7, 0.97),
    ("gpl-2", "gpl", "gpl 2 0 only|or later?", 6, 0.97),
    ("gpl-3", "gpl", "gpl 3 0 only|or later?", 6, 0.97),
    ("gpl-with-classpath-exception", "classpath", "gnu|gpl * with|and classpath exception", 9, 0.97),
    ("gpl-with-classpath-exception", "independent", "permission to link this library with independent modules to produce an executable", 8, 0.95),
    ("gpl-with-gcc-exception", "gcc", "gcc runtime library exception", 9, 0.97),
    ("gpl-with-font-exception", "exception", "gpl * with font|fonts exception", 9, 0.95),
    ("gpl-with-autoconf-exception", "autoconf", "configuration script generated by autoconf you may include it under the same distribution terms", 9, 0.97),
    ("lgpl", "lesser", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 7, 0.98),
    ("lgpl-2.1", "lesser", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license", 8, 0.98),
    ("lgpl-2.1", "lgpl", "lgpl 2 1 only|or later?", 6, 0.97),
    ("lgpl-3", "lgpl", "lgpl 3 0 only|or later?", 6, 0.97),
    ("agpl-3", "affero", "gnu affero general public license as published by the free software foundation either version 3", 8, 0.98),
    ("agpl-3", "agpl", "agpl 3 0 only|or later?", 6, 0.97),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 7, 0.99),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 7, 0.98),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", 6, 0.97),
    ("cddl", "common", "the contents of this file are subject to the terms of the common development and distribution license", 6, 0.97),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 6, 0.98),
    ("libpng", "libpng", "this copy of the libpng notices is provided for your convenience", 6, 0.97),
    ("boost-1", "boost", "distributed under the boost software license version 1 0", 6, 0.98),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 7, 0.99),
    ("wtfpl", "fuck", "do what the fuck you want to public license", 6, 0.98),
    ("beerware", "beer", "you can buy me a beer in return", 5, 0.9),
    ("beerware", "beer", "beer ware license", 5, 0.95),
    ("json", "evil", "the software shall be used for good not evil", 6, 0.97),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 5, 0.9),
    ("openssl", "openssl", "openssl license", 3, 0.85),
    ("python-2", "python", "psf license agreement for python", 5, 0.95),
    ("php-3", "php", "php license version 3 0|01", 5, 0.97),
    ("ruby", "ruby", "under the terms of the ruby license", 4, 0.85),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising", 6, 0.97),
    ("ncsa", "illinois", "university of illinois ncsa open source license", 6, 0.97),
    ("postgresql", "postgresql", "postgresql license", 4, 0.9),
    ("artistic-2", "artistic", "under the terms of the artistic license 2 0", 5, 0.95),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 6, 0.99),
    ("cc0-1", "cc0", "cc0 1 0 universal", 5, 0.98),
    ("cc0-1", "neighboring", "has waived all copyright and related or neighboring rights to this work", 6, 0.95),
    ("cc-by", "creative", "this work is licensed under a|the creative commons attribution", 3, 0.9),
    ("cc-by-nc", "noncommercial", "licensed under a|the creative commons attribution noncommercial", 4, 0.92),
    ("cc-by-nc", "commercial", "licensed under a|the creative commons attribution non commercial", 4, 0.92),
    ("non-commercial", "commercial", "for non commercial use only", 4, 0.85),
    ("non-commercial", "noncommercial", "for noncommercial use only", 4, 0.85),
    ("research-only", "research", "for research purposes only", 4, 0.7),
    ("no-derivatives", "derivative", "no derivative works are permitted|allowed", 4, 0.8),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited", 6, 0.97),
    ("proprietary", "reproduced", "no part of this * may be reproduced", 5, 0.8),
    ("proprietary", "trade", "contains confidential and trade secret information", 5, 0.85),
    ("all-rights-reserved", "reserved", "all rights are reserved", 3, 0.7),
    ("public-domain", "domain", "has been placed in|into the public domain", 4, 0.9),
    ("public-domain", "domain", "this work is in the public domain", 4, 0.9),
]


def _signature(words: str) -> bytes:
    out = b""
    for i, w in enumerate(words.split()):
        gap = _SEP if i else b""
        if w == "*":
            out += b"(?:" + _SEP + rb"[0-9a-z\x80-\xff]+){0,4}?"
        elif w.endswith("?"):
            out += b"(?:" + gap + re.escape(w[:-1].encode()) + b")?"
        else:
            out += gap + b"(?:" + b"|".join(re.escape(a.encode()) for a in w.split("|")) + b")"
    return out


def _gate(keyword: str, name: str) -> bytes:
    """A word that each match of the name holds: the one with the keyword, else the longest."""
    must = [w for w in name.split() if not w.endswith("?")]
    return next((w for w in must if keyword in w), max((w for w in must if w != "license"), key=len, default=must[0])).encode()


#: A negation up to four words before a detection, in the same clause.
_NEGATED = re.compile(rb"(?:^|[^0-9a-z])(?:not|never|nor|neither|no longer|isn['\x80-\xff]{1,3}t|without)(?:\s+[0-9a-z\x80-\xff-]+){0,4}\s+$")


def _refuted(text: bytes, start: int, end: int, label: str) -> bool:
    """Whether the words around a detection say that it is none: a negation before it, or a longer term."""
    if label == "public-domain" and text[end : end + 8].lstrip().startswith((b"name", b"suffix")):
        return True
    return _NEGATED.search(text[max(0, start - 96) : start]) is not None


class Rules:
    """The compiled rules: (keyword, regex, label, priority, confidence), built once in a process."""

    def __init__(self):
        self.rules = []
        for family, keyword, names, versions in FAMILIES:
            for name in names:
                for before, priority, confidence in FORMS:
                    lead = b"(?:" + b"|".join(_words(b) for b in before) + b")" + _SEP if before else b""
                    for version in [*versions, None]:
                        if version is None and name in WEAK and not before:
                            continue
                        # A bare name with a digit glued to it may be anything else (apache2), but for GPL2 and the like.
                        glued = b"v?" if not name[-1].isdigit() and (before or name.endswith("pl")) else b"v"
                        tail = b"" if version is None else b"(?:" + _SEP + b"(?:(?:version|v)" + _SEP + b"|v)?|" + glued + b")" + _words(version.removesuffix(" 0")) + (b"(?:" + _SEP + b"0)?" if version.endswith(" 0") else b"")
                        label = family if version is None else f"{family}-{version.removesuffix(' 0').replace(' ', '.')}"
                        body = _words(name) if not name.endswith("?") else _words(name.rsplit(" ", 1)[0]) + b"(?:" + _SEP + re.escape(name.rsplit(" ", 1)[1].rstrip("?").encode()) + b")?"
                        self.rules.append((_gate(keyword, name), re.compile(_EDGE_A + lead + body + tail + _EDGE_B), label, priority + (version is not None), confidence))
        for label, keyword, words, priority, confidence in SIGNATURES:
            gate = next(w for w in words.split() if keyword in w and not w.endswith("?") and "|" not in w)
            self.rules.append((gate.encode(), re.compile(_EDGE_A + _signature(words) + _EDGE_B), label, priority, confidence))
        self.keywords = [(k, re.compile(_EDGE_A + re.escape(k) + b"(?:(?=v?[0-9])|" + _EDGE_B + b")")) for k in sorted({r[0] for r in self.rules})]
        self.base = [(label, _words(phrase).split(_SEP)[-1], re.compile(_EDGE_A + _words(phrase) + _EDGE_B)) for phrase, label in PHRASES]

    def scan(self, text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Base places, and the rule detections that no other suppresses, as byte intervals."""
        base = [(m.start(), m.end(), label) for label, word, regex in self.base if word in text for m in regex.finditer(text)]
        here = {k for k, whole in self.keywords if k in text and whole.search(text)}
        found = []
        if here:
            for order, (keyword, regex, label, priority, confidence) in enumerate(self.rules):
                if keyword in here:
                    found += [(-priority, m.start() - m.end(), order, m.start(), m.end(), label, confidence) for m in regex.finditer(text) if not _refuted(text, m.start(), m.end(), label)]
        kept: list[tuple[int, int, str, float]] = []
        at: list[int] = []
        reach: list[int] = []  # kept intervals by start, and the farthest end up to each
        for _, _, _, a, b, label, confidence in sorted(found):
            k = int(np.searchsorted(at, a, side="right")) if at else 0
            if k and reach[k - 1] >= b:
                continue
            at.insert(k, a)
            reach.insert(k, max(b, reach[k - 1] if k else 0))
            for j in range(k + 1, len(reach)):
                if reach[j] >= b:
                    break
                reach[j] = b
            kept.append((a, b, label, confidence))
        return base, sorted(kept)


_RULES: list[Rules] = []


def rules() -> Rules:
    if not _RULES:
        _RULES.append(Rules())
    return _RULES[0]


PLACES = "array<struct<first_word:int,words:int,label:string>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, base places, rule detections (both with word positions) and the score: the chance
    that at least one of them is real, with 0.98 for a base place."""
    place = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("label", T.StringType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("base", place), T.StructField("detections", place), T.StructField("score", T.DoubleType())])
    arrow_place = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("label", pa.string())]))

    def run(batch: pa.RecordBatch) -> dict:
        raw, offsets = buffer_of(batch.column(1))
        low, starts, _, first = word_spans(raw, offsets)
        base, found, score = [], [], []
        for r in range(batch.num_rows):
            text = low[offsets[r] : offsets[r + 1]].tobytes()
            b, d = rules().scan(text)
            own = starts[first[r] : first[r + 1]] - offsets[r] if b or d else None

            def words(a: int, e: int, own=own) -> tuple[int, int]:
                i = int(np.searchsorted(own, a))
                return i, int(np.searchsorted(own, e)) - i

            base.append([dict(zip(("first_word", "words", "label"), (*words(x, y), label), strict=True)) for x, y, label in b])
            found.append([dict(zip(("first_word", "words", "label"), (*words(x, y), label), strict=True)) for x, y, label, _ in d])
            score.append(1.0 - float(np.prod([1 - c for *_, c in d] + [0.02] * len(b))))
        return {"doc_id": batch.column(0), "n_words": pa.array(np.diff(first)), "base": pa.array(base, arrow_place), "detections": pa.array(found, arrow_place), "score": pa.array(score)}

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("t")), run, schema)


def report(docs: DataFrame) -> DataFrame:
    """The digest that the query op10_licenses returns."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    labels = lambda c: F.transform(c, lambda p: p["label"])
    starts = F.transform("base", lambda p: p["first_word"].cast("long"))
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels("base")).alias("base_labels"), joined(F.concat(labels("base"), labels("detections"))).alias("labels"), "score",
    )
