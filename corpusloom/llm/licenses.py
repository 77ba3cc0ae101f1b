"""Licence recognition by sentences and ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_of

#: Fixed patterns, matched in full against normalised sentences (normalise() below: lower case, words and version numbers,
#: single spaces). Order matters: the first that matches names the sentence.
SENTENCES: list[tuple[str, str]] = [
    ("spdx", r"spdx-licen[cs]e-identifier (?P<v>[a-z0-9.+-]+)"),
    ("field", r"(?:the )?(?:project |package |code |software )?licen[cs]e (?:type |name |is )?(?:the )?(?P<n>{named})(?: licen[cs]e)?"),
    ("heading", r"(?:the )?(?P<n>{named}) licen[cs]e(?: \(?(?:mit|isc|mpl|apache|bsd)[a-z0-9. -]*\)?)?"),
    ("heading-mpl", r"mozilla public licen[cs]e(?: version| v)? 2\.0"),
    ("heading-gnu", r"gnu (?P<g>lesser |library |affero )?general public licen[cs]e(?: version)? (?P<v>[123](?:\.[01])?)(?: (?:\d\d? )?(?:january|february|march|april|may|june|july|august|september|october|november|december) .*)?"),
    ("mit-released", r"(?:this \w+ is |it is )?(?:released|licen[cs]ed|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat) licen[cs]e"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction.*)?"),
    ("mit-notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("as-is-mit", r"the software is provided as is without warranty of any kind.*"),
    ("no-liability-mit", r"in no event shall the authors or copyright holders be liable for any claim.*"),
    ("isc-grant", r"permission to use copy modify and ?(?:or)? distribute this software for any purpose with or without fee is hereby granted.*"),
    ("as-is-isc", r"the software is provided as is and (?:the authors?|isc|.* consortium) disclaims? all warranties.*"),
    ("apache-2.0", r"(?:this \w+ is )?licen[cs]ed under the apache licen[cs]e version 2\.?0?(?: the licen[cs]e)?"),
    ("apache-2.0-only-if", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0-obtain", r"you may obtain a copy of the licen[cs]e at.*"),
    ("apache-2.0-as-is", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:\d )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-name", r"(?:\d )?neither the name.*may be used to endorse or promote products.*"),
    ("bsd-advert", r"(?:\d )?all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*"),
    ("as-is-bsd", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("no-liability-bsd", r"in no event shall .* be liable for any direct indirect incidental.*"),
    ("bsd-named", r"(?:this \w+ is )?(?:released|licen[cs]ed|distributed) under (?:the )?(?:terms of )?(?:the )?(?P<v>[23])? ?clause bsd licen[cs]e"),
    ("lgpl", r"(?:this \w+ is )?(?:released|licen[cs]ed|distributed) under (?:the )?(?:terms of )?(?:the )?gnu (?:lesser|library) general public licen[cs]e(?: version)? (?P<v>[23](?:\.[01])?)(?P<later> or \(?at your option\)? any later version| or later)?"),
    ("agpl", r"(?:this \w+ is )?(?:released|licen[cs]ed|distributed) under (?:the )?(?:terms of )?(?:the )?gnu affero general public licen[cs]e(?: version)? (?P<v>3(?:\.0)?)(?P<later> or later)?"),
    ("gpl", r"(?:this \w+ is )?(?:released|licen[cs]ed|distributed) under (?:the )?(?:terms of )?(?:the )?gnu (?:general )?public licen[cs]e(?: version)? (?P<v>[123](?:\.0)?)(?P<later> or at your option any later version| or later)?"),
    ("gpl-free", r"this (?:program|file|library) is free software you can redistribute it and ?(?:or)? modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version (?P<v>[123])(?:\.0)? of the licen[cs]e (?P<later>or at your option any later version)"),
    ("lgpl-free", r"this (?:program|file|library) is free software you can redistribute it and ?(?:or)? modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation either version (?P<v>[23](?:\.[01])?) of the licen[cs]e (?P<later>or at your option any later version)"),
    ("gpl-hope", r"this (?:program|file|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl-details", r"see the gnu (?:lesser |library |affero )?general public licen[cs]e for more details"),
    ("gpl-received", r"you should have received a copy of the gnu .*"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?\.? ?2\.0"),
    ("mpl-obtain", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("cc", r"(?:this \w+ is |except where otherwise noted content is )?(?:released|licen[cs]ed|available|published) under (?:a |the )?(?:cc|creative commons)(?: licen[cs]e)? (?P<kind>by(?:-(?:nc|nd|sa))*|by(?: (?:nc|nd|sa))*|zero|0)(?: (?P<v>[1-4]\.0))?(?: international| unported)?(?: licen[cs]e)?"),
    ("public-domain", r"(?:this \w+ is |released )(?:free and unencumbered software released )?(?:in|into|to) the public domain"),
    ("see-license", r"(?:see|please refer to) (?:the )?(?:accompanying )?(?:file )?licen[cs]e(?: file)?(?:\.txt|\.md)? (?:file )?for (?:more )?(?:details|terms|information)"),
    ("reserved", r"all rights reserved"),
    ("copyright", r"(?:copyright|\(c\)|c)(?: \(c\)| c)? (?:19|20)\d\d.*"),
]
#: Names that headings and fields use, as patterns of normalised text, and what they stand for.
NAMED: list[tuple[str, str]] = [
    (r"mit|expat", "MIT"), (r"isc", "ISC"), (r"apache(?: software)?(?: licen[cs]e)?(?: version| v)?[ -]?2(?:\.0)?|apache-2\.0|asl 2\.0", "Apache-2.0"),
    (r"bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd|freebsd", "BSD-2-Clause"), (r"bsd[ -]3[ -]clause|3[ -]clause bsd|new bsd|modified bsd|revised bsd", "BSD-3-Clause"),
    (r"mpl[ -]2\.0|mozilla public(?: licen[cs]e)?(?: version| v)?[ -]?2\.0", "MPL-2.0"), (r"unlicen[cs]e|the unlicen[cs]e", "Unlicense"), (r"zlib", "Zlib"), (r"boost software|bsl-1\.0", "BSL-1.0"),
    (r"agpl[ -]?v?3(?:\.0)?(?:-only)?", "AGPL-3.0-only"), (r"agpl[ -]?v?3(?:\.0)?(?:\+|-or-later)", "AGPL-3.0-or-later"),
    (r"lgpl[ -]?v?2\.1(?:-only)?", "LGPL-2.1-only"), (r"lgpl[ -]?v?2\.1(?:\+|-or-later)", "LGPL-2.1-or-later"), (r"lgpl[ -]?v?3(?:\.0)?(?:-only)?", "LGPL-3.0-only"), (r"lgpl[ -]?v?3(?:\.0)?(?:\+|-or-later)", "LGPL-3.0-or-later"),
    (r"gpl[ -]?v?2(?:\.0)?(?:-only)?", "GPL-2.0-only"), (r"gpl[ -]?v?2(?:\.0)?(?:\+|-or-later)", "GPL-2.0-or-later"), (r"gpl[ -]?v?3(?:\.0)?(?:-only)?", "GPL-3.0-only"), (r"gpl[ -]?v?3(?:\.0)?(?:\+|-or-later)", "GPL-3.0-or-later"),
]
SENTENCES = [(name, p.replace("{named}", "|".join(x for x, _ in NAMED))) for name, p in SENTENCES]
#: Ordered rules: the sentences of a text, as identifiers in the order of the text, are searched for each rule's sequence from the
#: first rule on; others may stand between two of a sequence, but each sentence serves one rule only. {v}: the version found; {+}: "-or-later" or "-only".
RULES: list[tuple[tuple[str, ...], str]] = [
    (("spdx",), "{v}"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name", "as-is-bsd", "no-liability-bsd"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "as-is-bsd", "no-liability-bsd"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "as-is-bsd", "no-liability-bsd"), "BSD-2-Clause"),
    (("mit-grant", "mit-notice", "as-is-mit", "no-liability-mit"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant", "as-is-isc"), "ISC"),
    (("apache-2.0", "apache-2.0-only-if", "apache-2.0-obtain", "apache-2.0-as-is"), "Apache-2.0"),
    (("gpl-free", "gpl-hope", "gpl-details"), "GPL-{v}{+}"),
    (("lgpl-free", "gpl-hope", "gpl-details"), "LGPL-{v}{+}"),
    (("gpl-free",), "GPL-{v}{+}"),
    (("lgpl-free",), "LGPL-{v}{+}"),
    (("mpl-2.0", "mpl-obtain"), "MPL-2.0"),
    (("mpl-2.0",), "MPL-2.0"),
    (("apache-2.0",), "Apache-2.0"),
    (("mit-released",), "MIT"),
    (("bsd-named",), "BSD-{v}-Clause"),
    (("agpl",), "AGPL-{v}{+}"),
    (("lgpl",), "LGPL-{v}{+}"),
    (("gpl",), "GPL-{v}{+}"),
    (("cc",), "{cc}"),
    (("field",), "{n}"),
    (("heading-gnu",), "{g}"),
    (("heading-mpl",), "MPL-2.0"),
    (("heading",), "{n}"),
    (("public-domain",), "LicenseRef-public-domain"),
    (("see-license",), "LicenseRef-see-file"),
    (("reserved",), "LicenseRef-all-rights-reserved"),
]
#: A sentence is only looked at if it holds one of these; all patterns above need one. Words may stand on two lines.
HINT = re.compile(r"licen[cs]e|copyright|permission|warrant|liable|redistribut|reserved|public[^a-z0-9]+domain|endorse|advertising|spdx|\(c\)|©|free[^a-z0-9]+software|obtain|gnu|compliance|received|disclaim|creative[^a-z0-9]+commons|(?<![a-z0-9])cc(?![a-z0-9])|(?<![a-z0-9])c[^a-z0-9]+(?:19|20)\d\d", re.I)
#: Words that patterns start with, past a number; a sentence that starts otherwise is not looked at.
FIRST = re.compile(r"[^a-z0-9©]{0,400}(?:[0-9][^a-z0-9©]{1,400})?(?:©|(?:c|copyright|spdx-licen[cs]e-identifier|this|it|released|licen[cs]ed|distributed|available|provided|published|permission|the|in|into|to|free|isc|you|unless|redistributions?|neither|all|see|if|except|please|project|package|code|software|licen[cs]e|mit|expat|apache2?|asl|bsd|simplified|freebsd|new|modified|revised|mpl|mozilla|unlicen[cs]e|zlib|boost|bsl|agpl(?:v?[23])?|lgpl(?:v?[23])?|gpl(?:v?[23])?|gnu)(?![a-z0-9])|[23][^a-z0-9]{1,4}clause)", re.I)
#: Sentences end after . ! ? ; : and a gap (CUT), or, as some notices hold ; and :, only after . ! ? and a gap (STOP); the lines of a
#: paragraph are joined for that. They also end at a line's end, past lines that go on in lower case (WRAPPED).
CUT = re.compile(r"(?<=[.!?;:])(?<!dentifier:)(?<![\x20,]v\.)[\x20\x09-\x0D]+")
STOP = re.compile(r"(?<=[.!?])(?<![\x20,]v\.)[\x20\x09-\x0D]+")
WRAPPED = re.compile(r"\n(?=[a-z(\"'])")
#: Comment marks and indentation before a line.
MARKS = re.compile(r"^[ \t]*(?:(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|!+|>+|\|+|<!--+|(?:dnl|rem|REM)(?![^ \t\n]))[ \t]*)+|^[ \t]+", re.M)
BREAK, GAP, LETTER = re.compile("\n"), re.compile(r"[\x20\x09-\x0D]*"), re.compile(r"[^\W\d_]")
#: Code points that a sentence over several lines may have (the longest of the patterns' texts have about 700).
LONGEST = 4000
NOISE = re.compile(r"[^a-z0-9.+()\x20-]+")
_CASED = {name.lower(): name for _, name in RULES if "{" not in name}
_ALL = [(name, re.compile(p)) for name, p in SENTENCES]
_NAMED = [(re.compile(p), name) for p, name in NAMED]


def normalise(sentence: str) -> str:
    """Lower case, comment marks and punctuation but that of numbers and SPDX names gone, single spaces."""
    s = NOISE.sub(" ", sentence.lower().replace("/", " ").replace("©", "(c)").replace("\t", " "))
    return " ".join(w for w in (x.strip(".()+-") if x != "(c)" and not re.fullmatch(r"[a-z0-9.-]+\+", x) else x for x in s.split()) if w)


def sentence_ids(text: str) -> list[tuple[str, int, int, dict[str, str]]]:
    """(identifier, start, end, parts) of each known sentence of a text, in its order."""
    found = []
    flat = MARKS.sub(lambda m: " " * len(m[0]), text)  # keeps the length, so places stay true
    for lo, hi in _paragraphs(flat):
        if not HINT.search(flat, lo, hi):
            continue
        cuts = [m.span() for m in CUT.finditer(flat, lo, hi)]
        stops = [*(m.start() for m in STOP.finditer(flat, lo, hi)), hi]
        lines = [*(m.start() for m in BREAK.finditer(flat, lo, hi)), hi]
        runs = [k for k in lines if k == hi or not WRAPPED.match(text, k)]  # a marked or indented line may be one of a list
        starts: dict[int, int] = {}  # by the first place that is no gap: a line's start and the end of a cut may be the same
        for at in sorted({lo, *(b for _, b in cuts if b < hi), *(k + 1 for k in runs if k < hi)}):
            starts.setdefault(GAP.match(flat, at).end(), at)
        ends = [*(a for a, _ in cuts), hi]
        for at in starts.values():
            if not FIRST.match(flat, at, hi):
                continue
            line, *others = (x[bisect_left(x, at + 1)] for x in (lines, ends, stops, runs))
            tried = set()
            for end in (*others, line, min(line, others[0])):
                if end in tried or (end - at > LONGEST and end > line):
                    continue
                tried.add(end)
                if (hit := _known(flat[at:end])) is not None:
                    name, parts = hit
                    if found and found[-1][0] == name and at < found[-1][2] and not LETTER.search(flat, found[-1][1], at):
                        found.pop()  # the same sentence, from the number or mark before it
                    # a copyright line holds any words, so it ends with its line
                    found.append((name, at, min(end, line) if name == "copyright" else end, parts))
                    break
    return found


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of lines that are not blank."""
    at, lo, hi = 0, -1, 0
    for line in text.split("\n"):
        if line.strip():
            lo, hi = at if lo < 0 else lo, at + len(line)
        elif lo >= 0:
            yield lo, hi
            lo = -1
        at += len(line) + 1
    if lo >= 0:
        yield lo, hi


def _known(sentence: str) -> tuple[str, dict[str, str]] | None:
    if HINT.search(sentence):
        norm = normalise(sentence)
        for name, p in _ALL:
            if m := p.fullmatch(norm):
                return name, {k: v for k, v in m.groupdict().items() if v}
    return None


def _name(rule: str, parts: dict[str, str]) -> str:
    if rule == "{cc}":
        kind = parts["kind"].replace(" ", "-")
        return "CC0-1.0" if kind in ("zero", "0") else f"CC-{kind.upper()}" + (f"-{parts['v']}" if "v" in parts else "")
    if rule == "{n}":
        return next(name for p, name in _NAMED if p.fullmatch(parts["n"]))
    v = parts.get("v", "")
    if rule == "{g}":
        v += "" if "." in v else ".0"
        return {"lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}.get(parts.get("g", "").strip(), "GPL") + f"-{v}-only"
    if rule == "{v}":
        return _CASED.get(v, v)
    if "{+}" in rule and "." not in v:
        v += ".0"
    return rule.replace("{v}", v or "unknown").replace("{+}", "-or-later" if "later" in parts else "-only")


def licences(ids: list[tuple[str, int, int, dict[str, str]]]) -> list[str]:
    """Names by the ordered rules, each once, in the order in which they are found; sentences serve one rule each. A name that only a heading gives is left
    out where a rule has found a licence of that name, in whatever form it is granted (-only, -or-later).

    Each identifier's places wait in a list. A rule goes through the lists of its sequence once, as a place that one match has passed by is
    before all later ones, so the cost is in proportion to the sentences."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(ids):
        places.setdefault(x[0], []).append(i)
    out: list[str] = []
    for sequence, name in RULES:
        lists = [places.get(x, []) for x in sequence]
        heads, used = [0] * len(sequence), set()
        while all(lists):
            match, last = [], -1
            for k, at in enumerate(lists):
                while heads[k] < len(at) and (at[heads[k]] <= last or at[heads[k]] in used):
                    heads[k] += 1
                if heads[k] == len(at):
                    break
                last = at[heads[k]]
                match.append(last)
            if len(match) < len(sequence):
                break
            used.update(match)
            parts: dict[str, str] = {}
            for i in match:
                parts |= ids[i][3]
            found = _name(name, parts)
            if found not in out and not (sequence[0].startswith("heading") and any(x.startswith(found.removesuffix("-only")) for x in out)):
                out.append(found)
        for x in set(sequence) if used else ():
            places[x] = [i for i in places[x] if i not in used]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = sentence_ids(text) if HINT.search(text) else []
            names = licences(ids)
            rows.append((doc_id, names, len(ids), " ".join(x[0] for x in ids), ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in ids)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "licences", "n_sentences", "sentence_ids", "spans"])


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences (array of SPDX names or LicenseRef-), n_sentences, sentence_ids and spans (identifier:start:end, code
    points) of every row of docs.

    Null and empty texts hold no sentence. Rows are judged one by one: null doc_ids, ties and repeated rows stay as they are;
    columns besides doc_id and text are not read. Nothing is shuffled, and a task holds one batch of texts.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    return d.mapInArrow(_scan, "doc_id long, licences array<string>, n_sentences long, sentence_ids string, spans string")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))


QUERIES = {"op5_licences": op5_licences}
ORACLES: dict[str, str] = {}
