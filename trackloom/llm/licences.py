"""License scans by sentence-rule recognition.

A text is cut into lines and sentences; neighbouring pieces are joined, however many they are, as long as they
can still become a known sentence, and pieces without letters and digits are passed over. A normalised sentence
(lower case, letters, digits and single blanks) that fits a known pattern becomes that pattern's identifier,
with the version it states. Of sentences that overlap the one that ends first counts, and of these the longest:
a beginning that is never finished hides nothing that follows. Where a pattern may begin with any words, these
are looked for no further back than the piece in which its fixed words begin, and words in the middle of a
pattern never run over another beginning of it. The sequence of identifiers is then matched from left to
right against ordered licence rules; at each place the first rule that fits wins and consumes its identifiers,
and an identifier that no rule begins with is passed over.

Defined cases: null and empty text has no identifiers and no licences; a licence stated twice is found twice
in the sequence but listed once; repeated rows are scanned each; very long texts are scanned whole; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import recut, table

#: Every pattern of SENTENCES needs one of these within a single word, so no line break parts them, or fits SHORT;
#: a text, in lower case, with neither has no licence sentence.
HINTS = ("licenc", "licens", "copyright", "spdx", "permission", "redistribut", "warrant", "applicable", "gpl", "bsd", "commons", "domain", "unencumbered", "reserved", "endorse", "advertising", "altered", "misrepresented", "proprietary", "unauthori", "reproduce")
SHORT = regex.compile(r"(?<![a-z0-9])(?:c(?:[^a-z0-9]+c)?[^a-z0-9]+(?:\d|by(?![a-z0-9]))|cc[^a-z0-9]+(?:zero|0|by|attribution)|(?:apache|mit|expat|x11|isc|mpl|epl|bsl)(?![a-z]))")
CUT = regex.compile(r"(?<=[.!?;:])\s+|\s*\n\s*")
SPDX = regex.compile(r"SPDX-License-Identifier:\s*([\w.+() -]*[\w+)])", regex.IGNORECASE)

_V = r"(?: version| v)? ?(?P<v>\d(?: \d)?)"
_WORK = r"(?:this (?:work|file|text|document|program|software|code|project|article|content|page) (?:is |are )?)?"
_OPEN = rf"{_WORK}(?:is )?(?:licen[cs]ed|released|distributed|available|published|made available|provided) under(?: the(?: terms of(?: the)?)?)?"
_FREE = r"(?:.* )?(?:is|are) (?:dual )?(?:licen[cs]ed|released|distributed|made available|provided) under(?: the(?: terms of(?: the)?)?)?"
_LATER = r"(?: only|(?P<later> or (?:at your option )?(?:any )?later(?: version)?))?"
_MONTH = r"(?:january|february|march|april|may|june|july|august|september|october|november|december)"
#: Identifier and names of licences that a sentence may state, by their titles or SPDX names. Fixed values.
NAMED: list[tuple[str, str]] = [
    ("apache", rf"apache (?:software )?license{_V}(?: the license)?|apache (?P<v>\d \d)(?: licen[cs]e)?"),
    ("mit", r"(?:mit|expat|x11)(?: licen[cs]e)?"),
    ("isc", r"isc(?: licen[cs]e)?"),
    ("bsd", r"(?:(?:new|modified|revised|simplified) )?(?:(?P<v>[234]) clause )?bsd licen[cs]e|bsd (?P<v>[234]) clause(?: licen[cs]e)?"),
    ("gpl", rf"(?:gnu )?(?:general public licen[cs]e|gpl)(?:{_V})?{_LATER}"),
    ("lgpl", rf"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)(?:{_V})?{_LATER}"),
    ("agpl", rf"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?:{_V})?{_LATER}"),
    ("mpl", rf"(?:mozilla public license|mpl){_V}"),
    ("epl", rf"(?:eclipse public license|epl){_V}"),
    ("boost", rf"(?:boost software license|bsl){_V}"),
]
#: Titles with which the licences' own texts begin. Fixed values.
TITLES: list[tuple[str, str]] = [
    ("mit-title", r"(?:the )?mit license(?: mit)?"),
    ("isc-title", r"(?:the )?isc license(?: isc)?"),
    ("bsd-title", r"(?:the )?bsd (?P<v>[234]) clause license"),
    ("apache-title", rf"apache license version (?P<v>\d(?: \d)?) {_MONTH} \d{{4}}"),
    ("gpl-title", rf"gnu general public license version (?P<v>\d(?: \d)?)(?: \d\d?)? {_MONTH} \d{{4}}"),
    ("lgpl-title", rf"gnu (?:lesser|library) general public license version (?P<v>\d(?: \d)?)(?: \d\d?)? {_MONTH} \d{{4}}"),
    ("agpl-title", rf"gnu affero general public license version (?P<v>\d(?: \d)?)(?: \d\d?)? {_MONTH} \d{{4}}"),
    ("mpl-title", r"mozilla public license version (?P<v>\d(?: \d)?)"),
]
#: Identifier and pattern of the whole normalised sentence. The licences' own words.
SENTENCES: list[tuple[str, str]] = [
    ("copyright", r"(?:copyright|c)(?: c)? (?:\d{4}.*|by .*)"),
    ("all-rights-reserved", r"(?:.* )?all rights reserved"),
    ("spdx", r"spdx license identifier (?P<v>.+)"),
    ("apache-compliance", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at.*"),
    ("apache-no-warranty", r"unless required by applicable law or agreed to in writing.*"),
    ("apache-see", r"see the license for the specific language governing permissions and.*"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-no-warranty", r"the software is provided as is without warranty of any kind.*"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:\d )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-name", r"(?:\d )?neither the name of .* may be used to endorse or promote products.*"),
    ("bsd-advertising", r"(?:\d )?all advertising materials mentioning features or use of this software must display.*"),
    ("bsd-no-warranty", r"this software is provided by the .* as is and any express or implied warranties.*"),
    ("gpl-grant", rf"this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either{_V} of the license or at your option any later version"),
    ("lgpl-grant", rf"this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either{_V} of the license or at your option any later version"),
    ("gpl-no-warranty", r"this (?:program|library|file|software) is distributed in the hope that it will be useful but without any warranty.*"),
    ("mpl", rf"this source code form is subject to the terms of the mozilla public license{_V}"),
    ("cc", rf"{_OPEN}(?: a)? (?:cc|creative commons) (?P<kind>zero|0|by(?: nc)?(?: sa| nd)?|attribution(?: non ?commercial)?(?: share ?alike| no ?deriv\w*)?)(?:{_V})?(?: (?:international|unported|generic|universal))?(?: licen[cs]e)?"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:.* )?(?:is|are)?(?: hereby)? ?(?:placed in|released into|dedicated to) the public domain"),
    ("zlib-origin", r"(?:\d )?the origin of this software must not be misrepresented.*"),
    ("zlib-altered", r"(?:\d )?altered source versions must be plainly marked as such.*"),
    ("zlib-notice", r"(?:\d )?this notice may not be removed or altered from any source distribution"),
    ("wtfpl", r".*do what the fuck you want to public license.*"),
    ("proprietary", r"(?:.* )?(?:proprietary and confidential|unauthori[sz]ed copying of this file.*|no part of this .* may be reproduced.*)"),
]
SENTENCES += [(name, rf"{_OPEN} (?:{names})(?: see .*)?") for name, names in NAMED]
SENTENCES += [(name, rf"{_FREE} (?:{names})(?: see .*)?") for name, names in NAMED]
SENTENCES += TITLES
KNOWN = [(name, regex.compile(p)) for name, p in SENTENCES]


def unbounded(pattern: str) -> bool:
    """Whether a pattern begins with any words or has any words in its middle, so that any text may go on to fit it."""
    return pattern.startswith(("(?:.* )?", ".*")) or " .* " in pattern


def finder(pattern: str) -> regex.Pattern:
    """Finds an unbounded pattern in pieces that each end a line; tails run to the end of their piece."""
    free = pattern.startswith((".*", "(?:.* )?"))
    p = pattern.removeprefix("(?:.* )?").removeprefix(".*")
    cut = " " if free else r"\n"
    p = regex.sub(r"([^|(]*(?:\([^()]*\)\?)?[^|(]*) \.\* ", lambda m: f"{m[1]} (?:(?!{cut}{m[1]} )(?s:.))+? ", p).replace(".*", "[^\n]*")
    begin = "" if pattern.startswith(".*") else "(?<![a-z0-9])(?=[a-z0-9])" if free else "(?<=\n)"
    return regex.compile(rf"{begin}(?:{p})(?=\n)".replace(" ", "[ \n]"))


#: Sentences that begin with known words and go on with known words: whether a text may become one is seen from its beginning.
BEGUN = regex.compile("|".join(p for _, p in SENTENCES if not unbounded(p)))
#: The sentences with a free subject are looked for together, as they share their beginning.
FREE = rf"{_FREE} (?:{'|'.join(names for _, names in NAMED)})(?: see .*)?"
FINDERS = [finder(p) for p in [*(p for _, p in SENTENCES if unbounded(p) and not p.startswith(_FREE)), FREE]]
#: Ordered rules: identifiers in their order (those ending in ? may lack) and the licence; {v} is the version of the first identifier that has one.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("copyright?", "mit-grant", "mit-notice?", "mit-no-warranty?"), "MIT"),
    (("copyright?", "isc-grant", "mit-no-warranty?"), "ISC"),
    (("copyright?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name?", "bsd-no-warranty?"), "BSD-4-Clause"),
    (("copyright?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-no-warranty?"), "BSD-3-Clause"),
    (("copyright?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-no-warranty?"), "BSD-2-Clause"),
    (("copyright?", "apache", "apache-compliance?", "apache-copy?", "apache-no-warranty?", "apache-see?"), "Apache-{v}"),
    (("copyright?", "lgpl-grant", "gpl-no-warranty?"), "LGPL-{v}-or-later"),
    (("copyright?", "gpl-grant", "gpl-no-warranty?"), "GPL-{v}-or-later"),
    (("copyright?", "zlib-origin", "zlib-altered", "zlib-notice"), "Zlib"),
    (("unlicense",), "Unlicense"),
    (("spdx",), "{v}"),
    (("copyright?", "mit", "mit-no-warranty?"), "MIT"),
    (("copyright?", "isc"), "ISC"),
    (("copyright?", "bsd"), "BSD-{v}-Clause"),
    (("copyright?", "agpl", "gpl-no-warranty?"), "AGPL-{v}"),
    (("copyright?", "lgpl", "gpl-no-warranty?"), "LGPL-{v}"),
    (("copyright?", "gpl", "gpl-no-warranty?"), "GPL-{v}"),
    (("copyright?", "mpl"), "MPL-{v}"),
    (("copyright?", "epl"), "EPL-{v}"),
    (("copyright?", "cc"), "CC-{v}"),
    (("copyright?", "boost"), "BSL-{v}"),
    (("mit-title",), "MIT"),
    (("isc-title",), "ISC"),
    (("bsd-title",), "BSD-{v}-Clause"),
    (("apache-title",), "Apache-{v}"),
    (("gpl-title",), "GPL-{v}"),
    (("lgpl-title",), "LGPL-{v}"),
    (("agpl-title",), "AGPL-{v}"),
    (("mpl-title",), "MPL-{v}"),
    (("wtfpl",), "WTFPL"),
    (("public-domain",), "Public-Domain"),
    (("copyright?", "proprietary"), "Proprietary"),
    (("copyright", "all-rights-reserved"), "Proprietary"),
    (("all-rights-reserved",), "Proprietary"),
]


def normal(sentence: str) -> str:
    return " ".join(regex.findall(r"[a-z0-9]+", sentence.lower()))


def version(v: str | None) -> str:
    """Of the form 2.0; a missing one is unknown."""
    v = (v or "").replace(" ", ".")
    return v if "." in v else f"{v}.0" if v else "unknown"


def identify(sentence: str) -> tuple[str, str] | None:
    """Identifier and version of a normalised sentence."""
    for name, pattern in KNOWN:
        if m := pattern.fullmatch(sentence):
            groups = m.groupdict()
            v = groups.get("v")
            if name == "cc":
                kind = groups["kind"].replace("attribution", "by").replace("non commercial", "nc").replace("noncommercial", "nc")
                kind = regex.sub(r"share ?alike", "sa", regex.sub(r"no ?deriv\w*", "nd", kind)).upper().replace(" ", "-").replace("ZERO", "0")
                return name, f"0-{version(v or '1')}" if kind == "0" else f"{kind}-{version(v)}"
            if name == "spdx":
                return name, v.replace(" ", "-")
            if name in ("bsd", "bsd-title"):
                return name, v or "unknown"
            return name, version(v) + ("-or-later" if groups.get("later") else "")
    return None


def hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in HINTS) or SHORT.search(low) is not None


def identifiers(text: str | None) -> list[tuple[str, str]]:
    """The known sentences of the whole text, in order."""
    if not text or not hinted(text):
        return []
    raw, pieces = [], []
    for x in CUT.split(text):
        if piece := normal(x):
            raw.append(x)
            pieces.append(piece)
    ends = []  # (last piece, first piece) of all known sentences
    for i, whole in enumerate(pieces):
        j = i
        while (m := BEGUN.fullmatch(whole, partial=True)) and m.partial and j + 1 < len(pieces):
            j += 1
            whole = f"{whole} {pieces[j]}"
        if m and not m.partial:
            ends.append((j, i))
    lines = "\n".join(["", *pieces, ""])
    begins = list(accumulate((len(x) + 1 for x in pieces), initial=1))
    for pattern in FINDERS:
        ends += [(bisect_right(begins, m.end() - 1) - 1, bisect_right(begins, m.start()) - 1) for m in pattern.finditer(lines)]
    found, after = [], 0
    for j, i in sorted(ends):
        if i >= after:
            got = identify(" ".join(pieces[i : j + 1]))
            said = SPDX.search(" ".join(raw[i : j + 1])) if got[0] == "spdx" else None
            found.append((got[0], said[1]) if said else got)
            after = j + 1
    return found


def licences(found: list[tuple[str, str]]) -> list[str]:
    """Licences of a sequence of identifiers, each once, in the order found."""
    out, i = [], 0
    while i < len(found):
        for rule, licence in RULES:
            at, v, some = i, None, False
            for name in rule:
                maybe = name.endswith("?")
                if at < len(found) and found[at][0] == name.removesuffix("?"):
                    v = v or (found[at][1] if found[at][1] != "unknown" else None)
                    at, some = at + 1, some or not maybe
                elif not maybe:
                    break
            else:
                if some:
                    out.append(licence.format(v=v or "unknown"))
                    i = at - 1
                    break
        i += 1
    return list(dict.fromkeys(out))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order), licences of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(batches):
            found = [identifiers(x) for x in b.column(1).to_pylist()]
            strings = pa.list_(pa.string())
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array([[n for n, _ in x] for x in found], strings), pa.array([licences(x) for x in found], strings)], ["doc_id", "sentences", "licences"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentences array<string>, licences array<string>")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).selectExpr("doc_id", "cast(size(sentences) as bigint) as n_sentences", "array_join(sentences, ' ') as sentences", "array_join(licences, ' ') as licences")


QUERIES = {"op6_licences": op6_licences}
