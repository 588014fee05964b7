"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, anything but letters and digits to one
blank) and mapped to the identifier of a known licence sentence.  The identifiers, in text order, are then
matched against ordered rules: a rule fits where its identifiers follow one another with at most
``GAP`` characters of other text between; at each place the longest rule wins and what it used is used up.

A licence may be wrapped, so a text is cut twice: once at line ends and at sentence ends, once at blank
lines and at sentence ends only; a place counts once.

Edge cases: a null text counts as empty; an empty text has no licences; a text of any length is
scanned whole; repeated rows are scanned alike; known sentences that fit no rule are counted but name no
licence; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.common import pick

#: Characters between two sentences of one rule, at most.
GAP = 400

#: How a text says that it is under a licence, and what may follow the licence's name in that sentence.
GRANT = r"(?:.* )?(?:released|licensed|licenced|distributed|available|published|provided|covered|redistributed|dedicated|offered)(?: \w+)? under (?:the )?(?:terms of )?(?:the |an? )?"
TAIL = r"(?: (?:see|as|in|which|you|unless|copyright|by|and|or|for|with|the|a|file|found|that|included|international|unported) ?.*)?"
#: Licences that a sentence can name: a pattern over normalised text, whose groups give a version or variant, and the rule's name.  Fixed values.
NAMES = {
    "mit": (r"(?:mit(?: x11| expat)?|expat|x11) licen[sc]e", "MIT"),
    "isc": (r"isc licen[sc]e", "ISC"),
    "zlib": (r"zlib(?: libpng)? licen[sc]e", "Zlib"),
    "boost": (r"boost software licen[sc]e(?: v| version )?(?: ?1 0)?", "BSL-1.0"),
    "wtfpl": (r"(?:wtfpl|do what the f\w+ you want to public licen[sc]e)(?: v| version )?(?: ?2)?", "WTFPL"),
    "unlicense": (r"unlicen[sc]e", "Unlicense"),
    "apache": (r"apache(?: software)? licen[sc]e(?: v| version |,? )?(?P<v>\d(?: \d)?)?", "Apache-{v}"),
    "gnu": (
        r"gnu (?P<k>general|lesser general|library general|affero general) public licen[sc]e(?:(?: v| version |,? )(?P<v>\d(?: \d)?))?(?: of the licen[sc]e)?(?P<p> or (?:at your option )?(?:any )?(?:later|newer))?(?: version)?(?: only)?",
        "{k}-{v}{p}",
    ),
    "gpl": (r"(?:gnu )?(?P<k>gpl|lgpl|agpl)(?: licen[sc]e)?(?: ?v| version |,? )?(?P<v>\d(?: \d)?)?(?P<p> or (?:at your option )?(?:any )?(?:later|newer))?(?: version)?(?: only)?(?: licen[sc]e)?", "{k}-{v}{p}"),
    "mpl": (r"(?:mozilla public licen[sc]e|mpl)(?: v| version |,? )?(?P<v>\d(?: \d)?)?", "MPL-{v}"),
    "epl": (r"(?:eclipse public licen[sc]e|epl)(?: v| version |,? )?(?P<v>\d(?: \d)?)?", "EPL-{v}"),
    "artistic": (r"artistic licen[sc]e(?: v| version |,? )?(?P<v>\d(?: \d)?)?", "Artistic-{v}"),
    "bsd": (r"(?:bsd (?P<n>[023]) clause|(?P<m>[023]) clause bsd)(?: licen[sc]e)?", "BSD-{n}{m}-Clause"),
    "bsd-new": (r"(?:new|modified|revised) bsd licen[sc]e", "BSD-3-Clause"),
    "bsd-simple": (r"(?:simplified|freebsd) (?:bsd )?licen[sc]e", "BSD-2-Clause"),
    "cc0": (r"(?:cc0|cc zero|creative commons zero)(?: v| version )?(?: ?1 0)?(?: universal)?(?: licen[sc]e)?", "CC0-1.0"),
    "cc": (r"(?:cc|creative commons)(?: licen[sc]e)? (?P<k>by(?: nc)?(?: sa| nd)?)(?: (?P<v>\d \d))?(?: international)?(?: licen[sc]e)?", "CC-{k}-{v}"),
    "cc-words": (
        r"creative commons (?P<k>attribution(?: non ?commercial)?(?: share ?alike| no ?derivatives| no ?derivs)?)(?: (?P<v>\d \d))?(?: international| unported)?(?: licen[sc]e)?", "CC-{k}-{v}",
    ),
}

#: Known licence sentences as patterns over normalised text; a group names a version or variant.  Fixed values.
SENTENCES = {
    "mit-title": r"(?:the )?mit licen[sc]e(?: mit)?",
    "mit-permission": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": r"the software is provided as is without warranty of any kind express or implied .*",
    "mit-liability": r"in no event shall the authors or copyright holders be liable for any claim damages or other liability .*",
    "apache-compliance": r"you may not use this file except in compliance with the licen[sc]e",
    "apache-copy": r"you may obtain a copy of the licen[sc]e at(?: http\S* .*)?",
    "apache-basis": r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis .*",
    "apache-limits": r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e",
    "gpl-later": r"(?:.* )?you can redistribute it and or modify it under the terms of the gnu (?P<k>general|lesser general|library general|affero general) public licen[sc]e as published by the free software foundation(?: either)? version (?P<v>\d(?: \d)?) of the licen[sc]e or(?: at your option)?(?P<p> any later) version",
    "gpl-exact": r"(?:.* )?you can redistribute it and or modify it under the terms of the gnu (?P<k>general|lesser general|library general|affero general) public licen[sc]e(?: as published by the free software foundation)? version (?P<v>\d(?: \d)?)(?: of the licen[sc]e)?(?: only)?(?: as published by the free software foundation)?",
    "gpl-terms": r"(?:.* )?you can redistribute it and or modify it under the terms of the gnu (?P<k>general|lesser general|library general|affero general) public licen[sc]e(?: as published by the free software foundation)?",
    "gpl-version": r"either version (?P<v>\d(?: \d)?) of the licen[sc]e or(?: at your option)?(?P<p> any later) version",
    "gpl-only": r"(?:only )?version (?P<v>\d(?: \d)?) of the licen[sc]e(?: only)?",
    "gpl-hope": r"this (?:program|library|file|software|work) is distributed in the hope that it will be useful but without any warranty .*",
    "gpl-copy": r"you should have received a copy of the gnu (?:general|lesser general|library general|affero general) public licen[sc]e along with this (?:program|library|file|software|work).*",
    "bsd-permitted": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*",
    "bsd-source": r"(?:\d )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": r"(?:\d )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": r"(?:\d )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-permission": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted .*",
    "mpl-terms": r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?(?P<v>\d(?: \d)?)",
    "unlicense-text": r"this is free and unencumbered software released into the public domain",
    "zlib-warranty": r"this software is provided as is without any express or implied warranty",
    "zlib-permission": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely .*",
    "boost-permission": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e .*",
    "spdx": r"(?:.* )?spdx licen[sc]e identifier (?P<v>[a-z0-9 ]+)",
} | {f"{name}-short": GRANT + pattern + TAIL for name, (pattern, _) in NAMES.items()}

#: Ordered rules: the sentences that make up a licence's text or notice, and its name; {x} is a sentence's group.  Fixed values.
RULES = (
    (("mit-permission", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("mit-permission", "mit-notice", "mit-warranty"), "MIT"),
    (("mit-permission", "mit-notice"), "MIT"),
    (("apache-short", "apache-compliance", "apache-copy", "apache-basis", "apache-limits"), "Apache-{v}"),
    (("apache-short", "apache-copy", "apache-basis", "apache-limits"), "Apache-{v}"),
    (("gpl-terms", "gpl-version", "gpl-hope", "gpl-copy"), "{k}-{v}{p}"),
    (("gpl-terms", "gpl-only", "gpl-hope", "gpl-copy"), "{k}-{v}{p}"),
    (("gpl-later", "gpl-hope", "gpl-copy"), "{k}-{v}{p}"),
    (("gpl-exact", "gpl-hope", "gpl-copy"), "{k}-{v}{p}"),
    (("gpl-terms", "gpl-hope", "gpl-copy"), "{k}"),
    (("gpl-terms", "gpl-version"), "{k}-{v}{p}"),
    (("gpl-terms", "gpl-only"), "{k}-{v}{p}"),
    (("gpl-later",), "{k}-{v}{p}"),
    (("gpl-exact",), "{k}-{v}{p}"),
    (("gpl-terms",), "{k}"),
    (("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-permitted", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("zlib-warranty", "zlib-permission"), "Zlib"),
    (("zlib-permission",), "Zlib"),
    (("boost-permission",), "BSL-1.0"),
    (("isc-permission",), "ISC"),
    (("mpl-terms",), "MPL-{v}"),
    (("unlicense-text",), "Unlicense"),
    (("spdx",), "SPDX:{v}"),
    *(((f"{name}-short",), rule) for name, (_, rule) in NAMES.items()),
)
#: What variants are called in a licence's name.  Fixed values.
FAMILIES = {
    "general": "GPL", "lesser general": "LGPL", "library general": "LGPL", "affero general": "AGPL", "attribution": "BY", "attribution non commercial": "BY-NC", "attribution noncommercial": "BY-NC",
    "attribution share alike": "BY-SA", "attribution sharealike": "BY-SA", "attribution no derivatives": "BY-ND", "attribution noderivatives": "BY-ND", "attribution no derivs": "BY-ND",
    "attribution non commercial share alike": "BY-NC-SA", "attribution noncommercial sharealike": "BY-NC-SA", "attribution noncommercial noderivatives": "BY-NC-ND",
}
#: What every known sentence holds, whatever its words.
SIGNS = re.compile(
    r"unlicen[sc]e|licen[sc]e|permission|redistribut|warranty|public domain|in no event|either version|cc0|cc[ -]zero|creative commons|cc[ -]by|gpl|mpl|epl|wtfpl|[023][ -]clause", re.IGNORECASE
)

_KNOWN = [(name, re.compile(pattern)) for name, pattern in SENTENCES.items()]
_ENDS = re.compile(r"[.!?;:](?=\s|$)|\n[ \t\r]*\n")
_LINE_ENDS = re.compile(r"[.!?;](?=\s|$)|\n")
_OTHER = re.compile(r"[\W_]+")


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def _sentences(text: str, ends: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(start, end, sentence) without the blanks around it."""
    at = 0
    for stop in [m.end() for m in ends.finditer(text)] + [len(text)]:
        raw = text[at:stop]
        bare = raw.strip()
        if bare:
            start = at + len(raw) - len(raw.lstrip())
            yield start, start + len(bare), bare
        at = stop


def identified(text: str | None) -> list[tuple[int, int, str, dict[str, str]]]:
    """(start, end, identifier, groups) of the known sentences, in text order and disjoint."""
    if not text or not SIGNS.search(text):
        return []
    found = {}
    for ends in (_ENDS, _LINE_ENDS):
        for start, end, sentence in _sentences(text, ends):
            if SIGNS.search(sentence):
                plain = normalised(sentence)
                named = " under " in plain  # else no licence is merely named
                for name, pattern in _KNOWN:
                    if (named or not name.endswith("-short")) and (m := pattern.fullmatch(plain)):
                        found.setdefault((start, -end), (start, end, name, {k: v or "" for k, v in m.groupdict().items()}))
                        break
    out, at = [], 0
    for _, hit in sorted(found.items(), key=lambda x: x[0]):
        if hit[0] >= at:
            out.append(hit)
            at = hit[1]
    return out


def _name(rule: str, hits: list[tuple[int, int, str, dict[str, str]]]) -> str:
    """The rule's name with what the sentences say of version and variant; what they do not say is left out."""
    groups: dict[str, str] = {}
    for hit in hits:
        groups |= {k: v for k, v in hit[3].items() if v or k not in groups}
    version, gnu = groups.get("v", ""), rule.startswith("{k}")
    if rule.startswith("SPDX"):
        groups["v"] = version.replace(" ", "-")
    else:
        groups["v"] = version.replace(" ", ".") + (".0" if version and " " not in version else "")
    if "k" in groups:
        groups["k"] = FAMILIES.get(groups["k"], groups["k"].upper().replace(" ", "-"))
    groups["p"] = ("-or-later" if groups.get("p") else "-only") if gnu and version else ""
    return rule.format(**{"k": "", "n": "", "m": ""} | groups).rstrip("-")


def licences(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, licence) of each place where a rule fits, in order."""
    return matched(identified(text))


def matched(hits: list[tuple[int, int, str, dict[str, str]]]) -> list[tuple[int, int, str]]:
    """(start, end, licence) of each place where a rule fits the known sentences, the longest first."""
    out, i = [], 0
    while i < len(hits):
        best: tuple[int, str] | None = None
        for ids, name in RULES:
            part = hits[i : i + len(ids)]
            if tuple(h[2] for h in part) == ids and all(b[0] - a[1] <= GAP for a, b in zip(part, part[1:])) and (best is None or len(ids) > best[0]):
                best = (len(ids), _name(name, part))
        if best:
            out.append((hits[i][0], hits[i + best[0] - 1][1], best[1]))
            i += best[0]
        else:
            i += 1
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_sentences, licences, spans) for every row: known sentences, distinct licences in order, and their places."""

    @F.pandas_udf("n_sentences long, licences string, spans string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                known = identified(text)
                found = matched(known)
                rows.append((len(known), ",".join(dict.fromkeys(x[2] for x in found)), ",".join(f"{n}:{s}:{e}" for s, e, n in found)))
            yield pd.DataFrame(rows, columns=["n_sentences", "licences", "spans"])

    return pick(docs, id_col, text_col).select(id_col, scanned(F.col(text_col)).alias("s")).select(id_col, "s.*")
