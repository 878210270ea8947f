"""Licence scans by sentences: each normalised sentence that is known gives an identifier, and ordered rules match the sequence of identifiers.

Sentences of licences are looked up whole. Those that name a licence, or say a known thing in other surroundings, are told by patterns within them.

All of it is DataFrame expressions. A rule takes its identifiers out of the sequence, so that a later, shorter rule does not see them again; one
identifier of another licence may stand between two of a rule, and stays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_L, _UNDER = "licen[cs]e", "(?:under|by|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


def _v(number: str) -> str:
    """A version in a licence's name, as (version) 2.0 or v2, the v next to the name too."""
    whole, _, part = number.partition(".")
    return rf"(?: as published by the free software foundation)?(?: either)?(?: ?version| ?v)? ?{whole}" + ("(?: 0)?" if part in ("", "0") else f" {part}")


# Licences known by name. Identifier, licence, and the name in lower case with one space for whatever is not a letter or digit.
NAMES = [
    ("AGPL3", "AGPL-3.0", rf"(?:gnu )?affero general public {_L}{_v('3')}|(?:gnu )?agpl{_v('3')}"),
    ("LGPL3", "LGPL-3.0", rf"(?:gnu )?(?:lesser|library) general public {_L}{_v('3')}|(?:gnu )?lgpl{_v('3')}"),
    ("LGPL21", "LGPL-2.1", rf"(?:gnu )?(?:lesser|library) general public {_L}{_v('2.1')}|(?:gnu )?lgpl{_v('2.1')}"),
    ("LGPL20", "LGPL-2.0", rf"(?:gnu )?(?:lesser|library) general public {_L}{_v('2')}|(?:gnu )?lgpl{_v('2')}"),
    ("LGPL", "LGPL", rf"(?:gnu )?(?:lesser|library) general public {_L}|gnu lgpl"),
    ("GPL3", "GPL-3.0", rf"gnu general public {_L}{_v('3')}|(?:gnu )?gpl{_v('3')}"),
    ("GPL2", "GPL-2.0", rf"gnu general public {_L}{_v('2')}|(?:gnu )?gpl{_v('2')}"),
    ("GPL1", "GPL-1.0", rf"gnu general public {_L}{_v('1')}|(?:gnu )?gpl{_v('1')}"),
    ("GPLANY", "GPL", rf"gnu general public {_L}|gnu gpl"),
    ("GFDL13", "GFDL-1.3", rf"gnu free documentation {_L}{_v('1.3')}"),
    ("GFDL12", "GFDL-1.2", rf"gnu free documentation {_L}{_v('1.2')}"),
    ("GFDL", "GFDL", rf"gnu free documentation {_L}"),
    ("APACHE2", "Apache-2.0", rf"licen[cs]ed under the apache {_L}{_v('2')}|apache (?:software )?{_L}{_v('2')}|apache(?: v)? ?2 0 licen[cs]ed?|under (?:the )?apache(?: {_L})?{_v('2')}"),
    ("APACHE11", "Apache-1.1", rf"apache (?:software )?{_L}{_v('1.1')}"),
    ("MPL2", "MPL-2.0", rf"mozilla public {_L}{_v('2')}"),
    ("MPL11", "MPL-1.1", rf"mozilla public {_L}{_v('1.1')}"),
    ("EPL2", "EPL-2.0", rf"eclipse public {_L}{_v('2')}"),
    ("EPL1", "EPL-1.0", rf"eclipse public {_L}{_v('1')}"),
    ("CPL1", "CPL-1.0", rf"common public {_L}{_v('1')}"),
    ("CDDL11", "CDDL-1.1", rf"common development and distribution {_L}(?: cddl)?{_v('1.1')}"),
    ("CDDL1", "CDDL-1.0", rf"common development and distribution {_L}(?: cddl)?(?:{_v('1')})?"),
    ("EUPL12", "EUPL-1.2", rf"(?:european union public {_L}|eupl){_v('1.2')}"),
    ("EUPL11", "EUPL-1.1", rf"(?:european union public {_L}|eupl){_v('1.1')}"),
    ("ARTISTIC2", "Artistic-2.0", rf"artistic {_L}{_v('2')}"),
    ("ARTISTIC1", "Artistic-1.0", rf"artistic {_L}(?:{_v('1')})?"),
    ("BOOST", "BSL-1.0", rf"boost software {_L}(?:{_v('1')})?"),
    ("BUSL", "BUSL-1.1", rf"business source {_L}(?:{_v('1.1')})?"),
    ("OFL11", "OFL-1.1", rf"(?:sil )?open font {_L}(?:{_v('1.1')})?"),
    ("ODBL", "ODbL-1.0", rf"open (?:data commons open )?database {_L}(?:{_v('1')})?"),
    ("PSF", "PSF-2.0", rf"(?:python software foundation|psf) {_L}(?:{_v('2')})?"),
    ("ZLIBREF", "Zlib", rf"zlib(?: libpng)? {_L}"),
    ("WTFPL", "WTFPL", rf"do what the fuck you want to public {_L}|wtfpl"),
    ("BSD0", "0BSD", rf"(?:zero clause|0 clause) bsd(?: {_L})?|bsd (?:zero|0) clause(?: {_L})?|0bsd {_L}"),
    ("BSD2", "BSD-2-Clause", rf"(?:two|2) clause bsd(?: {_L})?|bsd (?:two|2) clause(?: {_L})?|(?:simplified|freebsd) bsd {_L}"),
    ("BSD3", "BSD-3-Clause", rf"(?:three|3) clause bsd(?: {_L})?|bsd (?:three|3) clause(?: {_L})?|(?:new|modified|revised) bsd {_L}"),
    ("BSD4", "BSD-4-Clause", rf"(?:four|4) clause bsd(?: {_L})?|bsd (?:four|4) clause(?: {_L})?"),
    ("BSDANY", "BSD", rf"bsd(?: style)? licen[cs]ed?"),
    ("MITREF", "MIT", rf"(?:released|licen[cs]ed|distributed|available) {_UNDER}(?:mit|expat)(?: {_L})?|(?:mit|expat)(?: style)? licen[cs]ed?"),
    ("ISCREF", "ISC", "isc licen[cs]ed?"),
    ("CC0", "CC0-1.0", "cc0(?: 1 0)?|dedicated to the public domain"),
    ("UNLICENSEREF", "Unlicense", "under (?:the )?unlicen[cs]e"),
]
#: Creative Commons licences, by their parts and versions.
CC = [("BY-NC-SA", "by nc sa", "attribution non ?commercial share ?alike"), ("BY-NC-ND", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"), ("BY-NC", "by nc", "attribution non ?commercial"), ("BY-SA", "by sa", "attribution share ?alike"), ("BY-ND", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("BY", "by", "attribution")]
NAMES += [(f"CC{part.replace('-', '')}" + ("" if v == "4.0" else v.replace(".", "")), f"CC-{part}-{v}", rf"(?:cc {short}|creative commons {long})(?: {_L})?(?: version| v)? ?{v.replace('.', ' ')}(?: international| generic| unported)?") for part, short, long in CC for v in ("4.0", "3.0", "2.5", "2.0", "1.0")]
# Sentences of licences and notices that do not name one.
SENTENCES = [
    ("MITGRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MITNOTICE", "the above copyright notice and this permission notice shall be included in all copies"),
    ("BOOSTGRANT", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("BOOSTNOTICE", "the copyright notices in the software and this entire statement including the above license grant"),
    ("ASIS", "(?:the|this) (?:font )?software is provided (?:by .{0,80} )?as is"),
    ("ISCNOTICE", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCGRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSDREDIST", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSDSOURCE", "redistributions of source code must retain the above copyright notice"),
    ("BSDBINARY", "redistributions in binary form must reproduce the above copyright notice"),
    ("BSDADVERT", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSDENDORSE", "neither the name of .{0,120} may be used to endorse or promote products"),
    ("APACHECOMPLY", "you may not use this file except in compliance with the licen[cs]e"),
    ("MPLCOMPLY", "a copy of the mpl was not distributed with this file"),
    ("ZLIBGRANT", "permission is granted to anyone to use this software for any purpose"),
    ("ZLIBORIGIN", "the origin of this software must not be misrepresented"),
    ("ZLIBALTERED", "altered source versions must be plainly marked as such"),
    ("ZLIBKEEP", "this notice may not be removed or altered from any source distribution"),
    ("EITHER3", "either version 3"),
    ("EITHER21", "either version 2 1"),
    ("EITHER2", "either version 2"),
    ("EITHER1", "either version 1"),
    ("LATER", "or (?:at your option )?(?:any )?later(?: version)?"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("RESERVED", "all rights reserved"),
]
# Whole sentences of licences, by identifier. A sentence that is one of them, however it is written and wrapped, is looked up; patterns are for the others.
WHOLE = {
    "MITGRANT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "MITNOTICE": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    ],
    "ASIS": [
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "This software is provided 'as-is', without any express or implied warranty",
    ],
    "ISCGRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "BSDREDIST": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSDSOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BSDBINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BSDENDORSE": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "APACHECOMPLY": ["you may not use this file except in compliance with the License"],
    "ZLIBGRANT": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "ZLIBORIGIN": ["The origin of this software must not be misrepresented"],
    "ZLIBALTERED": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"],
    "ZLIBKEEP": ["This notice may not be removed or altered from any source distribution"],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain"],
    "RESERVED": ["All rights reserved"],
}


def normalised(sentence: str) -> str:
    """Lower case, and one space for whatever is not a letter or digit; a number or letter of a list in front is no part of a sentence."""
    return re.sub(NUMBERED, "", re.sub("[^a-z0-9]+", " ", sentence.lower()).strip())


#: What counts the items of a list.
NUMBERED = "^(?:[0-9]{1,2}|[a-z]) "
LOOKUP = {normalised(x): name for name, some in WHOLE.items() for x in some}

# Rules of several sentences, the first to match first. A licence and its identifiers in order.
RULES = [
    ("BSD-4-Clause", ["BSDREDIST", "BSDSOURCE", "BSDBINARY", "BSDADVERT", "BSDENDORSE", "ASIS"]),
    ("BSD-3-Clause", ["BSDREDIST", "BSDSOURCE", "BSDBINARY", "BSDENDORSE", "ASIS"]),
    ("BSD-3-Clause", ["BSDREDIST", "BSDSOURCE", "BSDBINARY", "BSDENDORSE"]),
    ("BSD-2-Clause", ["BSDREDIST", "BSDSOURCE", "BSDBINARY", "ASIS"]),
    ("BSD-2-Clause", ["BSDREDIST", "BSDSOURCE", "BSDBINARY"]),
    ("MIT", ["MITGRANT", "MITNOTICE", "ASIS"]),
    ("MIT", ["MITGRANT", "MITNOTICE"]),
    ("BSL-1.0", ["BOOSTGRANT", "BOOSTNOTICE", "ASIS"]),
    ("BSL-1.0", ["BOOSTGRANT", "BOOSTNOTICE"]),
    ("ISC", ["ISCGRANT", "ISCNOTICE", "ASIS"]),
    ("ISC", ["ISCGRANT", "ISCNOTICE"]),
    ("0BSD", ["ISCGRANT", "ASIS"]),
    ("Zlib", ["ASIS", "ZLIBGRANT", "ZLIBORIGIN", "ZLIBALTERED", "ZLIBKEEP"]),
    ("Zlib", ["ZLIBGRANT", "ZLIBORIGIN", "ZLIBALTERED", "ZLIBKEEP"]),
    ("Unlicense", ["UNLICENSE", "ASIS"]),
    ("Apache-2.0", ["APACHE2", "APACHECOMPLY", "APACHE2"]),
    ("Apache-2.0", ["APACHE2", "APACHECOMPLY"]),
    ("MPL-2.0", ["MPL2", "MPLCOMPLY"]),
    ("AGPL-3.0-or-later", ["AGPL3", "LATER"]),
    ("LGPL-3.0-or-later", ["LGPL3", "LATER"]),
    ("LGPL-2.1-or-later", ["LGPL21", "LATER"]),
    ("LGPL-2.0-or-later", ["LGPL20", "LATER"]),
    ("LGPL-3.0-or-later", ["LGPL", "EITHER3", "LATER"]),
    ("LGPL-2.1-or-later", ["LGPL", "EITHER21", "LATER"]),
    ("LGPL-2.0-or-later", ["LGPL", "EITHER2", "LATER"]),
    ("LGPL-3.0", ["LGPL", "EITHER3"]),
    ("LGPL-2.1", ["LGPL", "EITHER21"]),
    ("LGPL-2.0", ["LGPL", "EITHER2"]),
    ("GPL-3.0-or-later", ["GPL3", "LATER"]),
    ("GPL-2.0-or-later", ["GPL2", "LATER"]),
    ("GPL-1.0-or-later", ["GPL1", "LATER"]),
    ("GPL-3.0-or-later", ["GPLANY", "EITHER3", "LATER"]),
    ("GPL-2.0-or-later", ["GPLANY", "EITHER2", "LATER"]),
    ("GPL-1.0-or-later", ["GPLANY", "EITHER1", "LATER"]),
    ("GFDL-1.3-or-later", ["GFDL13", "LATER"]),
    ("GFDL-1.2-or-later", ["GFDL12", "LATER"]),
    ("GPL-3.0", ["GPLANY", "EITHER3"]),
    ("GPL-2.0", ["GPLANY", "EITHER2"]),
]
# Identifiers that are a licence by themselves, beside the names.
SINGLE = {name: licence for name, licence, _ in NAMES} | {"UNLICENSE": "Unlicense", "RESERVED": "Proprietary", "ISCGRANT": "0BSD", "MITGRANT": "MIT", "BOOSTGRANT": "BSL-1.0"}
#: Licence identifiers after the SPDX tag, with their ending.
TAG = "spdx licen[cs]e identifier "
_TAGGED = sorted({licence for _, licence, _ in NAMES}, key=lambda x: (-len(x), x))
TAGS = [(f"TAG:{x}{end}", TAG + re.sub("[^a-z0-9]+", " ", (x + end).lower())) for x in _TAGGED for end in ("-or-later", "-only", "")]
SINGLE |= {name: name.removeprefix("TAG:").removesuffix("-only") for name, _ in TAGS}
KNOWN = TAGS + SENTENCES + [(name, pattern) for name, _, pattern in NAMES]
ANY = r"\b(?:" + "|".join(f"(?:{p})" for _, p in KNOWN) + r")\b"
#: A sentence ends at a mark before white space, or at an empty line. A text with a known sentence has a match of HINT, and so has the sentence.
END = r"[.!?;:][\"')]*\s+|\n\s*\n"
HINT = r"licen[cs]|permission|redistribut|provided|endorse|version|later|domain|creative|cc[^a-z0-9]*(?:by|0)|rights\s|software|gpl|eupl|wtfpl|bsd|misrepresented|altered|this[^a-z0-9]+entire|advertising|the[^a-z0-9]+mpl|apache|(?:under|by|to|of|the)[^a-z0-9]+(?:mit|expat)"
#: A plus sign after a short name is "or later".
#: A full stop within a version, as in v. 2.0, ends no sentence; a tag's colon neither.
JOINED = [(r"\b(v|ver|version)\.\s*([0-9])", "{0}1 {0}2"), (r"(spdx-license-identifier):\s*", "{0}1 "), (r"\b([al]?gpl(?:[ -]?v)?[ -]?[1-3](?:\.[0-9])?)\+", "{0}1 or later")]


def _sequence(ids: list[str]) -> tuple[str, str]:
    """What matches a rule's identifiers with at most one other between two, and what is left of it, groups written {0}n."""
    return "((?:,[^,]+,)??)".join(f",{re.escape(i)}," for i in ids), "".join(f"{{0}}{k}" for k in range(1, len(ids)))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, sentences, licenses, unmatched.

    sentences are the identifiers found in order; licenses the licences of the rules that matched in order of the rules, each as often as it was found,
    and then those of identifiers that are a licence by themselves, in order of place; unmatched the identifiers that neither took; all joined by commas,
    empty where there are none, as for null and empty texts. A sentence that holds several known ones gives each in order of place, but none within
    another; of two at one place the first listed. Lines of one sentence are joined. Between the parts of a sentence that names somebody
    (who provides a software, whose name may not be used) at most 80 or 120 characters stand. Repeated rows give the same row each; extra columns are not read; an
    empty table gives no rows.
    """
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    sentences = F.create_map(*[F.lit(x) for pair in LOOKUP.items() for x in pair])

    def identifiers(sentence):
        return F.element_at(F.transform(F.array(F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))), of_plain), 1)

    def of_plain(plain):
        whole = F.try_element_at(sentences, F.regexp_replace(plain, NUMBERED, ""))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(F.regexp_extract_all(plain, F.lit(ANY), F.lit(0)), identifier))

    def identifier(match):
        out = None
        for name, pattern in KNOWN:
            hit = F.regexp_like(match, F.lit(f"^(?:{pattern})$"))
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out

    whole = low
    for pattern, to in JOINED:
        whole = F.regexp_replace(whole, pattern, to.format("$"))
    hinted = F.filter(F.split(whole, END), lambda s: F.regexp_like(s, F.lit(HINT)))
    found = F.when(F.regexp_like(low, F.lit(HINT)), F.flatten(F.transform(hinted, identifiers))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    rows = rows.select("doc_id", F.array_join("found", ",").alias("sentences"), F.when(F.size("found") > 0, F.concat(F.lit(","), F.array_join("found", ",,"), F.lit(","))).otherwise("").alias("left"))
    parts = []
    for k, (name, ids) in enumerate(RULES):
        pattern, rest = _sequence(ids)
        rows = rows.withColumns({f"n{k}": F.when(F.col("left") != "", F.regexp_count("left", F.lit(pattern))).otherwise(0), "left": F.when(F.col("left") != "", F.regexp_replace("left", pattern, rest.format("$"))).otherwise("")})
        parts.append(F.array_repeat(F.lit(name), F.col(f"n{k}")))
    ids = F.filter(F.split("left", ","), lambda x: x != "")
    licence = F.create_map(*[F.lit(x) for pair in SINGLE.items() for x in pair])
    rows = rows.select("doc_id", "sentences", F.concat(*parts).alias("ruled"), ids.alias("ids"))
    single = F.filter(F.transform("ids", lambda x: F.try_element_at(licence, x)), lambda x: x.isNotNull())
    left = F.filter("ids", lambda x: ~x.isin(list(SINGLE)))
    return rows.select("doc_id", "sentences", F.array_join(F.concat("ruled", single), ",").alias("licenses"), F.array_join(left, ",").alias("unmatched"))


def oracle() -> str:
    """The same in the SQL of the correctness check."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    case = " ".join(f"WHEN regexp_full_match(x, {text(p)}) THEN {text(n)}" for n, p in KNOWN)
    whole_map = "MAP {" + ", ".join(f"{text(a)}: {text(b)}" for a, b in LOOKUP.items()) + "}"
    whole = "lower(coalesce(text, ''))"
    for pattern, to in JOINED:
        whole = f"regexp_replace({whole}, {text(pattern)}, {text(to.format(chr(92)))}, 'g')"
    steps, names, last = [], [], "f"
    for k, (name, ids) in enumerate(RULES):
        pattern, rest = _sequence(ids)
        steps.append(f"r{k} AS (SELECT * REPLACE (regexp_replace(rest, {text(pattern)}, {text(rest.format(chr(92)))}, 'g') AS rest), len(regexp_extract_all(rest, {text(pattern)})) AS n{k} FROM {last})")
        names.append(f"list_transform(range(n{k}), lambda i: {text(name)})")
        last = f"r{k}"
    singles = "MAP {" + ", ".join(f"{text(a)}: {text(b)}" for a, b in SINGLE.items()) + "}"
    return f"""
        WITH s AS (SELECT doc_id, list_filter(string_split_regex({whole}, {text(END)}), lambda s: regexp_matches(s, {text(HINT)})) AS parts FROM documents),
        w AS (SELECT doc_id, list_transform(parts, lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS plain, {whole_map} AS known FROM s),
        g AS (SELECT doc_id, flatten(list_transform(plain, lambda p: CASE WHEN known[regexp_replace(p, {text(NUMBERED)}, '')] IS NOT NULL THEN [known[regexp_replace(p, {text(NUMBERED)}, '')]] ELSE list_transform(regexp_extract_all(p, {text(ANY)}), lambda x: CASE {case} END) END)) AS found FROM w),
        f AS (SELECT doc_id, coalesce(array_to_string(found, ','), '') AS sentences, CASE WHEN len(found) > 0 THEN ',' || array_to_string(found, ',,') || ',' ELSE '' END AS rest FROM g),
        {", ".join(steps)},
        e AS (SELECT *, list_filter(string_split(rest, ','), lambda x: x <> '') AS ids, {singles} AS m FROM {last})
        SELECT doc_id, sentences,
            coalesce(array_to_string(list_concat(flatten([{", ".join(names)}]), list_filter(list_transform(ids, lambda x: m[x]), lambda x: x IS NOT NULL)), ','), '') AS licenses,
            coalesce(array_to_string(list_filter(ids, lambda x: m[x] IS NULL), ','), '') AS unmatched FROM e"""
