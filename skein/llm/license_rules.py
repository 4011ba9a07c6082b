"""Signature rules of licences, in order: (label, keyword, pattern, priority).

Patterns match normalised words joined by single blanks (lower case, no punctuation). keyword: the longest literal that
any match holds, by literal(). Priority: 4 exact identifiers, 3 full names and grants, 2 short names beside a telling word, 1 hints.
"""

from __future__ import annotations

#: label: identifiers as words, then full names.
NAMES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-1.0": ("apache 1 0", ("apache (?:software )?license (?:version )?1 0",)),
    "apache-1.1": ("apache 1 1", ("apache (?:software )?license (?:version )?1 1",)),
    "apache-2.0": ("apache 2 0", ("apache (?:software )?license (?:version |v)?2 0", "apache license v2")),
    "mit": ("mit", ("(?:the )?mit license", "(?:the )?expat license")),
    "mit-0": ("mit 0", ("mit no attribution(?: license)?",)),
    "isc": ("isc", ("(?:the )?isc license", "internet systems consortium license")),
    "bsd-1-clause": ("bsd 1 clause", ("bsd 1 clause license", "one clause bsd license")),
    "bsd-2-clause": ("bsd 2 clause", ("bsd 2 clause (?:simplified )?license", "(?:simplified|freebsd|two clause) bsd license", "freebsd license")),
    "bsd-3-clause": ("bsd 3 clause", ("bsd 3 clause (?:new or revised )?license", "(?:new|modified|revised|three clause) bsd license")),
    "bsd-4-clause": ("bsd 4 clause", ("bsd 4 clause license", "(?:original|four clause) bsd license")),
    "bsd-3-clause-clear": ("bsd 3 clause clear", ("clear bsd license",)),
    "0bsd": ("0bsd", ("zero clause bsd license", "bsd zero clause license")),
    "gpl-1.0": ("gpl 1 0(?: only| or later)?", ("gnu general public license (?:version |v)?1(?: 0)?",)),
    "gpl-2.0": ("gpl 2 0(?: only| or later)?", ("gnu general public license (?:version |v)?2(?: 0)?", "gnu gpl (?:version |v)?2(?: 0)?")),
    "gpl-3.0": ("gpl 3 0(?: only| or later)?", ("gnu general public license (?:version |v)?3(?: 0)?", "gnu gpl (?:version |v)?3(?: 0)?")),
    "lgpl-2.0": ("lgpl 2 0(?: only| or later)?", ("gnu library general public license (?:version |v)?2(?: 0)?",)),
    "lgpl-2.1": ("lgpl 2 1(?: only| or later)?", ("gnu lesser general public license (?:version |v)?2 1",)),
    "lgpl-3.0": ("lgpl 3 0(?: only| or later)?", ("gnu lesser general public license (?:version |v)?3(?: 0)?",)),
    "agpl-1.0": ("agpl 1 0(?: only| or later)?", ("affero general public license (?:version |v)?1(?: 0)?",)),
    "agpl-3.0": ("agpl 3 0(?: only| or later)?", ("gnu affero general public license (?:version |v)?3(?: 0)?",)),
    "gfdl-1.1": ("gfdl 1 1(?: only| or later)?", ("gnu free documentation license (?:version |v)?1 1",)),
    "gfdl-1.2": ("gfdl 1 2(?: only| or later)?", ("gnu free documentation license (?:version |v)?1 2",)),
    "gfdl-1.3": ("gfdl 1 3(?: only| or later)?", ("gnu free documentation license (?:version |v)?1 3",)),
    "mpl-1.0": ("mpl 1 0", ("mozilla public license (?:version |v)?1 0",)),
    "mpl-1.1": ("mpl 1 1", ("mozilla public license (?:version |v)?1 1",)),
    "mpl-2.0": ("mpl 2 0", ("mozilla public license (?:version |v)?2 0",)),
    "epl-1.0": ("epl 1 0", ("eclipse public license (?:version |v)?1 0",)),
    "epl-2.0": ("epl 2 0", ("eclipse public license (?:version |v)?2 0",)),
    "cpl-1.0": ("cpl 1 0", ("common public license (?:version |v)?1 0",)),
    "ipl-1.0": ("ipl 1 0", ("ibm public license (?:version |v)?1 0",)),
    "cddl-1.0": ("cddl 1 0", ("common development and distribution license (?:version |v)?1 0",)),
    "cddl-1.1": ("cddl 1 1", ("common development and distribution license (?:version |v)?1 1",)),
    "eupl-1.1": ("eupl 1 1", ("european union public licen[cs]e (?:version |v)?1 1",)),
    "eupl-1.2": ("eupl 1 2", ("european union public licen[cs]e (?:version |v)?1 2",)),
    "osl-3.0": ("osl 3 0", ("open software license (?:version |v)?3 0",)),
    "afl-3.0": ("afl 3 0", ("academic free license (?:version |v)?3 0",)),
    "artistic-1.0": ("artistic 1 0", ("artistic license (?:version )?1 0",)),
    "artistic-2.0": ("artistic 2 0", ("artistic license (?:version )?2 0",)),
    "bsl-1.0": ("bsl 1 0", ("boost software license(?: version)? 1 0",)),
    "busl-1.1": ("busl 1 1", ("business source license (?:version )?1 1",)),
    "zlib": ("zlib", ("zlib license", "zlib libpng license")),
    "libpng": ("libpng(?: 2 0)?", ("libpng license",)),
    "unlicense": ("unlicense", ("the unlicense",)),
    "wtfpl": ("wtfpl", ("do what the \\S+ you want to public license",)),
    "beerware": ("beerware", ("beer ware license", "beerware license")),
    "postgresql": ("postgresql", ("postgresql licen[cs]e",)),
    "python-2.0": ("python 2 0", ("python (?:software foundation )?license(?: version)? 2",)),
    "psf-2.0": ("psf 2 0", ("psf license(?: agreement)?(?: version)? 2",)),
    "php-3.01": ("php 3 01", ("php license (?:version )?3 01",)),
    "ruby": ("ruby", ("ruby license",)),
    "ofl-1.1": ("ofl 1 1", ("sil open font license(?: version)?(?: 1 1)?",)),
    "vim": ("vim", ("vim license",)),
    "curl": ("curl", ("curl license",)),
    "openssl": ("openssl", ("openssl license", "ssleay license")),
    "ncsa": ("ncsa", ("university of illinois ncsa open source license", "ncsa open source license")),
    "x11": ("x11", ("x11 license", "x consortium license")),
    "ms-pl": ("ms pl", ("microsoft public license",)),
    "ms-rl": ("ms rl", ("microsoft reciprocal license",)),
    "upl-1.0": ("upl 1 0", ("universal permissive license(?: version)?(?: v)?1 0",)),
    "blueoak-1.0.0": ("blueoak 1 0 0", ("blue oak model license",)),
    "mulanpsl-2.0": ("mulanpsl 2 0", ("mulan permissive software license(?: v| version )?2",)),
    "odbl-1.0": ("odbl 1 0", ("open database license",)),
    "odc-by-1.0": ("odc by 1 0", ("open data commons attribution license",)),
    "pddl-1.0": ("pddl 1 0", ("public domain dedication (?:and|&) license",)),
    "sspl-1.0": ("sspl 1 0", ("server side public license",)),
    "elastic-2.0": ("elastic 2 0", ("elastic license (?:version )?2 0",)),
    "tcl": ("tcl", ("tcl tk license",)),
    "qpl-1.0": ("qpl 1 0", ("q public license",)),
    "sleepycat": ("sleepycat", ("sleepycat license",)),
    "watcom-1.0": ("watcom 1 0", ("sybase open watcom public license",)),
    "apsl-2.0": ("apsl 2 0", ("apple public source license",)),
    "ecl-2.0": ("ecl 2 0", ("educational community license",)),
    "naist-2003": ("naist 2003", ("nara institute of science and technology license",)),
    "unicode-dfs-2016": ("unicode dfs 2016", ("unicode license agreement",)),
    "openrail": ("openrail", ("open rail m license", "responsible ai license")),
}
#: Names of products that are licensed under other licences, too: after "license" they tell nothing.
PRODUCTS = ("ruby", "vim", "curl", "openssl", "postgresql", "tcl", "x11", "zlib", "libpng", "sleepycat", "unlicense", "openrail")
_CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
_HINTS = (
    ("permissive-grant", "permission is hereby granted free of charge to any person obtaining a copy", 3),
    ("permissive-grant", "permission to use copy modify and or distribute this software", 3),
    ("bsd-style", "redistribution and use in source and binary forms", 3),
    ("warranty-disclaimer", "(?:the )?(?:software|work) is provided as is without warranty", 2),
    ("warranty-disclaimer", "without warranties or conditions of any kind", 2),
    ("copyleft-grant", "you can redistribute it and or modify it under the terms of", 3),
    ("lgpl", "(?:gnu )?lesser general public license", 2),
    ("agpl", "(?:gnu )?affero general public license", 2),
    ("gfdl", "gnu free documentation license", 2),
    ("mpl", "mozilla public license", 2),
    ("epl", "eclipse public license", 2),
    ("apache", "apache (?:software )?license", 2),
    ("bsd", "bsd (?:style )?license", 2),
    ("artistic", "artistic license", 2),
    ("public-domain", "(?:released|placed|dedicated|donated)(?: in)?(?: to)? the public domain", 3),
    ("public-domain", "public domain dedication", 3),
    ("public-domain", "in the public domain", 1),
    ("copyright", "copyright c? ?(?:19|20)[0-9]{2}", 1),
    ("proprietary", "proprietary and confidential", 2),
    ("proprietary", "without (?:the )?(?:prior )?(?:express )?written permission", 1),
    ("reserved", "(?:all|some|no) rights reserved", 1),
    ("license-file", "see (?:the )?license(?: file)?(?: in the project root)? for", 1),
    ("license-mention", "licensed under (?:the )?", 1),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2", 4),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3", 4),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1", 4),
    ("lgpl-3.0", "gnu lesser general public license as published by the free software foundation either version 3", 4),
    ("lgpl-2.0", "gnu library general public license as published by the free software foundation either version 2", 4),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3", 4),
    ("gpl", "you should have received a copy of the gnu general public license", 3),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", 3),
    ("agpl", "you should have received a copy of the gnu affero general public license", 3),
    ("apache-2.0", "you may not use this file except in compliance with the license", 3),
    ("apache-2.0", "www apache org licenses license 2 0", 4),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", 3),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", 3),
    ("mit", "opensource org licenses mit", 4),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", 4),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", 4),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 4),
    ("bsd-style", "use of this source code is governed by a bsd style license", 3),
    ("bsd-style", "redistributions of source code must retain the above copyright notice", 3),
    ("bsd-style", "redistributions in binary form must reproduce the above copyright notice", 3),
    ("bsd-3-clause", "neither the name of (?:\\S+ ){1,12}nor the names of (?:its|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission", 4),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 3),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 4),
    ("bsl-1.0", "distributed under the boost software license", 3),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", 4),
    ("unlicense", "this is free and unencumbered software released into the public domain", 4),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 4),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 4),
    ("epl-2.0", "made available under the terms of the eclipse public license (?:v |version )?2 0", 4),
    ("epl-1.0", "made available under the terms of the eclipse public license (?:v |version )?1 0", 4),
    ("cddl", "common development and distribution license", 2),
    ("ofl-1.1", "this font software is licensed under the sil open font license", 4),
    ("artistic", "licensed under the same terms as perl itself", 3),
    ("python-2.0", "python software foundation license", 2),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 4),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 4),
    ("odbl-1.0", "open data commons open database license", 3),
    ("cc-by", "licensed under a creative commons attribution", 3),
    ("cc-by-4.0", "creative commons attribution 4 0 international(?: public)? license", 4),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international(?: public)? license", 4),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international(?: public)? license", 4),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", 4),
    ("public-domain", "creativecommons org publicdomain mark 1 0", 4),
    ("dual-licensed", "dual licensed under", 2),
    ("dual-licensed", "licensed under either of", 2),
    ("commercial", "commercial license(?: agreement)?", 1),
    ("commercial", "end user license agreement", 2),
    ("proprietary", "licensed not sold", 2),
    ("proprietary", "confidential and proprietary", 2),
    ("proprietary", "proprietary (?:license|software)", 2),
    ("proprietary", "unlicensed (?:use|copying)(?: of this \\S+)? is (?:strictly )?prohibited", 2),
    ("proprietary", "redistribution (?:in whole or in part )?is (?:strictly )?prohibited", 2),
    ("proprietary", "no license express or implied", 2),
    ("non-commercial", "licensed for (?:personal|non ?commercial|academic|research)(?: and \\S+)? use only", 2),
    ("warranty-disclaimer", "there is no warranty for the (?:program|software|work)", 2),
    ("warranty-disclaimer", "without even the implied warranty of merchantability", 2),
    ("copyleft-grant", "redistribute it and or modify it under the same terms", 2),
    ("trademark", "trademark (?:license|permission)", 1),
    ("patent-grant", "perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 3),
)


def literal(pattern: str) -> str:
    """The longest run of plain characters that every match of pattern holds, with the blanks that stand around matches."""
    parts, depth, plain = [""], 0, f" {pattern} "
    for at, c in enumerate(plain):
        if c in "([":
            depth += 1
        optional = plain[at + 1 : at + 2] == "?"
        if depth or c in "?\\{}+" or optional:
            parts.append("")
        else:
            parts[-1] += c
        if c in ")]":
            depth -= 1
    return max(parts, key=len)


def rules() -> list[tuple[str, str, str, int]]:
    out: list[tuple[str, str, int]] = []
    for label, (short, full) in NAMES.items():
        out.append((label, f"spdx license identifier {short}", 4))
        out.append((label, f"licensed under (?:the )?(?:terms of the )?{short}(?: license)?", 3))
        if short not in PRODUCTS:
            out.append((label, f"license {short}", 2))
        out += [(label, p, 3) for p in full]
    for tail, name in _CC.items():
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{tail.replace(' ', '-')}-{version.replace(' ', '.')}"
            out.append((label, f"cc {tail} {version}", 4))
            out.append((label, f"creative commons {name} {version}", 4))
            out.append((label, f"creativecommons org licenses {tail} {version}", 4))
        out.append((f"cc-{tail.replace(' ', '-')}", f"creative commons {name}", 3))
    out += [("cc0-1.0", "cc0(?: 1 0)?", 3), ("cc0-1.0", "creative commons (?:cc0|zero)", 3)]
    return [(label, literal(p), p, priority) for label, p, priority in [*out, *_HINTS]]


_BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Any match of a rule or base phrase makes this match the text as it is, letters in either case.
GATE = f"licen|reserved|copyright|public|spdx|permission|warrant|redistribut|commons|proprietary|advertising|cc0|cc{_BREAKS}by|gnu{_BREAKS}gpl|mit{_BREAKS}no{_BREAKS}attribution"
