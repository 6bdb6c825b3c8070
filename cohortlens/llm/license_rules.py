"""Signature rules of the license scan, over texts normalised to words with single spaces."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases of the base labels.
BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Label, names as regexes, identifier words, keywords of which a text must hold one.
LICENSES = (
    ("mit", r"(?:mit|expat) licen[cs]ed?", "mit", ("mit licen", "expat licen", "identifier mit")),
    ("apache-2", r"(?:apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?|apache ?v?2(?: 0)?(?: licen[cs]ed?)?|asl 2 0)", "apache 2 0", ("apache", "asl 2")),
    ("apache-1.1", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache 1 1", ("apache",)),
    ("apache", r"apache (?:software )?licen[cs]ed?", "apache", ("apache",)),
    ("gpl-2", r"(?:(?:gnu )?general public licen[cs]e(?: gpl)?|(?:gnu )?gpl)(?: ?v(?:ersion)?)? ?2(?: 0)?(?: only| or later)?", r"gpl 2 0(?: only| or later)?", ("general public", "gpl")),
    ("gpl-3", r"(?:(?:gnu )?general public licen[cs]e(?: gpl)?|(?:gnu )?gpl)(?: ?v(?:ersion)?)? ?3(?: 0)?(?: only| or later)?", r"gpl 3 0(?: only| or later)?", ("general public", "gpl")),
    ("gpl", r"(?:gnu general public licen[cs]e|(?:gnu )?gpl(?: licen[cs]ed?)?)", r"gpl", ("general public", "gpl")),
    ("lgpl-2.1", r"(?:(?:gnu )?lesser general public licen[cs]e(?: lgpl)?|(?:gnu )?lgpl)(?: ?v(?:ersion)?)? ?2 1(?: only| or later)?", r"lgpl 2 1(?: only| or later)?", ("lesser general", "lgpl")),
    ("lgpl-3", r"(?:(?:gnu )?lesser general public licen[cs]e(?: lgpl)?|(?:gnu )?lgpl)(?: ?v(?:ersion)?)? ?3(?: 0)?(?: only| or later)?", r"lgpl 3 0(?: only| or later)?", ("lesser general", "lgpl")),
    ("lgpl", r"(?:gnu (?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl)", r"lgpl", ("lesser general", "library general", "lgpl")),
    ("agpl-3", r"(?:gnu affero general public licen[cs]e(?: (?:version |v)3(?: 0)?)?|(?:gnu )?agpl(?: ?v(?:ersion)?)? ?3(?: 0)?(?: only| or later)?)", r"agpl 3 0(?: only| or later)?", ("affero", "agpl")),
    ("agpl", r"(?:gnu )?agpl", "agpl", ("agpl",)),
    ("bsd-2", r"(?:(?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?|(?:simplified bsd|freebsd) licen[cs]e)", "bsd 2 clause", ("bsd",)),
    ("bsd-3", r"(?:(?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e)", "bsd 3 clause", ("bsd",)),
    ("bsd-4", r"(?:(?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?|original bsd licen[cs]e)", "bsd 4 clause", ("bsd",)),
    ("bsd", r"bsd(?: style)? licen[cs]ed?", "bsd", ("bsd",)),
    ("0bsd", r"(?:zero clause bsd|0bsd|bsd zero clause) licen[cs]e", "0bsd", ("bsd",)),
    ("isc", r"isc licen[cs]e", "isc", ("isc licen", "identifier isc")),
    ("mpl-1.1", r"(?:mozilla public licen[cs]e|mpl)(?: ?v(?:ersion)?)? ?1 1", "mpl 1 1", ("mozilla", "mpl")),
    ("mpl-2", r"(?:mozilla public licen[cs]e(?: (?:version |v)?2 0)?|mpl(?: ?v(?:ersion)?)? ?2(?: 0)?)", "mpl 2 0", ("mozilla", "mpl")),
    ("epl-1", r"(?:eclipse public licen[cs]e|epl)(?: ?v(?:ersion)?)? ?1 0", "epl 1 0", ("eclipse", "epl")),
    ("epl-2", r"(?:eclipse public licen[cs]e(?: (?:version |v)?2 0)?|epl(?: ?v(?:ersion)?)? ?2 0)", "epl 2 0", ("eclipse", "epl")),
    ("cddl-1", r"(?:common development and distribution licen[cs]e(?: (?:version |v)?1 [01])?|cddl(?: ?v?1 [01])?)", r"cddl 1 [01]", ("common development", "cddl")),
    ("cpl-1", r"common public licen[cs]e(?: (?:version |v)?1 0)?", "cpl 1 0", ("common public", "cpl")),
    ("artistic-1", r"artistic licen[cs]e (?:version |v)?1 0", r"artistic 1 0", ("artistic",)),
    ("artistic-2", r"artistic licen[cs]e(?: (?:version |v)?2 0)?", r"artistic 2 0", ("artistic",)),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", ("zlib",)),
    ("boost-1", r"boost software licen[cs]e(?: (?:version |v)?1 0)?", "bsl 1 0", ("boost software", "bsl")),
    ("unlicense", r"the unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public licen[cs]e)", "wtfpl", ("wtfpl", "do what the")),
    ("cc0-1", r"(?:cc0|creative commons zero)(?: (?:version |v)?1 0)?(?: universal)?", r"cc0 1 0", ("cc0", "commons zero")),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: licen[cs]e)? [1-4] [05]", r"cc by [1-4] [05]", ("cc by", "creative commons")),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", r"cc by sa [1-4] [05]", ("cc by", "creative commons")),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?", r"cc by nd [1-4] [05]", ("cc by", "creative commons")),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", r"cc by nc [1-4] [05]", ("cc by", "creative commons")),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]", ("cc by", "creative commons")),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]", ("cc by", "creative commons")),
    ("gfdl", r"gnu free documentation licen[cs]e(?: (?:version |v)?1 [1-3])?", r"gfdl 1 [1-3](?: only| or later)?", ("free documentation", "gfdl")),
    ("ofl-1.1", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?", "ofl 1 1", ("open font", "ofl")),
    ("odbl-1", r"open (?:data commons open )?database licen[cs]e", "odbl 1 0", ("database licen", "odbl")),
    ("psf-2", r"(?:python software foundation|psf) licen[cs]e", "psf 2 0", ("python software", "psf")),
    ("php-3", r"php licen[cs]e", r"php 3 0[01]?", ("php licen", "identifier php")),
    ("ms-pl", r"microsoft public licen[cs]e", "ms pl", ("microsoft public", "ms pl")),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "ms rl", ("microsoft reciprocal", "ms rl")),
    ("eupl", r"(?:european union public licen[cs]e(?: (?:version |v)?1 [12])?|eupl ?v?1 [12])", r"eupl 1 [12]", ("european union public", "eupl")),
    ("openssl", r"openssl licen[cs]e", "openssl", ("openssl",)),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", ("postgresql licen", "identifier postgresql")),
    ("sspl-1", r"(?:server side public licen[cs]e|sspl(?: ?v?1(?: 0)?)?)", "sspl 1 0", ("server side public", "sspl")),
    ("busl-1.1", r"business source licen[cs]e(?: (?:version |v)?1 1)?", "busl 1 1", ("business source", "busl")),
    ("proprietary", r"(?:proprietary|commercial) licen[cs]e(?: agreement)?", r"licenseref proprietary", ("proprietary", "commercial licen")),
)

#: Wording around a name; the part before it, the weight of such a detection.
GRANTS = (
    (r"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?", 0.95), (r"released under (?:the )?(?:terms of (?:the )?)?", 0.95),
    (r"distributed under (?:the )?(?:terms of (?:the )?)?", 0.95), (r"(?:made )?available under (?:the )?(?:terms of (?:the )?)?", 0.9),
    (r"(?:covered|governed) by (?:the )?(?:terms of (?:the )?)?", 0.85), (r"(?:subject to|in accordance with) (?:the )?(?:terms of (?:the )?)?", 0.8),
    (r"(?:see|read) (?:the )?", 0.6), (r"", 0.5),
)

#: Label, wording of the license's own text, keyword.
BODIES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd-3", r"neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors", "neither the name"),
    ("bsd-2", r"redistribution and use in source and binary forms with or without modification", "redistribution and use"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "program is free"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "library is free"),
    ("apache-2", r"you may not use this file except in compliance with the licen[cs]e", "except in compliance"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", r"altered source versions must be plainly marked as such", "altered source"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("proprietary", r"all rights reserved(?: no part of)?", "rights reserved"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied", "software is provided as is"),
    ("bsd", r"this software is provided by the (?:copyright holders?|regents|author)(?: and contributors)? as is", "software is provided by"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display", "advertising materials"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "program is distributed in the hope"),
    ("lgpl", r"this library is distributed in the hope that it will be useful but without any warranty", "library is distributed in the hope"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", "agreed to in writing software"),
    ("boost-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "person or organization"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document", "verbatim or modified"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", "its documentation for any purpose"),
    ("ofl-1.1", r"the fonts? (?:software )?(?:may not|can not|cannot) be sold by (?:itself|themselves)", "be sold by"),
    ("openssl", r"this product includes software developed by the openssl project", "openssl"),
    ("psf-2", r"psf is making python available to licensee on an as is basis", "psf is making"),
    ("cc0-1", r"dedicated the work to the public domain by waiving all of his or her rights", "by waiving all"),
)

#: Wording that takes a grant back; what stands before a name then gives no label.
DENIALS = ("not licensed under", "not licenced under", "not released under", "not distributed under", "not available under", "not made available under")


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int  # smaller wins
    weight: float
    base: bool = False


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")


def all_rules() -> list[Rule]:
    """Rules in order of priority: denied grants, identifiers, license texts, grants by wording, base phrases, bare names.

    A denied grant has no label of its own; it only suppresses what it contains.
    """
    rules = [Rule(label, _compiled(rf"spdx licen[cs]e identifier {ids}"), keys, 0, 0.99) for label, _, ids, keys in LICENSES]
    names = "|".join(name for _, name, _, _ in LICENSES)
    rules += [Rule("", _compiled(rf"{denial} (?:the )?(?:terms of (?:the )?)?(?:{names})"), (denial,), -1, 0.0) for denial in DENIALS]
    for label, _, ids, _ in LICENSES:  # "License: MIT"
        first = ids.split()[0]
        rules.append(Rule(label, _compiled(rf"licen[cs]e {ids}"), (f"license {first}", f"licence {first}"), 2, 0.8))
    rules += [Rule(label, _compiled(text), (key,), 1, 0.9 if label != "proprietary" else 0.4) for label, text, key in BODIES]
    for before, weight in GRANTS:
        rules += [Rule(label, _compiled(before + name), keys, 2 if before else 4, weight) for label, name, _, keys in LICENSES]
    rules += [Rule(label, _compiled(phrase), (phrase,), 3, 0.9, True) for label, phrase in BASE_PHRASES]
    return rules
