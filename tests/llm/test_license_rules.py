"""Ordinary license statements and the labels that they give."""

import pytest

from cohortlens.llm import license_scan

STATEMENTS = {
    "GPLv2": "gpl-2", "GNU GPL v2": "gpl-2", "GPL-2.0-only": "gpl-2", "licensed under the GNU GPL v2": "gpl-2", "GPL 2": "gpl-2",
    "licensed under GPL-3.0-or-later": "gpl-3", "released under the gpl v3": "gpl-3", "General Public License version 3": "gpl-3",
    "the GPL": "gpl", "AGPLv3": "agpl-3", "an AGPL program": "agpl", "LGPL": "lgpl", "LGPL-2.1-or-later": "lgpl-2.1", "lgplv3": "lgpl-3",
    "BSD license": "bsd", "a BSD-style license": "bsd", "BSD-3-Clause": "bsd-3", "the 2-clause BSD license": "bsd-2", "3-Clause BSD": "bsd-3",
    "License: Apache-2.0": "apache-2", "Apache 2": "apache-2", "the Apache License": "apache", "Apache License, Version 2.0": "apache-2",
    "MPL-2.0": "mpl-2", "MPL 1.1": "mpl-1.1", "EPL-2.0": "epl-2", "CDDL": "cddl-1", "EUPL 1.2": "eupl",
    "artistic license 1.0": "artistic-1", "licensed under the artistic license 1.0": "artistic-1", "Artistic License": "artistic-2",
    "MIT-licensed": "mit", "License: MIT": "mit", "licence: ISC": "isc", "PostgreSQL License": "postgresql", "SSPLv1": "sspl-1",
    "Business Source License 1.1": "busl-1.1",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy": "boost-1",
    "Unless required by applicable law or agreed to in writing, software distributed under the License": "apache-2",
    "All advertising materials mentioning features or use of this software must display": "bsd-4",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gpl",
    "not licensed under the GNU GPL": "", "It is not released under the terms of the Apache License, version 2.0, sadly": "apache-2",
    "This is not distributed under the LGPL-2.1": "", "not licensed under the GPL but under the ISC license": "isc",
    "we came with a license to practise medicine": "", "a permit and an isolated case": "", "the bsd of it": "",
}


@pytest.mark.parametrize("text", STATEMENTS)
def test_statement_gives_its_label(text):
    (row,) = license_scan._scan(iter([(1, text)]))
    assert row[6] == STATEMENTS[text]
    assert (row[7] > 0) == bool(row[6]) or row[5] == row[6]  # base labels stay, also where the grant is denied


def test_a_denial_takes_back_only_its_own_grant():
    (row,) = license_scan._scan(iter([(1, "Not licensed under the GPLv2. Some files: licensed under the GPLv2.")]))
    assert row[6] == "gpl-2" and len(row[8]) == 1 and row[8][0]["start"] >= 5
