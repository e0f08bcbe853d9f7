"""Whole license texts and further notices, as they stand in files."""

import pytest

from marketgrain.llm import licenses
from marketgrain.llm.licenses import KNOWN, Path

COPYRIGHT = "Copyright (c) 2024 Some Body\nAll rights reserved.\n\n"
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
CASES = [(n, t) for n, t in TEXTS.items()] + [
    ("MIT", "MIT License\n\n" + COPYRIGHT + KNOWN["MIT"]),
    ("MIT", "The MIT License (MIT)\n\n" + COPYRIGHT + KNOWN["MIT"].replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")),
    ("ISC", "ISC License\n\n" + COPYRIGHT + KNOWN["ISC"].upper()),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + COPYRIGHT + TEXTS["BSD-3-Clause"].replace(",", " ,")),
    ("Apache-2.0", TEXTS["Apache-2.0"].partition("APPENDIX: How to apply")[0]),
    ("Apache-2.0", TEXTS["Apache-2.0"].replace("License", "Licence").replace("[yyyy] [name of copyright owner]", "2024 Some Body")),
    ("Unlicense", "The Unlicense\n\n" + TEXTS["Unlicense"]),
    (None, TEXTS["Apache-2.0"][:5000]),
    (None, "MIT License\n\nNo other word of it."),
]
NOTICES = {"This project is licensed under the MIT License.": "MIT-notice", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "Distributed under the terms of the GNU General Public Licence v3.0": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT-notice"}


@pytest.fixture(scope="module")
def known(spark):
    return licenses.known_licenses(spark)


@pytest.mark.parametrize("broadcast", [True, False])
def test_whole_texts_and_notices(spark, known, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(licenses, "BROADCAST_TEXTS", 0)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(CASES)] + [(1000 + k, f"Some words.\n{t}\nOther words.") for k, t in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs, known).collect()}
    assert [got[k].license for k in range(len(CASES))] == [n for n, _ in CASES]
    assert [got[1000 + k].line_licenses for k in range(len(NOTICES))] == [[n] for n in NOTICES.values()]
