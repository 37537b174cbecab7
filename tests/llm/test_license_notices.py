"""Each license label on its common short form."""

import pytest

from llm import license_scan as L

NOTICES = [
    ("all-rights-reserved", "© 2020 Someone. All rights reserved."), ("all-rights-reserved", "All Rights Reserved"),
    ("mit", "Released under the MIT License"), ("mit", "MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"), ("apache", "Apache License 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"), ("gpl", "GNU General Public License v2"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"), ("cc-by-nc", "(CC BY-NC 3.0)"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"), ("cc-by-sa", "text: CC BY-SA"),
    ("cc-by", "Licensed under CC BY 4.0"), ("cc-by", "CC BY 4.0"),
    ("bsd", "BSD 3-Clause License"), ("bsd", "under the BSD 2-Clause license"), ("bsd", "under the BSD License"),
    ("isc", "under the ISC License"), ("mpl", "Mozilla Public License, v. 2.0"),
]
NONE = ["all rights are reserved", "they won by 4 0 today", "the license", "the mozilla public", "all rights reserve"]


@pytest.fixture(scope="module")
def labels(spark):
    texts = [t for _, t in NOTICES] + NONE + [f"some prose before {t} and some more after" for _, t in NOTICES]
    out = L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {texts[r.doc_id]: (r.labels, r.score) for r in out}


def test_short_notices(labels):
    for label, text in NOTICES:
        for t in (text, f"some prose before {text} and some more after"):
            assert labels[t][0] == [label], t
    for t in NONE:
        assert labels[t][0] == [] and labels[t][1] < L.MIN_COVER, t
