"""Whole licence texts, with and without titles, and texts that a caller adds."""

from pathlib import Path

import pytest

from parcelry.llm import licenses

DOCS = "doc_id bigint, text string"


def test_whole_texts_and_titles(spark):
    mit = licenses.KNOWN["MIT"][0].removeprefix("MIT License ")
    folder = Path(licenses.__file__).parent / "licenses_data"
    apache = (folder / "Apache-2.0").read_text()
    rows = [(1, mit), (2, "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + mit), (3, apache), (4, apache[: apache.index("APPENDIX:")]), (5, (folder / "GPL-3").read_text()), (6, (folder / "MPL-2.0").read_text().split("\n\n", 1)[1]), (7, "Own terms, all of them")]
    more = spark.createDataFrame([("Own", "own TERMS: all of them."), ("Own", None), ("Empty", "...")], "license string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame([*rows, (8, "")], DOCS), more=more).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "Apache-2.0", 5: "GPL-3.0-only", 6: "MPL-2.0", 7: "Own", 8: None}


@pytest.mark.parametrize("file", sorted(licenses.FILES))
def test_each_text_has_its_digest(file):
    text = (Path(licenses.__file__).parent / "licenses_data" / file).read_text()
    assert (licenses.FILES[file], text.split()) in [(name, t.split()) for name, t in licenses.known_texts()]
