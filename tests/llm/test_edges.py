"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns whose names clash with ours."""

import textwrap

import pytest
from pyspark.sql import functions as F

from brindle.llm import exact_dedup, fingerprints, licenses, mixing, near_dedup, packing, pii, quality, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, key long, rep long, row long, block long, data string, h1 long, comp long, kept string, score double, term string, bin long, open string"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (1, "the same text of five words and more", "en", "a"), (2, "the same  text of five words\tand more", "en", "a"), (2, "the same  text of five words\tand more", "en", "a"), (3, None, None, None),
    (4, "", "en", None), (5, " \n", "en", "b"), (None, "no name but a text of its own", "en", "b"), (None, None, "en", "b"), (6, "x", "de", "c"), (7, LONG, "en", "c"), (8, LONG + " end", "en", "c"), (9, "Released under the MIT License.", "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, *([None] * 14)) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 0), (6, 0, 0), (9, 0, None), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "suffix": lambda d, lab: suffix_dedup.remove_repeats(d), "exact": lambda d, lab: exact_dedup.exact_groups(d), "license": lambda d, lab: licenses.scan(d), "quality": lambda d, lab: quality.scores(d, lab),
    "pii": lambda d, lab: pii.personal_data(d), "mixing": lambda d, lab: mixing.mix(d), "packing": lambda d, lab: packing.pack(d), "fingerprints": lambda d, lab: fingerprints.fingerprints(d), "near": lambda d, lab: near_dedup.near_components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, labels, name):
    got = OPERATORS[name](docs, labels)
    rows = got.collect()
    if name == "packing":
        assert len({(r["doc_id"], r["ids_crc32"]) for r in rows if r["piece"] == 0}) >= 8 and sum(r["piece"] == 0 for r in rows) == len(ROWS)
    else:
        assert len(rows) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in rows if name != "packing") == sorted(str(r[0]) for r in ROWS) or name == "packing"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.filter("doc_id < 0"), labels.filter("doc_id < 0")).count() == 0


def test_exact_results(docs):
    got = exact_dedup.exact_groups(docs).collect()
    same = [r for r in got if r["doc_id"] in (1, 2)]
    assert {r["keep_id"] for r in same} == {2} and {r["group_size"] for r in same} == {3} and sum(r["kept"] for r in same) == 1
    empty = [r for r in got if r["doc_id"] in (3, 4, 5)]
    assert {r["keep_id"] for r in empty} == {5} and {r["group_size"] for r in empty} == {4}
    assert sum(r["kept"] for r in got) == 7
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == 7


def test_near_results(docs):
    got = near_dedup.near_components(docs).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[8]["component_id"] == 7 and not by[8]["kept"]
    assert by[3]["component_id"] == 3 and by[4]["component_id"] == 4 and by[3]["n_shingles"] == 0 and by[6]["n_shingles"] == 1
    left = near_dedup.keep_one(docs)
    assert left.columns == docs.columns and left.filter("doc_id IN (2, 8)").count() == 0 and left.filter("doc_id IS NULL").count() == 2


def test_mix_results(docs):
    rows = mixing.mix(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    goals = {r["source_size"]: r["target"] for r in rows}
    assert all(t <= 2 * s for s, t in goals.items())
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * total) <= 40_001
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns


@pytest.mark.parametrize("limits", [{"max_docs": 3}, {"max_attention": 1000}])
def test_packing_limits_bind(spark, limits):
    docs = spark.createDataFrame([(i, "some words of a text " * (1 + i % 4)) for i in range(40)], "doc_id long, text string")
    count = lambda **more: packing.pack(docs, capacity=128, **more).groupBy("sequence_id").agg(F.count("*").alias("docs"), F.sum(F.col("length") * F.col("length")).alias("attention")).collect()
    free, bound = count(), count(**limits)
    assert max(r["docs"] for r in free) > 3 and max(r["attention"] for r in free) > 1000 and len(bound) > len(free)
    assert all(r["docs"] <= limits.get("max_docs", 99) and r["attention"] <= limits.get("max_attention", 99_999) for r in bound)


def test_fingerprint_results(docs):
    rows = fingerprints.fingerprints(docs).collect()
    one = [r["fingerprint"] for r in rows if r["doc_id"] == 2]
    assert len(set(one)) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_quality_without_labels(docs, labels):
    got = quality.scores(docs, labels.filter("quality = 1")).collect()
    assert {r["score"] for r in got} == {0.5} and {r["predicted"] for r in got} == {1}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_license_sequences(spark):
    text = "Licensed under the Apache License, Version 2.0. Other words here.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp"
    got = licenses.scan(spark.createDataFrame([(1, text), (2, "All  rights,\treserved!\nAll rights reserved.")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["rules"] == "apache-2.0-notice,apache-2.0-header-copy" and got[0]["licenses"] == "Apache-2.0"
    assert got[1]["sentence_ids"] == "all-rights,all-rights"


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
CANON = [(MIT, "mit-text"), (BSD, "bsd-2-clause-text"), (BSD3, "bsd-3-clause-text"), (ISC, "isc-text"), (GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "lgpl-header"), (GPL.replace("GNU General", "GNU Affero General"), "agpl-header"), (BSD + "\n\n" + BSD3, "bsd-2-clause-text,bsd-3-clause-text"), (GPL, "gpl-header"), (MPL, "mpl-2.0-notice"), (APACHE, "apache-2.0-header"), ("This file is licensed under the MIT License.", "mit-notice-2"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0-spdx")]


@pytest.mark.parametrize("lead", ["", " * ", "# "])
@pytest.mark.parametrize("width", [50, 72, 5000])
def test_license_texts(spark, lead, width):
    def wrapped(text):
        return "\n".join(lead + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])

    rows = [(i, f"{lead}Copyright 2020\n{lead}\n" + wrapped(t)) for i, (t, _) in enumerate(CANON)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["rules"] for r in got] == [rule for _, rule in CANON]


def test_license_sentences_end_with_sentences(spark):
    rows = [(1, "We said: released under the\nMIT License, or not."), (2, "released under the\n\nMIT License"), (3, "Released under the MIT License" + " -" * 400 + "."), (4, "S L released under the MIT license L S")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["sentence_ids"] for r in got] == ["", "", "mit-notice", ""]


# ------------------------------------------------------------------ archives
def test_arc_versions():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\n\n</p>"
    for version in (1, 2):
        data = warc.arc_header(version) + warc.arc_record(version, "http://a/b c", body) + warc.arc_record(version, "dns:a", b"1.2.3.4")
        (head, _, _), (one, got, cut), (two, other, _) = warc.read_arc(data)
        assert head["URL"].startswith("filedesc:") and one["URL"] == "http://a/b c" and got == body and not cut and other == b"1.2.3.4"
        records = [warc.warc_record(f, b, c) for f, b, c in warc.read_arc(data)]
        again = list(warc.read_warc(b"".join(r + b"\r\n\r\n" for r in records)))
        assert [f["WARC-Type"] for f, _ in again] == ["warcinfo", "response", "resource"] and again[1][1] == body
    short = list(warc.read_arc(data[:-6]))
    assert short[-1][2]
    with pytest.raises(ValueError):
        list(warc.read_arc(b"no archive"))


def test_times():
    assert warc.w3c_time("20240102030405") == "2024-01-02T03:04:05Z" and warc.w3c_time("2024") == "2024-01-01T00:00:00Z" and warc.w3c_time("20249902") == "1970-01-01T00:00:00Z" and warc.w3c_time("x") == "1970-01-01T00:00:00Z"


def test_odd_pages(spark, tmp_path):
    big = "<p>" + "é\r\n\r\n" * 400
    rows = [(1, "http://a", big, 0), (2, "http://b b", big, 0), (2, "http://b b", big, 0), (3, None, None, 0), (4, "http://c", "", 0), (None, "http://d", big, 0), (5, "http://e", "short", 0), (6, "http://e", "short", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n long")
    warc.convert(pages, str(tmp_path / "w"), records_per_file=2)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in got)
    n = len(big.encode())
    assert kinds == sorted([("1", "revisit", "2", n), ("2", "response", "None", n), ("2", "response", "None", n), ("3", "response", "None", 0), ("4", "response", "None", 0), ("None", "revisit", "2", n), ("5", "response", "None", 5), ("6", "response", "None", 5)])
    revisit = next(r for r in got if r["page_id"] == 1)
    assert revisit["record_id"].startswith("<urn:uuid:")
    warc.convert(pages.filter("page_id < 0"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
