"""License scans by sentence rules: normalised sentences to known identifiers, identifier sequences to ordered rules.

A text is parted into sentences at sentence marks before a blank (not within "v. 2.0") and at blank lines; they are
normalised to lower-case ASCII letters and digits with single blanks between them. A known sentence begins and ends at an end
of a sentence or of a line, and may run over line ends, so wrapped and unwrapped texts give the same identifiers. Known
sentences give identifiers; the others give none and are passed over. A rule is an ordered sequence of identifiers, and holds
where the text's identifiers have it without a gap; where a longer rule of another licence has the same sentences and more,
the shorter one does not hold for them. The tables are small and fixed, so they are part of the expression: one
scan, no join, no shuffle.

The SQL has the first two tables (SENTENCES, RULES) and sentences within one line; the scan adds MORE_SENTENCES, NOTICES,
MORE_RULES and wrapped sentences. Both agree where a text has none of these.

Edge cases: null texts count as empty and match nothing; repeated sentences give repeated identifiers; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

NAME = "op4_license_scan"

#: Known sentences, normalised.
SENTENCES = {
    "all-rights": "all rights reserved",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-long": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "ccbync4-notice": "licensed under cc by nc 4 0",
    "ccby4-notice": "licensed under cc by 4 0",
    "ccbysa4-notice": "licensed under cc by sa 4 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this work is in the public domain",
}
#: Ordered rules, by name: license and identifiers.
RULES = {
    "all-rights-reserved": ("proprietary", ("all-rights",)),
    "apache-2.0-notice": ("Apache-2.0", ("apache-notice",)),
    "apache-2.0-header": ("Apache-2.0", ("apache-long", "apache-comply")),
    "apache-2.0-header-copy": ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy")),
    "mit-notice": ("MIT", ("mit-notice",)),
    "mit-notice-2": ("MIT", ("mit-notice-2",)),
    "mit-text": ("MIT", ("mit-grant", "mit-keep")),
    "gpl-3.0-notice": ("GPL-3.0", ("gpl3-notice",)),
    "gpl-2.0-notice": ("GPL-2.0", ("gpl2-notice",)),
    "gpl-header": ("GPL", ("gpl-free", "gpl-hope")),
    "cc-by-nc-4.0-notice": ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    "cc-by-4.0-notice": ("CC-BY-4.0", ("ccby4-notice",)),
    "cc-by-sa-4.0-notice": ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    "bsd-2-clause-text": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    "mpl-2.0-notice": ("MPL-2.0", ("mpl2-notice",)),
    "public-domain": ("public-domain", ("public-domain",)),
}
#: Canonical sentences and variants beyond those of the SQL, normalised, by their identifiers in order.
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_APACHE = "you may not use this {} except in compliance with the license"
_GPL = "this {} is free software you can redistribute it and or modify it under the terms of the gnu general public license {}"
_GPL_TERMS = ("as published by the free software foundation either version {} of the license or at your option any later version", "as published by the free software foundation version {} of the license", "version {} as published by the free software foundation")
_HOPE = "this {} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_LESSER = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {} general public license {}"
_THINGS = ("file", "software", "program", "project", "work", "library", "package", "code", "repository", "document")
MORE_SENTENCES = {
    _MIT: "mit-grant",
    f"{_MIT} {SENTENCES['mit-keep']}": "mit-grant,mit-keep",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-keep",
    f"{SENTENCES['apache-long']} {SENTENCES['apache-comply']}": "apache-long,apache-comply",
    **{_APACHE.format(x): "apache-comply" for x in _THINGS if x != "file"},
    **{f"{SENTENCES['apache-long']} {_APACHE.format(x)}": "apache-long,apache-comply" for x in _THINGS if x != "file"},
    **{_GPL.format(x, t.format(v)): "gpl-free" for x in ("program", "file", "software", "library") for t in _GPL_TERMS for v in (2, 3)},
    **{_HOPE.format(x): "gpl-hope" for x in ("program", "file", "software", "library")},
    **{_LESSER.format(x, "lesser", t.format(v)): "lgpl-free" for x in ("program", "library", "software") for t in _GPL_TERMS for v in ("2 1", "3")},
    **{_LESSER.format(x, "affero", t.format(3)): "agpl-free" for x in ("program", "software") for t in _GPL_TERMS},
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the boost software license version 1 0": "boost-notice",
    "neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    **{f"spdx license identifier {x}": f"spdx-{k}" for k, xs in {
        "mit": ("mit",), "apache": ("apache 2 0",), "gpl2": ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"), "gpl3": ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"), "bsd2": ("bsd 2 clause",), "bsd3": ("bsd 3 clause",),
        "isc": ("isc",), "lgpl21": ("lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"), "lgpl3": ("lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"), "agpl3": ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"),
        "unlicense": ("unlicense",), "zlib": ("zlib",), "boost": ("bsl 1 0",), "cc0": ("cc0 1 0",), "mpl2": ("mpl 2 0",), "ccby4": ("cc by 4 0",), "ccbync4": ("cc by nc 4 0",), "ccbysa4": ("cc by sa 4 0",),
    }.items() for x in xs},
}
#: What follows "this file is licensed under the" and its variants.
NOTICES = {
    "mit license": "mit-notice-2", "apache license version 2 0": "apache-notice", "apache license 2 0": "apache-notice", "gnu general public license version 2": "gpl2-notice", "gnu general public license version 3": "gpl3-notice",
    "gnu general public license v 2 0": "gpl2-notice", "gnu general public license v 3 0": "gpl3-notice", "gnu general public license v2 0": "gpl2-notice", "gnu general public license v3 0": "gpl3-notice",
    "mozilla public license v 2 0": "mpl2-notice", "mozilla public license version 2 0": "mpl2-notice", "cc by nc 4 0": "ccbync4-notice", "cc by 4 0": "ccby4-notice", "cc by sa 4 0": "ccbysa4-notice",
    "isc license": "isc-notice", "bsd 2 clause license": "bsd2-notice", "bsd 3 clause license": "bsd3-notice", "gnu lesser general public license version 2 1": "lgpl21-notice", "gnu lesser general public license version 3": "lgpl3-notice",
    "gnu affero general public license version 3": "agpl3-notice",
}
MORE_RULES = {
    "lgpl-header": ("LGPL", ("lgpl-free", "gpl-hope")), "agpl-header": ("AGPL", ("agpl-free", "gpl-hope")), "isc-text": ("ISC", ("isc-grant",)), "zlib-text": ("Zlib", ("zlib-grant",)), "unlicense-text": ("Unlicense", ("unlicense",)),
    "boost-1.0-notice": ("BSL-1.0", ("boost-notice",)), "isc-notice": ("ISC", ("isc-notice",)), "bsd-2-clause-notice": ("BSD-2-Clause", ("bsd2-notice",)), "bsd-3-clause-notice": ("BSD-3-Clause", ("bsd3-notice",)),
    "lgpl-2.1-notice": ("LGPL-2.1", ("lgpl21-notice",)), "lgpl-3.0-notice": ("LGPL-3.0", ("lgpl3-notice",)), "agpl-3.0-notice": ("AGPL-3.0", ("agpl3-notice",)),
    "bsd-3-clause-text": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    **{f"{k}-spdx": (x, (f"spdx-{i}",)) for k, x, i in (
        ("mit", "MIT", "mit"), ("apache-2.0", "Apache-2.0", "apache"), ("gpl-2.0", "GPL-2.0", "gpl2"), ("gpl-3.0", "GPL-3.0", "gpl3"), ("bsd-2-clause", "BSD-2-Clause", "bsd2"), ("bsd-3-clause", "BSD-3-Clause", "bsd3"),
        ("isc", "ISC", "isc"), ("lgpl-2.1", "LGPL-2.1", "lgpl21"), ("lgpl-3.0", "LGPL-3.0", "lgpl3"), ("agpl-3.0", "AGPL-3.0", "agpl3"), ("unlicense", "Unlicense", "unlicense"), ("zlib", "Zlib", "zlib"), ("bsl-1.0", "BSL-1.0", "boost"),
        ("cc0-1.0", "CC0-1.0", "cc0"), ("mpl-2.0", "MPL-2.0", "mpl2"), ("cc-by-4.0", "CC-BY-4.0", "ccby4"), ("cc-by-nc-4.0", "CC-BY-NC-4.0", "ccbync4"), ("cc-by-sa-4.0", "CC-BY-SA-4.0", "ccbysa4"),
    )},
}
_NOTICE = f"(?:(?:this|the) (?:{'|'.join(_THINGS)}) is )?(?:licensed|released|distributed|made available) under (?:the )?(?:terms of the )?"
_END = r"[.!?]+[ \t-\r]+|\n"


def marked(text: Column) -> Column:
    """The normalised text; S stands at ends of sentences and paragraphs, L at ends of lines, with blanks around them."""
    t = F.regexp_replace(F.lower(text), r"(?<![a-z0-9])v\.[ \t-\r]+(?=[0-9])", "v ")
    for what, mark in ((r"[.!?]+[ \t-\r]+", " S "), (r"\n[^a-z0-9S]*\n", " S "), (r"\n", " L ")):
        t = F.regexp_replace(t, what, mark)
    return F.regexp_replace(F.concat(F.lit("S "), t, F.lit(" S")), "[^a-z0-9SL]+", " ")


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES, more: dict[str, str] = MORE_SENTENCES, notices: dict[str, str] = NOTICES) -> Column:
    """Known identifiers of a text's sentences, in order."""
    table = {v: k for k, v in sentences.items()} | more
    forms = [*(x.replace(" ", "(?: L)* ") for x in sorted(table, key=len, reverse=True)), _NOTICE.replace(" ", "(?: L)* ") + f"(?:{'|'.join(x.replace(' ', '(?: L)* ') for x in notices)})"]
    found = F.regexp_extract_all(marked(text), F.lit(f"[SL] ({'|'.join(forms)})(?= [SL])"), F.lit(1))
    known, said = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (table, notices))
    plain = F.transform(found, lambda s: F.regexp_replace(s, " L(?= )", ""))
    return F.transform(plain, lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(said, F.regexp_replace(s, f"^{_NOTICE}", ""))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict = SENTENCES, rules: dict = RULES | MORE_RULES) -> DataFrame:
    """One row per row of docs: doc_id, sentence_ids, rules and licenses (comma-joined; the last two in order of rules, distinct)."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.array_join(identifiers(whole(docs[text_col]), sentences), ",").alias("sentence_ids"))
    # commas are doubled, so that sequences side by side share none
    framed = F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(","))
    sequence = lambda ids: f",{',,'.join(ids)},"
    count = lambda seq: (F.length(framed) - F.length(F.replace(framed, F.lit(seq), F.lit("")))) / len(seq)

    def holds(license: str, ids: tuple[str, ...]) -> Column:
        own = sequence(ids)
        longer = [sequence(more) for other, more in rules.values() if other != license and len(more) > len(ids) and own in sequence(more)]
        return count(own) > sum((count(x) for x in longer), F.lit(0)) if longer else F.contains(framed, F.lit(own))

    held = [F.when(holds(license, ids), F.struct(F.lit(name).alias("rule"), F.lit(license).alias("license"))) for name, (license, ids) in rules.items()]
    rows = rows.withColumn("held", F.array_compact(F.array(*held)))
    return rows.select("doc_id", "sentence_ids", F.array_join("held.rule", ",").alias("rules"), F.array_join(F.array_distinct("held.license"), ",").alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


ORACLE_SQL = f"""
WITH known(id, norm) AS (VALUES {_values((k, v) for k, v in SENTENCES.items())}),
rule(place, name, license, seq) AS (VALUES {_values((i, n, x, "," + ",".join(s) + ",") for i, (n, (x, s)) in enumerate(RULES.items()))}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, generate_subscripts(parts, 1) AS i, unnest(parts) AS s FROM (SELECT r, regexp_split_to_array(text, '{_END}') AS parts FROM d)),
k AS (SELECT s.r, string_agg(known.id, ',' ORDER BY i) AS ids FROM s JOIN known ON trim(regexp_replace(lower(s.s), '[^a-z0-9]+', ' ', 'g')) = known.norm GROUP BY s.r),
a AS (SELECT d.r, d.doc_id, coalesce(k.ids, '') AS ids FROM d LEFT JOIN k USING (r)),
h AS (SELECT a.r, rule.place, rule.name, rule.license FROM a JOIN rule ON contains(',' || a.ids || ',', rule.seq)),
l AS (SELECT r, license, min(place) AS place FROM h GROUP BY ALL)
SELECT a.doc_id, a.ids AS sentence_ids, coalesce((SELECT string_agg(h.name, ',' ORDER BY h.place) FROM h WHERE h.r = a.r), '') AS rules,
  coalesce((SELECT string_agg(l.license, ',' ORDER BY l.place) FROM l WHERE l.r = a.r), '') AS licenses FROM a
"""
