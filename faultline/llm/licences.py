"""Licence scans: MinHash bands retrieve templates, exact containment verifies them.

Words are runs of letters and digits in lower case, shingles are five words. For a
template of t shingles the text is read in windows of 2t shingles that start every
t shingles, so an occurrence lies wholly inside one of them. A window's MinHash
signature has ``BANDS`` bands of one row; a template is retrieved when a band
agrees. An occurrence at the threshold has Jaccard similarity of at least
0.8t / 2.2t with its window, so it is missed with a chance below
(1 - 0.36) ** 32 = 1e-6. Retrieved templates are kept when the window holds at
least ``THRESHOLD`` of their different shingles.

Licences of one family share most of their words. Of two of them found at the same
place (half of the shingles of one or more), the one with more shingles of the text
is reported, then the one of which more is there, then the first of the list.

The shingles of all templates are one table of buckets, in which a shingle of a text
finds its templates by its hash. Windows without any template shingle cannot reach
the threshold and get no signature. All of it happens inside the row of a document:
nothing is shuffled, and the templates are a fixed list whose size is a parameter of
the job.

Defined results: a null text, an empty text and one with fewer than five words hold
no licence; a template repeated in a text counts once per window; rows do not
depend on each other. Other columns pass through, except one with the name of the
result.
"""

import json
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import let
from faultline.llm.common import text_of

# fixed values: public licence notices
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons"
        " to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
        " except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:",
    ),
)
# further notices; the terms of the licences are in licence_texts
GNU = "This work is licensed under the GNU {}General Public License, version {}."
GNU_SHORT = "licensed under the GNU {}General Public License version {}"
GNU_NOTICE = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the"
    " GNU {1}General Public License as published by the Free Software Foundation, either version {2}"
    " of the License, or (at your option) any later version."
)
CC_NOTICE = "This work is licensed under a Creative Commons Attribution{} {} {} License."
CC_TERMS = (
    "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and"
    " conditions of this Creative Commons Attribution{} 4.0 International Public License (\"Public License\")."
)
GNU_VERSIONS = (
    ("GPL", "", ("1", "2", "3")),
    ("LGPL", "Library ", ("2",)),
    ("LGPL", "Lesser ", ("2.1", "3")),
    ("AGPL", "Affero ", ("3",)),
)
CC_KINDS = (
    ("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"),
    ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"),
)
RELEASED = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0")
NOTICES = (
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
     " MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may"
     " not use this file except in compliance with the License."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of"
     " the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public"
     " License 2.0 which is available at"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC"
     " LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE"
     " OF THIS AGREEMENT."),
    ("EPL-1.0", "Eclipse Public License - v 1.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC"
     " LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE"
     " OF THIS AGREEMENT."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free"
     " Documentation License, Version 1.2 or any later version published by the Free Software Foundation;"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free"
     " Documentation License, Version 1.3 or any later version published by the Free Software Foundation;"),
)
REMOTE_USE = (
    "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision"
    " of this License, if you modify the Program, your modified version must prominently offer all users interacting"
    " with it remotely through a computer network (if your version supports such interaction) an opportunity to"
    " receive the Corresponding Source of your version by providing access to the Corresponding Source from a network"
    " server at no charge, through some standard or customary means of facilitating copying of software. This"
    " Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General"
    " Public License that is incorporated pursuant to the following paragraph. "
)
FAMILIES = {"MIT-0": "MIT", "0BSD": "ISC", "LGPL": "GPL", "AGPL": "GPL"}  # by name, else by what is before the dash
SHINGLE = 5
BANDS = 32
THRESHOLD = 0.8
BUCKETS = 1 << 14  # of the shingles of all templates


def family(name: str) -> str:
    first = name.split("-")[0]
    return FAMILIES.get(name, FAMILIES.get(first, first))


@lru_cache(maxsize=1)
def known() -> tuple[tuple[str, str], ...]:
    """(licence, text) of all templates: ``TEMPLATES``, further notices and whole terms."""
    found = [*TEMPLATES, *NOTICES]
    for name, kind, versions in GNU_VERSIONS:
        for version in versions:
            full = f"{name}-{version if '.' in version else version + '.0'}"
            found += [(full, form.format(kind, version)) for form in (GNU, GNU_SHORT)]
            found += [(full, GNU_NOTICE.format(work, kind, version)) for work in ("program", "library", "file")]
    for name, kind in CC_KINDS:
        found += [(f"CC-{name}-{v}", f"Licensed under CC {name} {v}.") for v in ("3.0", "4.0")]
        found += [(f"CC-{name}-{v}", CC_NOTICE.format(kind, v, w)) for v, w in (("3.0", "Unported"), ("4.0", "International"))]
        found.append((f"CC-{name}-4.0", CC_TERMS.format(kind)))
    found += [(name, f"Released under the {name} License.") for name in RELEASED]
    folder = resources.files("faultline.llm") / "licence_texts"
    texts = {f.name.removesuffix(".txt"): f.read_text() for f in sorted(folder.iterdir(), key=lambda f: f.name)}
    gpl = texts["GPL-3.0"]
    section = gpl.index("  13. Use with the GNU Affero")
    texts["AGPL-3.0"] = (
        gpl[:section].replace("GNU General", "GNU Affero General")
        + REMOTE_USE
        + gpl[gpl.index("Notwithstanding", section) : gpl.index("  14. Revised")]
        .replace("GNU Affero General", "GNU General")
        .replace("but the special requirements of the GNU General Public License, section 13, concerning interaction"
                 " through a network will apply to the combination as such",
                 "but the work with which it is combined will remain governed by version 3 of the GNU General Public License")
        + gpl[gpl.index("  14. Revised") :].replace("GNU General", "GNU Affero General")
    )
    mit, isc = texts["MIT"], texts["ISC"]
    granted, given = mit.index("subject to the following"), mit.index("THE SOFTWARE IS PROVIDED")
    texts["MIT-0"] = mit[:granted].rstrip().removesuffix(",") + ". " + mit[given:]
    texts["0BSD"] = isc[: isc.index("provided that")].rstrip().removesuffix(",") + ". " + isc[isc.index("THE SOFTWARE IS") :]
    return tuple(dict.fromkeys([*found, *sorted(texts.items())]))


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order."""

    def hashed(words: Column) -> Column:
        return F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)]),
        )

    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return let(F.array_remove(parts, ""), hashed)


def signature(shingles: Column) -> Column:
    """The smallest hash of the shingles in each band; an empty set has none."""
    return F.array(
        *[F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k)))) for k in range(BANDS)]
    )


def prepared(spark: SparkSession, templates) -> list:
    """Name, length, shingles and signature of each template, by the functions of the texts."""
    rows = spark.createDataFrame(list(enumerate(templates)), "place int, t struct<name:string,text:string>")
    held = rows.select("place", "t.name", shingle_hashes(F.col("t.text")).alias("all"))
    held = held.withColumn("shingles", F.array_distinct("all"))
    return held.select("place", "name", F.size("all").alias("length"), "shingles", signature(F.col("shingles")).alias("bands")).orderBy("place").collect()


def constant(value, schema: str) -> Column:
    """A fixed value that Spark reads once, when it plans."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def bucket_table(templates) -> Column:
    """In each bucket the shingles of all templates, with the templates that have them."""
    places: dict[int, list[int]] = {}
    for t in templates:
        for h in t.shingles:
            places.setdefault(h, []).append(t.place)
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for h, p in places.items():
        buckets[h % BUCKETS].append({"h": h, "p": p})
    return constant(buckets, "array<array<struct<h:bigint,p:array<int>>>>")


def template_table(templates) -> Column:
    rows = [
        {"name": t.name, "family": family(t.name), "length": t.length, "size": len(t.shingles), "bands": list(t.bands)}
        for t in templates
    ]
    return constant(rows, "array<struct<name:string,family:string,length:int,size:int,bands:array<bigint>>>")


def windows_hit(hits: Column, length: Column) -> Column:
    """Numbers of the windows of a template's length that hold a hit."""
    first = F.transform(hits, lambda i: F.floor(i / length).cast("int"))
    both = F.concat(first, F.filter(F.transform(first, lambda w: w - 1), lambda w: w >= 0))
    return F.array_distinct(both)


MATCH = "array<struct<place:int,name:string,family:string,size:int,common:int,at:array<int>>>"


def matches(hashes: Column, hits: Column, place: Column, t: Column) -> Column:
    """The windows that retrieve a template and are verified to hold it, and where its shingles are."""

    def found(own: Column) -> Column:
        def agrees(start: Column) -> Column:
            bands = signature(F.array_distinct(F.slice(hashes, start + 1, 2 * t["length"])))
            return F.exists(F.zip_with(bands, t["bands"], lambda a, b: a == b), lambda same: same)

        def held(start: Column) -> Column:
            at = F.filter(own, lambda i: (i >= start) & (i < start + 2 * t["length"]))
            common = F.size(F.array_distinct(F.transform(at, lambda i: F.get(hashes, i))))
            return F.struct(at.alias("at"), common.alias("common"))

        starts = F.transform(windows_hit(own, t["length"]), lambda w: w * t["length"])
        retrieved = F.filter(starts, agrees)
        verified = F.filter(F.transform(retrieved, held), lambda m: m["common"] >= THRESHOLD * t["size"])
        return F.transform(
            verified,
            lambda m: F.struct(
                place.alias("place"), t["name"].alias("name"), t["family"].alias("family"), t["size"].alias("size"),
                m["common"].alias("common"), m["at"].alias("at"),
            ),
        )

    return let(F.transform(F.filter(hits, lambda x: F.array_contains(x["p"], place)), lambda x: x["i"]), found)


def best(found: Column) -> Column:
    """Without the matches that another licence of the family explains better."""

    def better(a: Column, b: Column) -> Column:
        there, here = b["common"] * a["size"], a["common"] * b["size"]
        more = (b["common"] == a["common"]) & ((there > here) | ((there == here) & (b["place"] < a["place"])))
        same_place = 2 * F.size(F.array_intersect(a["at"], b["at"])) >= F.size(a["at"])
        return (b["family"] == a["family"]) & (b["name"] != a["name"]) & ((b["common"] > a["common"]) | more) & same_place

    return F.filter(found, lambda a: ~F.exists(found, lambda b: better(a, b)))


def scanned(docs: DataFrame, templates=None, column: str = "licences") -> DataFrame:
    """Adds an array of (licence, windows), one entry for each template that is in the text."""
    held = prepared(docs.sparkSession, known() if templates is None else templates)
    buckets, table = bucket_table(held), template_table(held)

    def places(h: Column) -> Column:
        return F.get(F.transform(F.filter(F.get(buckets, F.pmod(h, F.lit(BUCKETS)).cast("int")), lambda e: e["h"] == h), lambda e: e["p"]), 0)

    def scan(hashes: Column) -> Column:
        tagged = F.transform(hashes, lambda h, i: F.struct(i.alias("i"), places(h).alias("p")))
        return let(F.filter(tagged, lambda x: x["p"].isNotNull()), lambda hits: named(hashes, hits))

    def named(hashes: Column, hits: Column) -> Column:
        present = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["p"]))))
        found = F.flatten(F.transform(present, lambda k: matches(hashes, hits, k, F.get(table, k))))
        return let(found.cast(MATCH), lambda all_found: let(best(all_found), counted))

    def counted(kept: Column) -> Column:
        return F.transform(
            F.array_sort(F.array_distinct(F.transform(kept, lambda m: m["place"]))),
            lambda k: F.struct(
                F.get(table, k)["name"].alias("licence"),
                F.size(F.filter(kept, lambda m: m["place"] == k)).cast("long").alias("windows"),
            ),
        )

    return docs.withColumn(column, let(shingle_hashes(text_of()), scan))


def licence_report(docs: DataFrame, templates=None) -> DataFrame:
    """doc_id, the licences of each text in order, and in how many windows they are."""
    found = scanned(docs.select("doc_id", "text"), templates)
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda m: m["licence"]))), ",").alias("licences"),
        F.aggregate("licences", F.lit(0).cast("long"), lambda a, m: a + m["windows"]).alias("n_windows"),
    )
