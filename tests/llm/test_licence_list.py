"""Licences apart from their relatives, as notices and as whole terms."""

from faultline.llm import licences

BODY = dict(licences.known())  # the last text of a licence: its terms, where they are in the list
GPL2 = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
    " option) any later version."
)


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licences for r in licences.licence_report(df).orderBy("doc_id").collect()]


def test_every_template_is_found_under_its_own_name(spark):
    found = scan(spark, ["head words " * 9 + text + " tail words" * 9 for _, text in licences.known()])
    wrong = [(name, text[:60], got) for (name, text), got in zip(licences.known(), found) if got != name]
    assert not wrong


def test_versions_and_variants_are_told_apart(spark):
    three = GPL2.replace("version 2", "version 3")
    got = scan(spark, [
        GPL2, three, three.replace("General", "Lesser General"), three.replace("General", "Affero General"),
        BODY["BSD-2-Clause"], BODY["BSD-3-Clause"], "x " * 30 + GPL2 + " y" * 300 + three,
        BODY["ISC"], BODY["0BSD"], BODY["MIT"], BODY["MIT-0"],
        BODY["GPL-3.0"] + " z" * 50 + GPL2, BODY["AGPL-3.0"], BODY["Unlicense"] + " " + BODY["MPL-2.0"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "the terms of nothing at all", None,
    ])
    assert got == [
        "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0,GPL-3.0", "ISC", "0BSD", "MIT",
        "MIT-0", "GPL-2.0,GPL-3.0", "AGPL-3.0", "MPL-2.0,Unlicense", "CC-BY-SA-4.0", "", "",
    ]
