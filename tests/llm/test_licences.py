from tidelayer.llm.licences import ANCHORS, RULES, SENTENCES, scan


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    return [tuple(r)[1:] for r in scan(docs).orderBy("doc_id").collect()]


def test_every_sentence_has_an_anchor_and_every_rule_known_identifiers():
    assert all(any(a in s for a in ANCHORS) for s in SENTENCES)
    assert all(set(ids) <= set(SENTENCES.values()) for _, ids in RULES)


def test_sequences(spark):
    header = (
        "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
        "You may obtain a copy of the License at\n"
    )
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.\n"
    )
    names = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert found(
        spark,
        [
            "Prose. Released under the MIT License. Released under the MIT License. More prose.",
            header,
            bsd,
            bsd + names,
            bsd.replace("2. Redist", "Something else.\nRedist"),  # the sequence is broken
            "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
            "this license is unknown",
            "See the GNU General Public License for more details.",
        ],
    ) == [
        ("MIT", 2, 0), ("Apache-2.0", 2, 0), ("BSD-2-Clause", 3, 0), ("BSD-3-Clause", 4, 0), ("", 3, 3), ("GPL-3.0,CC-BY-NC-4.0", 3, 0), ("", 0, 0), ("", 1, 1),
    ]


def test_awkward_rows(awkward, nothing):
    got = scan(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.doc_id for r in got if r.licences} == {12}
    assert scan(nothing).count() == 0


def test_native(awkward):
    plan = scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")


def test_wrapped_canonical_texts(spark):
    texts = [MIT, BSD, APACHE, GPL3, GPL2]
    names = [("MIT", 2, 0), ("BSD-3-Clause", 4, 0), ("Apache-2.0", 3, 0), ("GPL-3.0-or-later", 3, 0), ("GPL-2.0-or-later", 3, 0)]
    for sign in ("", "# ", " * ", "// ", "dnl "):
        wrapped = ["Some words | and\n" + "\n".join(sign + line for line in text.splitlines()) + "\nint x = 1;" for text in texts]
        assert found(spark, wrapped) == names, sign
    assert found(spark, [" ".join(text.split()) for text in texts]) == names  # on one line
    assert found(spark, [text.replace("\n", "\r\n") for text in texts]) == names


def test_known_words_inside_a_longer_piece_are_no_sentence(spark):
    assert found(spark, ["It was not released under the MIT License.", "Released under the\nMIT License of old.", "=mit-notice"]) == [("", 0, 0)] * 3


def test_sentences_of_a_caller(spark):
    docs = spark.createDataFrame([(1, "This is public domain work."), (2, "Nothing.")], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.licences for r in scan(docs, known={"this is public domain work": "pd"}, rules=[("PD", ["pd"])]).collect()}
    assert got == {1: "PD", 2: ""}
