"""Licence scan by sentence rules, in DataFrame functions only.

A text is normalised (lower case, letters and digits only) and cut into pieces at the ends of sentences, clauses and lines.
A known licence sentence is one piece or several in a row: where a text wraps it, with or without comment signs at the start
of a line, and at which colons or semicolons it is cut does not matter; it begins and ends where pieces do, the longest one
is taken first. What is known becomes its identifier, any other piece a gap. The identifiers form a sequence that is
matched against ordered rules: a rule names the identifiers that must stand side by side, the first rule that fits takes them.

Null and empty texts have no licence: `licences` is an empty string. Every row gives one row, repeated rows and rows
without an id too. Texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelayer.llm.texts import id_and_text

# Sentences as licences and notices word them, normalised, with an identifier each.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl2-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under cc by nc 4 0": "cc-by-nc4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa4-notice",
    "licensed under cc by 4 0": "cc-by4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
}

# Rules in order; the identifiers of a rule stand side by side.
RULES = [
    ("Apache-2.0", ["apache-notice", "apache-use", "apache-copy"]),
    ("Apache-2.0", ["apache-notice", "apache-use"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-grant", "mit-notice-kept"]),
    ("MIT", ["mit-notice"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
    ("CC-BY-4.0", ["cc-by4-notice"]),
    ("MPL-2.0", ["mpl2-notice"]),
]

# Every known sentence holds one of these (a test proves it), so a text without any of them has no known sentence.
ANCHORS = ("licen", "copyright", "warrant", "permi")

PIECE_END = r"[.!?;:]+[ \t\r\n]+|\n"
COMMENT_WORD = r"\n[ \t]*(?:rem|dnl)[ \t]+"  # any other comment sign has no letters and vanishes anyway
GAP = "-"


def _pieces(small: Column) -> Column:
    """The words of a text in lower case as '|piece|next piece|'."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(small, "|", " "), COMMENT_WORD, "\n"), PIECE_END, "|")
    return F.concat(F.lit("|"), F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9|]+", " "), r" *\|[ |]*", "|"), F.lit("|"))


def _sequence(small: Column, known: dict[str, str]) -> Column:
    """The identifiers of a text as ',a,,b,,-,': each has its own commas. An enumeration like `1.` or `(a)` is no sentence and no part of one."""
    longest_first = sorted(known.items(), key=lambda pair: (-len(pair[0]), pair[0]))
    wrapped = [(words, r"\| ?(?:[0-9a-z][ |])?" + words.replace(" ", "[ |]") + r" ?(?=\|)", "|=" + name) for words, name in longest_first]
    table = F.array(*[F.struct(F.lit(w).alias("words"), F.lit(p).alias("pattern"), F.lit(n).alias("name")) for w, p, n in wrapped])

    def look_up(state: Column, entry: Column) -> Column:
        found = F.regexp_replace(state["pieces"], entry["pattern"], entry["name"])
        return F.struct(F.when(F.contains(state["flat"], entry["words"]), found).otherwise(state["pieces"]).alias("pieces"), state["flat"].alias("flat"))

    def start(pieces: Column) -> Column:
        return F.struct(pieces.alias("pieces"), F.replace(pieces, F.lit("|"), F.lit(" ")).alias("flat"))

    state = F.transform(F.array(_pieces(small)), lambda pieces: F.aggregate(table, start(pieces), look_up)["pieces"])
    pieces = F.transform(F.split(state[0], r"\|"), lambda piece: F.trim(piece))

    def identifier(piece: Column) -> Column:
        return F.when(F.startswith(piece, F.lit("=")), F.substring(piece, 2, 1_000)).when(~piece.rlike("^([0-9]*|[a-z])$"), F.lit(GAP))

    found = F.filter(F.transform(pieces, identifier), lambda x: x.isNotNull())
    return F.concat(F.lit(","), F.array_join(found, ",,"), F.lit(","))


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `licences` (names in the order of the rules, with commas), `known_sentences`, `unmatched_sentences`."""
    rows = id_and_text(docs, id_col, text_col).withColumn("small", F.lower("text"))
    held = all(any(anchor in sentence for anchor in ANCHORS) for sentence in known)
    may = F.lit(not held)  # sentences of a caller may have none of the anchors: then every text is looked at
    for anchor in ANCHORS if held else ():
        may = may | F.contains(F.col("small"), F.lit(anchor))
    rows = rows.select("doc_id", F.when(may, _sequence(F.col("small"), known)).otherwise(F.lit(",")).alias("sequence"))
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(ids) + ",").alias("ids")) for name, ids in rules])
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        fits = F.contains(state["rest"], rule["ids"])
        rest = F.when(fits, F.replace(state["rest"], rule["ids"], F.lit(f",{GAP},"))).otherwise(state["rest"])
        found = F.when(fits & ~F.array_contains(state["found"], rule["name"]), F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"])
        return F.struct(rest.alias("rest"), found.alias("found"))

    plain = F.struct(F.lit(",").alias("rest"), F.array().cast("array<string>").alias("found"))
    state = F.when(F.col("sequence").rlike("[a-z]"), F.aggregate(ordered, start, apply)).otherwise(plain)
    rows = rows.select("doc_id", "sequence", state.alias("state"))
    return rows.select(
        "doc_id",
        F.array_join("state.found", ",").alias("licences"),
        F.regexp_count("sequence", F.lit("[a-z][a-z0-9-]*")).cast("bigint").alias("known_sentences"),
        F.regexp_count("state.rest", F.lit("[a-z][a-z0-9-]*")).cast("bigint").alias("unmatched_sentences"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(known: dict[str, str] = SENTENCES, rules: list = RULES) -> str:
    """The scan for DuckDB, over `documents` whose known sentences stand in one piece: it does not put wrapped ones together."""
    table = "MAP {" + ", ".join(f"{_quoted(s)}: {_quoted(i)}" for s, i in known.items()) + "}"
    steps = ["s0 AS (SELECT doc_id, sequence, sequence AS rest, CAST([] AS VARCHAR[]) AS found FROM sequences)"]
    for k, (name, ids) in enumerate(rules):
        side_by_side = _quoted("," + ",,".join(ids) + ",")
        steps.append(
            f"s{k + 1} AS (SELECT doc_id, sequence, replace(rest, {side_by_side}, ',{GAP},') AS rest, "
            f"CASE WHEN contains(rest, {side_by_side}) AND NOT list_contains(found, {_quoted(name)}) THEN list_append(found, {_quoted(name)}) ELSE found END AS found FROM s{k})"
        )
    return f"""
WITH sentences AS (
  SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '[.!?;:]+[ \\t\\r\\n]+|\\n'),
                                lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))) AS plain
  FROM documents),
sequences AS (
  SELECT doc_id, ',' || array_to_string(list_transform(list_filter(plain, lambda s: NOT regexp_full_match(s, '[0-9]*|[a-z]')),
           lambda s: coalesce({table}[s], {table}[regexp_replace(s, '^(?:[0-9]|[a-z]) ', '')], '{GAP}')), ',,') || ',' AS sequence
  FROM sentences),
{", ".join(steps)}
SELECT doc_id, array_to_string(found, ',') AS licences,
       CAST(len(regexp_extract_all(sequence, '[a-z][a-z0-9-]*')) AS BIGINT) AS known_sentences,
       CAST(len(regexp_extract_all(rest, '[a-z][a-z0-9-]*')) AS BIGINT) AS unmatched_sentences
FROM s{len(rules)}
"""
