"""Licence notices by Dice similarity of word bigrams (native DataFrame functions only).

A text is normalised (A-Z lower-cased, everything but ASCII letters, digits and points inside numbers becomes a space) to
one run of words across its lines. Each window of it that begins and ends with a bigram of a template is compared, as a set
of word bigrams, with the template's set: windows cut anywhere else have less Dice. Dice >= threshold is only possible when the
sizes differ by a factor of at most (2 - t) / t and the window holds t / (2 - t) of the template's bigrams; texts without the
words that this takes are passed over. Of each template and start the best window counts; of windows that share a word, the
one with more Dice, then the longer one. Full licences are found by their headings and opening paragraphs, not compared to their end.

Siblings differ in a word or two, which Dice alone forgives. So what tells a template from its siblings stands in braces, and a window must hold
every bigram of it. Licences that begin alike and differ in a later clause are told by that clause: an opening (of BSD or MIT kind) takes the name
of the strongest clause of its kind between it and the next opening; a clause without an opening is a notice of its own.

Defined cases: null or empty text: no notices. A notice's line is the one it begins on. A tie in Dice goes to the licence first
in alphabetical order. Repeated rows each get their own result. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Short notices and the distinctive opening paragraphs of common licences. What stands in braces must be there word by word.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the {BSD 2-Clause} License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the {BSD 3-Clause} License."),
    ("CC-BY-4.0", "Licensed under {CC BY 4.0}."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons {Attribution 4.0} International License."),
    ("CC-BY-NC-4.0", "Licensed under {CC BY-NC 4.0}."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons {Attribution-NonCommercial 4.0} International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under {CC BY-NC-ND 4.0}."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons {Attribution-NonCommercial-NoDerivatives 4.0} International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under {CC BY-NC-SA 4.0}."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons {Attribution-NonCommercial-ShareAlike 4.0} International License."),
    ("CC-BY-ND-4.0", "Licensed under {CC BY-ND 4.0}."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons {Attribution-NoDerivatives 4.0} International License."),
    ("CC-BY-SA-4.0", "Licensed under {CC BY-SA 4.0}."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons {Attribution-ShareAlike 4.0} International License."),
    ("CC0-1.0", "Released under {CC0 1.0}."),
    ("CC0-1.0", "This work is dedicated to the public domain under the {CC0 1.0} Universal Public Domain Dedication."),
    ("EPL-1.0", "Licensed under the {Eclipse Public License 1.0}."),
    ("EPL-2.0", "Licensed under the {Eclipse Public License 2.0}."),
    ("GPL-2.0", "This work is licensed under the {GNU General} Public {License, version 2}."),
    ("GPL-2.0-only", "Licensed under the {GPL version 2 only}."),
    ("GPL-2.0-only", "GNU General Public {License version 2 only}."),
    ("GPL-3.0", "This work is licensed under the {GNU General} Public {License, version 3}."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General} Public License as published by the Free Software Foundation, {either version 3} of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "Licensed under the {GPL version 3 only}."),
    ("GPL-3.0-only", "GNU General Public {License version 3 only}."),
    ("LGPL-3.0", "This work is licensed under the {GNU Lesser General} Public {License, version 3}."),
    ("MIT", "Released under the {MIT License}."),
    ("MIT", "Licensed under the {MIT License}."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: Headings and telling passages of full licences, and notices of versions that another's would be taken for.
FULL: list[tuple[str, str]] = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the {Boost Software License}, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the {Eclipse Public License v1.0} which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the {Eclipse Public License 2.0} which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "{GNU GENERAL} PUBLIC LICENSE {Version 2, June} 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General} Public License as published by the Free Software Foundation; {either version 2} of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General} Public {License version 2} as published by the Free Software Foundation."),
    ("GPL-3.0", "{GNU GENERAL} PUBLIC LICENSE {Version 3, 29} June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-2.1", "{GNU LESSER GENERAL} PUBLIC LICENSE {Version 2.1} February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-3.0", "{GNU LESSER GENERAL} PUBLIC LICENSE {Version 3, 29} June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", "{GNU AFFERO GENERAL} PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General} Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "{Neither the name of} the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All {advertising materials} mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General} Public License as published by the Free Software Foundation; either {version 2.1} of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General} Public License as published by the Free Software Foundation; either {version 3} of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("X11", "{Except as contained in this notice}, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]

#: Licence identifiers as they stand behind SPDX-License-Identifier.
SPDX = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0
CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0
LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib""".split()
TAGS = [(name, "{SPDX-License-Identifier: " + name + "}") for name in SPDX]

#: Openings and the clauses that name them: kind, beginning of the normalised template, whether it is a clause.
CLAUSES = [
    ("BSD", "redistribution and use in source", False), ("BSD", "neither the name of", True), ("BSD", "all advertising materials", True),
    ("MIT", "permission is hereby granted free of charge", False), ("MIT", "except as contained in this notice", True),
]


def _norm(text: str) -> list[str]:
    return re.sub(r"\.(?![0-9])|[^a-z0-9.]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def required(text: str) -> list[str]:
    """Bigrams of what stands in braces."""
    return list(dict.fromkeys(f"{a} {b}" for part in re.findall(r"\{(.*?)\}", text) for ws in [_norm(part)] for a, b in zip(ws, ws[1:])))


def clause_of(text: str) -> tuple[str, bool]:
    """Kind of an opening or clause, and whether it is a clause; kind is empty for all other templates."""
    own = " ".join(_norm(text))
    return next(((kind, clause) for kind, begin, clause in CLAUSES if own.startswith(begin)), ("", False))


def template_bigrams(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct word bigrams) of each template that has a bigram."""
    out = []
    for name, text in templates:
        words = _norm(text)
        pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        if pairs:
            out.append((name, pairs))
    return out


#: Words of templates that much other text holds; gates are made of them last.
COMMON = frozenset("a and any are as be by following for free in is it may no not of or other person provided public that the this to under use version with work you 2 2.0 3 4.0".split())


def gate_words(sets: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every window that reaches the threshold holds one: those of so many bigrams of each template that it can't miss all."""
    chosen: set[str] = set()
    for _, pairs in sets:
        spare = len(pairs) - _least(len(pairs), threshold)
        count = {w: sum(w in p.split(" ") for p in pairs) for p in pairs for w in p.split(" ")}
        ranked = sorted(count, key=lambda w: (w not in chosen, w in COMMON, -len(w), w))
        own: set[str] = set()
        while sum(bool(own & set(p.split(" "))) for p in pairs) <= spare:
            own.add(ranked[len(own)])
        chosen |= own
    return sorted(chosen)


def _least(n: int, threshold: float) -> int:
    return max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9))


def words_of(s: Column) -> Column:
    low = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.regexp_replace(low, r"\.(?![0-9])|[^a-z0-9.]", " "), " "), "")


def _bind(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.transform(F.array(value), f)[0]


_WINDOW = "struct<a:int,b:int,line:int,minus:double,less:int,license:string,kind:string,clause:boolean>"


def _apart(own: Column) -> Column:
    """Windows ordered by start: of those that share a word the better stays; what it displaced comes back if it is displaced itself."""
    none = F.array().cast(f"array<{_WINDOW}>")
    state = lambda done, last, was: F.struct(done.alias("done"), last.alias("last"), was.alias("was"))
    rank = lambda x: F.struct(x["minus"], x["less"], x["license"])

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc["last"], F.lit(0))
        back = F.filter(acc["was"], lambda w: (w["b"] + 1 < x["a"]) & ((F.size(acc["done"]) == 0) | (F.get(acc["done"], F.size(acc["done"]) - 1)["b"] + 1 < w["a"])))
        return (
            F.when((F.size(acc["last"]) == 0) | (last["b"] + 1 < x["a"]), state(F.concat(acc["done"], acc["last"]), F.array(x), none))
            .when(rank(x) < rank(last), state(F.concat(acc["done"], back), F.array(x), acc["last"]))
            .otherwise(state(acc["done"], acc["last"], acc["was"]))
        )

    return F.aggregate(own, state(none, none, none), step, lambda acc: F.concat(acc["done"], acc["last"]))


def _named(own: Column) -> Column:
    """Openings take the name of a clause of their kind behind them; those clauses are no notices of their own. From the end to the start."""
    none = F.array().cast(f"array<{_WINDOW}>")
    state = lambda out, held: F.struct(out.alias("out"), held.alias("held"))

    def step(acc: Column, x: Column) -> Column:
        mine = F.filter(acc["held"], lambda h: h["kind"] == x["kind"])
        name = F.coalesce(F.array_max(F.transform(mine, lambda h: h["license"])), x["license"])
        return (
            F.when(x["clause"], state(acc["out"], F.concat(acc["held"], F.array(x))))
            .when(x["kind"] != "", state(F.concat(acc["out"], F.array(x.withField("license", name).cast(_WINDOW))), F.filter(acc["held"], lambda h: h["kind"] != x["kind"])))
            .otherwise(state(F.concat(acc["out"], F.array(x)), acc["held"]))
        )

    named = lambda xs: F.aggregate(F.reverse(xs), state(none, none), step, lambda acc: F.array_sort(F.concat(acc["out"], acc["held"])))
    return F.when(F.exists(own, lambda x: x["kind"] != ""), named(own)).otherwise(own)


def notices(text: Column, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES + FULL + TAGS) -> Column:
    """array<struct<line int, license string, dice double>>: the best windows that reach the threshold and share no word."""
    sets = template_bigrams(templates)
    owners: dict[str, list[int]] = {}
    for k, (_, pairs) in enumerate(sets):
        for pair in pairs:
            owners.setdefault(pair, []).append(k)
    # Literal tables: bigram -> templates; template -> licence and bounds.
    lookup = F.create_map(*[c for pair, ks in owners.items() for c in (F.lit(pair), F.array(*[F.lit(k) for k in ks]))])
    texts = [t for _, t in templates if len(_norm(t)) > 1]
    shapes = F.array(*[
        F.struct(
            F.lit(k).alias("k"), F.lit(name).alias("license"), F.lit(len(pairs)).alias("n"), F.lit(_least(len(pairs), threshold)).alias("least"),
            F.lit(math.floor(len(pairs) * (2 - threshold) / threshold + 1e-9)).alias("most"),
            F.array(*[F.lit(x) for x in required(t)]).cast("array<string>").alias("must"), F.lit(clause_of(t)[0]).alias("kind"), F.lit(clause_of(t)[1]).alias("clause"),
        )
        for k, ((name, pairs), t) in enumerate(zip(sets, texts))
    ])

    def of_start(shape: Column, own: Column, bigrams: Column, i: Column) -> Column:
        """The best window from the template's hit number i, as an array of one or none."""
        a = F.get(own, i)["p"]
        ends = F.slice(own, i + shape["least"], shape["most"] - shape["least"] + 1)
        ends = F.filter(F.transform(ends, lambda h, j: F.struct(h["p"].alias("p"), (j + shape["least"]).alias("hits"))), lambda h: h["p"] - a < shape["most"])
        whole = lambda h: F.size(F.array_intersect(shape["must"], F.slice(own["pair"], i + 1, h["hits"]))) == F.size(shape["must"])
        ends = F.when(F.size(shape["must"]) == 0, ends).otherwise(F.filter(ends, whole))

        def window(h: Column) -> Column:
            size = F.size(F.array_distinct(F.slice(bigrams, a + 1, h["p"] - a + 1)))
            shared = F.size(F.array_distinct(F.slice(own["pair"], i + 1, h["hits"])))
            return F.struct((F.lit(-2.0) * shared / (size + shape["n"])).alias("minus"), (-shared).alias("less"), h["p"].alias("b"))

        best = F.array_min(F.transform(ends, window))
        return F.when(F.size(ends) == 0, F.array().cast(f"array<{_WINDOW}>")).otherwise(
            F.filter(F.array(F.struct(a.alias("a"), best["b"].alias("b"), F.get(own, i)["line"].alias("line"), best["minus"].alias("minus"), best["less"].alias("less"), shape["license"].alias("license"), shape["kind"].alias("kind"), shape["clause"].alias("clause"))), lambda w: -w["minus"] >= threshold)
        )

    def of_template(shape: Column, hits: Column, bigrams: Column) -> Column:
        none = F.array().cast(f"array<{_WINDOW}>")
        return _bind(
            F.filter(hits, lambda h: F.array_contains(h["ks"], shape["k"])),
            lambda own: F.when(F.size(own) < shape["least"], none).otherwise(
                F.flatten(F.transform(F.sequence(F.lit(0), F.size(own) - shape["least"]), lambda i: of_start(shape, own, bigrams, i)))
            ),
        )

    def of_words(ws: Column) -> Column:
        pairs = F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda x, y: F.struct(x["line"].alias("line"), F.concat_ws(" ", x["w"], y["w"]).alias("pair")))
        hit = lambda x, i: F.struct(i.alias("p"), x["line"].alias("line"), x["pair"].alias("pair"), F.try_element_at(lookup, x["pair"]).alias("ks"))
        found = lambda g: _bind(
            F.filter(F.transform(g, hit), lambda h: h["ks"].isNotNull()),
            lambda hits: F.flatten(F.transform(shapes, lambda shape: of_template(shape, hits, g["pair"]))),
        )
        return F.when(F.size(ws) < 2, F.array().cast(f"array<{_WINDOW}>")).otherwise(_bind(pairs, lambda g: _bind(_apart(F.array_sort(found(g))), _named)))

    some = F.coalesce(text, F.lit(""))
    gate = F.arrays_overlap(words_of(some), F.array(*[F.lit(w) for w in gate_words(sets, threshold)]))
    ws = F.flatten(F.transform(F.split(some, "\n"), lambda s, i: F.transform(words_of(s), lambda w: F.struct((i + 1).alias("line"), w.alias("w")))))
    kept = F.when(gate, _bind(ws, of_words)).otherwise(F.array().cast(f"array<{_WINDOW}>"))
    return F.transform(kept, lambda x: F.struct(x["line"].alias("line"), x["license"].alias("license"), (-x["minus"]).alias("dice")))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES + FULL + TAGS) -> DataFrame:
    """doc_id and the notices of each text; no shuffle."""
    return docs.select("doc_id", notices(F.col("text"), threshold, templates).alias("notices"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: number of notices, the licences found, and the best Dice value."""
    from spanveil.session import table

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.col("notices")
    return found.select(
        "doc_id",
        F.size(n).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(n["license"])), ",").alias("licenses"),
        F.array_join(n["line"].cast("array<string>"), ",").alias("lines"),
        F.round(F.coalesce(F.array_max(n["dice"]), F.lit(0.0)), 6).alias("best_dice"),
    )


def _sql_list(items: list[str]) -> str:
    return "[" + ",".join("'" + s.replace("'", "''") + "'" for s in items) + "]"


def oracle() -> str:
    """DuckDB SQL of op9_license_scan for texts whose notices fill a line each: TEMPLATES against unnested lines.

    Windows across lines and clauses are compared with a search by brute force in tests/llm, over whole tables.
    """
    sets = template_bigrams()
    values = ",".join(f"('{name}',{_sql_list(pairs)},CAST({_sql_list(required(t))} AS VARCHAR[]))" for (name, pairs), (_, t) in zip(sets, TEMPLATES))
    return rf"""
WITH tpl(license, pairs, must) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, unnest(ls) AS s, unnest(range(1, len(ls) + 1)) AS line FROM d),
w AS (SELECT rid, line, list_filter(string_split(regexp_replace(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '\.([^0-9]|$)', ' \1', 'g'), '[^a-z0-9.]', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM l),
b AS (SELECT rid, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bs FROM w WHERE len(ws) >= 2),
s AS (SELECT rid, line, license, 2.0 * len(list_intersect(bs, pairs)) / (len(bs) + len(pairs)) AS dice, len(list_intersect(bs, pairs)) AS n FROM b, tpl
      WHERE len(bs) >= len(pairs) * {THRESHOLD} / {2 - THRESHOLD} AND len(bs) <= len(pairs) * {2 - THRESHOLD} / {THRESHOLD} AND list_has_all(bs, must)),
m AS (SELECT rid, line, license, dice, n FROM s WHERE dice >= {THRESHOLD}),
one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY rid, line ORDER BY dice DESC, n DESC, license) = 1),
g AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
      string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines, max(dice) AS dice FROM one GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(licenses, '') AS licenses, coalesce(lines, '') AS lines,
       round(coalesce(dice, 0.0), 6) AS best_dice
FROM d LEFT JOIN g USING (rid)"""
