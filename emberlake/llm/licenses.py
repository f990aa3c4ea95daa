"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The units of a text are its lines, its paragraphs (runs of lines without one that has no letter or digit, so comment
marks alone part them), its sentences one to three at a time, and the whole of it. A unit and a template with a and b
bigrams have a coefficient of 2 min(a, b) / (a + b) at most, so only units whose size lies within bounds are compared.
Before that, a unit must hold an anchor: a few words of each template that over a third of its bigrams hang on. Without
any of them a coefficient of 0.8 is out of reach, so no match is lost, and long prose is put aside by one search.

The templates are a fixed short list, held as literals in one projection; there is no shuffle and no user function.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import let

LEAST = 0.8
#: Licences whose notices come within so much of the best one for a unit are named with it: the unit doesn't tell them apart.
MARGIN = 0.02

#: Notices by SPDX name (fixed values: the licences' own words).
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0-only": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": ["Released under the Zero-Clause BSD License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved."],
}


def _plain_words(text: str) -> list[str]:
    low = "".join(c if c.isascii() and c.isalnum() else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return low.split()


def template_bigrams(templates: Mapping[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """(licence, number of the notice, its different word bigrams), in the order of the table."""
    out = []
    for name, notices in templates.items():
        for k, notice in enumerate(notices):
            w = _plain_words(notice)
            if len(w) < 2:
                raise ValueError(f"{name}: a template has two words at least")
            out.append((name, k, list(dict.fromkeys(map(" ".join, zip(w, w[1:], strict=False))))))
    return out


def anchors(templates: Mapping[str, list[str]], least: float) -> list[str]:
    """Words of which every unit that matches a template holds one, as part of a longer word or not.

    Of a template with b bigrams, c of them with anchors, a unit without an anchor shares b - c at most, and has at least as
    many itself: its coefficient is under ``least`` if 2 (b - c) / (2 b - c) is. Words that many templates need come first.
    """
    left = {(name, k): list(grams) for name, k, grams in template_bigrams(templates)}
    size, chosen = {t: len(grams) for t, grams in left.items()}, []
    while open_ := [t for t in left if 2 * len(left[t]) >= least * (size[t] + len(left[t]))]:
        # long words are rare in other texts; short ones only where nothing else is left
        rare = lambda word: len(word) ** 2 if len(word) > 4 else 1e-3
        words = sorted({word for t in open_ for gram in left[t] for word in gram.split(" ")})
        chosen.append(max(words, key=lambda word: rare(word) * sum(1 / size[t] for t in open_ for gram in left[t] if word in gram)))
        left = {t: [gram for gram in grams if chosen[-1] not in gram] for t, grams in left.items()}
    return chosen


def _unit_words(unit: Column) -> Column:
    """Lower-case runs of a-z and 0-9; the text is cut to nothing else first. Only A-Z are lowered."""
    low = F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, "[^a-z0-9]+"), "")


#: What parts paragraphs and sentences; a window holds so many sentences at most.
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"
SENTENCE = r"[.!?:;][^A-Za-z0-9\x20\x09-\x0D]*[\x20\x09-\x0D]+"
SENTENCES = 3


def notices(text: Column, templates: Mapping[str, list[str]], least: float) -> Column:
    """An array of structs (dice, size, license, unit) for the units of a text that match a template by ``least`` or more."""
    known = template_bigrams(templates)
    sizes = [len(b) for *_, b in known]
    low, high = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
    hold = anchors(templates, least)

    def best(unit: Column) -> Column:
        def compared(b: Column) -> Column:
            n = F.size(b)
            hits = [
                F.when(n.between(size * least / (2 - least), size * (2 - least) / least), F.struct((2 * F.size(F.array_intersect(b, F.array(*map(F.lit, grams)))) / (n + size)).alias("dice"), F.lit(name).alias("license")))
                for (name, _, grams), size in zip(known, sizes, strict=True)
            ]
            return let(F.filter(F.array(*hits), lambda x: x["dice"] >= least), lambda hits: named(hits, n))

        def named(hits: Column, n: Column) -> Column:
            close = lambda top: F.transform(F.filter(hits, lambda x: x["dice"] >= top - MARGIN), lambda x: x["license"])
            one = lambda top: F.struct(top.alias("dice"), n.alias("size"), F.array_join(F.array_sort(F.array_distinct(close(top))), "/").alias("license"), unit.alias("unit"))
            return F.when(F.size(hits) > 0, let(F.array_max(hits)["dice"], one))

        def bigrams(w: Column) -> Column:
            return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

        # repeats of a bigram can hide in a long unit, so words bound bigrams from above only
        return let(_unit_words(unit), lambda w: F.when(F.size(w) >= max(2, low + 1), let(bigrams(w), lambda b: F.when(F.size(b) <= high, compared(b)))))

    def windows(s: Column) -> list[Column]:
        of = lambda k: F.transform(s, lambda _, i: F.array_join(F.slice(s, i + 1, F.lit(k)), " "))
        return [of(k) for k in range(2, SENTENCES + 1)]

    def found(t: Column) -> Column:
        units = let(F.split(t, SENTENCE), lambda s: F.concat(F.split(t, "\n"), F.split(t, PARAGRAPH), s, *windows(s), F.array(t)))
        able = F.array_distinct(F.filter(units, lambda u: u.rlike("(?i)" + "|".join(hold))))
        return F.filter(F.transform(able, best), lambda x: x.isNotNull())

    none = F.array().cast("array<struct<dice:double,size:int,license:string,unit:string>>")
    anchored = lambda t: let(F.lower(t), lambda x: functools.reduce(Column.__or__, (F.contains(x, F.lit(word)) for word in hold)))
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: F.when(anchored(t), found(t)).otherwise(none))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row for each row of ``docs``: (id, license, dice, n_notices, unit) of the best match, nulls without one.

    ``license`` names all licences within MARGIN of the best match of the unit, parted by "/": BSD-2-Clause/BSD-3-Clause for
    an opening that both have. Of equal coefficients the unit of most bigrams, then the greatest name and unit, counts. ``n_notices`` is the
    number of different units that match. Null and empty texts match nothing, and bytes that are not UTF-8 part words; rows
    with null or repeated ids are scanned one by one; an empty table gives none. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), notices(F.col(text_col), templates, least).alias("found"))
    return rows.select("id", F.size("found").cast("long").alias("n_notices"), F.array_max("found").alias("top")).select("id", F.col("top.license").alias("license"), F.round("top.dice", 6).alias("dice"), "n_notices", F.col("top.unit").alias("unit"))
