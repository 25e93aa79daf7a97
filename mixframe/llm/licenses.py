"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, letters and
digits, single blanks) and looked up among known licence sentences. What is
left of a text is a short sequence of sentence identifiers. Some known sentences
have slots for names and versions; they are patterns. Sentences that only name
licences, and SPDX expressions, give one identifier per licence named. Ordered rules are
matched against it: a rule names identifiers that follow one another, other
known sentences between them allowed; when it matches, they are used up, so
that a longer rule (three clauses) comes before the shorter one it contains.

Where a sentence ends is not certain: a line break may be an end or a blank, and
known sentences run across ``:`` and ``;``. So a text is cut in several ways,
and the sequence holds what any of them finds, by where it begins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of notices that name one, normalised.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_name": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_terms": "this project is licensed under the terms of the mit license",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_licensed": "licensed under the bsd license",
    "apache_name": "licensed under the apache license version 2.0",
    "apache_header": "licensed under the apache license version 2.0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache_copy_at": "you may obtain a copy of the license at",
    "apache_url": "http www.apache.org licenses license 2.0",
    "apache_urls": "https www.apache.org licenses license 2.0",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "gpl3_name": "this work is licensed under the gnu general public license version 3",
    "gpl3_licensed": "licensed under the gnu general public license version 3",
    "gpl2_name": "this work is licensed under the gnu general public license version 2",
    "gpl2_licensed": "licensed under the gnu general public license version 2",
    "lgpl3_name": "licensed under the gnu lesser general public license version 3",
    "agpl3_name": "licensed under the gnu affero general public license version 3",
    "mpl_name": "this source code form is subject to the terms of the mozilla public license v",
    "ccby_name": "licensed under cc by 4.0",
    "ccbysa_name": "licensed under cc by sa 4.0",
    "ccbync_name": "licensed under cc by nc 4.0",
    "ccby_work": "this work is licensed under a creative commons attribution 4.0 international license",
    "ccbysa_work": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "ccbync_work": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "cc0_name": "licensed under cc0 1.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
    "isc_grant_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit0_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "ncsa_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "postgres_grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "wtfpl_copy": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "mpl_1_1": "the contents of this file are subject to the mozilla public license version 1.1 the license",
    "cddl": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "lgpl_see": "see the gnu lesser general public license for more details",
    "agpl_see": "see the gnu affero general public license for more details",
}
# Public identifiers of licences, and names that notices give them, normalised.
NAMES = {
    "0BSD": ("bsd zero clause license", "zero clause bsd license"),
    "AFL-3.0": ("academic free license version 3.0",),
    "Apache-1.1": ("apache software license version 1.1",),
    "Apache-2.0": ("apache license", "apache license 2.0", "apache license v2.0", "apache license version 2.0", "apache 2.0 license", "apache 2 license", "apache 2.0", "apache v2", "asl 2.0"),
    "APSL-2.0": ("apple public source license version 2.0",),
    "Artistic-1.0": ("artistic license 1.0",),
    "Artistic-2.0": ("artistic license 2.0", "artistic license version 2.0"),
    "BSD-1-Clause": ("1 clause bsd license", "bsd 1 clause license"),
    "BSD-2-Clause": ("2 clause bsd license", "bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("3 clause bsd license", "bsd 3 clause license", "new bsd license", "revised bsd license", "modified bsd license"),
    "BSD-4-Clause": ("4 clause bsd license", "bsd 4 clause license", "original bsd license"),
    "BSL-1.0": ("boost software license", "boost software license 1.0", "boost software license version 1.0"),
    "BUSL-1.1": ("business source license 1.1",),
    "CC-BY-3.0": ("cc by 3.0", "creative commons attribution 3.0 unported license"),
    "CC-BY-4.0": ("creative commons attribution 4.0 international license",),
    "CC-BY-NC-4.0": ("creative commons attribution noncommercial 4.0 international license",),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0", "creative commons attribution noncommercial noderivatives 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0", "creative commons attribution noncommercial sharealike 4.0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"),
    "CC-BY-SA-3.0": ("cc by sa 3.0", "creative commons attribution sharealike 3.0 unported license"),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4.0 international license",),
    "CC0-1.0": ("cc0", "cc0 1.0 universal"),
    "CDDL-1.0": ("common development and distribution license version 1.0", "cddl 1.0"),
    "CDDL-1.1": ("cddl 1.1",),
    "CECILL-2.1": ("cecill license version 2.1",),
    "ECL-2.0": ("educational community license version 2.0",),
    "EPL-1.0": ("eclipse public license v1.0", "eclipse public license 1.0"),
    "EPL-2.0": ("eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license v 2.0"),
    "EUPL-1.2": ("eupl", "eupl version 1.2", "european union public licence version 1.2"),
    "HPND": (),
    "ISC": ("isc license", "isc licence"),
    "JSON": ("json license",),
    "MIT": ("mit license", "mit licence", "mit", "expat license", "mit license mit"),
    "MIT-0": ("mit no attribution license", "mit 0 license"),
    "MPL-1.1": ("mozilla public license version 1.1", "mpl 1.1"),
    "MPL-2.0": ("mozilla public license 2.0", "mozilla public license version 2.0", "mozilla public license v2.0", "mpl 2.0"),
    "MS-PL": ("microsoft public license", "ms pl"),
    "MS-RL": ("microsoft reciprocal license",),
    "NCSA": ("university of illinois ncsa open source license",),
    "ODbL-1.0": ("open database license", "odbl"),
    "OFL-1.1": ("sil open font license", "sil open font license 1.1", "sil open font license version 1.1"),
    "OSL-3.0": ("open software license version 3.0",),
    "PostgreSQL": ("postgresql license",),
    "PSF-2.0": ("python software foundation license", "python software foundation license version 2", "psf license"),
    "Python-2.0": (),
    "Ruby": ("ruby license",),
    "SSPL-1.0": ("server side public license", "server side public license version 1"),
    "Unicode-3.0": ("unicode license v3",),
    "Unlicense": ("unlicense",),
    "UPL-1.0": ("universal permissive license v1.0", "universal permissive license v 1.0"),
    "Vim": ("vim license",),
    "W3C": ("w3c software notice and license",),
    "WTFPL": ("wtfpl", "do what the fuck you want to public license"),
    "X11": ("x11 license",),
    "Zlib": ("zlib license", "zlib libpng license"),
    "ZPL-2.1": ("zope public license version 2.1", "zope public license version 2.1 zpl"),
}
# The licences of the GNU project, their full names and versions.
GNU = {
    "GPL": (("general public license",), ("1.0", "2.0", "3.0")),
    "LGPL": (("lesser general public license", "library general public license"), ("2.0", "2.1", "3.0")),
    "AGPL": (("affero general public license",), ("1.0", "3.0")),
}
WHO = r"(?:this (?:\S+ ){1,4}?|(?:(?!this )\S+ ){1,6}?)"
# Known sentences with slots, as patterns of the whole normalised sentence.
SLOTS = {
    "bsd_name": r"(?:neither the names? of .*|nor the names? .*)(?:endorse|promote) .*permission(?: .*)?|the names? of .* (?:may|must|shall) not be used to (?:endorse|promote) .*",
    "bsd_ad": r"all advertising materials mentioning features or use of this software must display the following acknowledge?ments?(?: .*)?",
    "bsd_source": r"redistributions of source code must retain the (?:above )?copyright notice (?:immediately at the beginning of the file without modification )?this list of conditions and the following disclaimers?(?: .*)?",
    "bsd_binary": r"redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimers?(?: in .*)?",
    "isc_as_is": r"the software is provided as is and .* disclaims? all warranties with regard to this software including all implied warranties of merchantability and fitness(?: .*)?",
    "x11_name": r"except as contained in this notice the names? of .* shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without (?:specific )?prior written authorization(?: .*)?",
    "cc0_waiver": r"to the extent possible under law .* (?:dedicated|waived) all copyright and related (?:and|or) neighboring rights to .*",
    "epl1_materials": r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1.0(?: .*)?",
    "epl2_materials": r"this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?2.0(?: .*)?",
    "ofl_font": r"this font software is licensed under the sil open font license version 1.1(?: .*)?",
}


def _gnu() -> tuple[dict[str, tuple[str, ...]], dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifiers of the GNU licences, the patterns of their notices, and the rules of these."""
    names, slots, rules = {}, {}, []
    for short, (called, versions) in GNU.items():
        for v in versions:
            number = re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") else "")
            start = f"{WHO}is (?:a )?free software you can redistribute it and or modify it under the terms of "
            licence = f"the gnu (?:{'|'.join(called)})"
            published = "as published by the free software foundation"
            later = "or at your option any later version"
            only = f"{start}{licence} (?:version |v){number} {published}|{start}{licence} {published} version {number}(?: of the license)?"
            slots[f"{short.lower()}{v}_only"] = f"{only}|{start}version {number} of {licence} {published}"
            slots[f"{short.lower()}{v}_later"] = (
                f"{start}{licence} {published} either version {number} of the license {later}"
                f"|{start}{licence} {published} version {number} of the license {later}"
                f"|{start}{licence} (?:version |v){number} {published} {later}"
            )
            for kind in ("only", "later"):
                spdx = f"{short}-{v}-" + {"only": "only", "later": "or-later"}[kind]
                names[spdx] = ()
                rules.append((spdx, (f"{short.lower()}{v}_{kind}",)))
    return names, slots, rules


def _named() -> dict[str, str]:
    """What a notice or an SPDX expression calls a licence, in lower case, and its identifier."""
    out = {}
    for spdx, names in NAMES.items():
        for n in (spdx.lower(), *names):
            out[n] = spdx
    for short, (kinds, versions) in GNU.items():
        for v in versions:
            # the plain identifier and "+" are the older spelling
            for form, spdx in (("", "only"), ("-only", "only"), ("+", "or-later"), ("-or-later", "or-later")):
                out[f"{short}-{v}{form}".lower()] = f"{short}-{v}-{spdx}"
            for n in {v, v.removesuffix(".0")}:
                for called in (short.lower(), f"gnu {short.lower()}", *(f"gnu {k}" for k in kinds)):
                    for mark in (" ", " v", " version "):
                        out[f"{called}{mark}{n}"] = f"{short}-{v}-only"
                        out[f"{called}{mark}{n} only"] = f"{short}-{v}-only"
                        out[f"{called}{mark}{n} or later"] = f"{short}-{v}-or-later"
                        out[f"{called}{mark}{n} or any later version"] = f"{short}-{v}-or-later"
    return out


GNU_NAMES, GNU_SLOTS, GNU_RULES = _gnu()
NAMES |= GNU_NAMES
SLOTS |= GNU_SLOTS
NAMED = _named()
#: Sentences that only name licences; the first group is what they name.
NOTICE = (
    r"^(?:(?:this|the|our) (?:\S+ ){0,3}?(?:is|are) )?(?:dual )?(?:licensed|released|distributed|(?:made )?available) under "
    r"(?:either (?:of )?)?(?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?(.{2,150}?)"
    r"(?: (?:see|at your option|which is available at) ?.*)?$"
)
#: A sentence without any of these has no slots and names no licence in passing.
CUES = r"endorse|promote|all advertising|^redistributions|disclaim|free software|^except as|neighboring|accompanying materials|font software|(?:licensed|released|distributed|available) under "
SPDX_TAG = r"(?i)SPDX-License-Identifier:"
ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
EXPRESSION = rf"^[ \t]*({ID}(?:[ \t]+(?i:and|or|with)[ \t]+{ID})*)"
# Rules in order; identifiers of a rule follow one another.
RULES = (
    ("X11", ("mit_grant", "mit_notice", "mit_as_is", "x11_name")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_name",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_terms",)),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_grant_and",)),
    ("0BSD", ("zero_grant",)),
    ("MIT-0", ("mit0_grant", "mit_as_is")),
    ("NCSA", ("ncsa_grant",)),
    ("BSL-1.0", ("boost_grant",)),
    ("Zlib", ("zlib_grant",)),
    ("PostgreSQL", ("postgres_grant",)),
    ("WTFPL", ("wtfpl_copy",)),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_ad", "bsd_name")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_ad")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD", ("bsd_licensed",)),
    ("Apache-2.0", ("apache_header", "apache_use", "apache_copy", "apache_as_is")),
    ("Apache-2.0", ("apache_header", "apache_use", "apache_copy_at", "apache_url", "apache_as_is")),
    ("Apache-2.0", ("apache_header", "apache_use", "apache_copy_at", "apache_urls", "apache_as_is")),
    ("Apache-2.0", ("apache_header",)),
    ("Apache-2.0", ("apache_name",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_see")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-3.0-only", ("gpl3_name",)),
    ("GPL-3.0-only", ("gpl3_licensed",)),
    ("GPL-2.0-only", ("gpl2_name",)),
    ("GPL-2.0-only", ("gpl2_licensed",)),
    ("LGPL-3.0-only", ("lgpl3_name",)),
    ("AGPL-3.0-only", ("agpl3_name",)),
    ("MPL-2.0", ("mpl_name",)),
    ("MPL-1.1", ("mpl_1_1",)),
    ("CDDL-1.0", ("cddl",)),
    ("EPL-1.0", ("epl1_materials",)),
    ("EPL-2.0", ("epl2_materials",)),
    ("OFL-1.1", ("ofl_font",)),
    ("CC0-1.0", ("cc0_waiver",)),
    ("CC-BY-SA-4.0", ("ccbysa_name",)),
    ("CC-BY-NC-4.0", ("ccbync_name",)),
    ("CC-BY-4.0", ("ccby_name",)),
    ("CC-BY-SA-4.0", ("ccbysa_work",)),
    ("CC-BY-NC-4.0", ("ccbync_work",)),
    ("CC-BY-4.0", ("ccby_work",)),
    ("CC0-1.0", ("cc0_name",)),
    ("Unlicense", ("unlicense",)),
    *GNU_RULES,
)
#: Marks, with and without those inside known sentences, and breaks that end a sentence:
#: each line, lines without letters and digits, none.
MARKS = (r"[.!?;:]+(?:\s+|$)", r"[.!?]+(?:\s+|$)")
BREAKS = (r"|\n+", r"|\n[^\p{L}\p{N}]*\n", "")
ENDS = tuple(m + b for m in MARKS for b in BREAKS)
NOISE = r"[^\p{L}\p{N}.]+"
#: Stands behind each end, so that positions outlast the cut.
CUT = "\x01"
#: Identifiers are single characters from here on while rules are matched.
FIRST_CODE = 0xE000
#: More than there are identifiers.
KINDS = 1 << 16


def triggers(sentences: dict[str, str]) -> list[str]:
    """Words such that every known sentence holds one; texts without any are
    not cut up. Greedy: the word that most of the remaining sentences hold."""
    left, out = [set(s.split()) for s in sentences.values()], []
    while left:
        counts: dict[str, int] = {}
        for s in left:
            for w in s:
                # a longer word first: it lets fewer texts pass
                counts[w] = counts.get(w, 0) + 1
        best = max(counts, key=lambda w: (counts[w] * len(w) ** 2, w))
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def pattern(codes: str) -> str:
    """The codes of a rule in order, the gaps between them as groups. A gap holds
    no code like the one before it, so that matches are short."""
    return "".join(f"{a}([^{a}]*?)" for a in codes[:-1]) + codes[-1]


def known_as(sentences: dict[str, str], slots: dict[str, str]) -> list[str]:
    """All identifiers: those of sentences and patterns, and one per licence that can be named."""
    return list(dict.fromkeys([*sentences, *slots, *(f"license:{x}" for x in NAMES)]))


def _place(at: Column, k: Column) -> Column:
    """Position and identifier in one number: distinct numbers are found by hash, structs pair by pair."""
    return at.cast("bigint") * KINDS + k


def _map(pairs: dict) -> Column:
    """A constant map of strings: one literal in the plan. Keys hold no ``:`` or ``,``."""
    return F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in pairs.items())), F.lit(","), F.lit(":"))


def occurrences(text: Column, ends: str, sentences: dict[str, str], slots: dict[str, str]) -> Column:
    """Known sentences of a text, in order: for each ``_place`` of the position of
    its first letter or digit and its number in ``known_as``, from 1."""
    place = {x: k for k, x in enumerate(known_as(sentences, slots), 1)}
    known = _map({s: place[x] for x, s in sentences.items()})
    named = _map({n: place[f"license:{x}"] for n, x in NAMED.items()})
    patterns = F.array(*[F.struct(F.lit(f"^(?:{p})$").alias("p"), F.lit(place[x]).alias("k")) for x, p in slots.items()])
    nothing = F.array().cast("array<int>")

    def normal(part: Column) -> Column:
        return F.trim(F.regexp_replace(F.rtrim(F.regexp_replace(F.lower(part), NOISE, " ")), r"^[. ]*[0-9]{1,2} |[. ]+$", ""))

    def names(n: Column) -> Column:
        what = F.regexp_extract(n, NOTICE, 1)
        whole = F.try_element_at(named, what).cast("int")
        each = F.transform(
            F.split(what, " (?:and|or) (?:the )?"), lambda x: F.coalesce(F.try_element_at(named, x).cast("int"), F.lit(0))
        )
        several = F.when(F.forall(each, lambda k: k > 0), each).otherwise(nothing)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(several)

    def others(n: Column) -> Column:
        fits = F.transform(F.filter(patterns, lambda x: F.regexp(n, x["p"])), lambda x: x["k"])
        return F.when(F.size(fits) > 0, F.slice(fits, 1, 1)).otherwise(names(n))

    def found(n: Column) -> Column:
        k = F.try_element_at(known, n).cast("int")
        return F.when(k.isNotNull(), F.array(k)).when(n.rlike(CUES), others(n)).otherwise(nothing)

    def step(state: Column, part: Column) -> Column:
        after = state["pos"] + F.length(part["s"])
        at = after - F.length(F.regexp_replace(part["s"], r"^[^\p{L}\p{N}]+", ""))
        more = F.concat(state["found"], F.transform(part["ks"], lambda k: _place(at, k)))
        more = F.when(F.size(part["ks"]) > 0, more).otherwise(state["found"])
        return F.struct(after.alias("pos"), more.alias("found"))

    cut = F.split(F.regexp_replace(F.translate(text, CUT, " "), ends, "$0" + CUT), CUT)
    parts = F.transform(cut, lambda s: F.struct(s.alias("s"), normal(s).alias("n")))
    parts = F.transform(parts, lambda x: F.struct(x["s"].alias("s"), found(x["n"]).alias("ks")))
    none = F.array().cast("array<bigint>")
    return F.aggregate(parts, F.struct(F.lit(0).alias("pos"), none.alias("found")), step, lambda state: state["found"])


def expressions(text: Column, sentences: dict[str, str], slots: dict[str, str]) -> Column:
    """Licences of SPDX expressions, as ``occurrences``. An exception (``WITH``)
    is no licence; identifiers that are not known are left out."""
    place = {x: k for k, x in enumerate(known_as(sentences, slots), 1)}
    named = _map({n: place[f"license:{x}"] for n, x in NAMED.items()})
    none = F.array().cast("array<bigint>")

    def licences(part: Column) -> Column:
        plain = F.regexp_replace(F.regexp_extract(part, EXPRESSION, 1), rf"(?i)[ \t]+with[ \t]+{ID}|[()]|\.+$", "")
        ks = F.transform(F.split(plain, r"(?i)[ \t]+(?:and|or)[ \t]+"), lambda x: F.try_element_at(named, F.lower(x)).cast("int"))
        return F.filter(ks, lambda k: k.isNotNull())

    def step(state: Column, part: Column) -> Column:
        ks = F.when(state["pos"] >= 0, licences(part)).otherwise(F.array().cast("array<int>"))
        # an identifier follows its neighbour by one position or more
        places = F.transform(ks, lambda k, i: _place(state["pos"] + i, k))
        after = F.greatest(state["pos"], F.lit(0)) + F.length(part) + len("SPDX-License-Identifier:")
        return F.struct(after.alias("pos"), F.concat(state["found"], places).alias("found"))

    start = F.struct(F.lit(-1).alias("pos"), none.alias("found"))
    return F.aggregate(F.split(text, SPDX_TAG), start, step, lambda state: state["found"])


def scan_licenses(
    docs: DataFrame, sentences: dict[str, str] | None = None, rules=RULES, slots: dict[str, str] | None = None
) -> DataFrame:
    """Licences that the texts of ``docs`` (``doc_id``, ``text``) state.

    Returns per row ``doc_id``, ``n_sentences`` (known sentences found),
    ``sentence_ids`` (in order, blank between), ``licenses`` (those of the
    rules that match, each once, in rule order, joined by commas, then those
    that are only named) and ``license`` (the first of them, null if none).
    Sentences end at ``.!?`` and, in one reading of two, ``:;`` before white
    space; each is done with line breaks as ends, with empty lines as ends, and
    with both as blanks. A sentence counts once, whichever readings find it; a
    number before it is no part of it. ``slots`` are patterns of sentences with
    names or versions in them; of two identifiers with one name the plain
    sentence is tried first. Licences named after ``licensed under`` and in SPDX
    expressions count as ``license:`` and their identifier. A null text counts
    as empty; repeated rows stay; an empty table gives an empty result; other
    columns are ignored.
    """
    sentences = SENTENCES if sentences is None else sentences
    slots = SLOTS if slots is None else slots
    low = F.lower("text")
    some = low.rlike(r"licensed|released|distributed|available") & low.contains("under")
    for word in [*triggers(sentences), "endorse", "redistribut", "disclaim", "free software", "neighboring", "advertising"]:
        some = some | low.contains(word)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    none = F.array().cast("array<bigint>")
    readings = F.concat(*[occurrences(F.col("text"), e, sentences, slots) for e in ENDS])
    tags = F.when(low.contains("spdx-license-identifier:"), expressions(F.col("text"), sentences, slots)).otherwise(none)
    seen = F.sort_array(F.array_distinct(F.concat(F.when(some, readings).otherwise(none), tags)))
    places = F.transform(seen, lambda x: (x % KINDS).cast("int"))
    state = rows.select("doc_id", F.coalesce(places, F.array().cast("array<int>")).alias("ks"))

    every = known_as(sentences, slots)
    ids = F.array(*[F.lit(k) for k in every])
    code = {k: chr(FIRST_CODE + i) for i, k in enumerate(every)}
    codes = F.array(*[F.lit(c) for c in code.values()])
    steps = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(pattern("".join(code[k] for k in rule))).alias("pattern"),
                F.lit("".join(f"${g}" for g in range(1, len(rule)))).alias("gaps"),
            )
            for i, (_, rule) in enumerate(rules)
        ]
    )

    def apply(state: Column, rule: Column) -> Column:
        left = F.regexp_replace(state["left"], rule["pattern"], rule["gaps"])
        hit = left != state["left"]
        return F.struct(
            left.alias("left"),
            F.when(hit, F.concat(state["hits"], F.array(rule["i"]))).otherwise(state["hits"]).alias("hits"),
        )

    coded = F.array_join(F.transform("ks", lambda k: F.element_at(codes, k)), "")
    start = F.struct(coded.alias("left"), F.array().cast("array<int>").alias("hits"))
    hits = F.aggregate(steps, start, apply, lambda state: state["hits"])
    names = F.array(*[F.lit(name) for name, _ in rules])
    named = F.array(*[F.lit(k.removeprefix("license:") if k.startswith("license:") else None) for k in every])
    # no rule of several sentences holds these, so they need no matching
    plain = F.array_sort(F.filter(F.transform("ks", lambda k: F.element_at(named, k)), lambda x: x.isNotNull()))
    matched = F.array_distinct(F.concat(F.transform(hits, lambda i: F.element_at(names, i + 1)), plain))
    found = F.when(F.size("ks") == 0, F.array().cast("array<string>")).otherwise(matched)
    out = state.select("doc_id", "ks", found.alias("found"))
    return out.select(
        "doc_id",
        F.size("ks").cast("bigint").alias("n_sentences"),
        F.array_join(F.transform("ks", lambda k: F.element_at(ids, k)), " ").alias("sentence_ids"),
        F.array_join("found", ",").alias("licenses"),
        F.when(F.size("found") > 0, F.try_element_at("found", F.lit(1))).alias("license"),
    )
