"""Licence scan by sentence rules.

A text is cut into sentences at blank lines and behind ``.``, ``!``, ``?`` or ``;`` before white space, and
normalised (lower case, letters and digits, single blanks; so comment marks go, and a line of nothing
else is blank). A single line end may part sentences or lie within one: a known licence sentence, from
one cut or line end to another, is found on a line of its own and wrapped over lines alike, the leftmost
and longest first, and is mapped to its identifier; runs of anything else become one ``?``. The SQL twin
cuts at every line end, so it agrees where no known sentence is wrapped. The sequence of identifiers is then
read by ordered rules: a rule whose identifiers stand next to each other names its licence and
takes them out, so longer rules come before those of their parts.

Texts without any of the trigger words in normal form, which every known sentence has one of, are not cut. NULL,
empty and other texts without known sentences have an empty sequence and no licence. Every row is
judged on its own, as a whole text; repeated rows alike.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import col

# Well-known licence sentences in normal form, by identifier.
SENTENCES = {
    "ApacheRef": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "spdx license identifier apache 2 0"],
    "ApacheUse": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "MITRef": ["released under the mit license", "licensed under the mit license", "spdx license identifier mit", "this project is licensed under the mit license"],
    "MITGrant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "MITNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AsIs": [
        "the software is provided as is without warranty of any kind",
        "this software is provided as is without warranty of any kind",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement",
        *[
            f"this software is provided by the {who} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
            "fitness for a particular purpose are disclaimed"
            for who in ("copyright holders and contributors", "copyright holder and contributors", "regents and contributors", "author and contributors", "author", "authors")
        ],
    ],
    "BSDGrant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ],
    "BSDRef": ["licensed under the bsd license", "licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "GPL2Ref": ["this work is licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only", *[
        f"{free}you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"
        for free in ("", "this program is free software ")
    ]],
    "GPL3Ref": ["this work is licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "GPLFree": ["this program is free software"],
    "GPLGrant2": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the "
        "license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license or at your option any later version",
    ],
    "GPLGrant3": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
    ],
    "GPLTerms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "GPLEither2": ["either version 2 of the license or at your option any later version"],
    "GPLEither3": ["either version 3 of the license or at your option any later version"],
    "CCBY4": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CCBYSA4": ["licensed under cc by sa 4 0"],
    "CCBYNC4": ["licensed under cc by nc 4 0"],
    "CC0": ["licensed under cc0 1 0", "dedicated to the public domain"],
    "AllRights": ["all rights reserved"],
}
# Sentences of further licence texts and headers.
SENTENCES |= {
    "BSDSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSDBinary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution"
    ],
    "BSDName": [
        f"neither the name of the {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for who in ("copyright holder", "author", "organization", "project", "university")
    ],
    "ISCGrant": [
        f"permission to use copy modify and {how}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies"
        for how in ("or ", "")
    ],
    "ZeroBSDGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "UnlicenseGrant": ["this is free and unencumbered software released into the public domain"],
    "ZlibGrant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    ],
    "BoostGrant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use "
        "reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all "
        "subject to the following"
    ],
    "WTFPLGrant": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "OFLGrant": ["this font software is licensed under the sil open font license version 1 1"],
    # behind "v." a sentence ends
    "MPL2Header": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "Either21": ["either version 2 1 of the license or at your option any later version"],
}
# Licences by SPDX identifier, their kind, and what they are called before the word licence.
NAMED = [
    ("MIT", "permissive", ["mit"]), ("MIT-0", "permissive", ["mit 0", "mit no attribution"]), ("X11", "permissive", ["x11"]), ("ISC", "permissive", ["isc"]), ("0BSD", "permissive", ["0bsd", "bsd zero clause"]),
    ("BSD-2-Clause", "permissive", ["bsd 2 clause", "2 clause bsd", "simplified bsd"]), ("BSD-3-Clause", "permissive", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"]),
    ("BSD-4-Clause", "permissive", ["bsd 4 clause", "original bsd"]), ("Apache-2.0", "permissive", ["apache 2 0", "apache 2", "apache"]), ("Apache-1.1", "permissive", ["apache 1 1"]),
    ("Zlib", "permissive", ["zlib"]), ("Unlicense", "permissive", ["unlicense"]), ("WTFPL", "permissive", ["wtfpl"]), ("BSL-1.0", "permissive", ["boost software", "boost"]), ("NCSA", "permissive", ["ncsa"]),
    ("PostgreSQL", "permissive", ["postgresql"]), ("Python-2.0", "permissive", ["python software foundation", "psf"]), ("PHP-3.01", "permissive", ["php"]), ("Artistic-2.0", "permissive", ["artistic 2 0", "artistic"]),
    ("AFL-3.0", "permissive", ["academic free"]), ("ECL-2.0", "permissive", ["educational community"]), ("MS-PL", "permissive", ["microsoft public"]), ("OFL-1.1", "permissive", ["sil open font"]),
    ("Vim", "permissive", ["vim"]), ("Ruby", "permissive", ["ruby"]), ("LPPL-1.3c", "permissive", ["latex project public"]), ("CC0-1.0", "permissive", ["cc0 1 0", "cc0"]),
    ("CC-BY-3.0", "permissive", ["cc by 3 0", "creative commons attribution 3 0"]), ("CC-BY-4.0", "permissive", ["cc by 4 0", "creative commons attribution 4 0"]),
    ("CC-BY-SA-3.0", "copyleft", ["cc by sa 3 0", "creative commons attribution sharealike 3 0"]), ("CC-BY-SA-4.0", "copyleft", ["cc by sa 4 0", "creative commons attribution sharealike 4 0"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc by nc 4 0"]), ("CC-BY-NC-SA-4.0", "noncommercial", ["cc by nc sa 4 0"]), ("CC-BY-ND-4.0", "reserved", ["cc by nd 4 0"]), ("CC-BY-NC-ND-4.0", "noncommercial", ["cc by nc nd 4 0"]),
    ("GPL-2.0-only", "copyleft", ["gpl 2 0", "gplv2"]), ("GPL-2.0-or-later", "copyleft", ["gplv2 or later"]), ("GPL-3.0-only", "copyleft", ["gpl 3 0", "gplv3"]), ("GPL-3.0-or-later", "copyleft", ["gplv3 or later"]),
    ("LGPL-2.0-only", "copyleft", ["lgpl 2 0"]), ("LGPL-2.0-or-later", "copyleft", []), ("LGPL-2.1-only", "copyleft", ["lgpl 2 1", "lgplv2 1"]), ("LGPL-2.1-or-later", "copyleft", []),
    ("LGPL-3.0-only", "copyleft", ["lgpl 3 0", "lgplv3"]), ("LGPL-3.0-or-later", "copyleft", []), ("AGPL-3.0-only", "copyleft", ["agpl 3 0", "agplv3"]), ("AGPL-3.0-or-later", "copyleft", []),
    ("MPL-1.1", "copyleft", ["mozilla public 1 1", "mpl 1 1"]), ("MPL-2.0", "copyleft", ["mozilla public 2 0", "mpl 2 0"]), ("EPL-1.0", "copyleft", ["eclipse public 1 0", "epl 1 0"]),
    ("EPL-2.0", "copyleft", ["eclipse public 2 0", "epl 2 0", "eclipse public"]), ("CDDL-1.0", "copyleft", ["cddl 1 0", "cddl"]), ("EUPL-1.2", "copyleft", ["european union public"]), ("OSL-3.0", "copyleft", ["open software"]),
    ("MS-RL", "copyleft", ["microsoft reciprocal"]), ("ODbL-1.0", "copyleft", ["open database"]), ("GFDL-1.3-only", "copyleft", ["gnu free documentation"]),
]
#: How a text says what it is licensed under.
LEADS = ["", "the ", "under the ", *[f"{what}{how} under the " for what in ("", "this file is ", "this project is ", "this software is ", "this work is ", "this code is ") for how in ("licensed", "released", "distributed")]]


def plain(name: str) -> str:
    """A name in the normal form of sentences."""
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def _references() -> tuple[dict[str, list[str]], list[tuple[str, str, str]]]:
    """Sentences and rules of the named licences: SPDX lines, and what a text says of its licence."""
    known, sentences, rules = {f for fs in SENTENCES.values() for f in fs}, {}, []
    for spdx, kind, names in NAMED:
        forms = [f"spdx license identifier {plain(spdx)}"]
        for name in names:
            short = name.replace(" ", "")
            forms += [f"{lead}{name} license" for lead in LEADS] + [f"the {name} license {name}", f"the {name} license {short}"]
        ident = "Ref" + re.sub("[^A-Za-z0-9]", "", spdx)
        sentences[ident] = list(dict.fromkeys(f for f in forms if f not in known))
        rules.append((ident, spdx, kind))
    return sentences, rules


def _gnu() -> tuple[dict[str, list[str]], list[tuple[str, str, str]]]:
    """The header of the lesser and the Affero licence, in parts at its semicolons or in one."""
    sentences: dict[str, list[str]] = {"LGPLFree": ["this library is free software"]}
    rules = []
    for short, name, versions in (("LGPL", "lesser", ("2.1", "3.0")), ("LGPLib", "library", ("2.0",)), ("AGPL", "affero", ("3.0",))):
        terms = f"you can redistribute it and or modify it under the terms of the gnu {name} general public license as published by the free software foundation"
        sentences[f"{short}Terms"] = [terms, f"this program is free software {terms}", f"this library is free software {terms}"]
        for version in versions:
            spdx = f"{short.removesuffix('ib')}-{version}-or-later"
            number = plain(version.removesuffix(".0"))
            ident = f"{short}Grant{number.replace(' ', '')}"
            sentences[ident] = [f"{free}{terms} either version {number} of the license or at your option any later version" for free in ("", "this program is free software ", "this library is free software ")]
            rules += [(f"{short}Terms,{'Either21' if version == '2.1' else 'GPLEither' + number}", spdx, "copyleft"), (ident, spdx, "copyleft")]
    return sentences, rules


_REFERENCES, _GNU = _references(), _gnu()
SENTENCES |= _GNU[0] | _REFERENCES[0]
#: Every known sentence has one of these words.
TRIGGERS = ["licens", "permi", "rights", "warrant", "redistribut", "free software", "public domain", "endorse", "either version"]
#: (identifiers that stand next to each other, licence, kind), in the order they are tried.
RULES = [
    ("ApacheRef,ApacheUse,ApacheCopy", "Apache-2.0", "permissive"),
    ("MITGrant,MITNotice,AsIs", "MIT", "permissive"),
    ("MITGrant,MITNotice", "MIT", "permissive"),
    *[(f"BSDGrant,{n}BSDSource,{n}BSDBinary,{last}", "BSD-3-Clause", "permissive") for n, last in (("?,", "?,BSDName"), ("", "BSDName"), ("?,", "?,AsIs"), ("", "?,AsIs"))],
    *[(f"BSDGrant,{n}BSDSource,{n}BSDBinary,AsIs", "BSD-2-Clause", "permissive") for n in ("?,", "")],
    ("BSDGrant,?,BSDSource,AsIs", "BSD", "permissive"),
    ("BSDGrant,AsIs", "BSD", "permissive"),
    ("BSDGrant,?,AsIs", "BSD", "permissive"),
    *_GNU[1],
    ("GPLFree,GPLTerms,GPLEither3", "GPL-3.0-or-later", "copyleft"),
    ("GPLFree,GPLTerms,GPLEither2", "GPL-2.0-or-later", "copyleft"),
    ("GPLFree,GPLGrant3", "GPL-3.0-or-later", "copyleft"),
    ("GPLFree,GPLGrant2", "GPL-2.0-or-later", "copyleft"),
    ("ApacheRef", "Apache-2.0", "permissive"),
    ("MITRef", "MIT", "permissive"),
    ("MITGrant", "MIT", "permissive"),
    ("BSDRef", "BSD-3-Clause", "permissive"),
    ("BSDGrant", "BSD", "permissive"),
    ("GPL3Ref", "GPL-3.0-only", "copyleft"),
    ("GPL2Ref", "GPL-2.0-only", "copyleft"),
    ("GPLGrant3", "GPL-3.0-or-later", "copyleft"),
    ("GPLGrant2", "GPL-2.0-or-later", "copyleft"),
    ("CCBYNC4", "CC-BY-NC-4.0", "noncommercial"),
    ("CCBYSA4", "CC-BY-SA-4.0", "copyleft"),
    ("CCBY4", "CC-BY-4.0", "permissive"),
    ("CC0", "CC0-1.0", "permissive"),
    ("ISCGrant", "ISC", "permissive"),
    ("ZeroBSDGrant", "0BSD", "permissive"),
    ("UnlicenseGrant", "Unlicense", "permissive"),
    ("ZlibGrant", "Zlib", "permissive"),
    ("BoostGrant", "BSL-1.0", "permissive"),
    ("WTFPLGrant", "WTFPL", "permissive"),
    ("OFLGrant", "OFL-1.1", "permissive"),
    ("MPL2Header", "MPL-2.0", "copyleft"),
    *_REFERENCES[1],
    ("AllRights", "LicenseRef-AllRightsReserved", "reserved"),
]
# Steps of normal form, on lower-cased text; H marks a cut and S a single line end, then | and a line end. An SPDX
# expression of up to four licences becomes a line for each; what follows a comma as "all rights reserved" is cut off.
SPDX = r"(spdx-license-identifier:)[ \t]*\(?([a-z0-9.+-]+)[ \t]+(?:or|and)[ \t]+\(?([a-z0-9.+-]+)\)?"
STEPS = [
    *[(SPDX, "$1 $2\n\n$1 $3")] * 3,
    (r",\s+(all rights reserved)", "\n\n$1"),
    (r"\n[^a-z0-9\n]+", "\n"),
    (r"\n\n+|(?<=[.!?;])\s+", "H"),
    (r"\n", "S"),
    (r"[^a-z0-9HS]+", " "),
    (r"[HS ]*H[HS ]*", "|"),
    (r" ?S[S ]*", "\n"),
]


def normal(low: Column) -> Column:
    """Words of a lower-cased text in normal form, with ``|`` at cuts and both ends and a line end at single ones."""
    out = F.concat(F.lit("\n"), low, F.lit("\n\n"))
    for pattern, put in STEPS:
        out = F.regexp_replace(out, pattern, put)
    return F.concat(F.lit("|"), F.trim(out), F.lit("|"))


def any_form(sentences: dict[str, list[str]]) -> str:
    """Pattern of all known sentences between cuts or line ends, longest first, wrapped anywhere."""
    forms = sorted((f for fs in sentences.values() for f in fs), key=len, reverse=True)
    return r"(?<=[|\n])(" + "|".join(f.replace(" ", r"[ \n]") for f in forms) + r")(?=[|\n])"


def identifier(sentence: Column, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """Identifier of a normalised sentence, ``?`` for others: a map from the hashes of the known forms."""
    by_form = F.create_map(*[x for name, forms in sentences.items() for f in forms for x in (F.lit(_hash(f)), F.lit(name))])
    return F.coalesce(F.try_element_at(by_form, F.md5(sentence)), F.lit("?"))


def _hash(form: str) -> str:
    return hashlib.md5(form.encode()).hexdigest()


def sequence(text: Column, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """Identifiers of a lower-cased text's sentences, runs of ``?`` as one; empty without a known one."""
    marked = F.regexp_replace(normal(text), any_form(sentences), "|<$1|")
    cut = F.filter(F.split(marked, r"\|"), lambda s: F.trim(s, F.lit("\n")) != "")
    names = F.transform(cut, lambda s: F.when(s.startswith("<"), identifier(F.translate(F.substring(s, 2, 1 << 30), "\n", " "), sentences)).otherwise("?"))
    joined = F.concat(F.lit(","), F.array_join(names, ","), F.lit(","))
    short = F.regexp_replace(joined, r",(?:\?,)+", ",?,")
    return F.when(short.rlike("[A-Za-z]"), short).otherwise(F.lit(""))


def read_rules(ids: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rest, found): the licences that the ordered rules find, and what of the sequence is left."""
    table = F.array(*[F.struct(F.lit(f",{s},").alias("ids"), F.struct(F.lit(n).alias("licence"), F.lit(k).alias("kind")).alias("hit")) for s, n, k in rules])
    start = F.struct(ids.alias("rest"), F.array().cast("array<struct<licence:string,kind:string>>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = state["rest"].contains(rule["ids"])
        # twice, since neighbours share a comma
        rest = F.replace(F.replace(state["rest"], rule["ids"], F.lit(",.,")), rule["ids"], F.lit(",.,"))
        found = F.when(hit, F.array_union(state["found"], F.array(rule["hit"]))).otherwise(state["found"])
        return F.struct(F.when(hit, rest).otherwise(state["rest"]).alias("rest"), found.alias("found"))

    return F.aggregate(table, start, step)


def scanned(docs: DataFrame, text: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """doc_id, sentence_ids, licences and kinds (both comma-joined, in rule order) of every row."""
    low = F.lower(F.coalesce(col(text).cast("string"), F.lit("")))
    frame = docs.select("doc_id", low.alias("text"))
    told = F.lit(False)
    for word in TRIGGERS:
        told = told | F.col("text").rlike(word.replace(" ", "[^a-z0-9]+"))
    frame = frame.select("doc_id", F.when(told, sequence(F.col("text"), sentences)).otherwise("").alias("ids"))
    frame = frame.select("doc_id", "ids", F.when(F.col("ids") != "", read_rules(F.col("ids"), rules)["found"]).alias("found"))
    found = F.coalesce("found", F.array().cast("array<struct<licence:string,kind:string>>"))
    return frame.select(
        "doc_id",
        F.trim(F.col("ids"), F.lit(",")).alias("sentence_ids"),
        F.array_join(F.array_distinct(F.transform(found, lambda x: x["licence"])), ",").alias("licences"),
        F.array_join(F.array_distinct(F.transform(found, lambda x: x["kind"])), ",").alias("kinds"),
    )
