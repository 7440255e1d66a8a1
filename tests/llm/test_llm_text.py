"""Quality rules, decontamination, licence scan, pseudonyms, encoding: rows judged one by one."""

import datetime
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, licences, pii, quality_hosts, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "long text of many words " * 3000 + "\n" + "x" * 5000
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "a b c d e " * 6), (5, "# $ % line\nline one\nline one\n\n  \nline one"),
    (6, "the quick brown fox jumps over the lazy dog again and again"), (7, LONG), (8, "ÄÖÜ été 日本語 ＡＢ 🙂 naïve" * 3),
    (9, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (10, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "src" if i % 2 else None, "z") for i, t in rows], "doc_id long, text string, source string, `n_words` string")


def test_quality_measures_and_verdicts(spark):
    got = {r["doc_id"]: r for r in quality_hosts.judged(frame(spark)).collect()}
    for i, t in TEXTS:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t), i
        assert r["kept"] == (not r["base_failed"] and not r["host_rejected"])


def test_a_bad_host_takes_its_documents_along(spark):
    fine = " ".join(f"word{k}" for k in range(30))
    rows = [(i, f"bad {i}", "bad") for i in range(60)] + [(100, fine, "bad")] + [(200 + i, f"{fine} {i}", f"good{i % 5}") for i in range(100)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, source string")
    got = quality_hosts.judged(docs)
    assert {r["doc_id"] for r in got.where("kept").collect()} == {200 + i for i in range(100)}
    kept = quality_hosts.good_documents(docs.withColumn("q_n_words", F.lit("clash")))
    assert kept.columns == ["doc_id", "text", "source", "q_n_words"] and kept.count() == 101


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    assert quality_hosts.judged(none).count() == quality_hosts.good_documents(none).count() == 0
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    assert not decontaminate.contamination(frame(spark), bench.limit(0)).where("contaminated").count()
    assert licences.scanned(none).count() == pii.pseudonymised(none, "k").count() == bpe.encode_digests(none, VOCABULARY).count() == 0
    assert token_counts.context_limits(token_counts.length_histogram(none, VOCABULARY)).count() == 0


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for k in range(25)] + [(25, None), (26, " .,"), (27, "W1 w2, w3! w4-w5 w6 w7 w8 w9 w10 w11")]
    docs = [(k, " ".join(rng.choice(["a", "b", "c", "b", "z"]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    docs += [(900, None), (901, ""), (902, "x w1 w2 w3 w4 w5 W6 w7 w8 w9 w10 y"), (903, "w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (200_000, 40):
        got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_words=blocks)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == {i: brute.contamination(t, items) for i, t in docs}


def test_passages_are_cut_out(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    own = " ".join(f"own{k}" for k in range(60))
    bench = spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string")
    rows = [(1, own), (2, f"{own} {passage}. {own}"), (3, passage), (4, None), (5, f"{own} " + passage.replace("p10", f"p10 {passage} p11", 1))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _clean_text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, max_coverage=0.5).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1] == own and got[4] is None
    assert got[2].split() == [*own.split(), ".", *own.split()]
    assert not any(brute.contamination(t, [(1, passage)])[4] for t in got.values())


def test_licence_sentences_and_rules(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
    gpl += "either version 3 of the License, or (at your option) any later version."
    rows = [*TEXTS, (20, "All rights reserved. all rights RESERVED!\nAll rights reserved"), (21, gpl), (22, "x\n" + gpl + " All rights reserved."), (23, "licensed to no one")]
    rows += [(24, "Licensed under the Apache License, Version 2.0;\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at")]
    got = {r[0]: tuple(r)[1:] for r in licences.scanned(frame(spark, rows)).collect()}
    assert got == {i: brute.licences(t, licences.SENTENCES, licences.RULES) for i, t in rows}
    assert got[21][1] == "GPL-3.0-or-later" and got[24][1] == "Apache-2.0"
    assert all(any(t in f for t in licences.TRIGGERS) for fs in licences.SENTENCES.values() for f in fs)


MIT = """Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def marked(text, mark):
    return "\r\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))


def test_wrapped_licence_notices(spark):
    texts = {"MIT": MIT, "BSD": BSD, "GPL-2.0-or-later": GPL2, "GPL-3.0-or-later": GPL3}
    ids = {"MIT": "MITGrant,MITNotice,AsIs", "BSD": "BSDGrant,?,BSDSource,AsIs", "GPL-2.0-or-later": "GPLFree,GPLTerms,GPLEither2", "GPL-3.0-or-later": "GPLGrant3"}
    want = [(n, v) for n, t in texts.items() for v in (t, f"some code\n{t}\nmore", *[marked(t, m) for m in ("#", " *", "//", ";", "--")], re.sub(r"(?<!\n)\n(?!\n)", " ", t))]
    got = {r["doc_id"]: r for r in licences.scanned(frame(spark, [(k, v) for k, (_, v) in enumerate(want)])).collect()}
    assert [got[k]["licences"] for k in range(len(want))] == [n for n, _ in want]
    assert all(ids[n] in got[k]["sentence_ids"] for k, (n, _) in enumerate(want))
    odd = [(1, "Dedicated to the public\ndomain"), (2, "all rights\n\nreserved"), (3, "x all rights\nreserved"), (4, "All rights\nreserved\nall rights reserved\nby us")]
    assert {r[0]: r[1] for r in licences.scanned(frame(spark, odd)).collect()} == {1: "CC0", 2: "", 3: "", 4: "AllRights,AllRights,?"}


BSD_CLAUSES = [
    """Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    """Neither the name of {who} nor the names of its contributors may be used
to endorse or promote products derived from this software without specific
prior written permission.""",
]
HEADERS = {
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.""",
}


def test_notices_and_spdx_lines(spark):
    intro, end = BSD.split("\n\n")[0], BSD.split("\n\n")[2]

    def bsd(n, who="the copyright holder", mark="{k}. "):
        return "\n\n".join([intro, *[mark.format(k=k + 1) + c.format(who=who) for k, c in enumerate(BSD_CLAUSES[:n])], end])

    want = [(n, v) for n, t in HEADERS.items() for v in (t, re.sub(r"\n", " ", t), marked(t, "//"))]
    want += [(f"BSD-{n}-Clause", bsd(n, who, mark)) for n in (2, 3) for mark in ("{k}. ", "* ", "") for who in ("the copyright holder", "Foo Ltd")]
    lines = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "// SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1-only",
        "/* SPDX-License-Identifier: (GPL-2.0-or-later AND MIT) OR ISC */": "MIT,ISC,GPL-2.0-or-later", "This file is licensed under the MIT License.": "MIT", "The MIT License (MIT)": "MIT",
        "Copyright 2020 Foo, all rights reserved.": "LicenseRef-AllRightsReserved", "Released under the Eclipse Public License.": "EPL-2.0", "the license of the club": "", "under the table license": "",
        "# This code is distributed under the 3-clause BSD license": "BSD-3-Clause", "SPDX-License-Identifier: Unknown-1.0 OR MPL-2.0": "MPL-2.0",
    }
    want += [(v, k) for k, v in lines.items()]
    got = {r["doc_id"]: r for r in licences.scanned(frame(spark, [(k, t) for k, (_, t) in enumerate(want)])).collect()}
    assert {t: (set(got[k]["licences"].split(",")), n) for k, (n, t) in enumerate(want) if set(got[k]["licences"].split(",")) != set(n.split(","))} == {}


def test_tables_of_licences():
    forms = [f for fs in licences.SENTENCES.values() for f in fs]
    assert len(forms) == len(set(forms)) and len({name for _, name, _ in licences.RULES}) >= 40
    assert all(any(t in f for t in licences.TRIGGERS) for f in forms) and all(f == licences.plain(f) for f in forms)
    assert all(part == "?" or part in licences.SENTENCES for ids, _, _ in licences.RULES for part in ids.split(","))


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    rows = [
        (1, "card 4111111111111111 and 4111 1111 1111 1111, bad 4111111111111112."), (2, "ip 10.0.0.255. v 300.1.1.1 and 1.2.3.4.5"), (3, "+1 (456) 555-2186"),
        (4, "ssn 123-45-6789 000-12-3456"), (5, "2024-02-29, 2023-02-29, 31/12/1999 12/31/1999"), (6, "mail ann.42@mail8.example.com"), (7, None), (8, ""), (9, "4111111111111111 x"),
    ]
    got = {r["doc_id"]: (r["text"], r["n_pseudonyms"]) for r in pii.pseudonymised(frame(spark, rows), "key").collect()}
    assert [got[i][1] for i in range(1, 10)] == [2, 1, 1, 1, 3, 1, 0, 0, 1]
    assert got[7][0] is None and got[8][0] == ""
    cards = re.findall(r"[\d ]{15,}\d", got[1][0])
    assert luhn(cards[0].replace(" ", "")) and cards[0].strip() == cards[1].replace(" ", "") and "4111111111111112" in got[1][0]
    assert got[9][0].split()[0] == cards[0].strip() != "4111111111111111"
    assert "300.1.1.1" in got[2][0] and "1.2.3.4.5" in got[2][0] and "10.0.0.255" not in got[2][0]
    assert re.fullmatch(r"\+1 \(4\d\d\) \d{3}-\d{4}", got[3][0]) and re.fullmatch(r"ssn \d{3}-\d\d-\d{4} 000-12-3456", got[4][0])
    first, kept, day, month = re.split(r",? ", got[5][0])
    assert datetime.date.fromisoformat(first) and kept == "2023-02-29" and day.split("/") == [month.split("/")[k] for k in (1, 0, 2)]
    assert re.fullmatch(r"mail [a-z]{3}\.\d\d@mail8\.example\.com", got[6][0])


def test_the_network_is_a_permutation(spark):
    pairs = spark.range(30 * 7).select((F.col("id") % 30).alias("l"), F.floor(F.col("id") / 30).alias("r"))
    moved = pairs.select(pii._permuted("k", "t", F.col("l"), F.col("r"), F.lit(30), F.lit(7)).alias("s")).select("s.*")
    assert moved.distinct().count() == 210 and moved.where("l not between 0 and 29 or r not between 0 and 6").count() == 0


def test_dates_are_one_to_one_in_every_notation(spark):
    """All days of five years in six notations: no two strings share a pseudonym, and each day has one."""
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(k) for k in range(1826)] + [datetime.date(y, 2, 29) for y in range(1904, 2100, 4)]
    forms = {"iso": "{y}-{m:02}-{d:02}", "slash": "{d:02}/{m:02}/{y}", "us": "{m:02}/{d:02}/{y}", "dot": "{d}.{m}.{y}", "short": "{d}/{m}/{y}", "year": "{y}/{m}/{d}"}
    rows = sorted({(f, t.format(y=d.year, m=d.month, d=d.day), d) for f, t in forms.items() for d in set(days) if f != "us" or d.day > 12})
    df = spark.createDataFrame(rows, "form string, value string, day date").repartition(8)
    got = df.select("form", "value", "day", pii.pseudonym(F.col("value"), "k").alias("new")).collect()
    by_text, by_day = {}, {}
    for r in got:
        assert by_text.setdefault(r["new"], r["value"]) == r["value"]
        parts = list(map(int, re.split("[-/.]", r["new"])))
        y, m, d = parts if r["form"] in ("iso", "year") else (parts[2], parts[0], parts[1]) if r["form"] == "us" else parts[::-1]
        assert by_day.setdefault(r["day"], datetime.date(y, m, d)) == datetime.date(y, m, d)
        assert [len(p) for p in re.split("[-/.]", r["new"])] == [len(p) for p in re.split("[-/.]", r["value"])] and (r["form"] != "us" or d > 12)
    assert len(set(by_day.values())) == len(by_day)


def test_pseudonyms_against_a_plain_network(spark):
    rng = random.Random(12)
    makers = [
        lambda: f"{rng.randint(1, 31):02}/{rng.randint(1, 13):02}/{rng.randint(1890, 2110)}", lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}",
        lambda: f"{rng.randint(0, 999):03}-{rng.randint(0, 99):02}-{rng.randint(0, 9999):04}", lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        lambda: ".".join(str(rng.randint(0, 270)) for _ in range(4)), lambda: "".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19))), lambda: "3782 822463 10005",
        lambda: f"{rng.choice(['ann', 'B.c', 'müller.hans', 'x1_y2'])}{rng.randint(0, 99)}@mail.example.org", lambda: "word", lambda: "+4930901820123",
    ]
    rows = [(k, " ".join(rng.choice(makers)() for _ in range(rng.randint(0, 6)))) for k in range(300)] + [(300, "x 1/5/2024, 2024/01/05; " * 2000)]
    docs = spark.createDataFrame([(i, t, 7, "q") for i, t in [*rows, *rows[:3]]], "doc_id long, text string, n_pseudonyms int, _found string").repartition(8)
    got = pii.pseudonymised(docs, "key").collect()
    want = {i: brute.pseudonymised(t, "key") for i, t in rows}
    assert len(got) == 304 and all((r["text"], r["_n_pseudonyms"]) == want[r["doc_id"]] for r in got)
    assert got[0].asDict()["n_pseudonyms"] == 7


def test_codes_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng, library = random.Random(1), Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x400), *range(0x1F00, 0x2070), 0x1C, 0x1D, 0x3000, 0x4E00, 0x1F600, 0x0130, 0x0301]]
    texts = [t for _, t in TEXTS] + ["'s it's don't", "<|startoftext|>hi<|endoftext|> <|ENDOFTEXT|>", "ab" * 4000, "!!!???... " * 40, "ΣΑΣ İstanbul"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encoded(docs, VOCABULARY, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want, t
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False) and got[i]["n_tokens"] == len(want)


def test_a_full_store_of_words_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    coder = bpe.Bpe.load(VOCABULARY)
    texts = [" ".join(f"word{k}" for k in range(n)) for n in (3, 9, 2, 12)]
    small = list(coder.encode(texts))
    monkeypatch.setattr(bpe, "KEPT", 10**6)
    assert small == list(bpe.Bpe.load(VOCABULARY).encode(texts))


def test_histogram_answers_every_limit(spark):
    docs = frame(spark)
    lengths = [r["n_tokens"] for r in bpe.encode_digests(docs, VOCABULARY).collect()]
    limits = token_counts.context_limits(token_counts.length_histogram(docs, VOCABULARY)).cache()
    for r in limits.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n) and r["docs_within"] == sum(x <= n for x in lengths) and r["docs_beyond"] == sum(x > n for x in lengths)
        assert r["tokens_within"] == sum(x for x in lengths if x <= n) and r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["cut_tokens"] == sum(lengths) - r["truncated_total"]
    for r in token_counts.at_limits(limits, [0, 7, 4096, 10**6]).collect():
        assert r["truncated_total"] == sum(min(x, r["context"]) for x in lengths) and r["docs_within"] == sum(x <= r["context"] for x in lengths)
    ordered = sorted(lengths)
    assert {r["share"]: r["n_tokens"] for r in token_counts.quantiles(limits, [0.5, 1.0]).collect()} == {0.5: ordered[-(-len(ordered) // 2) - 1], 1.0: ordered[-1]}
