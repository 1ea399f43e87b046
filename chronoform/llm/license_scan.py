"""Licence scans by sentence rules: sentences to identifiers of known licence sentences, then identifier sequences to licences.

After the sentence-matching method of German, Manabe and Inoue ("A sentence-matching method for automatic license identification of
source code files", 2010). Spark deals the texts to tasks; a scanner in each reads them one by one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

# Sentences as the licences word them; {} stands for what a publisher fills in, of up to twelve words.
SENTENCES: dict[str, str] = {
    "mit_name": "Released under the MIT License.",
    "mit_name_2": "Licensed under the MIT License.",
    "mit_name_3": "This project is licensed under the MIT License.",
    "mit_spdx": "SPDX-License-Identifier: MIT",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache_name": "Licensed under the Apache License, Version 2.0.",
    "apache_spdx": "SPDX-License-Identifier: Apache-2.0",
    "apache_grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_as_is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3_name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3_spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl3_only_spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl2_spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "gpl3_grant": "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_grant": "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl_hope": "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "gpl_received": "You should have received a copy of the GNU General Public License along with {}.",
    "bsd_spdx_2": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd_spdx_3": "SPDX-License-Identifier: BSD-3-Clause",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_endorse_own": "Neither the name of {} nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_endorse_author": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_endorse_names": "The names of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd_advert_2": "This product includes software developed by {}.",
    "asf_contributors": "Licensed to {} under one or more contributor license agreements.",
    "asf_notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    "asf_grant": "{} licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "lgpl2_grant": "{} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl2_library_grant": "{} is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mpl_grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ccbync_name": "Licensed under CC BY-NC 4.0.",
    "ccby_name": "Licensed under CC BY 4.0.",
    "ccbysa_name": "Licensed under CC BY-SA 4.0.",
    "ccby_work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0_name": "This work is dedicated to the public domain under CC0 1.0.",
    "reserved": "All rights reserved.",
    "bsd_as_is": "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd_liability": "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "gpl3_only_grant": "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl2_only_grant": "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21_grant": "{} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl_see": "See the GNU Lesser General Public License for more details.",
    "lgpl3_grant": "{} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3_received": "You should have received a copy of the GNU Lesser General Public License along with {}.",
    "agpl_grant": "{} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl_see": "See the GNU Affero General Public License for more details.",
    "agpl_received": "You should have received a copy of the GNU Affero General Public License along with {}.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero_bsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc_liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib_origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib_credit": "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "zlib_altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib_notice": "This notice may not be removed or altered from any source distribution.",
    "epl2_terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense_domain": "This is free and unencumbered software released into the public domain.",
    "unlicense_free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost_name": "Distributed under the Boost Software License, Version 1.0.",
}
# Further identifiers by which a licence is named after SPDX-License-Identifier.
SPDX = ("Apache-2.0 OR MIT", "MIT OR Apache-2.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "GPL-2.0-or-later", "ISC", "0BSD", "Zlib", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {f"spdx_{n}": f"SPDX-License-Identifier: {name}" for n, name in enumerate(SPDX)}
ENDORSEMENTS = ("bsd_endorse", "bsd_endorse_own", "bsd_endorse_author", "bsd_endorse_names")
#: Reported only where no other licence is: it stands in the notices of permissive licences too.
WEAK = "all-rights-reserved"
#: Sequences that do not match where an unknown item of a numbered list follows: the text goes on with a condition of its own.
LISTS = frozenset({("bsd_grant", "bsd_source", "bsd_binary")})
#: (licence, sequence of sentence identifiers), tried in this order: fuller texts before the short notices.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("Apache-2.0", ("apache_grant", "apache_copy", "apache_as_is", "apache_see")),
    ("GPL-3.0-or-later", ("gpl3_grant", "gpl_hope", "gpl_see", "gpl_received")),
    ("GPL-3.0-or-later", ("gpl3_grant", "gpl_hope", "gpl_see")),
    ("GPL-2.0-or-later", ("gpl2_grant", "gpl_hope", "gpl_see", "gpl_received")),
    ("GPL-2.0-or-later", ("gpl2_grant", "gpl_hope", "gpl_see")),
    *(("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_advert_2", e, "bsd_as_is", "bsd_liability")) for e in ENDORSEMENTS),
    *(("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_advert_2", e)) for e in ENDORSEMENTS),
    *(("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", e, "bsd_as_is", "bsd_liability")) for e in ENDORSEMENTS),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_liability")),
    *(("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", e)) for e in ENDORSEMENTS),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("asf_contributors", "asf_notice", "asf_grant", "apache_copy", "apache_as_is", "apache_see")),
    ("Apache-2.0", ("asf_grant", "apache_copy", "apache_as_is", "apache_see")),
    ("LGPL-2.0-or-later", ("lgpl2_grant", "gpl_hope", "lgpl_see")),
    ("LGPL-2.1-or-later", ("lgpl21_grant", "gpl_hope", "lgpl_see")),
    ("LGPL-3.0-or-later", ("lgpl3_grant", "gpl_hope", "lgpl_see", "lgpl3_received")),
    ("LGPL-3.0-or-later", ("lgpl3_grant", "gpl_hope", "lgpl_see")),
    ("AGPL-3.0-or-later", ("agpl_grant", "gpl_hope", "agpl_see", "agpl_received")),
    ("AGPL-3.0-or-later", ("agpl_grant", "gpl_hope", "agpl_see")),
    ("GPL-3.0-only", ("gpl3_only_grant", "gpl_hope", "gpl_see", "gpl_received")),
    ("GPL-3.0-only", ("gpl3_only_grant", "gpl_hope", "gpl_see")),
    ("GPL-2.0-only", ("gpl2_only_grant", "gpl_hope", "gpl_see", "gpl_received")),
    ("GPL-2.0-only", ("gpl2_only_grant", "gpl_hope", "gpl_see")),
    ("ISC", ("isc_grant", "isc_as_is", "isc_liability")),
    ("0BSD", ("zero_bsd_grant", "isc_as_is", "isc_liability")),
    ("Zlib", ("zlib_as_is", "zlib_liability", "zlib_grant", "zlib_origin", "zlib_credit", "zlib_altered", "zlib_notice")),
    ("Unlicense", ("unlicense_domain", "unlicense_free")),
    ("MPL-2.0", ("mpl_grant", "mpl_copy")),
    ("Apache-2.0", ("apache_grant",)),
    ("GPL-3.0-or-later", ("gpl3_grant",)),
    ("GPL-2.0-or-later", ("gpl2_grant",)),
    ("MPL-2.0", ("mpl_grant",)),
    ("MIT", ("mit_grant",)),
    ("LGPL-2.1-or-later", ("lgpl21_grant",)),
    ("LGPL-2.0-or-later", ("lgpl2_grant",)),
    ("LGPL-2.0-or-later", ("lgpl2_library_grant",)),
    ("Apache-2.0", ("asf_grant",)),
    ("LGPL-3.0-or-later", ("lgpl3_grant",)),
    ("AGPL-3.0-or-later", ("agpl_grant",)),
    ("GPL-3.0-only", ("gpl3_only_grant",)),
    ("GPL-2.0-only", ("gpl2_only_grant",)),
    ("ISC", ("isc_grant",)),
    ("Unlicense", ("unlicense_domain",)),
    ("EPL-2.0", ("epl2_terms",)),
    ("BSL-1.0", ("boost_name",)),
    ("MIT", ("mit_name",)),
    ("MIT", ("mit_name_2",)),
    ("MIT", ("mit_name_3",)),
    ("MIT", ("mit_spdx",)),
    ("Apache-2.0", ("apache_name",)),
    ("Apache-2.0", ("apache_spdx",)),
    ("GPL-3.0-only", ("gpl3_name",)),
    ("GPL-3.0-only", ("gpl3_only_spdx",)),
    ("GPL-3.0-or-later", ("gpl3_spdx",)),
    ("GPL-2.0-only", ("gpl2_spdx",)),
    ("BSD-2-Clause", ("bsd_spdx_2",)),
    ("BSD-3-Clause", ("bsd_spdx_3",)),
    ("CC-BY-NC-4.0", ("ccbync_name",)),
    ("CC-BY-4.0", ("ccby_name",)),
    ("CC-BY-4.0", ("ccby_work",)),
    ("CC-BY-SA-4.0", ("ccbysa_name",)),
    ("CC0-1.0", ("cc0_name",)),
    *((name, (f"spdx_{n}",)) for n, name in enumerate(SPDX)),
    (WEAK, ("reserved",)),
)
#: A line that ends within a sentence and goes on, after a comment mark or not, in lower case or with an opening bracket.
WRAP = r"([^\s.!?:;])[ \t]*\r?\n[ \t]*(?:(?:[#*/;]+|--)[ \t]*)?([a-z(])"
#: Where sentences end: at a stop before a blank, and where a line ends that does not go on. A colon or semicolon within a line is no end.
END = r"[.!?](?:\s|$)|\n"
#: The first of these alone.
STOP = r"[.!?](?:\s|$)"
WRAP_BYTES, STOP_BYTES, BLANKS = re.compile(WRAP.encode()), re.compile(STOP.encode().replace(b"$", rb"\Z")), re.compile(b"  +")


def plain(sentence: str) -> str:
    """A sentence as it is compared: a-z and 0-9, everything else one blank."""
    kept = "".join(c if c in LOWER or c.isdigit() and c.isascii() else " " for c in sentence.translate(str.maketrans(UPPER, LOWER)))
    return " ".join(kept.split())


#: What :func:`marked` makes of each byte: a-z and 0-9 stay, A-Z become lower, a line end is \x02, the mark \x01 stays, all else is a blank.
AS_MARKED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c == 1 else 2 if c == 10 else 32 for c in range(256))


def marked(text: str) -> str:
    """A text normalised, with \\x01 where a stop ends a sentence and \\x02 where a line ends that does not go on, at both ends too."""
    joined = WRAP_BYTES.sub(rb"\1 \2", text.encode("utf-8", "replace"))
    return "\x02" + BLANKS.sub(b" ", STOP_BYTES.sub(b"\x01", joined).translate(AS_MARKED)).decode("ascii") + "\x02"


SLOT, SLOT_WORDS = "{}", 12


def pattern(sentence: str, blank: str = r"[ \x02]++", stop: str = r"[ \x02]*+\x01[ \x02]*+", within: str = r"[ \x01\x02]++", last: str = r"(?= ?(?:\x01|\x02$))") -> str:
    """A known sentence as it may stand in a marked text: its own stops are stops there, and lines may end between any two words. A slot is any words, with stops as in "Inc."; one that a sentence ends with goes on to a stop."""
    slot = rf"[a-z0-9]+(?:{within}[a-z0-9]+){{0,{SLOT_WORDS - 1}}}?"
    parts = []
    for words in filter(None, map(words_of, re.split(STOP, sentence))):
        parts.append("".join((slot if w == SLOT else w) + (within if w == SLOT else blank) for w in words[:-1]) + (slot + last if words[-1] == SLOT else words[-1]))
    return stop.join(parts)


def words_of(sentence: str) -> list[str]:
    """The normalised words of a known sentence, slots among them."""
    return f" {SLOT} ".join(plain(s) for s in sentence.split(SLOT)).split()


def anchors(sentences: dict[str, str]) -> list[str]:
    """Words such that each sentence holds one of them, chosen greedily, long ones first among equals: a text without any holds no known sentence."""
    left, chosen = [{w for w in words_of(s) if len(w) > 3} or set(words_of(s)) - {SLOT} for s in sentences.values()], []
    while left:
        best = min({w for s in left for w in s}, key=lambda w: (-sum(w in s for s in left), -len(w), w))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return chosen


#: What numbers a list: as a sentence of its own it parts nothing, and a known sentence may stand behind it.
LABEL = r"(?:[0-9]{1,2}|[a-z])"
#: What numbers an item that is not known, with which a list of conditions goes on.
ITEM = r"[0-9]{1,2}"


class Scanner:
    """What is known of the licences, ready to read texts one by one: a small helper that tasks hold."""

    def __init__(self, sentences: dict[str, str], rules: tuple) -> None:
        self.known = {plain(s): k for k, s in sentences.items() if SLOT not in s}
        self.slotted = [(re.compile(pattern(s, " ", " ", " ", "")), k) for k, s in sentences.items() if SLOT in s]
        longest = sorted(((pattern(s), s) for s in sentences.values()), key=lambda x: len(x[0]), reverse=True)
        self.patterns = [(p, [run for run in map(str.strip, " ".join(words_of(s)).split(SLOT)) if run]) for p, s in longest]
        self.anchors, self.found = anchors(sentences), {}
        self.rules = [(licence, "".join(f"<{s}>" for s in sequence), sequence in LISTS) for licence, sequence in rules]
        self.between = re.compile(rf"(?:[ \x01\x02]*{LABEL} ?[\x01\x02])*[ \x01\x02]*")
        self.item = re.compile(rf"[ \x01\x02]*{ITEM}[ \x01]+[a-z0-9]")

    def finder(self, text: str) -> re.Pattern | None:
        """The known sentences of which all fixed words stand in the marked text, from where a sentence or line starts to where one ends, longer ones first."""
        if not any(a in text for a in self.anchors):
            return None
        flat = " ".join(text.translate({1: " ", 2: " "}).split())
        likely = tuple(p for p, runs in self.patterns if all(r in flat for r in runs))
        if not likely:
            return None
        if likely not in self.found:
            if len(self.found) >= 1000:
                self.found.clear()
            self.found[likely] = re.compile(rf"[\x01\x02] ?(?:{LABEL} )?({'|'.join(likely)})(?= ?[\x01\x02])")
        return self.found[likely]

    def name(self, sentence: str) -> str:
        """The identifier of a known sentence as it was found."""
        flat = re.sub(r"[ \x01\x02]+", " ", sentence)
        return self.known.get(flat) or next(k for p, k in self.slotted if p.fullmatch(flat))

    def tokens(self, text: str) -> list[str]:
        """A marked text as the identifiers of its known sentences in order, with ``?`` where other sentences stand before, between or after them, ``?+`` where the first of these is an item of a numbered list; empty if none is known."""
        finder = self.finder(text)
        out, end = [], 0
        other = lambda s: [] if self.between.fullmatch(s) else ["?+"] if self.item.match(s) else ["?"]
        for m in finder.finditer(text) if finder else ():
            out += [*other(text[end : m.start() + 1]), self.name(m[1])]
            end = m.end()
        return out + other(text[end:]) if out else []

    def scan(self, text: str | None) -> dict:
        """n_sentences, sentence_ids, licenses, n_matches and unmatched of one text."""
        text = marked(text or "")
        tokens, counts = self.tokens(text), {}
        rest = "<" + "><".join(tokens) + ">" if tokens else ""
        for licence, mark, of_list in self.rules if tokens else ():
            held = "#" * len(mark)
            if of_list:
                rest = rest.replace(f"{mark}<?+>", f"{held}<?+>")
            if mark in rest:
                counts[licence] = counts.get(licence, 0) + rest.count(mark)
                rest = rest.replace(mark, "|")
            if of_list:
                rest = rest.replace(f"{held}<?+>", f"{mark}<?+>")
        licences = sorted(counts) if len(counts) == 1 else sorted(set(counts) - {WEAK})
        known = ",".join(t for t in tokens if t not in ("?", "?+"))
        return {"n_sentences": len(RUN.findall(text)), "sentence_ids": known, "licenses": ",".join(licences), "n_matches": sum(counts.values()), "unmatched": ",".join(re.sub(r"[<>|?+]+", " ", rest).split())}


#: A sentence or line of a marked text.
RUN = re.compile("[a-z0-9][a-z0-9 ]*")
RESULT = "n_sentences long, sentence_ids string, licenses string, n_matches long, unmatched string"


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """For each row: id, n_sentences, sentence_ids (known ones in order), licenses (distinct, sorted), n_matches, unmatched.

    Rules are tried in order on the sequence of sentences; a match uses its sentences up. What no rule uses is
    ``unmatched``. A sentence that is not known parts a sequence, unless it is just the number or letter of a list. Null and empty
    texts: no sentences, empty strings. Repeated rows are scanned one by one. No shuffle. A known sentence may be wrapped anywhere, also
    before upper case, after a colon or semicolon or around blank lines; ``n_sentences`` counts a line that WRAP does not join as a sentence.
    Texts come to Python in Arrow batches and are read one at a time.
    """
    scanner = Scanner(sentences, rules)

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        return pa.array([scanner.scan(t.as_py()) for t in texts], KINDS)

    rows = docs.select(F.col(id_col).alias("id"), scanned(F.col(text)).alias("r"))
    return rows.select(F.col("id").alias(id_col), "r.*")


KINDS = pa.struct([("n_sentences", pa.int64()), ("sentence_ids", pa.string()), ("licenses", pa.string()), ("n_matches", pa.int64()), ("unmatched", pa.string())])


def oracle(sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> str:
    """DuckDB SQL for :func:`scan` over documents."""
    known = ", ".join(f"('{plain(s)}', '{k}')" for k, s in sentences.items() if SLOT not in s)
    slotted = " ".join(f"WHEN regexp_full_match(s, '{pattern(s, ' ', ' ', ' ', '')}') THEN '{k}'" for k, s in sentences.items() if SLOT in s)
    steps, last = [], "q"
    for n, (_, sequence) in enumerate(rules):
        mark = "".join(f"<{s}>" for s in sequence)
        if sequence in LISTS:
            steps.append(f"g{n} AS (SELECT * REPLACE (replace(rest, '{mark}<?+>', '{'#' * (n + 1)}<?+>') AS rest) FROM {last})")
            last = f"g{n}"
        left = f"replace(replace(rest, '{mark}', '|'), '{'#' * (n + 1)}<?+>', '{mark}<?+>')" if sequence in LISTS else f"replace(rest, '{mark}', '|')"
        steps.append(f"q{n} AS (SELECT * EXCLUDE (rest), CAST((length(rest) - length(replace(rest, '{mark}', ''))) / {len(mark)} AS BIGINT) AS n{n}, {left} AS rest FROM {last})")
        last = f"q{n}"
    licences = ", ".join(f"CASE WHEN n{n} > 0 THEN '{rule[0]}' END" for n, rule in enumerate(rules))
    total = " + ".join(f"n{n}" for n in range(len(rules)))
    return rf"""WITH known(s, k) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(string_split(regexp_replace(translate(regexp_replace(regexp_replace(coalesce(text, ''), '{WRAP}', '\1 \2', 'g'), '{END}', chr(1), 'g'), '{UPPER}', '{LOWER}'), '[^a-z0-9\x01]+', ' ', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
e0 AS (SELECT r, unnest(s) AS o, generate_subscripts(s, 1) AS p FROM d), e AS (SELECT r, p, regexp_matches(o, '^{ITEM} ') OR coalesce(regexp_full_match(lag(o) OVER (PARTITION BY r ORDER BY p), '{ITEM}'), false) AS item, regexp_replace(o, '^{LABEL} ', '') AS s FROM e0),
f AS (SELECT r, list(coalesce(k, CASE WHEN item THEN '?+' ELSE '?' END) ORDER BY p) AS tokens, list(k ORDER BY p) FILTER (WHERE k IS NOT NULL) AS found FROM (SELECT e.*, coalesce(known.k, CASE {slotted} END) AS k FROM e LEFT JOIN known USING (s)) WHERE k IS NOT NULL OR NOT regexp_full_match(s, '{LABEL}') GROUP BY r),
q AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(array_to_string(found, ','), '') AS sentence_ids, CASE WHEN found IS NULL THEN '' ELSE '<' || array_to_string(tokens, '><') || '>' END AS rest FROM d LEFT JOIN f USING (r)),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_filter(list_sort(list_distinct([{licences}])), lambda x: x IS NOT NULL AND (x <> '{WEAK}' OR len(list_distinct([{licences}])) = 1)), ',') AS licenses, {total} AS n_matches, replace(trim(regexp_replace(rest, '[<>|?+]+', ' ', 'g')), ' ', ',') AS unmatched FROM {last}"""
