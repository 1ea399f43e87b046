from __future__ import annotations

import time

from chronoform.llm import license_scan as L


def scan(spark, rows):
    return {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()}


def test_full_texts_short_notices_and_wrapping(spark):
    mit = "\n\n".join(L.SENTENCES[k] for k in ("mit_grant", "mit_notice", "mit_as_is", "mit_liability"))
    wrapped = mit.replace(" copy ", " copy\n# ")
    apache = " ".join(L.SENTENCES[k] for k in ("apache_grant", "apache_copy", "apache_as_is", "apache_see"))
    got = scan(spark, [(1, mit, ""), (2, wrapped, ""), (3, apache + "\n\n" + L.SENTENCES["mit_name"], ""), (4, "Released UNDER the mit license", ""), (5, None, ""), (6, "", ""), (7, "nothing here. " * 20000, ""), (8, L.SENTENCES["bsd_source"], "")])
    assert got[1].licenses == "MIT" and got[1].n_matches == 1 and got[1].unmatched == ""
    assert got[3].licenses == "Apache-2.0,MIT" and got[3].n_matches == 2
    assert got[2].licenses == got[4].licenses == "MIT"
    assert got[5].n_sentences == got[6].n_sentences == 0 and got[7].licenses == "" and got[7].n_sentences == 20000
    assert got[8].licenses == "" and got[8].unmatched == "bsd_source"


def test_order_of_rules_and_sequences(spark):
    s = L.SENTENCES
    got = scan(spark, [(1, f"{s['bsd_grant']}\n{s['bsd_source']}\n{s['bsd_binary']}\n{s['bsd_endorse'].format('Google Inc.')}", ""), (2, f"{s['bsd_grant']}\n{s['bsd_source']}\n{s['bsd_binary']}", ""), (3, f"{s['bsd_binary']}\n{s['bsd_source']}\n{s['bsd_grant']}", "")])
    assert [got[i].licenses for i in (1, 2, 3)] == ["BSD-3-Clause", "BSD-2-Clause", ""]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, L.SENTENCES["mit_name"]), (1, L.SENTENCES["mit_name"])], "doc_id long, text string")
    assert [r.licenses for r in L.scan(df).collect()] == ["MIT", "MIT"]
    assert L.scan(df.where("false")).count() == 0


def test_long_runs_take_linear_time(spark):
    odd = ["." * 200_000 + "x", " " * 200_000 + "x", "a\n" + " " * 200_000 + "!", "#" * 200_000, "x\n" * 100_000]
    rows = [(i, t + " " + L.SENTENCES["mit_name"]) for i, t in enumerate(odd)]
    began = time.time()
    L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert time.time() - began < 60


APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Some Body

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
AGPL = GPL3.replace("GNU General", "GNU Affero General")
LGPL3 = GPL3.replace("GNU General", "GNU Lesser General")
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
ISC = """Copyright (c) 2020 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD_TAIL = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""


def test_other_sentences_part_a_sequence(spark):
    s = L.SENTENCES
    three = [s["bsd_grant"], s["bsd_source"], s["bsd_binary"]]
    rows = [(1, "\n".join(three), ""), (2, f"{three[0]}\nFeed the cat.\n{three[1]}\n{three[2]}", ""), (3, f"{three[0]}\n1. {three[1]}\n2. {three[2]}", ""), (4, f"{three[0]}\n(a) {three[1]}\n(b) {three[2]}", ""), (5, "word " * 5000 + ". " + s["mit_name"], "")]
    got = scan(spark, rows)
    assert [got[i].licenses for i in range(1, 6)] == ["BSD-2-Clause", "", "BSD-2-Clause", "BSD-2-Clause", "MIT"]
    assert got[2].unmatched == got[2].sentence_ids == "bsd_grant,bsd_source,bsd_binary" and got[2].n_matches == 0


def test_every_known_sentence_holds_an_anchor():
    words = L.anchors(L.SENTENCES)
    assert all(any(w in L.plain(s) for w in words) for s in L.SENTENCES.values()) and len(words) < 12


def test_published_headers(spark):
    want = [(LGPL21, "LGPL-2.1-or-later"), (LGPL3, "LGPL-3.0-or-later"), (AGPL, "AGPL-3.0-or-later"), (GPL2_ONLY, "GPL-2.0-only"), (ISC, "ISC"), (ZLIB, "Zlib"), (BSD3 + BSD_TAIL, "BSD-3-Clause"), (UNLICENSE, "Unlicense"), ("SPDX-License-Identifier: LGPL-3.0-only", "LGPL-3.0-only"),
            (APACHE, "Apache-2.0"), (MIT, "MIT"), (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (BSD3, "BSD-3-Clause"), (BSD3.rsplit("\n\n", 1)[0], "BSD-2-Clause"), (MPL, "MPL-2.0")]
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")), lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */"]
    rows = [(10 * i + k, shape(t), "") for i, (t, _) in enumerate(want) for k, shape in enumerate(shapes)]
    got = scan(spark, rows)
    for i, (_, name) in enumerate(want):
        for k in range(len(shapes)):
            r = got[10 * i + k]
            assert (r.licenses, r.n_matches, r.unmatched) == (name, 1, ""), (name, k, r)


def test_known_sentences_keep_their_ends(spark):
    rows = [(1, "Released. Under the MIT License.", ""), (2, "Not released under the MIT License.", ""), (3, "Released under the MIT License agreement.", ""), (4, "License, v\n2.0", ""), (5, "Released under the MIT License. Released under the MIT License.", "")]
    got = scan(spark, rows)
    assert [got[i].sentence_ids for i in range(1, 6)] == ["", "", "", "", "mit_name,mit_name"]


LGPL2 = """{} is free software; you can redistribute it and/or
modify it under the terms of the GNU {} General Public
License as published by the Free Software Foundation; either
version 2 of the License, or (at your option) any later version.

{} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{} General Public License for more details."""
ASF = """Licensed to the Apache Software Foundation (ASF) under one
or more contributor license agreements.  See the NOTICE file
distributed with this work for additional information
regarding copyright ownership.  The ASF licenses this file
to you under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License.  You may obtain a copy of the License at

  http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied.  See the License for the
specific language governing permissions and limitations
under the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
PROMOTE = "may be used to endorse or\n   promote products derived from this software without specific prior\n   written permission.\n"
THIRD = [f"3. Neither the name of {who} nor the names of its\n   contributors {PROMOTE}" for who in ("the copyright holder", "Google Inc.", "the University", "Sun Microsystems, Inc.", "the <organization>", "Django")]
OTHER_THIRD = ["3. Neither the name of the project nor the names of contributors " + PROMOTE, "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n", "3. The names of its contributors may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n"]
RESERVED = "Copyright (c) 1999, Some Body.\nAll rights reserved.\n\n"
GPL_TEXTS = ((GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (AGPL, "AGPL-3.0-or-later"), (LGPL3, "LGPL-3.0-or-later"), (GPL2_ONLY, "GPL-2.0-only"), (LGPL21, "LGPL-2.1-or-later"))


def test_texts_as_people_publish_them(spark):
    """Organisations, programs and versions filled in; what a notice of rights says beside a licence; conditions that no rule knows."""
    name = lambda t, program: t.replace("This program is", f"{program} is").replace("This library is", f"{program} is").replace("along with this program", f"along with {program}")
    want = [
        *[(RESERVED + BSD + t + AS_IS.format("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"), "BSD-3-Clause") for t in THIRD],
        *[(RESERVED + BSD + t + AS_IS.format("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"), "BSD-3-Clause") for t in OTHER_THIRD],
        (BSD + AS_IS.format("THE AUTHOR", "THE AUTHOR"), "BSD-2-Clause"),
        (RESERVED + BSD, "BSD-2-Clause"),
        (BSD + "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the University of California,\n   Berkeley and its contributors.\n4. " + THIRD[2][3:] + AS_IS.format("THE REGENTS", "THE REGENTS"), "BSD-4-Clause"),
        (BSD + "3. Whoever uses it on a Tuesday sends a postcard.\n", ""),
        (ASF, "Apache-2.0"), (APACHE, "Apache-2.0"), (RESERVED + APACHE, "Apache-2.0"),
        *[(name(t, "Foo Bar"), licence) for t, licence in GPL_TEXTS],
        *[(t, licence) for t, licence in GPL_TEXTS],
        (LGPL2.format("This library", "Library", "This library", "Library"), "LGPL-2.0-or-later"), (LGPL2.format("GLib", "Lesser", "GLib", "Lesser"), "LGPL-2.0-or-later"),
        (RESERVED + MIT, "MIT"), (RESERVED, "all-rights-reserved"), (RESERVED + "Redistribution is fine.", "all-rights-reserved"), ("We licence nothing here.", ""),
    ]
    got = scan(spark, [(i, t, "") for i, (t, _) in enumerate(want)])
    assert len(want) >= 30 and [(got[i].licenses, t) for i, (t, _) in enumerate(want)] == [(licence, t) for t, licence in want]
