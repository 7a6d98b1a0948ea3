"""Every rule of the licence table with the text as it is published, wrapped and commented as in source files."""

import re
import textwrap

from vigil.llm import licences as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
DISCLAIMER = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
"""
APACHE_REST = """You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
FREE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
FREE2 = FREE.replace("software:", "software;").replace("version 3", "version 2")
HOPE = """
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
#: One text per rule, in the order of the table.
TEXTS = [
    MIT + DISCLAIMER, MIT, APACHE + APACHE_REST, APACHE, BSD3, BSD2, FREE + HOPE, FREE2 + HOPE, FREE, FREE2, ISC,
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "Licensed under CC BY 4.0.",
    "Released under the MIT License.", "Licensed under the MIT license.", "Licensed under the Apache License, Version 2.0.", MPL,
    "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: MIT",
    "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "All rights reserved.",
]


def wrapped(text):
    return "\n\n".join(textwrap.fill(p, 40) for p in re.split(r"\n\s*\n", text))


def test_every_rule_reads_its_published_text(spark):
    forms = [lambda t: t, lambda t: "".join(f" * {x}\n" for x in t.split("\n")), lambda t: "".join(f"# {x}\r\n" for x in t.split("\n")),
             wrapped, lambda t: f"Some Heading\n{t}\nMore of it\n"]
    assert len(TEXTS) == len(L.RULES)
    rows = [(100 * k + j, form(t)) for k, t in enumerate(TEXTS) for j, form in enumerate(forms)]
    got = {r.doc_id: r for r in L.recognise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, (name, seq) in enumerate(L.RULES):
        for j in range(len(forms)):
            row = got[100 * k + j]
            assert (row.licences, row.sentence_ids, row.n_unread) == (name, ",".join(seq), 0), (k, j)


def test_no_sentence_out_of_its_bounds(spark):
    rows = [(1, "SPDX-License-Identifier: MIT OR Apache-2.0"), (2, "not released under the MIT License."), (3, "free software: you can " * 9),
            (4, "All rights. Reserved."), (5, "All\n\nrights reserved."), (6, "All rights" + " : " * 20_000 + "reserved")]
    got = {r.doc_id: r.licences for r in L.recognise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k for k, v in got.items() if v} == {6}
