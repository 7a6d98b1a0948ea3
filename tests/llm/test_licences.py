import re

from llm_fixtures import none, odd, plain  # noqa: F401

from vigil.llm import licences as L

KNOWN = {s: i for i, s in L.SENTENCES}


def replay(text):
    text = re.sub(L.WRAP, r"\1 \2", text or "")
    parts = re.sub(L.STOP, "\\1\n", text).split("\n")
    ids = [KNOWN[n] for n in (re.sub("[^A-Za-z0-9]+", " ", p).strip().lower() for p in parts) if n in KNOWN]
    left, out = "".join(f"[{i}]" for i in ids), []
    for name, seq in L.RULES:
        mark = "".join(f"[{i}]" for i in seq)
        if mark in left:
            left = left.replace(mark, "|")
            out += [name] if name not in out else []
    return len(ids), ",".join(ids), ",".join(out), left.count("[")


def check(docs):
    got = sorted((repr(r.doc_id), r.n_known, r.sentence_ids, r.licences, r.n_unread) for r in L.recognise(docs).collect())
    assert got == sorted((repr(r.doc_id), *replay(r.text)) for r in docs.collect())


def test_tables(plain, odd, none):
    check(plain)
    check(odd)
    check(none)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_whole_licences(spark):
    rows = [(1, MIT), (2, "Word.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. More."),
            (3, "# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY"),
            (4, "See the GNU General Public License for more details. All rights reserved. All rights reserved."),
            (5, "released under the mit license maybe")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(docs)
    got = {r.doc_id: (r.licences, r.n_unread) for r in L.recognise(docs).collect()}
    assert got[1] == ("MIT", 0) and got[2] == ("CC-BY-NC-4.0,MIT", 0) and got[4] == ("Proprietary", 1) and got[5] == ("", 0)


def test_tables_agree():
    ids = [i for i, _ in L.SENTENCES]
    assert len(set(ids)) == len(ids) and all(set(seq) <= set(ids) for _, seq in L.RULES)
    assert all(re.sub("[^a-z0-9]+", " ", s).strip() == s for _, s in L.SENTENCES)
