import random
import re
import time

import pytest
from helpers import AWKWARD, awkward, empty

from lattica.llm import licenses as X
from lattica.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def base(text):
    w, places, labels = WORD.findall((text or "").translate(UP)), [], set()
    for phrase, label in X.BASE:
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def resolve(text):
    """Labels that stay and their score, the slow way."""
    low = text.lower()
    found = [(m.start(), -m.end(), r.priority, r.label, r.weight) for r in X.rules() if r.keyword in low and (r.keyword not in X._GATES or re.search(X._GATES[r.keyword], low)) for m in re.finditer(r.pattern, low)]
    found.sort()
    stay = [d for i, d in enumerate(found) if not any(e[2] <= d[2] and e[1] <= d[1] for e in found[:i])]
    miss = 1.0
    for d in stay:
        miss *= 1 - d[4]
    return {d[3] for d in stay}, 1 - miss if stay else 0.0


CASES = {
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
    "GNU Lesser General Public License v2.1": {"gpl", "lgpl-2.1"},
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
    "see https://creativecommons.org/licenses/by-sa/3.0/": {"cc-by-sa-3.0"},
    "Released under the MIT License.": {"mit"},
    "mit und ohne": set(),
    "Copyright (c) 2020 Someone. All Rights Reserved.": {"copyright", "reserved"},
    "BSD 3-Clause": {"bsd-3-clause"},
    "licensed under the terms of Foo-1.0": {"unknown-license"},
}


def test_labels(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r for r in X.scan_licenses(df).collect()}
    for i, (text, want) in enumerate(CASES.items()):
        assert got[i].labels == ",".join(sorted(want)), text
        labels, score = resolve(text)
        assert want == labels | set(filter(None, base(text)[4].split(",")))
        assert got[i].score == pytest.approx(score) and (got[i].score > 0) == bool(labels)


TEXTS = {
    "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated documentation files": "mit",
    "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions": "bsd",
    "Unless required by applicable law or agreed to in writing, software\n// distributed under the License": "apache-2.0",
    "either version 3 of the License, or (at your option) any later version": "gpl-3.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "The Software shall be used for Good, not Evil.": "json",
    "\u201cThe origin of this software must not be misrepresented\u201d": "zlib",
    "Unauthorized copying of this file, via any medium is strictly prohibited": "proprietary",
    "You may not reverse engineer, decompile, or disassemble": "proprietary",
    "Tous droits r\u00e9serv\u00e9s": "reserved",
}


def test_wordings(spark):
    """Wordings of license texts, as they stand in comments and with odd punctuation."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in X.scan_licenses(df).collect():
        text, want = list(TEXTS.items())[r.doc_id]
        assert want in r.labels.split(","), (text, r.labels)
        assert r.score == pytest.approx(resolve(text)[1]), text


def test_many_matches_in_one_text(spark):
    """50,000 matches take seconds and give what the slow resolver gives of as many kinds."""
    few = "all rights reserved, licensed under the MIT license; copyright 2020 copyrighted cc by 4.0 gpl v3 " * 40
    many = "all rights reserved " * 50_000 + few
    df = spark.createDataFrame([(1, few), (2, many), (3, "x")], "doc_id long, text string")
    X.scan_licenses(df.where("doc_id = 3")).collect()
    began = time.time()
    got = {r.doc_id: r for r in X.scan_licenses(df).collect()}
    assert time.time() - began < 20
    labels, score = resolve(few)
    assert set(got[1].labels.split(",")) == labels | {"reserved", "cc-by"} == set(got[2].labels.split(",")) and got[1].score == pytest.approx(score)
    assert got[2].n_base == 50_000 + got[1].n_base


@pytest.mark.parametrize("copies", [1, 63, 64, 65, 200])
def test_places_across_blocks(spark, copies):
    """Overlapping detections far into a text are resolved by their places."""
    text = "copyright 2020 " * copies + "GNU Lesser General Public License v2.1 " * copies
    got = X.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    labels, score = resolve(text)
    assert set(got.labels.split(",")) == labels | {"gpl"} and got.score == pytest.approx(score)


def test_rule_table():
    rules = X.rules()
    assert len(rules) >= 300 and len({r.name for r in rules}) == len(rules)
    assert [r.priority for r in rules] == sorted(r.priority for r in rules)
    for r in rules:
        assert not re.compile(r.pattern).search(""), r


def test_awkward_rows(spark):
    extra = [(20, "cc\x00by cc--BY ccby cc by1 xcc by", "", ""), (21, "all rights reserved " * 300, "", ""), (22, "General  PUBLIC\nLicense all\u00a0rights reserved", "", "")]
    df = spark.createDataFrame([*AWKWARD, *extra], "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS raw", "2 AS low", "3 AS found", "4 AS base")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in X.scan_licenses(df).collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t, *_ in [*AWKWARD, *extra]), key=repr)
    assert X.scan_licenses(empty(spark)).count() == 0 and X.scan_licenses(awkward(spark)).count() == len(AWKWARD)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_licenses(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        labels, score = resolve(texts[r.doc_id] or "")
        assert r.labels == ",".join(sorted(labels | set(filter(None, r.base_labels.split(","))))) and r.score == pytest.approx(score)


def test_native(spark):
    plan = X.scan_licenses(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def example(rng, parsed):
    """A random string that the parsed pattern matches; what stands around it is not asked."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind = arg[0][0]
            simple = [chr(v) if str(o) == "LITERAL" else chr(rng.randint(*v)) for o, v in arg if str(o) in ("LITERAL", "RANGE")]
            out += rng.choice(" -,\n") if str(kind) == "NEGATE" else rng.choice(simple or ["w"])
        elif op == "BRANCH":
            out += example(rng, rng.choice(arg[1]))
        elif op == "SUBPATTERN":
            out += example(rng, arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(example(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_keywords_and_gates_are_implied():
    rng, gate = random.Random(1), X.opening(X.rules())
    for r in X.rules():
        parsed = re._parser.parse(r.pattern)
        for _ in range(30):
            text = example(rng, parsed)
            if re.search(r.pattern, text):
                assert re.search(gate, text), (r, text)
                assert r.keyword in text and re.search(X._GATES.get(r.keyword, ""), text), (r, text)


def test_no_keyword_hides_a_match(spark):
    texts = {
        "It may not be copied without permission.": "proprietary",
        "Must not be distributed to anyone.": "proprietary",
        "may not be reproduced in part": "proprietary",
        "Released under Foo-1.0": "unknown-license",
        "distributed under the terms of the foo": "unknown-license",
        "See COPYING for details.": "unknown-license",
        "see the file copying for more information": "unknown-license",
        "It may not be seen, under no rule": "",
    }
    for text in texts:
        found = sorted((m.start(), -m.end(), r.priority, r.label) for r in X.rules() for m in re.finditer(r.pattern, text.lower()))
        assert {d[3] for d in found} == set(filter(None, [texts[text]])), text
    got = X.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert [(r.labels, r.score) for r in sorted(got, key=lambda r: r.doc_id)] == [(w, {"": 0.0, "proprietary": 0.5, "unknown-license": 0.4}[w]) for w in texts.values()]


def test_query_against_every_regex(spark):
    """As the brute force above, with no keyword and no gate at all."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_licenses(spark, sf).collect():
        low = (texts[r.doc_id] or "").lower()
        found = sorted((m.start(), -m.end(), p.priority, p.label) for p in X.rules() for m in re.finditer(p.pattern, low))
        stay = {d[3] for i, d in enumerate(found) if not any(e[2] <= d[2] and e[1] <= d[1] for e in found[:i])}
        assert r.labels == ",".join(sorted(stay | set(filter(None, r.base_labels.split(",")))))
