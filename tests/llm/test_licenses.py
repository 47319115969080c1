from brute import words
from packwright.llm import licenses
from packwright.llm.notices import FULL_NOTICES

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
TEXTS = [
    "x CC-BY y. cc by CC BY ccby", "GNU General  Public-License, all rights\nreserved ALL RIGHTS RESERVED", "all rights were reserved",
    MIT, MIT.replace("free of charge, ", ""), " ".join(MIT.split()[:4]), "Licensed under CC BY-NC 4.0.", "",
]


def places(text):
    w = words(text)
    return sorted((i, label) for p, label in licenses.BASE_PHRASES.items() for n in [len(p.split())] for i in range(len(w)) if w[i : i + n] == p.split())


def test_base_places_are_all_there(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in licenses.scan_licenses(docs).collect():
        assert r.n_words == len(words(TEXTS[r.doc_id]))
        assert sorted((s["first"], s["label"]) for s in r.spans if s["base"]) == places(TEXTS[r.doc_id])


def test_notices_with_words_changed_are_one_span(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    own = {r.doc_id: [(s["label"], round(s["score"], 2), s["first"], s["last"]) for s in r.spans if not s["base"]] for r in licenses.scan_licenses(docs).collect()}
    assert own[3] == [("mit", 1.0, 0, 19)]
    assert [(label, first) for label, _, first, _ in own[4]] == [("mit", 0)] and 0.6 <= own[4][0][1] < 1
    assert own[5] == [] and [label for label, *_ in own[6]] == ["cc-by-nc-4.0"]


def test_report(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.report(licenses.scan_licenses(docs)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 7, "gpl,reserved")
    assert (got[6].base_labels, got[6].labels, got[6].score) == ("cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert (got[7].n_words, got[7].n_base, got[7].first_word, got[7].labels, got[7].score) == (0, 0, None, "", 0.0)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = licenses.scan_licenses(edge_docs).collect()
    key = lambda i, n: (i is not None, i or 0, n)
    assert sorted(key(r.doc_id, r.n_words) for r in got) == sorted(key(i, len(words(t))) for i, t in edge_rows)
    assert licenses.report(licenses.scan_licenses(no_docs)).collect() == []


def slow_votes(text):
    """(label, first, last, score) of own spans by comparing all words at all places."""
    found, params, w = [], licenses.Params(), words(text)
    for phrase, label, base, k in licenses.templates(params):
        t = phrase.split()
        places = {}
        for o in range(len(t) - k + 1):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == t[o : o + k]:
                    places.setdefault(i - o, []).append((i, o))
        clusters = []
        for d in sorted(places):
            if clusters and d - last <= params.reach:
                clusters[-1] += places[d]
            else:
                clusters.append(list(places[d]))
            last = d
        for c in clusters:
            score = len({o for _, o in c}) / (len(t) - k + 1)
            if not base and score >= params.least:
                found.append((label, min(i for i, _ in c), max(i for i, _ in c) + k - 1, round(score, 9)))
    return sorted(found)


def changed(text, every):
    """Each so-many-th word replaced; a word put in front of some, others left out."""
    w = text.split()
    return " ".join(f"x{i}" if i % every == 0 else f"new {a}" if i % 41 == 1 else "" if i % 53 == 2 else a for i, a in enumerate(w))


def test_whole_notices_against_all_places(spark):
    texts = {}
    for label, text in FULL_NOTICES.items():
        half = " ".join(text.split()[: len(text.split()) // 2])
        for kind in (text, text.upper(), "Copyright (c) 2020 Some One. " + changed(text, 37), changed(text, 4), half, "/* " + text.replace("\n", "\n * ") + " */ code()"):
            texts[len(texts)] = (label, kind)
    texts[len(texts)] = ("mit", FULL_NOTICES["isc"] + " between " + FULL_NOTICES["mit"] + FULL_NOTICES["mit"])
    docs = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id bigint, text string")
    got = {r.doc_id: sorted((s["label"], s["first"], s["last"], round(s["score"], 9)) for s in r.spans if not s["base"]) for r in licenses.scan_licenses(docs).collect()}
    for i, (label, text) in texts.items():
        assert got[i] == slow_votes(text)
        full = [s for s in got[i] if s[0] == label]
        assert i % 6 in (3, 4) or full
    assert [s[0] for s in got[len(texts) - 1]].count("isc") == 1 and [s[0] for s in got[len(texts) - 1]].count("mit") >= 2
