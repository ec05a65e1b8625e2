import random

from callspark.llm.license_scan import COVER, GAP, GRAM, PHRASES, STRETCH, TEMPLATES, scan_licenses
from tests.llm import brute


def _want(text):
    words = brute.alnum_words(text)
    places = [(k, label) for label, phrase in PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_base_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["under", "the", "MIT", "license", "Apache", "License", "Version", "2", "cc", "BY-NC", "by", "nc", "under the mit license", "Apache License, Version 2.0", "CC BY-NC", "mit licenſe", "by nć", "K", "İ", "été", "x"]
    docs = [(k, rng.choice([" ", "\n", "--"]).join(rng.choice(parts) for _ in range(rng.randrange(30)))) for k in range(300)]
    docs += [(900, None), (901, ""), (902, "..."), (903, "cc"), (904, "CC BY NC " * 5000), (905, "cc bK nc"), (905, "cc bK nc"), (905, "cc by nc"), (None, "under the mit license")]
    rows = scan_licenses(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, label string, n int")).collect()
    got = sorted((str(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in rows)
    assert got == sorted((str(i), *map(str, _want(t))) for i, t in docs)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in rows)


def test_texts_with_changes_are_found(spark):
    docs = [
        (1, "x y z. Permission is hereby granted, free of charge, to any person or body obtaining a copy of this software and associated files (the 'Software'), to deal in the Software without restriction"),
        (2, "Redistribution in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: a b c"),
        (3, "permission is hereby granted to leave the room"),
    ]
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (rows[1].labels, rows[2].labels, rows[3].labels) == ("mit", "bsd", "") and rows[1].n_base == 0 and 0.6 <= rows[1].score < 1


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _shares(text):
    """(label, largest share) of each template, by all windows of all spans of merged diagonals."""
    words, out = brute.alnum_words(text), []
    for label, template in (*PHRASES, *TEMPLATES):
        own = template.split()
        size, extent = len(own) - GRAM + 1, int(STRETCH * len(own))
        hits = [(p, t) for p in range(len(words) - GRAM + 1) for t in range(size) if words[p : p + GRAM] == own[t : t + GRAM]]
        spans, last = [], None
        for p, t in sorted(hits, key=lambda x: x[0] - x[1]):
            if last is None or p - t - last > GAP:
                spans.append([])
            last = p - t
            spans[-1].append((p, t))
        most = 0
        for span in spans:
            for start in {p for p, _ in span}:
                best = {}
                for p, t in sorted((x for x in span if start <= x[0] <= start + extent - GRAM), key=lambda x: (x[0], -x[1])):
                    best[t] = max(best.get(t, 0), 1 + max((v for k, v in best.items() if k < t), default=0))
                most = max(most, max(best.values(), default=0))
        out.append((label, most / size))
    return out


def test_labels_and_score_against_brute_force(spark):
    rng, docs = random.Random(7), []
    for k in range(160):
        words = []
        for _ in range(rng.randrange(1, 4)):
            own = rng.choice(TEMPLATES)[1].split()
            a = rng.randrange(len(own))
            own = own[a : a + rng.randrange(5, 40)]
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randrange(2)] = rng.choice([[], ["other"], ["some", "more", "words"]])
            words += own + ["filler"] * rng.randrange(4)
        docs.append((k, " ".join(words)))
    docs.append((500, " ".join(t for _, t in TEMPLATES) * 3))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        shares, base = _shares(text), _want(text)[4]
        labels = {label for label, share in shares if share >= COVER} | set(filter(None, base.split(",")))
        assert got[i] == (",".join(sorted(labels)), round(max(x for _, x in shares), 9)), text


def test_scattered_grams_are_no_license(spark):
    own = TEMPLATES[0][1].split()
    grams = [own[k : k + 3] for k in range(len(own) - 2)]
    docs = [(1, " ".join(" ".join(g) for g in grams)), (2, " foreign ".join(" ".join(g) for g in grams)), (3, " ".join(" ".join(g) for g in reversed(grams))), (4, " ".join(own))]
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k].labels for k in (1, 2, 3, 4)] == ["", "", "", "mit"] and rows[4].score == 1.0 and all(rows[k].score < COVER for k in (1, 2, 3))
