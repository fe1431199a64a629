"""License notices that are wrapped over lines, against brute force."""

from __future__ import annotations

import random
import re

from framelake.llm import licenses

WORD = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
MIT = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\")\n */"
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
APACHE = "you may not use this file except in compliance\r\nwith the License. You may obtain a copy of\r\nthe License at"
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3"


def brute(text: str, templates: tuple[tuple[str, str], ...] = licenses.TEMPLATES) -> tuple[set[str], float]:
    """Labels and largest containment of all lines, and of all runs of 5 / 4 of a template's words within lines that have words."""
    parts, lines = [[]], [WORD.findall(line.lower()) for line in text.split("\n")]
    for words in lines:
        if words:
            parts[-1] += words
        else:
            parts.append([])
    labels, best = set(), 0.0
    for label, wording in templates:
        want, n = set(wording.split()), -(-5 * len(wording.split()) // 4)
        runs = lines + [part[i : i + n] for part in parts for i in range(len(part))]
        share = max(len(want & set(run)) / len(want) for run in runs)
        if share >= 0.8 - 1e-9:
            labels.add(label)
            best = max(best, share)
    return labels, best


def test_wrapped_notices(spark):
    rng = random.Random(4)
    vocabulary = [w for _, text in licenses.TEMPLATES for w in text.split()] + ["stone", "river", "cloud"]
    texts = [MIT, BSD, APACHE, GPL, "all rights\n\nreserved", "all rights\nreserved", "all\n" + "stone " * 9 + "\nrights reserved"]
    texts += ["stone river\n" * 90 + MIT + "\ncloud" * 90, "stone " * 77 + "\n" + GPL]
    for _ in range(150):
        words = [w for _ in range(rng.randint(1, 4)) for w in [*rng.choices(vocabulary, k=rng.randint(0, 45)), *(x for x in rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.9)]]
        texts.append("".join(w + rng.choice(("\n", "\n\n", *" " * 9)) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    for i, label in enumerate(("mit-text", "bsd", "apache-2.0", "gpl-notice")):
        assert label in got[i].template_labels
    assert not got[4].template_labels and got[5].template_labels == ["all-rights-reserved"] and not got[6].template_labels
    for i, text in enumerate(texts):
        labels, best = brute(text)
        assert got[i].template_labels == sorted(labels)
        assert got[i].n_base or abs(got[i].score - best) < 1e-9


def test_whole_licenses(spark):
    """Each full wording, wrapped after every ninth word, with some words missing, and cut below the threshold."""
    whole = [(label, wording.split()) for label, wording in licenses.TEMPLATES if len(wording.split()) > 50]
    assert len(whole) == 4
    wrap = lambda words: "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    texts = [wrap(["stone"] * 40 + form + ["river"] * 300) for _, words in whole for form in (words, [w for i, w in enumerate(words) if i % 12], words[: len(words) // 2])]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        labels, best = brute(text)
        assert got[i].template_labels == sorted(labels) and (whole[i // 3][0] in labels) == (i % 3 < 2)
        assert got[i].n_base or abs(got[i].score - best) < 1e-9


def test_hundreds_of_templates(spark):
    """Templates that share frequent words and most of their rare ones."""
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    templates = tuple((f"t{i}", " ".join(rng.sample(common, rng.randint(2, 12)) + rng.sample(rare[i : i + 12], rng.randint(1, 6)))) for i in range(300))
    templates += tuple((f"u{i}", " ".join([w for w in wording.split() if rng.random() < 0.9] + ["extra"])) for i, (_, wording) in enumerate(templates[:40]))
    texts = []
    for _ in range(60):
        words = [w for _ in range(rng.randint(0, 3)) for w in [*rng.choices(common + rare, k=rng.randint(0, 30)), *(x for x in rng.choice(templates)[1].split() if rng.random() < 0.9)]]
        texts.append("".join(w + rng.choice(("\n", "\n\n", *" " * 9)) for w in words))
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    hits = 0
    for i, text in enumerate(texts):
        labels, best = brute(text, templates)
        hits += len(labels)
        assert got[i].template_labels == sorted(labels)
        assert abs(got[i].score - (best if labels else 0.0)) < 1e-9
    assert hits > 40
