"""Labels equal a plain chain, long texts too; texts of no learned language are told by their evidence."""

from __future__ import annotations

import random
import re

import numpy as np

from framelake.llm import langid_crf

SF = "/root/testdata/sf0.001"


def plain(model, text: str) -> np.ndarray:
    """Marginals by the textbook recursion, word by word."""
    words = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
    scores = []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        kinds, of, codes, begin = langid_crf.word_types(raw, np.array([0]), np.array([len(raw)]))
        scores.append(langid_crf.emissions(model, kinds, codes, begin)[0].astype(float))
    e, move = np.exp(np.array(scores) - np.max(scores, 1, keepdims=True)), np.exp(model.move)
    alpha, beta = [np.exp(model.start) * e[0]], [np.ones(len(model.langs))]
    for x in e[1:]:
        a = (alpha[-1] @ move) * x
        alpha.append(a / a.sum())
    for x in e[:0:-1]:
        b = move @ (x * beta[-1])
        beta.append(b / b.sum())
    out = np.array(alpha) * np.array(beta[::-1])
    return out / out.sum(1, keepdims=True)


def test_labels_equal_a_plain_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid_crf.fit(docs, 30)
    texts = [r.text for r in docs.orderBy("doc_id").limit(12).collect() if r.text] + [" ".join(r.text for r in docs.orderBy("doc_id").limit(40).collect() if r.text) * 12]
    assert len(texts[-1].encode()) > langid_crf.STEP // 2
    for text in texts:
        data = text.lower().encode()
        want = plain(model, text)
        for step in (1 << 20, 3000):
            langid_crf.STEP, was = step, langid_crf.STEP
            got = list(langid_crf._marginals(model, np.frombuffer(data, np.uint8), np.array([0, len(data)])))
            langid_crf.STEP = was
            assert np.allclose(np.concatenate([g for g, _, _ in got]), want, atol=1e-6)
        assert len(got) == 1 or step == 3000


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(3)
    gibberish = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(120)) for _ in range(20)]
    other = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 6, "vaʻa ʻoku ngaahi ʻaho kotoa pē ʻoku hauʻ mai ki heni xhosa uqhagamshelwano lwethu qgirha " * 4]
    one = r.choice([t for (t,) in docs.where("lang = 'de'").select("text").collect() if t and len(t) > 300])
    two = r.choice([t for (t,) in docs.where("lang = 'fr'").select("text").collect() if t and len(t) > 300])
    more = spark.createDataFrame([*((10_000 + i, t, None) for i, t in enumerate(gibberish)), *((20_000 + i, t, None) for i, t in enumerate(other)), (30_000, one[:300] + " " + two[:300], None)], docs.schema)
    kept = {x.doc_id for x in langid_crf.identified(docs.union(more)).collect()}
    assert not kept & set(range(10_000, 30_000)) and 30_000 in kept
    clean = {x.doc_id for x in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").select("doc_id").collect()}
    assert clean <= kept
