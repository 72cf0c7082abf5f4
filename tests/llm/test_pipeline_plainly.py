"""The whole pipeline against plain Python: the same decisions row by row, without Spark."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.test_near_dup import brute, edited
from tests.llm.test_search_and_filters import edit_best
from timelore.llm import decontaminate, quality_crf
from timelore.llm.queries import tokenizer_path


def raked(cells, rate=0.6, temper=0.7):
    """Probabilities of (source, lang, topic): one factor for each value, found by halving, rounds until nothing moves."""
    keys, most = list(cells), np.array([cells[k] for k in cells], float)
    total = most.sum()
    goals = []
    for m in range(3):
        values = sorted({k[m] for k in keys})
        n = np.array([most[[k[m] == v for k in keys]].sum() for v in values])
        want = n**temper / (n**temper).sum()
        low, high = 0.0, 1e6 * total
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(want * mid, n).sum() < rate * total else (low, mid)
        goals.append(dict(zip(values, np.minimum(want * high, n))))
    want = rate * most
    for _ in range(300):
        for m in range(3):
            for v, goal in goals[m].items():
                at = np.array([k[m] == v for k in keys])
                low, high = 0.0, 1e9
                for _ in range(120):
                    mid = (low + high) / 2
                    low, high = (mid, high) if np.minimum(want[at] * mid, most[at]).sum() < goal * (1 - 1e-13) else (low, mid)
                want[at] *= min(high, 1e8)
    return dict(zip(keys, np.minimum(want, most) / most))


def topic(text):
    found = [("table", " | "), ("contact", "@"), ("links", "http://"), ("links", "https://"), ("legal", "icense"), ("legal", "opyright"), ("noise", "!!"), ("noise", "***")]
    return next((name for name, mark in found if mark in text), "prose")


def test_pipeline_equals_plain_steps(spark, tmp_path):
    rng = random.Random(7)
    item = words(900, 30)
    texts = [words(i, rng.randint(40, 90)) + ".\n" + words(500 + i, 30) + rng.choice(["", " a@b", " | c", " license"]) for i in range(70)]
    texts += [edited(texts[k], rng, 1) for k in range(8)] + [texts[9], texts[10].upper()]
    texts += ["pre " + edited(item, rng, 2) + " post " + words(70 + k, 40) for k in range(4)] + [(words(600 + i, 30).upper() + "!! ") * 3 for i in range(40)] + ["", None]
    rows = [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0 if t and "!!" in t else 1, 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality_crf.fit(docs, labels)
    kept = [r for r in rows if model.scores([r[1] or ""])[0] >= quality_crf.GOOD_FROM]
    assert 0 < len(kept) < len(rows)
    classes = brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if classes[r[0]] == r[0]]
    pattern = decontaminate.words_of(item)
    leaks = [r for r in kept if r[1] and edit_best(pattern, decontaminate.words_of(r[1])) <= int(0.2 * len(pattern))]
    assert len(leaks) >= 3
    kept = [r for r in kept if r not in leaks]
    tokens = {r[0]: 0 if not r[1] else 1 + sum(c in " \n\t" for c in r[1]) for r in kept}
    cell = {r[0]: (r[3] or "<null>", r[2], topic(r[1] or "")) for r in kept}
    cells = Counter()
    for r in kept:
        cells[cell[r[0]]] += tokens[r[0]]
    chance = raked({k: n for k, n in cells.items() if n})
    u = lambda i: int(hashlib.md5(f"{i}mix".encode()).hexdigest()[:8], 16) / 2**32
    kept = [r for r in kept if u(r[0]) < (1.0 if tokens[r[0]] == 0 else chance[cell[r[0]]])]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for r in sorted(kept):
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
