"""Decontamination, neighbours, WARC, mixture, URL tree, pipeline."""

import base64
import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from timelore.llm import ann, decontaminate, mixing, token_codes, url_tree, warc
from timelore.llm.common import fresh_path, table
from tests.llm.conftest import words

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- decontamination


def edit_best(pattern, text):
    """Smallest edit distance of the pattern to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=90), st.lists(st.sampled_from("abcd"), max_size=120))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(pattern, text):
    assert decontaminate.Pattern(pattern).best(text)[0] == min(edit_best(pattern, text), len(pattern))


def test_matches_equal_brute_force():
    rng = random.Random(1)
    items = [(i, words(i, rng.randint(1, 40))) for i in range(12)] + [(50, ""), (51, "a b c d e"), (52, "two words"), (53, "one")]
    matcher = decontaminate.Matcher(items)
    for d in range(60):
        w = words(1000 + d, 60).split()
        i, text = rng.choice(items)
        leak = text.split()
        for _ in range(rng.randint(0, 1 + len(leak) // 3)):
            if leak:
                k = rng.randrange(len(leak))
                leak[k : k + 1] = rng.choice([[], ["new"], [leak[k], "more"]])
        at = rng.randrange(len(w))
        doc = w[:at] + leak + w[at:]
        want = {}
        for item, t in items:
            m = t.split()
            if m and (e := edit_best(m, doc)) <= int(0.2 * len(m)):
                want[item] = e
        assert {x[0]: x[1] for x in matcher.matches(" ".join(doc).upper() + "!")} == want


def test_leaks_in_blocks_and_hard_inputs(spark, hard_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, words(900, 30)), (2, None), (3, "x"), (4, words(901, 20)), (4, words(901, 20)), (None, words(902, 25))], "item_id long, text string")
    docs = hard_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(70, "pre " + words(900, 30) + " post"), (71, words(902, 25)), (72, words(901, 20)[3:])], "doc_id long, text string")).withColumn("_leaked", F.lit(1))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == {(8, 3), (70, 1), (71, None), (72, 4)}  # document 8 has the word x
    short = decontaminate.find_leaks(spark.createDataFrame([(1, "an X here"), (2, "an xx here")], "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in short] == [(1, 3, 0)]
    assert decontaminate.find_leaks(spark.createDataFrame([(1, "an X here")], "doc_id long, text string"), bench, min_words=5).isEmpty()
    two = spark.createDataFrame([(None, "pre " + words(900, 30)), (None, "clean")], "doc_id long, text string")
    assert [r.text for r in decontaminate.decontaminate(two, bench).collect()] == ["clean"]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.find_leaks(no_docs, bench).collect() == []


# ---------------------------------------------------------------- neighbours


def test_tables_find_every_code_in_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**63, (3000, ann.TURNS), dtype=np.uint64)
    codes[1:40] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, (39, ann.TURNS), dtype=np.uint64))
    codes[40:200] = codes[0] ^ (rng.integers(0, 2**63, (160, ann.TURNS), dtype=np.uint64) & rng.integers(0, 2**63, (160, ann.TURNS), dtype=np.uint64))
    tables = ann.SubstringTables(codes)
    for radius in (0, 3, 9, 20, 35, 50):
        got = tables.within(codes[0], radius, ann.probes(radius // ann.PARTS))
        assert got.tolist() == np.flatnonzero(ann.hamming(codes, codes[0]) <= radius).tolist()


def test_recall_and_scores(spark):
    got = ann.search(table(spark, "/root/testdata/sf0.1", "embeddings")).toPandas()
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").toPandas()
    v = np.array(rows.embedding.tolist(), float)
    ids, hit, total = rows.vec_id.to_numpy(), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (v * v[q]).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((v[q] * v[q]).sum()))
        s[q] = -2
        top = np.lexsort((ids, -s))[:5]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert len(mine) == 5 and np.abs(mine.score - s[np.searchsorted(ids, mine.vec_id)]).max() == 0
        hit += len(set(mine.vec_id) & set(ids[top]))
        total += 5
    assert hit / total >= 0.9


def test_few_rows_are_probed_where_neighbours_are_near():
    """Vectors in groups: the neighbours are found, and a tenth of the rows at most is looked at."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(400, 64))
    v = np.repeat(centres, 10, axis=0) + 0.08 * rng.normal(size=(4_000, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    codes = ann.learn(v[::2], 4, 0.97)
    own = codes.of(unit)
    tables, masks = ann.SubstringTables(own), ann.probes(codes.radius // ann.PARTS)
    probed, hit = 0, 0
    for i in range(0, 4_000, 50):
        probed += len(tables.probed(own[i], masks))
        near = set(np.argsort(-(unit @ unit[i]))[:10].tolist())
        hit += len(near & set(tables.within(own[i], codes.radius, masks).tolist()))
    assert probed / 80 / 4_000 < 0.1 and hit / 800 > 0.9


def test_several_blocks_and_widened_radius(spark, monkeypatch):
    """Blocks of either kind don't change the result, and queries far from all get their k by a wider radius."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(600, 8)), -50 * np.ones((1, 8))])
    rows = [(i if i < 600 else 5_000, x) for i, x in enumerate(v.tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(map(tuple, ann.search(t, target=0.6).collect()))
    monkeypatch.setattr(ann, "INDEX_BLOCK", 70)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    assert sorted(map(tuple, ann.search(t, target=0.6).collect())) == whole
    assert len(whole) == 13 * 5 and sum(r[0] == 5_000 for r in whole) == 5


def test_neighbour_hard_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [nan, 1.0, 0.0], 1), (6, [inf, 1.0, 0.0], 1), (7, [None, 1.0, 0.0], 1), (8, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (9, [], 1), (None, [1.0, 1.0, 0.0], 1), (10, [0.0, 1.0, 0.0], 1), (10, [0.0, 1.0, 0.0], 2), (50, [1.0, 1.0, 0.0], 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    got = {q: [(r.vec_id, round(r.score, 9)) for r in g] for q, g in _by(ann.search(t).orderBy("query_id", "rank").collect()).items()}
    assert got == {0: [(1, 1.0), (2, 1.0), (50, round(0.5**0.5, 9)), (10, 0.0)], 50: [(x, round(0.5**0.5, 9)) for x in (0, 1, 2, 10)], 100: [(8, 1.0)]}
    assert ann.search(t.limit(0)).collect() == []


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(r)
    return out


# ---------------------------------------------------------------- WARC


def test_archive_round_trip(spark):
    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, "same"), (4, "u", ""), (5, "u", None), (6, "u\r\nx: y", "a\r\n\r\nb\r\n\r\n"), (7, "u", "é" * 9000), (None, "n", "same"), (None, "n", "alone"), (8, "u", "twice"), (8, "u", "twice")]
    t = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    path = warc.write_archive(t, fresh_path(spark, "w"))
    rows = warc.reconstruct(spark, path).collect()
    assert len(rows) == len(pages)
    texts = {}
    for i, _, h in pages:
        texts.setdefault(i, set()).add((h or "").encode())
    kinds = {}
    for r in rows:
        header, payload = bytes(r.record).split(b"\r\n\r\n", 1)
        payload = payload[:-4]
        assert payload in texts[r.page_id] and r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kinds.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert kinds[1] == kinds[2] == [("revisit", 3)] and kinds[3] == [("response", None)] and kinds[4] == [("revisit", 5)]
    assert sorted(kinds[8], key=str) == [("response", None), ("revisit", 8)] and sorted(kinds[None], key=str) == [("response", None), ("revisit", 3)]
    stored = warc.read_warc(spark, path).collect()
    assert sorted(bytes(r.payload) for r in stored if "WARC-Type: response" in r.header) == sorted({(h or "").encode() for _, _, h in pages})
    assert warc.archive_and_read(t.limit(0)).collect() == []
    assert {r.record_type for r in warc.archive_and_read(t, min_bytes=10**6).collect()} == {"response"}


def rewritten(spark, path, change):
    """The archive's only WARC file with its records changed, written as it was."""
    row = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(f"{path}/warc").collect()[0]
    changed = b"".join(gzip.compress(change(x)) for _, x in warc.members(bytes(row.content)))
    with open(row.path.removeprefix("file:"), "wb") as f:
        f.write(changed)
    crc = os.path.join(os.path.dirname(row.path.removeprefix("file:")), "." + os.path.basename(row.path) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)


@pytest.mark.parametrize("change, message", [
    (lambda x: x.replace(b"some text", b"same text"), "payload differs from its digest"),
    (lambda x: x.replace(b"Content-Length", b"Content-Size"), "states no Content-Length"),
    (lambda x: x.replace(b"some text", b"text"), "doesn't end after 9 bytes"),
    (lambda x: x.replace(b"\r\n\r\n", b"\n"), "the header has no end"),
])
def test_broken_payload_is_noticed(spark, change, message):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string"), fresh_path(spark, "w"))
    assert bytes(warc.reconstruct(spark, path).first().record).endswith(b"some text\r\n\r\n")
    rewritten(spark, path, change)
    with pytest.raises(Exception, match=message):
        warc.reconstruct(spark, path).collect()


def test_files_are_bounded_and_every_row_has_a_record(spark, monkeypatch):
    """Files end after FILE_BYTES; gzip reads them as one stream; a large payload is one record; a cut file is an error."""
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000)
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefgh<>é") for _ in range(300_000))
    rows = [(i, "u", "".join(rng.choice("abcdef ") for _ in range(500))) for i in range(40)] + [(40, "u", big), (41, "v", big), (41, "v", big), (None, None, None)]
    path = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), fresh_path(spark, "w"))
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(f"{path}/warc").collect()]
    assert len(files) > 5 and sum(len(f) > 3_000 for f in files) <= 1
    assert sum(gzip.decompress(f).count(b"WARC-Record-ID: ") for f in files) == len(rows)
    back = {r.page_id: bytes(r.record) for r in warc.reconstruct(spark, path).collect()}
    assert all(back[i].split(b"\r\n\r\n", 1)[1] == (h or "").encode() + b"\r\n\r\n" for i, _, h in rows)
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(files[0][:-30]))


# ---------------------------------------------------------------- mixture


def test_raking_meets_all_marginals(spark):
    cells = spark.createDataFrame([(s, l, t, 10 + 7 * i) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xyz" for t in "pq")], "_source string, _lang string, _topic string, tokens long")
    goals = {m: spark.createDataFrame([(v, 1 / len(vs)) for v in vs], f"_{m} string, target_{m} double") for m, vs in (("source", "ab"), ("lang", "xyz"), ("topic", "pq"))}
    got = mixing.rake(cells, goals, 12).toPandas()
    for m, n in (("_source", 2), ("_lang", 3), ("_topic", 2)):
        assert np.allclose(got.groupby(m).weight.sum(), 1 / n, atol=1e-6)


def test_sample_follows_the_targets(spark):
    rows = [(i, "w " * 49 + "w", "en" if i % 10 else "de", "big" if i % 3 else "small", 100) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    goal = spark.createDataFrame([("big", 0.5), ("small", 0.5)], "v string, s double")
    got = mixing.mixed(docs, rate=0.4, targets={"source": goal}, temper=1.0).toPandas()
    assert abs(len(got) / 6000 - 0.4) < 0.03 and abs((got.source == "big").mean() - 0.5) < 0.03 and abs((got.lang == "de").mean() - 0.1) < 0.03


def test_kept_tokens_have_the_target_shares_where_cells_are_full(spark):
    tokens = {"anx": 2000, "any": 40, "apx": 300, "apy": 60, "bnx": 500, "bny": 700, "bpx": 20, "bpy": 1380}
    factor = {"a": 0.5, "b": 1.2, "n": 0.6, "p": 1.1, "x": 0.9, "y": 1.7}
    want = {k: n * min(1.0, factor[k[0]] * factor[k[1]] * factor[k[2]]) for k, n in tokens.items()}
    whole = sum(want.values())
    goals = {m: {v: sum(w for k, w in want.items() if k[i] == v) / whole for v in vs} for i, (m, vs) in enumerate((("source", "ab"), ("lang", "np"), ("topic", "xy")))}
    cells = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "_source string, _lang string, _topic string, tokens long")
    frames = {m: spark.createDataFrame(list(g.items()), f"_{m} string, target_{m} double") for m, g in goals.items()}
    got = mixing.bounded_rake(cells, frames, whole / 5000, 8).toPandas()
    kept = got.tokens * got.probability
    assert (got.probability >= 1).sum() == 3 and got.probability.max() <= 1 and abs(kept.sum() / whole - 1) < 1e-5
    for m, g in goals.items():
        for v, share in g.items():
            assert abs(kept[got[f"_{m}"] == v].sum() / kept.sum() - share) < 1e-5, (m, v)


def test_target_above_all_tokens_of_its_value(spark):
    rows = [(f"s{i}", "en", "prose", n) for i, n in enumerate((50, 150, 300, 500))]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long")
    goal = [("s0", 0.4), ("s1", 0.2), ("s2", 0.2), ("s3", 0.2)]
    frames = {"source": spark.createDataFrame(goal, "_source string, target_source double"), "lang": spark.createDataFrame([("en", 1.0)], "_lang string, target_lang double"), "topic": spark.createDataFrame([("prose", 1.0)], "_topic string, target_topic double")}
    got = {r._source: r.tokens * r.probability for r in mixing.bounded_rake(cells, frames, 0.6, 8).collect()}
    assert {k: round(v, 3) for k, v in got.items()} == {"s0": 50.0, "s1": 150.0, "s2": 200.0, "s3": 200.0}


def test_mixture_hard_inputs(hard_docs, no_docs):
    kept = mixing.mixed(hard_docs)
    assert kept.columns == hard_docs.columns
    rows = kept.collect()
    assert {3, 4} <= {r.doc_id for r in rows} and len(rows) <= hard_docs.count()
    assert sum(r.doc_id == 2 for r in rows) in (0, 2)
    assert mixing.mixed(no_docs).collect() == []
    assert sorted(map(str, mixing.mixed(hard_docs).collect())) == sorted(map(str, rows))


# ---------------------------------------------------------------- URL tree


def test_host_path_and_rules(spark):
    urls = {1: None, 2: "no scheme", 3: "http://A.Example.ORG/es/x?q#f", 4: "x://example.org/en/1", 5: "http://example.org/en/2", 6: "http://org", 7: "http://sub.com/de/9", 8: "http://sub.com/fr/9", 9: "http://notorg/fr/", 10: "http://h?x/y", 11: "http://a://b/c", 12: "http://com/de/", 13: "HTTP://İ.com/de/"}
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in urls.items()] + [(None, "http://q/a", "h", "c"), (5, urls[5], "h", "c")], "page_id long, url string, html string, host string")
    rows = url_tree.judge(pages, spark.createDataFrame([], "page_id long, good int")).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 15
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[4] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert got[5] == ("example.org", "/en/2", "org/", "allow") and got[6] == ("org", "", None, "allow")
    assert got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow") and got[9][2:] == (None, "allow")
    assert got[10][:2] == ("h", "") and got[11][:2] == ("a:", "//b/c") and got[12][2:] == ("com/de/", "block") and got[13][0] == "İ.com"
    assert url_tree.judge(pages.limit(0), spark.createDataFrame([], "page_id long, good int")).collect() == []


def test_bad_branch_is_found_and_like_branches_merge(spark):
    pages, labels = [], []
    for i in range(600):
        section = ("news", "blog", "spam")[i % 3]
        pages.append((i, f"http://h.net/{section}/{i}/page"))
        labels.append((i, 0 if section == "spam" else int(i % 20 > 0)))
    rows = url_tree.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).collect()
    for r in rows:
        assert r.verdict == ("block" if r.page_id % 3 == 2 else "allow")
    assert {r.template for r in rows if r.page_id % 3 == 2} == {"/spam/*/page"} and len({r.template for r in rows}) <= 3


def test_bad_branch_deep_in_the_path(spark):
    """Six segments and more; one path has thirty, and one ends where others go on."""
    pages, labels = [(900, "http://h.net/" + "x/" * 30), (901, "http://h.net/a/b/c")], []
    for i in range(400):
        branch = "spam" if i % 2 else "good"
        pages.append((i, f"http://h.net/a/b/c/d/{branch}/{i}"))
        labels.append((i, 0 if branch == "spam" else 1))
    rows = url_tree.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(got) == 402
    for i in range(400):
        assert got[i].verdict == ("block" if i % 2 else "allow") and got[i].template.split("/")[5:] == ["spam" if i % 2 else "good", "*"]
    assert got[900].template == "/" + "/".join("*" * 30) and got[901].template.count("/") == 3


def merged_plainly(counted: dict[tuple, tuple[int, int]]) -> dict[tuple, tuple]:
    """Templates of (segments -> (labelled, good)) of one host, level by level."""
    t = {s: () for s in counted}
    for level in range(max(map(len, counted))):
        groups: dict[tuple, dict[str, list[tuple]]] = {}
        for s in counted:
            if len(t[s]) == level and len(s) >= level:
                groups.setdefault(t[s], {}).setdefault(s[level] if len(s) > level else "", []).append(s)
        for kids in groups.values():
            every = [s for k in kids.values() for s in k]
            all_n, all_good = (sum(counted[s][i] for s in every) for i in (0, 1))
            for child, own in kids.items():
                n, good = (sum(counted[s][i] for s in own) for i in (0, 1))
                rest, z = all_n - n, 0.0
                if n >= 5 and rest >= 5 and 0 < all_good < all_n:
                    z = abs(good / n - (all_good - good) / rest) / (all_good / all_n * (1 - all_good / all_n) * (1 / n + 1 / rest)) ** 0.5
                for s in own if child else []:
                    t[s] = (*t[s], child if z >= url_tree.Z or (rest == 0 and n >= 5) else "*")
    return t


def test_chains_and_branchings_equal_a_plain_merge(spark):
    rng = random.Random(9)
    paths = set()
    while len(paths) < 90:
        lead = rng.choice([("a",) * 9, ("a",) * 4 + ("b",) * 3, ("c", "d"), ()])
        paths.add(lead + tuple(rng.choice("xy") for _ in range(rng.randint(0, 3))) + ("e",) * rng.choice([0, 0, 6]))
    pages = [(i, "http://h.net/" + "/".join(s)) for i, s in enumerate(p for p in sorted(paths) for _ in range(rng.choice([1, 3, 9])))]
    labels = [(i, int(rng.random() < (0.9 if "/x" in u else 0.3))) for i, u in pages if rng.random() < 0.7]
    rows = url_tree.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).collect()
    known, counted = dict(labels), {}
    for i, u in pages:
        s = tuple(x for x in u.removeprefix("http://h.net").split("/") if x)
        n, good = counted.get(s, (0, 0))
        counted[s] = (n + (i in known), good + known.get(i, 0))
    want = merged_plainly(counted)
    assert all(r.template == "/" + "/".join(want[tuple(x for x in r.path.split("/") if x)]) for r in rows)


def test_a_very_deep_path(spark):
    """Two thousand segments that twenty pages share are one step, not two thousand."""
    deep = "http://h.net/" + "/".join(f"s{chr(97 + i % 26)}" for i in range(2_000))
    pages = [(i, f"{deep}/{'ab'[i % 2]}/{chr(97 + i)}") for i in range(20)] + [(99, "http://h.net/other")]
    rows = url_tree.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(i, i % 2) for i in range(20)], "page_id long, good int")).collect()
    assert len(rows) == 21 and {r.template.count("/") for r in rows if r.page_id < 99} == {2_002}
    assert {r.template.split("/")[1:4] == ["sa", "sb", "sc"] for r in rows if r.page_id < 99} == {True}


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, out, SF).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
    assert len(last) == sizes[-1] and sum(r.n_tokens for r in last) == max(r.start + r.n_tokens for r in last)


def test_pipeline_on_hard_documents(spark, hard_docs, no_docs):
    for docs in (hard_docs, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            path = fresh_path(spark, name)
            stage(spark, out, SF).write.parquet(path)
            out = spark.read.parquet(path)
    assert token_codes.encode_and_read(no_docs, corpus_pipeline.tokenizer_path()).collect() == []
