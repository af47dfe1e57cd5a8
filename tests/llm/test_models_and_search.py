"""Fingerprints, host reputation, toxicity, licences and nearest neighbours."""

import hashlib
import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest import frame
from pyspark.sql import functions as F

from redactory.llm import ann, fingerprints, license_scan, toxicity, url_filter


def test_edited_texts_and_likeness(spark, corpus):
    rows = [(i, t) for i, (_, t) in enumerate(corpus) if t is None or len(t) < 20_000]
    got = {r.doc_id: r for r in fingerprints.edit_and_compare(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    prints, off = {}, []
    for k, (d, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r = got[d]
        assert r.n_chars == len(text) and r.edited == edited and len(r.fingerprint) == fingerprints.BINS
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        for estimate, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = plain.shingles(text.lower(), 5), plain.shingles(other.lower(), 5)
            off.append(estimate - (len(a & b) / len(a | b) if a | b else 1.0))
            assert 0 <= estimate <= 1
    off = np.array(off)
    assert abs(off.mean()) < 0.03 and np.sqrt((off**2).mean()) < 0.08


def test_fingerprints_pass_columns_on(spark):
    got = fingerprints.fingerprints(frame(spark, [(1, "a b"), (1, "a b"), (None, None), (2, "")])).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2 and got[0]._text == "u"
    assert fingerprints.edit_and_compare(frame(spark, [])).count() == 0


def test_equal_ids_and_single_rows(spark):
    got = fingerprints.edit_and_compare(frame(spark, [(1, "abc def"), (1, "abc xyz"), (None, "no id")])).collect()
    assert len(got) == 3
    one = fingerprints.edit_and_compare(frame(spark, [(5, "abcdef")])).first()
    assert one.edited == "abcd" + "ab" and one.near_next == 1.0


RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def test_hosts_paths_and_rules(spark):
    urls = {"https://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
            "http://example.org/en/2#a": ("example.org", "/en/2", "org/", "allow"),
            "http://notexample.com/de/": ("notexample.com", "/de/", "com/de/", "block"),
            "ftp://x.com?/de/": ("x.com", "", None, "allow"), "x.com/de/": ("", "", None, "allow"), None: ("", "", None, "allow"),
            "http://É.com/fr/a://b/de/": ("É.com", "/fr/a://b/de/", "com/fr/", "allow"),
            "http://xexample.org/es/\n1": ("xexample.org", "/es/\n1", "org/", "allow")}
    pages = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(urls)], "page_id long, url string, rate double")
    labels = spark.createDataFrame([(0, None), (None, 1)], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_pages(pages, labels, RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.judge_pages(pages.limit(0), labels, RULES).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("bad.a.com", 0)] * 40 + [("good.a.com", 1)] * 40 + [("new.a.com", None)] + [("b.net", 1)] * 30 + [("one.b.net", 0)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["bad.a.com"].high < 0.5 < got["good.a.com"].low
    assert got["bad.a.com"].rate < got["new.a.com"].rate < got["good.a.com"].rate
    assert 0 < got["one.b.net"].rate < got["b.net"].rate
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, (h, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows)], "page_id long, good int")
    verdicts = {r.host: r.verdict for r in url_filter.judge_pages(pages, labels).collect()}
    assert {h for h, v in verdicts.items() if v == "block"} == {"bad.a.com"}


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network.fresh({}, rng.normal(size=6), 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(0, 6, (3, toxicity.WINDOW))
    grams = rng.integers(-1, 20, (3, toxicity.WINDOW, toxicity.LETTERS))
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        x = net.features(ids, grams).astype(np.float64)
        p = toxicity.sigmoid(net.logits(x.reshape(-1, x.shape[-1]), np.arange(ids.size).reshape(ids.shape)).astype(np.float64))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = net.gradients(ids, grams, y)
    for name, at in (("Wf", (0, 3)), ("Ub", (2, 20)), ("cf", (17,)), ("word", (3, 0)), ("char", (5, 1)), ("attend", (9,)), ("out", (1,)), ("bias", (0,))):
        before, step = net.p[name][at], 1e-2
        net.p[name][at] = before + step
        up = loss()
        net.p[name][at] = before - step
        down = loss()
        net.p[name][at] = before
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4, rel=0.05), name


def toxic_rows(n=400):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(200)]
    out = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice((5, 40, 300)))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(("vile", "rotten", "nasty"))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_held_out_accuracy_and_last_windows(spark):
    rows = toxic_rows()
    docs = frame(spark, [(d, t) for d, t, _ in rows] + [(1000, None), (1001, ""), (None, "vile")])
    labels = spark.createDataFrame([(d, b) for d, _, b in rows] + [(None, 1), (3, None), (1000, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    score = {r.doc_id: r.score for r in got.collect()}
    assert len(score) == len(rows) + 3 and all(0 <= s <= 1 for s in score.values())
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    right = [(score[d] >= 0.5) == bool(b) for d, _, b in rows if d in held]
    assert np.mean(right) > 0.95 and score[1000] == score[1001] < 0.5 <= score[None]
    net = toxicity.train([t for _, t, _ in rows], np.array([b for *_, b in rows]))
    long = " ".join(t for _, t, b in rows if not b)
    assert net.scores(pa.array([long, long + " vile rotten nasty"], pa.large_string())).round().tolist() == [0, 1]


def test_no_letter_is_left_out():
    texts = ["傻瓜。你好abc 笨蛋", "กขค😀idiot", "a" * 100 + "z", "é" * 40, "日", "", "l’été «non»"]
    words = toxicity.word_table(pa.array(texts, pa.large_string()))
    names = [words.distinct[i].as_py().decode() for i in words.ids]
    of = [names[a:b] for a, b in zip(words.word_ends[:-1], words.word_ends[1:])]
    assert of[0] == ["傻瓜", "你好", "abc", "笨蛋"] and of[1] == ["กข", "ขค", "ค😀", "idiot"]
    assert of[2][-1][-1] == "z" and sum(map(len, of[2])) >= 101 and set("".join(of[3])) == {"é"} and len(of[3]) == 6
    assert of[4:] == [["日"], [], ["l", "été", "non"]]
    assert max(len(n.encode()) for n in names) <= toxicity.LETTERS
    grams = toxicity.trigrams(words.distinct)
    assert ((grams >= 0).sum(axis=1) == [len(w.as_py()) for w in words.distinct]).all()


@pytest.mark.parametrize("letters", ["天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "klmnopqrst"])
def test_insults_after_the_start_of_a_run(letters):
    """Texts without spaces that all begin alike: what follows decides."""
    rng = random.Random(7)
    bad = ("傻瓜", "笨蛋") if letters[0] > "z" else ("vile", "nasty")
    texts, y = [], []
    for i in range(400):
        w = [rng.choice(letters) for _ in range(rng.choice((10, 40, 90)))]
        if i % 2:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(letters[:8] + "".join(w))
        y.append(i % 2)
    net = toxicity.train(texts[:300], np.array(y[:300]))
    got = net.scores(pa.array(texts[300:], pa.large_string())) >= 0.5
    assert np.mean(got == np.array(y[300:], dtype=bool)) > 0.9


def test_without_both_classes(spark):
    docs, none = frame(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.5}
    assert toxicity.score_documents(frame(spark, []), none).count() == 0


def test_licences_are_found_where_they_are(spark, corpus):
    made = [(2000 + i, f"{corpus[i][1]}\n{t.upper()}\n{corpus[i + 1][1]}") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    cut = " ".join(license_scan.TEMPLATES[2][1].split()[:-9])  # most of the notice
    rows = [*corpus, *made, (3000, cut), (3001, "under the MIT License"), (3002, cut[:len(cut) // 2])]
    got = {(r.doc_id, tuple(r.licenses)) for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    wanted = {2000 + i: name for i, (name, _) in enumerate(license_scan.TEMPLATES)} | {3000: "MIT"}
    assert {(d, n) for d, n in got if n} == {(d, (n,)) for d, n in wanted.items()}
    assert len(got) == len({d for d, _ in rows})
    with pytest.raises(ValueError):
        license_scan.scan_licenses(frame(spark, rows), [("X", "too short")])
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_versions_and_names_of_licences(spark):
    every = (*license_scan.TEMPLATES, *license_scan.VERSIONS)
    gpl = next(t for name, t in every if name == "GPL")
    texts = {t: {name} for name, t in every} | {
        "This work is licensed under the GNU General Public License, version 4.": set(),
        "licensed under the GNU Affero General Public License, version 2.": set(),
        gpl.replace("GNU General", "GNU Lesser General"): {"LGPL"}, gpl.replace("redistribute it", "redistribute them"): {"GPL"},
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 3.0.": set()}
    # The family's own template is part of these.
    texts |= {t: texts[t] | {"LGPL"} for t in texts if t.startswith("licensed under the GNU Lesser")}
    rows = [(i, f"some words before\n{t}\nand others after") for i, t in enumerate(texts)]
    got = {r.doc_id: set(r.licenses) for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == dict(enumerate(texts.values()))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v int")


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[200:500] = x[20]  # a common vector, one of the queries among them
    rows = [(i, [float(e) for e in r], 0, 0) for i, r in enumerate(x)]
    odd = [(2000, None, 0, 0), (2020, [0.0] * 24, 0, 0), (2040, [float("nan")] * 24, 0, 0), (2060, [None] * 24, 0, 0),
           (2080, [1.0] * 3, 0, 0), (2100, [float("inf")] * 24, 0, 0), (None, rows[0][1], 0, 0), rows[3]]
    got = ann.nearest(vectors(spark, rows + odd), F.expr("vec_id % 20 = 0"), k=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    big, recall = x.astype(np.float64), []
    for q, found in by.items():
        score = big @ big[q]
        order = [int(i) for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(abs(score[v] - s) < 1e-9 and v != q for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        recall.append(len(set(order) & {v for _, v, _ in found}) / 20)
    assert np.mean(recall) >= 0.9


def test_few_vectors(spark):
    got = ann.nearest(vectors(spark, [(0, [1.0, 0.0], 0, 0), (1, [0.5, 0.5], 0, 0)]), F.expr("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]
    assert ann.nearest(vectors(spark, [(0, [1.0], 0, 0)]), F.expr("vec_id % 20 = 0")).count() == 0
    assert ann.nearest(vectors(spark, []), F.expr("vec_id % 20 = 0")).count() == 0


def test_sha_of_edited_text_is_utf8(spark):
    row = fingerprints.edit_and_compare(frame(spark, [(1, "日本語"), (2, "aé😀")])).where("doc_id = 2").select(
        F.sha2("edited", 256).alias("s")).first()
    assert row.s == hashlib.sha256("aé日".encode()).hexdigest()
