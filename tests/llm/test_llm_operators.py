"""Training-data operators against brute force, on small rows with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.llm import ann, chat_format, html_extract, license_scan, license_texts, mixing, packing, quality_model, quality_rules, registry, simhash, textstats, tokens, url_filter
from sextant.session import table

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(LOREM[i] for i in rng.integers(0, len(LOREM), n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 300), "en", "b", 1), (2, prose(2, 300), "en", "a", 1), (3, prose(2, 300) + " tail", "en", None, 1), (4, None, None, "a", None), (5, "", "en", "a", 0), (6, " \t\n", "en", "c", 3),
        (7, long, "en", "a", 9), (8, long.upper(), "en", "a", 9), (9, "one two", "fr", "é", 7), (9, "one two", "fr", "é", 7), (10, "ONE two", "fr", "b", 7), (None, "no id here", "en", "b", 1), (11, prose(3, 60) + "\nAll rights reserved.\n" + prose(4, 60), "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]


# 1 license scan


def test_license_scan_equals_containment(spark, docs):
    notice = " ".join(LOREM) + " end of a longer notice with some more words in it that nobody reads"
    half = " ".join(notice.split()[: len(notice.split()) * 9 // 10])
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(20, prose(5, 500) + " " + notice.upper() + " " + prose(6, 500)), (21, prose(7, 77) + " " + half), (22, "x " + " ".join(notice.split()[:9])), (23, "released under the\tMIT License.")], "doc_id long, text string"))
    templates = [*license_scan.NOTICES, ("own", notice), ("empty", "")]
    got = {(r["doc_id"], r["license_id"]) for r in license_scan.scan(more, templates).collect()}
    assert got == {(11, "all-rights-reserved"), (20, "own"), (21, "own"), (23, "MIT")}


def test_license_scan_without_templates_or_rows(spark, docs):
    assert license_scan.scan(docs, []).count() == 0
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_registered_license_scan_finds_texts_headers_and_tags(spark, tmp_path):
    listed = {name: text for name, text in [*license_texts.texts(), *license_texts.SHORT_TEXTS]}
    rows = [(n, prose(n, 400) + "\n" + text + "\n" + prose(n + 99, 400)) for n, text in enumerate(listed.values())]
    body = listed["GPL-3.0"].split()
    rows += [
        (100, "Copyright me\n" + license_texts.HEADERS[0][1].upper()), (101, "# SPDX-License-Identifier: GPL-3.0-or-later\nimport os"), (102, "Released under the MIT License"), (103, "Licensed under CC BY-SA 4.0."),
        (104, prose(1, 30_000) + " " + " ".join(body[:2000] + body[2500:])), (105, prose(2, 500) + " " + " ".join(body[: len(body) // 2])),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["license_id"]) for r in registry.op1_license_scan(spark, str(tmp_path)).collect()}
    assert got >= {(n, name) for n, name in enumerate(listed)}
    assert got >= {(100, "Apache-2.0"), (101, "GPL-3.0"), (102, "MIT"), (103, "CC-BY-SA-4.0"), (104, "GPL-3.0")}
    assert not {name for n, name in got if n == 105}


@pytest.mark.parametrize("window,shingles", [(32, 2), (32, 8), (256, 9), (256, 64), (2048, 65), (16384, 513)])
def test_license_bands_miss_few_matches(window, shingles):
    """Measured: windows that hold just the least share of a template, against its minima."""
    rng = np.random.default_rng(window + shingles)
    shared = int(np.ceil(license_scan.SIMILARITY * shingles))
    shift = np.uint64(64 - license_scan.bins(window, shingles))

    def minima(h):
        h = np.sort(h)
        top = h >> shift
        return h[np.append(True, top[1:] != top[:-1])]

    missed, runs = 0, 20_000 if window < 300 else 3_000 if window < 3_000 else 1_000
    for _ in range(runs):
        h = rng.integers(0, 2**64, window + shingles - shared, dtype=np.uint64)
        missed += not len(np.intersect1d(minima(h[:window]), minima(h[window - shared :]), assume_unique=True))
    assert missed <= 1e-3 * runs


def test_license_with_an_insertion_is_found_at_every_offset(spark):
    template = [f"t{i}" for i in range(68)]
    inserted = [f"x{i}" for i in range(40)]
    rows = []
    for offset in range(0, 150, 3):
        for cut in (10, 34, 60):
            filler = [f"f{offset}-{cut}-{i}" for i in range(400)]
            rows.append((1000 * offset + cut, " ".join([*filler[:offset], *template[:cut], *inserted, *template[cut:], *filler[offset:]])))
    rows += [(-1 - cut, " ".join([*template[:cut], *inserted, *template[cut + 16 :]])) for cut in (10, 34)]
    got = {r["doc_id"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), [("own", " ".join(template))]).collect()}
    assert got == {i for i, _ in rows if i >= 0}


def test_license_scan_equals_its_windows(spark):
    """Against the windows by hand, with all templates of the query."""
    templates = [*license_scan.NOTICES, *license_texts.templates()]
    rng = np.random.default_rng(8)
    rows = [(n, prose(n, int(rng.integers(5, 300))) + "\n" + " ".join(text.split()[: int(len(text.split()) * rng.uniform(0.6, 1.1)) + 1]) + " " + prose(n + 1, int(rng.integers(0, 300)))) for n, (_, text) in enumerate(templates)]
    got = {(r["doc_id"], r["license_id"]): (r["containment"], r["first_word"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    wanted = {}
    for tier in license_scan.tiers(templates):
        for i, text in rows:
            w = license_scan.template_words(text)
            h = [" ".join(w[j : j + tier.size]) for j in range(len(w) - tier.size + 1)]
            for start in range(0, max(0, len(h) - 1 - (tier.window - tier.stride)) + 1, tier.stride) if h else ():
                own = set(h[start : start + tier.window])
                for name, shingles in tier.templates:
                    share = len(own & set(shingles)) / len(shingles)
                    if share >= license_scan.SIMILARITY:
                        best = wanted.get((i, name), (0, 0))
                        wanted[i, name] = max(best, (share, -start))
    assert got == {k: (pytest.approx(share), -back) for k, (share, back) in wanted.items()}


# 2 simhash


def slow_fingerprint(text):
    tokens_ = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(tokens_[i : i + 3]) for i in range(max(1, len(tokens_) - 2))] if tokens_ else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60)
@given(st.text(alphabet="aBcÉ \t\n\x0b\x1c\u00a0", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def slow_components(fps):
    """fps: id -> fingerprint."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    own = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.filter("doc_id is not null").collect()}
    wanted = slow_components(own)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] is not None} == {i: (f"{own[i]:016x}", wanted[i]) for i in own}
    kept = Counter(r["doc_id"] for r in simhash.deduplicated(docs).collect())
    assert kept == Counter({**{i: 1 for i in set(wanted.values())}, None: 1})
    odd = docs.limit(0).unionAll(docs.sparkSession.createDataFrame([(1, prose(1, 50), "", "", 0), (1, prose(2, 50), "", "", 0), (1, prose(1, 50), "", "", 0), (2, prose(2, 50), "", "", 0), *[(None, prose(3, 50), "", "", 0)] * 3, (3, prose(4, 50), "", "", 0), (3, prose(1, 50), "", "", 0)], DOCS))
    assert Counter((r["doc_id"], r["text"]) for r in simhash.deduplicated(odd).collect()) == Counter([(1, prose(1, 50)), (1, prose(2, 50)), (None, prose(3, 50)), (3, prose(4, 50))])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows,group_rows", [(20, 8), (200, 10), (10_000, 30)])
def test_links_across_shards_and_groups(spark, monkeypatch, shard_rows, group_rows):
    """Many shards, and trees inside shards, lose no link; the third of the fingerprints shares a half."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:150].tolist():
        y = x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        fps |= {y, y ^ (1 << int(rng.integers(64)))}
    centre = int(base[0])
    fps |= {centre ^ (1 << i) for i in range(64)}
    low, high = int(base[1]) & 0xFFFFFFFF, int(base[2]) >> 32 << 32
    for x in rng.integers(0, 2**32, 150).tolist():
        fps |= {(x << 32) | low, (x ^ (1 << int(rng.integers(32)))) << 32 | low, high | x}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    unsigned = lambda x: x & (2**64 - 1)
    assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 2 for a, b in edges)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(unsigned(a)), find(unsigned(b))
        root[max(a, b)] = min(a, b)
    assert {x: find(x) for x in fps} == slow_components({x: x for x in fps})
    assert len(edges) < 6 * len(fps)


def test_spanning_links_of_a_dense_group_are_few():
    fps = np.array([0, *(1 << i for i in range(64)), *(3 << i for i in range(63))], dtype=np.uint64)
    assert len(simhash.spanning_links(fps)) == len(fps) - 1


# 3 url filter


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("deep.example.org", "/en/", "allow")]


def slow_verdict(url):
    host, path = url_filter.split_url(url)
    best = max(((len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return (host, path, best and best[2], best[3] if best else "allow")


URLS = ["http://a.org", "http://a.org/", "HTTP://A.ORG/es/", "x://www.example.org/es/1?q#f", "x://example.org/en/12", "x://notexample.org/es/", "https://B.com/fr/x", "https://b.com/de/#x", "https://com/de/", "x://deep.example.org/en/1", "x://q.deep.example.org/en/1", "no scheme", "", None, "x://", "x://h?a/b", "a://b://c/d", "x://example.org./es/", "x://ÄÖ.org/é"]


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_url_filter(spark, ranges):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 3)] + [(None, "x://a.org/", "x")], "page_id long, url string, verdict string")
    got = url_filter.filter_urls(pages, url_filter.rules_frame(spark, [*RULES, (None, "/", "block")]), ranges=ranges).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=repr) == sorted([(i, *slow_verdict(u)) for i, u in enumerate(URLS * 3)] + [(None, *slow_verdict("x://a.org/"))], key=repr)


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([(1, "x://a.org/es/")], "page_id long, url string")
    rules = url_filter.rules_frame(spark, RULES)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_filter.filter_urls(pages, rules.limit(0)).collect()] == [(1, "a.org", "/es/", None, "allow")]


# 4 quality rules and text statistics


def slow_stats(text):
    text = text or ""
    w = words(text)
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if words(line) and line in lines[:i])
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside))


@settings(max_examples=80)
@given(st.text(alphabet="ab \t\n\x0b\x1c\u2028#é|", max_size=60))
def test_text_stats(text):
    assert textstats.text_stats(text)[:5] == slow_stats(text)


def test_quality_rules_over_documents(docs):
    rules = quality_rules.DecisionList([(quality_rules.Condition("dup_line_share", True, 0.5),)])
    got = quality_rules.judge(docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1)), rules).collect()
    assert len(got) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        n, chars, symbols, dup, repeat = slow_stats(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_learning_finds_conjunctions():
    rng = np.random.default_rng(0)
    x = {"a": rng.uniform(size=3000), "b": rng.uniform(size=3000), "c": rng.uniform(size=3000)}
    bad = ((x["a"] > 0.7) & (x["b"] <= 0.4)) | (x["c"] > 0.95)
    found = quality_rules.learn(x, bad)
    rejected = np.zeros(3000, dtype=bool)
    for rule in found.rules:
        rejected |= np.logical_and.reduce([c.holds(x) for c in rule])
    assert (rejected & ~bad).sum() <= 0.02 * (~bad).sum()
    assert (rejected & bad).sum() >= 0.95 * bad.sum()
    assert quality_rules.learn(x, np.zeros(3000, dtype=bool)).rules == []


def test_quality_rules_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    assert rules.rules == [] and quality_rules.judge(docs.limit(0), rules).count() == 0


def test_quality_rules_on_held_out_documents(spark, sf):
    """Learned on three folds of the labels, judged on the fourth."""
    sf = sf.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen, held = labels.filter(quality_model.fold(F.col("doc_id")) != 2), labels.filter(quality_model.fold(F.col("doc_id")) == 2)
    judged = quality_rules.judge(docs.join(held.select("doc_id"), "doc_id", "left_semi"), quality_rules.fit(docs, seen)).join(held, "doc_id").filter("NOT base_failed")
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts[1, True] > 200 and counts.get((1, False), 0) <= 0.02 * counts[1, True]
    assert counts[0, False] > 20 and counts.get((0, True), 0) <= 0.1 * counts[0, False]


def test_quality_rules_with_string_ids(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    named = F.concat(F.lit("d"), F.col("doc_id"))
    rules = quality_rules.fit(docs.withColumn("doc_id", named), labels.withColumn("doc_id", named))
    assert rules.describe() and quality_rules.passed(docs.withColumn("doc_id", named), rules).count() > 0


# 5 quality model


def test_quality_model_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = registry.QUERIES["op5_quality_model"](spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_model_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        model = quality_model.fit(docs, own)
        got = quality_model.score(docs, model, keep=docs.columns)
        assert got.count() == docs.count() and got.columns == [*docs.columns, "score", "predicted"]
    assert quality_model.score(docs.limit(0), model).count() == 0


def slow_features(text):
    text = text or ""
    raw, w = text.encode(), words(text)
    n, size = max(1, len(w)), max(1, len(raw))
    lines = [line for line in text.split("\n") if words(line)]
    upper, lower, digits = (sum(c in alphabet for c in text) for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
    _, chars, symbols, dup, repeat = slow_stats(text)
    return [
        np.log1p(len(w)), chars / n, np.log1p(100 * symbols / n), dup / max(1, len(lines)), repeat / n, np.log1p(n / max(1, len(lines))), upper / max(1, upper + lower), digits / size,
        np.log1p(100 * sum(c in "!?" for c in text) / n), len(set(w)) / n, max(Counter(w).values(), default=0) / n, np.log1p(max((len(x.encode()) for x in w), default=0)),
    ]


def slow_isotonic(raw, label):
    """The largest over starts of the smallest over ends of the means between them, tied values together; then counts of the level sets."""
    at = np.unique(raw)
    total, count = (np.array([v[raw == x].sum() for x in at]) for v in (label, np.ones(len(raw))))
    t, c = np.append(0, np.cumsum(total)), np.append(0, np.cumsum(count))
    means = (t[None, 1:] - t[:-1, None]) / np.maximum(c[None, 1:] - c[:-1, None], 1)
    fit = np.array([max(means[i, k:].min() for i in range(k + 1)) for k in range(len(at))])
    knots = []
    for level in np.unique(fit.round(12)):
        own = np.flatnonzero(fit.round(12) == level)
        level = (total[own].sum() + 0.5) / (count[own].sum() + 1)
        if knots and level <= knots[-1][0]:
            knots[-1] = (knots[-1][0], knots[-1][1], at[own[-1]])
        else:
            knots.append((level, at[own[0]], at[own[-1]]))
    x, y = [], []
    for i, (middle, low, high) in enumerate(knots):
        up = min(middle - (knots[i - 1][0] if i else 0), (knots[i + 1][0] if i + 1 < len(knots) else 1) - middle) / 4
        x += [low, high] if high > low else [low]
        y += [middle - up, middle + up] if high > low else [middle]
    return np.array(x), np.array(y)


def test_quality_model_equals_its_definition(spark, sf):
    """Statistics, features, ridge and calibration computed again from the texts, by other means."""
    docs = table(spark, sf, "documents").collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    x = np.array([slow_features(r["text"]) for r in docs])
    y = np.array([labels.get(r["doc_id"], -1) for r in docs])
    folds = np.array([fold(r["doc_id"]) for r in docs])
    ridge_rows, calibration_rows = (y >= 0) & np.isin(folds, (0, 3)), (y >= 0) & (folds == 1)
    mean, std = x[ridge_rows].mean(0), x[ridge_rows].std(0)
    rng = np.random.default_rng(quality_model.SEED)
    weights, phases = rng.normal(size=(12, 256)) / 12**0.5, rng.uniform(0, 2 * np.pi, 256)
    scaled = np.clip((x - mean) / np.where(std > 1e-9, std, 1), -8, 8)
    z = np.hstack([np.cos(scaled @ weights + phases) * (2 / 256) ** 0.5, scaled / 8, np.ones((len(x), 1))])
    # Ridge as least squares on a longer system.
    penalty = np.sqrt(1e-3 * ridge_rows.sum() / z.shape[1]) * np.eye(z.shape[1])
    ridge = np.linalg.lstsq(np.vstack([z[ridge_rows], penalty]), np.append(y[ridge_rows], np.zeros(z.shape[1])), rcond=None)[0]
    at, value = slow_isotonic((z @ ridge)[calibration_rows].round(13), y[calibration_rows].astype(float))
    wanted = np.interp(z @ ridge, at, value)
    got = {r["doc_id"]: r["score"] for r in registry.QUERIES["op5_quality_model"](spark, sf).collect()}
    assert np.allclose([got[r["doc_id"]] for r in docs], wanted, atol=1e-6)


def test_quality_scores_rank_documents(spark, sf):
    rows = registry.QUERIES["op5_quality_model"](spark, sf.replace("0.001", "0.1")).filter("held_out").join(table(spark, sf.replace("0.001", "0.1"), "labels"), "doc_id").collect()
    assert len({r["score"] for r in rows}) > len(rows) / 4
    score, label = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    good, bad = score[label == 1], score[label == 0]
    assert ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean() >= 0.99


@settings(max_examples=30)
@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(0, 1)), min_size=1, max_size=60))
def test_isotonic_never_falls(rows):
    raw, label = np.array([r for r, _ in rows]), np.array([float(y) for _, y in rows])
    fitted = quality_model.Isotonic.fit(raw, label)(np.sort(raw))
    assert (np.diff(fitted) >= -1e-12).all() and fitted.min() >= 0 and fitted.max() <= 1


# 6 mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, docs, monkeypatch):
    many = docs.unionAll(spark.createDataFrame([(100 + i, prose(i, 20 + i % 50), "en", "abc"[i % 3] if i % 2 else "b", 1) for i in range(400)], DOCS))
    first = None
    for rows in (1_000_000, 40):
        monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", rows)
        got = mixing.mix(many).collect()
        assert len(got) == many.count()
        key = sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)
        first = first or key
        assert key == first
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    wanted = slow_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= most[s]
    mixed = Counter(r["doc_id"] for r in mixing.mixed_documents(many).select("doc_id").collect())
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    assert mixed == +copies
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_without_an_id_do_not_stay_together(spark):
    """Buckets of the shuffle and of ranks: a third of all rows may lack an id."""
    frame = spark.createDataFrame([(None, prose(i, 30), "en", "a", 1) for i in range(400)], DOCS)
    hashes = [r[0] for r in frame.select(mixing.shuffle_hash(F.col("doc_id"), F.col("text"), 17)).collect()]
    assert len(set(hashes)) == 400 and len({h >> 56 for h in hashes}) > 8
    assert sum(r["taken"] for r in mixing.mix(frame).collect()) == pytest.approx(1.5 * 400 * 30, abs=30)
    rows = packing.pack(frame).collect()
    assert len(rows) == 400 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 400


# 7 html


PAGES = [
    ("", ""),
    (None, ""),
    ("plain text only", "plain text only"),
    ("<html><body><nav><a>Home</a></nav><article><h1>Title &amp; more</h1><p><b>One\n  two<br><p>Three&nbsp;four.</article><footer>&copy; x</footer></body></html>", "Title & more\nOne two\nThree four."),
    ("<body><div class='cookie-notice'>We use cookies</div><main><p>First paragraph of the text.</p><aside>Aside</aside><form>Name <input></form><script>var p='</p>'</script><p>S.</p><div class='comments'><p>Nice post!</p></div></main><div id=sidebar>Links</div></body>", "First paragraph of the text.\nS."),
    ("<div class=top-nav><a>a</a><a>b</a></div><div><p>A long enough sentence to be the content of this page.</p><p>Ok.</p></div><div class='ad'>Buy now</div>", "A long enough sentence to be the content of this page.\nOk."),
    ("<article><p>unclosed <i>tags <b>everywhere<p>next</article> stray </div>", "unclosed tags everywhere\nnext"),
    ("<p>broken <![declaration here</p>", None),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one\ntwo\na b\nc"),
    ("<div class='page has-sidebar'><div class='article-header'><h1>T</h1></div><div class=content><p>some text that is long enough here</p><p>x</p></div><div class='sidebar'>no</div><div class='postComments'>bad</div></div>", "T\nsome text that is long enough here\nx"),
    ("<article><p>whole</p><p>cut off here <a hre", "whole\ncut off here"),
    ("<article><p>open</p><!-- never closed <p>x</p>", "open"),
    ("a < b", "a < b"),
    ("<article><header><h1>Own title</h1></header><p>Text &lt;here&gt;</p></article>", "Own title\nText <here>"),
]


@pytest.mark.parametrize("html,expected", PAGES)
def test_extract(html, expected):
    got = html_extract.extract(html)
    assert expected is None or got == expected


@pytest.mark.parametrize(
    "html",
    [
        "<head><script><!-- var a = 1; </script></head><article><p>whole text</p></article>",
        "<article><script>if(x<!--y) z = '<!--';</script><p>whole text</p></article>",
        "<style><!-- p {} </style><article><p>whole text</p></article>",
        "<article><p title='<!--'>whole text</p></article>",
        "<article><!-- closed --!><p>whole text</p></article>",
        "<article><!--><p>whole</p><!---><p>text</p></article>",
        "<head><title>a <!-- b</title></head><noscript><p><!-- c</noscript><article><p>whole text</p></article>",
    ],
)
def test_comment_sign_outside_markup_cuts_nothing(html):
    assert html_extract.extract(html).split() == ["whole", "text"]


SENTENCE = "a sentence of the text that is long enough to count "


@pytest.mark.parametrize(
    "region,others",
    [
        ("<ul>" + f"<li>{SENTENCE * 4}" * 5 + "</ul>", ("p", "p")),
        ("<table><tr><td>" + f"<p>{SENTENCE * 4}</p>" * 5 + "</table>", ("p", "p")),
        ("<blockquote>" + f"<p>{SENTENCE * 4}</p>" * 5 + "</blockquote>", ("p", "p")),
        ("<section>" + f"<p>{SENTENCE * 4}</p>" * 5 + "</section>", ("section", "section")),
        ("<div>" + f"<p>{SENTENCE * 4}</p>" * 5 + "</div>", ("div", "div")),
    ],
)
def test_article_around_its_largest_part_is_kept(region, others):
    before, after = (f"<{tag}>{name} {SENTENCE}</{tag}>" for tag, name in zip(others, ("intro", "closing"), strict=True))
    got = html_extract.extract(f"<body><div><h2>Heading</h2>{before}{region}{after}</div><div class=sidebar>no</div></body>").split("\n")
    assert [line.split()[0] for line in got] == ["Heading", "intro", *["a"] * 5, "closing"]


@pytest.mark.parametrize(
    "html,expected",
    [
        (f"<div class='elementor-widget-container'><h1>T</h1><p>{SENTENCE}</p><div class=related>no</div></div>", f"T\n{SENTENCE.strip()}"),
        (f"<form id=aspnetForm><nav>no</nav><p>{SENTENCE}</p><form>Name</form></form>", None),
        (f"<form><div class=notice>no</div><main><p>{SENTENCE}</p></main></form>", SENTENCE.strip()),
        ("<article><p>as <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "as x=1 holds"),
        (f"<article><p>{SENTENCE * 3}</p></article><div class=related>" + "<article><h3><a>Title</a></h3><p>Why all of this <a>more</a></p></article>" * 5 + "</div>", (SENTENCE * 3).strip()),
        (f"<div><p>{SENTENCE}</p></div><div class=comments><p>{SENTENCE * 9}</p></div><form>Name</form>", SENTENCE.strip()),
    ],
)
def test_wrappers_of_the_whole_page_are_no_boilerplate(html, expected):
    got = html_extract.extract(html)
    assert got == expected if expected is not None else got.startswith(SENTENCE.strip())


@pytest.mark.parametrize(
    "html",
    [
        f"<article><div class='widget-area article-body'><p>one {SENTENCE}</p><p>two {SENTENCE * 4}</p></div></article>",
        f"<article><div id='story-promo-text'><p>one {SENTENCE}</p><p>two {SENTENCE * 4}</p></div></article>",
        f"<article><p>one {SENTENCE}</p><section class='related-work'><p>two {SENTENCE * 4}</p></section></article>",
        f"<div class=post><p>one {SENTENCE * 3}</p><div class='banner-text'><p>two {SENTENCE * 9}</p></div></div>",
        f"<article><p>one {SENTENCE * 3}</p></article><article><p>two {SENTENCE * 4}</p></article>",
        f"<article><section><h2>one</h2><p>one {SENTENCE}</p></section><section><p>two {SENTENCE * 9}</p></section></article>",
        f"<main><p>one {SENTENCE * 3}</p></main><article><p>two {SENTENCE * 2}</p></article>",
    ],
)
def test_names_and_tags_do_not_erase_articles(html):
    """Words of an article in class names, and several articles."""
    page = f"<body><nav><ul><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul></nav><div class=ad>Buy it now.</div>{html}<footer>&copy; all of it</footer></body>"
    assert list(dict.fromkeys(line.split()[0] for line in html_extract.extract(page).split("\n"))) == ["one", "two"]


def article_of(page):
    """Another reading of the test pages, whose articles stand between two tags."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", re.sub(r"<br\b[^>]*>", " ", found[1] if found else ""))
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


NEUTRAL = re.compile(r"<(/?)(?:article|nav|footer)\b")


def test_all_test_pages(spark, sf, monkeypatch):
    """Every page against another reading of it; without telling tags and names; and without the method's parts."""
    pages = [r["html"] for r in table(spark, sf.replace("0.001", "0.01"), "pages").select("html").collect()]
    right = lambda change=lambda p: p: sum(html_extract.extract(change(p)) == article_of(p) for p in pages)
    neutral = lambda p: NEUTRAL.sub(r"<\1div", p).replace(' class="ad"', "")
    unnamed = lambda p: p.replace(' class="ad"', "")
    assert right() == len(pages)
    assert right(lambda p: NEUTRAL.sub(r"<\1div", p)) >= 0.98 * len(pages)
    assert right(neutral) >= 0.98 * len(pages)
    as_it_is = right(unnamed)
    monkeypatch.setattr(html_extract, "split_level", lambda v: float(v.min()) - 1)
    assert right() < 0.3 * len(pages)  # no threshold: the adverts come in
    monkeypatch.undo()
    monkeypatch.setattr(html_extract, "smoothed", lambda v, known: v)
    assert right(unnamed) < as_it_is  # no smoothing: fewer of the adverts that nothing marks are told apart


def slow_select(lines, elements):
    """The region from its definition: sets of ancestors for every line, sums over all lines for every element."""
    above = []
    for n in range(len(elements)):
        chain = {n}
        while elements[n].parent >= 0:
            n = elements[n].parent
            chain.add(n)
        above.append(chain)
    chars = [len(line.text) for line in lines]
    within = lambda n: [i for i, line in enumerate(lines) if n in above[line.element]]
    total = sum(chars)
    held = [sum(chars[i] for i in within(n)) for n in range(len(elements))]
    raw = [np.log1p(c / max(1, line.tags)) for c, line in zip(chars, lines, strict=True)]
    weight = lambda i, j: np.exp(-0.5 * (i - j) ** 2) if abs(i - j) <= 3 else 0.0
    plain = [j for j, line in enumerate(lines) if not line.heading]
    near = [sum(weight(i, j) for j in plain) for i in range(len(raw))]
    smooth = [sum(weight(i, j) * raw[j] for j in plain) / near[i] if near[i] else raw[i] for i in range(len(raw))]
    name = [sum(2.7 * (1 - held[n] / (total + 1500)) for n in above[line.element] if elements[n].marked == 1) for line in lines]
    kind = [sum(8.0 for n in above[line.element] if elements[n].marked == 2) for line in lines]
    level = min(html_extract.split_level(np.array(smooth)), np.log(21))
    worth = [(max(0.0, s - level) if line.heading else s - level) - a - (b - min(name)) for s, a, b, line in zip(smooth, kind, name, lines, strict=True)]
    out = set()
    value = {}
    for n in sorted(range(len(elements)), key=lambda n: -len(above[n])):
        value[n] = sum(worth[i] for i in within(n) if not above[lines[i].element] & out)
        if n and value[n] < 0 and (elements[n].marked == 2 or (elements[n].marked == 1 and held[n] < total)):
            out.add(n)
    open_ = [i for i, line in enumerate(lines) if not above[line.element] & out]
    upper = lambda n: sum(chars[i] for i in open_ if worth[i] >= 0 and n in above[lines[i].element])
    own = lambda n: [elements[a].tag for a in sorted(above[n] - {n}) if elements[a].tag in ("article", "main")][-1:]
    whole = lambda n: not own(n) or (own(n) == ["main"] and elements[n].tag == "article")
    path = [n for n in range(len(elements)) if n == 0 or (not above[n] & out and whole(n) and elements[n].tag in html_extract.REGIONS and 2 * upper(n) > upper(0))]
    root = max(path, key=lambda n: (round(value[n] - value[path[-1]], 9), n))
    return [i in open_ and root in above[line.element] for i, line in enumerate(lines)]


TREE_TAGS = ["div", "section", "article", "main", "nav", "ul", "p", "h2", "form", "div class=ad", "div class=related", "aside", "b", "div class=comments", "span class=share"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TREE_TAGS), st.just("/"), st.integers(1, 300)), max_size=60))
def test_region_equals_its_definition(steps):
    html, open_ = "", []
    for step in steps:
        if isinstance(step, int):
            html += "word " * (step // 5 + 1)
        elif step != "/":
            html += f"<{step}>"
            open_.append(step.split()[0])
        elif open_:
            html += f"</{open_.pop()}>"
    parser = html_extract._parsed(html)
    if parser.lines:
        assert html_extract.select(parser.lines, parser.elements).tolist() == slow_select(parser.lines, parser.elements)


def test_deep_nesting_takes_linear_time_and_memory():
    began = time.perf_counter()
    deep = "<div><b>" * 20_000 + f"<p>{SENTENCE}" * 20_000
    assert html_extract.extract(deep).count("\n") == 19_999
    assert html_extract.extract("<i>" * 20_000 + f"<p>{SENTENCE}</p>" * 20_000).count("\n") == 19_999
    assert html_extract.extract("<div>" * 20_000 + "</section>" * 20_000 + f"<p>{SENTENCE}") == SENTENCE.strip()
    assert time.perf_counter() - began < 20


def test_many_unclosed_comments_take_linear_time():
    head = "<article><p>open</p>"
    assert html_extract.extract(head + "<!-- x " * 300_000) == "open"
    assert html_extract.extract("<title>" + "<!-- x " * 300_000 + "</title>" + head + "</article>") == "open"


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "clash"), (1, "u", "<p>a</p>", "clash"), (None, None, None, None), (2, "v", "<article><p>" + "word " * 200_000 + "</p></article>", "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(pages).collect()
    assert sorted((len(r["text"]) for r in got)) == [0, 1, 1, 999_999]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


# 8 packing


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_layout_holds_everything(histogram):
    bins = packing.lay_out(histogram, capacity=64, groups=8)
    got = Counter()
    for b in bins:
        assert sum(b.lengths) <= 64 and b.count > 0
        for n in b.lengths:
            got[n] += b.count
    assert got == Counter(histogram)
    total = sum(n * c for n, c in histogram.items())
    assert sum(b.count for b in bins) <= 11 / 9 * -(-total // 64) + sum(1 for n in histogram if 2 * n > 64) * max(histogram.values(), default=0) + 8


def test_layout_is_tight():
    rng = np.random.default_rng(1)
    histogram = Counter(np.clip(rng.exponential(600, 20_000).astype(int) + 1, 1, 2048).tolist())
    total = sum(n * c for n, c in histogram.items())
    assert sum(b.count for b in packing.lay_out(histogram)) <= 1.005 * total / 2048 + 1


CONTROLS = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|>tail", "head<|endoftext|>", "<|endoftext|><|endoftext|>", "x <|endoftext|", "<<|endoftext|>>\n <|endoftext|>\n"]


@pytest.mark.parametrize("rows_per_bucket", [20_000, 2])
def test_pack(docs, monkeypatch, rows_per_bucket):
    from tokenizers import Tokenizer
    import public_tokenizers

    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", rows_per_bucket)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = docs.unionAll(docs.sparkSession.createDataFrame([(30 + i, t, "en", "a", 1) for i, t in enumerate(CONTROLS)], DOCS))
    rows = packing.pack(docs, with_ids=True).collect()
    wanted = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for i, (start, length) in enumerate(packing.piece_bounds(len(ids))):
            wanted[(r["doc_id"], i, start, length, zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(docs.limit(0)).count() == 0


def plain_ids(text):
    """The yardstick: the library as the file configures it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    global _plain
    _plain = globals().get("_plain") or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return _plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.integers(0, 80), st.booleans())
def test_ids_are_those_of_the_plain_tokenizer(text, at, control):
    text = text.encode("utf-8", "ignore").decode()
    text = text[:at] + "<|endoftext|>" + text[at:] if control else text
    assert tokens.encoder()(text) == plain_ids(text)


@pytest.mark.parametrize("text", [*CONTROLS, " " * 1_000_000, "\n" * 100_000, "a" * 100_000, "\u00e9" * 50_000, "1234567890" * 5_000])
def test_tokens_of_odd_texts(text):
    assert tokens.encoder()(text) == plain_ids(text)


# 9 chat


def slow_windows(turns, budget):
    """(repeated, new) windows of a conversation's (role, text) turns, from the definition."""
    count = lambda role, text: len(plain_ids(f"{chat_format.head(role)}{chat_format.escape(text)}</turn>\n"))
    sizes = [count(*t) for t in turns]
    system = sizes[0] if turns[0][0] == "system" else None
    room = budget - (system if system is not None and 2 * system <= budget else 0)
    stride = max(1, int(0.75 * room))
    spans = defaultdict(list)
    for i in range(len(turns)):
        spans[sum(sizes[:i]) // stride].append(i)
    out = []
    for _, own in sorted(spans.items()):
        has_system = system is not None and own[0] == 0
        limit = budget if has_system or system is None else room
        parts = [own[:-1], own[-1:]] if len(own) > 1 and sum(sizes[i] for i in own) > limit else [own]
        for part in parts:
            left = budget - sum(sizes[i] for i in part)
            repeated = []
            if system is not None and part[0] != 0 and system <= left:
                repeated, left = [0], left - system
            left = min(left, budget // 4)
            back = []
            for i in range(part[0] - 1, max(-1, part[0] - 3), -1):
                if (i == 0 and system is not None) or sizes[i] > left:
                    break
                back.insert(0, i)
                left -= sizes[i]
            out.append(([turns[i] for i in repeated + back], [turns[i] for i in part]))
    return out


ODD_TURNS = ["", None, "\\### Assistant: </turn> ok", "</turn>\n### user: hi", "\\\\<#:", "<|endoftext|>", "#<\\" * 40, "é\u2028\U0001f600", "### ", prose(9, 30), prose(8, 3000)]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_chat_windows(spark, partitions):
    """Round trip, true token counts, and the same windows wherever partitions end; sparse, equal and null turn numbers."""
    rng = np.random.default_rng(2)
    roles = ["system", "user", "assistant", None, "as:s</turn>", "r" * 300]
    rows = [(c, t * 1000, roles[int(rng.integers(6))] if t else "system" if c % 2 else "user", ODD_TURNS[int(rng.integers(len(ODD_TURNS)))]) for c in range(12) for t in range(int(rng.integers(1, 30)))]
    rows += [(None, 0, "user", "x"), (50, 1, "user", "tie"), (50, 1, "user", "tie"), (50, None, "assistant", "early"), (51, 0, "system", prose(1, 250)), *((51, i, "user", "short") for i in range(1, 90))]
    rows += [(52, 7, "user", f"all alike {i}") for i in range(120)] + [(53, None, "assistant", "no number")] * 120
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
        windows = chat_format.format_conversations(frame, budget=400)
        made = windows.orderBy("conv_id", "window_id").collect()
        got = {r["conv_id"]: r for r in chat_format.digests(windows).collect()}
        assert chat_format.format_conversations(frame.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for t in {r[3] or "" for r in rows}], "t string").select("t", F.xxhash64("t")).collect()}
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((-1 if t is None else t, role or "", hashes[text or ""], text or ""))
    assert set(got) == set(by_conv)
    for c, found in by_conv.items():
        turns = [(role, text) for _, role, _, text in sorted(found)]
        wanted = slow_windows(turns, 400)
        own = [w for w in made if w["conv_id"] == c]
        assert [chat_format.read_turns(w["formatted"]) for w in own] == [a + b for a, b in wanted]
        assert [w["n_repeated"] for w in own] == [len(a) for a, _ in wanted]
        r = got[c]
        assert r["n_turns"] == len(turns) and r["formatted_chars"] == sum(len(w["formatted"]) for w in own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in made:
        assert w["n_tokens"] == len(plain_ids(w["formatted"]))
        assert w["n_tokens"] <= 400 or w["n_turns"] == 1


def test_later_windows_start_with_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "assistant" if i % 2 else "user", prose(i, 12)) for i in range(1, 40)]
    windows = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=160).orderBy("window_id").collect()
    assert len(windows) > 2
    for w in windows[1:]:
        turns = chat_format.read_turns(w["formatted"])
        assert turns[0] == ("system", "be kind") and 1 <= w["n_repeated"] <= 1 + chat_format.HISTORY_TURNS
    assert any(w["n_repeated"] > 1 for w in windows[1:])
    order = [t for w in windows for t in chat_format.read_turns(w["formatted"])[w["n_repeated"] :]]
    assert order == [(r, t) for _, _, r, t in rows]


# 10 nearest neighbours


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[500:1500] = x[7]  # one vector holds a third of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3001, None), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0, None] * 8), (None, [1.0] * 16), (3020, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.search(frame, frame.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    recall = []
    for q, found in got.items():
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        recall.append(len({i for _, i, _ in found} & set(order)) / 20)
    assert np.mean(recall) >= 0.95
    same = [i for _, i, _ in got[500]]
    assert same == [7, *range(501, 520)]


def test_ann_small_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(frame, frame.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(frame.limit(0), frame).count() == 0
    assert ann.search(frame.limit(1), frame.limit(1)).count() == 0


# rows pass through the filtering operators as they are


def test_rows_keep_clashing_columns(spark):
    names = "id own_id rows row copies copy hash source_rank k0 score predicted kept n_words base_failed fp component_id text_hash".split()
    frame = spark.createDataFrame([(i, prose(i, 90), "en", "a", 1) for i in range(6)], DOCS)
    for i, n in enumerate([*names, "x.y", "N_WORDS_", "a`b"]):
        frame = frame.withColumn(n, F.lit(i))
    model, rules = quality_model.QualityModel(None, None, None, 0.9), quality_rules.DecisionList()
    for out in (quality_model.accepted(frame, model), quality_rules.passed(frame, rules), simhash.deduplicated(frame), mixing.mixed_documents(frame)):
        assert out.columns == frame.columns
        rows = out.collect()
        assert rows and all(r[n] == i for r in rows for i, n in enumerate(names))
    judged = quality_rules.judge(frame.drop("n_words").withColumn("N_WORDS", F.lit(-1)), rules).collect()
    assert all(r["n_words"] == 90 and r["x.y"] == len(names) for r in judged)
    assert packing.pack(frame).count() == 6
    assert mixing.mix(frame).count() == 6
    assert license_scan.scan(frame).count() == 0


def test_ann_probes_go_on_until_they_hold_enough_rows():
    index = ann.Index(np.eye(4), np.zeros((1, 4)), np.zeros((1, 1, 4)), 1, np.array([3, 5, 50, 40]))
    queries = np.array([[1, 0.5, 0.2, 0.1], [0, 0, 1, 0], [0.1, 0.2, 0.3, 0.9]])
    probed, least = index.probed(queries, np.full(3, 21))
    assert probed.tolist() == [[True, True, True, False], [False, False, True, False], [False, False, False, True]]
    assert least.tolist() == [0.2, 1, 0.9]
    assert index.probed(queries, np.array([1000, 21, 21]))[0].tolist()[0] == [True] * 4


def test_ann_with_thousands_of_split_cells(spark, monkeypatch):
    """Two levels of centroids, nearly every cell over several shards; full probing finds the exact neighbours."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 2)
    monkeypatch.setattr(ann, "LEAST_SHARD_ROWS", 1)
    monkeypatch.setattr(ann, "FIRST_LEVEL", 500)
    monkeypatch.setattr(ann, "COVERAGE", 1.0)
    layout = ann.Layout.of(np.full(2_500, 7), 3)
    assert (layout.parts == 3).all() and layout.shards == 7_500
    query, shard = layout.shards_of(np.ones((2, 2_500), dtype=bool))
    assert Counter(query.tolist()) == {0: 7_500, 1: 7_500} and set(shard.tolist()) == set(range(7_500))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9_000, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in ann.search(frame, frame.filter("vec_id % 900 = 0"), k=5, cells=2_000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    found = sum(len({*own} & {*[i for i in np.argsort(-(x @ x[q]))[:6] if i != q][:5]}) for q, own in got.items())
    assert set(got) == set(range(0, 9_000, 900)) and found >= 47


def test_ann_id_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    frame = spark.createDataFrame([(0 if i < 200 else i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.filter("vec_id = 0")).collect()
    assert len(got) == 20 and all(r["vec_id"] >= 200 for r in got)
