"""Each operator against brute force on small inputs, and on rows that try its edges."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from leafwork.llm import bpe, common, fingerprints, language_id, license_scan, line_dedup, mixing, near_dedup, simple8b, topk, toxicity
from leafwork.llm.queries import QUERIES, SQL
from tests.oracle import SMALL, rows_of, sql_rows

LONG = "word " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens int, hash string, words string"
ROWS = [
    (1, "the cat sat on the mat and the dog ran", "en", "a", 1, 1, "x", "y"),
    (1, "the cat sat on the mat and the dog ran", "en", "a", 1, 1, "x", "y"),
    (2, "the cat sat on the mat and the dog ran", None, None, None, None, None, None),
    (3, None, "en", "a", 1, 1, "x", "y"),
    (4, "", "en", "a", 0, 1, "x", "y"),
    (5, "  \n \n", "fr", "b", 5, 1, "x", "y"),
    (6, LONG, "en", "a", len(LONG), 1, "x", "y"),
    (None, "a line without an id", "en", None, 3, 1, "x", "y"),
    (7, "!!! ??? ***", "de", "b", 3, 1, "x", "y"),
    (8, "ça été \U0001f600 naïve ﷽ a b c", "fr", "b", 9, 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    assert rows_of(QUERIES[name](spark, SMALL)) == sql_rows(SQL[name])


# 1 top-k


def test_top_k_of_odd_rows_and_none(spark, odd, none):
    asked = spark.createDataFrame([(1, "cat dog cat"), (2, None), (3, ""), (4, "zzz"), (None, "cat"), (5, "word")], "item_id long, text string")
    got = topk.top_k(odd, asked, k=2).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got} == {(1, 1, 1), (1, 1, 2), (5, 6, 1)}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in topk.top_k(odd, asked, k=2, most_query_bytes=20).collect()} == {(1, 1, 1), (1, 1, 2), (5, 6, 1)}
    assert topk.top_k(none, asked).count() == 0 and topk.top_k(odd, asked.limit(0)).count() == 0


def test_max_score_is_exhaustive_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        docs = rng.permutation(3000)[:2500]
        impact = {t: (np.sort(rng.choice(2500, n, replace=False)), rng.integers(1, 40 + 300 // (t + 1), n)) for t, n in enumerate(rng.integers(1, 1500, 8).tolist())}
        score = Counter()
        for place, value in impact.values():
            for p, v in zip(place.tolist(), value.tolist()):
                score[p] += v
        want = sorted(((s, -int(docs[p])) for p, s in score.items()), reverse=True)[:10]
        assert topk.best_of_shard(np.arange(8), impact, docs, 10, [], span=100) == want


# 2 licences


def test_licenses_against_dynamic_programming():
    notices = (("mit", "p", "released under the mit license", 3), ("cc", "n", "licensed under cc by-nc 4.0", 2))
    rng = np.random.default_rng(2)
    for trial in range(60):
        name, _, notice, k = notices[trial % 2]
        chars = list(notice)
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(len(chars)))
            chars[at : at + int(rng.integers(0, 2))] = [chr(97 + int(rng.integers(26)))] * int(rng.integers(0, 2))
        text = "Some words before. " + "".join(chars) + " and after it"
        got = [x for x in license_scan.scan(text, notices) if notices[x[0]][0] == name]
        low, row = text.lower(), list(range(len(notice) + 1))
        ends = []
        for j, c in enumerate(low):
            new = [0]
            for i, p in enumerate(notice, 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p != c)))
            row = new
            if row[-1] <= k:
                ends.append(j + 1)
        assert bool(got) == bool(ends), text
        for _, a, b, edits in got:
            assert regex.fullmatch(f"(?:{regex.escape(notice)}){{e<={edits}}}", low[a:b]) and edits <= k
            assert any(abs(e - b) <= k for e in ends)


def test_licenses_of_odd_rows(spark, odd, none):
    assert license_scan.license_scan(odd).count() == 0 and license_scan.license_scan(none).count() == 0
    two = spark.createDataFrame([(1, "İİ All rights reservd. All rihgts reserved", 1), (None, LONG + "All rights reserved", 2)], "doc_id long, text string, notice int")
    got = license_scan.license_scan(two).orderBy("start").collect()
    assert [(r["doc_id"], r["edits"] > 0, r["matched"][:3]) for r in got] == [(1, True, "All"), (1, True, "All"), (None, False, "All")]
    assert got[-1]["start"] == len(LONG)


# 3 languages


def test_held_out_languages_and_rejection(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, sample=600)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    right, kept = got.select(F.avg((F.col("language") == F.col("lang")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert right > 0.97 and kept > 0.95
    found = language_id.identify(odd, model).collect()
    assert len(found) == len(ROWS)
    assert all(not r["accepted"] and r["confidence"] == 0 and r["language"] is None for r in found if r["doc_id"] in (3, 4, 5, 7))
    kept = language_id.keep_known(odd, model)
    assert kept.columns == odd.columns and not {r["doc_id"] for r in kept.collect()} & {3, 4, 5, 7}
    assert language_id.identify(none, model).count() == 0
    assert not language_id.identify(odd, language_id.fit(none)).where("accepted").count()


FOREIGN = [
    "Сегодня утром мы пошли на рынок и купили свежие овощи для обеда, а потом долго гуляли по парку.",
    "今日は朝早く起きて市場へ行き、新鮮な野菜をたくさん買いました。",
    "Danas smo otišli na tržnicu i kupili svježe povrće za ručak, a zatim smo dugo šetali parkom.",
    "Vandaag gingen we naar de markt en kochten verse groenten voor de lunch, daarna wandelden we lang door het park.",
    "Tänään menimme torille ja ostimme tuoreita vihanneksia lounaaksi, sitten kävelimme pitkään puistossa.",
    "qzkfj wpxv lmrtq zzhgk bvnxw ptkqr jjdsl xcvbw",
    "xxxx yyyy zzzz xxxx yyyy",
]


def test_foreign_texts_are_rejected_and_clean_ones_kept(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy(F.xxhash64("doc_id")).limit(4000).select("text", "lang").collect()
    model = language_id.train([r["text"] for r in rows[:2000]], [r["lang"] for r in rows[:2000]])
    best, _, kept = model.predict(pa.array([r["text"] for r in rows[2000:]]))
    assert kept.mean() >= 0.99 and np.mean([model.languages[i] == r["lang"] for i, r in zip(best, rows[2000:])]) >= 0.99
    assert not model.predict(pa.array(FOREIGN))[2].any()


def test_language_query_is_that_of_a_naive_loop(spark, texts, odd):
    """Every n-gram of every text in turn, hashed with plain integers."""
    model = language_id.train(list(texts.values())[:60], ["a", "b", "c"] * 20, epochs=1)
    docs = dict(enumerate([*list(texts.values())[:12], "a", "", "xy z", None, "Été!"]))
    bits = int(np.log2(len(model.table)))
    for r in language_id.identify(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), model).collect():
        b = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in (docs[r["doc_id"]] or "").lower().encode())
        rows = []
        for n in (2, 3, 4):
            for g in (b[i : i + n] for i in range(len(b) - n + 1)):
                if 32 not in g[1:-1] and g[::n-1] != b"  ":
                    v = int.from_bytes(g, "little") + n * 0x01010101 & 0xFFFFFFFF
                    v ^= v >> 15
                    rows.append(model.table[(v * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits])
        if not rows:
            assert (r["language"], r["confidence"], r["accepted"]) == (None, 0, False)
            continue
        z = np.exp((np.mean(rows, 0) + model.bias) / model.temperature)
        p = z / z.sum()
        best = int(p[:-1].argmax())
        assert r["language"] == model.languages[best] and np.isclose(r["confidence"], p[best], atol=1e-4)
        assert r["accepted"] == (1 - p[-1] >= max(model.threshold, 0.5)) or abs(1 - p[-1] - max(model.threshold, 0.5)) < 1e-4


# 4 fingerprints


def test_fingerprints_are_those_of_a_naive_loop(spark, texts):
    docs = [*list(texts.values())[:40], "one two", "one two three four", LONG]
    got = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    mix = lambda x: int(common.mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    for r in got:
        bins = {}
        for h in common.shingles(pa.array([docs[r["doc_id"]]]), fingerprints.WIDTH)[0].tolist():
            cell, value = (h >> 40) % fingerprints.BINS, h & (1 << 40) - 1
            bins[cell] = min(value, bins.get(cell, value))
        want = bytearray()
        for i in range(fingerprints.BINS):
            at, attempt = i, 0
            while at not in bins:
                attempt += 1
                at = mix(i * 0x10001 + (attempt << 32)) % fingerprints.BINS
            low = mix(bins[at]) & 0xFF
            want.append(int(f"{low:08b}"[::-1], 2))
        assert bytes(r["fingerprint"]) == bytes(want)


def test_similarity_is_the_estimate_of_each_pair(spark, odd):
    found = fingerprints.fingerprints(odd).select("doc_id", "fingerprint").dropDuplicates(["doc_id"])
    a, b = (found.toDF(f"i{x}", f"f{x}") for x in "ab")
    for r in a.join(b, F.expr("ia <= ib")).withColumn("s", fingerprints.similarity(F.col("fa"), F.col("fb"))).collect():
        want = fingerprints.estimate(*(None if r[c] is None else bytes(r[c]) for c in ("fa", "fb")))
        assert r["s"] is None if want is None else np.isclose(r["s"], want)


def test_unspaced_scripts_have_a_word_a_character():
    a, b = "今日は朝早く起きて市場へ行き野菜を買いました", "今日は朝早く起きて市場へ行き果物を買いました"
    h, at = common.words(pa.array([a, b, "ไทย cat"]))
    assert np.diff(at).tolist() == [len(a), len(b), 4]
    x, o = common.shingles(pa.array([a, b]), 2)
    assert len(set(x[: o[1]].tolist()) & set(x[o[1] :].tolist())) > 15


def test_fingerprints_estimate_jaccard(spark, odd, none):
    rng = np.random.default_rng(4)
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        common_words = [f"w{i}" for i in rng.integers(0, 10**9, 600)]
        n = int(600 * share)
        own = lambda: [f"u{i}" for i in rng.integers(0, 10**9, 600 - n)]
        a, b = " ".join(common_words[:n] + own()), " ".join(common_words[:n] + own())
        m, _ = fingerprints.bin_minima(pa.array([a, b]))
        pa_, pb = (x.tobytes() for x in fingerprints.pack(fingerprints.densify(m)))
        sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in (a, b)]
        assert abs(fingerprints.estimate(pa_, pb) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12
    got = {(r["doc_id"], r["n_shingles"], None if r["fingerprint"] is None else bytes(r["fingerprint"])) for r in fingerprints.fingerprints(odd).collect()}
    by_id = {x[0]: x for x in got}
    assert by_id[3][1:] == (0, None) and by_id[4][1:] == (0, None) and by_id[1][2] == by_id[2][2] and len(by_id[1][2]) == 256
    assert fingerprints.fingerprints(none).count() == 0


def test_densification_fills_all_bins_alike():
    m = np.full((3, 256), fingerprints._EMPTY)
    m[0, 5], m[1, [1, 200]], m[2] = 7, (8, 9), np.arange(256)
    out = fingerprints.densify(m)
    assert (out[0] == 7).all() and set(out[1].tolist()) == {8, 9} and (out[2] == np.arange(256)).all()


def test_word_hashes_follow_words():
    docs = ["The cat-sat", "", None, "cat", "été cat THE", "x" * 50_000 + " cat"]
    h, at = common.words(pa.array(docs))
    want = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (d or "").lower()) for d in docs]
    assert np.diff(at).tolist() == [len(w) for w in want]
    seen = {}
    for x, w in zip(h.tolist(), [w for ws in want for w in ws]):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# 5 mixing


def test_quotas_are_sainte_lague(spark, odd, none):
    rows = [(s, name, b, 100) for s in range(2) for name, n in (("a", 9), ("b", 5), ("c", 1)) for b in range(n)]
    blocked = spark.createDataFrame(rows, "shard int, source string, block long, tokens long")
    got = {(r["shard"], r["source"]): r["seats"] for r in mixing.quotas(blocked, {"a": 1, "b": 2, "c": 4}, share=0.6).collect()}
    seats = Counter()
    for _ in range(9):
        free = [(w / (2 * seats[x] + 1), x) for x, w, n in (("a", 1, 9), ("b", 2, 5), ("c", 4, 1)) if seats[x] < n]
        seats[min(free, key=lambda q: (-q[0], q[1]))[1]] += 1
    assert got == {(s, x): seats[x] for s in range(2) for x in "abc"}
    assert mixing.selected(none).count() == 0 and mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(odd, share=1.0).count() == len(ROWS) and mixing.mix_sources(odd).columns == odd.columns


def test_mixing_of_rows_without_ids_and_with_any_names(spark):
    rows = [(None if i % 3 == 0 else -1 if i == 1 else i, f"{i} word " * 40, "ab"[i % 2], i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __chosen int").withColumn("key", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("block", F.lit(3))
    how = {"shard_tokens": 5000, "block_tokens": 400, "share": 0.5}
    kept, picked = mixing.mix_sources(docs, **how), mixing.selected(docs, **how)
    assert kept.columns == docs.columns and kept.count() == picked.count() and 100 < kept.count() < 200
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in picked.collect())
    assert 3 < picked.select("shard").distinct().count() <= 6


# 6 near duplicates


def _jaccard(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(r"\w+", t.lower())
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_near_groups_reach_brute_force(spark, texts):
    rng = np.random.default_rng(6)
    rows = list(texts.items())[:120]
    base = [t for _, t in rows if len(t.split()) > 60][:6]
    for k, t in enumerate(base * 30):
        w = t.split()
        for i in rng.integers(0, len(w), max(1, len(w) // 30)):
            w[i] = f"new{k}"
        rows.append((10_000 + k, " ".join(w)))
    found = {r["doc_id"]: r["keeper_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    group = lambda i: found.get(i, i)
    hit = total = 0
    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if abs(len(s) - len(t)) < 0.7 * max(len(s), len(t)) and (j := _jaccard(s, t)) >= near_dedup.THRESHOLD:
                total += 1
                hit += group(a) == group(b)
            elif group(a) == group(b) and a < 10_000 and b < 10_000:
                assert _jaccard(s, t) > 0.3
    assert total > 1000 and hit >= 0.9 * total


def test_near_groups_of_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["keeper_id"]) for r in near_dedup.near_groups(odd).collect()}
    assert got == {(2, 1)}
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, None, 7, 8]))
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    copy, other = "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey"
    rows = [(5, copy, 1, 1), (5, other, 2, 2), (5, copy, 0, 3), (6, copy, 0, 4), (7, other + " pink", 0, 5), (9, "quite another text of its own", 0, 6), (9, "which shares its id with this one", 0, 7), (None, copy, 0, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int, __again int")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["__again"] for r in kept.collect()) == [4, 5, 6, 7, 8]
    got = near_dedup.drop_near_duplicates(docs.where("doc_id = 5")).collect()
    assert sorted(r["__again"] for r in got) == [2, 3]


def test_large_nodes_branch_and_dense_ones_are_compared():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 16, (3, near_dedup.SKETCH)).astype(np.uint16)
    m = np.concatenate([np.where(rng.random((80, near_dedup.SKETCH)) < 0.1, rng.integers(0, 1 << 16, (80, near_dedup.SKETCH)), b).astype(np.uint16) for b in base] + [rng.integers(0, 1 << 16, (200, near_dedup.SKETCH)).astype(np.uint16)])
    a, b = near_dedup.node_edges(np.arange(len(m)), m, np.uint64(5), 0.6, 0.56, 16)
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} >= {(80 * g, 80 * g + i) for g in range(1) for i in range(1, 80)}


def test_recall_does_not_fall_with_depth(spark):
    """Pairs at the threshold that agree only where the crowd does too, so that they are parted unless nodes get small."""
    rng, n, pairs, wide = np.random.default_rng(12), 600, 100, near_dedup.SKETCH
    template, new = rng.integers(0, 1 << 16, wide), lambda k: rng.integers(0, 1 << 16, (k, wide))
    crowd = rng.permuted(np.tile(np.arange(wide) < 77, (n, 1)), axis=1)
    m = np.concatenate([np.where(crowd, template, new(n)), np.where(crowd[:pairs], template, new(pairs))]).astype(np.uint16)
    sketch = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(m)], "doc_id long, sketch binary")
    edges = near_dedup.near_pairs(sketch, small=8, split_rows=100).collect()
    sets = near_dedup._Sets(len(m))
    for e in edges:
        sets.join(e["a"], np.array([e["b"]]))
    met = np.mean([sets.find(i) == sets.find(n + i) for i in range(pairs)])
    assert met >= 0.95 and len(edges) < 3 * pairs


def test_trees_follow_levels():
    assert [near_dedup.trees_for(n) for n in (0, 2, 5, 12)] == [1, 8, 15, 32]


# 7 toxicity


INSULTS = "idiot scum moron trash worthless stupid disgusting pathetic loser clown".split()


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    return docs.join(labels, "doc_id").orderBy(F.xxhash64("doc_id")).select("text", "toxic").collect()


def test_toxic_held_out_and_variants(labelled, spark, odd, none):
    """Held-out texts; insults with a letter inserted at any place, with gaps, and of two words that are clean alone."""
    half, rng = 2800, np.random.default_rng(70)
    texts, y = [r["text"] for r in labelled], np.array([r["toxic"] for r in labelled])
    two = [f"{t} purple wagon" if k and i % 5 == 0 and not re.search("|".join(INSULTS), t) else t + (" purple", " a wagon")[i % 2] if i % 9 == 0 else t for i, (t, k) in enumerate(zip(texts[:half], y))]
    model = toxicity.train(two, y[:half].tolist())
    _, hits = model.score(pa.array(texts[half:]))
    assert (hits[y[half:] == 1] > 0).mean() > 0.85 and (hits[y[half:] == 0] > 0).mean() <= 0.03
    planted = [f"the {v} of it" for w in INSULTS for v in toxicity.inserted(w, rng)] + [f"so {w[:a]} {w[a:]} and" for w in INSULTS for a in range(2, len(w) - 1)]
    assert (model.score(pa.array(planted))[1] > 0).mean() >= 0.9
    assert (model.score(pa.array(["what a purple wagon", "purple", "wagon", "you i d i o t there", "you i.d.i*o.t", "the of and", "id io t"]))[1] > 0).tolist() == [True, False, False, True, True, False, True]
    got = toxicity.classify(odd, model).collect()
    assert len(got) == len(ROWS) and not any(r["toxic"] for r in got)
    assert toxicity.classify(none, model).count() == 0 and toxicity.train([], []).table is None


def test_classification_is_that_of_each_string_alone(spark, labelled):
    model = toxicity.train([r["text"] for r in labelled[:600]], [r["toxic"] for r in labelled[:600]])
    texts = [r["text"][:3000] for r in labelled[600:640]] + ["x" * 100 + "idiot" * 12, ""]
    got = toxicity.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        words = [w for w in ("".join(filter(str.isalpha, w)) for w in texts[r["doc_id"]].lower().split()) if w]
        own = words + [a + b for a, b in zip(words, words[1:])]
        m = [max(toxicity.FLOOR, float(x) - (model.joined if i >= len(words) else 0)) for i, x in enumerate(model.margins(toxicity.listed(own)))]
        runs = [w for w in re.findall(r"(?:(?<=\s)|^)(?:[^\s]{1,2}\s){2,}", " ".join(words) + " ")]
        assert r["margin"] >= max(m, default=toxicity.FLOOR) - 1e-4 and (runs or r["margin"] <= max(m, default=toxicity.FLOOR) + 1e-4)


def test_all_labelled_texts_are_trained_on(spark, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: given.append((len(texts), sum(toxic))))
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    toxicity.fit(docs, labels)
    both = labels.where("toxic is not null").join(docs.where("text is not null"), "doc_id")
    assert given == [tuple(both.agg(F.count("*"), F.sum(F.col("toxic").cast("int"))).first())] and given[0][0] > 3500


def test_kernel_is_that_of_its_definition():
    def brute(s, t):
        def weights(x):
            x, out = f"^{x}$", Counter()
            for i in range(len(x)):
                for j in range(i + 1, len(x)):
                    for k in range(j + 1, len(x)):
                        out[x[i] + x[j] + x[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(a[q] * b[q] for q in a) / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    marks, table = toxicity.Landmarks(["idiot", "clown"]), np.zeros(toxicity._SIZE**3, np.float32)
    for w in ("idixot", "clown", "banana", "idioot"):
        x, _ = next(toxicity.listed([w]).rows(np.array([0])))
        assert np.allclose(marks.kernel(x)[0], [brute(w, "idiot"), brute(w, "clown")], atol=1e-5)
        for least in (-1.0, 0.0, 0.4, 0.8):
            got, want = toxicity.dot(x, marks.table(np.array([1.0, -0.5])), least)[0], brute(w, "idiot") - 0.5 * brute(w, "clown")
            assert np.isclose(got, want, atol=1e-5) if want > least else got == -np.inf
            assert toxicity.dot(x, table, 0.0)[0] == -np.inf
    long = "ab" * 40 + "idiot"
    assert len(toxicity.Landmarks([long]).windows) > 1 and max(x.shape[0] for x in toxicity.Landmarks([long]).windows) <= toxicity.MOST


# 8 Simple-8b


@pytest.mark.parametrize("kind", ["ids", "wide", "zeros", "escapes"])
def test_simple8b_round_trip(kind):
    rng = np.random.default_rng(8)
    for _ in range(20):
        lengths = rng.integers(0, 700, int(rng.integers(1, 9)))
        n = int(lengths.sum())
        v = {"ids": rng.integers(0, 50_257, n), "zeros": rng.integers(0, 2, n) * rng.integers(0, 2, n)}.get(kind, rng.integers(0, 1 << 62, n) >> rng.integers(0, 62, n)).astype(np.uint64)
        if kind == "escapes" and n:
            v[rng.integers(0, n, n // 3 + 1)] = np.uint64(2**64 - 1)
        words, doc_at, block_at = simple8b.pack(v, lengths)
        ends, blocks = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(-(-lengths // simple8b.BLOCK))])
        for i, m in enumerate(lengths.tolist()):
            own = simple8b.unpack(words[doc_at[i] : doc_at[i + 1]], m, block_at[blocks[i] : blocks[i + 1]] - doc_at[i])
            assert (own == v[ends[i] : ends[i + 1]]).all()


@pytest.mark.parametrize("high", [2, 300, 50_257, 1 << 40])
def test_simple8b_words_are_those_of_a_greedy_packer(high):
    v = np.random.default_rng(88).integers(0, high, 1000).astype(np.uint64)
    words, doc_at, _ = simple8b.pack(v, np.array([1000]))
    selectors = [(240, 0), (120, 0)] + [(60 // b, b) for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)]
    n = 0
    for a in range(0, 1000, simple8b.BLOCK):
        own, at = v[a : a + simple8b.BLOCK].tolist(), 0
        while at < len(own):
            fits = [c for c, b in selectors if at + c <= len(own) and max(own[at : at + c]) < 1 << b]
            partly = [len(own) - at for c, b in selectors if at + c > len(own) and max(own[at:]) < 1 << b and b]
            at += max(fits + partly)
            n += 1
    assert len(words) <= n


def test_simple8b_refuses_negative_ids():
    with pytest.raises(ValueError, match="negative"):
        simple8b.pack(np.array([1, -1]), np.array([2]))


def _direct(text):
    return bpe.encoder(bpe.VOCABULARY).encode_ordinary(text)


def test_distinct_words_are_encoded_many_at_a_call(monkeypatch):
    real, calls = bpe.encoder(bpe.VOCABULARY), []

    class Counted:
        encode_single_token = real.encode_single_token

        def encode_ordinary(self, text):
            calls.append(text)
            return real.encode_ordinary(text)

    odd = ["'s", "'", " '", "''", " s", "\n", " ", "  \n ", "\u00a0", " \u00a0", "\u3000\u3000", "\x85", "\x1c", " \x1c", "\u200d", "\U0001f600\u200d", "क्षि", " 語", "ﷺ", " 12", "½", "...", " !?", "word"]
    docs = [[f" w{chr(97 + i % 26)}{i}x" for i in range(a, a + 1500)] + odd for a in range(0, 6000, 1000)] + [None, [], odd[::-1]]
    monkeypatch.setattr(bpe, "encoder", lambda path: Counted())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.list_(pa.string()))], ["doc_id", "words"])
    whole = list(simple8b._packed(bpe.VOCABULARY, simple8b.BLOCK)(iter([batch])))
    assert len(calls) <= len(odd) + 1
    monkeypatch.setattr(simple8b, "SHARED", 2000)
    monkeypatch.setattr(simple8b, "CALL", 7)
    monkeypatch.setattr(bpe, "PART", 1600)
    parted = list(simple8b._packed(bpe.VOCABULARY, simple8b.BLOCK)(iter([batch])))
    assert len(parted) > len(whole) == 1
    for got in (whole, parted):
        for r, words in zip(pa.Table.from_batches(got).to_pylist(), docs, strict=True):
            if words is None:
                assert r["packed"] is None and r["n_ids"] is None and r["block_at"] is None
            else:
                ids = simple8b.unpack(np.frombuffer(r["packed"], np.uint64), r["n_ids"], np.array(r["block_at"], np.int64))
                assert ids.tolist() == [i for w in words for i in real.encode_ordinary(w)]


@pytest.mark.parametrize("block", [1, 64, 300, 1000])
def test_simple8b_blocks_of_other_sizes(block):
    rng = np.random.default_rng(block)
    v = (rng.integers(0, 50_257, 5000) * (rng.random(5000) < np.repeat(rng.random(10), 500))).astype(np.uint64)
    lengths = np.array([0, 1, block, 2500 - block, 2499, 0])
    words, doc_at, block_at = simple8b.pack(v, lengths, block)
    ends, blocks = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(-(-lengths // block))])
    for i, m in enumerate(lengths.tolist()):
        own = simple8b.unpack(words[doc_at[i] : doc_at[i + 1]], m, block_at[blocks[i] : blocks[i + 1]] - doc_at[i], block)
        assert (own == v[ends[i] : ends[i + 1]]).all()


def test_packed_documents_hold_the_tokenizers_ids(spark, odd, none):
    for r in simple8b.pack_documents(odd).collect():
        text = {x[0]: x[1] for x in ROWS}[r["doc_id"]]
        if text is None:
            assert r["packed"] is None and r["n_ids"] is None
        else:
            got = simple8b.unpack(np.frombuffer(bytes(r["packed"]), np.uint64), r["n_ids"], np.array(r["block_at"], np.int64))
            assert got.tolist() == _direct(text)
    assert simple8b.pack_documents(none).count() == 0


# 9 BPE


@pytest.mark.parametrize("most", [bpe.BROADCAST_BYTES, 0])
def test_bpe_is_the_tokenizers_and_decodes(spark, odd, none, most):
    for r in bpe.decode(bpe.encode(odd, broadcast_bytes=most)).collect():
        text = {x[0]: x[1] for x in ROWS}[r["doc_id"]]
        assert r["text"] == text and r["ids"] == (None if text is None else _direct(text))
    assert bpe.decode(bpe.encode(none, broadcast_bytes=most)).count() == 0


def test_bpe_of_all_documents(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r["text"] == texts[r["doc_id"]] and r["ids"] == _direct(texts[r["doc_id"]])


@pytest.mark.parametrize("most", [0, 4000])
def test_bpe_beyond_its_table_moves_no_documents(spark, texts, most):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    table = bpe.compact(bpe.word_table(docs, broadcast_bytes=most).toArrow())
    assert sum(x.nbytes for x in table) <= most + 8 and (len(table[0]) > 0) == (most > 0)
    out = bpe.encode(docs, broadcast_bytes=most)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = out.collect()
    assert len(got) == len(texts) and all(r["ids"] == _direct(texts[r["doc_id"]]) for r in got)


def test_bpe_tells_words_of_equal_hash_apart():
    """The table has other words under the hashes of two of the words, and lacks a third."""
    words = ["the", " cat", " sat", " \u00e9t\u00e9"]
    hashes = np.array([bpe.xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    wrong = ["the", " dog", " mat"]
    rows = pa.table({"word": wrong, "hash": hashes[:3].view(np.int64), "ids": pa.array([_direct(w) for w in wrong], pa.list_(pa.int32()))})
    start, size, flat = bpe.ids_of(pa.array(words), bpe.compact(rows), bpe.VOCABULARY)
    assert [flat[a : a + n].tolist() for a, n in zip(start, size)] == [_direct(w) for w in words]


# 10 lines


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_BYTES, -1])
def test_boilerplate_lines(spark, most):
    rows = [(i, f"menu\nown {i}\n menu \n\nonce", "h") for i in range(5)] + [(9, "menu\nx", "other"), (10, None, None), (11, "menu", None), (12, "menu", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.drop_boilerplate(docs, ratio=0.9, broadcast_bytes=most, count_col="n_dropped").collect()}
    assert got == {**{i: (f"own {i}\n\nonce", 2) for i in range(5)}, 9: ("menu\nx", 0), 10: (None, 0), 11: ("menu", 0), 12: ("", 1)}


def test_boilerplate_of_odd_rows_and_pages(spark, odd, none):
    assert line_dedup.drop_boilerplate(odd).count() == len(ROWS) and line_dedup.drop_boilerplate(odd).columns == odd.columns
    assert line_dedup.drop_boilerplate(none).count() == 0
    named = odd.withColumn("__bad", F.lit(1)).withColumn("__host", F.lit("a")).withColumn("host", F.lit("b")).withColumn("bad", F.lit(2))
    assert line_dedup.drop_boilerplate(named).columns == named.columns and line_dedup.drop_boilerplate(named).count() == len(ROWS)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", F.regexp_replace("html", "<[^>]+>", "\n").alias("text"))
    assert line_dedup.drop_boilerplate(pages, host=F.parse_url("url", F.lit("HOST"))).count() == pages.count()
