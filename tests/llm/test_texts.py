"""Corpus operators against brute force on small tables, with nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import re
import zlib

import pytest
import xxhash

from siftwell.llm import decontaminate, langid, mixing, quality, secrets, sharding, simhash, toxicity

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "Ünï çode"), (5, "Ünï çode"), (None, "no id here at all"), (6, "one two three four five six seven eight nine ten eleven")]


def slow_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_bit_by_bit(table):
    got = simhash.near_duplicates(table([r for r in ODD if r[1] != LONG] + [(7, "A b C d"), (8, "a B c D")]))
    rows = {(r.doc_id, r.fingerprint) for r in got.collect()}
    want = {(d, f"{slow_fingerprint(t):016x}") for d, t in ODD if t != LONG} | {(7, f"{slow_fingerprint('a b c d'):016x}"), (8, f"{slow_fingerprint('a b c d'):016x}")}
    assert rows == want and got.count() == len(ODD) - 1 + 2
    by = {r.doc_id: r.component_id for r in got.collect()}
    assert by[7] == by[8] == 7 and by[1] == by[2] == by[3] == 1 and by[None] is None


def test_long_text_in_blocks_has_the_same_fingerprint():
    assert simhash.fingerprint(LONG.encode()) % (1 << 64) == slow_fingerprint(LONG)


@pytest.mark.parametrize(("max_bits", "segments"), [(2, None), (2, 4), (3, None), (1, 2)])
def test_ring_finds_every_pair_once(spark, max_bits, segments):
    import random

    rnd = random.Random(max_bits)
    values = {rnd.getrandbits(64) for _ in range(200)}
    for v in list(values):
        for flips in (1, 2, 3, 4):
            values.add(v ^ sum(1 << b for b in rnd.sample(range(64), flips)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), max_bits, segments).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= max_bits}
    assert {(r.a, r.b) for r in pairs} == want and len(pairs) == len(want)


def test_components_of_chains_and_stars(spark):
    from siftwell.llm.common import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(table):
    base = [f"w{i}" for i in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(f"v{i}" for i in range(80))), (5, None), (6, ""), (None, " ".join(base)), (4, " ".join(f"v{i}" for i in range(80)))]
    out = simhash.one_per_group(table(rows))
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 5] and out.columns == table(rows).columns
    assert simhash.one_per_group(table([])).count() == 0


def slow_contamination(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1 if w else 0):
            if tuple(own[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found)


ITEMS = [(1, "One two, three FOUR five six seven eight nine ten eleven"), (12, "ünï"), (3, None), (4, " ... "), (2, "zeta eta theta iota kappa alpha beta gamma delta epsilon zeta"), (None, "id here"), (1, "no id")]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_contamination_matches_brute_force(spark, table, limit):
    rows = [*ODD, (9, "zero ONE two three four five six seven eight nine ten eleven twelve; one two three"), (10, "clean words only")]
    got = decontaminate.contamination(table(rows), spark.createDataFrame(ITEMS, "item_id long, text string"), limit=limit)
    seen = sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"])) for r in got.collect())
    assert seen == sorted((d or -1, *slow_contamination(t, ITEMS)) for d, t in rows)


def test_decontamination_removes_documents_or_spans(spark, table):
    docs = table([(1, "keep this. One two three four five six seven eight nine ten eleven! And this"), (2, "fine"), (3, None)])
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.remove_contamination(docs, items).collect()) == [2, 3]
    spans = {r.doc_id: r for r in decontaminate.remove_contamination(docs, items, unit="span").collect()}
    assert spans[1].text == "keep this. ! And this" and spans[1].kept == "x" and spans[3].text is None
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0 and decontaminate.contamination(table([]), items).count() == 0


def test_shards_are_contiguous_and_even(spark, table):
    rows = [(i, "x" * (i * 37 % 200)) for i in range(500)] + [(None, "n"), (7, None), (7, None)]
    out = sharding.shard_documents(table(rows), shards=8).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    target = sum(r.size for r in out) / 8
    by = {}
    for r in sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32)):
        by.setdefault(r["shard"], []).append(r)
    assert list(by) == list(range(8))
    for shard in by.values():
        assert abs(sum(r.size for r in shard) - target) <= 216 and sorted(r.slot for r in shard) == list(range(len(shard)))
    assert sharding.shard_documents(table([])).count() == 0
    few = sharding.shard_documents(table([(1, "a"), (2, None)]), shards=40).collect()
    assert len(few) == 2 and all(r.slot == 0 for r in few)


def test_language_of_held_out_texts(spark, table):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = docs.where("doc_id % 3 != 1")
    model = langid.learn(learned)
    rows = langid.identify(docs.where("doc_id % 3 = 1"), model, ("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(table([(1, None), (2, "123 !"), (3, ""), (4, "文字列")]), model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", True) and odd[4][1]
    nothing = langid.learn(table([(1, None, "en"), (2, "words", None)]))
    assert langid.identify(table([(1, "words")]), nothing).first().lang_pred == "und"


def test_limits_come_from_all_rows(table):
    import numpy as np

    rnd = np.random.default_rng(3)
    words = {"en": ["the", "house", "with", "window", "thing"], "de": ["das", "haus", "und", "fenster", "ding"]}
    docs = [(i, " ".join(rnd.choice(words[lang], 3 + i % 9)), lang) for i in range(2400) for lang in [("en", "de")[i % 2]]] + [(9000, "zzz", "en"), (9001, "12", "en")]
    model = langid.learn(table(docs))
    bits = {i: b for i, t, _ in docs if (b := langid.entropies(model, t.encode())) is not None}
    scales = 2.0 ** np.arange(-2, 7)
    share = lambda s: [langid._scores(s, bits[i])[model.languages.index(lang)] for i, _, lang in docs if i in bits]
    assert model.scale == scales[np.argmin([-np.log(np.maximum(share(s), 1e-12)).mean() for s in scales])]
    assert model.floor == pytest.approx(np.quantile([langid._scores(model.scale, b).max() for b in bits.values()], 1 - langid.ACCEPT))
    for k, name in enumerate(model.languages):
        assert model.limits[k] == pytest.approx(np.quantile([bits[i][k] for i, _, lang in docs if lang == name and i in bits], langid.ACCEPT))


def test_no_language_loses_its_rare_grams(table):
    import numpy as np

    rnd = np.random.default_rng(1)
    rare = ["".join(map(chr, rnd.integers(0x4E00, 0x9F00, 140_000))) for _ in range(16)]
    docs = table([(i, t, "zz") for i, t in enumerate(rare)] + [(100 + i, "the hot words of the hot language", "en") for i in range(5)])
    model = langid.learn(docs)
    assert model.languages == ["en", "zz"] and len(model.levels[2].grams) > 2_000_000
    assert langid.predict(model, rare[3][:200].encode())[0] == "zz" and langid.predict(model, b"the hot words")[0] == "en"
    with pytest.raises(ValueError, match="max_grams"):
        langid.learn(table([(1, "some words", "en")]), max_grams=3)


def test_language_model_sums_to_one():
    import numpy as np

    grams = [(name, *langid.grams_of(text.encode())) for name, text in (("a", "abba baab abab"), ("b", "bcb cbc bbc"))]
    model = langid.train(grams)
    chars = model.levels[0].grams
    for context in model.levels[2].contexts:
        total = langid._probabilities(model, (context << 21) + chars, 3).sum(axis=0)
        assert np.all(total <= 1 + 1e-9) and np.all(total > 0.5)


def slow_secrets(text):
    found = []
    for i, (rx, least, flags) in enumerate((
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, re.I | re.A), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0),
    )):
        found += [(m.start(), i, m.end()) for m in re.finditer(rx, text or "", flags) if len(m[2] if i == 0 else m[0]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_spans(table):
    rows = [
        (1, None), (2, ""), (3, "ü PassWord = 'abcdefghijkl' and token:short"), (4, "AKIA" + "A1" * 8 + " AKIAX"), (5, "0123456789abcdef0 deadbeef"),
        (6, "api_key: deadbeefdeadbeef42 secret=aaa.bbb-ccc_ddd"), (7, "key is Zx9Qw7Lk3Vb5Nm2Tr8Yp4Hs6 here"), (8, "see some/path/to/a/module_name/file and 123e4567-e89b-12d3-a456-426614174000"), (9, LONG),
    ]
    got = {r.doc_id: r for r in secrets.secret_spans(table(rows)).collect()}
    for d, t in rows:
        assert got[d].base_spans == slow_secrets(t), d
        assert set(filter(None, got[d].base_spans.split(","))) <= set(got[d].spans.split(","))
    assert got[7].spans == "entropy:7:31" and got[8].spans == "" and got[1].spans == ""


def test_sliding_entropy_equals_direct_entropy():
    import math
    import random

    rnd = random.Random(3)
    run = "".join(rnd.choice("aaab0123456789XYZ") for _ in range(400))
    for limit in (2.5, 3.2):
        covered = set()
        for i in range(len(run) - 19):
            part = run[i : i + 20]
            if -sum(part.count(c) / 20 * math.log2(part.count(c) / 20) for c in set(part)) >= limit - 1e-9:
                covered |= set(range(i, i + 20))
        assert {p for a, b in secrets.dense_runs(run, limit) for p in range(a, b)} == covered


def test_toxicity_learns_words_and_orders_grades(spark, table):
    plain = "the quiet river runs past green hills and old stone houses every single day of week"
    rows = [(i, f"{plain} {i}" + (" vileword" * (i % 7) if i % 4 == 0 else "")) for i in range(200)] + [(900, None), (901, ""), (902, f"{plain} vileword"), (903, "vileword " * 9)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0 and i % 7 > 0)) for i in range(200)] + [(None, 1, 1), (900, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(table(rows), labels)
    got = {r.doc_id: r for r in toxicity.grade(table(rows), model).collect()}
    assert all(got[i].toxic == (i % 4 == 0 and i % 7 > 0) for i in range(200)) and not got[900].toxic and not got[901].toxic
    assert got[902].toxic and got[903].severity > got[902].severity and list(model.thresholds) == sorted(model.thresholds)
    left = toxicity.remove_toxic(table(rows), model)
    assert left.count() == sum(not r.toxic for r in got.values()) and left.columns == table(rows).columns and left.first().kept == "x"
    assert toxicity.grade(table(rows), toxicity.learn(table(rows), labels.where("toxic = 0"))).where("toxic").count() == 0
    assert toxicity.grade(table([]), model).count() == 0


def test_quality_needs_no_labels(spark, table):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out, model = quality.score(docs)
    scored = {r.doc_id: r.kept for r in out.collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept_good = [scored[d] for d, q in truth.items() if q == 1 and d in scored]
    kept_bad = [scored[d] for d, q in truth.items() if q == 0 and d in scored]
    assert sum(kept_good) >= 0.98 * len(kept_good) and sum(kept_bad) <= 0.1 * len(kept_bad)
    assert (model.labels.accuracy > 0.5).all()
    odd, _ = quality.score(table(ODD))
    assert odd.count() == len(ODD) and quality.score(table([]))[0].count() == 0


def test_estimation_finds_the_better_labeller():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    votes = np.full((4000, quality.N_LABELLERS), quality.NONE)
    for j in range(quality.N_LABELLERS):
        right = 0.95 if j else 0.6
        cast = rng.random(4000) < 0.7
        votes[cast, j] = np.where(rng.random(4000) < right, truth, ~truth)[cast]
    model = quality.fit_labels(votes, np.ones(4000))
    assert model.accuracy[0] < model.accuracy[1:].min() and abs(model.prior - 0.8) < 0.05
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97


def slow_rake(cells, targets, share, rounds):
    total = sum(cells.values())
    weight = {c: t * share for c, t in cells.items()}
    for _ in range(rounds):
        for i, goal in enumerate(targets):
            for v in {c[i] for c in cells}:
                own = sum(w for c, w in weight.items() if c[i] == v)
                for c in weight:
                    if c[i] == v:
                        weight[c] = weight[c] * goal[v] * total * share / own if own else 0.0
        weight = {c: min(w, cells[c]) for c, w in weight.items()}
    return weight


def test_raking_and_sampling(spark, table):
    rows = [(i, "w " * (i % 17 + 1), ("en", "de")[i % 3 == 0], f"s{i % 2}") for i in range(600)] + [(900, None, None, None), (901, "", "en", "s0")]
    targets = {"source": {"s0": 0.3, "s1": 0.7}, "lang": {"en": 0.5, "de": 0.5}}
    out = mixing.mix(table(rows), targets, share=0.4, rounds=6).collect()
    cells = {}
    for _, t, lang, source in rows:
        key = (source or "(none)", lang or "(none)")
        cells[key] = cells.get(key, 0) + len((t or "").split())
    want = slow_rake(cells, [{**targets["source"], "(none)": 0}, {**targets["lang"], "(none)": 0}], 0.4, 6)
    assert len(out) == len(rows)
    for r in out:
        key = (r.source or "(none)", r.lang or "(none)")
        p = want[key] / cells[key] if cells[key] else 1.0
        assert r.probability == pytest.approx(p) and r.kept == (int(hashlib.md5(f"9:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32 < p)
    assert mixing.mix(table([])).count() == 0 and mixing.sample(table(rows)).columns == table(rows).columns


def test_a_word_over_many_parts_has_no_blank_inside(monkeypatch):
    import numpy as np

    text = ("ab" * 300 + "9 é" + "c" * 200 + "!!").encode()
    whole = langid.grams_of(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    for a, b in zip(langid.grams_of(text), whole, strict=True):
        assert np.array_equal(a, b)
    assert langid.grams_of(b"1 2 3 4 5 6 7 8")[0].size == 0


def slow_kneser_ney(texts, word):
    """Probabilities of the trigrams of ``word`` by interpolated Kneser-Ney over (language, text), term by term."""
    padded = lambda t: " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
    grams = {}
    for lang, text in texts:
        t = padded(text)
        for i in range(len(t) - 2):
            grams.setdefault(lang, []).append(t[i : i + 3])
    chars = {g[-1] for own in grams.values() for g in own}
    out = {}
    for lang, own in grams.items():
        tri = {g: own.count(g) for g in own}
        bi = {g: len({t for t in tri if t[1:] == g}) for g in {t[1:] for t in tri}}
        uni = {g: len({b for b in {t[1:] for t in tri} if b[1:] == g}) for g in {t[2:] for t in tri}}
        levels = [uni, bi, tri]

        def p(gram, n):
            if n == 0:
                return 1 / (len(chars) + 1)
            table = levels[n - 1]  # noqa: B023
            once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
            d = once / (once + 2 * twice) if once and twice else 0.5
            context = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
            total = sum(context.values())
            if not total:
                return p(gram[1:], n - 1)
            return max(table.get(gram, 0) - d, 0) / total * (gram in table) + d * len(context) / total * p(gram[1:], n - 1)

        t = padded(word)
        out[lang] = [p(t[i : i + 3], 3) for i in range(len(t) - 2)]
    return out


def test_probabilities_equal_plain_kneser_ney():
    texts = [("a", "the cat sat on the mat that the cat had"), ("b", "die katze sass auf der matte die katze"), ("a", "another cat")]
    import numpy as np

    counts = []
    for lang in ("a", "b"):
        parts = [langid.grams_of(t.encode()) for own, t in texts if own == lang]
        counts.append((lang, *langid._added(*(np.concatenate(x) for x in zip(*parts, strict=True)))))
    model = langid.train(counts)
    for word in ("the katze", "cat", "zzz", "matter hats"):
        want = slow_kneser_ney(texts, word)
        grams, n = langid.grams_of(word.encode())
        bits = langid.entropies(model, word.encode())
        for k, lang in enumerate(("a", "b")):
            assert bits[k] == pytest.approx(-np.log2(want[lang]).mean())


def test_languages_of_odd_rows(spark, table):
    rows = [(1, "the cat sat here"), (1, "the cat sat here"), (2, None), (3, ""), (4, "1234 !!"), (None, "le chat est là"), (5, "chat " * 200_000)]
    docs = table([(*r, "en" if i % 2 else "fr") for i, r in enumerate(rows)])
    model = langid.learn(docs)
    got = langid.identify(docs, model, ("doc_id", "kept", "items")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"} and {r.kept for r in got} == {"x"}
    empty = langid.identify(docs, langid.learn(table([])))
    assert {r.lang_pred for r in empty.collect()} == {"und"} and langid.identify(table([]), model).count() == 0


def test_secrets_in_a_very_long_text_take_time_in_proportion():
    import time

    scanner = secrets.Scanner()
    line = "token = 'a8Fk29sLq0ZxPw73Vn5T' and 9f86d081884c7d659a2feaa0c55ad015 or QmFzZTY0RW5jb2RlZFNlY3JldDEyMw\n"
    times = []
    for n in (4_000, 16_000):
        start = time.process_time()
        base, every = scanner.find((line * n).encode())
        times.append(time.process_time() - start)
        assert len(base) == 2 * n and len(every) >= 3 * n - 1
    assert times[1] < 8 * times[0]


def test_spans_within_a_base_span_are_left_out():
    base, every = secrets.Scanner().find(b"secret: a8Fk29sLq0ZxPw73Vn5Tb1 then a8Fk29sLq0ZxPw73Vn5Tb1")
    assert len(base) == 1 and [k for _, k, _ in every] == [0, 3]
    assert secrets.secret_spans


def test_secrets_of_nothing(table):
    assert secrets.secret_spans(table([])).count() == 0 and simhash.near_duplicates(table([])).count() == 0


def test_benchmark_slices_are_fetched_one_at_a_time(spark, table, monkeypatch):
    order = []
    scan, fetch = decontaminate._scan, decontaminate._slices

    def slices(*a):
        for part in fetch(*a):
            order.append("fetched")
            yield part

    monkeypatch.setattr(decontaminate, "_slices", slices)
    monkeypatch.setattr(decontaminate, "_scan", lambda *a: order.append("scanned") or scan(*a))
    items = spark.createDataFrame([(i, f"item {i} " + "words of it " * 9) for i in range(12)], "item_id long, text string")
    assert decontaminate.contamination(table([(1, "item 3 " + "words of it " * 9)]), items, limit=200).first().n_hit > 0
    assert order[:3] == ["fetched", "fetched", "scanned"] and "fetched" in order[3:]
    for at, step in enumerate(order):
        if step == "fetched" and at > 1:
            assert order[at - 1] == "scanned"


def test_word_shapes_are_whole_and_pairs_counted():
    assert quality.shape(b"a-1-B-2-c-3-D-4-e") == "a-9-Aa-9-a-9-Aa-9-a"
    values, _ = quality.measures(b"one two one two one two three")
    assert values["repeats"] == pytest.approx(1 - 3 / 6)
