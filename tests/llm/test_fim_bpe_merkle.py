"""Fill-in-the-middle, BPE and the Merkle manifest against plain Python on small tables."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import bpe, fim, merkle

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "alpha beta, gamma's delta 12 epsilon\n\n zeta (eta) theta iota kappa " * 20_000
TEXTS = [
    None, "", " ", "a", "ab", "<", "<P", "has <S> inside", "ends in <M>", "Ünï çode \U0001f600 漢字、かな “quoted” — \u0558 ⱟ", "tab\t\tand  blanks \n x",
    "it's we'll I'd 'tis ''s", "say <|endoftext|> twice <|endoftext|><|endoftext|>x", "<<<P<S<M", "one two three " * 40, LONG,
]
ROWS = [*enumerate(TEXTS), (3, "a"), (3, "a"), (3, "another text"), (None, "no id"), (None, "no id"), (-5, "below zero"), *((100 + i, f"text number {i} " * (i % 9)) for i in range(120))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return doc_id, len(text), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("unit", [3, fim.UNIT])
def test_fim_outputs_digests_and_restoration(table, unit):
    rows = [r for r in ROWS if unit > 3 or r[1] != LONG]
    docs = table(rows).repartition(3)
    want = sorted((slow_fim(*r) for r in rows), key=key)
    got = sorted((tuple(r) for r in fim.digests(docs, unit=unit).collect()), key=key)
    assert got == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=key)
    texts = sorted((tuple(r) for r in fim.outputs(docs, unit=unit).collect()), key=key)
    assert texts == sorted((w[:6] for w in want), key=key)
    assert all(fim.restore(w[5], w[2]) == w[6] for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_of_nothing_and_of_broken_text(spark, table):
    assert fim.digests(table([])).count() == fim.outputs(table([])).count() == 0
    docs = spark.sql("select id as doc_id, cast(unhex('41FF42C3') as string) as text from range(40)")
    rows = fim.digests(docs).collect()
    assert len(rows) == 40 and {r.n for r in rows} == {4} and {r.restored_sha256 for r in rows} == {hashlib.sha256(b"A\xffB\xc3").hexdigest()}


def test_fim_shuffles_texts_once(table):
    plan = fim.digests(table(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("block_words", [10, bpe.BLOCK_WORDS])
def test_bpe_ids_and_texts_as_the_library_gives_them(table, block_words):
    tokenizer = Tokenizer.from_file(PATH)
    found = bpe.decode(bpe.encode(table(ROWS).repartition(3), PATH, keep=["doc_id", "shard"], block_words_=block_words), PATH)
    assert found.columns == ["doc_id", "shard", "ids", "decoded"]
    want = []
    for doc_id, text in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, 1, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_bpe_of_nothing_and_of_odd_ids(spark, table):
    assert bpe.decode(bpe.encode(table([]), PATH), PATH).count() == 0
    rows = spark.createDataFrame([([0, 99_999_999, 1],), (None,), ([],), ([50256],), ([161],)], "ids array<int>")
    tokenizer = Tokenizer.from_file(PATH)
    assert [r.decoded for r in bpe.decode(rows, PATH).collect()] == ['!"', "", "", "<|endoftext|>", tokenizer.decode([161], skip_special_tokens=False)]


def test_bpe_splitters_agree_and_cuts_change_nothing(monkeypatch):
    known = bpe.Splitter(bpe.vocabulary(PATH).added)
    assert known._alike("ß") and known._alike("—") and not known._alike("\u0558")
    rnd = random.Random(3)
    alphabet = "ab'sLlt 1\n\t., é(—٣　中\u0558"
    monkeypatch.setattr(bpe, "PART_CHARS", 7)
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert [w for part in known.split(text) for w in part] == [text[i:j] for _, (i, j) in known.split_library(text)]


def test_bpe_shuffles_words_and_not_occurrences(spark, table):
    docs = table([(i, "the same words over and over " * 200) for i in range(64)])
    blocks = bpe.word_blocks(docs.coalesce(1), PATH, "text", ["doc_id"])
    assert bpe.block_words(blocks).count() == 7 and blocks.where("bucket is null").count() < 64


def slow_merkle(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, text, lang, source, n_chars)."""

    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, at):
        for nodes in levels[:-1]:
            yield (at & 1, nodes[at ^ 1] if at ^ 1 < len(nodes) else None)
            at >>= 1

    runs = {}
    for doc_id, text, lang, source, n in rows:
        drawn = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 0
        altered = leaf([doc_id, source, lang, n + 1 if drawn and n is not None else n, text])
        runs.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf([doc_id, source, lang, n, text]), doc_id, altered))
    names = sorted(runs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {r: climb([x[2] for x in sorted(runs[r], key=lambda x: x[:3])]) for r in names}
    top = climb([trees[r][-1][0] for r in names])
    out = []
    for nth, r in enumerate(names):
        for at, (_, _, own, doc_id, altered) in enumerate(sorted(runs[r], key=lambda x: x[:3])):
            path = [*way(trees[r], at), *way(top, nth)]
            folded = altered
            for right, other in path:
                folded = sha(folded) if other is None else sha(other + folded) if right else sha(folded + other)
            out.append((doc_id, own, trees[r][-1][0], top[-1][0], sha("".join(o for _, o in path if o)), folded))
    return out


def manifest(spark, rows, parts=4):
    docs = spark.createDataFrame([(*r, "x", 7, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, run int, low boolean").repartition(parts)
    drawn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    found = merkle.manifest(docs, tampered=drawn, changed={"n_chars": F.col("n_chars") + 1})
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in found.collect()]


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 256, 257, 5, 1], [700, 1, 2]])
def test_manifest_equals_plain_trees(spark, sizes):
    rnd = random.Random(sum(sizes))
    ids = rnd.sample(range(-5000, 5000), sum(sizes))
    langs = [None, "de", "", "é", "zz"]
    rows = [(ids.pop(), rnd.choice([None, "", "text", "Ünï"]), langs[i], rnd.choice([None, "src"]), rnd.choice([None, 3])) for i, n in enumerate(sizes) for _ in range(n)]
    assert sorted(manifest(spark, rows), key=key) == sorted(slow_merkle(rows), key=key)


def test_manifest_with_repeated_rows_ids_and_no_ids(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(300)] + [(7, f"again {i % 3}", "en", "s", 1) for i in range(500)] + [(None, f"n{i % 4}", "en", None, None) for i in range(300)]
    rows += [(2**62 + i * 2**40, "far", "de", "s", None) for i in range(20)] + [(-(2**63), "least", "de", "s", 0), (2**63 - 1, "most", "de", "s", 0)] + [(9, "same", None, None, 2)] * 5
    assert sorted(manifest(spark, rows), key=key) == sorted(slow_merkle(rows), key=key)


def test_manifest_of_nothing(spark):
    assert manifest(spark, []) == []


def test_ranks_of_sparse_and_dense_containers():
    rnd = random.Random(1)
    for n in (0, 1, 5, 63, 64, 65, 500, 1024):
        lows = sorted(rnd.sample(range(1 << merkle.LOW_BITS), n))
        extra = [(x, rnd.randint(1, 9)) for x in lows[::3]]
        import numpy as np

        ranks = merkle.Ranks(merkle._container(np.array(lows, np.int64)), extra)
        every = list(range(1 << merkle.LOW_BITS))
        assert ranks.rank(np.array(every)).tolist() == [sum(x < e for x in lows) + sum(m for x, m in extra if x < e) for e in every]
