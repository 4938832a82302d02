"""Language profiles, the Merkle manifest and hard negatives against their plain definitions."""

import hashlib
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from markerloom.llm import catalog, language, merkle, negatives
from markerloom.llm.common import stored
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


# Languages


def plain_profile(text):
    """Sum of bound vectors over every letter or mark and its neighbours."""
    kinds = [unicodedata.category(c)[0] in "LM" for c in text.lower()]
    line = ["\0", *(c if k else "\0" for c, k in zip(text.lower(), kinds, strict=True)), "\0"]
    total = np.zeros(language.DIMENSIONS)
    for i in range(1, len(line) - 1):
        if line[i] != "\0":
            a, b, c = (language.letter_vector(ord(x)).astype(int) for x in line[i - 1 : i + 2])
            total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def plain_language(text, known):
    if not any(unicodedata.category(c)[0] == "L" for c in text or "") or not known:
        return "und", 0.0
    own = plain_profile(text)
    cosines = {n: round(float(own @ p / np.linalg.norm(own) / np.linalg.norm(p)), 6) for n, p in known.items()}
    best = min(known, key=lambda n: (-cosines[n], n))
    return best, max(0.0, cosines[best])


ODD = ["", None, " \n", "12 !?", "a", "É", "ñ ñ", "Straße İstanbul", "नमस्ते दुनिया", "́", "中文字符", "x\0y", "the " * 4000, "a1b2c3"]


def test_languages_are_those_of_the_definition(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    learn = ~language.held_out(F.col("doc_id"))
    known = language.prototypes(docs.repartition(5), learn)
    rows = docs.collect()
    wanted = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and not plain_held_out(r["doc_id"]):
            wanted[r["lang"]] = wanted.get(r["lang"], 0) + plain_profile(r["text"])
    assert sorted(known) == sorted(wanted) and all((known[n] == wanted[n]).all() for n in known)
    texts = [r["text"] for r in rows][:60] + ODD
    odd = spark.createDataFrame([(None if i % 7 == 3 else i // 2, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    got = language.predict(odd, known).collect()
    plain = [(None if i % 7 == 3 else i // 2, *plain_language(t, known)) for i, t in enumerate(texts)]
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got) == Counter((k, n, round(s, 6)) for k, n, s in plain)


def plain_held_out(key):
    import zlib

    return zlib.crc32(str(key).encode()) % 4 == 2


def test_profiles_do_not_depend_on_how_texts_are_cut(monkeypatch):
    texts = [t or "" for t in ODD]
    whole = language.Lot(texts).profiles(np.arange(len(texts)), len(texts))
    for cells, places in ((16, 1 << 22), (4_000_000, 1)):
        monkeypatch.setattr(language, "CELLS", cells)
        monkeypatch.setattr(language, "PLACES", places)
        assert (language.Lot(texts).profiles(np.arange(len(texts)), len(texts)) == whole).all()
    assert all((whole[i] == plain_profile(t)).all() for i, t in enumerate(texts))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = catalog.op11_language_id(spark, folder).filter("held_out").toPandas()
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", F.char_length("text").alias("n")).toPandas()
    both = found.merge(truth, on="doc_id").dropna()
    assert (both.lang_pred == both.lang).mean() > 0.98
    assert (both.lang_pred == both.lang)[both.n > 50].all()
    assert both.score.between(0, 1).all()


def test_languages_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([], schema)
    assert language.prototypes(none, F.lit(True)) == {}
    assert language.predict(none, {}).count() == 0
    rows = spark.createDataFrame([(1, None, "a"), (2, "1 2", "b"), (3, "word", None), (4, "other words", "c"), (4, "other words", "c")], schema)
    known = language.prototypes(rows, F.lit(True))
    assert list(known) == ["c"]
    assert sorted((r["doc_id"], r["lang_pred"]) for r in language.predict(rows, known).collect()) == [(1, "und"), (2, "und"), (3, "c"), (4, "c"), (4, "c")]
    assert {r["lang_pred"] for r in language.predict(rows, {}).collect()} == {"und"}


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Root, and for every leaf the digests to its left and right, level by level."""
    nodes, paths = list(leaves), [[] for _ in leaves]
    owner = list(range(len(leaves)))
    while len(nodes) > 1:
        for i, at in enumerate(owner):
            run = at // 2 * 2
            paths[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 2])))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        owner = [at // 2 for at in owner]
    return nodes[0], paths


def plain_manifest(rows, changed):
    """Rows are (doc_id, lang, n_chars, text)."""
    digests = [(plain_leaf(r), plain_leaf(c)) for r, c in zip(rows, changed, strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, digests[i][0]))
    trees = {}
    for i in order:
        trees.setdefault(rows[i][1], []).append(i)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {n: plain_tree([digests[i][0] for i in trees[n]]) for n in names}
    root, above = plain_tree([built[n][0] for n in names])
    out = []
    for at, n in enumerate(names):
        for i, path in zip(trees[n], built[n][1], strict=True):
            fold, whole = digests[i][1], path + above[at]
            for left, right in whole:
                fold = sha(left + fold + right)
            out.append((rows[i][0], digests[i][0], built[n][0], root, sha("".join(a + b for a, b in whole)), fold, fold == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_is_the_definition(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET", 2**levels)
    rng = random.Random(levels)
    sizes = {"one": 1, "two": 2, "five": 5, "é": 17, "": 3, None: 9, "many": 70}
    rows = [(rng.choice([None, *range(60)]), n, rng.choice([None, rng.randint(0, 9)]), rng.choice([None, "", "-", "1:a", "é" * 5])) for n, c in sizes.items() for _ in range(c)]
    rows += rows[:6]
    rng.shuffle(rows)
    tamper = lambda r: r[0] is not None and r[0] % 3 == 0 and r[2] is not None
    changed = [(*r[:2], r[2] + 1, r[3]) if tamper(r) else r for r in rows]
    schema = "doc_id long, lang string, n_chars long, text string, path int, tree int, digest string"
    table = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], schema).repartition(3)
    tampered = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(table, ["doc_id", "lang", "n_chars", "text"], tampered)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows, changed))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, lang string, text string"
    assert merkle.manifest(spark.createDataFrame([], schema), ["doc_id", "text"]).count() == 0
    [one] = merkle.manifest(spark.createDataFrame([(None, None, None)], schema), ["doc_id", "text"]).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == sha("--") and one["path"] == [] and one["verified"]


def test_nodes_cover_their_children(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BUCKET", 4)
    leaves = spark.range(37).select(F.when(F.col("id") < 5, "a").otherwise("b").alias("tree"), F.col("id").alias("key"), merkle.digest(F.col("id").cast("string")).alias("digest"))
    built = merkle.forest(leaves)
    nodes = {(r["tree"], r["level"], r["lo"]): r for r in built.nodes().collect()}
    for tree, size in (("a", 5), ("b", 32)):
        depth = math.ceil(math.log2(size))
        assert max(k[1] for k in nodes if k[0] == tree) == depth
        for level in range(depth + 1):
            row = sorted(k[2] for k in nodes if k[:2] == (tree, level))
            assert row == list(range(0, size, 2**level))
            for lo in row:
                n = nodes[tree, level, lo]
                assert n["hi"] == min(lo + 2**level, size)
                if level:
                    below = [nodes.get((tree, level - 1, x)) for x in (lo, lo + 2 ** (level - 1))]
                    assert n["digest"] == sha("".join(b["digest"] for b in below if b))
    assert {r["tree"]: r["digest"] for r in built.tops.collect()} == {"a": nodes["a", 3, 0]["digest"], "b": nodes["b", 5, 0]["digest"]}


# Hard negatives


def plain_negatives(rows, is_anchor, k_pos, k_neg, percent):
    """Rows are (number, id, label, whole vector)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for number, key, label, vector in rows:
        if not is_anchor(key):
            continue
        scored = sorted((-dot(vector, v), i, n, other == label) for n, i, other, v in rows if n != number)
        for p, positive, *_ in [s for s in scored if s[3]][:k_pos]:
            fits = [s for s in scored if not s[3] and 100 * -s[0] >= percent * -p and -s[0] <= -p][:k_neg]
            out += [(key, positive, rank, i, -p, -s) for rank, (s, i, *_) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("seed, k_pos, k_neg, block", [(1, 5, 5, 1 << 25), (2, 3, 2, 64), (3, 1, 7, 300), (4, 5, 5, 1 << 25)])
def test_hard_negatives_are_the_definition(spark, monkeypatch, seed, k_pos, k_neg, block):
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", block)
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 3)
    monkeypatch.setattr(negatives, "HELD", 20)
    rng = random.Random(seed)
    big = 5e4 if seed == 4 else 1.0
    same = [0.5, 0.25, -0.125]
    rows = []
    for i in range(150):
        vector = same if rng.random() < 0.3 else [rng.choice([-0.3, 0.1, 0.2, 0.7, 0.999]) * big for _ in range(rng.choice([3, 3, 3, 2, 0]))]
        rows.append((rng.randint(0, 120), rng.choice([0, 0, 0, 1, 2, 7]), vector))
    rows += [(None, 1, same), (10, None, same), (20, 1, None), (30, 1, [1.0, None]), (40, 1, [float("nan")]), (50, 1, [float("inf")])]
    table = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "vec_id long, label int, embedding array<double>, row int, anchor int, slot string").repartition(4)
    whole = stored(negatives.whole_vectors(table), "numbered")
    held = [(r["row"], r["vec_id"], r["label"], r["vector"]) for r in whole.collect()]
    assert len(held) == 150
    got = negatives.mine(whole, F.col("vec_id") % 10 == 0, k_pos, k_neg, 80).collect()
    wanted = [r for r in plain_negatives(held, lambda key: key % 10 == 0, k_pos, k_neg, 80) if r[4] >= 0]
    assert Counter(map(tuple, got)) == Counter(wanted) and wanted


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert negatives.mine(negatives.whole_vectors(none), F.lit(True)).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], schema)
    assert negatives.mine(negatives.whole_vectors(alone), F.lit(True)).count() == 0
    pair = spark.createDataFrame([(0, 1, [1.0]), (100, 1, [1.0]), (3, 2, [1.0]), (2, 2, [0.9]), (4, 2, [0.5])], schema)
    got = negatives.mine(negatives.whole_vectors(pair), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 100, 1, 3, 65536, 65536), (0, 100, 2, 2, 65536, 256 * 230)]
    huge = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30])], schema)
    with pytest.raises(ValueError, match="too large"):
        negatives.mine(negatives.whole_vectors(huge), F.lit(True))


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    import oracle

    folder = "/root/testdata/sf0.01"
    assert oracle.compare(catalog.QUERIES[name](spark, folder), oracle.duck(folder), catalog.ORACLES[name]) is None
