"""Chat, fingerprints, personal data, archives, near-duplicates, quality rules and the pipeline against brute force."""

import gzip
import hashlib
import io
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from markerloom.llm import chat, ordermin, pii, quality, simhash, warc
from markerloom.llm.components import components
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fp string, stats string"


# Chat


def chat_rows():
    odd = "a\\|b <|end|>\n <\\| \\\\ </s>[INST] x [/INST] <<|"
    return [
        (1, 0, "system", odd), (1, 1, "user", "hi"), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "user", "only"), (3, None, "assistant", "first"), (3, 0, "we|ird\nro\\ple", "x"), (3, 0, None, "y"),
        (None, 5, "assistant", "alone"), (None, 5, "assistant", "alone"),
    ]


def test_chat_reads_back(spark):
    turns = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string")
    examples = chat.expand(turns.withColumn("example", F.lit(1)).withColumn("n", F.lit(1)))
    back = chat.read_back(examples).collect()
    wanted = {}
    for i, (conv, turn, role, text) in enumerate(chat_rows()):
        key = (conv, i if conv is None else 0)
        wanted.setdefault(key, []).append(((turn is not None, turn or 0), role or "", text or ""))
    got = sorted((str(r["conv_id"]), [tuple(t) for t in r["turns"]], r["replies"]) for r in back)
    assert got == sorted(
        (str(k[0]), [t[1:] for t in sorted(v)], [t[2] for t in sorted(v) if t[1] == "assistant"]) for k, v in wanted.items()
    )
    first = examples.filter("conv_id = 1").orderBy("example").collect()
    assert [r["example"] for r in first] == [2, 4] and [r["last"] for r in first] == [False, True]
    assert first[1]["formatted"].startswith(first[0]["formatted"])
    assert chat.read_back(chat.expand(turns.limit(0))).count() == 0


# Fingerprints


def plain_fingerprint(text):
    """The signatures of a text, from the definition."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return []
    mask, seen, bins = (1 << 64) - 1, {}, {}
    for place in range(max(1, len(words) - ordermin.SHINGLE + 1)):
        h = 42
        for w in words[place : place + ordermin.SHINGLE]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        high = h >> ordermin.PLACE_BITS
        number = seen[high] = seen.get(high, -1) + 1
        x = xxhash.xxh64_intdigest(np.int64(high).tobytes(), 42)
        x = xxhash.xxh64_intdigest(np.int32(number).tobytes(), x)
        packed = (x & ~((1 << ordermin.PLACE_BITS) - 1) & mask) | place
        bins.setdefault(packed >> (64 - ordermin.BIN_BITS), []).append(packed)
    out = []
    for own, members in bins.items():
        chosen = sorted(members)[: ordermin.TUPLE]
        h = 42
        for m in sorted((m & ((1 << ordermin.PLACE_BITS) - 1), m >> ordermin.PLACE_BITS) for m in chosen):
            h = xxhash.xxh64_intdigest(np.uint64(m[1]).tobytes(), h)
        out.append(own << (64 - ordermin.BIN_BITS) | h >> ordermin.BIN_BITS)
    return sorted(np.array(out, dtype=np.uint64).view(np.int64).tolist())


def plain_likeness(a, b):
    filled = {(x & (1 << 64) - 1) >> (64 - ordermin.BIN_BITS) for x in [*a, *b]}
    return len(set(a) & set(b)) / len(filled) if filled else 1.0


def test_order_minhash_is_the_definition(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "one two", " one  two\tthree ", "a b c " * 400]
    texts += [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    rows = [(None if i % 13 == 5 else i, t, "x", "y") for i, t in enumerate(texts)] + [(3, "one", "x", "y")]
    got = ordermin.compare_edits(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    keyed = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, (key, text, *_) in enumerate(keyed[:-1]):
        text, following = text or "", keyed[i + 1][1] or ""
        if key == 3:
            continue  # equal rows follow each other in any order
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = by_id[key]
        assert r["edited"] == edited and r["n_chars"] == len(text)
        assert sorted(r["fingerprint"]) == plain_fingerprint(text) and sorted(r["edited_fingerprint"]) == plain_fingerprint(edited)
        assert r["near_edited"] == plain_likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == plain_likeness(r["fingerprint"], plain_fingerprint(following))
    alone = ordermin.compare_edits(spark.createDataFrame([(7, "abc def", "", "")], DOCS)).collect()
    assert [r["edited"] for r in alone] == ["abc dab"]
    assert ordermin.compare_edits(spark.createDataFrame([], DOCS)).count() == 0


def test_order_matters_and_nearness_falls_with_edits(spark):
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    halves = " ".join(words[450:] + words[:450])
    edited = " ".join(words[:600] + [f"v{i}" for i in range(300)])
    rows = spark.createDataFrame([(1, " ".join(words), "", ""), (2, halves, "", ""), (3, edited, "", "")], DOCS)
    fp = {r["doc_id"]: r["f"] for r in ordermin.with_fingerprint(rows, "text", "f").collect()}
    swapped, third = plain_likeness(fp[1], fp[2]), plain_likeness(fp[1], fp[3])
    assert 0.2 < swapped < 0.9 and 0.1 < third < 0.7


def test_neighbours_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordermin, "ROWS_PER_BUCKET", 3)
    rows = [(i * i, f"t{i}") for i in range(40)] + [(None, f"n{i}") for i in range(9)]
    moved = ordermin.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()
    after = {r["text"]: r["next"]["text"] for r in moved}
    assert all(after[f"t{i}"] == f"t{i - 1}" for i in range(1, 40))
    chain, at = [], after["t0"]
    while at != "t39":
        chain.append(at)
        at = after[at]
    assert sorted(chain) == sorted(f"n{i}" for i in range(9))


# Personal data


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        checks = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(checks) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(6)
    pieces = ["a", "b.c", "@", ".", "-", "1", "25", "255.", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", " ", "+", "+1 (523) 555-1055", "x@y.z", "é", "_%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain_base(text), text


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789 of it") == []
    assert kinds("call 523-555-1055 now") == ["local_phone"] and kinds("523-555-1055") == []
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    assert kinds(f'token = "{secret}"') == ["secret"] and kinds(f"commit {secret}") == [] and kinds(f"see {secret} there") == []
    assert kinds("the password extraordinarily-incomprehensible") == [] and kinds("key " + "1" * 30) == []
    assert pii.redact_text(f"api_key={secret} x") == "api_key=<SECRET> x" and kinds("SECRET_KEY: wJalrXUtnFEMI/K7MDENG/bPxRfiCY+zz==") == ["secret"]
    assert pii.redact_text("to a@b.co or 1.2.3.4!") == "to <EMAIL> or <IP>!"
    long = "a" * 300_000 + "." + "1" * 300_000 + "@" + "+1" * 100_000
    assert all(kind != "email" for kind, *_ in pii.spans_of(long))


def test_spans_of_all_rows(spark):
    rows = [(1, "é a@b.co", "", ""), (None, None, "", ""), (2, "", "", ""), (1, "é a@b.co", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = pii.find_spans(docs).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "email:2:8"), (None, ""), (2, ""), (1, "email:2:8")]))
    assert [r["text"] for r in pii.redact(docs).collect()] == ["é <EMAIL>", None, "", "é <EMAIL>"]
    assert pii.find_spans(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).columns == docs.columns


# Archives


def page_rows():
    big = "é" * 700
    fake = "\x1f\x8b\x08 not a member "
    return [(1, "http://a/b c\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", fake * 200), (2, None, big)]


def test_hot_and_rare_payloads_find_their_page(spark):
    rng = random.Random(3)
    payloads = ["h" * 1200] * 700 + [f"{i // 2:04d}" * 300 for i in range(1600)] + ["s" * 999] * 50
    rng.shuffle(payloads)
    rows = [(i if i % 97 else None, f"u{i % 3}" if i % 5 else None, text) for i, text in enumerate(payloads)]
    heads = {}
    for i, _, text in rows:
        if len(text) >= 1000 and i is not None:
            heads[text] = max(i, heads.get(text, -1))
    wanted = Counter((i, text, heads.get(text) if heads.get(text) != i else None) for i, _, text in rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter((r["page_id"], r["html"], r["head"]) for r in warc.with_heads(pages).collect())
    assert got == wanted


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 20])
def test_archives_read_back_at_any_range(spark, tmp_path, range_bytes):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages.withColumn("digest", F.lit("x")), str(tmp_path / "w"))
    got = warc.read_archives(archives, range_bytes).collect()
    wanted = []
    for page, _, html in page_rows():
        raw = (html or "").encode()
        group = [p for p, _, h in page_rows() if h == html and len(raw) >= 1000 and p is not None]
        head = max(group) if len(group) > 1 and max(group) != page else None
        wanted.append((page, "revisit" if head is not None else "response", len(raw), hashlib.sha1(raw).hexdigest(), head, None if head is not None else raw))
    assert sorted(map(str, ((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] is not None else None) for r in got))) == sorted(map(str, wanted))
    for r in archives.collect():
        raw = open(r["path"], "rb").read()
        assert len(raw) == r["bytes"] and gzip.decompress(raw).count(b"WARC/1.1\r\n") == r["n_records"] + 1
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


class _Bytes(io.BytesIO):
    pass


def test_false_magic_is_passed_over():
    stored_plain = b"WARC/1.1\r\nContent-Length: 5\r\n\r\n\x1f\x8b\x08xy\r\n\r\n"
    import zlib

    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the magic stands in the file
    member = packer.compress(stored_plain) + packer.flush()
    whole = member * 3
    for cut in range(1, len(whole), 7):
        places = [r.place for b, e in ((0, cut), (cut, len(whole))) for r in warc.records_in_range(_Bytes(whole), b, e)]
        assert places == [0, len(member), 2 * len(member)]


@pytest.mark.parametrize("block", [1, 2, 3, 13, 100, 513, 5000])
def test_no_record_is_lost_at_the_end_of_a_block(block):
    rng = random.Random(block)
    members, places, at = [], [], 0
    for i in range(60):
        html = "".join(rng.choice("abc <>é") for _ in range(rng.randint(0, 900))).encode()
        members.append(warc._member(warc.record(i, f"u{i}", html, hashlib.sha1(html).hexdigest(), None, "2000-01-01T00:00:00Z")))
        places.append(at)
        at += len(members[-1])
    whole = b"".join(members)
    for size in (777, 4096, len(whole)):
        found = [r for b in range(0, len(whole), size) for r in warc.records_in_range(_Bytes(whole), b, min(b + size, len(whole)), block)]
        assert [r.place for r in found] == places
        assert [warc._page(r)[0] for r in found] == list(range(60))


# Near-duplicates


def plain_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, far=3):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= far:
            up[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates_of_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "a b c d"), (9001, "A b c d"), (9002, None), (9003, " \n"), (0, "twice the id")], "doc_id long, text string")
    whole = docs.union(extra).withColumn("fp", F.lit(1)).withColumn("tie", F.lit(2))
    rows = whole.collect()
    fps = [plain_simhash(r["text"]) for r in rows]
    roots = plain_components(fps)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    wanted = sorted(str((r["doc_id"], f, least.get(root))) for r, f, root in zip(rows, fps, roots, strict=True))
    got = simhash.near_duplicates(whole).select("doc_id", simhash.hex_text(F.col("fp")).alias("h"), "component_id").collect()
    assert sorted(str((r["doc_id"], int(r["h"], 16), r["component_id"])) for r in got) == wanted
    kept = simhash.keep_one(whole.withColumn("kept_tie", F.lit("t")).withColumn("Kept_Doc", F.lit(1))).collect()
    assert len(kept) == len(set(roots)) and {r["kept_tie"] for r in kept} == {"t"}
    assert simhash.near_duplicates(whole.limit(0)).count() == 0 and simhash.keep_one(whole.limit(0)).count() == 0


def test_lists_of_any_size_lose_no_link(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(simhash, "LIST_SIZE", 16)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
        flips = np.uint64(1) << rng.integers(0, 40, (6, 40, 3)).astype(np.uint64)
        members = np.unique((base[:1, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel())
        got = simhash.links_in_list(members)
        assert all((int(members[a]) ^ int(members[b])).bit_count() <= 3 for a, b in got)
        up = simhash._Forest(len(members))
        for a, b in got:
            up.join(a, b)
        wanted = plain_components([int(m) for m in members])
        same = lambda x: sorted(sorted(i for i, r in enumerate(x) if r == root) for root in set(x))
        assert same([up.root(i) for i in range(len(members))]) == same(wanted)


def test_every_near_pair_shares_a_posting():
    for lost in combinations(range(8), 3):
        assert any(not set(t) & set(lost) for t in simhash.TRIPLES)


def test_components_of_a_long_chain(spark):
    chain = spark.range(0, 300).select((F.col("id") * 7 % 301).alias("a"), ((F.col("id") + 1) * 7 % 301).alias("b"))
    assert {r["root"] for r in components(chain).collect()} == {0}


# Quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + s for i, w in enumerate(windows) if windows.count(w) > 1 for s in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts():
    rng = random.Random(9)
    assert quality.counts(None)[:5] == (0, 0, 0, 0, 0)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "|", " ", "a b c"]) for _ in range(rng.randint(0, 40)))
        assert quality.counts(text)[:5] == plain_counts(text)


def test_rules_hold_on_other_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    assert rules and all(r.conditions for r in rules)
    other, wanted = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judged(other, rules).join(wanted, "doc_id").filter("not base_failed").toPandas()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.2


def test_rules_of_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a " * 80, "", ""), (None, None, "", ""), (1, "a " * 80, "", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) == []
    assert [r["kept"] for r in quality.judged(docs, []).collect()] == [False, False, False]
    assert quality.judged(docs.limit(0), []).count() == 0
    assert quality.keep_good(docs, []).columns == docs.columns
    good = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)), 5)], "doc_id long, text string, quality_counts int")
    assert [r["quality_counts"] for r in quality.keep_good(good, []).collect()] == [5]


# Pipeline


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    rules = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    wanted = {r["doc_id"] for r in quality.judged(docs, rules).filter("kept").collect()}
    rows = good.collect()
    assert {r["doc_id"] for r in rows} == wanted and len(rows) == len(wanted)
    roots = plain_components([plain_simhash(r["text"]) for r in rows])
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    single = stages["near_duplicates"](spark, spark.createDataFrame(rows, docs.schema), FOLDER)
    kept = single.collect()
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in kept) == sorted(least.values())
    clean = stages["personal_data"](spark, spark.createDataFrame(kept, docs.schema), FOLDER)
    texts = {r["doc_id"]: r["text"] for r in kept}
    cleaned = clean.collect()
    assert clean.columns == docs.columns and len(cleaned) == len(kept)
    for r in cleaned:
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert pii.base_spans(texts[r["doc_id"]]) or r["text"] == texts[r["doc_id"]] or pii.spans_of(texts[r["doc_id"]])
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "a b", None, None, 3)]])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, str(tmp_path)).count() == (0 if not rows else 1 + ("near" in stage.__name__) if "near" in stage.__name__ else len(rows))
