"""Packing, byte-level BPE, frame files and word-piece counts against plain library calls."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from markerloom.llm import bpe, frames, packing, wordpiece
from markerloom.llm.pretokens import split_blank_words, split_words
from markerloom.llm.tokens import encoder
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, ids string, part string"
TEXTS = [
    (1, "The cat's ran.  It's 12 o'clock\n\n\tnow", "x", "p"),
    (2, None, None, None),
    (3, "", "x", "p"),
    (4, "the " * 9000, "x", "p"),
    (4, "the " * 9000, "x", "p"),
    (None, "no key 　 é中文 😀😀 <|endoftext|> 's", "x", "p"),
    (5, "x" * 700 + "=" * 300, "x", "p"),
    (6, "  \n ", "x", "p"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_are_those_of_the_pattern():
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(3)
    pieces = ["a", "s", "'", "'s", "'re", " ", "  ", "\n", "\t", "1", "٣", "é", "中", "!", "　", "😀", "ll", "'ll"]
    for _ in range(1500):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        words, number, counts = split_words(texts)
        ends = np.cumsum(counts)
        got = [[words[j] for j in number[e - c : e]] for e, c in zip(ends, counts, strict=True)]
        assert got == [pattern.findall(t) for t in texts]
        words, number, counts = split_blank_words(texts)
        ends = np.cumsum(counts)
        got = [[words[j] for j in number[e - c : e]] for e, c in zip(ends, counts, strict=True)]
        assert got == [regex.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_packing_covers_every_id_once(documents, tokenizer):
    rows = packing.pack(documents).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for key, text, *_ in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = whole[key, len(ids)]
        copies = sum(1 for k, t, *_ in TEXTS if k == key and t == text)
        starts = sorted(r["start"] for r in own)
        assert sum(r["length"] for r in own) == copies * len(ids) and starts[0] == 0
        for r in own:
            assert r["ids"] == np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = 0
    for sequence, offset, length in places:
        assert sequence * packing.WINDOW + offset == at
        at += length
    packed = packing.sequences(packing.pack(documents)).collect()
    assert sum(r["n_tokens"] for r in packed) == at
    assert sorted(r["n_tokens"] for r in packed)[1:] == [packing.WINDOW] * (len(packed) - 1)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in packed)


def test_added_tokens_get_the_ids_of_the_library(spark, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"{end}{end} x{end}", f"it's{end}s ", f"  {end}  ", "<|endoftext", "<|ENDOFTEXT|>", "", f"<|{end}|>"]
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)] == wanted
    assert wanted[0] == [50256]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    back = frames.read_frames(frames.write_frames(rows, folder=str(tmp_path / "frames"))).collect()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in back}
    assert got == {i: [*ids, 0] for i, ids in enumerate(wanted)}
    packed = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(rows).collect()}
    assert packed == {i: [*ids, 1] for i, ids in enumerate(wanted)}


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none).count() == 0
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert frames.read_frames(frames.write_frames(none)).count() == 0
    assert wordpiece.token_counts(none).count() == 0


@pytest.mark.parametrize(("frequent", "sampled"), [(0, 1.0), (50, 1.0), (bpe.FREQUENT_WORDS, bpe.SAMPLED)])
def test_bpe_is_that_of_the_library(documents, frequent, sampled):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(documents, frequent=frequent, sampled=sampled)).collect()
    wanted = sorted((str(k), np.array(known.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t, *_ in TEXTS)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in got) == wanted
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_long_words_merge_like_short_ones():
    path = public_tokenizers.path(bpe.RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(5)
    for size in (1, 2, 3, 50, 3000):
        word = "".join(rng.choice("thean") for _ in range(size))
        if word.encode() not in bpe.read_ranks(path):
            assert bpe.merge_long(word.encode(), path) == known.encode_ordinary(word)


def known_table(ids):
    raw, lengths = bpe._bytes_of(pa.array([w.encode() for w in ids], pa.binary()))
    sizes = np.array([len(x) for x in ids.values()], dtype=np.int64)
    return bpe.KnownWords.of(raw, lengths, np.array([i for x in ids.values() for i in x], dtype=np.uint32), sizes)


@pytest.mark.parametrize("shared", [False, True])
def test_known_words_are_found_by_all_their_bytes(monkeypatch, shared):
    if shared:  # words of the same first byte have the same hash
        monkeypatch.setattr(bpe, "_hashes", lambda raw, lengths: raw[np.cumsum(lengths) - lengths].astype(np.uint64))
    ids = {"abc": [1, 70_000], "b": [2], "é!": [3, 4, 5]}
    table = known_table(ids | {"ax": [9]} if shared else ids)
    asked = ["zz", "é!", "abc", "abd", "a", "b", "bb", "é", "a" * 300, "ax"]
    found = table.find(*bpe._bytes_of(pa.array(asked, pa.string())))
    flat, sizes = table.ids_of(found[found >= 0])
    got = dict(zip([w for w, at in zip(asked, found, strict=True) if at >= 0], np.split(flat.tolist(), np.cumsum(sizes)[:-1]), strict=True))
    # Of two words that share a hash one is left to the fold.
    assert {w: x.astype(int).tolist() for w, x in got.items()} == ids
    nothing = np.zeros(0, dtype=np.int64)
    assert not len(table.find(np.zeros(0, dtype=np.uint8), nothing)) and not len(table.ids_of(nothing)[0])


def test_known_words_take_little_memory():
    table = known_table({f" word{i}": [i % 50_000, 7, 8] for i in range(20_000)})
    assert sum(getattr(table, f).nbytes for f in ("hashes", "raw", "begins", "ids", "firsts")) < 20_000 * 40


def test_only_words_not_sent_along_are_folded(spark):
    texts = spark.createDataFrame([(1, "Qzvrtk hello hello"), (2, None), (3, "Qzvrtk wwqxj " + "xyq" * 100)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path(bpe.RANKS)
    for limit, folded in ((0, {"Qzvrtk", " wwqxj"}), (50, set())):
        sent = spark.sparkContext.broadcast(bpe.frequent_words(texts.fillna(""), path, limit, 1.0))
        rare = [bytes(word).decode() for r in bpe._lots(texts.fillna(""), path, sent).collect() for word in r["rare"]]
        assert len(rare) == len(set(rare)) and set(rare) == folded


def test_frame_files(documents, tokenizer, tmp_path):
    files = frames.write_frames(documents, folder=str(tmp_path / "frames"), frame_ids=256)
    got = frames.read_frames(files).collect()
    texts = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (key, text, *_) in zip(sorted(got, key=lambda r: r["start"]), texts, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


class _Counted:
    """A file that remembers what was read."""

    def __init__(self, path):
        self.file, self.read_bytes = open(path, "rb"), 0

    def size(self):
        return self.file.seek(0, 2)

    def seek(self, place):
        self.file.seek(place)

    def read(self, n):
        self.read_bytes += n
        return self.file.read(n)


def test_one_document_needs_its_own_frames_only(tmp_path):
    path, rng = tmp_path / "one.zst", np.random.default_rng(1)
    docs = [rng.integers(0, 50000, n).astype("u4") for n in (5, 1000, 0, 70, 9000, 3)]
    writer = frames.FrameWriter(open(path, "wb"), frame_ids=100)
    for i, ids in enumerate(docs):
        writer.add(None if i == 1 else i, ids)
    writer.close()
    reader = frames.FrameReader(_Counted(path))
    before = reader.stream.read_bytes
    [(key, start, ids)] = reader.documents([3])
    assert (key, start, ids.tolist()) == (3, 1005, docs[3].tolist())
    assert reader.stream.read_bytes - before < 1000 < path.stat().st_size
    assert [x[2].tolist() for x in reader.documents()] == [d.tolist() for d in docs]
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2] ^= 255
    (tmp_path / "bad.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  the library or the checksum
        list(frames.FrameReader(_Counted(tmp_path / "bad.zst")).documents())
    tail = path.read_bytes()[-4:]
    assert struct.unpack("<I", tail)[0] == frames.SEEKABLE_MAGIC


def greedy(word, begin, go_on):
    """Longest match, straight from its definition. The empty entry is the bare mark, which nothing else may begin."""
    at, pieces = 0, 0
    if "" in begin and not any(word[:e] in begin for e in range(1, len(word) + 1)):
        begin, pieces = go_on, 1
    while at < len(word):
        entries = go_on if at else begin
        end = next((e for e in range(len(word), at, -1) if word[at:e] in entries), None)
        if end is None:
            return -1
        pieces, at = pieces + 1, end
    return pieces


def test_automaton_counts_the_greedy_pieces():
    rng = random.Random(7)
    for _ in range(300):
        entries = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        begin, go_on = set(entries[::2]) | {"a"}, set(entries[1::2])
        automaton = wordpiece.LongestMatch(sorted(begin), sorted(go_on))
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
            assert automaton.count(word) == greedy(word, begin, go_on)


def test_word_piece_counts(documents):
    begin, go_on = map(set, wordpiece.read_pieces(public_tokenizers.path(wordpiece.PIECES)))
    got = sorted(map(tuple, wordpiece.token_counts(documents).collect()), key=str)
    wanted = []
    for key, text, *_ in TEXTS:
        found = [greedy(w, begin, go_on) for w in regex.findall(r"[^\x20\x09-\x0D]+", text or "")]
        wanted.append((key, len(found), sum(abs(x) for x in found), found.count(-1)))
    assert got == sorted(wanted, key=str)


def test_words_that_only_the_bare_mark_begins(spark):
    """Against the entries of the file itself: longest match over the marked word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(wordpiece.PIECES))
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    entries = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)}
    assert {"▁", "ñ", "中"} <= entries and not {"▁ñ", "▁中", "\U0001F9FF"} & entries

    def pieces(word):
        rest, count = "▁" + word, 0
        while rest:
            end = next((e for e in range(len(rest), 0, -1) if rest[:e] in entries), None)
            if end is None:
                return -1
            rest, count = rest[end:], count + 1
        return count

    rng = random.Random(9)
    letters = [e for e in sorted(entries) if len(e) == 1 and e != "▁" and not e.isspace()]
    words = ["ñes", "中国人民大学", "ça", "ß", "the", "😀", "\U0001F9FF", "a\U0001F9FF", "ñ\U0001F9FF"]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    got = [wordpiece.counter(public_tokenizers.path(wordpiece.PIECES)).automaton.count(w) for w in words]
    assert got == list(map(pieces, words)) and got[0] == 3 and got[1] == 7
    [row] = wordpiece.token_counts(spark.createDataFrame([(1, "ñes 中 \U0001F9FF")], "doc_id long, text string")).collect()
    assert tuple(row) == (1, 3, 3 + 2 + 1, 1)


def test_automaton_with_a_bare_mark_counts_the_greedy_pieces():
    rng = random.Random(8)
    for _ in range(300):
        made = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        begin, go_on = set(made[::2]) | {""}, set(made[1::2])
        automaton = wordpiece.LongestMatch(sorted(begin), sorted(go_on))
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            first = next((e for e in range(len(word), 0, -1) if word[:e] in begin), 0)
            rest = greedy(word[first:], go_on, go_on)
            assert automaton.count(word) == (-1 if rest < 0 else 1 + rest)


def test_query_digests(spark):
    from markerloom.llm import catalog

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in catalog.documents(spark, folder).select("doc_id", "text").collect()}
    for r in catalog.op3_byte_bpe(spark, folder).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
