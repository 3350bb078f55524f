import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from tricorpus.llm import chat, rangecoder, token_files
from tricorpus.llm.tokens import Counter, Encoder, encoder


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer():
    r = random.Random(1)
    pieces = ["word", "Ünïcode", "12", "don't", ",", ".", "\n", " ", "  ", "\t", "<|endoftext|>", "日本", "a,b", "x.", "\r\n", "é"]
    texts = ["", " ", "\n", " a", "a ", "a\nb"] + ["".join(r.choice(pieces) + r.choice([" ", "", "\n"]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    code = encoder()
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.texts(texts)] == [plain_ids(t) for t in texts]


def test_words_and_marks_equal_the_tokenizer():
    r = random.Random(2)
    letters, marks = ["a", "Wort", "ñandú", "queué", "日本", "ß", "ﬁ", "ª", "ǅ", "ا", "x²", "½", "Ⅷ"], [",", ".", "...", "(", ")", '"', "'", "'s", "'ll", "<|endoftext|>", "<|", "-", "_", "—", "«", "$", "1", "2a", "\u0301"]
    texts = ["".join(r.choice(letters + marks) if r.random() < 0.8 else r.choice([" ", "\n"]) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    code, numbers = encoder(), encoder(kind=Counter)
    want = [plain_ids(t) for t in texts]
    for _ in range(2):  # as met first, and as remembered
        assert [np.frombuffer(x, code.dtype).tolist() for x in code.texts(texts)] == want
        assert numbers.counts(texts) == [len(x) for x in want]


class Asked(Encoder):
    asked = 0

    def __getitem__(self, part):
        self.asked += 1
        return super().__getitem__(part)


def test_a_part_is_looked_up_once_for_many_texts():
    texts = ["the cat, the dog.", "the (cat) the dog!"] * 100
    code = encoder(kind=Asked)
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.texts(texts)] == [plain_ids(t) for t in texts]
    assert code.asked == len({"\nthe", " cat", ",", " the", " dog", ".", " (", "cat", ")", "!"})
    assert " dog" in code and " dog." not in code  # a word before a mark is the same word


def test_texts_cut_at_marks_equal_the_tokenizer():
    r = random.Random(3)
    pieces = [*"abst'''(,.)!-$é’—9", "'ll", "'re", "<|endoftext|>", "<|", "|>", " ", " ", "\n"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 20))) for _ in range(5000)]
    code, numbers = encoder(), encoder(kind=Counter)
    want = [plain_ids(t) for t in texts]
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.texts(texts)] == want
    assert numbers.counts(texts) == [len(x) for x in want]
    assert code.texts([]) == [] and numbers.counts([]) == []


def test_too_large_ids_are_refused():
    with pytest.raises(ValueError):
        rangecoder.encode_block(np.array([1]), np.array([1]), np.array([1 << 19]))


def test_mixing_three_predictors_beats_order_0():
    r = np.random.default_rng(5)
    ids = np.minimum(r.zipf(1.3, 200_000), 5000)
    ids[1::2] = (ids[::2] * 31) % 977  # every other one follows from the one before
    _, n = np.unique(ids, return_counts=True)
    entropy = -(n * np.log2(n / len(ids))).sum() / 8
    assert len(rangecoder.encode_block(np.array([1]), np.array([len(ids)]), ids)) < 0.85 * entropy


@pytest.mark.parametrize("n,space", [(0, 1), (1, 1), (2, 5), (191, 7), (5000, 50_257), (60_000, 3)])
def test_blocks_come_back(n, space):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), space) - 1
    lens = np.array([n // 3, 0, n - n // 3], np.int64)
    block = rangecoder.encode_block(np.array([-5, 0, 2**62]), lens, ids.astype(np.int64))
    doc_ids, back, got = rangecoder.decode_block(block)
    assert doc_ids.tolist() == [-5, 0, 2**62] and back.tolist() == lens.tolist() and got.tolist() == ids.tolist()


def test_repetitive_ids_take_little_room():
    ids = np.tile(np.arange(50, dtype=np.int64), 2000)
    assert len(rangecoder.encode_block(np.array([0]), np.array([len(ids)]), ids)) < len(ids) // 2


def test_damage_is_found():
    block = bytearray(rangecoder.encode_block(np.array([1]), np.array([1000]), np.arange(1000)))
    for at in (0, 10, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode_block(bytes(bad))


def test_files_hold_every_document_in_order(docs, rows, empty, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "blocks"))
    got = token_files.read_documents(docs.sparkSession.read.parquet(str(tmp_path / "blocks"))).orderBy("start").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, t or "") for i, t in rows), key=key)
    start = 0
    for g, (i, t) in zip(got, want, strict=True):
        assert (g.doc_id, g.start, g.ids) == (i, start, [*plain_ids(t), 2])
        start += len(g.ids)
    digests = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files.token_file_digest(docs).collect()}
    assert digests == {(g.doc_id, g.start): (len(g.ids), zlib.crc32(np.array(g.ids, "<u4").tobytes())) for g in got}
    assert token_files.token_file_digest(empty).count() == 0


TRICKY = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "a\nb\n", "<|", "|>", "<n", "<\\n|", "\r\n"]


def test_escapes_come_back():
    for t in TRICKY:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_conversations_come_back(spark):
    r = random.Random(7)
    talks = {c: [(r.choice(["user", "assistant", "system", "tool\nx", None]), r.choice([*TRICKY, None])) for _ in range(r.randint(1, 9))] for c in range(40)}
    table = [(c, t, role, text, 1) for c, turns in talks.items() for t, (role, text) in enumerate(turns)]
    r.shuffle(table)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, example int")
    talks[-1] = [("user", TRICKY[2]), ("assistant", TRICKY[2])]
    got = {x.conv_id: x for x in chat.chat_digest(df).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns = [(a or "", b or "") for a, b in turns]
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for e in chat.expand(df).collect():
        if e.loss_start is not None:
            head = chat.parse(e.text)
            assert head == [(a or "", b or "") for a, b in talks[e.conv_id]][: len(head)]
            assert chat.unescape(e.text[e.loss_start : e.loss_end]) == head[-1][1] and head[-1][0] == "assistant"


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.chat_digest(empty).collect()] == [-1]
    nulls = spark.createDataFrame([(None, 1, "user", "a"), (None, None, "assistant", "b")], empty.schema)
    assert {r.conv_id: r.n_turns for r in chat.chat_digest(nulls).collect()} == {None: 2, -1: 2}
