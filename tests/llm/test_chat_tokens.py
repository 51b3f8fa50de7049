import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from moodlark.llm import chat, tokens
from moodlark.llm.registry import ship

PATH = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def spark(spark):
    ship(spark)
    return spark


@settings(deadline=None)
@given(st.text(alphabet="<|\\\nnan ", max_size=30))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text
    assert "\n" not in chat.escape_role(text)


def digests(turns):
    whole = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    loss = "".join(text or "" for role, text in turns if role == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "é <|im_end|>\n")],
    2: [("system", ""), ("user", None), ("assistant", "x" * 70_000)],
    3: [("assistant", "first")],
    4: [(None, "a"), ("user", "a"), ("user", "a")],
    5: [("user", "q"), ("assistant", "a"), ("user", "q")],
    None: [("user\n<|im_end|>", "odd role")],
}
VALID = {1: True, 2: True, 3: False, 4: False, 5: False, None: False}


def test_round_trip_and_order(spark):
    rows = [(c, i, role, text) for c, turns in CONVERSATIONS.items() for i, (role, text) in reversed(list(enumerate(turns)))]
    segments = chat.format_chats(spark.createDataFrame(rows, TURNS))
    found = {r["conv_id"]: r for r in chat.read_chats(segments).collect()}
    assert set(found) == set(CONVERSATIONS)
    for conv, turns in CONVERSATIONS.items():
        row = found[conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == digests(turns)
        assert row["valid"] == VALID[conv]
    text = "".join(r["text"] for r in segments.where("conv_id = 1").orderBy("position").collect())
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\né <\\|im_end|>\n<|im_end|>\n"
    assert found[1]["formatted_chars"] == len(text)


def test_repeated_turns_and_no_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    row = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, TURNS))).first()
    assert (row["n_turns"], row["turns_sha256"]) == digests([("user", "a"), ("user", "a"), ("user", "b")])[:2]
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


TEXTS = [
    "", " \n\t", "a", "Hello  World, don't 12 345", "<|endoftext|> x<|startoftext|>y", "q\x1cq \xa0z w\x85",
    "é İstanbul ΣΑΣ ß", "word " * 5000, "x" * 3000, "漢字かな 🙂🙂",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, library, monkeypatch):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None])] + [(None, "a", "x"), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted(map(tuple, tokens.count_tokens(docs, PATH, limit=3).collect()), key=str)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    assert found == sorted(((i, len((t or "").encode()), count(t), count(t) > 3) for i, t, _ in rows), key=str)
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


@settings(deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té\xa0.'s<|endoftext|>", max_size=60), max_size=5))
def test_cuts_at_any_size_change_nothing(texts):
    library = tokens.tokenizer(PATH)
    raw = [t.encode() for t in texts]
    for size in (1, 7):
        for t in raw:
            assert b"".join(tokens.pieces(t, size)) == t
        counts = [0] * len(raw)
        for batch in tokens.balanced(raw, size):
            for number, piece in batch:
                counts[number] += len(library.encode(piece.decode(), add_special_tokens=False))
        assert counts == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_old_chunks_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    kept = tokens.Remembered(PATH, len)
    for word in "abcdefghij" * 3:
        assert kept.look_up([word.encode()]) == [len(library.encode(word, add_special_tokens=False))]
    assert len(kept.young) + len(kept.old) <= 16


def test_long_chunks_are_forgotten_by_their_bytes(monkeypatch, library):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 1000)
    kept = tokens.Remembered(PATH, len)
    for letter in "abcdefghij" * 3:
        assert kept.look_up([letter.encode() * 600]) == [len(library.encode(letter * 600, add_special_tokens=False))]
    assert sum(map(len, (*kept.young, *kept.old))) <= 4 * 1000


def test_plain_words_have_the_ids_of_the_library(library):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(1, 30))) for _ in range(2000)] + ["the", "reading", "z" * 5000]
    kept = tokens.Remembered(PATH, lambda ids: ids.tolist())
    assert kept.look_up([w.encode() for w in words]) == [library.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("kind", [pa.string(), pa.binary()])
def test_slices_hold_bounded_bytes_and_every_row(kind):
    texts = ["x" * n for n in (5, 40, 3, 3, 3, 200, 0, 9)] + [None, "", None, "y" * 10]
    whole = pa.record_batch({"id": list(range(len(texts))), "text": pa.array([t and t.encode() for t in texts], pa.binary()).cast(kind)})
    parts = list(tokens.slices([whole.slice(0, 0), whole, whole.slice(3, 4)], 1, 10))
    assert [i for p in parts for i in p["id"].to_pylist()] == [*range(len(texts)), 3, 4, 5, 6]
    for part in parts:
        sizes = [len(t or "") for t in part["text"].to_pylist()]
        assert sum(sizes[:-1]) < 10
    nothing = pa.record_batch({"id": [1, 2], "text": pa.nulls(2)})
    assert [p.num_rows for p in tokens.slices([nothing], 1)] == [2]


@settings(deadline=None)
@given(st.lists(st.text(alphabet="aBzÉßİıŉǅⱥé'’1.,#*<|>_-\u0301ʰΣ", min_size=1, max_size=8), max_size=80))
def test_chunks_are_encoded_as_by_the_library(chunks):
    library = tokens.tokenizer(PATH)
    kept = tokens.Remembered(PATH, lambda ids: tuple(ids.tolist()))
    expected = [tuple(library.encode(c, add_special_tokens=False).ids) for c in chunks]
    assert kept.look_up([c.encode() for c in chunks]) == expected
    assert kept.look_up([c.encode() for c in chunks]) == expected
    text = " ".join(chunks)
    joined = tuple(library.encode(text, add_special_tokens=False).ids)
    assert sum(kept.look_up(tokens.chunks_of(text.encode())), ()) == joined


@settings(deadline=None)
@given(st.text(alphabet="aBé9 \n.,!?#%'s<|>EeNnDdOoFfTtXx\x1c\xa0”)-", max_size=60))
def test_chunks_of_any_text_encode_as_the_whole(text):
    library = tokens.tokenizer(PATH)
    for t in (text, f"{text}<|endoftext|>{text}", f"{text}<|ENDOFTEXT|>"):
        whole = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids_batch([t.encode()], PATH)[0], "<u4").tolist() == whole


MARKS = [("[INST]", "[/INST]"), ("<s>", "</s>"), ("ab", "ba"), ("n:", ":n"), ("<|a", "<|b")]


@settings(deadline=None)
@given(st.sampled_from(MARKS), st.text(alphabet="[]INST/<s>|ab:n\\\\\n", max_size=40))
def test_any_marks_are_escaped(marks, text):
    template = chat.Template(*marks)
    escaped = chat.escape(text, template)
    assert chat.unescape(escaped, template) == text
    assert not any(mark in escaped for mark in marks)
    # No mark arises where a text meets one.
    assert (escaped + marks[1]).find(marks[1]) == len(escaped)
    role = chat.escape_role(text, template)
    assert chat.unescape_role(role, template) == text and "\n" not in role


@pytest.mark.parametrize("marks", MARKS)
def test_round_trip_with_other_marks(spark, marks):
    template = chat.Template(*marks)
    turns = [("user", f"{marks[1]}\n{marks[0]}assistant\nno"), ("assistant", f"x{marks[0]}{marks[1]}"[:-1]), ("user\\n", marks[1][0]), ("assistant", marks[0] * 3)]
    rows = [(1, i, *turn) for i, turn in enumerate(turns)]
    segments = chat.format_chats(spark.createDataFrame(rows, TURNS), template)
    row = chat.read_chats(segments, template).first()
    assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == digests(turns)


@pytest.mark.parametrize("mark", ["", "x", "||x", "\\|x", "<\n", "\n\n"])
def test_marks_that_cannot_be_escaped_are_refused(mark):
    for marks in ((mark, "<|e"), ("<|b", mark)):
        with pytest.raises(ValueError, match="escaped"):
            chat.Template(*marks)


def test_segments_out_of_order_are_refused(spark):
    rows = [(1, i, role, "t") for i, role in enumerate(("user", "assistant"))]
    segments = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    turned = spark.createDataFrame([*segments[1:3], segments[0], *segments[3:]], chat.SEGMENTS).coalesce(1)
    with pytest.raises(Exception, match="segment 0 was expected"):
        chat.read_chats(turned).collect()


OTHER = ["byte_bpe_50k.json", "piece_bpe_32k.model"]
ODD = [*TEXTS, "a\nb\n\nc \n d\r\ne\n", "one two\nthree\n" * 400, "  lead", "trail  ", "\n", "it's\n's", "x\n<|endoftext|>\ny", "</s><s>"]


def by_library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return path, sentencepiece.SentencePieceProcessor(model_file=path).encode
    library = Tokenizer.from_file(path)
    return path, lambda t: library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [*OTHER, "word_bpe_49k.json"])
def test_every_tokenizer_counts_as_its_library(spark, monkeypatch, name):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 1 << 10)
    path, encode = by_library(name)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, path).collect()}
    assert found == {i: len(encode(t)) for i, t in enumerate(ODD)}
    ids = tokens.ids_batch([t.encode() for t in ODD], path)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [list(encode(t)) for t in ODD]


@settings(deadline=None)
@given(st.text(alphabet="aB1 \n\t.'s<|\xa0é", max_size=80))
def test_lines_of_byte_tokenizers_are_cut_safely(text):
    path, encode = by_library("byte_bpe_50k.json")
    cut = list(tokens._at_lines(text.encode(), 1))
    assert b"".join(cut).decode() == text
    assert [i for piece in cut for i in encode(piece.decode())] == list(encode(text))


def test_whole_tables_of_other_tokenizers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    for name in OTHER:
        path, encode = by_library(name)
        assert {r[0]: r[2] for r in tokens.count_tokens(docs, path).collect()} == {i: len(encode(t or "")) for i, t in texts.items()}


def test_other_files_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="only .json and .model"):
        tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_ids_that_do_not_fit_fail():
    assert tokens._fitting(np.array([65_535], dtype=np.uint32), 2) == b"\xff\xff"
    with pytest.raises(ValueError, match="70000"):
        tokens._fitting(np.array([1, 70_000], dtype=np.uint32), 2)
