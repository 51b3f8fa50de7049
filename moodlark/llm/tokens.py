"""Token ids and token counts, by public tokenizers.

How a text may be cut follows from its tokenizer's own rules. One that makes
letters small and drops white space never joins what white space separates, so
a text may be cut at any ASCII white space: its ids are those of its chunks.
Chunks repeat, so each is encoded once and remembered, in two generations of
bounded size. One on bytes keeps white space, but a line feed between two other
characters is a token's beginning. Texts of any other tokenizer are not cut.
"""

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunks that one worker remembers, and bytes of them, each at most twice.
REMEMBERED, REMEMBERED_BYTES = 250_000, 4 << 20
# Bytes of text that are encoded together, and after which a long text is cut.
BATCH_BYTES = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


# Words that are encoded as one text, since a call costs more than a word.
_TOGETHER = 64
# Marks after a letter or digit. The tokenizer begins a new piece there, so white
# space in between changes nothing, and "word" and "word," are one chunk to remember.
# The pattern begins with a mark, so that the search passes over all other bytes at once.
_MARKS = re.compile(rb"[.,;:!?#*$%&](?<=[a-z0-9].)[.,;:!?#*$%&]*")


def chunks_of(text: bytes) -> list[bytes]:
    """Chunks of ``text`` that are encoded apart, fewer different ones than its own.

    Letters A-Z are made small, as the tokenizer does, unless the text may hold
    a special token, which is told by its case.
    """
    if b"<|" in text:
        return text.split()
    return _MARKS.sub(rb" \g<0>", text.lower()).split()


class Remembered:
    """What ``of`` gives for the array of ids of each chunk, remembered in two generations."""

    def __init__(self, path: str, of) -> None:
        self.library, self.of = tokenizer(path), of
        self.model = self.library.model
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.young_bytes = 0

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in coded]

    def _words(self, words: list[str]) -> Iterator[np.ndarray]:
        """Ids of words of letters: each ends with its only token that closes a word."""
        groups = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        for group, ids in zip(groups, self._encoded([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                start = 0
                for end in ends.tolist():
                    yield ids[start:end]
                    start = end
            else:
                yield from self._encoded(group)

    def _small(self, words: list[str]) -> Iterator[np.ndarray]:
        """Ids of words of letters a-z: no rule changes or cuts them, so the tokenizer's model has them as they are."""
        for word in words:
            yield np.array([token.id for token in self.model.tokenize(word)], dtype=np.uint32)

    def look_up(self, chunks: list[bytes]) -> list:
        """The value of each chunk. New ones are encoded once, many in one call."""
        if len(self.young) > REMEMBERED or self.young_bytes > REMEMBERED_BYTES:
            self.young, self.old, self.young_bytes = {}, self.young, 0
        young, old = self.young, self.old
        if new := set(chunks).difference(young):
            self.young_bytes += sum(map(len, new))
            young.update((c, old[c]) for c in new if c in old)
            texts = {c: c.decode() for c in new.difference(young)}
            small = [c for c in texts if c.isalpha() and c.islower()]
            young.update(zip(small, map(self.of, self._small([texts.pop(c) for c in small])), strict=True))
            words = [c for c, text in texts.items() if text.isalpha()]
            young.update(zip(words, map(self.of, self._words([texts[c] for c in words])), strict=True))
            rest = [c for c, text in texts.items() if not text.isalpha()]
            young.update(zip(rest, map(self.of, self._encoded([texts[c] for c in rest])), strict=True))
        return list(map(young.__getitem__, chunks))


def pieces(text: bytes, size: int = BATCH_BYTES) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes, cut only where white space stands.

    A stretch without white space is never cut, however long it is.
    """
    start = 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) and text[at] not in _SPACES:
            at += 1
        yield text[start:at]
        start = at
    if start < len(text) or not text:
        yield text[start:]


def balanced(texts: Iterable[bytes], size: int = BATCH_BYTES, cut=pieces) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (number of the text, piece of it) of about ``size`` bytes each."""
    held, total = [], 0
    for number, text in enumerate(texts):
        for piece in cut(text, size):
            held.append((number, piece))
            total += len(piece)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def _at_lines(text: bytes, size: int = BATCH_BYTES) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes, cut before single line feeds that no other white space is near."""
    start = 0
    while len(text) - start > size:
        found = _LINE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start() + 1]
        start = found.start() + 1
    yield text[start:]


# ASCII letters, digits and common marks around a line feed.
_LINE = re.compile(rb"[!-~](?=\n[!-~])")


def _uncut(text: bytes, size: int = BATCH_BYTES) -> Iterator[bytes]:
    yield text


# The rules of a tokenizer that makes letters small and drops white space. Its words end in "</w>".
_DROPS_BLANKS = {
    "normalizer": ["NFC", ["Replace", r"\s+", " "], "Lowercase"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "end": "</w>",
}


def _drops_blanks(spec: dict) -> bool:
    """Whether chunks between white space may be encoded apart, letters A-Z made small and marks cut off."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    told = [s["type"] if s["type"] != "Replace" else ["Replace", s["pattern"].get("Regex"), s["content"]] for s in steps]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if told != _DROPS_BLANKS["normalizer"] or [p["type"] for p in before] != ["Split", "ByteLevel"]:
        return False
    split, on_bytes = before
    removed = split["pattern"].get("Regex") == _DROPS_BLANKS["split"] and split["behavior"] == "Removed" and split["invert"]
    marked = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    plain = not on_bytes["add_prefix_space"] and not on_bytes["use_regex"] and spec["model"].get("end_of_word_suffix") == _DROPS_BLANKS["end"]
    return removed and marked and plain and spec.get("post_processor") is None


def _on_bytes(spec: dict) -> bool:
    """Whether a single line feed between visible ASCII characters begins a token, whatever stands around."""
    before = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or "\n" in t["content"] for t in spec["added_tokens"])


class Coder:
    """What ``of`` gives for the array of ids of each piece of a text."""

    def __init__(self, path: str, of) -> None:
        self.of, self.remembered, self.cut = of, None, _uncut
        if path.endswith(".model"):
            self.encode = _sentences(path)
            return
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if _drops_blanks(spec):
            self.remembered, self.cut = Remembered(path, of), pieces
        elif _on_bytes(spec):
            self.cut = _at_lines
        self.encode = lambda texts: [x.ids for x in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, texts: Iterable[bytes]) -> Iterator[tuple[int, list]]:
        """(number of the text, values of its next pieces), batch by batch."""
        for batch in balanced(texts, cut=self.cut):
            if self.remembered is None:
                coded = self.encode([piece.decode() for _, piece in batch])
                for (number, _), ids in zip(batch, coded, strict=True):
                    yield number, [self.of(np.array(ids, dtype=np.uint32))]
                continue
            chunks = [chunks_of(piece) for _, piece in batch]
            values = iter(self.remembered.look_up([c for part in chunks for c in part]))
            for (number, _), part in zip(batch, chunks, strict=True):
                yield number, list(islice(values, len(part)))


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _sentences(path: str):
    return lambda texts: _model(path).encode(texts, num_threads=1)


def vocabulary_size(path: str) -> int:
    """One more than the largest id. A file that is neither .json nor .model is refused."""
    if path.endswith(".model"):
        return _model(path).get_piece_size()
    if not path.endswith(".json"):
        raise ValueError(f"{path}: only .json and .model tokenizers are read")
    return max(tokenizer(path).get_vocab(with_added_tokens=True).values()) + 1


@lru_cache(maxsize=4)
def _lengths(path: str) -> Coder:
    return Coder(path, len)


def _fitting(ids: np.ndarray, width: int) -> bytes:
    if width < 4 and ids.max(initial=0) >= 1 << 8 * width:
        raise ValueError(f"id {ids.max()} does not fit {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


@lru_cache(maxsize=4)
def _ids(path: str, width: int) -> Coder:
    # Ids of a small vocabulary always fit: they need no look.
    if vocabulary_size(path) <= 1 << 8 * width:
        return Coder(path, lambda ids: ids.astype(f"<u{width}").tobytes())
    return Coder(path, lambda ids: _fitting(ids, width))


def count_batch(texts: list[bytes], path: str) -> list[int]:
    """Tokens of each text."""
    counts = [0] * len(texts)
    for number, values in _lengths(path).parts(texts):
        counts[number] += sum(values)
    return counts


def ids_batch(texts: list[bytes], path: str, width: int = 4) -> list[bytes]:
    """Token ids of each text, as little-endian numbers of ``width`` bytes."""
    parts: list[list[bytes]] = [[] for _ in texts]
    for number, values in _ids(path, width).parts(texts):
        parts[number].append(b"".join(values))
    return [b"".join(p) for p in parts]


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices whose values of ``column`` have about ``size`` bytes; no row is cut.

    Spark hands over thousands of rows at once. Nothing is copied here, so that
    only a slice's rows are held as Python objects.
    """
    for batch in batches:
        lengths = pc.binary_length(batch.column(column).cast(pa.binary()))
        ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = min(int(np.searchsorted(ends, before + size)) + 1, len(ends))
            yield batch.slice(start, end - start)
            start = end


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Texts are counted whole, without added tokens; strings of special tokens
    inside a text count as the tokenizer's default has it. A null text is
    empty and has no tokens; ids may be null or repeated, each row is counted.
    Other columns are not read. Nothing is shuffled, only lengths come back. An
    empty table gives an empty table.

    ``path`` names a .json file of the tokenizers library or a .model file of
    sentencepiece; other files are refused.
    """
    vocabulary_size(path)
    schema = pa.schema([(id, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = as_bytes(batch.column(1))
            yield pa.record_batch([batch.column(0), [len(t) for t in texts], count_batch(texts, path)], schema=schema)

    read = docs.select(F.col(id).cast("long").alias(id), F.col(text).alias("text"))
    counted = read.mapInArrow(run, f"`{id}` long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
