"""BPE encoding and decoding with a published vocabulary, in batched numpy merge rounds.

Texts are normalised and cut into words as the vocabulary file prescribes (NFC, runs of
white space to one blank, lower case; contractions, runs of letters, single numbers,
runs of other signs). The distinct words of a slice lie one after another in one flat
symbol array. In every round the rank of each adjacent pair is found by binary search
over the sorted pair keys, each word merges all places of its lowest pair, and words
without a pair are done; a round serves all words at once. Words seen before in a task
are looked up.

Edge cases: a null text is empty; an empty text has no tokens and decodes to "". The two
special tokens are recognised where their strings stand in the raw text. Characters
without a token, if the vocabulary had any gap, are skipped as the file's settings
(no unknown token) demand.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from mentionlake.llm.arrays import lists, slices
from mentionlake.llm.tables import documents, texts_of

WORD_BPE = "word_bpe_49k.json"
# Words remembered per task; beyond that the table starts anew.
REMEMBERED = 1 << 18


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, more = [], 0
    for byte in range(256):
        letters.append(chr(byte if byte in plain else 256 + more))
        more += byte not in plain
    return letters


# Letters and numbers of the regex module's Unicode that the tokenizers
# library, built on an earlier one, takes for other signs. First and last code points.
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1
1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""


# Capitals that the tokenizers library's Unicode has and Python's has not:
# first and last code point, and the lower-case letter of the first.
CAPITALS = """
1c89-1c89 1c8a, a7cb-a7cb 264, a7cc-a7cc a7cd, a7ce-a7ce a7cf, a7d2-a7d2 a7d3, a7d4-a7d4 a7d5, a7da-a7da a7db, a7dc-a7dc 19b,
10d50-10d65 10d70, 16ea0-16eb8 16ebb
"""


def newer_capitals() -> dict[int, int]:
    """Code points of those capitals, each with that of its lower-case letter."""
    out = {}
    for entry in CAPITALS.split(","):
        span, low = entry.split()
        first, last = (int(x, 16) for x in span.split("-"))
        out.update(zip(range(first, last + 1), range(int(low, 16), int(low, 16) + last - first + 1)))
    return out


def newer_signs() -> list[tuple[str, str]]:
    return [tuple(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()]


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of a tokenizer file; ids of single bytes, inside a word and at its end."""

    tokens: list[str]
    special: dict[str, int]
    inner: np.ndarray
    final: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    cut: str
    newer: list[tuple[str, str]]

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in {**vocab, **special}.items():
            tokens[i] = token
        letters = byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return cls(
            tokens, special,
            np.array([vocab.get(x, -1) for x in letters]), np.array([vocab.get(x + suffix, -1) for x in letters]),
            keys[order], order, merged[order], cut, newer_signs(),
        )


_FAR = np.int64(1) << 40


def encode_words(words: list[str], v: Vocabulary) -> list[np.ndarray]:
    """The ids of each word."""
    raw = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    symbols = v.inner[flat]
    ends = np.cumsum(sizes) - 1
    symbols[ends] = v.final[flat[ends]]
    owner = np.repeat(np.arange(len(words)), sizes)
    known = symbols >= 0
    symbols, owner = symbols[known], owner[known]
    done_symbols, done_owner = [], []
    while len(symbols) > 1:
        pair = symbols[:-1] << 32 | symbols[1:]
        at = np.searchsorted(v.keys, pair)
        at[at == len(v.keys)] = 0
        rank = np.where((v.keys[at] == pair) & (owner[:-1] == owner[1:]), v.ranks[at], _FAR)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lowest = np.minimum.reduceat(np.append(rank, _FAR), starts)
        each = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
        over = each == _FAR
        if over.any():  # words without a pair left leave the array
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            live = ~over
            symbols, owner, each = symbols[live], owner[live], each[live]
            rank, at = np.append(rank, _FAR)[live][:-1], np.append(at, 0)[live][:-1]
            if len(symbols) < 2:
                break
        chosen = rank == each[:-1]
        # of overlapping places of one pair (a a a) every second one merges, from the left
        if (chosen[1:] & chosen[:-1]).any():
            index = np.arange(len(chosen))
            last_free = np.maximum.accumulate(np.where(chosen, -1, index))
            chosen &= (index - last_free) % 2 == 1
        places = np.flatnonzero(chosen)
        symbols[places] = v.merged[at[places]]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    done_symbols.append(symbols)
    done_owner.append(owner)
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    symbols = symbols[np.argsort(owner, kind="stable")]
    return np.split(symbols, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


class Encoder:
    """Encodes texts with one vocabulary; remembers words between calls."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.cut = regex.compile(v.cut)
        ranges = "".join(f"{a}-{b}" for a, b in v.newer)
        self.newer = {chr(c) for a, b in v.newer for c in range(ord(a), ord(b) + 1)}
        older = v.cut.replace(r"\p{L}", f"[\\p{{L}}--[{ranges}]]").replace(r"\p{N}", f"[\\p{{N}}--[{ranges}]]")
        self.older_cut = regex.compile(older, regex.V1)
        self.capitals = newer_capitals()
        self.capital = frozenset(map(chr, self.capitals))
        self.space = regex.compile(r"\s+")
        self.marks = regex.compile("|".join(map(regex.escape, v.special)))
        self.known: dict[str, np.ndarray] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens are among them as they are."""
        found: list[str] = []
        at = 0
        for mark in self.marks.finditer(text):
            found += self._plain(text[at : mark.start()])
            found.append(mark.group())
            at = mark.end()
        return found + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        if not text.isascii() and not self.capital.isdisjoint(text):
            text = text.translate(self.capitals)
        # letter by letter, as a final sigma is no exception here
        text = text.lower() if text.isascii() or "Σ" not in text else "".join(map(str.lower, text))
        if text.isascii() or self.newer.isdisjoint(text):
            return self.cut.findall(text)
        return self.older_cut.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t or "") for t in texts]
        fresh = list({w for ws in cut for w in ws} - self.known.keys())
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list({w for ws in cut for w in ws})
        plain = [w for w in fresh if w not in self.v.special]
        if plain:
            self.known.update(zip(plain, encode_words(plain, self.v)))
        for w in fresh:
            if w in self.v.special:
                self.known[w] = np.array([self.v.special[w]])
        none = np.zeros(0, np.int64)
        known = self.known
        return [np.concatenate([known[w] for w in ws]) if ws else none for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids with a blank between them: the file names no decoder."""
        tokens = self.v.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of its text and what they decode to."""
    v = Vocabulary.read(path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(part.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists(flat, offsets, pa.int32()), pa.array([encoder.decode(i) for i in ids])],
                    ["doc_id", "ids", "decoded"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), made where a text is encoded."""
    v = Vocabulary.read(path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(encoder.decode(i).encode()).hexdigest() for i in ids]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
