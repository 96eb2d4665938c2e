"""BPE encoding and decoding with the word-end vocabulary of a tokenizers file, in batched numpy merge rounds.

Null text encodes as empty (no tokens, empty decoded text). Rows are independent: repeated rows give repeated results, an
empty table an empty result, a very long text is encoded word by word. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from seafret.llm.common import text_of

NONE = np.int64(1 << 40)
#: Characters that str.split() takes for white space and the vocabulary file's pattern does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space by Unicode, as the file's normalizer replaces it.
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
# Ranges of letters and numbers that the regex module knows and the library's pattern does not, and capitals that
# the library knows and Python does not, with the distance to their small letters.
UNKNOWN_LETTERS = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed
1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
UNKNOWN_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
FIRST_UNKNOWN = "\u0558"
# Combining marks (and one vowel sign that composes) which are newer than the library's tables: it leaves them where they are.
UNKNOWN_MARKS = """7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50
10f82-10f85 11070 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1
1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"""
FIRST_UNKNOWN_MARK = "\u07fd"
NEW_CAPITALS = {
    "1c89": 1, "a7cb": 0x264 - 0xA7CB, "a7cc": 1, "a7ce": 1, "a7d2": 1, "a7d4": 1, "a7da": 1, "a7dc": 0x19B - 0xA7DC,
    "10d50-10d65": 0x20, "16ea0-16eb8": 0x1B,
}


def _ranges(text: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (r.partition("-") for r in text.split())]


def _class(text: str) -> str:
    """Inner part of a character class."""
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(text))


AT_MARKS = re.compile(f"([{_class(UNKNOWN_MARKS)}])")
SMALL = {c: c + far for text, far in NEW_CAPITALS.items() for a, b in _ranges(text) for c in range(a, b + 1)}
#: Words whose ids a worker remembers.
REMEMBERED = 300_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Vocabulary, merges and special tokens of a tokenizers file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        for name, known in ((r"\p{L}", UNKNOWN_LETTERS), (r"\p{N}", UNKNOWN_NUMBERS)):
            pattern = pattern.replace(name, f"[{name}--[{_class(known)}]]")
        self.exact = regex.compile(pattern, regex.V1)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)))
        letters = _byte_letters()
        # symbols of a byte inside a word and at its end
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + self.suffix] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = 1 + max(max(vocab.values()), max(self.specials.values()))
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        content = {i: t for t, i in (vocab | self.specials).items()}
        self.content = [content.get(i, "") for i in range(self.size)]
        self.known: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it is no merge) and where it is in the sorted keys."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (no empty ones) as little-endian 32-bit integers.

        All words are one flat array. Each round finds the lowest-ranked pair of every unfinished word and merges its
        occurrences from left to right; words without a pair left drop out.
        """
        out: list[bytes] = [b""] * len(words)
        if not words:
            return out
        n = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        last = np.cumsum(n) - 1
        sym[last] = self.final[flat[last]]
        word = np.repeat(np.arange(len(words)), n)
        rank, at = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        fresh = np.setdiff1d(np.arange(len(sym)), last, assume_unique=True)  # pairs within a word
        while len(sym):
            rank[fresh], at[fresh] = self.ranks(sym[fresh], sym[fresh + 1])
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            counts = np.diff(np.append(start, len(sym)))
            if done.any():
                raw = sym.astype("<u4").tobytes()
                which, begin, end = word[start[done]].tolist(), (4 * start[done]).tolist(), (4 * (start + counts)[done]).tolist()
                for k, i, j in zip(which, begin, end):
                    out[k] = raw[i:j]
                keep = np.repeat(~done, counts)
                sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
                low, counts = low[~done], counts[~done]
                if not len(sym):
                    break
            # in a run such as a a a every second pair overlaps the one before it
            pos = np.flatnonzero(rank == np.repeat(low, counts))
            new_run = np.concatenate(([True], np.diff(pos) > 1))
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
            sym[pos] = self.made[at[pos]]
            rank[pos] = rank[pos + 1]  # none if the pair ended its word
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            pos -= np.arange(len(pos))
            # only pairs with a new symbol have a new rank
            fresh = np.union1d(pos, pos[pos > 0] - 1)
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of chunks, which are texts without white space."""
        pieces = {}
        for c in chunks:
            found = self.pattern if c.isascii() or max(c) < FIRST_UNKNOWN else self.exact
            pieces[c] = [p.encode("utf-8", "surrogatepass") for p in found.findall(normal(c))]
        words = list({w for ps in pieces.values() for w in ps})
        ids = dict(zip(words, self.merge(words)))
        for c, ps in pieces.items():
            self.known[c] = b"".join([ids[p] for p in ps])

    def prepare(self, texts: list[str]) -> None:
        """Learn the new words of many texts in one go, if they are not too many to be held at once."""
        if sum(map(len, texts)) < 1 << 22:
            new = set(" ".join(texts).split()).difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            self.learn(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, special strings in it as their tokens."""
        out = []
        for text in texts:
            parts, end = [], 0
            if "<|" in text:
                for m in self.special.finditer(text):
                    parts += [self._plain(text[end : m.start()]), self.specials[m.group()].to_bytes(4, "little")]
                    end = m.end()
            out.append(b"".join([*parts, self._plain(text[end:])]))
        return out

    def _plain(self, text: str) -> bytes:
        chunks = WHITE.split(text) if SEPARATORS.search(text) else text.split()
        known = self.known
        ids = []
        for i in range(0, len(chunks), 1 << 17):
            some = chunks[i : i + (1 << 17)]
            new = set(some).difference(known)
            if new:
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = set(some)
                self.learn(new)
            ids.append(b"".join(map(known.__getitem__, some)))
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, as the file names no decoder; special tokens are not skipped."""
        return " ".join(map(self.content.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def normal(text: str) -> str:
    """Composed and lower-cased letter by letter (no special final sigma)."""
    if text.isascii():
        return text.lower()
    if max(text) < FIRST_UNKNOWN_MARK:
        composed = unicodedata.normalize("NFC", text)
    else:  # a mark without a class divides what is put in order
        composed = "".join([unicodedata.normalize("NFC", part) for part in AT_MARKS.split(text)])
    return composed.replace("Σ", "σ").lower().translate(SMALL)


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """One vocabulary per worker."""
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def _codes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            texts = batch.column(1)
            # whole words of many texts are merged together
            for i in range(0, len(texts), 64):
                some = [t or "" for t in texts.slice(i, 64).to_pylist()]
                bpe.prepare(some)
                ids = bpe.encode(some)
                decoded = [bpe.decode(x).encode("utf-8", "surrogatepass") for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 64),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _both(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for i in range(len(batch)):
                ids = bpe.encode([batch.column(1)[i].as_py() or ""])[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1),
                        pa.array([np.frombuffer(ids, "<u4").astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([bpe.decode(ids)]),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of every text."""
    return _read(docs).mapInArrow(_both(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; the ids and texts never leave their task."""
    return _read(docs).mapInArrow(_codes(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
