"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tree's leaves hold the merge rank of each symbol with its right neighbour and its root
the smallest (rank, position): the leftmost merge of lowest rank. A merge changes three
leaves, each in logarithmic time, and the work ends when the root holds no merge.
"""

import hashlib
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from corpusplan.llm.common import store_of, texts_of, with_columns

CACHE_WORDS = 1 << 19
_NONE = 1 << 62


# Letters, numbers and lower cases that Unicode 16 and 17 gave to code points that Python's
# own tables still call unassigned (first, last) and (first upper case, last, first lower case).
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
               (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
               (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
               (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
               (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
             (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
             (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]


def _ranges(kind: str, more=()) -> str:
    """The code points whose category begins with `kind`, and more, as the inside of a pattern's set."""
    found, start = list(more), None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c)).startswith(kind)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            found.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merge_all(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge pairs of ids, the lowest rank first and of equals the leftmost, until none is left.

    merges: pair of ids to (rank, id of the merged symbol).
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    shift = size.bit_length()
    place = (1 << shift) - 1
    get = merges.get
    made = [get(p) for p in zip(symbols, symbols[1:])]
    made.append(None)  # the last symbol has no right neighbour
    tree = [_NONE] * size
    tree += [m[0] << shift | i if m else _NONE for i, m in enumerate(made)]
    tree += [_NONE] * (2 * size - len(tree))
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        i = root & place
        j = after[i]
        symbols[i] = made[i][1]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            made[i] = m = get((symbols[i], symbols[k]))
            changes = [(i + size, m[0] << shift | i if m else _NONE), (j + size, _NONE)]
        else:  # the merged symbol is the last one; had j a leaf, it held no merge
            changes = [(i + size, _NONE)]
        h = before[i]
        if h >= 0:
            made[h] = m = get((symbols[h], symbols[i]))
            changes.append((h + size, m[0] << shift | h if m else _NONE))
        for leaf, value in changes:
            if tree[leaf] == value:
                continue
            tree[leaf] = value
            while leaf > 1:  # up to the root, or as far as a minimum changes
                other = tree[leaf ^ 1]
                low = value if value < other else other
                leaf >>= 1
                if tree[leaf] == low:
                    break
                tree[leaf] = value = low
    return [s for s in symbols if s >= 0]


def _is_latin(text: str) -> bool:
    """Whether all code points are below 256; of those none is in doubt."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words(dict):
    """Word to its ids as little-endian bytes; emptied when it has grown to its bound."""

    def __init__(self, encode, bound: int):
        super().__init__()
        self.encode, self.bound = encode, bound

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        out = self[word] = self.encode(word)
        return out


class Tokenizer:
    """A BPE vocabulary with word ends: lower case, white space dropped, special tokens whole."""

    # white space, written out as it is a matter of Unicode's property and not of a library
    _SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

    def __init__(self, definition: dict, cache_words: int = CACHE_WORDS):
        model = definition["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in definition["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [""] * size
        for token, i in {**vocab, **special}.items():
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.special = {t: np.uint32(i).astype("<u4").tobytes() for t, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.words = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{self._SPACE}\p{{L}}\p{{N}}]+")
        # the fast pattern knows another Unicode version: texts with code points in doubt take a slower one
        letters_, numbers = _ranges("L", NEW_LETTERS), _ranges("N", NEW_NUMBERS)
        self.doubtful = re.compile(f"[{_ranges('Cn')}]")
        self.careful = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters_}]+|[{numbers}]|[^{self._SPACE}{letters_}{numbers}]+")
        self.lower = {a + i: low + i for a, b, low in NEW_LOWER for i in range(b - a + 1)}
        self.cache = _Words(self._encode_word, cache_words)

    def _encode_word(self, word: str) -> bytes:
        data = word.encode()
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return np.array(merge_all(symbols, self.merges), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        # runs of white space may stay: no word holds any
        text = unicodedata.normalize("NFC", text)
        # letter by letter: a sigma at a word's end is no other letter
        text = text.replace("Σ", "σ").lower()
        words = self.words
        if not _is_latin(text) and self.doubtful.search(text):
            text, words = text.translate(self.lower), self.careful
        return b"".join(map(self.cache.__getitem__, words.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, one after another."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, special ones too, joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_definition(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", keep: bool = True,
                  cache_words: int = CACHE_WORDS) -> DataFrame:
    """Add `n_tokens`, `ids_sha256` (ids as little-endian unsigned 32-bit integers) and
    `decoded_sha256` (UTF-8), in lower-case hexadecimal; with `keep` also `ids` and `decoded`.

    `vocabulary` is the path of a tokenizer file that every executor has. Null text counts
    as empty: no ids, empty decoded text. Columns of these names are replaced. A worker
    remembers at most `cache_words` words, so its memory has a bound.
    """
    store_of(docs.sparkSession, "bpe")

    def work():
        tokenizer = Tokenizer(load_definition(vocabulary), cache_words)

        def step(batch):
            ids = [tokenizer.encode(t) for t in texts_of(batch, text)]
            out = [[len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids]]
            if not keep:
                return [*out, [hashlib.sha256(tokenizer.decode(i).encode()).hexdigest() for i in ids]]
            decoded = [tokenizer.decode(i) for i in ids]
            return [*out, [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                    [np.frombuffer(i, "<u4").astype(np.int32) for i in ids], decoded]
        return step

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return with_columns(docs, added + ", ids array<int>, decoded string" * keep, work)
