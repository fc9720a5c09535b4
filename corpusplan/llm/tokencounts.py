"""Exact token counts of every prefix of a text, by dynamic programming over its last tokens.

The BPE tokens of a text are the one sequence in which every two neighbours, encoded on their
own, stay the two tokens they are: a merge over a border needs nothing but the two tokens beside it.
So each prefix has one last token, namely the token that ends there and may follow the last
token of the prefix before it, and

    count(prefix) = count(prefix without its last token) + 1.

That is worked out once for every word and kept; a count at any place, the longest prefix within a
budget, or whether a text fits are then looked up in the stored counts without encoding again.
"""

import re
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusplan.llm.common import kept_by_worker, store_of, texts_of, with_columns

SPACE = "▁"  # what the vocabulary writes for a blank, and puts before every text
CACHE_WORDS = 1 << 19
CACHE_PAIRS = 1 << 19
CACHE_MOVES = 1 << 17
LONG_WORD = 64  # longer words are counted each time
_SLICE = 1 << 20  # characters cut into words at a time
_TOGETHER = 1 << 22  # characters whose new words are worked out together
_MANY = 1 << 20  # words held at a time, unless a slice has more


def _kin(pieces) -> list[str]:
    """The letters that pieces hold side by side, directly or through others, blanks aside; the largest set first."""
    kin: dict[str, list[str]] = {}
    for a, b in {pair for p in pieces for pair in zip(p, p[1:]) if SPACE not in pair}:
        more, less = sorted((kin.setdefault(a, [a]), kin.setdefault(b, [b])), key=len, reverse=True)
        if more is not less:
            more += less
            kin.update(dict.fromkeys(less, more))
    return sorted({"".join(sorted(k)) for k in kin.values()}, key=lambda k: (-len(k), k))


class _Place(dict):
    """A place in the automaton of the pieces: the next place by letter, and the pieces that end here, the longest first."""

    __slots__ = ("text", "ends", "move")

    def __init__(self, text: str, ends: list[tuple[int, int, int]], move):
        super().__init__()
        self.text, self.ends, self.move = text, ends, move

    def __missing__(self, letter: str) -> "_Place":
        found = self[letter] = self.move(self.text + letter)
        return found


class Vocabulary:
    """A BPE vocabulary of pieces with scores; characters it doesn't know are spelt in bytes."""

    def __init__(self, scores: dict[str, float], cache_words: int = CACHE_WORDS):
        self.scores = scores
        self.pieces = list(scores)
        self.ids = {p: i for i, p in enumerate(scores)}
        self.heads = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        # texts are cut where no piece goes on: before blanks, and between letters that no piece holds side by side
        inner = any(SPACE in p.lstrip(SPACE) for p in scores)
        sets = [f"[{re.escape(k)}]+" for k in _kin(scores)]
        self.cut = re.compile("(?s).+" if inner else f"{SPACE}*(?:{'|'.join([*sets, f'[^{SPACE}]'])})|{SPACE}+")
        self.border = None if inner else re.compile(f"[^{SPACE}](?={SPACE})")
        self.pairs: dict[int, bool] = {}
        self.places: dict[str, _Place] = {}
        self.moves = 0
        self.start = _Place("", [], self.move)
        # two generations: what is still met when the younger one is full moves on, the rest is forgotten
        self.young: dict[str, array] = {}
        self.old: dict[str, array] = {}
        self.bound = max(1, cache_words // 2)

    def merged(self, symbols: list[str]) -> list[str]:
        """The highest score first, and of equals the leftmost, until no pair is a piece."""
        symbols = list(symbols)
        ranks = [self.scores.get(a + b) for a, b in zip(symbols, symbols[1:])]
        while (best := max((r for r in ranks if r is not None), default=None)) is not None:
            at = ranks.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.scores.get(symbols[at - 1] + symbols[at])
            if at < len(ranks):
                ranks[at] = self.scores.get(symbols[at] + symbols[at + 1])
        return symbols

    def token(self, number: int) -> str:
        return self.pieces[number - 1] if number <= len(self.pieces) else chr(number - len(self.pieces) - 1)

    def follows(self, key: int) -> bool:
        """Whether the two tokens, encoded together, stay apart and whole; nothing before: whether the token stays whole."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        apart = [self.token(n) for n in (key >> 21, key & 0x1FFFFF) if n]
        known = self.pairs[key] = self.merged([*"".join(apart)]) == apart
        return known

    def move(self, text: str) -> _Place:
        """The place after these letters: that of their longest end that begins a piece, or else of the last letter."""
        if self.moves >= CACHE_MOVES:
            for place in (self.start, *self.places.values()):
                place.clear()
            self.places, self.moves = {}, 0
        self.moves += 1
        while len(text) > 1 and text not in self.heads:
            text = text[1:]
        if (place := self.places.get(text)) is None:
            ends = [(len(text) - i, self.ids[text[i:]] + 1, 1) for i in range(len(text)) if text[i:] in self.ids]
            if text[-1] not in self.ids:
                ends.append((1, len(self.pieces) + 1 + ord(text[-1]), len(text[-1].encode())))
            place = self.places[text] = _Place(text, ends, self.move)
        return place

    def counted(self, words: list[str]) -> dict[str, array]:
        """The number of tokens of each prefix (not the empty one) of each word.

        In sorted order a word shares the table of the one before it as far as their letters are equal.
        """
        known, follows = self.pairs.get, self.follows
        # of each prefix: its tokens, the number of its last token and its place
        out, count, number, places, before = {}, [0], [0], [self.start], ""
        for word in sorted(words):
            same = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                same += 1
            del count[same + 1:], number[same + 1:], places[same + 1:]
            place = places[-1]
            for letter in word[same:]:
                place = place[letter]
                for length, own, tokens in place.ends:
                    key = number[-length] << 21 | own
                    if (apart := known(key)) or apart is None and follows(key):
                        break
                else:
                    raise AssertionError(f"no last token: {word[:len(count)]!r}")
                count.append(count[-length] + tokens)
                number.append(own)
                places.append(place)
            out[word] = array("i", count[1:])
            before = word
        return out

    def look_up(self, words: list[str]) -> list[array]:
        """The prefix counts of words, those not remembered worked out together."""
        found = [*map(self.young.get, words)]
        if missed := {w for w, f in zip(words, found) if f is None}:
            again = {w: f for w in missed if (f := self.old.get(w)) is not None}
            fresh = self.counted([*(missed - again.keys())]) | again
            found = [fresh[w] if f is None else f for w, f in zip(words, found)]
            for w, f in fresh.items():
                if len(w) <= LONG_WORD:
                    if len(self.young) >= self.bound:
                        self.old, self.young = self.young, {}
                    self.young[w] = f
        return found

    def slices(self, text: str):
        """The text as the vocabulary writes it, in slices that no token crosses."""
        text, at = SPACE + text.replace(" ", SPACE) if text else "", 0
        while at < len(text):
            end = self.border and self.border.search(text, at + _SLICE)
            end = end.end() if end else len(text)
            yield text[at:end]
            at = end

    def totals(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        out, words, owners, size = [0] * len(texts), [], [], 0

        def settle():
            new = [*dict.fromkeys(words)]
            known = {w: f[-1] for w, f in zip(new, self.look_up(new))}
            counts = map(known.__getitem__, words)
            for owner, n in owners:
                out[owner] += sum(islice(counts, n))
            del words[:], owners[:]

        for owner, text in enumerate(texts):
            for part in self.slices(text):
                pieces = self.cut.findall(part)
                words += pieces
                owners.append((owner, len(pieces)))
                size += len(part)
                if size >= _TOGETHER or len(words) >= _MANY:
                    settle()
                    size = 0
        settle()
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text[:len(text)]."""
        counts, total = [np.zeros(1, np.int64)], 0
        for n, part in enumerate(self.slices(text)):
            found = self.look_up(self.cut.findall(part))
            inside = np.frombuffer(b"".join(found), np.intc).astype(np.int64)
            totals = np.array([f[-1] for f in found], np.int64)
            inside += total + np.repeat(np.cumsum(totals) - totals, [len(f) for f in found])
            counts.append(inside[n == 0:])  # the blank put before a text counts with its first character
            total += int(totals.sum())
        return np.concatenate(counts)


def load_vocabulary(path: str, cache_words: int = CACHE_WORDS) -> Vocabulary:
    """The pieces and scores of a sentencepiece BPE file without normalisation rules."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  Åﬁ　b\t "
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError(f"{path}: its rules change texts")
    plain = (i for i in range(model.vocab_size())
             if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)))
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in plain}, cache_words)


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(counts).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(data), "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: bool = True,
                 cache_words: int = CACHE_WORDS) -> DataFrame:
    """Add `n_bytes` (UTF-8), `n_tokens` and, with `keep`, `prefix_counts`: the packed token counts of all prefixes.

    `vocabulary` is the path of a sentencepiece BPE file that every executor has. Null text counts as
    empty: no bytes, no tokens. Rows are answered one by one, repeated or not; columns of these names
    are replaced. A text of any length is one pass; a worker remembers at most `cache_words` words.
    """
    store_of(docs.sparkSession, "tokencounts")

    def work():
        known = kept_by_worker(("tokencounts", vocabulary, cache_words), lambda: load_vocabulary(vocabulary, cache_words))

        def step(batch):
            texts = texts_of(batch, text)
            sizes = [len(t.encode()) for t in texts]
            if not keep:
                return [sizes, known.totals(texts)]
            counts = [known.prefixes(t) for t in texts]
            return [sizes, [int(c[-1]) for c in counts], [packed(c) for c in counts]]
        return step

    return with_columns(docs, "n_bytes bigint, n_tokens bigint" + ", prefix_counts binary" * keep, work)


def _answers(counted: DataFrame, added: str, answer) -> DataFrame:
    def work():
        return lambda batch: [pa.array([None if c is None else answer(unpacked(c)) for c in batch.column("prefix_counts").to_pylist()],
                                       pa.int64())]
    return with_columns(counted, f"{added} bigint", work)


def longest_prefix(counted: DataFrame, budget: int, added: str = "n_kept") -> DataFrame:
    """Add the code points of the longest prefix of at most `budget` tokens, from the stored counts.

    A longer prefix can have fewer tokens, so it is the last place within the budget, not the first beyond it.
    """
    return _answers(counted, added, lambda c: int(np.flatnonzero(c <= budget)[-1]) if budget >= 0 else None)


def tokens_at(counted: DataFrame, place: int, added: str = "n_before") -> DataFrame:
    """Add the tokens of the first `place` code points (of the whole text, if it is shorter)."""
    return _answers(counted, added, lambda c: int(c[min(max(place, 0), len(c) - 1)]))


def truncate(counted: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """The rows with `text` cut to its longest prefix of at most `budget` tokens."""
    cut = longest_prefix(counted.withColumn(text, F.coalesce(text, F.lit(""))), budget, "_n_kept")
    return cut.withColumn(text, F.substring(F.col(text), F.lit(1), F.col("_n_kept").cast("int"))).drop("_n_kept")
