import random

import public_tokenizers
import pytest
import sentencepiece

from corpusplan.llm import queries, tokencounts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "▁", "a▁ b", "</s><s><unk><0x0A> <|x|>", "a\x00b", "é ﬁ　x", "日本語テスト😀", "\n\n\tx\r\n",
       "word" * 5000, " " * 3000, "x" * 70 + " y", "ab " * 4000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return tokencounts.load_vocabulary(PATH)


def texts(count, longest=40):
    rng = random.Random(3)
    letters = " ▁  abcdeéßthein\n\t日本😀ﬁ\x00ing.,-0123"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(count)]


def test_every_prefix_equals_the_library(library, vocabulary):
    for t in texts(300):
        assert vocabulary.prefixes(t).tolist() == [len(library.encode(t[:i])) for i in range(len(t) + 1)]


def test_slices_and_forgetting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "_SLICE", 16)
    monkeypatch.setattr(tokencounts, "_TOGETHER", 50)
    monkeypatch.setattr(tokencounts, "CACHE_PAIRS", 20)
    small = tokencounts.load_vocabulary(PATH, cache_words=6)
    some = [t for t in ODD if t and len(t) < 200] + texts(200, 90)
    assert small.totals(some) == [len(library.encode(t)) for t in some]
    assert [int(small.prefixes(t)[-1]) for t in some] == [len(library.encode(t)) for t in some]
    assert len(small.young) <= 3 and len(small.old) <= 3


def test_a_vocabulary_whose_pieces_cross_blanks():
    scores = {p: -i for i, p in enumerate(["▁", "a", "b", "a▁", "▁a", "a▁a", "b.", ".", "▁ab"])}
    v = tokencounts.Vocabulary(scores)
    for t in ("a a", "ab a", "b.a b", "a a a a", "aab.ab  a"):
        for i in range(1, len(t) + 1):
            assert v.prefixes(t)[i] == len(v.merged(list("▁" + t[:i].replace(" ", "▁"))))


def test_a_stem_is_worked_out_once_whatever_stands_around_it(library):
    v = tokencounts.load_vocabulary(PATH)
    stems, ends = ["house", "Garten", "дом", "cheval", "Éire", "x"], [".", ",", "!!", ".\nThe", "2", "7\n", "語", "😀", "\u0301"]
    some = [f"a {s}{e} {e}{s}" for s in stems for e in ends]
    assert v.totals(some) == [len(library.encode(t)) for t in some]
    assert len(v.young) < len(stems) * len(ends)  # words cut at blanks alone are twice as many


def test_joined_pieces_equal_the_library(library, vocabulary):
    rng = random.Random(5)
    pieces = [p.replace("▁", " ") for p in vocabulary.scores]
    some = ["".join(rng.choice(pieces[:1 << rng.randrange(6, 16)]) + rng.choice(["", "", "\u0301", "\t", "٣", "ß\x00", "😀"])
                    for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    assert vocabulary.totals(some) == [len(library.encode(t)) for t in some]
    for t in some[:150]:
        assert vocabulary.prefixes(t).tolist() == [len(library.encode(t[:i])) for i in range(len(t) + 1)]


def test_forgotten_places_and_many_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "CACHE_MOVES", 7)
    monkeypatch.setattr(tokencounts, "_MANY", 3)
    v = tokencounts.load_vocabulary(PATH)
    some = [t for t in ODD if t] + texts(200, 90)
    assert v.totals(some) == [len(library.encode(t)) for t in some]
    assert len(v.places) <= 7


def test_counts_budgets_and_truncation(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD + texts(30))] + [(0, None, "y"), (None, "ab", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = tokencounts.count_tokens(docs, PATH)
    assert counted.columns == ["doc_id", "text", "n_bytes", "n_tokens", "prefix_counts"]
    got = counted.collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t)))
    for budget in (0, 3, 7):
        cut = {(r.doc_id, r.text): r.n_kept for r in tokencounts.longest_prefix(counted, budget).collect()}
        for (_, t), n in cut.items():
            t = (t or "")[:400]
            sizes = [len(library.encode(t[:i])) for i in range(len(t) + 1)]
            if sizes[-1] > budget + 40 or len(t) < 400:
                assert n == max(i for i, s in enumerate(sizes) if s <= budget)
        kept = {r.doc_id: r.text for r in tokencounts.truncate(counted, budget).collect()}
        assert all(len(library.encode(t)) <= budget for t in kept.values())
    at = {r.doc_id: r.n_before for r in tokencounts.tokens_at(counted, 5).where("doc_id IS NOT NULL AND text IS NOT NULL").collect()}
    assert all(n == len(library.encode(ODD[i][:5])) for i, n in at.items() if i < len(ODD))
    assert tokencounts.count_tokens(docs.limit(0), PATH).count() == 0


def test_the_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or ""))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 4096)
