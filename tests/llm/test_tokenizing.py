import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from folio.llm import tokenizing
from folio.llm.tokenizing import PieceEncoder, _Table
from tests.llm.cases import awkward

TEXTS = [r[1] for r in awkward()] + ["a  b", "a\n b", "a\n  b", " x", "x ", "\0 y\0", " \n a", "It's 123  don't\t\tGo", "é́ Á Σας ΣΑΣ x", "a \x01 b \x01", "́ ́a b́", "a  b 　", " x  y", "a\x1f b", "\n\nA\n\n B \r\n", "   ", "a  ", "\tx", "a b", "don't, stop. (it), \"x\".", "a<|endoftext|> b", "<|startoftext|><|endoftext|>", " x  <|endoftext|>\n<|startoftext|> <|endoftext", "<|endoftext|><|endoftext|> é"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    encoder = PieceEncoder(public_tokenizers.path(name))
    for remembered in (10**6, 10):  # with and without forgetting
        monkeypatch.setattr(tokenizing, "REMEMBERED_PIECES", remembered)
        for texts in (TEXTS, TEXTS[::-1], [], [None], [""]):
            ids, of = encoder.encode(pa.array(texts, pa.string()))
            for k, text in enumerate(texts):
                assert ids[of[k] : of[k + 1]].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_table_finds_what_was_added():
    rng = np.random.default_rng(0)
    table, keys = _Table(4), rng.integers(1, 1 << 63, 5000, dtype=np.uint64)
    for a in range(0, 5000, 700):
        part = keys[a : a + 700]
        assert (table.find(part) == -1).all()
        table.add(part, np.arange(a, a + len(part), dtype=np.int32))
    assert (table.find(keys) == np.arange(5000)).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cuts_before_marks_keep_the_ids(name):
    rng = np.random.default_rng(3)
    parts = ["a", "Zz", "é", "ß", "×", "÷", "İ", "Σ", "7", "٣", "日", "—", "'", "'s", "'LL", ".", ",,", "###", "<|", "_", "~", "e\u0301", "\u0301", "\u0338", " ", "\n", "\t ", "\u00a0", "\0"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)]
    encoder = PieceEncoder(public_tokenizers.path(name))
    assert encoder.marks
    ids, of = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[of[k] : of[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_with_other_marks_are_no_new_pieces():
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["maison", "forêt", "été", "Straße"]
    encoder.encode(pa.array([f"x {w}" for w in words] + ["x. x, x! x###"]))
    known = encoder.table.size
    encoder.encode(pa.array([f"x {w}{m} {w}{m}" for w in words for m in (".", ",", "!", "###")]))
    assert encoder.table.size == known


def test_forgetting_keeps_pieces_that_recur(monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED_PIECES", 100)
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    common = " ".join(["of", *(f"w{k}" for k in range(20))])
    texts = [" ".join([common, *(f"n{j}x{k}" for k in range(60))]) for j in range(6)]
    learned = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda keys, pieces: (learned.append(len(keys)), learn(keys, pieces)))
    for text in texts:
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.table.size <= 100 + 81
    assert learned == [81] + [60] * 5
