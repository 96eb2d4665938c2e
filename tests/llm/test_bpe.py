import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from frames import empty, messy, rows
from seafret.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MINE = bpe.WordBpe(PATH)


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    got = MINE.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert MINE.decode(got) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aàAbtheing'sm<|endoftext|> \n\x1c\x85 ²٣Σς́😀", max_size=80))
def test_hard_letters(text):
    same(text)


def test_runs_and_specials():
    for text in ("a" * 301, "ab" * 77 + "aaa", "<|endoftext|><|startoftext|>x<|endoftext|", "it's we'LL 'S", "İΣ ΑΣ ΣΑ", "", " \n"):
        same(text)


def test_words_together_and_alone_agree():
    words = [w.encode() for w in ("hello", "thththth", "a", "zzzzzz", "bananas")]
    assert MINE.merge(words) == [MINE.merge([w])[0] for w in words]


def test_nothing_to_merge():
    assert MINE.merge([]) == []
    MINE.prepare(["", " "])
    assert MINE.encode(["", "\n"]) == [b"", b""]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    fresh = bpe.WordBpe(PATH)
    text = " ".join(f"word{i} and{i % 7}" for i in range(300))
    fresh.prepare([text, text])
    assert fresh.encode([text]) == MINE.encode([text])


def test_frame(spark):
    got = bpe.digests(messy(spark), PATH).collect()
    want = []
    for doc_id, text, *_ in rows():
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want.append((str(doc_id), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.digests(empty(spark), PATH).count() == 0
    whole = {r.doc_id: r for r in bpe.encode(messy(spark), PATH).collect()}
    assert whole[2].ids == [] and whole[2].decoded == ""
    assert whole[1].ids == LIBRARY.encode(rows()[0][1], add_special_tokens=False).ids


def test_pairs_of_marks_equal_the_library():
    """Every combining mark beside one of each class, in both orders."""
    import unicodedata

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mine = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))] + [chr(0x11930), chr(0x11935), chr(0x11938)]
    partners = {unicodedata.combining(m): m for m in reversed(marks)}.values()
    texts = [f"a{x}{y} b{y}{x}\u00e9" for x in marks for y in partners]
    for i in range(0, len(texts), 500):
        some = " ".join(texts[i : i + 500])
        ids = library.encode(some, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode([some])[0], "<u4").tolist() == ids
