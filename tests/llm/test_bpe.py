"""Encoding and decoding against the tokenizers library."""

import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kadastra.llm import bpe
from tests.llm.helpers import awkward, documents

LIBRARY = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
KNOWN = bpe.Vocabulary(bpe.read_vocabulary())

TEXTS = [
    "Hello, world! It's 2024; we'll see they'RE I'd", "ΑΣ ΟΔΥΣΣΕΥΣ Σ", "İstanbul ﬁne é é Å Å", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaaaaaaaaaaa",
    "  　x​y", "١٢٣ ½ Ⅷ", "'s't're've'm'll'd'", "!!!???...!!!", "😀👩‍👩‍👧 🇵🇱", "ha" * 2000, "\x00\x01\x85\x7f",
]


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def ours(texts):
    ids, starts = KNOWN.encode_texts(texts)
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def decoded(ids, **how):
    return KNOWN.decode(pa.array([ids], pa.list_(pa.int32())), **how)[0].as_py()


@pytest.mark.parametrize("text", TEXTS)
def test_text_alone(text):
    ids = ours([text])[0]
    assert (ids, decoded(ids)) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs", "Cn")), max_size=60), max_size=6))
def test_any_texts(texts):
    assert ours(texts) == [library(t)[0] for t in texts]


def test_words_made_of_merges():
    r = random.Random(3)
    parts = [x.replace("</w>", "") for x in list(json.loads(bpe.read_vocabulary())["model"]["vocab"])[:3000] if x.isascii()]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(2000)]
    assert ours(texts) == [library(t)[0] for t in texts]


def test_table_with_awkward_rows(spark):
    rows = awkward() + [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)]
    docs = documents(spark, rows).selectExpr("*", "n_chars AS ids")
    got = bpe.decode(bpe.encode(docs))
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = sorted([(i, *library(t)) for i, t, _, _ in rows], key=repr)
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got.collect()], key=repr) == want
    assert sorted([tuple(r) for r in bpe.encode(docs, decoded="again").collect()], key=repr) == want


def test_small_chunks_give_the_same(spark, monkeypatch):
    texts = ["one two", None, "", "x" * 50, "three <|endoftext|> four"] * 5
    assert list(bpe._chunks([2, 1, 0, 3])) == [(0, 4)]
    monkeypatch.setattr(bpe, "CHUNK", 3)
    assert list(bpe._chunks([2, 1, 0, 3, 9, 1])) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert ours([t or "" for t in texts]) == [library(t)[0] for t in texts]


def test_special_tokens_are_left_out_on_request():
    assert decoded([49407, 3306], skip_special=True) == "hello</w>"
    some = pa.array([None, [49407], [], [3306, 49406]], pa.list_(pa.int32()))
    assert KNOWN.decode(some[1:], skip_special=True).to_pylist() == ["", "", "hello</w>"]
    assert KNOWN.decode(some).to_pylist() == ["", "<|endoftext|>", "", "hello</w> <|startoftext|>"]


def test_empty_table_and_wrong_vocabularies(spark, tmp_path):
    assert bpe.decode(bpe.encode(documents(spark, []))).collect() == []
    spec = json.loads(bpe.read_vocabulary())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError, match="lower rank"):
        bpe.Vocabulary(json.dumps(spec))
    with pytest.raises(ValueError, match="not a vocabulary"):
        bpe.Vocabulary(json.dumps(spec | {"normalizer": {"normalizers": []}}))


def test_merges_at_once_and_one_by_one_agree(monkeypatch):
    """Whatever share of the merges is made rank by rank; overlapping pairs (aaaa) and neighbouring ones (abab) too."""
    r, left, found = random.Random(3), [], []
    listed = ["".join(r.choices("aab" if k % 3 == 0 else ["the", "ing", "ation", "er", "al", "st"], k=r.randrange(1, 8))) for k in range(5000)]
    one_by_one = KNOWN._merge
    monkeypatch.setattr(KNOWN, "_merge", lambda *a: left.append(sum(map(len, a[3].values()))) or one_by_one(*a))
    for at_once in (0, bpe.AT_ONCE, 1 << 60):
        monkeypatch.setattr(bpe, "AT_ONCE", at_once)
        found.append([x.tolist() for x in KNOWN.encode(listed)])
    assert found[0] == found[1] == found[2]
    assert left[0] == 0 and left[1] < left[2] / 2  # few positions are left for single steps
    ids, starts = found[0]
    assert [ids[a:b] for a, b in zip(starts, starts[1:], strict=False)] == [library(w)[0] for w in listed]
