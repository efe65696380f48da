import json

import pytest
from tokenizers import Tokenizer

from rankloom.llm import bpe
from rankloom.llm.queries import TOKENIZER

TEXTS = [
    None, "", " ", "Hello world's don't I'LL 123", "a<|endoftext|>b <|startoftext|><|startoftext|>", "İstanbul ΣΑΣ ǅ ﬁ x é 中文字 🙂🙂 ١٢", "aaaaaaaaaaaaaaaaaa hahahahahaha " * 3, "\x00\x01 \x1c a\x85b\u00a0c\u2003d",
    "unprefixed prefix prefixes prefixing", "x" * 3000, "<|endoftext", "the,the.the!!" * 50,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_ids_and_decoding_match_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids binary")
    rows = bpe.encode_documents(docs, TOKENIZER).orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS)
    for r, t in zip(rows, TEXTS, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(r.ids)).cast("I") if r.ids else []) == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), TOKENIZER).count() == 0


def test_small_bounds_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PAIRS", 50)
    monkeypatch.setattr(bpe, "MOST_WORDS", 10)
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    for t in TEXTS * 2:
        (ids,) = encoder.encode([t or ""])
        assert list(memoryview(ids).cast("I") if ids else []) == library.encode(t or "", add_special_tokens=False).ids


def test_shared_prefixes_are_computed_once():
    trie = bpe.WordTrie({"a": 0, "b": 1, "a</w>": 2, "b</w>": 3, "ab": 4, "ab</w>": 5, "aba</w>": 6}, [("a", "b"), ("a", "b</w>"), ("ab", "a</w>")])
    assert dict(trie.encode({"ab", "aba", "abab", "bb"})) == {"ab": [5], "aba": [6], "abab": [4, 5], "bb": [1, 3]}
    # a, ab$ | b, a$ | a, b$ | b, b$: each node of the trie once
    assert trie.n_steps == 8


# --- files with other settings ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spec():
    with open(TOKENIZER, encoding="utf-8") as f:
        return json.load(f)


OTHERS = {
    "cased": {"normalizer": {"type": "NFC"}},
    "no normaliser": {"normalizer": None},
    "another decoder": {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}},
    "white space only": {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}},
    "no added tokens": {"added_tokens": []},
    "added tokens within each other": {"added_tokens": [{"id": 49406 + i, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, c in enumerate(["<|end", "<|endoftext|>"])]},
}


@pytest.mark.parametrize("name", OTHERS)
def test_other_settings_give_what_the_library_gives(spec, name):
    text = json.dumps(spec | OTHERS[name])
    library, encoder = Tokenizer.from_str(text), bpe.Encoder(text)
    for t in [*TEXTS, "Hello World", "Don't SHOUT", "a\u0301 A\u030a  b"]:
        want = library.encode(t or "", add_special_tokens=False).ids
        (ids,) = encoder.encode([t or ""])
        assert list(memoryview(ids).cast("I") if ids else []) == want, t
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_models_of_other_kinds_are_refused(spark, spec, tmp_path):
    plain = {"id": 49406, "content": "<x>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    wrong = [
        spec | {"model": spec["model"] | {"end_of_word_suffix": None}}, spec | {"model": spec["model"] | {"byte_fallback": True}}, spec | {"model": spec["model"] | {"dropout": 0.1}}, spec | {"pre_tokenizer": {"type": "Whitespace"}}, spec | {"pre_tokenizer": None},
        spec | {"added_tokens": [plain | {"lstrip": True}]}, spec | {"added_tokens": [plain | {"normalized": True}]},
    ]
    for k, parsed in enumerate(wrong):
        (path := tmp_path / f"{k}.json").write_text(json.dumps(parsed))
        with pytest.raises(ValueError):
            bpe.encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(path))
