import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import tokens as K

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def ranks():
    return K.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder(ranks, tmp_path_factory):
    path = tmp_path_factory.mktemp("lex") / "lex.bin"
    path.write_bytes(K.compile_lexicon([" graph", " graphs", "graph", " edges", " edge", "ge", " the", "学习", " convolutional"], ranks))
    return K.Encoder(str(path))


TEXTS = ["The graph's edges, and graphs of graphs.", "<|endoftext|> is text", "   ", " \n\n x", "学习率在54轮之后减半。", "naïve Übergänge ¿qué?", "a" * 5000, "_" * 9001, "é" * 700, "👩‍🔬 🙂", "don't I'LL they've", "\t 　x", "a\x001\x00\x00 \x00!\x00"]


def split(ids, sizes):
    out, at = [], 0
    for n in sizes:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_known_texts(encoder, reference):
    assert split(*encoder.encode(TEXTS)) == reference(TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", categories=["Lu", "Ll", "Nd", "Zs", "Po", "Sm"], max_codepoint=0x2FFF) | st.sampled_from(" \n\t'graph"), max_size=40))
def test_merge_is_exact(encoder, reference, text):
    assert split(*encoder.encode([text])) == reference([text])


def test_automaton_numbers_words_and_shares_suffixes():
    words = sorted({w.encode() for w in ["walking", "talking", "walked", "talked", "a", "ab", "abc", "zebra"]})
    a = K.Automaton(words)
    t = a.tables()
    assert len(t["final"]) < sum(map(len, words))
    e = K.Encoder.__new__(K.Encoder)
    e.a = t
    assert e.numbers(words).tolist() == list(range(len(words)))
    assert e.numbers([b"", b"walk", b"zebras", b"b"]).tolist() == [-1] * 4


@pytest.mark.parametrize("size", [0, 5, 1000])
def test_lexicon_size_changes_nothing(table, reference, size):
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choice(["node", "edge", "walks", "Graph", "loss=0.5"]) for _ in range(30)) for _ in range(20)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(1000, None, "c"), (1001, "", "c")]
    df = table(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in K.encode(df, ["doc_id"], lexicon_size=max(size, 1)).collect()}
    assert got.pop(1000) == [] and got.pop(1001) == []
    assert [got[i] for i in range(len(texts))] == reference(texts)
    n = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(df, ["doc_id"], lexicon_size=max(size, 1)).collect()}
    assert all(n[i] == len(got[i]) for i in got) and n[1000] == 0


def test_no_documents(table):
    assert K.encode(table([], "doc_id bigint, text string"), ["doc_id"]).count() == 0
