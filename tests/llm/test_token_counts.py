"""Token counts against the tokenizer's library."""

import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadlens.llm import queries, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine(library):
    with open(PATH, encoding="utf-8") as f:
        return token_counts.Transducer(f.read(), token_counts.character_symbols(library.pre_tokenizer))


def _same(machine, library, texts):
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert machine.count(pa.array(texts, pa.string())).to_pylist() == want


def test_edges(machine, library):
    _same(machine, library, [
        None, "", " ", "  ", "a", "\n \n", "a\n b", "a\n  b", "'s", "'r", "'l", "'re", "x'll", "it's'", " 's", "don't've", "\0\0a",
        "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "é" * 999, "a" * 50_000, " " * 3000 + "x", "ab" * 20_000])


def test_random_texts(machine, library):
    rng = random.Random(1)
    alphabet = [*"   \n\t　 '''stmdrvle reZq9٣é中😀!<|>", "<|endoftext|>", "'re", "'ll", "  ", "don't"]
    _same(machine, library, ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(20_000)])
    points = [*range(32, 127)] * 400 + [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    _same(machine, library, ["".join(map(chr, rng.choices(points, k=rng.randint(0, 60)))) for _ in range(5000)])


def test_every_token_and_pair(machine, library):
    texts = [t for t in (library.decode([i]) for i in range(50_256)) if "�" not in t]
    rng = random.Random(2)
    _same(machine, library, texts + [rng.choice(texts) + rng.choice(texts) for _ in range(20_000)])


def test_chunks_and_tables_start_anew(machine, library, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("ACGT acgt'\n", k=30_000))
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "SLICE_POINTS", 1000)
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 500)
    monkeypatch.setattr(token_counts, "MAX_MATCHES", 10)
    _same(machine, library, [text, text[5:999], None, text[77:]])


def test_scan_finds_entry_states():
    cutter, rng = token_counts.Cutter(), random.Random(4)
    symbols = [token_counts.RESET, *rng.choices(range(12), k=5000)]
    state, begins = 0, [False] * len(symbols)
    for i, c in enumerate(symbols):
        state, mark = token_counts._cutting_step(state, c)
        begins[i] |= bool(mark & token_counts.HERE)
        begins[i - 1] |= bool(mark & token_counts.BEFORE)
    assert cutter.cuts(token_counts.np.array(symbols, dtype=token_counts.np.uint8)).tolist() == begins


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_token_counts"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)


def test_frames(spark):
    rows = [(1, None, "a", 5), (1, "", None, 5), (1, "two words", "b", 6), (None, "two words", None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, symbols string, n_tokens int")
    got = token_counts.with_token_counts(df, PATH)
    assert sorted(got.columns) == sorted(df.columns)
    assert sorted(r["n_tokens"] for r in got.collect()) == [0, 0, 2, 2]
    assert token_counts.with_token_counts(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.with_token_counts(df, public_tokenizers.path("word_bpe_49k.json"))
