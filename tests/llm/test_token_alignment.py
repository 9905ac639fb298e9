"""Token alignment against a brute-force version."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from threadlens.llm import queries, token_alignment
from threadlens.llm.token_counts import byte_alphabet

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Brute:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def b_bytes(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[1:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return []
        ends = [{sum(map(len, side[:k + 1])): k + 1 for k in range(len(side))} for side in (a_bytes, b_bytes)]
        out, i, j = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            out.append((a[i:ends[0][end]], b[j:ends[1][end]]))
            i, j = ends[0][end], ends[1][end]
        return out

    def row(self, text):
        groups = self.groups(text)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        times = Counter((i, j) for x, y in groups for i in x for j in y)
        sizes = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(times.values()))
        return *sizes, hashlib.sha256(said.encode()).hexdigest() if groups else "", times

    def table(self, texts):
        rows = [self.row(t) for t in texts]
        held = Counter(p for r in rows for p in r[5])
        most = {}
        for (i, _), n in held.items():
            most[i] = max(n, most.get(i, 0))
        return [
            (*r[:4], sum(n for p, n in r[5].items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in r[5].items()), r[4])
            for r in rows]


@pytest.fixture(scope="module")
def brute():
    return Brute()


@pytest.fixture(scope="module")
def aligner():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return token_alignment.Aligner(f.read(), g.read())


def _same(aligner, brute, texts):
    got = aligner.align_texts(pa.array(texts, pa.string())).to_pylist()
    for text, g in zip(texts, got, strict=True):
        times = {(p >> 20, p & (1 << 20) - 1): n for p, n in zip(g["pairs"], g["times"])}
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["groups_sha256"], times) == brute.row(text), text


def test_edges(aligner, brute):
    _same(aligner, brute, [
        None, "", " ", "  ", "a", " a", "a ", "a  ", " a  b ", "\n \n", "\0\0a", "▁", "x ▁▁b y", "<s> <|endoftext|>", "<0x0A>\n",
        "a" * 500, " " * 300 + "x", "-" * 700, "日本語のテキスト" * 30, "fine words only"])
    assert len(aligner.align_texts(pa.array([], pa.string()))) == 0


def test_random_texts(aligner, brute, monkeypatch):
    monkeypatch.setattr(token_alignment, "ALIGN_BYTES", 2000)
    monkeypatch.setattr(token_alignment, "CUT_BYTES", 9000)
    monkeypatch.setattr(token_alignment, "PIECES", 100)
    monkeypatch.setattr(token_alignment, "MANY_LINKS", 3)
    rng = random.Random(1)
    alphabet = [*"   \n\t　 '''stmdrvle reZq9٣é中😀!<|>▁", "<|endoftext|>", "<s>", "  ", "don't", "<0x0A>", "hello", "the quick"]
    _same(aligner, brute, ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)])


@pytest.mark.parametrize("hot", [1 << 18, 40])
def test_query(spark, brute, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", hot)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_token_alignment"](spark, SF).collect()}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(got[i][c] for c in names) for i in docs] == brute.table(docs.values())


def test_frames(spark, brute):
    texts = [None, "", "two words", "two words", "x ▁", "other words"]
    rows = [(None if i % 2 else 7, t, i, "k", "r", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, found int, key string, row string, n_best int")
    got = token_alignment.with_alignment(df, A, B)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert set(got.columns) == set(df.columns) | set(names)
    assert [tuple(r[c] for c in names) for r in got.orderBy("found").collect()] == brute.table(texts)
    assert token_alignment.with_alignment(df.limit(0), A, B).count() == 0
