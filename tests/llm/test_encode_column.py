"""The encoder over a whole column against the library, text by text, and the cut of its ids into files."""

import numpy as np
import pyarrow as pa
import pytest

from sitegrain.llm import wavelet, word_bpe
from sitegrain.llm.word_bpe import WordBpe, tokenizer_path

TEXTS = [
    None,
    "",
    " \t\n",
    "  one two  one\r\nTwo_3 don't ",
    "a\x0bb\x0cc\x1cd\x1ee\x85f\xa0g h　i",
    "<|endoftext|> x<|endoftext|>y <| é ß ĳ Ⅻ 漢字 🙂",
    "zqxv" * 50,
]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_encode_column_equals_library(kind):
    enc = WordBpe(tokenizer_path())
    for texts in (TEXTS, TEXTS[::-1], [], [None], TEXTS * 40):
        column = pa.array(["cut off", *texts], kind).slice(1)
        ids, sizes = enc.encode_column(column, 1)
        want = [[*enc.whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize(
    "texts",
    [
        ["x<", "|endoftext|> y", "DON'", "T 'tis", "r'", "", "re", "12", "3"],
        ["We'LL they're I'm 'sé 'é ''s 's's x'd1 rock'n'roll 'rex", "a_b--c1d2", "Éa éA ÿŸ 3×4 İi Ω< <|", None],
        ["e\u0301 H\u0331 \u0301a", "漢'd 漢", "'S", "<|ENDOFTEXT|> <|endoftext|>a"],
    ],
)
def test_words_split_as_the_library_does(texts):
    """Contractions, signs, foreign chunks and special tokens, also where one text's end and the next one's start would make one."""
    enc = WordBpe(tokenizer_path())
    ids, sizes = enc.encode_column(pa.array(texts), 1)
    want = [[*enc.whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_words_met_lately_stay_known(monkeypatch):
    """A full table of words gives way to a new one; a word that is still in use is not encoded again."""
    monkeypatch.setattr(word_bpe, "CACHE_ENTRIES", 4)
    enc, asked = WordBpe(tokenizer_path()), []

    class Bulk:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(w for t in texts for w in t.split("\n"))
            return bulk.encode_batch_fast(texts, **kw)

    bulk, enc.bulk = enc.bulk, Bulk()
    for text in ("aa bb cc dd ee ff", "bb, aa! gg", "Aa hh ii jj kk ll", "aa ll mm"):
        ids, sizes = enc.encode_column(pa.array([text]), 1)
        assert ids.tolist() == [*enc.whole.encode(text, add_special_tokens=False).ids, 1] and sizes.tolist() == [len(ids)]
    assert sorted(asked) == sorted(["!", ",", *(2 * c for c in "abcdefghijklm")])


def test_files_hold_whole_documents(spark, tmp_path):
    """A file is closed after the document that fills it."""
    words = [1_500_000, 600_000, 3, 0, 2_500_000, 7]
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(words)], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        files = wavelet.write_shards(docs, f"file://{tmp_path}/tokens")
        rows = sorted(map(tuple, files.select("part", "docs", "tokens").collect()))
        got = sorted(map(tuple, wavelet.read_documents(files).select("doc_id", "start", "n_tokens").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = [n + 1 for n in words]
    assert wavelet.FILE_TOKENS == 2_000_000
    assert rows == [(0, 2, sum(sizes[:2])), (1, 3, sum(sizes[2:5])), (2, 1, sizes[5])]
    assert got == [(i, int(sum(sizes[:i])), n) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("n", [1, 8, 9, wavelet.BLOCK_BITS - 1, wavelet.BLOCK_BITS, wavelet.BLOCK_BITS + 1, 2 * wavelet.BLOCK_BITS + 9])
def test_last_block_of_a_plane(n):
    """Blocks are inflated to their own size: the last one of a plane is shorter."""
    tokens = np.random.default_rng(n).integers(0, 49408, n).astype("<u2")
    raw = wavelet.to_bytes([5], [n], tokens)
    assert wavelet.from_bytes(raw)[2].tokens().tolist() == tokens.tolist()
    matrix = wavelet.from_bytes(raw)[2]
    assert all(matrix.access(i) == tokens[i] and matrix.select(int(tokens[i]), matrix.rank(int(tokens[i]), i)) == i for i in {0, n // 2, n - 1})
