"""Fast, exact ids of the public word-level BPE, for use inside Python workers.

The tokenizers library does the merging; this module only keeps the ids of
words it has met (``encode``: of white-space chunks too), within a bound on
entries, and hands the rest to the library in bulk. A chunk outside plain Latin
letters, or one that could hold a special token, goes to the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import resident

#: Entries kept per worker in each table, of which a worker fills two (about 200 bytes an entry).
CACHE_ENTRIES = 600_000
END_ID = 49407

#: The word pattern of the vocabulary file, for Latin text.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_WORDS_OR_END = re.compile(_WORDS.pattern + r"|\n")
#: Eight bytes of ids beyond any vocabulary.
_MARK = b"\xff" * 8
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: White space for Python's split, but not for the vocabulary's pattern.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _chunks(text: str) -> list[str]:
    return re.split(r"[ \t\n\r]+", text) if any(c in text for c in _SEPARATORS) else text.split()


#: What a byte of UTF-8 is in the vocabulary's pattern. Whatever is not white space, plain Latin letters, digits or signs is foreign.
_WHITE, _LETTER, _DIGIT, _SIGN, _FOREIGN = range(5)
_KIND = bytearray([_FOREIGN]) * 256
for _kind, _those in {
    _SIGN: range(0x21, 0x7F),
    _DIGIT: b"0123456789",
    _LETTER: [*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5],  # with the letters of two bytes
    _WHITE: b" \t\n\v\f\r",
}.items():
    for _byte in _those:
        _KIND[_byte] = _kind
_LOWER = bytes(range(256)).lower()
#: Two bytes each that look like letters, but aren't plain ones: multiplication and division signs and the dotted capital I.
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
_PLAIN_WORD = re.compile("[!-~À-ÖØ-öø-įı-ſ]*")


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has.

    A to Z come in lower case. A chunk between white space that has foreign
    bytes, or may hold a special token, is one word, as it is written.
    """
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = bytes(memoryview(texts.buffers()[2])[at[0] : at[-1]]) if at[-1] > at[0] else b""
    if not raw:
        return pa.array([], pa.string()), np.zeros(len(at) - 1, np.int64)
    at -= at[0]
    low, kinds = (np.frombuffer(raw.translate(bytes(t)), np.uint8) for t in (_LOWER, _KIND))
    filled, edge = kinds != _WHITE, np.zeros(len(raw) + 4, bool)  # edge: a word, white space or a text begins here; the rest is room to look ahead
    rows = edge.copy()
    rows[at] = True
    edge[1 : len(raw)] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
    edge |= rows
    edge[[0, len(raw)]] = True

    quote = np.flatnonzero(low == ord("'"))  # 's 't 'm 'd 're 've 'll are words, where no sign stands before them
    quote = quote[edge[quote] & ~rows[quote + 1]]
    if len(quote):
        a, b = (np.append(low, [0, 0, 0])[quote + i] for i in (1, 2))
        short = np.isin(a, list(b"stmd"))
        long = ((((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & ~rows[quote + 2]
        edge[quote[short | long] + 1] = False
        edge[quote[short] + 2] = True
        edge[quote[long] + 3] = True

    own = np.frombuffer(raw, np.uint8)
    foreign = [np.flatnonzero(kinds == _FOREIGN)]
    pairs = [(ord("<"), ord("|")), *(_NO_LETTERS if not raw.isascii() else ())]
    foreign += [np.flatnonzero((own[:-1] == a) & (own[1:] == b) & ~rows[1 : len(raw)]) for a, b in pairs]
    if len(foreign := np.concatenate(foreign)):
        begins = np.flatnonzero(filled & (rows[: len(raw)] | ~np.append(False, filled[:-1])))
        stops = np.flatnonzero(np.append(~filled | rows[: len(raw)], True))
        begins = begins[np.unique(np.searchsorted(begins, foreign, side="right")) - 1]
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[begins] = 1
        np.subtract.at(inside, stops[np.searchsorted(stops, begins, side="right")], 1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        edge[: len(raw)] &= ~inside
        edge[begins] = True
        low = np.where(inside, own, low)

    starts = np.flatnonzero(edge[: len(raw)] & filled)
    sizes = np.flatnonzero(edge[1 : len(raw) + 1] & filled) + 1 - starts
    places = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(low[filled])).cast(pa.string())
    return words, np.diff(np.searchsorted(starts, at))


class WordBpe:
    """``encode(texts)`` → one bytes object a text: its ids as little-endian uint16."""

    def __init__(self, path: str, ordinary: bool = False) -> None:
        """ordinary: the strings of special tokens are ordinary text."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = ordinary
        self.bulk = Tokenizer.from_file(path)
        self.bulk.normalizer = normalizers.Sequence([])
        self.bulk.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids_of_words(self, joined: str, n: int) -> list[bytes]:
        """The ids of each of ``n`` lower-case words, joined by line feeds."""
        ids = np.array(self.bulk.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
        stops = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != n:
            raise RuntimeError("word ends don't match the words")
        raw = ids.tobytes()
        return [raw[a:z] for a, z in zip([0, *stops], stops)]

    def _learn_words(self, words: list[str]) -> None:
        self.words.update(zip(words, self._ids_of_words("\n".join(words), len(words))))

    def _learn(self, chunks: list[str]) -> None:
        known = self.words
        joined = "\n".join(chunks)
        if not _PLAIN.fullmatch(joined) or "<|" in joined or any(x in joined for x in _SEPARATORS):
            plain = []
            for c in chunks:
                if _PLAIN.fullmatch(c) and "<|" not in c and not any(x in c for x in _SEPARATORS):
                    plain.append(c)
                else:
                    self.chunks[c] = np.array(self.whole.encode(c, add_special_tokens=False).ids, "<u2").tobytes()
            chunks, joined = plain, "\n".join(plain)
        if len(known) > CACHE_ENTRIES:
            known.clear()
        words = _WORDS_OR_END.findall(joined.lower())
        new = list(set(words).difference(known, "\n"))
        for at in range(0, len(new), 4096):
            self._learn_words(new[at : at + 4096])
        known["\n"] = _MARK  # splits the ids of all chunks at once
        raws = b"".join(map(known.__getitem__, words)).split(_MARK) if len(chunks) > 1 else []
        if len(raws) == len(chunks):
            self.chunks.update(zip(chunks, raws))
        else:  # one chunk, or ids that happen to hold the mark
            for c in chunks:
                self.chunks[c] = b"".join([known[w] for w in _WORDS.findall(c.lower())])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, chunks = [], self.chunks
        for at in range(0, len(texts), 32):
            split = [_chunks(t or "") for t in texts[at : at + 32]]
            if len(chunks) > CACHE_ENTRIES:
                chunks.clear()
            if new := set().union(*split).difference(chunks):
                self._learn(list(new))
            get = chunks.__getitem__
            out += [b"".join(map(get, s)) for s in split]
        return out

    def _met(self, words: list[str]) -> list[bytes]:
        """The ids of words as ``_words_of`` gives them; words met lately stay in one of two tables."""
        if len(self.lately) > CACHE_ENTRIES:
            self.before, self.lately = self.lately, {}
        raws = list(map(self.lately.get, words))
        if missing := [i for i, raw in enumerate(raws) if raw is None]:
            new, plain = {}, []
            for i in missing:
                w = words[i]
                if (raw := self.before.get(w)) is not None:
                    new[w] = raw
                elif w.isalpha() and w.isascii() or _PLAIN_WORD.fullmatch(w) and "<|" not in w:
                    plain.append(w)
                else:
                    new[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u2").tobytes()
            for at in range(0, len(plain), 4096):
                some = plain[at : at + 4096]
                new.update(zip(some, self._ids_of_words("\n".join(some).lower(), len(some))))
            for i in missing:
                raws[i] = new[words[i]]
            self.lately.update(new)
        return raws

    def encode_column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by ``end``, and how many each has; equal words are looked up once."""
        words, counts = _words_of(texts)
        coded = words.dictionary_encode()
        kinds = coded.dictionary
        one = pa.ListArray.from_arrays(pa.array([0, len(kinds)], pa.int32()), kinds)
        raws = self._met(pc.binary_join(one, "\n")[0].as_py().split("\n") if len(kinds) else [])
        held = pa.array([*raws, np.array([end], "<u2").tobytes()], pa.large_binary())
        stops = np.cumsum(counts)
        taken = held.take(pa.array(np.insert(coded.indices.to_numpy(), stops, len(kinds))))
        places = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 2
        ids = np.frombuffer(taken.buffers()[2], "<u2")[: places[-1]] if len(taken) else np.zeros(0, "<u2")
        return ids, np.diff(places[stops + np.arange(1, len(stops) + 1)], prepend=0)


def encoder(path: str) -> WordBpe:
    """The worker's encoder; it lives as long as no other operator's model takes its place."""
    return resident(("word_bpe", path, False), lambda: WordBpe(path))


def ordinary_encoder(path: str) -> WordBpe:
    """As ``encoder``, with no special tokens: the end id never comes from a text."""
    return resident(("word_bpe", path, True), lambda: WordBpe(path, ordinary=True))
