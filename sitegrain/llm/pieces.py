"""Operator 2 — SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text holds an edge for every piece of the vocabulary that
matches at a position (and byte pieces for a character without a piece); an
edge's weight is the piece's score in the model file. A forward Viterbi pass
gives the best score of reaching each position; used as the heuristic of a
backward A-star search it is exact, so complete segmentations leave the queue
in order of score, and the first N are the N best.

No piece has a space mark after another character (nor, in the public file,
letters beside digits or punctuation), so the lattice of a text is a chain of
small lattices. Their best paths and gaps to the second
best are computed in bulk and kept. Only the N - 1 segments with the smallest gaps can
differ among a text's N best: the search runs over those, with the rest of the
chain fixed at its best, which changes no result.

Ties go to the longer last piece, then to the earlier find. Defined results: a
null text counts as empty and has one segmentation, of no pieces; decoding
replaces bytes that are no UTF-8 by U+FFFD; the space mark U+2581 stands for a
space, so a text that holds it literally decodes to spaces in its place.
Repeated rows are encoded each; an empty table gives an empty result; a very
long text costs memory in proportion to its length and is never cut. Only the
id and text columns are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import resident, table, text_batches

SPACE = "▁"
N_BEST = 4
#: A character without a piece weighs so much less than the least single-character piece, as unknowns do in unigram models.
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS = 800_000
#: Segments up to this length are learned in bulk, so many at a time; the few longer ones one by one.
BULK_LENGTHS, BULK_SEGMENTS = (8, 16, 32), 4096
#: Segments between which a vocabulary can have no piece, and between words and punctuation where it has none either.
_COARSE = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_FINE = re.compile(rf"{SPACE}*(?:[^\W\d_²]+|\d+|(?:[^{SPACE}\w]|[_²])+)|{SPACE}+")


def _kind(c: str) -> str:
    return "space" if c == SPACE else "letter" if re.fullmatch(r"[^\W\d_²]", c) else "digit" if re.fullmatch(r"\d", c) else "other"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


Path = tuple[float, tuple[int, ...]]


class PieceLattice:
    """A model's pieces and the search over their lattices."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.pieces = {self.text[i]: (i, sp.get_score(i)) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.bytes_of = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_ids = {i: b for b, i in self.bytes_of.items()}
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.floor = min((s for p, (_, s) in self.pieces.items() if len(p) == 1), default=0.0) - UNKNOWN_PENALTY
        self.starts = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        pairs = {(_kind(a), _kind(b)) for p in self.pieces for a, b in zip(p, p[1:]) if _kind(a) != _kind(b)}
        if any(b == "space" for _, b in pairs):
            raise ValueError("a piece has a space mark after another character")
        self.segment = _FINE if all(a == "space" for a, _ in pairs) else _COARSE
        self.as_bytes = [self.text[i].replace(SPACE, " ").encode() for i in range(size)]
        for i in range(size):
            if i in self.byte_ids:
                self.as_bytes[i] = bytes([self.byte_ids[i]])
            elif i in self.silent:
                self.as_bytes[i] = b""
        self.as_bytes[self.unknown] = " ⁇ ".encode()
        self._trie()
        self._clear()

    def _trie(self) -> None:
        """The pieces' prefixes as arrays: children by (node, character), and the piece and score that end at a node."""
        node = {"": 0} | {p: i for i, p in enumerate(sorted(self.starts), 1)}
        steps = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in node if p], np.int64)
        order = np.argsort(steps)
        self.steps, self.child = steps[order], np.array([i for p, i in node.items() if p], np.int32)[order]
        self.ends = np.full(len(node), -1, np.int32)
        self.weights = np.full(len(node), -np.inf)
        for p, (i, score) in self.pieces.items():
            self.ends[node[p]], self.weights[node[p]] = i, score

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.raws: list[bytes] = []
        self.totals = np.zeros(1 << 14)
        self.gaps = np.zeros(1 << 14)

    def _learn(self, segments: list[str]) -> None:
        """Best path, its score and the gap to the second best of segments that aren't known yet."""
        segments = sorted(segments, key=len)
        bounds = np.searchsorted(np.fromiter(map(len, segments), np.int64, len(segments)), BULK_LENGTHS, side="right").tolist()
        for at, stop, longest in zip([0, *bounds], bounds, BULK_LENGTHS):
            for a in range(at, stop, BULK_SEGMENTS):
                self._keep(*self._best_in_bulk(segments[a : min(stop, a + BULK_SEGMENTS)], longest))
        for s in segments[bounds[-1] :]:
            total, raw, gap = self.best(s)
            self._keep([s], [raw], [total], [gap])

    def _keep(self, segments: list[str], raws: list[bytes], totals, gaps) -> None:
        n = len(self.raws)
        while n + len(segments) > len(self.totals):
            self.totals, self.gaps = (np.concatenate([x, np.zeros(len(x))]) for x in (self.totals, self.gaps))
        self.known.update(zip(segments, range(n, n + len(segments))))
        self.raws += raws
        self.totals[n : n + len(segments)], self.gaps[n : n + len(segments)] = totals, gaps

    def _best_in_bulk(self, segments: list[str], width: int) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
        """``best`` of many segments of at most ``width`` characters: the same passes, a position of all of them at a time."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        row = np.repeat(np.arange(len(segments)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[row] - place
        # scores and ids of the pieces of length k that end at z, over all segments
        most = min(width, self.longest)
        score = np.full((most + 1, width + 1, len(segments)), -np.inf)
        piece = np.full((most + 1, width + 1, len(segments)), -1, np.int32)
        lone = np.zeros(len(codes), bool)  # characters that are pieces themselves
        start, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k in range(1, most + 1):
            go = left[start] >= k
            start, node = start[go], node[go]
            wanted = node << 21 | codes[start + k - 1]
            at = np.minimum(np.searchsorted(self.steps, wanted), len(self.steps) - 1)
            go = self.steps[at] == wanted
            start, node = start[go], self.child[at[go]].astype(np.int64)
            if not len(start):
                break
            full = self.ends[node] >= 0
            s, e = start[full], node[full]
            score[k, place[s] + k, row[s]] = self.weights[e]
            piece[k, place[s] + k, row[s]] = self.ends[e]
            if k == 1:
                lone[s] = True
        odd = np.zeros(len(segments), bool)
        odd[row[~lone]] = True
        # forwards
        every = np.arange(len(segments))
        best = np.full((width + 1, len(segments)), -np.inf)
        back = np.zeros((width + 1, len(segments)), np.int32)
        best[0] = 0.0
        for z in range(1, width + 1):
            for k in range(min(z, most), 0, -1):
                through = best[z - k] + score[k, z]
                better = through > best[z]
                best[z][better] = through[better]
                back[z][better] = k
        # the best paths, from their ends
        on = np.zeros(score.shape, bool)
        ids = np.full((len(segments), width), -1, np.int32)
        z = np.where(odd, 0, sizes)
        for step in range(width):
            alive = np.flatnonzero(z)
            if not len(alive):
                break
            k = back[z[alive], alive]
            on[k, z[alive], alive] = True
            ids[alive, width - 1 - step] = piece[k, z[alive], alive]
            z[alive] -= k
        # backwards: the best path through each edge that is off the best path
        after = np.full((width + 1, len(segments)), -np.inf)
        after[sizes, every] = 0.0
        second = np.full(len(segments), -np.inf)
        for end in range(width, 0, -1):
            for k in range(1, min(end, most) + 1):
                rest = after[end] + score[k, end]
                np.maximum(after[end - k], rest, out=after[end - k])
                np.maximum(second, np.where(on[k, end], -np.inf, best[end - k] + score[k, end] + after[end]), out=second)
        totals = best[sizes, every]
        flat, stops = ids[ids >= 0].astype("<u2").tobytes(), (2 * np.cumsum((ids >= 0).sum(1))).tolist()
        raws = [flat[a:b] for a, b in zip([0, *stops], stops)]
        with np.errstate(invalid="ignore"):
            gaps = totals - second
        for i in np.flatnonzero(odd).tolist():  # a character without a piece: one by one
            totals[i], raws[i], gaps[i] = self.best(segments[i])
        return segments, raws, totals, gaps

    def edges(self, segment: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end position: (start, ids, score) of the pieces that end there, longest first."""
        n = len(segment)
        into: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        get, starts = self.pieces.get, self.starts
        for a in range(n):
            single = False
            for z in range(a + 1, min(n, a + self.longest) + 1):
                part = segment[a:z]
                if part not in starts:
                    break
                if found := get(part):
                    into[z].append((a, (found[0],), found[1]))
                    single |= z == a + 1
            if not single:
                raw = segment[a].encode("utf-8", "surrogatepass")
                ids = tuple(self.bytes_of[b] for b in raw) if self.bytes_of else (self.unknown,)
                into[a + 1].append((a, ids, self.floor))
        return into

    @staticmethod
    def forward(into: list) -> tuple[list[float], list[tuple[int, tuple[int, ...]]]]:
        """Viterbi: best score to each position, and the edge it came by."""
        best, back = [0.0] * len(into), [(0, ())] * len(into)
        for z in range(1, len(into)):
            top = -np.inf
            for a, ids, s in into[z]:
                if best[a] + s > top:
                    top, back[z] = best[a] + s, (a, ids)
            best[z] = top
        return best, back

    def best(self, segment: str) -> tuple[float, bytes, float]:
        """Best score, its ids (uint16), and how much less the second best scores."""
        into = self.edges(segment)
        best, back = self.forward(into)
        ids: list[int] = []
        on, z = set(), len(segment)
        while z:
            a, part = back[z]
            ids[:0] = part
            on.add((a, z, part))
            z = a
        # the best path through an edge, forwards and backwards; off the best path the largest is the second best
        n = len(segment)
        after = [-np.inf] * n + [0.0]
        second = -np.inf
        for z in range(n, 0, -1):
            rest = after[z]
            for a, part, s in into[z]:
                if rest + s > after[a]:
                    after[a] = rest + s
                if (a, z, part) not in on:
                    second = max(second, best[a] + s + rest)
        return best[n], np.array(ids, "<u2").tobytes(), best[n] - second

    def a_star(self, chain: list[str], n: int) -> list[tuple[float, list[tuple[int, ...]]]]:
        """The n best segmentations of a chain of segments, best first: (score, ids by segment)."""
        lattices = [self.edges(s) for s in chain]
        forwards = [self.forward(x)[0] for x in lattices]
        before = np.concatenate([[0.0], np.cumsum([f[-1] for f in forwards])]).tolist()  # best score up to each segment
        count, out = 0, []
        # entries: (-(best score of a whole path through here), order, segment, position, score behind, ids found so far)
        queue = [(-before[-1], 0, len(chain) - 1, len(chain[-1]) if chain else 0, 0.0, ((),) * len(chain))]
        while queue and len(out) < n:
            f, _, k, z, behind, ids = heapq.heappop(queue)
            while k >= 0 and z == 0:
                k -= 1
                z = len(chain[k]) if k >= 0 else 0
            if k < 0:
                out.append((-f, list(ids)))
                continue
            for a, part, s in lattices[k][z]:
                count += 1
                score = behind + s
                through = before[k] + forwards[k][a] + score
                heapq.heappush(queue, (-through, count, k, a, score, (*ids[:k], part + ids[k], *ids[k + 1 :])))
        return out

    def n_best(self, text: str | None, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """Up to n segmentations, best first: (score, ids)."""
        return self.n_best_of([text], n)[0]

    def n_best_of(self, texts: list[str | None], n: int = N_BEST) -> list[list[tuple[float, np.ndarray]]]:
        """``n_best`` of several texts, whose new segments are learned together."""
        split = [self.segment.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > CACHE_SEGMENTS:
            self._clear()
        if new := set().union(*split).difference(self.known):
            self._learn(list(new))
        return [self._n_best(segments, n) for segments in split]

    def _n_best(self, segments: list[str], n: int) -> list[tuple[float, np.ndarray]]:
        if not segments:
            return [(0.0, np.zeros(0, "<u2"))]
        at = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
        totals, gaps = self.totals[at], self.gaps[at]
        few = min(n - 1, len(at))
        near = np.sort(np.argpartition(gaps, few - 1)[:few]).tolist() if few else []
        base = float(totals.sum() - totals[near].sum())
        raws = list(map(self.raws.__getitem__, at.tolist()))
        out = []
        for score, parts in self.a_star([segments[i] for i in near], n):
            for i, ids in zip(near, parts):
                raws[i] = np.array(ids, "<u2").tobytes()
            out.append((base + score, np.frombuffer(b"".join(raws), "<u2")))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.n_best(text, 1)[0][1]

    def decode(self, ids) -> str:
        """The text of a sequence of ids; the mark before the first word is dropped."""
        raw = b"".join(map(self.as_bytes.__getitem__, np.asarray(ids, np.int64).tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def lattice(path: str) -> PieceLattice:
    """The worker's model; it lives as long as no other operator's takes its place."""
    return resident(("pieces", path), lambda: PieceLattice(path))


def encode_n_best(docs: DataFrame, n: int = N_BEST, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, rank, score, ids)``: the n best segmentations of every text, rank from 0."""
    path, kind = model or model_path(), docs.schema[id_col].dataType.simpleString()

    def make(rows):
        for i, text, segmentations in rows:
            for rank, (score, ids) in enumerate(segmentations):
                yield i, rank, score, ids.astype(np.int32)

    return _run(docs, path, n, id_col, text_col, make, f"id {kind}, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of rows of piece ids; a null sequence is an empty text."""
    path, kind = model or model_path(), encoded.schema[id_col].dataType.simpleString()
    text_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(path)
        for b in batches:
            texts = [m.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string")


def _run(docs: DataFrame, path: str, n: int, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    text_batches(docs.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(path)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 32):
                part = texts[at : at + 32]
                columns = list(zip(*make(zip(ids[at : at + 32], part, m.n_best_of(part, n)))))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types)], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    """Of every document: pieces and checksum of the best segmentation, the N best scores, and whether it decodes to its text."""
    path = model_path()

    def digest(rows):
        m = lattice(path)
        for i, text, found in rows:
            best = found[0][1]
            whole = m.decode(best) == (text or "")
            yield (
                i, len(best), zlib.crc32(best.astype("<u4").tobytes()), len(found), [s for s, _ in found],
                [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found], whole,
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces bigint, ids_crc32 bigint, n_best int, scores array<double>, crcs array<bigint>, decodes boolean"
    return _run(docs, path, N_BEST, "doc_id", "text", digest, schema)
