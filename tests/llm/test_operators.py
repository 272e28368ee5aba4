"""Corpus operators against brute force, round trips and held-out accuracy, with nulls, empties, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sitegrain.llm import langid, near_copies, packing, pieces, quality, sharding, simhash, syncmers, token_counts, toxicity, wavelet
from pyspark.sql import functions as F

from sitegrain.llm.common import shared_dir
from sitegrain.llm.queries import QUERIES
from sitegrain.llm.word_bpe import WordBpe, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30_000 + "end"
TEXTS = [
    "The cat sat on the mat.", "the cat sat on the mat.", None, "", "   \n\t ", "one", "one two", LONG, LONG, "tête-à-tête Ünïcode ÇA va?",
    "日本語のテキスト", "a b c a b c a b c", "x\x1cy \x85z it's 'quoted' <|endoftext|> ! \" end", "The cat sat on the mat.",
]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, t, "en" if t else None, "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = Counter(i for g in grams for i in range(64) if xxhash.xxh64_intdigest(g, 42) >> i & 1)
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(grams))


def _components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in fps}


def test_simhash_brute_force(spark, small, documents, empty):
    for docs in (small, documents):
        expected = {r.doc_id: _fingerprint(r.text if len(r.text or "") < 10**5 else r.text) for r in docs.collect()}
        got = {r.id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicate_components(docs).collect()}
        assert {i: f for i, (f, _) in got.items()} == expected
        assert {i: c for i, (_, c) in got.items()} == _components(expected)
    assert simhash.near_duplicate_components(empty).count() == 0


def test_linked_pairs_lose_nothing(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = {0, 2**64 - 1, *base}
    for b in base:
        for n in (1, 2, 3, 4):
            x = b
            for bit in rnd.sample(range(64), n):
                x ^= 1 << bit
            fps.add(x)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    pairs = {tuple(r) for r in simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()}
    brute = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert pairs == brute
    finer = {tuple(r) for r in simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint"), finer=True).collect()}
    assert finer == brute


def test_keep_one(small):
    kept = simhash.keep_one(small)
    groups = _components({i: _fingerprint(t) for i, t in enumerate(TEXTS)})
    assert kept.columns == small.columns
    assert {r.doc_id for r in kept.collect()} == set(groups.values())


def test_pieces_n_best_brute_force():
    model = pieces.PieceLattice(pieces.model_path())

    def brute(text, n):
        into, found = model.edges(pieces.SPACE + text.replace(" ", pieces.SPACE)), []

        def back(z, score, ids):
            if z == 0:
                found.append((score, ids))
                return
            for a, part, s in into[z]:
                back(a, score + s, part + ids)

        back(len(into) - 1, 0.0, ())
        return sorted(found, key=lambda f: -f[0])[:n]

    rnd = random.Random(1)
    for _ in range(40):
        text = "".join(rnd.choice(["the", "in", " ", "é", "ab", "  ", "ñ", "日", "\n", "st", "1", "²", "_"]) for _ in range(rnd.randint(1, 6)))[:10]
        ours, all_ = model.n_best(text, 4), brute(text, 4)
        assert np.allclose([s for s, _ in ours], [s for s, _ in all_])
        assert len({tuple(i.tolist()) for _, i in ours}) == len(ours)
        assert all(model.decode(ids) == text for _, ids in ours)


def test_pieces_round_trip(small, empty):
    coded = pieces.encode_n_best(small, 2)
    texts = {r.id: r.text for r in pieces.decode(coded.where("rank = 0").select("id", "ids")).collect()}
    assert texts == {i: t or "" for i, t in enumerate(TEXTS)}
    assert pieces.encode_n_best(empty).count() == 0


def _exact_bins(items, capacity):
    best, items = len(items), sorted(items, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k, b in enumerate(bins):
            if b + items[i] <= capacity and b not in bins[:k]:
                go(i + 1, [*bins[:k], b + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_packing_plan_is_optimal_on_small_cases():
    rnd = random.Random(3)
    for _ in range(100):
        capacity = rnd.choice([10, 20, 50])
        items = [rnd.randint(1, capacity if rnd.random() < 0.5 else capacity // 2) for _ in range(rnd.randint(0, 9))]
        plan = packing.plan(dict(Counter(items)), capacity)
        assert sum(m for m, _ in plan) == _exact_bins(items, capacity)
        assert Counter({s: n for s, n in sum((Counter({s: m * c for s, c in f.items()}) for m, f in plan), Counter()).items()}) == Counter(items)


def _ids(text, end):
    from tokenizers import Tokenizer

    _ids.t = getattr(_ids, "t", None) or Tokenizer.from_file(tokenizer_path())
    return np.array([*_ids.t.encode(text or "", add_special_tokens=False).ids, *end], "<u4")


def test_word_bpe_equals_the_library():
    texts = [t if len(t or "") < 1000 else t[:1000] for t in TEXTS]
    assert [np.frombuffer(x, "<u2").tolist() for x in WordBpe(tokenizer_path()).encode(texts)] == [_ids(t, []).tolist() for t in texts]


def test_packing(small, empty):
    rows = packing.pack(small, 512).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, {})[r.piece] = r
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        ids = _ids(t, [0])
        cut = [ids[a : a + 512] for a in range(0, len(ids), 512)]
        assert [(by_doc[i][k].start, by_doc[i][k].length, by_doc[i][k].ids_crc32) for k in range(len(cut))] == [
            (512 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)
        ]
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(empty).count() == 0


def test_sharding(spark, small, documents, empty):
    for docs, shards in ((documents, 24), (small, 3), (documents.union(documents), 5)):
        rows = sharding.shard_by_bytes(docs, shards).collect()
        assert Counter(r.id for r in rows) == Counter(r.doc_id for r in docs.collect())
        for s in range(shards):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(shards)]
        assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_splits_a_hot_group(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id bigint, text string")
    sizes = Counter()
    for r in sharding.shard_by_bytes(docs, 8).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_token_counts(small, empty, spark):
    files, manifest = token_counts.write_flat_files(small, f"{shared_dir(spark)}/flat")
    counts = token_counts.document_counts(files, block_tokens=8192)
    got = {r.doc_id: r.n_tokens for r in token_counts.of_documents(counts, manifest).collect()}
    plain = WordBpe(tokenizer_path(), ordinary=True)
    assert got == {i: len(x) // 2 for i, x in enumerate(plain.encode(TEXTS))}
    assert all(r["tail"] == 0 for r in token_counts.tails(files, counts).collect())
    files, _ = token_counts.write_flat_files(empty, f"{shared_dir(spark)}/flat")
    assert token_counts.document_counts(files).count() == 0


def _statistics(text):
    text = text or ""
    words, at = re.findall(r"[^\x20\x09-\x0D]+", text), {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_statistics(small, documents):
    for docs in (small, documents):
        stats = quality.with_statistics(docs)
        rows = stats.select("doc_id", "text", *(stats[quality.AS + c].alias(c) for c in quality.BASE)).collect()
        assert all(tuple(r)[2:] == _statistics(r.text) for r in rows)


def test_quality_learns_and_keeps(spark, small, labels, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(docs, marks).join(marks, "doc_id").where("not _sg_base_failed").select("quality", "_sg_kept").collect()
    assert sum((r.quality == 1) == r._sg_kept for r in rows) >= 0.97 * len(rows)
    none = quality.judged(small, marks.limit(0))
    assert [r.doc_id for r in none.where("_sg_kept <> (not _sg_base_failed)").collect()] == []
    assert quality.judged(empty, labels).count() == 0


def test_quality_learner():
    rnd = random.Random(0)
    rows = []
    for i in range(600):
        row = {f: rnd.random() for f in quality.FEATURES}
        rows.append(row | {"bad": int(row["upper_share"] > 0.6 and row["n_words"] <= 0.7), "fold": i % 3})
    rules = quality.learn(rows)
    caught = sum(any(all(c.holds(r) for c in rule) for rule in rules) == bool(r["bad"]) for r in rows)
    assert caught >= 0.9 * len(rows)
    assert not any(all(c.holds(r) for c in rule) for rule in rules for r in rows if r["upper_share"] < 0.5)
    assert quality.learn([]) == []


def test_wavelet_matrix():
    tokens = np.random.default_rng(0).integers(0, 49408, 3000).astype("<u2")
    tokens[::7] = 5
    ids, lengths, matrix = wavelet.from_bytes(wavelet.to_bytes([None, 3, 9], [1000, 0, 2000], tokens))
    assert ids == [None, 3, 9] and lengths.tolist() == [1000, 0, 2000] and (matrix.tokens() == tokens).all()
    where = np.flatnonzero(tokens == 5)
    assert [matrix.select(5, k) for k in range(len(where))] == where.tolist()
    assert matrix.rank(5, 777) == (tokens[:777] == 5).sum() and matrix.rank(60000) == 0
    assert all(matrix.access(i) == tokens[i] for i in range(0, 3000, 41))
    assert wavelet.from_bytes(wavelet.to_bytes([], [], np.zeros(0, "<u2")))[2].rank(1) == 0


def test_token_files(spark, small, empty):
    rows = wavelet.read_documents(wavelet.write_shards(small, f"{shared_dir(spark)}/wm")).collect()
    start = 0
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), TEXTS):
        ids = _ids(t, [1])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.read_documents(wavelet.write_shards(empty, f"{shared_dir(spark)}/wm")).count() == 0


def _hash(value, seed=42):
    """Spark's xxhash64 of a string or a signed long, as a signed long."""
    raw = value.encode() if isinstance(value, str) else int(value).to_bytes(8, "little", signed=True)
    return int(np.uint64(xxhash.xxh64_intdigest(raw, seed % 2**64)).view(np.int64))


def _hash_all(values):
    h = 42
    for v in values:
        h = _hash(v, h)
    return h


def _anchors(text):
    """Closed syncmers (hash, position) by the definition."""
    alone = "\u3040-\u30ff\u4e00-\u9fff"
    h = [_hash(t) for t in re.findall(rf"[{alone}]|[^ \t\n\x0B\f\r{alone}]{{1,32}}", text)]
    if len(h) < 5:
        return [(_hash(" ".join(map(str, h))), 0)] if h else []
    pairs = [_hash_all(h[i : i + 2]) for i in range(len(h) - 1)]
    out = []
    for i in range(len(h) - 4):
        inner = pairs[i : i + 4]
        if min(inner) in (inner[0], inner[3]):
            out.append((_hash_all([inner[0], inner[2], inner[3]]), i))
    return out


def _sketch(text):
    first = {}
    for h, i in _anchors(text):
        first.setdefault((h % 2**64) >> 32, i)
    return dict(sorted(first.items())[:64])


def _likeness(a, b):
    if not a and not b:
        return 1.0
    least = sorted(a.keys() | b.keys())[:64]
    return sum(x in a and x in b for x in least) / min(64, len(a.keys() | b.keys()))


def _check_syncmers(rows, table):
    """Every value of op8 by brute force; table: (doc_id, text), repeated and null ids allowed."""
    order = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), -_hash(r[1])))
    expected = []
    for i, (k, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = _sketch(t), _sketch(edited), _sketch(following)
        shifts = Counter(b[x] - a[x] for x in a.keys() & b.keys())
        aligned = max(shifts.values()) / shifts.total() if shifts else None
        text = lambda s: "".join(f"{x:08x}" for x in s)
        expected.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), _likeness(a, b), _likeness(a, c), aligned))
    assert Counter(map(tuple, rows)) == Counter(expected)


def test_syncmers_brute_force(spark, small, documents, empty, tmp_path):
    hot = [(7 if i % 3 else i, f"text {i} " * (i % 9)) for i in range(600)]
    ends = [(2**63 - 1, "a b c d e f"), (-(2**63), "g h"), (None, "n"), (None, "o p q r s t"), (0, "zero")]
    tables = {
        "small": small, "documents": documents, "one": small.limit(1), "none": empty,
        "hot": spark.createDataFrame(hot, "doc_id bigint, text string"), "ends": spark.createDataFrame(ends, "doc_id bigint, text string"),
    }
    for name, docs in tables.items():
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = syncmers.op8_syncmers(spark, f"{tmp_path}/{name}").collect()
        written = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        _check_syncmers(rows, [(r.doc_id, r.text or "") for r in written.select("doc_id", "text").collect()])


def test_syncmer_buckets_split(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 5)
    monkeypatch.setattr(syncmers, "SEGMENTS", 8)
    rows = [(i if i % 3 else 42, f"t{i}") for i in range(900)] + [(None, f"n{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    most = syncmers._bucketed(docs).groupBy("_bucket").count().agg({"count": "max"}).first()[0]
    assert most <= 40
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -_hash(r[1])))
    got = {(r.doc_id, r.text): r.next.text for r in syncmers.with_next(docs, ["text"]).collect()}
    assert got == {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}


def test_syncmer_choice(spark):
    text = " ".join(f"w{i % 37}x{i}" for i in range(300))
    rows = syncmers.anchors(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [tuple(a) for a in rows[0].anchors] == _anchors(text) and 90 < len(rows[0].anchors) < 210


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op9_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_langid_edges(small, empty):
    model = langid.train(small)
    rows = {r.doc_id: r for r in langid.identified(small, model).collect()}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for i, r in rows.items() if not any(map(str.isalpha, TEXTS[i] or "")))
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.identified(small, None).collect()} == {"und"}


def test_toxicity(spark, documents):
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    rnd = random.Random(2)
    common = [f"{a}{b}" for a in ("ba", "do", "mi", "ra", "so") for b in ("ka", "le", "nu", "ti")]
    rows = [(i, " ".join([*rnd.choices(common, k=80), *(["vile" + rnd.choice("abcdef")] * 2 if i % 3 == 0 else []), *rnd.choices(common, k=80)])) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    out = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.train(docs, marks)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert out[900] == out[901] < 0.5
    assert toxicity.train(docs, marks.limit(0)) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}


class _Spelling:
    """Interpolated Kneser-Ney over characters by the definition, with dictionaries."""

    def __init__(self, shared_words, own_words, alphabet):
        self.tables, self.alphabet = {}, alphabet
        for o in range(1, toxicity.ORDER + 1):
            kinds, counts = shared_words if o <= toxicity.SHARED else own_words, Counter()
            seen = set()
            for k, w in enumerate(kinds):
                text = "<" * (toxicity.ORDER - 1) + w + ">"
                for i in range(toxicity.ORDER - 1, len(text)):
                    gram = text[i - o + 1 : i + 1]
                    if o == toxicity.ORDER or (o > 1 and gram[0] == "<"):
                        counts[gram] += 1
                    elif (longer := text[i - o : i + 1]) not in seen:
                        seen.add(longer)
                        counts[gram] += 1
            self.tables[o] = counts

    def log(self, word):
        text, total = "<" * (toxicity.ORDER - 1) + word + ">", 0.0
        for i in range(toxicity.ORDER - 1, len(text)):
            p = 1 / self.alphabet
            for o in range(1, toxicity.ORDER + 1):
                t, gram = self.tables[o], text[i - o + 1 : i + 1]
                same = {g: c for g, c in t.items() if g[:-1] == gram[:-1]}
                if same:
                    p = (max(same.get(gram, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * p) / sum(same.values())
            total += np.log(p)
        return total


def test_kneser_ney_brute_force():
    """By the definition, with the production settings."""
    rnd = random.Random(4)
    kinds = ["ab", "abc", "ba", "cab", "bad", "dab", "acd"]
    corpus = [(rnd.choices(kinds[: 4 + 3 * y], k=rnd.randint(1, 9)), y) for y in (0, 1) for _ in range(14)]
    pairs, words = Counter(), Counter()
    for text, y in corpus:
        pairs.update({(a, b, y) for a, b in zip(["^", *text], text)})
        words.update({(w, y) for w in text})
    names = sorted({w for w, _ in words})
    h = dict(zip(names, toxicity.word_hash(names).tolist())) | {"^": int(toxicity.START)}
    found = sorted({(a, b) for a, b, _ in pairs})
    signed = lambda x: int(np.uint64(x).view(np.int64))
    left = np.array([[signed(h[w]), *(len({a for a, x, z in pairs if x == w and z == y}) for y in (0, 1))] for w in names])
    after = np.array([[signed(h[a]), *(v for y in (0, 1) for own in ([n for (x, _, z), n in pairs.items() if x == a and z == y],) for v in (sum(own), len(own)))] for a in h])
    keys = toxicity.pair_hash(*(np.array([h[p[i]] for p in found], np.uint64) for i in (0, 1)))
    by_class = np.array([[words[w, y] for y in (0, 1)] for w in names], float)
    model = toxicity.Model.fit(names, by_class, left, after, keys, np.array([[pairs[*p, y] for y in (0, 1)] for p in found], float))
    alphabet = len(set("".join(names))) + 2
    spelling = [_Spelling(names, [w for w in names if words[w, y]], alphabet) for y in (0, 1)]
    d = toxicity.DISCOUNT

    def unigram(w, y):
        left = {b: len({a for a, x, z in pairs if x == b and z == y}) for _, b, z in pairs if z == y}
        base = np.exp(spelling[y].log(w))
        classes = {b: len({z for _, x, z in pairs if x == b}) for b in names}
        shared = (max(classes[w] - toxicity.SHARED_DISCOUNT, 0) + toxicity.SHARED_DISCOUNT * len(names) * base) / sum(classes.values())
        return (max(left.get(w, 0) - d, 0) + d * len(left) * shared) / sum(left.values())

    def probability(before, w, y):
        after = {b: n for (a, b, z), n in pairs.items() if a == before and z == y}
        if not after:
            return unigram(w, y), 0
        return (max(after.get(w, 0) - d, 0) + d * len(after) * unigram(w, y)) / sum(after.values()), sum(after.values())

    texts = [["ab", "cab", "bad"], ["bad", "zz", "abc"], ["acd"]]
    scorer = toxicity.Scorer(model)
    scorer.evidence([" ".join(t) for t in texts])
    flat = [w for t in texts for w in t]
    at = np.array([scorer.known[w] for w in flat])
    got = model.log_ratios(scorer.hashes[at], scorer.own[at], scorer.there[at], scorer.context[at], np.array([0, 3, 6]))
    expected = []
    for t in texts:
        for before, w in zip(["^", *t], t):
            if w not in names:
                word = pair = spelling[1].log(w) - spelling[0].log(w)
            else:
                word = pair = np.log(unigram(w, 1) / unigram(w, 0))
                (p0, n0), (p1, n1) = (probability(before, w, y) for y in (0, 1))
                weight = min(n0, n1) / (min(n0, n1) + toxicity.EXPERIENCE)
                pair = word + weight * (np.log(p1 / p0) - word)
            expected.append((pair, word))
    assert np.allclose(got, np.array(expected).T, atol=1e-4)


def test_calibration_never_lowers_a_score():
    rnd = np.random.default_rng(3)
    y = (np.arange(400) % 4 == 0).astype(float)
    x = np.column_stack([y + rnd.normal(size=400), -y + rnd.normal(size=400), rnd.normal(size=400) * 0.1])
    slopes, shift = toxicity._calibrated(x, y)
    assert min(slopes) >= 0 and slopes[0] > 0.3 and slopes[1] == 0.0 and np.isfinite(shift)


def test_langid_votes_brute_force():
    words, langs = ["haus", "hause", "house", "mouse", "maus"], ["de", "en"]
    docs = np.array([[3, 0], [1, 0], [0, 4], [0, 2], [2, 1]], float)
    model = langid.Model.fit(langs, words, docs)
    known = [i for i in range(5) if docs[i].sum() >= langid.KNOWN]

    def logs(table):
        totals = [sum(c[k] for c in table.values()) + langid.SMOOTHING * len(table) for k in (0, 1)]
        return {x: [np.log((c[k] + langid.SMOOTHING) / totals[k]) for k in (0, 1)] for x, c in table.items()}

    by_word = logs({words[i]: docs[i] for i in known})
    grams = lambda w, n: [("\x02" * (langid.ORDER - 1) + w + "\x03")[i - n + 1 : i + 1] for i in range(langid.ORDER - 1, langid.ORDER + len(w))]
    by_gram = {}
    for n in range(1, langid.ORDER + 1):
        table = {}
        for w, c in zip(words, docs):
            for g in grams(w, n):
                table[g] = table.get(g, 0) + c
        by_gram[n] = logs(table)

    def votes(w):
        if w in by_word:
            return by_word[w]
        for n in range(langid.ORDER, 0, -1):
            if hit := [by_gram[n][g] for g in grams(w, n) if g in by_gram[n]]:
                return np.mean(hit, 0)
        return [0, 0]

    wanted = ["haus", "hause", "hauses", "grouse", "xyz", "x"]
    assert np.allclose(model.votes(wanted), [votes(w) for w in wanted], atol=1e-4)
    assert langid.Identifier(model).identify(["haus maus", "house", "12 !", None])[0] == ["de", "en", "und", "und"]


CLASHING = ("id", "row", "h", "n", "rule", "kept", "base_failed", "score", "toxicity", "_w", "_t", "_sg_kept", "_near_row", "_simhash_row", "digest", "a.b", "length", "path", "_at")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with further columns of every name that operators use themselves."""
    rows = [(i, t, *range(i, i + len(CLASHING))) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))


def _same_rows(kept, docs):
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_clashing_columns(spark, clashing, labels, documents):
    long = clashing.union(documents.limit(60).selectExpr("doc_id + 1000", "text", *(str(i) for i in range(len(CLASHING)))))
    marks = labels.selectExpr("doc_id + 1000 as doc_id", "quality", "toxic").union(spark.createDataFrame([(1000, 1, 1)], "doc_id bigint, quality int, toxic int"))
    model = toxicity.train(long, marks, held_out_too=True)
    for kept in (quality.keep_good(long, marks), toxicity.keep_clean(long, model), toxicity.keep_clean(long, None), simhash.keep_one(long), near_copies.keep_one(long)):
        _same_rows(kept, long)
    assert toxicity.scored(clashing, None).columns[-1] == "score_"
    n = len(TEXTS)
    assert pieces.encode_n_best(clashing, 1).count() == n and packing.pack(clashing).select("id").distinct().count() == n
    assert sharding.shard_by_bytes(clashing, 3).count() == n and langid.identified(clashing, None).count() == n
    assert syncmers.with_next(syncmers.with_sketch(clashing.select("doc_id", "text"), F.col("text"), "sketch"), ["text"]).count() == n
    files, _ = token_counts.write_flat_files(clashing, f"{shared_dir(spark)}/flat")
    assert token_counts.document_counts(files).count() == n
    assert wavelet.read_documents(wavelet.write_shards(clashing, f"{shared_dir(spark)}/wm")).count() == n


def test_keep_one_with_odd_ids(spark):
    rows = [(None, "a b c d"), (None, "e f g h"), (7, "a b c d"), (8, "i j k l"), (8, "m n o p"), (9, "i j k l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for kept in (simhash.keep_one(docs), near_copies.keep_one(docs)):
        assert sorted((r.text, r.doc_id) for r in kept.collect()) == [("a b c d", 7), ("e f g h", None), ("i j k l", 8), ("m n o p", 8)]


def _odd_tables(spark):
    """Tables of documents and labels that every query must take."""
    schema, marks = SCHEMA, "doc_id bigint, quality int, toxic int"
    twice = [(1, "same text " * 40, "en", "s", 400)] * 5 + [(2, None, None, None, None)] * 3
    nulls = [(None, None, None, None, None), (None, "no id " * 30, None, None, None), (3, "", "de", None, 0), (4, "   ", None, "s", 3)]
    ends = [(2**63 - 1, "last " * 60, "en", "s", 300), (-(2**63), "first " * 60, "en", "s", 360)]
    some = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (99, 0, 1)]
    return {name: (spark.createDataFrame(rows, schema), spark.createDataFrame(lab, marks)) for name, rows, lab in (("none", [], []), ("twice", twice, some), ("nulls", nulls, some), ("ends", ends, []))}


#: Queries with one row for each document, by its id.
BY_DOCUMENT = {name: run for name, run in QUERIES.items() if name not in ("op3_packing", "op12_overlaps")}


def test_queries_take_odd_tables(spark, tmp_path):
    for name, (docs, marks) in _odd_tables(spark).items():
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        n = docs.count()
        ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        for query, run in BY_DOCUMENT.items():
            rows = run(spark, f"{tmp_path}/{name}").collect()
            assert Counter(r.doc_id for r in rows) == ids, (name, query)
            if name == "twice" and query not in ("op4_sharding", "op7_wavelet", "op8_syncmers", "op13_mixing"):  # these give equal rows places, or neighbours, of their own
                assert len({repr(r) for r in rows}) == len(ids), query
        packed = QUERIES["op3_packing"](spark, f"{tmp_path}/{name}").collect()
        assert Counter(r.doc_id for r in packed if r.piece == 0) == ids
        import corpus_pipeline

        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() <= n


def test_queries_by_contract(spark, documents):
    """The columns that the contracts name, over whole tables, against brute force."""
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = {name: {r.doc_id: r for r in run(spark, SF).collect()} for name, run in BY_DOCUMENT.items()}
    assert all(r.keys() == texts.keys() for r in rows.values())
    fps = {i: _fingerprint(t) for i, t in texts.items()}
    components, start = _components(fps), 0
    for i, t in sorted(texts.items()):
        assert (rows["op1_simhash"][i].fingerprint, rows["op1_simhash"][i].component_id) == (f"{fps[i]:016x}", components[i])
        assert rows["op2_pieces"][i].decodes == ("\u2581" not in t)
        r = rows["op4_sharding"][i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None) and 0 <= r.shard < 24
        r, stats = rows["op6_quality"][i], _statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0]) and not (r.base_failed and r.kept)
        ids, r = _ids(t, [1]), rows["op7_wavelet"][i]
        ends = np.flatnonzero(ids == 1)
        assert (r.start, r.n_tokens, r.ids_crc32, r.last_id, r.n_ends, r.first_end) == (start, len(ids), zlib.crc32(ids.tobytes()), 1, len(ends), ends[0])
        start += len(ids)
        r = rows["op9_langid"][i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        r = rows["op10_toxicity"][i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    packed = QUERIES["op3_packing"](spark, SF).collect()
    lengths, places = Counter(), {}
    for r in packed:
        ids = _ids(texts[r.doc_id], [0])[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and (len(ids), zlib.crc32(ids.tobytes())) == (r.length, r.ids_crc32)
        lengths[r.length] += 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) <= 2048 for p in places.values())
    assert len(places) == packing.lower_bound(lengths, 2048)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
        if name == "quality_rules":
            judged = quality.judged(before, spark.read.parquet(f"{sf}/labels.parquet")).where("_sg_kept").select("doc_id")
            assert {r.doc_id for r in judged.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert [d.columns for d in kept[:3]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 3
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] >= ids[1] >= ids[2] == ids[3]
    texts = kept[0].select("doc_id", "text").collect()
    scorer = toxicity.Scorer(toxicity.train(kept[0], spark.read.parquet(f"{sf}/labels.parquet")))
    assert ids[1] == {r.doc_id for r, x in zip(texts, scorer.score([r.text for r in texts])) if x < 0.5}
    sets = {r.doc_id: set(near_copies.shingles(r.text).tolist()) for r in kept[1].collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert ids[2] == {find(i) for i in sets}
    lengths = Counter(r.length for r in kept[3].select("length").collect())
    assert kept[3].select("sequence_id").distinct().count() == packing.lower_bound(lengths, 2048)
