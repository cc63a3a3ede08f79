"""The training-data operators against brute force, round trips and edge cases."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest

import oracle
from weftline.lineage import new_folder
from weftline.llm import bpe_count, licenses, mixing, packing, ppm, quality, queries, rpforest, simhash, tokenbin, tokens, trie, warc
from weftline.tables import load

SQL = queries.oracle_sql()
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, id long, n string"
ROWS = [
    (1, None, "en", "a", 0, "x", 9, "y"),
    (2, "", None, None, 0, "x", 9, "y"),
    (3, "one two", "en", "a", 7, "x", 9, "y"),
    (4, "one two", "en", "b", 7, "x", 9, "y"),
    (4, "one two", "en", "b", 7, "x", 9, "y"),
    (None, "é ñ 中文 🙂 \x00 <|endoftext|>", "xx", "b", 9, "x", 9, "y"),
    (5, "the cat sat on the mat and " * 3000, "en", "a", 81000, "x", 9, "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    assert oracle.compare(spark, sf_dir, name, queries.queries()[name], SQL[name]) == ""


def _documents(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in load(spark, sf_dir, "documents").collect()]


def test_odd_rows_and_empty_tables(spark, odd, none):
    byte, word, piece = (queries.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
    for f in (
        licenses.license_scan,
        quality.quality_rules,
        ppm.ppm_scores,
        simhash.simhash_components,
        lambda d: mixing.temperature_mix(d).where("epoch = 0"),
        lambda d: bpe_count.token_counts(d, piece),
        lambda d: packing.pack_documents(d, word),
        lambda d: tokenbin.token_file_round_trip(d, byte, 2),
    ):
        got = f(odd)
        ids = collections.Counter(r.doc_id for r in got.collect())
        assert set(ids) == {1, 2, 3, 4, 5, None} and ids[3] == 1 and ids[4] == 2
        assert f(none).count() == 0 and f(none).columns == got.columns


def _components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in linked:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_trie_finds_all_close_codes():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    got = {(int(i), int(j)) for a, b in trie.close_codes(codes, codes, True, 0, 0, [2] * 65) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert got == want


def test_trie_join_with_hot_nodes(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    codes = list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(600)} | {rng.getrandbits(64) for _ in range(300)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    d = spark.createDataFrame([(0, c, i) for i, c in enumerate(signed)], "tree long, code long, id long")
    links = [(r.a, r.b) for r in trie.near_links(d, 64, 2, task_codes=150, node_codes=64).collect()]
    want = [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 2]
    assert _components(len(codes), links) == _components(len(codes), want)
    assert all((codes[a] ^ codes[b]).bit_count() <= 2 for a, b in links)


def test_simhash_components_equal_brute_force(spark, sf_dir):
    import xxhash

    docs = _documents(spark, sf_dir)
    prints = []
    for _, t in docs:
        w = t.encode().lower().split()
        runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    n = len(docs)
    roots = _components(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = collections.defaultdict(lambda: 1 << 60)
    for i, r in enumerate(roots):
        least[r] = min(least[r], docs[i][0])
    want = sorted((docs[i][0], f"{prints[i]:016x}", least[roots[i]]) for i in range(n))
    assert sorted(map(tuple, queries.op10_simhash(spark, sf_dir).collect())) == want


def _jaccard(a, b, width):
    x, y = (set(zip(*(t.lower().split()[k:] for k in range(width)), strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(5000)]
    rows, near = [], 0
    for k in range(60):
        words = rng.choices(vocab, k=300)
        rows.append((10 * k, " ".join(words)))
        other = list(words)
        for _ in range(3):  # three changed words part about fifteen of some three hundred shingles
            other[rng.randrange(300)] = "changed"
        rows.append((10 * k + 1, " ".join(other)))
        rows.append((10 * k + 2, " ".join(words).upper()))
        rows.append((10 * k + 3, " ".join(rng.choices(vocab, k=300))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.simhash_near_duplicates(d).collect()}
    for k in range(60):
        near += got[10 * k + 1] == 10 * k
        assert got[10 * k + 2] == 10 * k and got[10 * k + 3] == 10 * k + 3
    assert near >= 59


def test_near_duplicates_with_a_repeated_line(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for k in range(30):
        words, line = rng.choices(vocab, k=400), rng.choices(vocab, k=12)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + line * 10))]
        assert _jaccard(rows[-2][1], rows[-1][1], 5) > 0.93
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.simhash_near_duplicates(d).collect()}
    assert [got[2 * k + 1] for k in range(30)] == [2 * k for k in range(30)]


def test_near_duplicates_among_texts_of_one_template(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(20000)]
    template, rows = rng.choices(vocab, k=300), []
    for k in range(300):  # pairs that are near to each other, in a group that is just below the threshold
        words = template + rng.choices(vocab, k=58)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-20], *rng.choices(vocab, k=20)]))]
    assert _jaccard(rows[0][1], rows[2][1], 5) < 0.8 <= _jaccard(rows[0][1], rows[1][1], 5)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.simhash_near_duplicates(d).collect()}
    assert all(got[2 * k] == 2 * k for k in range(300))
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 297


def _families(rng, families, copies, length, changes):
    """Texts of families whose members differ from a base by so many changed words each."""
    vocab, rows = [f"w{i}" for i in range(20000)], []
    for _ in range(families):
        base = rng.choices(vocab, k=length)
        for _ in range(copies):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(length)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    return rows


def _exact_groups(rows, similarity=0.8):
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for g in x:
            holders[g].append(i)
    links = []
    for i, x in enumerate(sets):
        common = collections.Counter(j for g in x for j in holders[g] if j < i)
        links += [(i, j) for j, c in common.items() if c / (len(x) + len(sets[j]) - c) >= similarity]
    return links, _components(len(rows), links)


@pytest.mark.parametrize("limits", [{}, {"task_codes": 40, "task_shingles": 4000}])
def test_near_duplicates_in_families_around_the_threshold(spark, limits):
    rows = _families(random.Random(11), 40, 30, 300, 4)
    links, want = _exact_groups(rows)
    got = {r.id: r.component_id for r in simhash.simhash_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()}
    assert all(want[i] == want[got[i]] for i in range(len(rows)))  # no link below the threshold
    assert sum(got[i] == got[j] for i, j in links) >= 0.95 * len(links)
    assert sum(got[i] != i for i in range(len(rows))) >= 0.95 * sum(want[i] != i for i in range(len(rows)))


def test_spanning_links_equal_all_pairs():
    rows = _families(random.Random(4), 3, 20, 120, 3) + _families(random.Random(5), 1, 5, 6, 1) + [(0, ""), (0, "one")]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    _, want = _exact_groups(rows)
    i, j = simhash.spanning_within(sets, 0.8)
    assert _components(len(sets), list(zip(i, j, strict=True))) == want
    half = len(sets) // 2
    parts = np.arange(len(sets))
    x, y = simhash.spanning_across(sets[:half], sets[half:], parts[:half], parts[half:], 0.8)
    across = [(a, b + half) for a, b in zip(x, y, strict=True)]
    inside = [(a, b) for a, b in _exact_groups(rows)[0] if (a < half) == (b < half)]
    assert _components(len(sets), inside + across) == want


def test_forest_of_dense_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    center = rng.standard_normal(16)
    vectors = [center + 0.02 * rng.standard_normal(16) for _ in range(150)] + [rng.standard_normal(16) for _ in range(150)]
    rows = [(i, v.astype(np.float32).tolist(), i % 2) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, rows[0][1], None), (1004, rows[0][1], 0), (1005, [], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rpforest.embedding_near_duplicates(d, leaf_rows=32).collect()}
    good = [(i, np.asarray(v, np.float64), lab) for i, v, lab in rows if v and lab is not None and np.isfinite(v).all() and any(v)]
    linked = [(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.98]
    n = collections.Counter(x for p in linked for x in p)
    roots = _components(len(good), linked)
    want = {i: (0, i, True) for i, _, _ in rows}
    want |= {good[k][0]: (n[k], good[roots[k]][0], good[roots[k]][0] == good[k][0]) for k in range(len(good))}
    assert got == want


@pytest.mark.parametrize("width", [64, 8])
def test_forest_finds_planted_pairs_across_splits(spark, width):
    rng = np.random.default_rng(width)
    base = rng.standard_normal((1500, width))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1500, width))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9802, 0.983, (1500, 1))
    both = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * side)).astype(np.float32)
    d = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(both)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.embedding_near_duplicates(d, leaf_rows=128).collect()}
    unit = both.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(unit), dtype=bool)
    i, j = np.nonzero(near)
    roots = _components(len(unit), zip(i.tolist(), j.tolist(), strict=True))
    assert got == {k: (int(n), roots[k]) for k, n in enumerate(near.sum(axis=1))} and len(i) >= 3000


def test_forest_of_empty_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, id long, key string, unit string, many int"
    assert rpforest.embedding_near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 3, 5, "k", "u", 9), (1, [1.0, 0.0], 3, 5, "k", "u", 9), (2, [2.0, 0.0], 3, 5, "k", "u", 9), (None, [1.0, 0.0], 3, 5, "k", "u", 9), (4, [1.0, None], 3, 5, "k", "u", 9)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in rpforest.embedding_near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (4, 0, 4, True), (None, 0, None, None)]


def _archive(compress):
    import gzip

    data = [warc.record("response", i, f"http://x/{i}", f"<p>{i}</p>".encode() * 50, warc.sha1_base32(f"<p>{i}</p>".encode() * 50)) for i in range(6)]
    return [gzip.compress(x, mtime=0) if compress else x for x in data]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = _archive(compress)
    damaged = bytearray(parts[2])
    damaged[len(damaged) // 2] ^= 0xFF
    raw = b"junk!" + parts[0] + parts[1] + bytes(damaged) + parts[3] + parts[4][: len(parts[4]) // 2] + parts[5] + b"\x1f\x8b\x08tail"
    found = list(warc.salvage(io.BytesIO(raw), len(raw)))
    records, gaps = [x for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]
    assert [r.headers["warc-target-uri"][-1] for r in records] == list("0135")
    assert sum(x.length for x in found) == len(raw) and len(gaps) == 4 and all(g.reason for g in gaps)


def test_salvage_within_a_member():
    import gzip

    parts = _archive(False)
    at = parts[2].index(b"<p>")
    damaged = parts[2][:at] + b"#" + parts[2][at + 1 :]
    whole = gzip.compress(b"".join([parts[0], parts[1], damaged, *parts[3:]]), mtime=0)
    first = gzip.compress(b"".join([damaged, *parts[3:]]), mtime=0)
    flipped = bytearray(gzip.compress(b"".join(parts), mtime=0))
    flipped[-8] ^= 0xFF
    ended = gzip.compress(b"".join(parts), 0, mtime=0)  # stored: version lines stand in the file itself
    tail = gzip.compress(parts[5], mtime=0)
    long = gzip.compress(warc.record("response", 7, "http://x/" + "u" * 70_000, b"x", warc.sha1_base32(b"x")), mtime=0)
    plain = gzip.decompress(long)

    def ids(raw):
        found = list(warc.salvage(io.BytesIO(raw), len(raw)))
        assert {(x.offset, x.length) for x in found if x.length == 0} == set()
        return [x.headers["warc-record-id"][len(warc.PAGE) + 1 : -1] for x in found if isinstance(x, warc.Record)], [x.reason for x in found if isinstance(x, warc.Gap)]

    assert ids(whole)[0] == list("01345") and len(ids(whole)[1]) == 1
    assert ids(first)[0] == list("345")
    assert ids(bytes(flipped) + tail)[0] == list("0123455")
    assert ids(ended[: len(ended) * 3 // 4] + tail)[0] == [*"0123", "5"]
    assert ids(long + tail)[0] == ["7", "5"] == ids(plain + parts[5])[0]


def test_warc_odd_pages(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, None, "same"), (7, "u", None), (8, "u", ""), (None, "u", "same"), (3, "u", "same")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(d).collect())
    assert got == collections.Counter([(5, 4, "revisit", 3), (3, 4, "response", None), (3, 4, "response", None), (9, 4, "revisit", 3), (7, 0, "response", None), (8, 0, "revisit", 7), (None, 4, "response", None)])
    assert {r.payload_digest for r in warc.warc_round_trip(d).where("payload_bytes = 4").collect()} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    assert warc.warc_round_trip(d.limit(0)).count() == 0


def _ppm(train, texts):
    """Log10 probabilities by method C with exclusion, from counts of all contexts."""
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        s = ppm.symbols(t).tolist()
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    known = {}

    def log(window):
        left_out, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            c = {a: n for a, n in seen.get(window[ppm.ORDER - k : -1], {}).items() if a not in left_out}
            if not c:
                continue
            if window[-1] in c:
                return math.log10(p * c[window[-1]] / (sum(c.values()) + len(c)))
            p *= len(c) / (sum(c.values()) + len(c))
            left_out |= set(c)
        return math.log10(p / (257 - len(left_out)))

    out = []
    for t in texts:
        s = ppm.symbols(t).tolist()
        windows = [tuple(s[i - ppm.ORDER : i + 1]) for i in range(ppm.ORDER, len(s))]
        for w in windows:
            if w not in known:
                known[w] = log(w)
        out.append(math.fsum(known[w] for w in windows))
    return out


def _held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("head", [1 << 22, 200, 0])
def test_ppm_scores_equal_brute_force_at_any_head(spark, head):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 7))) for _ in range(60)]
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join(rng.choices(words, k=40)) + "xyz"[: i % 4]) for i in range(60)]
    rows += [(None, "zz top"), (3, "twice"), (3, "twice"), (70, "ab" * 40000)]
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string"), head=head).collect())
    want = _ppm([t for i, t in rows if not _held_out(i)], [t for _, t in rows])
    want = sorted((str(i), len((t or "").split()) + 1, p) for (i, t), p in zip(rows, want, strict=True))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-6 * abs(b[2]) + 1e-9 for a, b in zip(got, want, strict=True))


def test_ppm_base_and_held_out(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    got = {r.doc_id: r for r in queries.op5_ppm_scores(spark, sf_dir).collect()}
    held = {i: _held_out(i) for i, _ in docs}
    scores = _ppm([t for i, t in docs if not held[i]], [t for _, t in docs])
    c = collections.Counter()
    for i, t in docs:
        if not held[i]:
            c.update([*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    for (i, t), score in zip(docs, scores, strict=True):
        w = [*t.encode().lower().split(), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6
        assert abs(r.score - score) <= 1e-6 * abs(score)


ALPHABET = [*"ab aaa  ▁\n\tthe’éÉß中文🙂 0²!?\r\x00ﬁ.'", "in", "tion", " the", "</s>", "▁▁", "    ", "<0x0A>", "<|endoftext|>", "'s", "'LL"]


def _fuzz(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)] + ["a" * 3000, " " * 700, "the" * 300, ""]


def test_token_counts_equal_the_library(spark, sf_dir):
    from sentencepiece import SentencePieceProcessor

    path = queries.vocabulary("piece_bpe_32k.model")
    texts = _fuzz(4000) + [t for _, t in _documents(spark, sf_dir)[:40]]
    counter = bpe_count.Counter(path)
    want = [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    assert counter.count(texts) == want
    assert [sum(map(counter._queue, bpe_count._PRE("▁" + t.replace(" ", "▁")))) if t else 0 for t in texts[:500]] == want[:500]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(spark, sf_dir, name):
    e = tokens.Encoder(queries.vocabulary(name))
    texts = _fuzz(4000) + [t for _, t in _documents(spark, sf_dir)[:40]]
    assert e.encode(texts) == [np.array(x.ids, np.uint32).tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_token_file_reads_only_what_is_asked_and_checks_sums():
    docs = [(3, 10), (4, 200_000), (None, 5), (9, 0), (9, 70_000)]
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 50_000, n).astype(np.uint32) for _, n in docs]

    class Kept(io.BytesIO):
        def close(self):
            pass

        def size(self):
            return len(self.getvalue())

    f = Kept()
    w = tokenbin.Writer(f)
    for (d, _), x in zip(docs, ids, strict=True):
        w.add(d, x)
    w.close()
    r = tokenbin.Reader(f)
    assert np.array_equal(r.read(4)[0], ids[1]) and [len(x) for x in r.read(9)] == [0, 70_000] and r.read(5) == []
    import zstandard

    raw = f.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read(4)  # an ordinary reader skips index and table
    broken = Kept(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:])
    with pytest.raises(ValueError):
        list(tokenbin.Reader(broken).parts())


def test_token_files_equal_the_library(spark, sf_dir):
    lib = tokens.Encoder(queries.vocabulary("byte_bpe_50k.json")).library
    start, want = 0, []
    for i, t in sorted(_documents(spark, sf_dir)):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op8_token_files(spark, sf_dir).collect())) == want


def _check_packing(rows, capacity=4096):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, sf_dir):
    rows = queries.op7_best_fit_packing(spark, sf_dir).collect()
    lib = tokens.Encoder(queries.vocabulary("word_bpe_49k.json")).library
    want = []
    for i, t in _documents(spark, sf_dir):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert _check_packing(rows) <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_within_its_bound(spark):
    rng = random.Random(8)
    lengths = [4096 if rng.random() < 0.1 else rng.randrange(1, 3000) for _ in range(4000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").repartition(3)
    least = -(-sum(lengths) // 4096)
    used = {k: _check_packing(packing.pack_pieces(pieces, 4096, open_bins=k, block_pieces=2000).collect()) for k in (2, 16, 64)}
    assert used[2] > used[16] >= used[64] and used[64] <= 1.02 * least  # the bound costs something, and at its set value little
    many = packing.pack_pieces(pieces, 4096).collect()
    assert len(many) == 4000 and sorted((r.doc_id, r.length) for r in many) == sorted(enumerate(lengths))


def test_token_files_split_an_id_of_many_rows(spark):
    rows = [(None if k % 3 else 7, f"text {k}") for k in range(600)] + [(9, "last")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be one range
    try:
        files = tokenbin.write_token_files(d, queries.vocabulary("byte_bpe_50k.json"), 2, new_folder(spark))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.where("first_doc is null and last_doc is null").count() > 1
    got = tokenbin.read_token_files(files).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    ordered = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in got)
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(ordered, ordered[1:], strict=False)) and ordered[0][0] == 0


def test_token_counts_of_the_whole_table(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    want = sorted((i, len(t.encode()), n, n > 4096) for i, t in _documents(spark, sf_dir) for n in [len(model.encode(t))])
    got = queries.op6_token_counts(spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline as cp

    prose = " ".join(f"the w{k} of x{k} and" for k in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, q_row string, q_kept string, mix_copies string, place string, row string, lost_id long, id long, t string, key string"
    extra = ("a", "b", "c", "d", "e", 1, 2, "f", "g")
    rows = [(k, prose, "en", s, 9, *extra) for k, s in ((5, "x"), (3, "x"), (3, "x"), (None, "y"), (4, None))]
    rows += [(10, None, None, None, None, *extra), (11, "", "en", "x", 0, *extra), (12, " ".join(f"word{k} the" for k in range(900_000)), "pl", "y", 1, *extra), (13, prose.replace("w7 ", "other "), "en", "x", 9, *extra)]
    docs = spark.createDataFrame(rows, schema)
    kept = cp.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == {5: 1, 3: 2, None: 1, 4: 1, 12: 1, 13: 1}
    single = cp.dedup_stage(spark, kept, "")
    # one of each group, with all rows of its id; rows without an id stay
    assert single.columns == docs.columns and collections.Counter(r.doc_id for r in single.collect()) == {3: 2, None: 1, 12: 1}
    mixed = cp.mixing_stage(spark, single, "")
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and counts.keys() == {3, None, 12} and counts[12] == 1 and counts[3] >= 2
    packed = cp.packing_stage(spark, mixed, "").collect()
    _check_packing(packed)
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == counts
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, "").count() == 0
    assert simhash.simhash_near_duplicates(docs.select("doc_id", "text")).where("id = 10").first().component_id == 10


def test_best_fit_closes_the_fullest():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 9, 5, 1]), 10, open_bins=2)
    assert bins.tolist() == [0, 1, 0, 2, 1, 2] and offsets.tolist() == [0, 0, 6, 0, 5, 9]
    bins, _ = packing.best_fit(np.array([6, 5, 7, 4, 3]), 10, open_bins=2)
    assert bins.tolist() == [0, 1, 2, 1, 2]  # the bin with six was closed when the third was opened


def _mix_source():
    return [(k, "w " * 50, "big") for k in range(800)] + [(1000 + k, "w " * 50, f"s{k % 4}") for k in range(80)]


def test_mixing_limits(spark):
    d = spark.createDataFrame(_mix_source(), "doc_id long, text string, source string")
    got = mixing.temperature_mix(d, max_repetition=3.0, block_tokens=200).collect()
    times = collections.Counter((r.source, r.doc_id) for r in got)
    assert all(n == 1 for (source, _), n in times.items() if source == "big")
    drawn = collections.Counter()
    for r in got:
        drawn[r.source] += r.n_tokens
    assert all(2.9 <= drawn[f"s{k}"] / 1000 <= 3.0 for k in range(4))
    for source in drawn:  # the draws of a source follow each other without gaps
        starts = sorted((r.start, r.n_tokens) for r in got if r.source == source)
        assert all(s + n <= t for (s, n), (t, _) in zip(starts, starts[1:], strict=False))
    exponent = mixing.find_exponent(spark.createDataFrame([(8.0,), (1.0,), (1.0,)], "n double"), target_entropy=1.0)
    p = np.array([8.0, 1.0, 1.0]) ** exponent
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 1.0) < 1e-4
    small = mixing.temperature_mix(d, max_repetition=3.0, budget_tokens=10_000, block_tokens=200).collect()
    assert abs(sum(r.n_tokens for r in small if r.epoch is not None) - 10_000) <= 50 * 6 and any(r.epoch is None for r in small)
    assert {r.doc_id for r in small} == {k for k, _, _ in _mix_source()}


def test_mixed_rows_lie_apart_and_by_weight(spark):
    rows = [(*r, "m", "q", None) for r in _mix_source()]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies string, place string, row string").repartition(7)
    out = mixing.mix_rows(d, max_repetition=3.0, block_tokens=200)
    got = out.collect()
    assert out.columns == d.columns
    want = collections.Counter(r.doc_id for r in mixing.temperature_mix(d, max_repetition=3.0, block_tokens=200).collect())
    assert collections.Counter(r.doc_id for r in got) == want
    last = {}
    for k, r in enumerate(got):
        assert k - last.get(r.doc_id, -1000) > 100  # no copy near another
        last[r.doc_id] = k
    parts = [collections.Counter(r.source for r in got[k : k + len(got) // 4]) for k in range(0, len(got) - 3, len(got) // 4)]
    assert all(abs(p["big"] / sum(p.values()) - 800 / len(got)) < 0.05 for p in parts)
    odd = spark.createDataFrame([*ROWS, (6, None, None, None, None, None, None, None)], DOC)
    assert collections.Counter(r.doc_id for r in mixing.mix_rows(odd).collect())[4] >= 2
    assert mixing.mix_rows(odd.limit(0)).count() == 0


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit.replace("MIT License", "The  MIT  License".replace("The  ", ""))).upper()
    rows = [(1, "Copyright (c) 2020 A. Person\n" + wrapped), (2, mit.partition("\n\n")[2].replace("sublicense", "sub-license")), (3, "Some text.\nReleased under the MIT Licence"), (4, mit + " And more.")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].license_id for k in (1, 2, 3, 4)] == ["MIT", "MIT", None, None]
    assert (got[3].n_notices, got[3].notice_licenses) == (1, "MIT")


def test_licenses_under_copyright_lines_of_many_kinds(spark):
    mit, bsd = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"]
    lines = ["Copyright (c) Meta Platforms, Inc. and affiliates.", "Copyright (c) Jane Doe", "Copyright (c) [year] [fullname]", "Copyright The Go Authors", "Portions Copyright 2020 X", "© The Authors", "Copyright (c) 2010, X\nAll rights reserved.", "Copyright (c) 2010 X\n\n * All rights reserved.\nCopyright Y"]
    rows = [(2 * k, x + "\n\n" + mit) for k, x in enumerate(lines)] + [(2 * k + 1, x + "\n" + bsd.replace("\n\n", "\n")) for k, x in enumerate(lines)]
    wrapped = mit.replace("The above copyright notice", "The above\ncopyright notice").replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    rows += [(100, lines[1] + "\n" + wrapped), (101, "All rights reserved.\n" + mit), (102, "copyright notice of mine\n" + mit)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].license_id for k in range(2 * len(lines))] == ["MIT", "BSD-3-Clause"] * len(lines)
    assert [got[k].license_id for k in (100, 101, 102)] == ["MIT", None, None] and got[12].n_notices == 1
    assert got[0].canonical_digest == got[100].canonical_digest


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline as cp

    docs = load(spark, sf_dir, "documents")
    kept = cp.quality_stage(spark, docs, sf_dir)
    want = {r.doc_id for r in queries.op4_quality_rules(spark, sf_dir).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    runs = {i: frozenset(" ".join(w[k : k + 5]) for w in [re.sub("[A-Z]", lambda m: m[0].lower(), text[i]).split()] for k in range(len(w) - 4)) for i in want}
    ids = sorted(want)
    linked = [(a, b) for a in range(len(ids)) for b in range(a) if len(runs[ids[a]] & runs[ids[b]]) >= 0.8 * len(runs[ids[a]] | runs[ids[b]])]
    first = {ids[r] for r in _components(len(ids), linked)}
    single = cp.dedup_stage(spark, kept, sf_dir)
    assert {r.doc_id for r in single.collect()} == first
    mixed = cp.mixing_stage(spark, single, sf_dir)
    copies = collections.Counter(r.doc_id for r in mixing.temperature_mix(single, max_repetition=2.0).collect())
    assert collections.Counter(r.doc_id for r in mixed.collect()) == copies and set(copies) == {r.doc_id for r in single.collect()}
    packed = cp.packing_stage(spark, mixed, sf_dir).collect()
    _check_packing(packed)
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert cp.run(spark, sf_dir).count() == len(packed)
