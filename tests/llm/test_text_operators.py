"""Operators on whole texts against brute force, over awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from statweave.llm import bpe, common, exact_dedup, langid, lm_scoring, packing, quality_gbt, quality_rules, simhash
from tests.llm.data import DE, documents, frame, prose

xxhash = pytest.importorskip("xxhash")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


@pytest.mark.parametrize("settings", [{}, {"bits_per_row": 1, "broadcast_mb": 0, "hot_groups": 10**9}, {"bits_per_row": 4096, "broadcast_mb": 0}, {"broadcast_mb": 0, "hot_groups": 1}, {"bits_per_row": 1, "broadcast_mb": 0, "hot_groups": 20}])
def test_exact_dedup(spark, settings):
    docs = documents()
    got = rows_of(exact_dedup.exact_dedup(frame(spark), **settings))
    assert len(got) == len(docs)
    groups = defaultdict(list)
    for i, t, *_ in docs:
        groups[key(t)].append((-len(t or ""), i is None, i))
    for r in got:
        g = groups[r["text_sha256"]]
        assert (r["group_size"], r["keep_id"]) == (len(g), min(g)[2])
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == dict.fromkeys(groups, 1)  # one row each, repeated rows too
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_empty_tables(spark):
    empty = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (exact_dedup.exact_dedup(empty), quality_rules.quality_rules(empty), simhash.simhash_groups(empty), packing.pack(empty), lm_scoring.lm_scores(empty), langid.identify(empty), quality_gbt.quality_scores(empty, labels), bpe.bpe_digests(empty), bpe.bpe_ids(empty)):
        assert out.count() == 0


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    docs = documents()
    got = rows_of(quality_rules.quality_rules(frame(spark)))
    want = Counter((i, *brute_measures(t)) for i, t, *_ in docs)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["posterior"] <= 1


def test_votes_separate_planted_classes():
    good, bad = (1, 1, 1, 1, 1, 1), (2, 1, 1, 2, 1, 0)
    code = lambda v: sum(x * 3 ** (len(v) - 1 - k) for k, x in enumerate(v))
    model = quality_rules.fit_votes({code(good): 900, code(bad): 100}, 6)
    assert model.posterior(list(good)) > 0.9 > 0.1 > model.posterior(list(bad))
    assert quality_rules.fit_votes({}, 6).prior > 0.5


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    values = sorted(values)
    v, parent = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return {x: find(i) for i, x in enumerate(values)}


def test_simhash(spark):
    docs = documents()
    got = rows_of(simhash.simhash_groups(frame(spark)))
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in docs]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{f:016x}") for i, f in prints)
    component = brute_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[component[f]] = min(i, least.get(component[f], i))
    assert all(r["component_id"] == least.get(component[int(r["fingerprint"], 16)]) for r in got)


@pytest.mark.parametrize("limit", [16384, 40])
def test_trie_join_loses_no_link(spark, limit):
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 2**63, 4, dtype=np.uint64):
        for _ in range(250):
            x = int(centre)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    signed = {int(np.array(x, np.uint64).view(np.int64)): x for x in values}
    links = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)
    got = {r["node"]: r["root"] for r in simhash.connected_components(links).collect()}
    want = brute_components(values)
    classes = lambda label: {frozenset(x for x in signed if label(x) == c) for c in {label(x) for x in signed}}
    assert classes(lambda x: got.get(x, x)) == classes(lambda x: want[signed[x]])


def library(path):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def test_bpe_equals_the_library(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    own = library(bpe.tokenizer_path())
    docs = documents()
    want = Counter()
    for i, t, *_ in docs:
        ids = own.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i, len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.bpe_digests(frame(spark)).collect()) == want
    monkeypatch.setattr(bpe, "LEAST", 8)
    monkeypatch.setattr(bpe, "MOST", 64)
    monkeypatch.setattr(bpe, "MEAN", 16)
    import random

    rng, encoder = random.Random(1), bpe.Encoder(bpe.tokenizer_path(), cache_chars=500)
    parts = ["a", " ", "  ", "\n", "'re", "'", "'s", "1", "é", "　", "\xa0", "!", "<|endoftext|>", "\x1c", "\x85", "日本", "😀", "don't", "x" * 50, " " * 90, "\r\n", "'l"]
    for _ in range(600):
        text = "".join(rng.choices(parts, k=rng.randint(0, 120)))
        ids = own.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids == encoder.whole(text).tolist()
        assert encoder.decode(np.array(ids, np.uint32)) == own.decode(ids, skip_special_tokens=False)
    shared = "".join(rng.choices(["word ", "other ", "thing, "], k=400))
    encoder = bpe.Encoder(bpe.tokenizer_path())
    for i in range(5):
        encoder.encode(f"document {i} " + shared)
    assert encoder.reused > 0


def test_packing(spark):
    pytest.importorskip("public_tokenizers")
    own = library(bpe.tokenizer_path())
    docs = documents()
    got = rows_of(packing.pack(frame(spark)))
    want = Counter()
    for i, t, *_ in docs:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, ids.size, 1024):
            piece = ids[at : at + 1024]
            want[i, at, piece.size, zlib.crc32(piece.tobytes()), ids.size] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(windows) <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.25


def test_plan_is_best_fit_decreasing():
    import random

    rng = random.Random(2)
    for _ in range(100):
        size = rng.choice([8, 16, 33])
        counts = {x: n for x in range(1, size + 1) if (n := rng.randint(0, 9))}
        open_ = []
        for x in sorted(counts, reverse=True):
            for _ in range(counts[x]):
                fit = min(((c, i) for i, c in enumerate(open_) if c >= x), default=None)
                if fit:
                    open_[fit[1]] -= x
                else:
                    open_.append(size - x)
        assert packing.plan_windows(counts, size)[1] == len(open_)


def counted(docs):
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), "\n"]) for i, t, *_ in docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    return tokens, held, Counter(w for i, ws in tokens if not held(i) for w in ws)


@pytest.mark.parametrize("known", [lm_scoring.KNOWN_WORDS, 40])
def test_lm_counts_and_base(spark, monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN_WORDS", known)
    docs = documents()
    tokens, held, counts = counted(docs)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, ws in tokens:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        want[i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 4)] += 1
    got = rows_of(lm_scoring.lm_scores(frame(spark)))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def plain_units(counts, head):
    """Units and class shares of words, worked out word by word."""
    hashes = {}
    for w in counts:
        h, kinds, _ = lm_scoring.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        hashes[w] = (int(h[0]), int(kinds[0])) if w != "\n" else (0, -1)
    order = sorted((w for w in counts if w != "\n"), key=lambda w: (-counts[w], hashes[w][0] - (1 << 64 if hashes[w][0] >> 63 else 0)))
    unit = {w: 1 + k for k, w in enumerate(order[:head])}
    words, tokens = Counter(), Counter()
    for w in order[head:]:
        words[hashes[w][1]] += 1
        tokens[hashes[w][1]] += counts[w]
    return unit, words, tokens


@pytest.mark.parametrize("known", [lm_scoring.KNOWN_WORDS, 60])
def test_lm_score_is_that_of_a_plain_model(spark, monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN_WORDS", known)
    kept, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: kept.append((train(*a), a[1])) or kept[-1][0])
    docs = documents()
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in rows_of(lm_scoring.lm_scores(frame(spark)))}
    model, words = kept[0]
    tokens, _, counts = counted(docs)
    assert (words.units > 0).sum() <= known
    unit, class_words, class_tokens = plain_units(counts, (words.units > 0).sum())

    def place(w):
        if w == "\n":
            return 0, 0.0
        if w in unit:
            return unit[w], 0.0
        data = w.encode()
        k = int(lm_scoring.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1][0])
        return 1 + lm_scoring.HEAD_UNITS + k, math.log10(counts[w] + 0.1) - math.log10(class_tokens[k] + 0.1 * (class_words[k] + 1))

    for i, ws in tokens:
        if len(ws) > 300:
            continue
        at, second, total = 0, 0, 0.0
        for w in ws:
            u, inside = place(w)
            logits = model.unit.astype(float) @ (model.one[at].astype(float) + model.two[second]) + model.bias
            total += (logits[u] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / math.log(10) + inside
            at, second = u, at
        assert abs(got[i, len(ws)] - total) < 1e-3 * len(ws)


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    size, nexts = 30, np.random.default_rng(1).integers(1, 30, (30, 2))
    texts = []
    for _ in range(400):
        text = [int(rng.integers(1, size))]
        while len(text) < 40:  # the next unit follows from the last two
            text.append(int(nexts[text[-1], text[-2] % 2 if len(text) > 1 else 0]))
        texts.append(np.array([*text, 0], "<u2"))
    noise = np.bincount(np.concatenate(texts), minlength=size) + 0.1
    noise = noise / noise.sum()
    trainer = lm_scoring.Trainer(lm_scoring.untrained(noise, 16), noise, draws=32)
    assert trainer.run(iter(texts * 3)) == 3 * sum(x.size for x in texts)
    last, second, total = trainer.model().tables()
    p = np.exp(last[:, None, :] + second[None, :, :] - total[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    a, b, w = (np.concatenate(x) for x in zip(*map(lm_scoring.contexts, texts), strict=True))
    mean = np.log(p[a, b, w]).mean()
    one = np.bincount(a * size + w, minlength=size * size).reshape(size, size) + 1e-9
    assert mean > np.log(noise[w]).mean() + 1
    assert mean > np.log((one / one.sum(axis=1, keepdims=True))[a, w]).mean()  # better than any model of one unit of context


def test_lm_reads_long_texts_in_pieces(monkeypatch):
    text = pa.array(["Some words \t and others, é " * 3000])
    whole = lm_scoring.tokens(*next(lm_scoring.pieces(text)))
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 1000)
    monkeypatch.setattr(lm_scoring, "byte_pieces", lambda data: common.byte_pieces(data, 1000))
    parts = [lm_scoring.tokens(*x) for x in lm_scoring.pieces(text)]
    assert len(parts) > 50
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), whole, strict=True))


def test_language(spark):
    got = {r["doc_id"]: r for r in rows_of(langid.identify(frame(spark)))}
    langs = {i: g for i, _, g, *_ in documents()}
    assert sum(got[i]["lang_pred"] == langs[i] for i in range(60)) >= 58
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (104, 105, 106, 107))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_quality_learns_on_held_out(spark):
    rng = np.random.default_rng(1)
    docs = documents(300)
    docs = [(i, t if i is None or i % 3 or i >= 300 else "!! ".join(rng.choice(list("ABCDE#$"), 80)), *rest) for i, t, *rest in docs]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = rows_of(quality_gbt.quality_scores(frame(spark, docs), labels))
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 100]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held]) >= 0.95
    none = rows_of(quality_gbt.quality_scores(frame(spark), labels.where("false")))
    assert {r["score"] for r in none} == {0.5}


def test_language_that_was_not_learned(spark):
    rng = random.Random(3)
    swahili = "watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri hivyo yapasa watendeane kindugu".split()
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]
    other = [(1000 + i, prose(rng, words, 80), None, "src", 1, True, "r", 1, "s", "w", 2) for i, words in enumerate([swahili, noise] * 20)]
    got = {r["doc_id"]: r["score"] for r in rows_of(langid.identify(frame(spark, documents(300)[:300] + other)))}
    assert all(got[1000 + i] < 0.2 for i in range(40))
    assert sum(got[i] >= 0.2 for i in range(300)) >= 299


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_ROWS", 100)
    rng = random.Random(4)
    rows = [(i, prose(rng, ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3)], 20), f"q{i % 70:02}") for i in range(280)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folds=1, held_out=1, train_rows=2)
    assert sorted(x for names in model.members.values() for x in names) == [f"q{i:02}" for i in range(70)]


def test_language_sample_is_bounded_where_one_row_repeats(spark, monkeypatch):
    sizes, fit = [], langid.fit_svm
    monkeypatch.setattr(langid, "fit_svm", lambda x, *a: sizes.append(len(x)) or fit(x, *a))
    rng = random.Random(6)
    rows = [(1, "the same text of the same document", "en")] * 5000 + [(i, prose(rng, DE, 20), "de") for i in range(2, 300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folds=1, held_out=1, train_rows=50)
    assert sizes and max(sizes) == 100 and model.members == {"germanic": ["de", "en"]}


def test_gram_counts_by_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab Cé1日\n", k=rng.randint(0, 40))) for _ in range(50)] + [None, ""]
    got = langid.gram_counts(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        data = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").encode()]
        want = np.zeros(langid.DIMENSIONS)
        for width in (2, 3, 4):
            for i in range(len(data) - width + 1):
                gram = data[i : i + width]
                if gram[-2:] != [32, 32]:
                    code = int.from_bytes(bytes(gram), "big")
                    want[(code + width) % 2**32 * 2654435761 % 2**32 >> 20] += 1
        assert (row == want).all()


def brute_statistics(text):
    data = (text or "").encode()
    out = dict.fromkeys(quality_gbt.FEATURES, 0.0)
    if not data:
        return out
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", data), [x for x in data.split(b"\n") if x]
    for name, chars in quality_gbt._GROUPS.items():
        out[name] = sum(b in chars for b in data) / len(data)
    known = b"".join(quality_gbt._GROUPS.values())
    out["high"] = sum(b >= 128 for b in data) / len(data)
    out["control"] = sum(b < 32 and b not in known for b in data) / len(data)
    n = max(1, len(words))
    out["log_bytes"], out["log_words"], out["log_lines"] = math.log1p(len(data)), math.log1p(len(words)), math.log1p(data.count(b"\n") + 1)
    out["word_length"], out["longest_word"] = sum(map(len, words)) / n, math.log1p(max(map(len, words), default=0))
    out["distinct_words"], out["most_common_word"] = len(set(words)) / n, max(Counter(words).values(), default=0) / n
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    out["repeated_windows"] = sum(k for k in windows.values() if k > 1) / n
    out["dup_lines"], out["line_words"] = 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(words) / (data.count(b"\n") + 1))
    out["bare_words"] = sum(not re.search(rb"[A-Za-z0-9\x80-\xff]", w) for w in words) / n
    out["capital_words"] = sum(65 <= w[0] <= 90 for w in words) / n
    out["ended_words"] = sum(w[-1:] in (b".", b"!", b"?") for w in words) / n
    return out


def test_statistics_by_brute_force(monkeypatch):
    texts = [t for _, t, *_ in documents()] + ["", "\n\n", " a ", "x\nx\n\nx", "!! ?? 1", "a b c d e a b c d e", "A.\x01é"]
    got = quality_gbt.statistics(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        want = brute_statistics(text)
        assert np.allclose(row, [want[name] for name in quality_gbt.FEATURES]), text
    monkeypatch.setattr(common, "BLOCK", 64)
    monkeypatch.setattr(quality_gbt, "BLOCK", 64)
    assert np.allclose(quality_gbt.statistics(pa.array(texts)), got)


def test_forest_by_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(300) < 0.1)).astype(float)
    one = quality_gbt.fit_forest(x, y, trees=1, depth=1, bins=64, rate=1.0, least=5, ridge=1.0)
    p = y.mean()
    best = None
    for j in range(3):
        for edge in sorted(set(x[:, j])):
            left = x[:, j] <= edge
            if min(left.sum(), (~left).sum()) < 5:
                continue
            gain = sum((y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + 1) for m in (left, ~left))
            best = max(best or (-1,), (gain, j, edge))
    gain, j, edge = best
    assert one.feature[0, 0] == j
    left = x[:, j] <= edge
    assert ((x[:, j] <= one.edge[0, 0]) == left).all()
    for node, m in ((1, left), (2, ~left)):
        assert np.isclose(one.value[0, node], (y[m] - p).sum() / (m.sum() * p * (1 - p) + 1))
    many = quality_gbt.fit_forest(x, y, trees=5, depth=3, least=5)
    for row, got in zip(x, many.probability(x), strict=True):
        total = many.base
        for feature, cut, value in zip(many.feature, many.edge, many.value, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + (1 if row[feature[node]] <= cut[node] else 2)
            total += value[node]
        assert np.isclose(got, 1 / (1 + np.exp(-total)))


def test_svm_separates_and_its_margin_is_right():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 4)).astype(np.float32)
    positive = x[:, 0] + x[:, 2] > 0.3
    w = langid.fit_svm(x, positive, cost=20.0, rounds=3000)
    y = np.where(positive, 1, -1)
    weight = 20 * np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    loss = lambda v: v @ v + 2 * (weight * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()
    assert ((x @ w[:-1] + w[-1] > 0) == positive).mean() > 0.97
    for _ in range(200):  # no step away from the solution lowers the objective
        assert loss(w.astype(float)) <= loss(w + rng.normal(0, 0.05, 5)) + 1e-3


def test_votes_by_brute_force():
    rng = random.Random(9)
    rules = 4
    votes = [tuple(rng.choices((0, 1, 2), (2, 6, 1) if rng.random() < 0.7 else (2, 2, 5), k=rules)) for _ in range(300)]
    code = lambda v: sum(x * 3 ** (rules - 1 - k) for k, x in enumerate(v))
    got = quality_rules.fit_votes(Counter(map(code, votes)), rules, rounds=25)
    prior, rates = 0.85, [[list(side) for _ in range(rules)] for side in quality_rules.BELIEF]
    weight = [max(1.0, 0.2 * len(votes) * x) for x in (0.15, 0.85)]
    posterior = lambda v: 1 / (1 + (1 - prior) / prior * math.prod(rates[0][r][x] / rates[1][r][x] for r, x in enumerate(v)))
    for _ in range(25):  # row by row
        p = [posterior(v) for v in votes]
        new = [[[weight[g] * quality_rules.BELIEF[g][x] + sum((q if g else 1 - q) for q, v in zip(p, votes, strict=True) if v[r] == x) for x in range(3)] for r in range(rules)] for g in (0, 1)]
        prior = (weight[1] + sum(p)) / (len(votes) + sum(weight))
        rates = [[[y / sum(row) for y in row] for row in side] for side in new]
    for v in set(votes):
        assert abs(got.posterior(list(v)) - posterior(v)) < 1e-6


def test_a_rule_that_is_wrong_half_the_time_decides_nothing():
    rng = random.Random(10)
    code = lambda v: sum(x * 3 ** (len(v) - 1 - k) for k, x in enumerate(v))
    counts = Counter()
    for _ in range(4000):
        good = rng.random() < 0.85
        sound = [1 if rng.random() < (0.97 if good else 0.3) else 2 for _ in range(5)]
        counts[code((*sound, rng.choice((1, 2))))] += 1
    model = quality_rules.fit_votes(counts, 6)
    weigh = lambda rule, v: math.log(model.rates[1][rule][v] / model.rates[0][rule][v])
    assert abs(weigh(5, 2)) < 0.75 * min(abs(weigh(r, 2)) for r in range(5))
    assert model.posterior([1, 1, 1, 1, 1, 2]) > 0.5 > model.posterior([2, 2, 2, 1, 2, 1])


def test_quality_rules_verdict(spark):
    rows = rows_of(quality_rules.quality_rules(frame(spark)))
    measured = {(r["doc_id"], r["n_words"]): r for r in rows_of(quality_rules.measures(frame(spark)))}
    plain = lambda x: x.replace("word_chars between 3 * n_words and 12 * n_words", "3 * n_words <= word_chars <= 12 * n_words")
    checks = [(plain(rule.good), plain(rule.bad)) for rule in quality_rules.RULES]
    patterns = [[2 if eval(bad, {}, measured[r["doc_id"], r["n_words"]]) else 1 if eval(good, {}, measured[r["doc_id"], r["n_words"]]) else 0 for good, bad in checks] for r in rows]
    code = lambda v: sum(x * 3 ** (len(v) - 1 - k) for k, x in enumerate(v))
    model = quality_rules.fit_votes(Counter(map(code, patterns)), len(checks))
    for r, v in zip(rows, patterns, strict=True):
        assert (r["n_good"], r["n_bad"]) == (v.count(1), v.count(2))
        assert abs(r["posterior"] - model.posterior(v)) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_fingerprints_of_long_texts(monkeypatch):
    rng = random.Random(11)
    for n in (0, 1, 2, 3, 4, 500):
        text = " ".join(rng.choices(["a", "bb", "c" * 40, "é"], k=n))
        want = brute_fingerprint(text)
        assert simhash.fingerprint(text.encode()) == want
        monkeypatch.setattr(simhash, "byte_pieces", lambda x: common.byte_pieces(x, 10))
        assert simhash.fingerprint(text.encode()) == want
        monkeypatch.undo()


@pytest.mark.parametrize("most", [1, 30, 1000])
def test_hot_subtries_are_marked_by_broadcast_and_by_shuffle(spark, most):
    filed = spark.createDataFrame([(0, i % 7, i) for i in range(700)] + [(1, 5, i) for i in range(300)], "block long, top long, value long")
    hot = spark.createDataFrame([(0, 3, 100, [1, 2]), (1, 5, 300, [4])], "block long, top long, n long, bits array<int>")
    got = Counter((r.block, r.top, tuple(r.bits or ())) for r in simhash._marked(filed, hot, most).collect())
    assert got == Counter({(0, t, (1, 2) if t == 3 else ()): 100 for t in range(7)} | {(1, 5, (4,)): 300})


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
from statweave.llm import bpe, langid, lm_scoring, packing, periodic_runs, quality_gbt, simhash
from statweave.llm.common import by_slices, lower_ascii, text_buffers
line = " ".join("w%x" % (i * 2654435761 % 2**32) for i in range(100_000)) + " "
text = pa.array([line * ((64 << 20) // len(line) + 1), "x" * (16 << 20)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "op1":
    for i in range(2):
        for p in lm_scoring.pieces(text.slice(i, 1)):
            lm_scoring.tokens(*p)
elif sys.argv[1] == "op2":
    data, offsets = text_buffers(text)
    simhash.fingerprint(lower_ascii(data).tobytes())
elif sys.argv[1] in ("op3", "op9", "op13"):
    one = pa.RecordBatch.from_arrays([pa.array([1]), text.slice(0, 1), pa.array([0])], ["doc_id", "text", "part"])
    if sys.argv[1] == "op3":
        assert sum(b.num_rows for b in packing._pieces(1024, 0, None)(iter([one]))) > 10_000
    elif sys.argv[1] == "op9":
        assert bpe.encoder().digests(one.column("text")[0].as_py())[0] > 10_000_000
    else:
        word = next(periodic_runs._words(one, None))
        assert periodic_runs._result([periodic_runs._collapsed(word, periodic_runs.runs_of(word[5]))]).num_rows == 1
elif sys.argv[1] == "op6":
    [quality_gbt.statistics(text.slice(i, 1)) for i in range(2)]
else:
    [langid.vectors(text.slice(i, 1)) for i in range(2)]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op6", "op7", "op9", "op13"])
def test_memory_of_very_long_texts(name):
    import subprocess
    import sys

    got = subprocess.run([sys.executable, "-c", MEMORY, name], capture_output=True, text=True, check=True, timeout=200)
    assert int(got.stdout) < 1000  # MB, for 80 MB of text
