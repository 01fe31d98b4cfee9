import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopmill.llm import ann, bpe, chat, common, langid, mixing, pii, quality, repeats, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, n_words long, score double"
LONG = " ".join(f"word{i}" for i in range(6000))
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, "Hello there, you", "en", "a"), (3, "Hello there, you", "en", "a"), (None, "no id here at all", "en", None), (4, LONG, "de", "b"), (5, LONG + " tail", "de", "b"), (6, "x" * 3000, "fr", "a"), (7, "1234 !!", None, "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, 2, 0.5) for i, t, lang, s in ROWS], DOCS).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality(docs, none):
    got = quality.judge(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept and by[4].kept and by[4].n_words == 6000
    assert quality.judge(none).count() == 0


def test_quality_rejects_hosts_that_mostly_fail(spark):
    """Two hosts of nine failing documents in ten: their sound documents go too; a host of one document isn't rejected for it."""
    sound, symbols = " ".join(f"word{i}" for i in range(40)), " ".join(f"#w{i}$" for i in range(40))
    lines = "\n".join(["the same line of words again"] * 3 + [f"line {i} says something else {i * 7}" for i in range(4)])
    rows = [(i, sound, f"good{i % 7}") for i in range(700)]
    rows += [(1000 + i, sound if i % 10 == 0 else symbols, "signs") for i in range(60)]
    rows += [(2000 + i, sound if i % 10 == 0 else lines, None) for i in range(60)]  # without a host: a host of its own
    rows += [(3000, symbols, "once"), (3001, "# " * 100_000 + sound, "good1"), (3002, None, "good1"), (3002, None, "good1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_words": F.lit("x"), "host": F.lit("good0"), "kept": F.lit(0)})
    got = quality.judge(df)
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert not any(by_id[i].kept for i in by_id if 1000 <= i < 3000) and all(by_id[i].host_rejected for i in by_id if 1000 <= i < 3000)
    assert not by_id[1000].base_failed and not by_id[2000].base_failed  # sound by themselves
    assert by_id[3000].kept and all(by_id[i].kept for i in range(700))
    assert by_id[3001].base_failed and by_id[3001].n_words == 100_040 and by_id[3002].base_failed and not by_id[3002].host_rejected


def test_repeat_words_against_brute_force(spark):
    random.seed(1)
    rows = [(i, " ".join(random.choice("ab") for _ in range(random.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n for r in df.select("doc_id", quality.repeat_words(common.words(F.col("text"))).alias("n")).collect()}
    for i, t in rows:
        w = t.split()
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        assert got[i] == len({j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)})


def test_language(docs, none):
    model = langid.fit(docs)
    got = langid.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 7)} == {"und"}
    assert langid.fit(none) is None and langid.predict(docs, None, ["doc_id"]).where("lang_pred <> 'und'").isEmpty()
    assert langid.predict(none, model, ["doc_id"]).count() == 0


def linked(values):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= simhash.BITS:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_simhash_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # large buckets are dealt out in blocks
    random.seed(3)
    seeds = [random.getrandbits(64) for _ in range(6)]
    values = list(dict.fromkeys([s ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))) for s in seeds for _ in range(25)]))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = {r.node: r.component for r in common.components(edges).collect()}
    root = linked(values)
    groups, want = {}, {}
    for v, r in zip(signed, root):
        groups.setdefault(found.get(v, v), set()).add(v)
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_pigeonring_passes_all_links():
    rng = random.Random(5)
    d = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(2000)], np.uint64)
    assert simhash.passes_chains(d).all()


def test_simhash_rows(docs, none):
    got = simhash.classes(docs, ["doc_id"]).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].fp == 0 and by[2].component_id == 1 and by[5].component_id == 4
    assert simhash.classes(none, ["doc_id"]).count() == 0


PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def test_bpe_like_tiktoken(docs, none):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in bpe.tokenize(docs, path, PATTERN, ["doc_id", "text"]).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    coder, rng = bpe.codec(path, PATTERN), random.Random(2)
    for _ in range(500):
        t = "".join(rng.choice(["a", "the", " ", "\n", "é", "日", "😀", "1", "!!", "'s", "zz", "tion"]) for _ in range(30))
        ids = np.frombuffer(coder.encode(t), "<u4")
        assert ids.tolist() == plain.encode_ordinary(t) and "".join(coder.decode(ids, 3)) == t
    assert bpe.tokenize(none, path, PATTERN).count() == 0


def test_pii_patterns_and_masking(docs, none):
    t = "mail a.b@c.de, 10.0.0.1, 999.1.1.1, 4111 1111 1111 1111, +1 (415) 555-2671"
    spans, failed = pii.base_spans(t)
    assert [t[a:b] for _, a, b in sorted(spans)] == ["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+1 (415) 555-2671"] and failed
    assert pii.masked_text(t, spans) == "mail [email], [ip], 999.1.1.1, [card], [phone]"
    got = {r.doc_id: r for r in pii.detect(docs, None, ["doc_id"]).collect()}
    assert got[1].masked is None and got[1].n_email == 0 and got[4].masked == LONG
    assert pii.detect(none, None, ["doc_id"]).count() == 0


def test_pii_network_learns():
    rng = random.Random(1)
    texts = [f"some words {rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)} and x{i}@mail.org or {i * 7} more" for i in range(300)]
    net = pii.train(texts[:250])
    hit = 0
    for t in texts[250:]:
        x = pii.classes_of(t)
        starts = pii.window_starts(x, t)
        found = pii.added_spans(t, *pii.reconciled(len(t), starts, *net.decode(pii.windows(x, starts))), [])
        hit += len(set(found) & set(pii.base_spans(t)[0]))
    assert hit >= 80  # of 100


class Labeller:
    """Labels one passage as a span of one kind."""

    def __init__(self, text, passage, kind):
        self.y = np.zeros(len(text) + 2 * pii.WINDOW, np.int8)
        a = text.index(passage)
        self.y[a : a + len(passage)] = 2 + 2 * kind
        self.y[a] = 1 + 2 * kind
        self.starts = pii.window_starts(pii.classes_of(text), text)

    def decode(self, x):
        y = self.y[self.starts[:, None] + np.arange(pii.WINDOW)]
        return y, np.ones(y.shape, np.float32)


@pytest.mark.parametrize("passage,kind,added", [("bob.25(at)mail6(dot)org", 0, True), ("46[.]35[.]149[.]125", 1, True), ("4111.1111.1111.1111", 2, True), ("(216) 555-4155", 3, True), ("99.1.1.1", 1, False)])
def test_pii_failed_matches_block_their_own_kind_only(passage, kind, added):
    text = "some words and " + ("9" if not added else "") + passage + " then more words"
    base, every = next(pii.spans_of([text], Labeller(text, passage, kind)))
    a = text.index(passage)
    assert base == [] and every == ([(kind, a, a + len(passage))] if added else [])


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, 10, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10]) & set(got[q].values()))
    assert len(got) == 75 and hit / 750 >= 0.9
    assert ann.neighbours(df.limit(0), 10, F.lit(True)).count() == 0


def test_ann_completes_scattered_queries_beside_copies(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 16))
    x = np.vstack([centres[rng.integers(5, size=1940)] + rng.normal(scale=0.001, size=(1940, 16)), rng.normal(size=(60, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(2000)
    ids[:150] = 1990  # many rows of one query's own id
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    queries = [*range(1940, 1990, 2), 200, 201]
    got = {}
    for r in ann.neighbours(df, 20, F.col("vec_id").isin(queries)).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hit = []
    for q in queries:
        s = np.sort((x @ x[q])[ids != q])[::-1]
        assert len(got.get(q, [])) == 20
        hit.append(np.mean(np.array(sorted(got[q], reverse=True)) >= s[19] - 1e-9))
    assert np.mean(hit[:25]) >= 0.9
    few = spark.createDataFrame([(1, [1.0, 0.0])] * 300 + [(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in ann.neighbours(few, 5, F.expr("vec_id = 1 and v[0] = 2")).collect()} == {2, 3}


def repeats_by_brute_force(rows):
    """Counter of (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    want = Counter()
    seen = {k: Counter(b[s : s + k] for _, b in raw for s in range(len(b) - k + 1)) for k in (repeats.LENGTH, repeats.SHORT)}
    for i, b in raw:
        gone = {k: np.zeros(len(b), bool) for k in seen}
        for k in seen:
            for s in range(len(b) - k + 1):
                if seen[k][b[s : s + k]] > 1:
                    gone[k][s : s + k] = True
        g = gone[repeats.LENGTH]
        want[(i, len(b), int(g.sum()), len(repeats.runs(g)), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest(), int(gone[repeats.SHORT].sum()))] += 1
    return want


@pytest.mark.parametrize("shard", [3, 10, 1024])
def test_merged_transforms_find_repeated_starts(monkeypatch, shard):
    monkeypatch.setattr(repeats, "SHARD", shard)
    rng = np.random.default_rng(shard)
    middle = [rng.integers(97, 99, 700, dtype=np.uint8).tobytes() for _ in range(3)]
    texts, n, m, anchor, group = [], [], [], [], []
    for i in range(40):
        g, before, after = i % 4, int(rng.integers(0, 200)), int(rng.integers(280, 600))
        part = middle[g % 3][300 - before : 300 + after]
        cut = int(rng.integers(0, len(part)))
        part = part[:cut] + bytes([rng.integers(97, 99)]) + part[cut + 1 :]
        starts = min(before + 1, len(part) - repeats.SHORT + 1)
        texts.append(part)
        n.append(starts)
        m.append(max(0, min(starts, len(part) - repeats.LENGTH + 1)))
        anchor.append(before)
        group.append(g)
    want = np.zeros((40, max(n)), bool), np.zeros((40, max(n)), bool)
    for table, limit, size in ((want[0], n, repeats.SHORT), (want[1], m, repeats.LENGTH)):
        for i in range(40):
            for s in range(limit[i]):
                for j in range(40):
                    k = anchor[j] - anchor[i] + s
                    if i != j and group[i] == group[j] and 0 <= k < limit[j] and texts[i][s : s + size] == texts[j][k : k + size]:
                        table[i, s] = True
    got = repeats.repeated_starts(texts, *map(np.array, (n, m, anchor, group)))
    assert want[0].any() and want[1].any() and (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_anchors_in_chunks(monkeypatch):
    data = np.random.default_rng(3).integers(97, 100, 5000, dtype=np.uint8)
    whole = [x for part in repeats.anchors(data) for x in zip(*part)]
    monkeypatch.setattr(repeats, "CHUNK", 700)
    parts = [x for part in repeats.anchors(data) for x in zip(*part)]
    at = lambda rows: {(start + i, int(key), start + anchor) for key, _, place in rows for start, n, anchor in [repeats.unpacked(int(place))] for i in range(n)}
    assert at(whole) == at(parts) and len(at(whole)) == 5000 - repeats.SHORT + 1


@pytest.mark.parametrize("block", [2048, 6])
def test_repeats_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(160))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 200))) + passage[rng.randint(0, 90) : rng.randint(300, 800)] + word()) for i in range(25)]
    rows += [(30, "ab " * 400), (31, None), (32, rows[0][1]), (32, rows[0][1]), (33, "short"), (34, "short"), (None, rows[1][1] + "!"), (35, "x" + passage[:285] + "y"), (36, "\0" * 300), (37, "a" + "\0" * 500)]
    got = Counter(tuple(r) for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string"), digests=True).drop("kept").collect())
    assert got == repeats_by_brute_force(rows)


def test_chat_round_trip(spark):
    rows = [(1, 0, "us:er\n", "a\\"), (1, 1, None, "###"), (1, 2, "x", "\n</turn>\n### a: b"), (None, None, None, None), (2, 0, "assistant", "####\\\\</turn></turn>"), (2, 0, "assistant", "####\\\\</turn></turn>")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.where("not same").isEmpty() and {r.conv_id: len(r.turns) for r in got.collect()} == {1: 3, None: 1, 2: 2}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got) and mixing.mix(none).count() == 0
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 3]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 50 for r in sums)
    assert mixing.mixed_rows(df, ["doc_id"]).count() == mixing.mix(df).agg(F.sum("passes_taken")).first()[0]


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    vowel, rest = (lambda: rng.choice("aeiou")), (lambda: rng.choice("bdlnrst"))
    vocabulary = [vowel() + rest() + vowel() + rest() + vowel() for _ in range(300)]
    clean = lambda: rng.choices(vocabulary, k=30)
    rows, labels = [], []
    for i in range(400):
        w = clean()
        if i % 2:
            w[3] = rng.choice(["moron", "scumbag", "worthless"])
            w[9] = rng.choice(["moron", "scumbag", "worthless"])
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert sum((got[i] >= 0.5) == (i % 2) for i in range(300, 400)) >= 95
    odd = spark.createDataFrame([(1, "ala m o r o n ebe wor.thless"), (2, "ala ebe ono")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(odd, model, ["doc_id"]).collect()}
    assert s[1] > s[2]
    assert toxicity.score(docs, model, ["doc_id"]).count() == len(ROWS) and toxicity.score(none, None, ["doc_id"]).count() == 0
    assert toxicity.fit(none, lab.limit(0)) is None


def gap_weighted(a: str, b: str) -> float:
    """The exact kernel of two words between their marks, by dynamic programming over prefixes."""
    a, b, d = f"<{a}>", f"<{b}>", toxicity.DECAY
    inner = [[1.0] * (len(b) + 1) for _ in range(len(a) + 1)]  # of subsequences shorter by one, weighed to the prefixes' ends
    for _ in range(toxicity.ORDER - 1):
        new = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                met = d * d * inner[i - 1][j - 1] if a[i - 1] == b[j - 1] else 0.0
                new[i][j] = met + d * new[i - 1][j] + d * new[i][j - 1] - d * d * new[i - 1][j - 1]
        inner = new
    return sum(d * d * inner[i][j] for i in range(len(a)) for j in range(len(b)) if a[i] == b[j])


def test_toxicity_kernel_against_dynamic_programming():
    rng = random.Random(8)
    # with its marks a word of five letters fills the widest span, so no subsequence of it is left out
    found = ["".join(rng.choices("abc", k=n)) for n in (2, 3, 4, 5) for _ in range(25)]
    feature, dense = toxicity.Subsequences(), np.zeros((len(found), 1 << toxicity.HASH_BITS), np.float32)
    for i, w in enumerate(found):
        code, value = feature([w])
        np.add.at(dense[i], code[0], value[0])
    got = dense @ dense.T
    own = [gap_weighted(w, w) for w in found]
    want = np.array([[gap_weighted(a, b) / np.sqrt(own[i] * own[j]) for j, b in enumerate(found)] for i, a in enumerate(found)])
    assert np.abs(got - want).max() < 1e-5 and (want > 0.1).sum() > len(found)


def test_toxicity_scores_beyond_the_word_table(monkeypatch):
    weights = np.random.default_rng(1).normal(size=1 << toxicity.HASH_BITS).astype(np.float32)
    vocabulary = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfer", "hotel", "india", "juliet", "kilogram"]
    texts = ["", "12 34", "alpha bravo", "charlie delta alpha", " ".join(vocabulary), "alpha", "hotel india echoes golfer foxtrot juliet", "alpha bravo charlie kilogram"]
    bags = [toxicity.words_of(t) for t in texts]
    want = toxicity.WordScores(weights, 0.1).features_of(bags)
    monkeypatch.setattr(toxicity, "MAX_WORDS", 5)
    words = toxicity.WordScores(weights, 0.1)
    assert np.allclose(words.features_of(bags[2:3]), want[2:3]) and np.allclose(words.features_of(bags), want)
    assert len(words.known) <= 5


def test_toxicity_fit_reads_one_text_an_id(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "fit_in_task", lambda rows, make, kind: taken.extend(rows.collect()))
    df = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(1, "text 0"), (2, None), (3, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    toxicity.fit(df, lab)
    assert [r.text for r in taken][1:] == ["", "x"] and taken[0].text.startswith("text ") and [r.toxic for r in taken] == [1, 0, 0]


def test_toxicity_of_short_words_and_long_texts():
    rng = random.Random(6)
    vocabulary = [a + b + c for a in "aeiou" for b in "lnrst" for c in "aeiou"]
    texts = [" ".join(rng.choices(vocabulary, k=20) + ["zgk"] * (i % 2)) for i in range(200)]
    model = toxicity.Model(texts, [i % 2 for i in range(200)])
    x = toxicity.WordScores(model.weights, model.bias).features_of([t.split() for t in ("ala ene", "ala ene zgk", "ala ene z*gk")])
    assert x[1, 0] > 0 and x[2, 0] > 0 and x[0, 0] < x[1, 0]
    many = toxicity.WordScores(np.zeros(1 << toxicity.HASH_BITS, np.float32), 0.5)  # every word scores above 0
    text = " ".join("w" + "".join(rng.choices("abcdefgh", k=9)) for _ in range(600))
    n = len(toxicity.words_of(text))
    assert n > 500 and np.isclose(many.features_of([toxicity.words_of(text)])[0, 3], np.sqrt(n / (n + 10)))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    big = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 7), ("z", 8)], "k string, i int")
    small = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    got = Counter((r.k, r.v) for r in common.join_small(big, small, "k").collect())
    assert got == {("a", 1): 50, (None, 2): 1, ("z", None): 1}


def test_ann_finds_neighbours_in_tight_clusters_and_among_long_vectors(spark):
    rng = np.random.default_rng(5)
    tight = rng.normal(size=(6, 64))[rng.integers(6, size=6000)] + 0.01 * rng.normal(size=(6000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(tight)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, 20, F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    share = []
    for i, ids in found.items():
        agree = tight @ tight[i]
        agree[i] = -np.inf
        share.append(len(ids & set(np.argsort(-agree)[:20].tolist())) / 20)
    assert len(share) == 120 and np.mean(share) > 0.99
    # a long vector that the sample lacks shows its cell
    long = np.zeros((1, 8)); long[0, 0] = 90.0
    x = rng.normal(size=(400, 8))
    index = ann.Index(x, np.arange(400), 16, long, np.array([999]))
    seen = index.probes(x[:50], np.arange(50), np.ones(50, int), 1, np.full(16, 1000), None)
    assert all(index.long_cells[0] in cells for cells in seen)


def test_no_table_of_fingerprints_or_salted_rows_is_broadcast(spark, monkeypatch):
    """Spark takes exploded rows for as few as they were before: a fingerprint's sixty keys, a small table once for each salt."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    prints = common.materialize(spark.range(40).select(F.xxhash64("id").alias("fp")), "prints")
    texts = common.materialize(spark.createDataFrame([(i, f"some words of text {i % 3} and more") for i in range(9)], "doc_id long, text string"), "texts")
    small = common.materialize(spark.createDataFrame([(i, i) for i in range(3)], "doc_id long, v int"), "small")
    made = [simhash.links(prints), simhash.classes(texts, ["doc_id"]), simhash.one_of_each(texts, ["doc_id", "text"]), common.join_small(texts, small, "doc_id")]
    assert not any("Broadcast" in plan(df) for df in made)
    assert [df.count() for df in made[1:]] == [9, 3, 9]


def test_the_mix_broadcasts_no_histogram(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # the one table that is broadcast on purpose
    docs = spark.createDataFrame([(i, f"some words of text {i}", f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    slim = common.materialize(mixing.slim_rows(docs), "slim")
    goals = slim.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("target", F.lit(60.0))
    found = mixing.thresholds(slim.select("source", "size", "h"), goals)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3
