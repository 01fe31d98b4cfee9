"""Fill-in-middle, spelling variants and MinHash near-dedup against plain versions of their rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopmill.llm import common, infill, minhash, variants

DOCS = "doc_id long, text string, lang string, n long, form string, output string, word string, digest string, component_id long, kept boolean"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \n "), (4, "Hello there, you and you and you"), (4, "Hello there, you and you and you"), (None, "no id here at all, none"), (None, "no id here at all, none"), (5, LONG), (6, LONG + " tail"), (7, "x" * 3000), (8, "takes <S> a mark"), (9, "  two  spaces\tand a tab \n"), (4, "another text under the same id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "f", "o", "w", "d", 5, True) for i, t in ROWS], DOCS).cache()


def test_infill_against_the_rule(docs):
    got = infill.infill(docs, ["doc_id", "text", "n", "form"]).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    rows = got.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i or 0, t or "") for i, t in ROWS)
    forms = set()
    for r in rows:
        text = r.text or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50
        form = "plain" if plain else "spm" if h4 % 100 < 80 else "psm"
        want = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        assert (r.n, r.form, r.output, r.back) == (len(units), form, want, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (len(pre), len(mid)))
        forms.add(form)
    assert infill.infill(docs.limit(0), ["doc_id"]).count() == 0 and len(forms) > 1


def test_infill_of_every_form_comes_back(spark, monkeypatch):
    monkeypatch.setattr(infill, "PORTION", 40)  # texts are handled a few at a time
    random.seed(2)
    texts = ["".join(random.choice("ab é😀<P S>M\n\t ") for _ in range(random.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = infill.infill(df, ["doc_id"], rate=100).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == texts[r.doc_id] for r in rows) and {r.form for r in rows} == {"plain", "spm", "psm"}


def variants_by_rule(rows):
    n, low = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {a: [b for b in words if a != b and abs(len(a) - len(b)) < 2 and variants.one_edit(a, b)] for a in words}
    best = {a: min(near[a], key=lambda b: (-words[b], b), default=None) for a in words}
    form = {a: b if b and words[b] >= 2 * words[a] else None for a, b in best.items()}
    out = set()
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out.add((a, form[a], root, words[a], len(near[a]), words[form[a]] if form[a] else None))
    return out


def variants_of(df):
    return [tuple(r) for r in variants.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_one_edit():
    assert variants.one_edit("abcde", "abde") and variants.one_edit("abcde", "abxde") and variants.one_edit("aab", "ab")
    assert not variants.one_edit("abcde", "abcde") and not variants.one_edit("abcde", "abc") and not variants.one_edit("abcde", "badce")


def test_variants_against_all_pairs(spark):
    random.seed(4)
    words = ["".join(random.choice("aabÀé") for _ in range(random.randint(5, 8))) for _ in range(150)]
    pick = lambda: random.choices(words, [1.05**i for i in range(150)])[0]
    rows = [(random.choice([None, *range(40)]), " ".join(pick().upper() if k % 5 == 0 else pick() for k in range(90))) for _ in range(80)]
    got = variants_of(spark.createDataFrame(rows, "doc_id long, text string"))
    want = variants_by_rule(rows)
    assert len(got) == len(set(got)) and set(got) == want and any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_variants_of_long_words_and_odd_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(variants, "LONG", 7)  # words at the limit meet on both ways, pairs must count once
    random.seed(5)
    base = ["".join(random.choice("ab") for _ in range(n)) for n in (6, 7, 8, 9, 12)]
    more = {b[:k] + c + b[k + d :] for b in base for k in range(len(b)) for c in ("", "x") for d in (0, 1)}
    rows = [(i, " ".join(sorted(more | set(base)))) for i in range(4)]
    assert set(variants_of(spark.createDataFrame(rows, "doc_id long, text string"))) == variants_by_rule(rows)
    assert set(variants_of(docs)) == variants_by_rule(ROWS)
    assert variants_of(docs.limit(0)) == []


def test_variants_of_a_very_long_word(spark):
    random.seed(6)
    a = "".join(random.choice("abcdefgh") for _ in range(20_000))
    rows = [(i, f"{a} {a[:9000] + a[9001:]} {a[:15000]}z{a[15001:]}") for i in range(8)]
    got = {r[0]: r for r in variants_of(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[a][4] == 2 and got[a[:9000] + a[9001:]][4] == 1


def near_by_rule(rows):
    low = {i: i + 32 for i in range(65, 91)} | {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").translate(low).split(" ") if x]
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(least[root(i)], default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and c == d))
    return Counter(out)


def near_of(df):
    return Counter(tuple(r) for r in minhash.classes(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_duplicates_of_odd_rows(docs):
    assert near_of(docs) == near_by_rule(ROWS)
    assert not near_of(docs.limit(0))


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # large groups are dealt out by pairs of blocks
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 20_000)
    random.seed(7)
    word = lambda: random.choice("abcdefghij") + str(random.randint(0, 400))
    texts = []
    for n in (12, 30, 60, 200, 400):
        now = [word() for _ in range(n)]
        for _ in range(40):
            # a family that drifts: neighbours are near, ends aren't
            texts.append(" ".join(now))
            now = list(random.choice([now, texts[-1].split()]))
            for _ in range(random.randint(0, max(1, n // 60))):
                now[random.randrange(len(now))] = word()
            if random.random() < 0.2:
                now.insert(random.randrange(len(now)), word())
    texts += ["Some few words", "some  FEW\twords", "some few", "one"] + random.sample(texts, 10)
    rows = [(random.choice([i, i, i, 7, None]), t) for i, t in enumerate(random.sample(texts, len(texts)))]
    want = near_by_rule(rows)
    assert near_of(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert any(not r[3] for r in want)


def test_chunks_find_each_pair_within_the_threshold():
    rng = np.random.default_rng(8)
    assert minhash.MOST // minhash.CHUNKS == 1 and minhash.CHUNKS * 2 > minhash.MOST
    for _ in range(300):
        x = rng.integers(0, 65536, minhash.SYMBOLS).astype("<u2")
        y = x.copy()
        for k in rng.permutation(minhash.SYMBOLS)[: minhash.MOST]:
            y[k] ^= 1
        a, b = minhash.keys_of(np.stack([x, y]))
        assert (a == b).any()


def test_members_of_a_hub(spark):
    edges = [(1000, i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2100)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(300)} == {0} and found[1000] == 0 and {found[i] for i in range(2000, 2101)} == {2000}
