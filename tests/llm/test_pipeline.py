import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline as P
from loopmill.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double"
SYLLABLES = [a + b for a in "bdlmnrst" for b in "aeiou"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(5), []
    for i in range(300):
        text = prose(rng, rng.randint(30, 90))
        if i % 5 == 1:
            text += " " + rng.choice(["scumbag", "worthless", "moronic"]) + " " + rng.choice(["scumbag", "moronic"])
        if i % 7 == 0:
            text += f" mail me{i}@site.example.org now"
        rows.append((i, text, "en", f"s{i % 3}", len(text), 1, 0.5))
    rows += [(1000 + i, rows[2][1], "en", "s0", 9, 1, 0.5) for i in range(5)] + [rows[4]] * 3  # copies and repeated rows
    rows += [(3, prose(rng, 60), "de", "s1", 5, 1, 0.5), (None, prose(rng, 50), None, None, None, 1, 0.5), (None, rows[8][1], "en", "s1", 1, 1, 0.5)]  # an id twice, no id
    rows += [(2000, None, None, "s2", 7, None, None), (2001, "", "en", None, 0, 1, 0.5), (2002, "  ", "en", "s1", 2, 1, 0.5), (2003, prose(rng, 9000), "en", "s2", 9, 1, 0.5)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 == 1), 1) for i in range(300)] + [(None, 1, 1), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def print_of(text):
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def rows_of(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def test_stages_against_brute_force(spark, folder):
    import public_tokenizers
    import tiktoken

    from loopmill.llm import bpe, mixing

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    source = rows_of(docs)
    clean = P.drop_toxic(spark, docs, folder).cache()
    kept = Counter(rows_of(clean))
    insulted = [r for r in source if r[1] and any(w in r[1] for w in ("scumbag", "worthless", "moronic"))]
    assert not kept - Counter(source) and clean.columns == P.COLUMNS
    assert sum(kept[r] > 0 for r in insulted) <= 0.1 * len(insulted) and sum(kept.values()) >= 0.95 * (len(source) - len(insulted))

    one = P.drop_near_copies(spark, clean, folder).cache()
    rows = rows_of(clean)
    label = groups([print_of(r[1]) for r in rows])
    left = Counter(rows_of(one))
    assert sum(left.values()) == len(set(label))
    for g in set(label):
        of = [r for r, x in zip(rows, label) if x == g]
        ids = [r[0] for r in of if r[0] is not None]
        assert any(left[r] for r in of if r[0] == (min(ids) if ids else None))

    safe = P.mask_personal_data(spark, one, folder).cache()
    texts = {(r[0], r[1]) for r in rows_of(safe)}
    assert sum(1 for _ in rows_of(safe)) == sum(left.values()) and not any("@" in (t or "") for _, t in texts)
    assert sum("[email]" in (t or "") for _, t in texts) == sum("@" in (r[1] or "") for r in left)

    mixed = P.mix_sources(spark, safe, folder).cache()
    wanted = {r.doc_id: r.passes_taken for r in mixing.mix(safe).where("doc_id is not null and doc_id <> 3").collect()}
    times = Counter(r[0] for r in rows_of(mixed))
    assert all(times[i] == n for i, n in wanted.items()) and max(times.values()) <= 3 * 2

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in P.encode(spark, mixed, folder).collect())
    want = Counter()
    for i, text, *_ in rows_of(mixed):
        ids = plain.encode_ordinary(text or "")
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want


def test_stages_on_empty_tables(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_query_columns(spark, folder):
    q = queries.QUERIES
    assert q["op2_language"](spark, folder).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert q["op3_simhash"](spark, folder).columns == ["doc_id", "fingerprint", "component_id"]
    assert q["op5_pii"](spark, folder).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert q["op10_toxicity"](spark, folder).columns == ["doc_id", "held_out", "score", "predicted"]
