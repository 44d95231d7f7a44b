"""Every query of the subpackage on a small folder of odd documents: contract columns and types, one row a document, odd
cases, and plain versions of what SQL can't express."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import lattice, media, quality, toxicity
from tapeline.llm.registry import QUERIES
from tapeline.llm.shared import held_out

CONTRACT = {
    "op2_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_lattice": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}
CLASHING = ["row", "token", "key", "fp", "n", "score", "toxicity", "context", "place", "statistics", "media", "ids", "part", "uid"]


def sentence(rng, n):
    return " ".join(rng.choice(["time", "people", "Way", "day", "man", "thing", "woman", "life", "child", "world", "école", "straße", "idiot", "house"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with null and blank texts, no word breaks, repeated rows, and columns whose names the operators use."""
    path = f"file://{tmp_path_factory.mktemp('odd')}"
    rng = random.Random(9)
    shared = sentence(rng, 90)
    rows = [(i, sentence(rng, rng.randint(1, 120))) for i in range(60)] + [(100 + i, shared + f" tail {i}") for i in range(5)] + [(110, shared), (111, shared)]
    rows += [(120, None), (121, ""), (122, " \n\t "), (123, "x" * 5_000), (124, "漢字" * 900), (125, "🙂é\u0000ü"), (126, 'token = "9f8Kd03jLmQ2xZv7Rt5Yb1Nc4Wp6Sg8H"'), (127, shared), (127, shared), (128, "word " * 40_000)]
    frame = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING))).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(60)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, shared[:200]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path, rows


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}"
    for t in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.fixture(scope="module")
def found(spark, folder):
    done = {}

    def rows(name):
        if name not in done:
            done[name] = QUERIES[name](spark, folder[0]).collect()
        return done[name]

    return rows


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, folder, found, name):
    schema = QUERIES[name](spark, folder[0]).schema
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    assert own.startswith(CONTRACT[name])
    assert Counter(r["doc_id"] for r in found(name)) == Counter(d for d, _ in folder[1])
    columns = CONTRACT[name].replace(",", "").split()[::2]
    assert not any(r[c] is None for r in found(name) for c in columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_missing_ids(spark, folder, tmp_path_factory, name):
    """Rows without doc_id are rows like others (op9 writes them first)."""
    path = f"file://{tmp_path_factory.mktemp('nulls')}"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    spark.createDataFrame([(None, "one two three"), (None, None), (None, "one two three"), (1, "four five")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    rows = QUERIES[name](spark, path).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "None", "None", "None"]


def test_held_out_is_crc32(found):
    for name, modulus, remainder in (("op3_quality", 5, 0), ("op10_toxicity", 5, 0), ("op8_lattice", 7, 2)):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in found(name))
    assert all(r["predicted"] == int(r["score"] >= least) and 0 <= r["score"] <= 1 for name, least in (("op3_quality", 0.3), ("op10_toxicity", 0.5)) for r in found(name))


def test_repeats_and_passages(folder, found):
    for r in found("op2_repeats"):
        text = dict(folder[1])[r["doc_id"]] or ""
        assert r["n_bytes"] == len(text.encode()) and 0 <= r["n_removed"] <= r["n_bytes"]
        if r["doc_id"] in (110, 111, 127):
            assert r["n_removed"] == r["n_bytes"] and r["shared_words"] == 90
        if r["doc_id"] in (120, 121, 122, 124, 125, 126):
            assert r["shared_words"] == 0


def plain_means(image, height, width):
    """Area means by going over each sample's overlap with each target pixel."""
    h, w = image.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            top, bottom, left, right = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            total = 0.0
            for y in range(int(top), min(h, int(np.ceil(bottom)))):
                for x in range(int(left), min(w, int(np.ceil(right)))):
                    total += image[y, x] * (min(bottom, y + 1) - max(top, y)) * (min(right, x + 1) - max(left, x))
            out[i, j] = total / ((bottom - top) * (right - left))
    return out


def test_media_digests_and_features(folder, found):
    texts = dict(folder[1])
    for r in found("op6_media"):
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(payload) <= 2048:
            image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
            small = np.round(plain_means(image, 8, 9), 6)
            digest = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
            tile = np.clip(np.round(plain_means(image, media.TILE, media.TILE)), 0, 255)
            assert r["feature"].split(":")[0] == digest and np.abs(tile - np.clip(np.round(media.resized(image, media.TILE, media.TILE)), 0, 255)).max() <= 1


def test_whole_texts_by_a_plain_lattice(spark, folder, found):
    """Base counts by a plain count; the score as a sum of plain log-sums over each word's segmentations."""
    import public_tokenizers

    texts = folder[1]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    learn = [t for d, t in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in learn for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    documents = spark.read.parquet(f"{folder[0]}/documents.parquet")
    counts = lattice.word_counts(documents, ~held_out(7, 2))
    pieces, end = lattice.trained(counts, lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model")), c[None])
    weight = dict(zip(pieces.strings, pieces.weight, strict=True))

    def plain(word):
        letters = "▁".encode() + word.encode()
        alpha = [0.0] + [-np.inf] * len(letters)
        for e in range(1, len(letters) + 1):
            for s in range(max(0, e - pieces.lengths[-1]), e):
                if (w := weight.get(letters[s:e])) is not None:
                    alpha[e] = np.logaddexp(alpha[e], alpha[s] + w)
        return alpha[-1]

    own = {}
    for d, t in dict(texts).items():
        tokens = words(t)
        if len(tokens) < 130 and all(len(w) < 200 for w in tokens):
            own[d] = (sum(plain(w) for w in tokens) + end) / np.log(10)
    for r in found("op8_lattice"):
        tokens = [*words(dict(texts)[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in c for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens))
        if r["doc_id"] in own:
            assert r["score"] == pytest.approx(own[r["doc_id"]])


def test_trees_by_plain_traversal(folder):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < 0)).astype(np.float64)
    trees = quality.fit_trees(x, y, rounds=30, depth=3)

    def plain(row):
        odds = trees.base
        for feature, threshold, leaves in zip(trees.feature, trees.threshold, trees.leaves, strict=True):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            odds += leaves[node - (len(leaves) - 1)]
        return 1 / (1 + np.exp(-odds))

    score = trees.probability(x)
    assert score[:50] == pytest.approx([plain(r) for r in x[:50]]) and ((score > 0.5) == y).mean() > 0.95


def test_toxicity_score_by_a_plain_mean():
    many = ["you idiot go away", "what a lovely day", "idiots are here", "the house is old", "such an idi0t", "a good friend"] * 10
    y = np.array([1, 0, 1, 0, 1, 0] * 10)
    scorer = toxicity.fit(many, y, np.ones(len(y)), steps=60)

    def plain(text):
        total, words = 0.0, re.findall(r"[a-z0-9']+", text.lower())
        for w in words:
            raw = np.frombuffer(w.encode(), np.uint8)
            rows, many_rows = toxicity.subwords(raw, np.array([0, len(raw)]))
            assert many_rows[0] == 1 + sum(max(0, len(w) + 2 - k + 1) for k in toxicity.GRAMS)
            total += float(scorer.row[rows].astype(np.float64).mean())
        return 1 / (1 + np.exp(-(scorer.bias + (total / len(words) if words else 0.0))))

    for text in ["you idiot", "IDIOTIC thing", "lovely house", "", "idi0t!! house"]:
        data = np.frombuffer(text.encode(), np.uint8)
        assert scorer.probability(data, np.array([0, len(data)]))[0] == pytest.approx(plain(text), abs=1e-6)
    data = [np.frombuffer(t.encode(), np.uint8) for t in ("idiotic", "lovely")]
    assert scorer.probability(data[0], np.array([0, len(data[0])]))[0] > scorer.probability(data[1], np.array([0, len(data[1])]))[0]


def test_clashing_columns_are_errors(spark):
    rows = spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, toxicity double")
    with pytest.raises(ValueError, match="toxicity"):
        toxicity.with_toxicity(rows, toxicity.Scorer(0.0, np.zeros(1 << toxicity.BUCKET_BITS, np.float32)))
    with pytest.raises(ValueError, match="dhash"):
        media.media_features(spark.createDataFrame([(1, b"", "x")], "doc_id long, media binary, dhash string"))
