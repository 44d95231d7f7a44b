"""The training-data operators against brute force, round trips and held-out accuracy, with the odd cases of each."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline.llm import bpe, decontamination, jaccard_join, lattice, media, quality, repeats, secrets_scan, suffixes, token_files, toxicity
from tapeline.llm.shared import held_out, scratch

SF = "/root/testdata/sf0.001"
ODD = [(900, None), (901, ""), (902, "  \n\t"), (903, "é ü 漢字 🙂 " * 30), (904, "one two"), (905, "one two"), (906, "word " * 60_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label string, score int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_classes(rows):
    sets = {}
    for d, text in rows:
        w = words(text)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_classes_equal_all_pairs(spark, docs):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(80)) for _ in range(6)]
    rows = [(i, text) for i, text in enumerate(base)]
    for i in range(60):  # chains of small changes: near copies of near copies
        w = rows[rng.randrange(len(rows))][1].split()
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((100 + i, " ".join(w)))
    rows += ODD
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(frame(spark, rows)).collect()}
    assert found == brute_classes(rows)
    whole = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs).collect()} == brute_classes(whole)


def test_pairs_come_from_the_trees(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = [base]
    for _ in range(400):  # chains of changes, some sets larger, all sharing a block
        own = sets[rng.integers(len(sets))].copy()
        own[rng.integers(0, len(own), rng.integers(1, 60))] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 62, rng.integers(0, 90)).astype(np.uint64)])))
    n = np.array([len(x) for x in sets])
    k, guest = jaccard_join.size_class(n, 80)
    met = set()
    for c in range(k.min() - 1, k.max() + 1):
        own = np.flatnonzero((k == c) | (guest & (k == c + 1)))
        if not len(own):
            continue
        sig = jaccard_join.folded([jaccard_join.signature(sets[i]) for i in own], jaccard_join.signature_bytes(c, 80))
        forest = jaccard_join.SignatureForest(np.arange(len(own)) % 3, n[own], sig, own, k[own] != c)
        for a, b in forest.pairs(80):
            met |= {(min(x, y), max(x, y)) for x, y in zip(own[a], own[b], strict=True)}
            assert (a % 3 == b % 3).all()
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    in_block = {(i, j) for i, j in linked for c in {k[i], k[j]} for own in [np.flatnonzero((k == c) | (guest & (k == c + 1))).tolist()] if i in own and j in own and own.index(i) % 3 == own.index(j) % 3}
    assert in_block and in_block <= met and len(met) < 0.2 * len(sets) ** 2 / 2
    rows = [(i, " ".join(f"w{(i // 4, j) if j % 15 else (i, j)}" for j in range(90))) for i in range(20)]
    assert len({r["component_id"] for r in jaccard_join.jaccard_classes(frame(spark, rows), percent=60).collect()}) == 5


def test_block_leaders_are_first_sets_of_nodes(spark):
    rows = [(t, 8, fp, 300 + fp // 50) for t, many in ((1, 1), (2, 5), (3, 700), (4, 17), (5, 2)) for fp in range(many)] + [(2, 8, 3, 300)]
    blocks = spark.createDataFrame(rows, "token long, k byte, fp long, n int").repartition(5)
    found = defaultdict(dict)
    for r in jaccard_join.shared_blocks(blocks).collect():
        found[r["token"]][r["fp"]] = (r["head"], r["leader"])
    first = lambda i: i if i == 0 else i // 16 * 16 if i % 16 else i // 256 * 256 if i % 256 else 0
    assert found == {t: {i: (0, first(i)) for i in range(many)} for t, many in ((2, 5), (3, 700), (4, 17), (5, 2))}


def brute_repeats(rows, length):
    where = defaultdict(int)
    for _, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            where[b[i : i + length]] += 1
    out = {}
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if where[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = [letters(60) for _ in range(4)]
    rows = [(i, letters(rng.randint(0, 80)) + rng.choice(shared)[rng.randint(0, 20) : rng.randint(35, 60)] + letters(20)) for i in range(80)]
    return [*rows, (200, None), (201, ""), (202, "abab" * 40), (203, "a" * 100), (204, rows[3][1]), (205, "é" * 60), (None, rows[4][1]), (206, "x" + rows[5][1]), (206, rows[6][1])]


def cut(found):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found.collect())


@pytest.mark.parametrize("most", [500, 3])
def test_repeats_equal_brute_force(spark, most):
    rows = repeat_rows()
    found = cut(repeats.without_repeats(frame(spark, rows), length=20, gram=10, by="any", most=most))
    assert found == Counter((rows[i][0], *x) for i, x in brute_repeats([(i, t) for i, (_, t) in enumerate(rows)], 20).items())


def test_repeats_come_from_the_factors(spark, monkeypatch):
    units = np.frombuffer(b"abcdefgh|xbcdefgh|", np.uint8)
    ends = np.repeat([8, 17], 9)
    order = suffixes.Suffixes(units, ends, 20)
    earlier, later = suffixes.factors(order.order, order.shared())
    assert earlier.tolist()[10:17] == [7, 6, 5, 4, 3, 2, 1] and later.tolist()[1:8] == [7, 6, 5, 4, 3, 2, 1] and not earlier[:9].any()
    held = pa.table({"key": [1, 1], "context": [1, 2], "doc_id": [1, 2], "row": [1, 2], "n": [1, 1], "several": [False, False], "low": [-4, -4], "high": [0, 0], "shift": [4, 4], "units": pa.array([b"zabcdefgh", b"yabcdefgh"], pa.binary())})
    layout = repeats.Layout(8, 4)
    assert (repeats.longest(held, layout, "any")[4] == 8).sum() == 2 and (repeats.longest(held, layout, "earlier")[4] == 8).sum() == 1
    monkeypatch.setattr(repeats, "factors", lambda order, shared, least: (np.zeros(len(order), np.int64),) * 2)
    assert not repeats.longest(held, layout, "any")[4].any()


@pytest.mark.parametrize("kind", [np.uint8, np.uint32])
def test_factors_equal_brute_force(kind):
    rng = random.Random(1)
    for _ in range(40):
        strings = [[rng.choice([0, 1, 255]) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 6))]
        strings += strings[: rng.randint(0, 1)]
        lengths = np.array([len(x) + 1 for x in strings])
        last = np.cumsum(lengths) - 1
        order = suffixes.Suffixes(np.concatenate([np.array([*x, 0], kind) for x in strings]), np.repeat(last, lengths), 30)
        owner = np.repeat(np.arange(len(strings)) % 3, lengths)
        earlier, later = suffixes.factors(order.order, order.shared())
        elsewhere = suffixes.factors_elsewhere(order.order, order.shared(), owner)
        places = [(last[k] - len(x) + i, x[i:], k % 3) for k, x in enumerate(strings) for i in range(len(x))]
        common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        for at, own, of in places:
            met = [(p, common(own, x), o) for p, x, o in places]
            longest = [max((m for p, m, o in met if rule(p, o)), default=0) for rule in (lambda p, o: p < at, lambda p, o: p > at, lambda p, o: o != of)]  # noqa: B023
            assert [earlier[at], later[at], elsewhere[at]] == longest


def test_copies_enter_a_suffix_array_once(monkeypatch):
    rng = random.Random(2)
    for _ in range(40):
        strings = [[rng.choice([0, 1, 255]) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 6))]
        twice = np.array([rng.random() < 0.5 for _ in strings])
        both = [x for x, t in zip(strings, twice, strict=True) for _ in range(1 + t)]
        found = []
        for some in (strings, both):
            lengths = np.array([len(x) + 1 for x in some])
            array = suffixes.Suffixes(np.concatenate([np.array([*x, 0], np.uint8) for x in some]), np.repeat(np.cumsum(lengths) - 1, lengths), 30)
            order, shared = array.order, array.shared()
            if some is strings:
                order, shared = suffixes.with_copies(array, shared, lengths, twice)
            found.append([x.tolist() for x in suffixes.factors(order, shared)])
        assert found[0] == found[1]
    sizes, made = [], suffixes.Suffixes
    monkeypatch.setattr(repeats, "Suffixes", lambda units, ends, length: sizes.append(len(units)) or made(units, ends, length))
    held = pa.table({"key": [1], "context": [1], "doc_id": [1], "row": [1], "n": [2], "several": [True], "low": [-4], "high": [0], "shift": [4], "units": pa.array([b"zabcdefgh"], pa.binary())})
    assert (repeats.longest(held, repeats.Layout(8, 4), "any")[4] >= 8).sum() == 4 and sizes == [10]


@pytest.mark.parametrize("n, values", [(300, 3), (300, 90), (9_000, 256)])
def test_first_keys_order_suffixes_as_their_bytes(n, values):
    rng = np.random.default_rng(4)
    ends = np.sort(rng.choice(n - 1, n // 50, replace=False))
    ends = np.append(ends, n - 1)
    units = rng.integers(0, values, n).astype(np.uint8)
    found = suffixes.Suffixes(units, ends[np.searchsorted(ends, np.arange(n))], 30)
    raw = units.tobytes()
    strings = [raw[i : i + left] for i, left in enumerate(found.left)]
    assert [strings[i] for i in found.order] == sorted(strings) and sorted(found.order) == list(range(n))


@pytest.mark.parametrize("below", [50, 1 << 17, 1 << 30])
def test_pairs_of_ranks_are_sorted_with_their_places(below):
    rng = np.random.default_rng(6)
    first, second = rng.integers(0, below, (2, 3_000)).astype(np.int32)
    first[:20], second[:20] = below - 1, below - 1
    key, order = suffixes._sorted(first, second, below)
    assert sorted(order) == list(range(3_000))
    pairs = list(zip(first[order].tolist(), second[order].tolist(), strict=True))
    assert pairs == sorted(pairs) and [a == b for a, b in zip(key, key[1:], strict=False)] == [a == b for a, b in zip(pairs, pairs[1:], strict=False)]


def test_repeats_shuffle_no_text_without_ranges_and_aggregate_by_hash(spark, monkeypatch):
    plans, kept = {}, repeats.written

    def written(rows, tag):
        plans[tag] = rows._jdf.queryExecution().sparkPlan().toString()
        return kept(rows, tag)

    monkeypatch.setattr(repeats, "written", written)
    rows = [(i, t) for i, (_, t) in enumerate(repeat_rows())]
    found = repeats.without_repeats(frame(spark, rows), length=20, gram=10, by="any")
    assert "SortAggregate" not in plans["repeat-contexts"]
    assert "has(row" in found._jdf.queryExecution().optimizedPlan().toString()
    assert cut(found) == Counter((rows[i][0], *x) for i, x in brute_repeats(rows, 20).items())


def test_ranges_are_merged_across_batches(spark):
    rng = random.Random(3)
    ranges = [(rng.randint(1, 9), rng.random() < 0.3, a, a + rng.randint(1, 9)) for a in (rng.randint(0, 400) for _ in range(900))]
    covered = defaultdict(set)
    for row, passage, a, b in ranges:
        covered[row, passage] |= {*range(a, b)}
    touch = {(row, b) for row, passage, a, b in ranges if not passage} & {(row, a) for row, passage, a, b in ranges if not passage}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = repeats._spans(spark.createDataFrame(ranges, "row long, passage boolean, start int, end int").repartition(4)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert touch and sorted(r["row"] for r in found) == sorted({x[0] for x in ranges})
    for r in found:
        spans = list(zip(r["edges"][::2], r["edges"][1::2], strict=True))
        assert {i for a, b in spans for i in range(a, b)} == covered[r["row"], False] and all(b < a for (_, b), (a, _) in zip(spans, spans[1:], strict=False))
        assert r["shared"] == len(covered[r["row"], True])


def test_repeats_of_all_halvings_are_placed_at_once(spark, monkeypatch):
    calls, placed = [], repeats._placed
    monkeypatch.setattr(repeats, "_placed", lambda *x: calls.append(x) or placed(*x))
    rows = [(i, t) for i, (_, t) in enumerate(repeat_rows())]
    found = cut(repeats.without_repeats(frame(spark, rows), length=20, gram=10, by="any", most=2))
    assert found == Counter((rows[i][0], *x) for i, x in brute_repeats(rows, 20).items())
    assert len(calls) == 1


@pytest.mark.parametrize("most", [500, 3])
def test_repeats_keep_the_first(spark, most):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(90))
    found = {r["doc_id"]: r["n_removed"] for r in repeats.without_repeats(frame(spark, [(2, text), (1, text), (3, "z")]), length=20, gram=10, most=most).collect()}
    assert found == {1: 0, 2: 90, 3: 0}
    rows = [(i, t) for i, (_, t) in enumerate(repeat_rows())]
    kept, seen = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in repeats.without_repeats(frame(spark, rows), length=20, gram=10, most=most).collect()}, set()
    for d, t in rows:  # every window is kept once: where it starts first
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 19):
            if raw[i : i + 20] in seen:
                gone[i : i + 20] = b"\1" * 20
            seen.add(raw[i : i + 20])
        assert sum(b - a for a, b in kept[d]) == sum(gone), d


@pytest.mark.parametrize("most", [500, 3])
def test_shared_passages_equal_brute_force(spark, most):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(k) for k in (51, 60, 80, 49, 55)]
    rows = [(i, " ".join(some(rng.randint(0, 30)) + rng.choice(passages)[rng.randint(0, 1) :] + some(5))) for i in range(30)]
    rows += [(100, " ".join(passages[2]).upper().replace(" ", " \n ")), (101, " ".join(some(60) * 2)), (102, None), (103, "a " * 200), (104, rows[0][1]), (104, rows[0][1])]
    places = defaultdict(set)
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 49):
            places[tuple(w[i : i + 50])].add((d, t))
    wanted = {}
    for d, t in rows:
        w, own = words(t), set()
        for i in range(len(w) - 49):
            if places[tuple(w[i : i + 50])] - {(d, t)}:
                own |= {*range(i, i + 50)}
        wanted[d] = len(own)
    found = {r["doc_id"]: r["shared_words"] for r in repeats.without_repeats(frame(spark, rows), most=most, passage=50).collect()}
    assert found == wanted and wanted[101] == 0 and wanted[100] == 80


def test_leaks_find_edited_items(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion."
    items = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    rows = [(1, f"before {item.upper()} after"), (2, "x " + item.replace("fox", "fix").replace("brew", "brews")), (3, item[:30]), *ODD]
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.leaks(frame(spark, rows), items).collect()}
    assert found == {(1, 1): 0, (2, 1): 2}


def brute_leaks(rows, items, share=0.08):
    """(doc, item) pairs by plain edit distance over all places; short items as whole words."""
    clean = lambda t: re.sub(r"\s+", " ", t.lower())
    out = set()
    for i, item in items:
        x = clean(item or "").strip()
        for d, text in rows:
            y = clean(text or "")
            if not x or not y:
                continue
            now = [(0, j) for j in range(len(y) + 1)]  # edits and start of the best alignment that ends here
            for a, c in enumerate(x):
                row = [(a + 1, 0)]
                for j, o in enumerate(y):
                    row.append(min((now[j][0] + (c != o), now[j][1]), (now[j + 1][0] + 1, now[j + 1][1]), (row[j][0] + 1, row[j][1])))
                now = row
            inside = lambda a, b: a > 0 and y[a - 1].isalnum() and y[a].isalnum() or b < len(y) and y[b].isalnum() and y[b - 1].isalnum()  # noqa: E731, B023
            if any(e <= int(share * len(x) + 1e-9) and not (len(x) < 24 and inside(s, j)) for j, (e, s) in enumerate(now) if s < j):
                out.add((d, i))
    return out


def test_leaks_equal_plain_edit_distance(spark):
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcde ") for _ in range(n)).strip() or "a"
    items = [(i, letters(n)) for i, n in enumerate([2, 5, 7, 11, 12, 13, 18, 22, 24, 26, 29, 38, 39, 60, 90])] + [(50, None), (51, "  "), (52, "ABCDE eabc\tdbac ddcba")]
    rows = []
    for d in range(60):
        x = list(rng.choice(items[:15])[1])
        for _ in range(rng.randint(0, max(1, len(x) // 9))):
            k = rng.randrange(len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice(["x", "", "yz"])
        rows.append((d, rng.choice(["", "q ", "qq"]) + "".join(x) + rng.choice(["", " z", "zz", "! "])))
    rows += [(100, "ab"), (101, "abx"), (102, "we say " + items[1][1] + "."), (103, "so abcde  EABC dbac ddcba it is"), *ODD[:4]]
    table = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute_leaks(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame(spark, rows), table).collect()} == wanted and (103, 52) in wanted
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame(spark, rows), table, block=100).collect()} == wanted
    assert decontamination.leaks(frame(spark, rows), table.limit(0)).isEmpty() and decontamination.leaks(frame(spark, rows), table.where("text is null")).isEmpty()


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(frame(spark, [*ODD, (907, "a<|endoftext|>b")]).select("doc_id", "text"))
    found = {r["doc_id"]: r["ids"] for r in bpe.encoded(both, path).collect()}
    text = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    assert all(found[d] == library.encode(t, add_special_tokens=False).ids for d, t in text.items())
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(both, path), path).collect()}
    assert back == text


def test_token_files_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(frame(spark, [(10**6 + d, t) for d, t in ODD]).select("doc_id", "text"))
    place = scratch(spark, "test-tokens")
    token_files.write_token_files(both, place, path, end_id=2)
    start, expected = 0, {}
    for d, t in sorted((r["doc_id"], r["text"] or "") for r in both.collect()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        expected[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, place).collect()} == expected


def test_media_come_back(spark):
    found = {r["doc_id"]: r for r in media.media_features(media.payload_images(frame(spark, ODD))).collect()}
    for d, t in ODD:
        raw = (t or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        assert found[d]["payload_sha256"] == hashlib.sha256(raw).hexdigest() and found[d]["tail_crc32"] == zlib.crc32(raw[-64:])
    image = np.arange(64 * 40, dtype=np.uint8).reshape(40, 64)
    assert (media.decoded(media.to_bmp(image)) == image).all() and (media.decoded(media.to_pgm(image)) == image).all()
    assert media.resized(image, 8, 9).mean() == pytest.approx(image.mean())


def test_lattice_sums_all_segmentations(spark):
    pieces = lattice.Pieces([b"\xe2\x96\x81", b"\xe2\x96\x81a", b"a", b"b", b"ab"], np.log([0.1, 0.2, 0.3, 0.2, 0.2]))
    data = np.frombuffer(b"ab", np.uint8)
    found = lattice.marginals(pieces, data, np.array([0, 2]))[0][0]
    assert np.exp(found) == pytest.approx(0.1 * 0.3 * 0.2 + 0.1 * 0.2 + 0.2 * 0.2)


def test_lattice_of_long_words(spark):
    rng = random.Random(2)
    strings = [b"\xe2\x96\x81", *(bytes([c]) for c in b"abc"), b"ab", b"abc", b"ca", b"\xe2\x96\x81ab", b"bcabca"]
    pieces = lattice.Pieces(strings, np.log(np.array([1, 3, 2, 2, 3, 1, 2, 1, 1]) / 16))
    many = ["".join(rng.choice("abc") for _ in range(n)).encode() for n in (1, 5, 255, 256, 257, 300, 2_000)]

    def plain(word):
        letters = b"\xe2\x96\x81" + word
        alpha = [0.0] + [-np.inf] * len(letters)
        for end in range(1, len(letters) + 1):
            for x, w in zip(strings, pieces.weight, strict=True):
                if letters[:end].endswith(x):
                    alpha[end] = np.logaddexp(alpha[end], alpha[end - len(x)] + w)
        return alpha[-1]

    data, offsets = np.frombuffer(b"".join(many), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in many])])
    found, expected = lattice.marginals(pieces, data, offsets, np.arange(1.0, 8.0))
    assert found == pytest.approx([plain(x) for x in many])
    assert lattice.marginals(pieces, np.frombuffer(b"abz" * 200, np.uint8), np.array([0, 600]))[0][0] == -np.inf
    assert (expected * [len(x) for x in strings]).sum() == pytest.approx(sum((k + 1) * (len(x) + 3) for k, x in enumerate(many)))
    monkey = lattice.LONG
    try:
        lattice.LONG = 0  # every word alone: the same counts
        alone = lattice.marginals(pieces, data, offsets, np.arange(1.0, 8.0))
    finally:
        lattice.LONG = monkey
    assert alone[0] == pytest.approx(found) and alone[1] == pytest.approx(expected)


def test_lattice_of_a_megabyte_without_white_space():
    import public_tokenizers

    pieces = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    word = np.frombuffer(("".join(random.Random(1).choice(["the", "ing", "漢", "q", "0x9f"]) for _ in range(400_000))).encode()[: 1 << 20], np.uint8)
    start = time.perf_counter()
    score = lattice.marginals(pieces, word, np.array([0, len(word)]), np.ones(1))[0][0]
    assert -np.inf < score < 0 and time.perf_counter() - start < 60


def test_base_scores_equal_counts(spark):
    import public_tokenizers

    rows = [(i, f"alpha beta w{i % 5} Gamma") for i in range(40)] + ODD[:5]
    found = {r["doc_id"]: r for r in lattice.lm_scores(frame(spark, rows), public_tokenizers.path("piece_bpe_32k.model"), train=~held_out(7, 2)).collect()}
    learn = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in learn for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for d, t in rows:
        tokens = [*words(t), None]
        assert found[d]["n_tokens"] == len(tokens) and found[d]["n_known"] == sum(w in c for w in tokens)
        assert found[d]["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens))
        assert found[d]["score"] < 0


def auc(pairs):
    ones, zeros = ([s for s, y in pairs if y == k] for k in (1, 0))
    return np.mean([[(a > b) + 0.5 * (a == b) for b in zeros] for a in ones])


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_held_out_accuracy(spark, label):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    if label == "quality":
        scores = quality.quality_scores(documents, labels, train=~held_out(5, 0))
    else:
        scores = toxicity.with_toxicity(documents, toxicity.toxicity_model(documents, labels, train=~held_out(5, 0))).withColumnRenamed("toxicity", "score")
    pairs = [(r["score"], r[label]) for r in scores.where(held_out(5, 0)).join(labels, "doc_id").select("score", label).collect()]
    assert auc(pairs) > 0.85 and all(0 <= s <= 1 for s, _ in pairs)


def test_models_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = frame(spark, ODD)
    assert {round(r["score"], 6) for r in quality.quality_scores(rows, none, train=~held_out(5, 0)).collect()} == {0.5}
    scored = toxicity.with_toxicity(rows, toxicity.toxicity_model(rows, none, train=~held_out(5, 0)))
    assert scored.columns == [*rows.columns, "toxicity"] and scored.where("toxicity <> 0.5").isEmpty()


def test_secrets_are_found_and_prose_is_left(spark):
    forest = secrets_scan.fit_forest(spark)
    rows = [(1, 'api_key = "9f8Kd03jLmQ2xZv7Rt5Yb1Nc4Wp6Sg8H" and more'), (2, "commit 3f786850e387550fdab836ed7e6dc881de23001b fixed the build"), (3, "plain words only, nothing else here"), *ODD]
    found = [(r["doc_id"], r["start"], r["end"]) for r in secrets_scan.secrets(frame(spark, rows), forest).collect()]
    assert found == [(1, 11, 43)]
    clean = {r["doc_id"]: r["text"] for r in secrets_scan.redacted(frame(spark, rows), forest).collect()}
    assert clean[1] == 'api_key = "[SECRET]" and more' and all(clean[d] == t for d, t in rows[1:])


def test_forest_on_unseen_findings(spark):
    forest = secrets_scan.fit_forest(spark)
    fresh = secrets_scan.labelled_findings(1_000, seed=99)
    x = np.array([secrets_scan.features(b.encode()[-48:], c.encode(), a.encode()[:48], p) for b, c, a, p in fresh[["before", "candidate", "after", "path"]].itertuples(index=False)])
    assert ((forest.probability(x) >= 0.5) == fresh["label"]).mean() > 0.95


def test_short_plain_dotted_and_padded_secrets(spark):
    forest = secrets_scan.fit_forest(spark)
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    held = ["Tr0ub4dor3x", "qwhzkvbnmplrtx", "83920174", "p.ss!w@rd$1", jwt, "c2VjcmV0cGFzc3dvcmQxMjM="]
    rows = [(i, f'here password = "{x}" and more') for i, x in enumerate(held)] + [(10, f"see Authorization: Bearer {jwt} end"), (11, "db_password=hunter2, user=bob"), (12, '{"password": "S3cr3t!", "user": "bob"}')]
    clean = {r["doc_id"]: r["text"] for r in secrets_scan.redacted(frame(spark, rows), forest).collect()}
    assert [clean[i] for i in range(6)] == ['here password = "[SECRET]" and more'] * 6
    assert [clean[i] for i in (10, 11, 12)] == ["see Authorization: Bearer [SECRET] end", "db_password=[SECRET], user=bob", '{"password": "[SECRET]", "user": "bob"}']
    found = {r["doc_id"]: (r["start"], r["end"], r["sha256"]) for r in secrets_scan.secrets(frame(spark, rows), forest).collect()}
    assert found == {d: (s := t.index(x), s + len(x), hashlib.sha256(x.encode()).hexdigest()) for (d, t), x in zip(rows, [*held, jwt, "hunter2", "S3cr3t!"], strict=True)}
    harmless = ["password: required field", "the token: string is", 'password = os.getenv("DB_PASSWORD")', 'password = "********"', 'author: "John Smithson"', "access: public and", "see https://www.example.com/foo/bar1 now", 'password = "" or none']
    left = secrets_scan.redacted(frame(spark, list(enumerate(harmless))), forest).orderBy("doc_id").collect()
    assert [r["text"] for r in left] == harmless


def test_secrets_of_each_kind_are_found_among_prose(spark, docs):
    rng = random.Random(77)
    chars = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    lower, alnum = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kinds = {
        "letters": lambda: f'token = "{chars(lower, rng.randint(18, 40))}"', "digits": lambda: f"secret: {chars('0123456789', rng.randint(12, 24))}", "short": lambda: f'password = "{chars(alnum, rng.randint(8, 12))}"', "long": lambda: f"api_key={chars(alnum, rng.randint(20, 48))}",
        "signs": lambda: f"db_password: {chars(alnum + '!@$#%', rng.randint(10, 20))}", "told": lambda: f"the password is {chars(alnum, rng.randint(12, 30))}", "hex": lambda: f'auth_token = "{chars("0123456789abcdef", 40)}"',
    }
    prose = [r["text"] for r in docs.where("length(text) between 200 and 800").orderBy("doc_id").limit(60).collect()]
    rows, planted = [], {}
    for d, (kind, made) in enumerate((k, m) for k, m in kinds.items() for _ in range(40)):
        before, text = rng.choice(prose), made()
        rows.append((d, f"{before}\n{text}\n{rng.choice(prose)}"))
        value = re.split(r'= "|=|: | is ', text)[-1].rstrip('"')
        at = len(before.encode()) + 1 + text.index(value)
        planted[d] = (kind, at, at + len(value))
    met = defaultdict(list)
    for r in secrets_scan.secrets(frame(spark, rows), secrets_scan.fit_forest(spark)).collect():
        met[r["doc_id"]].append((r["start"], r["end"]))
    found = Counter(kind for d, (kind, a, b) in planted.items() if any(x <= a and y >= b for x, y in met[d]))
    assert min(found[k] for k in kinds) >= 36, found


def test_secrets_leave_prose_alone(spark, docs):
    forest = secrets_scan.fit_forest(spark)
    found = secrets_scan.secrets(docs, forest, path_column="source").count()
    assigned = docs.where(F.col("text").rlike(r"(?i)(token|secret|passw|api[_-]?key)[\w.-]*[\"']?\s*[:=]")).count()
    assert found <= assigned + 0.01 * docs.count()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard_join.jaccard_classes(none).count() == 0 and repeats.without_repeats(none).count() == 0
    assert decontamination.leaks(none, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert bpe.encoded(none, bpe.vocabulary_path()).count() == 0


def test_pipeline_keeps_clean_documents(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(ids) > 0.5 * docs.count() / 2
    assert rows.where(F.col("n_tokens") < 0).isEmpty()


ITEMS = ["The quick survey of coastal lighthouses lists forty towers and their keepers in order", "Every third ledger in the archive was bound in green cloth before the great flood came"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with benchmark and labels, and documents of which some have no doc_id or a repeated one."""
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(7)]
    near = lambda i: base[i] + " end"
    rows = [(1, base[0]), (1, near(0)), (2, near(0) + " of"), (None, base[0]), (None, base[1]), (None, near(1)), (3, base[2]), (None, near(2)), (3, base[3]), (3, near(3)), (4, base[3])]
    rows += [(None, None), (None, ""), (None, " \n"), (None, " \n"), (5, base[4]), (5, base[4]), (None, base[5] + " " + ITEMS[0]), (6, base[6]), (6, base[6] + " " + ITEMS[1].replace("green", "grean")), (None, base[5])]
    rows += [(7, base[1][:40] + ' password = "Tr0ub4dor3x" '), (None, base[2][:40] + ' password = "Tr0ub4dor3x" '), (7, base[2][:40])]
    frame = spark.createDataFrame([(d, t, "en", "crawl", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i > 3)) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", rows, frame


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stage_toxicity_decides_each_text(spark, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder, rows, frame = corpus
    scorer = toxicity.toxicity_model(frame, spark.read.parquet(f"{folder}/labels.parquet"), train=~held_out(5, 0))
    alone = lambda t: scorer.probability(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    assert kept(corpus_pipeline.not_toxic(spark, frame, folder)) == Counter(r for r in rows if alone(r[1] or "") < 0.5)


def test_stage_keeps_one_of_each_class(spark, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder, rows, frame = corpus
    found = kept(corpus_pipeline.one_of_each(spark, frame, folder))
    different = sorted(set(rows), key=str)
    classes = defaultdict(list)
    for i, (_, head) in brute_classes([(i, t) for i, (_, t) in enumerate(different)]).items():
        classes[head].append(different[i])
    assert set(found.values()) == {1} and len(found) == len(classes)
    for members in classes.values():
        held = [m for m in members if m in found]
        assert len(held) == 1 and held[0][0] == min((d for d, _ in members if d is not None), default=None)


def test_stage_drops_each_text_with_an_item(spark, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder, rows, frame = corpus

    def edits(item, text):
        row = [0] * (len(text) + 1)
        for x in item:
            above, row = row, [row[0] + 1]
            for j, y in enumerate(text):
                row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        return min(row)

    clean = Counter(r for r in rows if all(edits(i.lower(), (r[1] or "").lower()) > 0.08 * len(i) for i in ITEMS))
    assert len(rows) - clean.total() == 2 and kept(corpus_pipeline.not_leaked(spark, frame, folder)) == clean


def test_stages_of_secrets_and_encoding_keep_each_row(spark, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder, rows, frame = corpus
    clean = corpus_pipeline.without_secrets(spark, frame, folder)
    wanted = Counter((d, t and t.replace("Tr0ub4dor3x", "[SECRET]")) for d, t in rows)
    assert kept(clean) == wanted and clean.where("n_chars <> length(text)").isEmpty()
    back = corpus_pipeline.encoded_and_decoded(spark, frame, folder).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in back) == Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


def test_repeats_keep_keys_whole_above_divided_joins(spark):
    conf = {"autoBroadcastJoinThreshold": "1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "adaptive.skewJoin.skewedPartitionFactor": "1", "adaptive.advisoryPartitionSizeInBytes": "500"}
    rows = [(i, t) for i, (_, t) in enumerate(repeat_rows() * 3)]
    rows = [(i, t if i % 3 else f"{t}{i}{t}") for i, t in rows]
    before = {c: spark.conf.get(f"spark.sql.{c}") for c in conf}
    try:
        for c, value in conf.items():
            spark.conf.set(f"spark.sql.{c}", value)
        found = cut(repeats.without_repeats(frame(spark, rows).repartition(5), length=20, gram=10, by="any", most=3))
    finally:
        for c, value in before.items():
            spark.conf.set(f"spark.sql.{c}", value)
    assert found == Counter((rows[i][0], *x) for i, x in brute_repeats(rows, 20).items())
