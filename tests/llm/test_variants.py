"""Spelling variants, conversation repair and sharding against plain versions, with the odd cases of each."""

import bisect
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeline.llm import conversations, sharding, spelling, toxicity
from tapeline.llm.registry import ORACLE, QUERIES
from tapeline.llm.wavelet import WaveletTree

LETTERS = "abcé"


@settings(max_examples=60, deadline=None)
@given(st.permutations(list(range(13))), st.lists(st.tuples(*[st.integers(0, 13)] * 4), min_size=1, max_size=6))
def test_ranges_of_a_wavelet_tree(values, queries):
    found = WaveletTree(np.array(values)).report(*(np.array(x) for x in zip(*queries, strict=True)))
    plain = [(q, v) for q, (a, b, low, high) in enumerate(queries) for v in values[a:b] if low <= v < high]
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(plain)


def near(a, b):
    """Exactly one edit apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_forms(counts):
    form, out = {}, {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        out[w] = [form[w], n, len(others), counts[form[w]] if form[w] else None]
    for w, row in out.items():
        root = w
        while form[root]:
            root = form[root]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


@pytest.mark.parametrize("most", [3, 50_000])
def test_forms_equal_all_pairs(spark, most):
    rng = random.Random(most)
    made = {"".join(rng.choice(LETTERS) for _ in range(rng.randint(5, 7))) for _ in range(250)} | {"a" * k for k in range(5, 12)} | {"ab" * 400, "ab" * 400 + "b", "ab" * 399 + "aa"}
    counts = {w: rng.choice([3, 4, 7, 20, 60, 300]) for w in made}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in spelling.spelling_forms(rows, most=most).collect()}
    assert found == plain_forms(counts)


def plain_words(rows):
    total = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def test_words_of_odd_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(LETTERS + "xyzÖß÷") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "9", "漢"]) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    rows += [(None, "Straße straße STRASSE " * 9), (None, None), (50, ""), (51, "\u0000\n 🙂"), (52, "QwErTz" * 90_000), (52, "QwErTz" * 90_000), (53, "QwErTz" * 90_000), (54, "hello world " * 120_000)]
    spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    monkeypatch.setattr(spelling, "COUNTED_BYTES", 2_000)
    found = {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in QUERIES["op11_spelling"](spark, f"file://{tmp_path}").collect()}
    assert found == plain_forms(plain_words(rows))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The least (cost, edits) by trying every edit at every place, with what the edits leave."""
    kind = faults(rows)
    done = {}

    def best(i, state, inserts):
        """From turn i with roles so far in this state of the pattern."""
        if (i, state, inserts) not in done:
            options = [(0, "", ())] if i == len(rows) and state in "0a" else [(10**9, "", ())]
            ways = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
            if inserts < 2:
                cost, edits, left = best(i, ways, inserts + 1)
                options.append((cost + 3, "I" + edits, ((f"{conversations.NAMES[ways]}:"), *left)))
            if i < len(rows):
                role, text = rows[i]
                cost, edits, left = best(i + 1, state, 0)
                options.append((cost + 4, "D" + edits, left))
                if kind[i] not in ("blank", "duplicate"):
                    more = 3 * (kind[i] == "truncated")
                    for to in [ways] + ["s"] * (state == "0"):
                        cost, edits, left = best(i + 1, to, 0)
                        if role[:1] == to:
                            options.append((cost + more, "K" + edits, (f"{role}:{text}", *left)))
                        if to != "s":
                            options.append((cost + more + 3, "R" + edits, (f"{conversations.NAMES[to]}:{text}", *left)))
            done[i, state, inserts] = min(options)
        return done[i, state, inserts]

    return best(0, "0", 0)


def plain_report(rows):
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    kinds, initials = Counter(faults(pairs)), [r[:1] for r, _ in pairs]
    cost, audit, left = plain_repair(pairs)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("segment_rows", [2, 5_000])
def test_repairs_equal_trying_every_edit(spark, segment_rows):
    """Turns are in any partition; with two turns a segment, costs between states decide nearly all."""
    rng = random.Random(segment_rows)
    rows = []
    for c in [None, *range(40)]:
        for turn in rng.sample(range(12), rng.randint(1, 9)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", " ", ""]), rng.choice(["Yes.", "No", " ", "", "What? ", "Well!\n", "漢"]), rng.choice([0, 1, 1, 1, 2])))
    rows += [(90, 1, "user", "Same.", 1)] * 7 + [(90, 1, "assistant", "Good.", 1)] + [(91, 2, "user", "Gone.", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").repartition(3)
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.repaired(frame, segment_rows).collect()}
    by_conv = defaultdict(list)
    for c, turn, role, text, copies in rows:
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        by_conv[c] += [(turn is not None, turn or 0, role, digest, turn, text)] * copies if copies else []
    plain = {c: plain_report([(t, r, x) for _, _, r, _, t, x in sorted(by_conv[c])]) for c in {r[0] for r in rows}}
    assert found == plain and found[91] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_conversations_with_nulls_equal_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(9)]), rng.choice([None, "user", "assistant", "system", "User"]), rng.choice([None, "Yes.", "No", "  ", "a.b? ", "e" * 3_000 + "!"]), 1, "x") for _ in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg int, copies string").repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    query = QUERIES["op12_conversations"](spark, f"file://{tmp_path}")
    found = sorted(str(tuple(r)) for r in query.select("conv_id", *COLUMNS).collect())
    duckdb.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    table = duckdb.execute(f"SELECT conv_id, {', '.join(COLUMNS)} FROM ({ORACLE['op12_conversations']})").fetchall()
    assert found == sorted(map(str, table))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 30)), max_size=80))
def test_balanced_tree_equals_a_sorted_list(steps):
    tree, plain = sharding.Balanced(), []
    for add, x in steps:
        if add and (x, 0) not in plain:
            tree.add((x, 0))
            bisect.insort(plain, (x, 0))
        elif not add and (x, 0) in plain:
            tree.remove((x, 0))
            plain.remove((x, 0))
        k = bisect.bisect_left(plain, (x, -1))
        assert tree.at_least((x, -1)) == (plain[k] if k < len(plain) else None)

    def height(node):
        sides = [height(node[1]), height(node[2])] if node else [0, 0]
        assert abs(sides[0] - sides[1]) < 2
        return 1 + max(sides) if node else 0

    height(tree.root)


def plain_best_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        fits = [(r, k) for k, r in enumerate(room) if r >= s]
        k = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(60, 90), st.integers(1, 9))
def test_packing_equals_a_plain_one(sizes, capacity, shards):
    sizes = sorted(sizes, reverse=True)
    assert sharding.best_fit(sizes, capacity) == plain_best_fit(sizes, capacity)
    found = sharding.packed(sizes, shards)
    assert len(found) == len(sizes) and set(found) <= set(range(shards))
    load = np.bincount(found, weights=sizes, minlength=shards)
    assert load.max() <= max(sizes[0], 2 * sum(sizes) / shards + sizes[0])


def test_shards_of_documents(spark):
    """Copies of a text stay together, slots have no gaps, sizes are nearly equal but for a group above its share."""
    rng = random.Random(2)
    rows = [(i, "word " * rng.choice([0, 1, 3, 10, 40, 200])) for i in range(3_000)] + [(5_000 + i, f"text {i} é" * rng.randint(1, 30)) for i in range(4_000)]
    rows += [(None, None), (None, ""), (7, "again"), (7, "again")] + [(10_000 + i, "the same words in many rows " * 20) for i in range(1_500)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, item string").repartition(5)
    found = sharding.sharded(frame, shards=8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    of, slots, load = {}, defaultdict(list), Counter()
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add(t or "")
    for r in found:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        if len(texts[r["doc_id"]]) == 1:
            text = next(iter(texts[r["doc_id"]]))
            assert of.setdefault(text, r["shard"]) == r["shard"]
    assert set(slots) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    rest = [x for x in load.values() if x not in groups.values()]
    assert load[0] == max(groups.values()) > sum(load.values()) / 8 and len(rest) == 6
    assert max(rest) - min(rest) <= 0.03 * sum(rest) / 6


@pytest.mark.parametrize("name", ["op11_spelling", "op12_conversations", "op13_sharding"])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert QUERIES[name](spark, f"file://{tmp_path}").collect() == []


def test_contract_of_columns(spark):
    kinds = {
        "op11_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
        "op12_conversations": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
        "op13_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    }
    for name, wanted in kinds.items():
        frame = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema) == wanted
        assert frame.where(F.col(wanted.split()[0]).isNull()).isEmpty()


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The operator's query fits the model of toxicity_model() without the driver's hands."""
    documents = spark.createDataFrame([(k, f"word{k % 11} {'bad' if k % 3 else 'good'}") for k in range(300)] + [(None, "none")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, toxic int")
    plain = toxicity.toxicity_model(documents, labels, train=F.lit(True))
    here, driver = toxicity.fit, os.getpid()
    monkeypatch.setattr(toxicity, "fit", lambda many, *x: here(many, *x) if not many or os.getpid() != driver else pytest.fail("fitted in the driver"))
    found = toxicity.toxicity_scorer(documents, labels, train=F.lit(True))
    assert found.bias == plain.bias and np.array_equal(found.row, plain.row) and found.row.any()
    assert toxicity.toxicity_scorer(documents, labels.where("false"), train=F.lit(True)).bias == 0


def test_toxicity_sample_has_a_bound_in_bytes(spark, monkeypatch):
    """One text of a doc_id however many rows it has, none above a size, and no more than the bytes of all."""
    rows = [(1, f"text {k % 7}") for k in range(20_000)] + [(2, "x" * ((1 << 20) + 1))] + [(k, f"word {k} " * 400) for k in range(3, 60)] + [(None, "none"), (60, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 61)], "doc_id long, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda many, y, weight: taken.append((many, y)))
    toxicity.toxicity_model(documents, labels, train=F.lit(True))
    many, y = taken.pop()
    assert len(many) == 59 and sum(t.startswith("text ") for t in many) == 1 and max(map(len, many)) < 1 << 20 and sorted(set(y)) == [0, 1]
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 40_000)
    toxicity.toxicity_model(documents, labels, train=F.lit(True))
    assert 0 < sum(map(len, taken.pop()[0])) <= 40_000
