"""The byte model against a restatement that goes bit by bit, and its sums over tasks."""

import math
import random

import numpy as np
import pytest

from tallyfold.llm import byte_model as bm

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdeé ") for _ in range(RNG.randint(1, 7))).strip() or "x" for _ in range(150)]
M64 = (1 << 64) - 1
SPREAD = 0x9E3779B97F4A7C15


def text(n):
    return "".join(RNG.choice(WORDS) + RNG.choice([" ", " ", " ", ". ", "\n"]) for _ in range(n)).capitalize().encode()


TEXTS = [text(RNG.randint(0, 300)) for _ in range(40)] + [b"", b"\n", "ß".encode() * 400, b"a" * 700]


def code_of(texts):
    counts = np.zeros((bm.BEFORE, 256), np.int64)
    bm.follower_counts(texts, counts)
    return counts, bm.Code.of(counts)


def model_of(texts, tasks=1, bits=14):
    _, code = code_of(texts)
    sizes = bm.Sizes(bits, bits)
    rows = {}
    for k in range(tasks):
        learner = bm.Learner(code, sizes)
        learner.learn(texts[k::tasks], last=True)
        for table, segment, content in learner.segments():
            rows.setdefault((table, segment), []).append(content)
    return bm.Model.of(code, sizes, {k: bm.finished(k[0], bm.merged(k[0], v)) for k, v in rows.items()})


def contexts(raw, at):
    """The hashes of all predictors before byte ``at`` of a text, in plain integers."""
    data = bytes([bm.END]) * bm.LOOK_BACK + raw
    at += bm.LOOK_BACK
    blanks = b" \n\t\r\x0b\x0c\xff"
    word = next((i + 1 for i in range(at - 1, -1, -1) if data[i] in blanks), 0)
    last = next((i + 1 for i in range(word - 2, -1, -1) if data[i] in blanks), 0)
    before = data[at - 1] * 32 + int(bm._KIND[data[at - 2]])

    def rolled(since, salt):
        h = sum((b + 1) * pow(SPREAD, i, 1 << 64) for i, b in enumerate(data[since:at].lower())) + salt & M64
        return (h ^ h >> 31) * SPREAD & M64

    out = {}
    for kind in (*bm.NODES, *bm.RUNS):
        if kind == "word":
            out[kind] = rolled(max(word, at - bm.WORD_BACK), before)
        elif kind == "words":
            out[kind] = rolled(max(last, at - bm.LOOK_BACK), 0)
        elif kind <= 8:
            out[kind] = int.from_bytes(data[at - kind : at], "little") * SPREAD & M64
        else:
            out[kind] = rolled(at - kind, 0)
    return out, before, at - word


def decisions(code, raw):
    """Contexts, place in the word, rank and its (depth, node, bit) of each byte and the end."""
    for at, byte in enumerate(raw + bytes([bm.END])):
        hashes, before, inside = contexts(raw, at)
        rank = int(code.rank[before, byte])
        yield hashes, before, min((inside + 1) // 2, bm.PLACES - 1), byte, rank, [(j, int(code.node[j, rank]), int(code.bit[j, rank])) for j in range(code.length[rank])]


def slow_score(model, raw):
    """log10 probability of a text, one bit after another."""
    code, total, steps, done, waiting = model.code, 0.0, 0, 0, []
    weights, curvature = np.ones(bm.GROUPS), bm.TEXT_FIRMNESS * np.eye(bm.GROUPS)
    for hashes, before, place, _, rank, bits in decisions(code, raw):
        seen, guess = [], []
        for table, kind in zip(model.tables[len(bm.NODES) :], bm.RUNS):
            h = hashes[kind]
            entry = int(table[h >> 64 - model.sizes.run])
            known = entry >> 16 == (h >> 48 - model.sizes.run & 0xFFFF | 1)
            seen.append(entry & 255 if known else 0)
            guess.append(int(code.rank[before, entry >> 8 & 255]))
        first = next((r for r, n in enumerate(seen) if n), None)
        gate = (0 if first is None else 2 * first + 1 + (seen[first] >= bm.SURE)) * bm.PLACES + place
        for j, node, bit in bits:
            x = []
            for table, kind in zip(model.tables, bm.NODES):
                slot = (hashes[kind] >> 64 - model.sizes.node) ^ int(bm._salts(model.sizes.node)[node])
                x.append((int(table[slot]) - 128) / 16)
            for r, g in enumerate(guess):
                agrees = seen[r] > 0 and all(code.bit[i, g] == code.bit[i, rank] for i in range(j))
                worth = float(model.worth[r, min(j, bm.DEPTHS - 1), bm.RUN_BIN[seen[r]]])
                x.append((worth if code.bit[j, g] == 1 else -worth) if agrees else 0.0)
            x.append(1.0)
            level = min(j, bm.DEPTHS - 1)
            grouped = np.zeros(bm.GROUPS)
            for i, group in enumerate(bm.GROUP_OF):
                grouped[group] += model.weights[level, gate, i] * x[i]
            logit = float(weights @ grouped)
            p = 1 / (1 + math.exp(-max(-12, min(12, logit))))
            waiting.append((grouped, bit, p))
            step = int(max(-8, min(8, logit)) * 2 + 16.5)
            final = p + (float(model.maps[(level * bm.GATES + gate) * bm.MAP_STEPS + step]) - p) / 4
            total += math.log10(max(1e-6, final if bit else 1 - final))
            done += 1
            if done == bm.STEPS[min(steps, len(bm.STEPS) - 1)]:
                curvature = curvature + sum(p * (1 - p) * np.outer(g, g) for g, _, p in waiting)
                weights = weights + np.linalg.solve(curvature, sum((b - p) * g for g, b, p in waiting))
                steps, done, waiting = steps + 1, 0, []
    return total


def test_scores_are_those_of_single_decisions():
    model = model_of(TEXTS)
    texts = [*TEXTS[:6], text(500), b"", b"unseen \x7f!", "日本 é".encode()]
    got = bm.Scorer(model).scores(texts)
    assert got == pytest.approx([slow_score(model, t) for t in texts], rel=2e-3)


def test_texts_are_followed_side_by_side(monkeypatch):
    """Steps are solved for all texts of a batch at once, and a text's score doesn't depend on its neighbours or on the sizes of batches."""
    model = model_of(TEXTS)
    texts, solve, calls = [text(n) for n in (0, 30, 200, 400)] * 10, np.linalg.solve, []
    alone = [bm.Scorer(model).scores([t])[0] for t in texts]
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: calls.append(len(a)) or solve(a, b))
    assert bm.Scorer(model).scores(texts) == pytest.approx(alone, rel=1e-5)
    assert max(calls) >= 10 and len(calls) < len(texts)


def test_every_decision_is_priced_once(monkeypatch):
    """Mixing along a text and the price of its bits share one probability each; before, each was worked out twice."""
    model = model_of(TEXTS)
    texts, priced, plain = [text(n) for n in (0, 30, 200, 400)] * 3, [], bm.probability
    monkeypatch.setattr(bm, "probability", lambda logit: priced.append(logit.size) or plain(logit))
    bm.Scorer(model).scores(texts)
    assert sum(priced) == sum(len(bits) for raw in texts for *_, bits in decisions(model.code, raw))


def test_learning_sorts_bytes_not_decisions(monkeypatch):
    """Bytes are put in order of gates once; their decisions, three times as many, follow that order."""
    _, code = code_of(TEXTS)
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kinds: sorted_.append(len(a)) or argsort(a, *args, **kinds))
    bm.Learner(code, bm.Sizes(14, 14)).learn(TEXTS, last=True)
    assert sum(sorted_) <= sum(len(raw) + 1 for raw in TEXTS)


@pytest.mark.parametrize("size", [500, 10**9])
def test_learning_depends_on_blocks_alone(monkeypatch, size):
    """However many bytes are decided at once, a block is learned as a whole."""
    expected = model_of(TEXTS)
    monkeypatch.setattr(bm, "LEARNED_BYTES", size)
    model = model_of(TEXTS)
    assert all((a == b).all() for a, b in zip(model.tables, expected.tables))
    np.testing.assert_allclose(model.weights, expected.weights, rtol=1e-3, atol=1e-4)


def test_counts_are_those_of_single_decisions():
    _, code = code_of(TEXTS[:8])
    learner = bm.Learner(code, bm.Sizes(20, 20))
    learner.learn(TEXTS[:8], last=True)
    counts = [{} for _ in bm.NODES]
    for raw in TEXTS[:8]:
        for hashes, *_, bits in decisions(code, raw):
            for i, kind in enumerate(bm.NODES):
                for _, node, bit in bits:
                    key = (hashes[kind] >> 64 - 20) ^ int(bm._salts(20)[node])
                    counts[i].setdefault(key, [0, 0])[bit] += 1
    for table, expected in zip(learner.nodes, counts):
        assert set(np.flatnonzero(table).tolist()) == set(expected)
        for slot, pair in expected.items():
            if max(pair) <= bm.MOST:
                assert [int(table[slot]) & 255, int(table[slot]) >> 8] == pair


def test_large_counts_keep_their_ratio():
    table = np.zeros(16, np.uint16)
    for _ in range(40):
        bm._add_counts(table, np.array([6] * 90 + [7] * 10, np.uint32))
    low, high = int(table[3]) & 255, int(table[3]) >> 8
    assert low > 60 and low / high == pytest.approx(9, rel=0.3)


def test_code_is_a_prefix_code_of_ranks():
    counts, code = code_of(TEXTS)
    words = ["".join(str(code.bit[j, r]) for j in range(code.length[r])) for r in range(256)]
    assert len(set(words)) == 256 and sum(2.0 ** -len(w) for w in words) == 1
    for before in np.flatnonzero(counts.sum(axis=1)):
        assert sorted(code.rank[before].tolist()) == list(range(256))
        ordered = counts[before][np.argsort(code.rank[before])]
        assert (np.diff(ordered) <= 0).all()


def test_parts_of_a_text_see_the_bytes_before_them():
    raw = text(400)
    _, code = code_of([raw])
    whole, cut = bm.Batch(list(bm.units(raw)), code), bm.Batch(list(bm.units(raw, 37)), code)
    for a, b in zip([*whole.node_hash, *whole.run_hash, whole.rank, whole.place], [*cut.node_hash, *cut.run_hash, cut.rank, cut.place]):
        assert (a == b).all()


def test_learners_of_tasks_add_up():
    one, four = model_of(TEXTS), model_of(TEXTS, tasks=4)
    held = [text(200) for _ in range(10)]
    # Counts are the same; weights settle in every task anew.
    for a, b in zip(one.tables[: len(bm.NODES)], four.tables):
        assert np.mean(a != b) < 0.01
    size = sum(map(len, held))
    bits = [-bm.Scorer(m).scores(held).sum() / math.log10(2) / size for m in (one, four)]
    assert bits[0] == pytest.approx(bits[1], rel=0.1) and max(bits) < 3


def test_what_stood_before_is_cheap():
    model = model_of(TEXTS, bits=18)
    known, new = TEXTS[0] + TEXTS[1], text(300)
    again, other = bm.Scorer(model).scores([known, new])
    assert again / len(known) > 0.85 * other / len(new)


def test_no_training_text_costs_a_bit_a_decision():
    model = model_of([])
    raw = b"ab"
    bits = sum(len(d[-1]) for d in decisions(model.code, raw))
    assert bm.Scorer(model).scores([raw])[0] == pytest.approx(bits * math.log10(0.5), rel=1e-6)


def test_scores_depend_on_the_table_alone(spark, monkeypatch):
    """Rows dealt in one partition, in seven or backwards, with several learners: the same scores."""
    from pyspark.sql import functions as F

    from tallyfold.llm import context_mixing

    monkeypatch.setattr(context_mixing, "LEARNER_BYTES", 6_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 5"))  # repeated rows
    scores = []
    for dealt in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id")).repartition(3, "text")):
        out = context_mixing.score_documents(dealt, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
        scores.append(sorted((r["doc_id"], r["score"], r["base_score"]) for r in out.collect()))
    for other in scores[1:]:
        assert [r[0] for r in other] == [r[0] for r in scores[0]]
        np.testing.assert_allclose([r[1:] for r in other], [r[1:] for r in scores[0]], rtol=1e-6)
