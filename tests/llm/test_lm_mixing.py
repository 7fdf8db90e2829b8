import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import SF, lowered, no_documents, odd_documents, rows_of
from plumbline.llm import lm_mixing
from plumbline.llm.tables import table


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def base(rows):
    counts = Counter(t for d, text in rows if not held_out(d) for t in [*lowered(text), b"\n"])
    total = sum(counts.values())
    rest = math.log10(total + 0.1 * (len(counts) + 1))
    out = []
    for d, text in rows:
        tokens = [*lowered(text), b"\n"]
        out.append((d, held_out(d), len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(math.log10(counts[t] + 0.1) - rest for t in tokens)))
    return out


def check(found, rows):
    expected = sorted(base(rows), key=lambda r: (repr(r[0]), r[2], r[5]))
    found = sorted(found, key=lambda r: (repr(r[0]), r[2], r[5]))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert all(abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5])) for a, b in zip(found, expected))


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.fixture(scope="module")
def scored(spark):
    return rows_of(lm_mixing.scored(table(spark, SF, "documents")), *COLUMNS)


def test_base_score_is_exact(spark, scored):
    check([r[:6] for r in scored], rows_of(table(spark, SF, "documents"), "doc_id", "text"))


def test_score_is_a_log_probability(scored):
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in scored)


def test_held_out_texts_change_no_other_score(spark, scored):
    docs = table(spark, SF, "documents")
    held = sorted(r[0] for r in scored if r[1])
    other = docs.withColumn("text", F.when(F.col("doc_id") == held[0], F.lit("quite another text " * 50)).otherwise(F.col("text")))
    before, after = ({r[0]: r[6] for r in rows} for rows in (scored, rows_of(lm_mixing.scored(other), *COLUMNS)))
    assert [d for d in before if abs(before[d] - after[d]) > 1e-6 * abs(before[d])] == [held[0]]


def test_learned_text_is_likelier_than_noise(spark):
    rows = [(i, " ".join(f"word{(i + k) % 13} common" for k in range(60))) for i in range(40)]
    held = [r for r in rows if held_out(r[0])]
    noise = [(r[0], "".join(chr(97 + (7 * k * k + k) % 26) if k % 6 else " " for k in range(len(r[1])))) for r in held]
    plain = {r[0]: r for r in rows_of(lm_mixing.scored(spark.createDataFrame(rows, "doc_id long, text string")), *COLUMNS)}
    mixed = [r for r in rows if not held_out(r[0])] + noise
    noisy = {r[0]: r for r in rows_of(lm_mixing.scored(spark.createDataFrame(mixed, "doc_id long, text string")), *COLUMNS)}
    assert held and all(plain[d][6] > 0.2 * noisy[d][6] and plain[d][6] > plain[d][5] for d, _ in held)


def test_odd_rows_and_no_rows(spark):
    docs = odd_documents(spark)
    check([r[:6] for r in rows_of(lm_mixing.scored(docs), *COLUMNS)], rows_of(docs, "doc_id", "text"))
    assert lm_mixing.scored(no_documents(spark)).count() == 0
    only_held_out = spark.createDataFrame([(i, "x y z w v") for i in range(100) if held_out(i)], "doc_id long, text string")
    assert {r[4] for r in rows_of(lm_mixing.scored(only_held_out), *COLUMNS)} == {0}


def test_code_is_a_prefix_code():
    code = lm_mixing.ByteCode(np.arange(256) ** 2)
    words = {tuple(code.bit[f : f + n].tolist()) for f, n in zip(code.first, code.length)}
    assert len(words) == 256 and abs(sum(2.0 ** -len(w) for w in words) - 1) < 1e-12


def test_expected_followers_keep_their_real_share():
    key, follower = np.array([5, 5, 9], np.uint32), np.array([7, 8, 7], np.uint16)
    told = lm_mixing._expected([(key.tobytes(), lm_mixing._packed_counts(np.array(n)), follower.tobytes()) for n in ([4000, 400, 1], [697, 59, 0])])
    odds = [np.frombuffer(x, np.uint32).astype(np.uint16).view(np.float16).astype(float).tolist() for x in told]
    for found in odds:  # 4697 of 5156, for the leader's rows without the own occurrence
        assert abs(found[0] - math.log(4696.3 / 459.3)) < 0.01 and abs(found[1] - math.log(4697.3 / 458.3)) < 0.01
        assert found[2] == 0  # what occurs once and here is expected by nothing


def test_small_errors_and_short_texts_move_weights():
    weights, n = np.full((lm_mixing.GATES, lm_mixing.INPUTS), 0.35, np.float32), 4000
    nothing = np.zeros(n, bool), np.zeros(n, bool), np.zeros((n, 3), np.float32)
    one_bit = np.arange(2), np.full((1, lm_mixing.INPUTS), -3.0, np.float32), np.zeros(1, np.uint8)
    cost = lambda n: lm_mixing._coded_online(np.zeros(n, int), np.array([0, n]), *one_bit, weights, nothing)[0]
    still = math.log1p(math.exp(-0.35 * lm_mixing.INPUTS * 3))
    assert cost(16) == pytest.approx(16 * still, rel=1e-5)
    assert cost(32) < 32 * still * 0.9999  # the second step has learned from the first
    assert cost(n) < n * still * 0.7


def test_shared_beginnings_have_the_inputs_of_whole_words():
    rng = np.random.default_rng(7)
    words = {bytes(rng.choice(list(b"aabc\xc3"), int(n)).tolist()) for n in rng.integers(1, 9, 3000)} | {b"x" * 70_000, b"x" * 70_001}
    spelt = sorted([*lm_mixing.spelled(list(words)), b"\n"])
    code = lm_mixing.ByteCode(np.bincount(np.frombuffer(b"".join(spelt), np.uint8), minlength=256))
    tables = [rng.normal(size=(1 << bits, 2)).astype(np.float16) for bits in lm_mixing.TABLE_BITS]
    many, logits, gate, where = lm_mixing._bit_inputs(spelt, code, tables, piece=500)
    n_bits, slots, bit, place = lm_mixing.coded_bits(spelt, code)
    logs = [t[s].astype(np.float32) for t, s in zip(tables, slots)]
    plain = np.stack([(x[:, 1] - x[:, 0]) * (1 - 2 * bit.astype(np.float32)) for x in logs], 1)
    assert (many == n_bits).all() and len(logits) < 0.6 * len(plain)
    assert (logits[where] == plain).all()
    assert (gate[where] == lm_mixing.gates(place, logs[3][:, 0] > -0.1, logs[3][:, 1] > -0.1)).all()


def some_texts(rng, n_words=300, n_texts=40):
    """Spelled words, ascending, the end after them; texts as places among these; where the texts begin."""
    words = sorted({bytes(rng.choice(list(b"aabc\xc3"), int(n)).tolist()) for n in rng.integers(1, 9, n_words)} | {b"a" * 20 + b"b", b"a" * 20 + b"c"})
    spelt = [*lm_mixing.spelled(words), b"\n"]
    texts = [[*rng.integers(0, len(words), int(n)).tolist(), len(words)] for n in rng.integers(0, 90, n_texts)]
    return spelt, np.concatenate(texts), np.cumsum([0, *map(len, texts)])


def test_tokens_have_their_inputs_in_a_row():
    rng = np.random.default_rng(8)
    spelt, _, _ = some_texts(rng, 3000)
    code = lm_mixing.ByteCode(np.bincount(np.frombuffer(b"".join(spelt), np.uint8), minlength=256))
    tables = [rng.normal(size=(1 << bits, 2)).astype(np.float16) for bits in lm_mixing.TABLE_BITS]
    many, logits, gate, where = lm_mixing._bit_inputs(spelt, code, tables)
    edges = np.cumsum([0, *map(len, spelt)])
    first, found, found_gate = lm_mixing._token_inputs(np.frombuffer(b"".join(spelt), np.uint8), edges, code, tables, piece=500)
    assert (np.diff(first) == many).all() and (found == logits[where]).all() and (found_gate == gate[where]).all()


def test_order_by_beginnings_and_packets():
    words = [b"b", b"a" * 20 + b"b", b"ab", b"a", b"\xc3\xa9", b"a" * 20 + b"c", b"aa", b"a" * 15]
    text, size = lm_mixing._spelled_packet(b" ".join(words))
    assert text.tobytes() == b"".join(lm_mixing.spelled(words)) and size.tolist() == [len(w) + 1 for w in words]
    order = lm_mixing._alphabetic(text, np.cumsum([0, *size]))
    assert sorted(order.tolist()) == list(range(len(words)))
    beginnings = [lm_mixing.spelled(words)[i][:16] for i in order]
    assert beginnings == sorted(beginnings)
    assert len(lm_mixing._alphabetic(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0


def test_online_coding_is_that_of_a_plain_loop():
    rng = np.random.default_rng(9)
    spelt, token, first = some_texts(rng)
    many = rng.integers(1, 30, len(spelt))
    bit_first = np.cumsum([0, *many])
    logits = rng.normal(size=(bit_first[-1], lm_mixing.INPUTS)).astype(np.float32)
    gate = rng.integers(0, lm_mixing.GATES, bit_first[-1]).astype(np.uint8)
    weights = rng.normal(0.3, 0.1, (lm_mixing.GATES, lm_mixing.INPUTS)).astype(np.float32)
    expected, inputs = rng.random(len(token)) < 0.5, rng.normal(size=(len(token), 3)).astype(np.float32)
    hit = expected & (rng.random(len(token)) < 0.5)
    found = lm_mixing._coded_online(token, first, bit_first, logits, gate, weights, (expected, hit, inputs))
    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        cost, own, drift, match = 0.0, weights.astype(float), np.zeros(weights.shape), np.array(lm_mixing.MATCH_WEIGHTS)
        for step in range(lo, hi, lm_mixing.STEP_TOKENS):
            grad, moved = np.zeros(weights.shape), np.zeros(3)
            for t in range(step, min(step + lm_mixing.STEP_TOKENS, hi)):
                if expected[t]:
                    p = 1 / (1 + math.exp(-min(max(match @ inputs[t], -11), 11)))
                    cost -= math.log(p if hit[t] else 1 - p)
                    moved += (hit[t] - p) * inputs[t] / (1, 16, 1)
                for b in range(bit_first[token[t]], bit_first[token[t] + 1]) if not hit[t] else ():
                    odds = math.exp(min(max(own[gate[b]] @ logits[b], -11), 11))
                    cost += math.log(1 + odds)
                    grad[gate[b]] -= odds / (1 + odds) * logits[b]
            match += 0.05 * moved
            drift += grad**2
            own += lm_mixing.RATE * grad / np.sqrt(drift + 25)
        assert found[i] == pytest.approx(cost, rel=1e-5)


def test_pulls_of_bits_in_a_row_are_added_up_first(monkeypatch):
    n, bits, summed, plain = 4000, 40, [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: summed.append(len(x)) or plain(x, *a, **b))
    logits, gate = np.full((bits, lm_mixing.INPUTS), -3.0, np.float32), np.repeat(np.arange(4, dtype=np.uint8), bits // 4)
    weights = np.full((lm_mixing.GATES, lm_mixing.INPUTS), 0.35, np.float32)
    nothing = np.zeros(n, bool), np.zeros(n, bool), np.zeros((n, 3), np.float32)
    lm_mixing._coded_online(np.zeros(n, int), np.array([0, n]), np.array([0, bits]), logits, gate, weights, nothing)
    assert sum(summed) <= n * (1 + 4 * lm_mixing.INPUTS)  # before: an entry for each bit and input
