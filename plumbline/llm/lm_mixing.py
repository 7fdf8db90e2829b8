"""Language-model scores by online logistic context mixing, beside an exact unigram base score.

A text is its tokens: words (A-Z lower-cased), then one end. A word is spelled as its bytes and a
space, the end as one newline, and each byte as the bits of a Huffman code of the training bytes, so
a text's probability is a product of bit probabilities. A bit's predictors are count tables over
hashed contexts: the 1, 2 and 3 bytes before within the token, and the token's whole beginning. Each
gives the logit of its counts; a gate (place in the token, and what has followed its beginning)
selects the weights that combine them, and a logistic function turns the sum into a probability.

Before a token is spelled, a match predictor has its say: the three tokens before it are a hashed
context too, and the token that followed this context most often elsewhere in the training rows is
expected. One more bit tells whether it came; its predictors are the logit of the counts and the
number of expectations met in a row, mixed like the others. If it came, nothing is spelled.
(The expected token is kept as 16 bits of its hash, never 0, so one miss in 65,535 passes for a hit.)

Learning, from training rows only:
* Word counts, exact, by block (see ``blocks``): what is shuffled grows with the corpus's words.
* Followers of three-token contexts, by block too; a training row's own occurrence is taken out.
* Count tables, from the distinct words times their counts. Hashing bounds them: the table size is a
  parameter, not a matter of the input, which is why they may be broadcast.
* First weights: each task moves its own, online, over its share of the distinct words (each bit predicted
  from the counts without one occurrence of its own word), and the tasks' weights are averaged.

Scoring is online: every document starts with these weights and, after each few tokens, moves its own
weights along the gradient of what it has just coded. Nothing of a document changes another's score.
Contexts end at a token's start, so bit inputs are computed once for each distinct word of a block.
Spelled tokens are either a list, or the bytes of all of them with the size of each (``Spelt``).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm.ship import ship
from plumbline.llm.store import stored
from plumbline.llm.words import _BYTE, _LOWER, _powers_up_to, ngram_hashes, text_bytes, words_of

TABLE_BITS = (18, 20, 21, 22)  # 2**bits slots for the contexts of 1, 2, 3 bytes and the whole beginning
INPUTS = len(TABLE_BITS)
GATES = 12
BLOCK_BYTES = 8 << 20  # of text; all bit inputs of a block's distinct words are held at once
PACKET_WORDS = 10_000
STEP_TOKENS = 16
TOGETHER = 256  # documents a numpy step works on, so that its arrays stay in the cache
STEP_WORDS = 500  # distinct words of a step while first weights are learned
CONTEXT = 3
END_HASH = np.uint64(0x5851F42D4C957F2D)
MATCH_WEIGHTS = (0.9, 0.35, -0.6)  # to begin with: logit of the counts, hits in a row, bias
LOW16 = np.uint64(0xFFFF)
RATE = 0.02
SHARD_BITS = 16
PRIOR = 0.15  # added to the counts of zeros and ones
END = 10
ASK = "kind int, block int, part int, words binary, counts binary, followers binary"
TOLD = "kind int, block int, part int, data binary, more binary, n long, v long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log10 double, score double, n_bytes long"
_ASK = pa.schema(
    [("kind", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("followers", pa.binary())]
)
_TOLD = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("known_log10", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()),
    ]
)


Spelt = list[bytes] | tuple[np.ndarray, np.ndarray]


class ByteCode:
    """A Huffman code of the 256 bytes: for each byte the inner nodes on its path and the bits taken."""

    def __init__(self, histogram: np.ndarray):
        heap = [(int(n) + 1, i, i) for i, n in enumerate(histogram)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}
        for inner in range(256, 511):
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            above[left], above[right] = (inner, 0), (inner, 1)
            heapq.heappush(heap, (a + b, inner, inner))
        paths = []
        for symbol in range(256):
            path, at = [], symbol
            while at in above:
                at, bit = above[at]
                path.append((at - 256, bit))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths])
        self.first = np.cumsum(self.length) - self.length
        self.step = np.array([n for p in paths for n, _ in p], np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # of each inner node
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)


def coded_bits(spelled: Spelt, code: ByteCode, shared: bool = False) -> tuple[np.ndarray, ...]:
    """For spelled tokens: each one's number of bits; a table slot for every bit and context; the bits; place in the token.

    With ``shared``, for tokens in ascending order: beginnings that a token shares with the one before it have the
    same contexts and are not worked out again; a fifth array tells for every bit of every token where it stands.
    """
    text, size = _joined(spelled)
    first = np.cumsum(size) - size
    place = np.arange(len(text)) - np.repeat(first, size)
    wide = text.astype(np.uint64)

    def before(k: int) -> np.ndarray:
        shifted = np.zeros(len(text), np.uint64)
        shifted[k:] = wide[: len(text) - k] + np.uint64(1)
        shifted[place < k] = 0
        return shifted

    b = [before(k) for k in (1, 2, 3)]
    value = _BYTE[text] * _powers_up_to(int(size.max()))[place]
    run = np.cumsum(value) - value  # of all bytes before this one
    start = run - np.repeat(run[first], size) + place.astype(np.uint64)
    two = b[0] | b[1] << np.uint64(9)
    contexts = [b[0], two, two | b[2] << np.uint64(18), start]
    many = code.length[text]
    per_token = np.add.reduceat(many, first)
    where = ()
    if shared:
        new, standing = _new_bytes(text, size, first, place)
        begins = np.cumsum(many[new]) - many[new]
        of_byte = begins[np.cumsum(new)[standing] - 1] - (np.cumsum(many) - many)
        standing_bits = np.repeat(of_byte.astype(np.int32), many)
        standing_bits += np.arange(len(standing_bits), dtype=np.int32)
        where = (standing_bits,)
        text, place, many, contexts = text[new], place[new], many[new], [c[new] for c in contexts]
    at = np.arange(many.sum()) + np.repeat(code.first[text] - (np.cumsum(many) - many), many)
    step, bit = np.take(code.step, at, mode="clip"), np.take(code.bit, at, mode="clip")
    slots = []
    for k, bits in enumerate(TABLE_BITS):
        spread = (contexts[k] + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        mixed = np.repeat(spread, many)
        mixed += step
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed >>= np.uint64(64 - bits)
        slots.append(mixed.view(np.int64))
    return per_token, slots, bit, np.repeat(np.minimum(place, 3).astype(np.uint8), many), *where


def _new_bytes(text: np.ndarray, size: np.ndarray, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes of tokens in ascending order: which are not part of the beginning shared with the token before,
    and for each byte the new one that ends the same beginning."""
    previous = np.concatenate([[0], first[:-1]])
    same = place < np.repeat(np.concatenate([[0], size[:-1]]), size)
    other = np.repeat(previous, size) + place
    same &= text[np.where(same, other, 0)] == text
    alike = np.minimum.reduceat(np.where(same, len(text), place), first)
    new = place >= np.repeat(alike, size)
    by_place = np.argsort(place.astype(np.uint16) if len(text) < 1 << 16 or place.max() < 1 << 16 else place, kind="stable")
    last_new = np.maximum.accumulate(np.where(new[by_place], np.arange(len(text)), 0))
    standing = np.empty(len(text), np.int64)
    standing[by_place] = by_place[last_new]
    return new, standing


def spelled(words: list[bytes]) -> list[bytes]:
    return [w if w == b"\n" else w + b" " for w in words]


def _joined(spelt: Spelt) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spelled tokens, and the size of each."""
    if isinstance(spelt, tuple):
        return spelt
    return np.frombuffer(b"".join(spelt), np.uint8), np.fromiter(map(len, spelt), np.int64, len(spelt))


def _spelled_packet(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by single spaces, as spelled tokens."""
    text = np.frombuffer(words + b" ", np.uint8)
    return text, np.diff(np.flatnonzero(text == 0x20), prepend=-1)


def _alphabetic(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The order of tokens by their first 16 bytes, so that shared beginnings stand together."""
    size, keys = np.diff(edges), []
    for lo in (0, 8):
        key = np.zeros(len(size), np.uint64)
        for k in range(lo, lo + 8):
            key <<= np.uint64(8)
            key |= np.where(k < size, np.take(text, edges[:-1] + k, mode="clip"), np.uint8(0))
        keys.append(key)
    return np.lexsort(keys[::-1])


def gates(place: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The weight set of each bit: place in the token, and what the token's beginning was followed by so far:
    nothing, one bit value only, or both."""
    return place * np.uint8(3) + zeros.astype(np.uint8) + ones.astype(np.uint8)


def is_held_out(doc_id: int | None) -> bool:
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _bytes_and_code(docs: DataFrame, held_out) -> tuple[int, ByteCode]:
    """The texts' total bytes, and the code of the training rows' bytes."""

    def count(batches):
        for batch in batches:
            data, edges = text_bytes(batch.column("text"))
            train = np.repeat([not held_out(i) for i in batch.column("doc_id").to_pylist()], np.diff(edges))
            seen = np.bincount(_LOWER[data[train]], minlength=256)
            yield pa.RecordBatch.from_pydict({"byte": np.arange(257), "n": np.append(seen, len(data))})

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    found = {r.byte: r.n for r in rows}
    histogram = np.array([found.get(i, 0) for i in range(256)])
    histogram[[9, 11, 12, 13]] = 0
    histogram[32] += histogram[END]
    return found.get(256, 0), ByteCode(histogram)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending; a place of each; of each entry, which it is. (Unlike np.unique's, the sort need not be stable.)"""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse


def _block_words(table: pa.Table):
    """Words of a block; its distinct hashes and one word each (sorted by hash); each word's place among them."""
    words = words_of(table["text"], lower=True)
    coded = pa.array(words.hash).dictionary_encode()  # words repeat: most need no sort
    found, which = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    inverse = rank[which]
    at = np.empty(len(found), np.int64)
    at[inverse] = np.arange(len(inverse))
    return words, found[order], at, inverse


def _token_hashes(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and where each text begins."""
    return np.insert(words.hash, words.first[1:], END_HASH), words.first + np.arange(len(words.first))


def _tag(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each token's hash, never 0: that stands for what is not learned."""
    return np.maximum(hashes >> np.uint64(48), np.uint64(1))


def _packed_counts(times: np.ndarray) -> bytes:
    """Exact counts, one byte each; those from 255 on follow as 32 bits."""
    return np.minimum(times, 255).astype(np.uint8).tobytes() + times[times >= 255].astype(np.uint32).tobytes()


def _unpacked_counts(data: bytes, n: int) -> np.ndarray:
    times = np.frombuffer(data, np.uint8, n).astype(np.int64)
    times[times == 255] = np.frombuffer(data, np.uint32, -1, n) if len(data) > n else 0
    return times


def _contexts(words, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of tokens with a whole context; each one's context with 16 bits of its own hash (zeros where
    held out, for what follows there is not learned); whether it is learned from."""
    hashes, first = _token_hashes(words)
    sizes = np.diff(first)
    at = np.flatnonzero(np.arange(len(hashes)) - np.repeat(first[:-1], sizes) >= CONTEXT)
    learned = np.repeat(trains, sizes)[at]
    key = ngram_hashes(hashes, CONTEXT)[at - CONTEXT] & ~LOW16
    return at, key | np.where(learned, _tag(hashes[at]), np.uint64(0)), learned


def _expected(rows: list[tuple]) -> list[bytes]:
    """Answers to context requests of one key range, 32 bits an entry: the follower, and the log odds that it
    comes as a half float, from exact counts without the row's own occurrence; 0 if nothing is expected."""
    keys = [np.frombuffer(k, np.uint32).astype(np.uint64) << np.uint64(16) for k, _, _ in rows]
    code = np.concatenate([k | np.frombuffer(f, np.uint16) for k, (_, _, f) in zip(keys, rows)])
    count = np.concatenate([_unpacked_counts(c, len(k)) for k, (_, c, _) in zip(keys, rows)])
    pairs, _, inverse = _distinct(code)
    times = np.bincount(inverse, count, len(pairs)).astype(np.int64)
    context = pairs >> np.uint64(16)
    begins = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    group = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]]))
    total, most = np.add.reduceat(times, begins), np.maximum.reduceat(times, begins)
    leaders = np.flatnonzero(times == most[group])
    leader = leaders[np.unique(group[leaders], return_index=True)[1]][group]  # of each pair's context
    learned = (pairs & LOW16) > 0
    most = most[group] - (learned & (leader == np.arange(len(pairs))))
    rest = np.maximum(total[group] - learned - most, 0)
    odds = np.log((most + 0.3) / (rest + 0.3)).astype(np.float16).view(np.uint16)
    answer = np.where(most > 0, (pairs[leader] & LOW16) << np.uint64(16) | odds, 0).astype(np.uint32)
    found = answer[inverse]
    edges = np.cumsum([0, *map(len, keys)])
    return [found[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]


def _match_inputs(words, trains: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of a block: whether one was expected, whether it came, and the predictors of that."""
    hashes, first = _token_hashes(words)
    at, pairs, _ = _contexts(words, trains)
    told = answers[_distinct(pairs)[2]] if len(at) else np.zeros(0, np.uint32)
    came, some = _tag(hashes[at]) == told >> np.uint32(16), told > 0
    expected, hit, logit = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool), np.zeros(len(hashes), np.float32)
    expected[at[some]], hit[at[some]] = True, came[some]
    logit[at[some]] = (told[some] & np.uint32(0xFFFF)).astype(np.uint16).view(np.float16)
    # Hits in a row before each token, within its text.
    last_miss = np.maximum.accumulate(np.where(hit, -1, np.arange(len(hashes))))
    run = np.arange(len(hashes)) - 1 - np.concatenate([[-1], last_miss[:-1]])
    run = np.minimum(run, np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first)))
    inputs = np.stack([logit, np.minimum(run, 16).astype(np.float32), np.ones(len(hashes), np.float32)], 1)
    return expected, hit, inputs


def _fit_weights(logits: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray, weights: np.ndarray, scale: np.ndarray) -> None:
    """One online step: moves ``weights`` (gate, input) along the gradient of coding ``bit``, in place."""
    p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", weights[gate], logits), -12, 12)))
    err = (bit - p) * (times / max(times.sum(), 1e-9))
    grad = np.stack([np.bincount(gate, err * logits[:, k], GATES) for k in range(INPUTS)], 1).astype(np.float32)
    scale *= 0.95
    scale += 0.05 * grad**2
    weights += 0.02 * grad / np.sqrt(scale + 1e-10)


def _learned(told: DataFrame, code: ByteCode) -> tuple[list[np.ndarray], np.ndarray]:
    """Count tables, as logarithms of the counts of zeros and ones, and the first weights."""
    spark = told.sparkSession
    shards = [1 << max(bits - SHARD_BITS, 0) for bits in TABLE_BITS]
    base = np.cumsum([0, *shards])

    def count(batches):
        """Sums over the rows of a task, so that one task sends one row for each shard at most."""
        tables = [np.zeros(2 << bits) for bits in TABLE_BITS]
        for batch in batches:
            for data, counts in zip(batch.column("data").to_pylist(), batch.column("more").to_pylist()):
                if data:
                    n_bits, slots, bit, _ = coded_bits(_spelled_packet(data), code)
                    times = np.repeat(np.frombuffer(counts, np.uint32).astype(np.float64), n_bits)
                    for k in range(INPUTS):
                        np.add.at(tables[k], slots[k] + (bit.astype(np.int64) << TABLE_BITS[k]), times)
        for k in range(INPUTS):
            for s in range(shards[k]):
                piece = tables[k].reshape(2, -1)[:, s << SHARD_BITS : (s + 1) << SHARD_BITS].astype(np.float32)
                seen = np.flatnonzero(piece.any(0)).astype(np.uint32)
                if len(seen):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([int(base[k]) + s], pa.int32()), "at": [seen.tobytes()], "n": [piece[:, seen].tobytes()]})

    def add_up(table: pa.Table) -> pa.Table:
        sums = np.zeros((2, 1 << SHARD_BITS))
        for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist()):
            sums[:, np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.float32).reshape(2, -1)
        logs = np.log(sums + PRIOR).astype(np.float16)
        return pa.table({"shard": table["shard"][:1], "logs": pa.array([logs.tobytes()], pa.binary())})

    vocabulary = told.where("kind = 2").select("data", "more")
    rows = vocabulary.mapInArrow(count, "shard int, at binary, n binary").groupBy("shard").applyInArrow(add_up, "shard int, logs binary").collect()
    tables = [np.full((1 << bits, 2), np.log(PRIOR), np.float16) for bits in TABLE_BITS]
    for row in rows:
        k = int(np.searchsorted(base, row.shard, "right")) - 1
        logs = np.frombuffer(row.logs, np.float16).reshape(2, -1)
        lo = (row.shard - int(base[k])) << SHARD_BITS
        tables[k][lo : lo + logs.shape[1]] = logs.T[: (1 << TABLE_BITS[k]) - lo]
    shared = spark.sparkContext.broadcast(tables)

    def fit(batches):
        pairs = [t.view(np.uint32).ravel() for t in shared.value]  # the logarithms of both counts, read at once
        with np.errstate(over="ignore", invalid="ignore"):  # of every half float, thus of many that do not occur:
            left = np.exp(np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32))  # the count it is the logarithm of,
            left = np.maximum(np.concatenate([left, left - 1]), np.float32(PRIOR))  # and that without this occurrence
            some = left > 0.9
        weights, scale, seen = np.full((GATES, INPUTS), 0.35, np.float32), np.zeros((GATES, INPUTS), np.float32), 0.0
        for batch in batches:
            for data, counts in zip(batch.column("data").to_pylist(), batch.column("more").to_pylist()):
                (text, size), all_times = _spelled_packet(data), np.frombuffer(counts, np.uint32)
                edges = np.concatenate([[0], np.cumsum(size)])
                for lo in range(0, len(size), STEP_WORDS):
                    times, hi = all_times[lo : lo + STEP_WORDS], min(lo + STEP_WORDS, len(size))
                    n_bits, slots, bit, place = coded_bits((text[edges[lo] : edges[hi]], size[lo:hi]), code)
                    logits = np.empty((len(bit), INPUTS), np.float32)
                    own = bit.astype(np.int64) << 16
                    other = own ^ (1 << 16)
                    for k in range(INPUTS):
                        both = np.take(pairs[k], slots[k], mode="clip").view(np.uint16)
                        zeros, ones = both[::2] + other, both[1::2] + own
                        logits[:, k] = np.log(np.take(left, ones, mode="clip") / np.take(left, zeros, mode="clip"))
                    each = np.repeat(times, n_bits).astype(np.float64)
                    _fit_weights(logits, gates(place, some[zeros], some[ones]), bit, each, weights, scale)
                    seen += each.sum()
        if seen:
            yield pa.RecordBatch.from_pydict({"i": np.arange(weights.size), "w": weights.ravel() * seen, "n": np.full(weights.size, seen)})

    means = vocabulary.mapInArrow(fit, "i long, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()
    weights = np.full(GATES * INPUTS, 0.35, np.float32)
    for row in means:
        weights[row.i] = row.w
    return shared, weights.reshape(GATES, INPUTS)


def _bit_inputs(spelt: Spelt, code: ByteCode, tables: list[np.ndarray], piece: int = 4_000):
    """For spelled tokens in ascending order: each one's number of bits; of every bit of a distinct beginning the
    logits against the value it has, and the gate; for every bit of every token, which of these it is. Worked out
    for some thousand tokens at a time, which bounds the memory of the steps between."""
    many, logits, gate, where, done = [], [], [], [], 0
    pairs = [t.view(np.uint32).ravel() for t in tables]  # the logarithms of both counts, read at once
    text, size = _joined(spelt)
    edges = np.concatenate([[0], np.cumsum(size)])
    for lo in range(0, len(size), piece):
        hi = min(lo + piece, len(size))
        n_bits, slots, bit, place, standing = coded_bits((text[edges[lo] : edges[hi]], size[lo:hi]), code, shared=True)
        part = np.empty((len(bit), INPUTS), np.float32)
        sign = 1 - 2 * bit.astype(np.float32)
        for k in range(INPUTS):
            logs = np.take(pairs[k], slots[k], mode="clip").view(np.float16).astype(np.float32).reshape(-1, 2)
            np.multiply(logs[:, 1] - logs[:, 0], sign, out=part[:, k])
        many.append(n_bits)
        logits.append(part)
        gate.append(gates(place, logs[:, 0] > -0.1, logs[:, 1] > -0.1))
        where.append(standing + np.int32(done))
        done += len(bit)
    return tuple(map(np.concatenate, (many, logits, gate, where))) if len(many) > 1 else (many[0], logits[0], gate[0], where[0])


def _token_inputs(text: np.ndarray, edges: np.ndarray, code: ByteCode, tables: list[np.ndarray], piece: int = 4_000):
    """For tokens text[edges[i]:edges[i + 1]] in ascending order: where each one's bits begin (one more: the end), and
    logits and gate of every bit. Beginnings are shared while these are worked out; then each token has its bits in a row."""
    done, n_bits = 0, int(code.length[text].sum())
    first, logits, gate = np.zeros(len(edges), np.int64), np.empty((n_bits, INPUTS), np.float32), np.empty(n_bits, np.uint8)
    for lo in range(0, len(edges) - 1, piece):
        at = edges[lo : lo + piece + 1]
        many, of_bits, gates_, where = _bit_inputs((text[at[0] : at[-1]], np.diff(at)), code, tables, piece)
        first[lo + 1 : lo + 1 + len(many)] = done + np.cumsum(many)
        np.take(of_bits, where, 0, out=logits[done : done + len(where)], mode="clip")
        np.take(gates_, where, out=gate[done : done + len(where)], mode="clip")
        done += len(where)
    return first, logits, gate


def _coded_online(token: np.ndarray, first: np.ndarray, bit_first: np.ndarray, logits, gate, weights, match) -> np.ndarray:
    """The cost in nats of each text, whose tokens are token[first[i]:first[i + 1]] (places among distinct tokens);
    logits and gate of token t's bits are those from bit_first[t] to bit_first[t + 1].

    All texts of the block move on together, ``STEP_TOKENS`` tokens at a time; each has weights of its own.
    """
    sizes = np.diff(first)
    cost = np.zeros(len(sizes))
    own = np.tile(weights, (len(sizes), 1, 1)).reshape(-1, INPUTS)
    drift = np.zeros(own.shape, np.float32)
    expected, hit, inputs = match
    own_match = np.tile(np.array(MATCH_WEIGHTS, np.float32), (len(sizes), 1))
    by_size = np.argsort(-sizes, kind="stable")
    live, step = len(sizes), 0
    while True:
        while live and sizes[by_size[live - 1]] <= step * STEP_TOKENS:
            live -= 1
        if not live:
            return cost
        docs = by_size[:live]
        for lo in range(0, live, TOGETHER):
            some = docs[lo : lo + TOGETHER]
            begin = first[some] + step * STEP_TOKENS
            many = np.minimum(first[some + 1] - begin, STEP_TOKENS)
            place = np.cumsum(many) - many
            where = np.arange(many.sum()) + np.repeat(begin - place, many)
            doc = np.repeat(np.arange(len(some)), many)
            # The match bit of the tokens that have one.
            asked = expected[where]
            x, y, of = inputs[where[asked]], hit[where[asked]].astype(np.float32), doc[asked]
            z = np.clip(np.einsum("ij,ij->i", own_match[some][of], x), -11, 11)
            p = 1 / (1 + np.exp(-z))
            cost[some] += np.bincount(of, -np.log(np.where(y > 0, p, 1 - p)), len(some))
            moved = np.stack([np.bincount(of, (y - p) * x[:, k] / (1, 16, 1)[k], len(some)) for k in range(3)], 1)
            own_match[some] += (0.05 * moved).astype(np.float32)
            # The bits of the tokens that are spelled.
            spelt_ones = ~hit[where]
            tokens = token[where[spelt_ones]]
            if not len(tokens):
                continue
            many = np.bincount(doc[spelt_ones], minlength=len(some))
            some, many = some[many > 0], many[many > 0]
            place = np.cumsum(many) - many
            n_bits = bit_first[tokens + 1] - bit_first[tokens]
            ends = np.cumsum(n_bits)
            at = np.repeat(bit_first[tokens] - (ends - n_bits), n_bits)
            at += np.arange(ends[-1])
            per_doc = np.add.reduceat(n_bits, place)
            slot = np.repeat(np.arange(0, len(some) * GATES, GATES), per_doc)
            x = np.take(logits, at, 0, mode="clip")
            slot += np.take(gate, at, mode="clip")
            w = own.reshape(-1, GATES, INPUTS)[some].reshape(-1, INPUTS)
            each = np.take(w, slot, 0, mode="clip")
            each *= x
            z = each[:, 0] + each[:, 1]
            z += each[:, 2] + each[:, 3]
            e = np.exp(np.clip(z, -11, 11, out=z), out=z)  # the odds against what came
            odds = 1 + e
            e /= odds
            cost[some] += np.add.reduceat(np.log(odds, out=odds), np.cumsum(per_doc) - per_doc)
            # Some ten bits in a row share a weight set: their pulls are added up before they are dealt to the sets.
            runs = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            for k in range(INPUTS):
                x[:, k] *= e
            pull = np.add.reduceat(x.view(np.complex64), runs, axis=0, dtype=np.complex128).view(np.float64)  # two inputs a number
            of_run = slot[runs]
            grad = np.stack([np.bincount(of_run, pull[:, k], len(w)) for k in range(INPUTS)], 1).astype(np.float32)
            seen = drift.reshape(-1, GATES, INPUTS)[some].reshape(-1, INPUTS) + grad**2
            w -= RATE * grad / np.sqrt(seen + 25)
            own.reshape(-1, GATES, INPUTS)[some] = w.reshape(-1, GATES, INPUTS)
            drift.reshape(-1, GATES, INPUTS)[some] = seen.reshape(-1, GATES, INPUTS)
        step += 1


def scored(docs: DataFrame, held_out=is_held_out) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), with log10 probabilities of the whole text.

    ``held_out`` decides by doc_id which rows the model must not learn from. Base score: the sum over
    tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))), c the token's count, N the number and V the
    distinct number of training tokens. Score: the mixing model's. ``bits_per_byte`` is the model's
    cost of the text's bytes as spelled. Null, empty and wordless texts are an end only; a row
    without an id trains; repeated rows count each; other columns are ignored. Without training
    rows all counts are 0 and both scores come from the smoothing alone.
    """
    ship(docs.sparkSession)
    total, code = _bytes_and_code(docs, held_out)
    parts = B.LEAST_BLOCKS
    while parts * BLOCK_BYTES < total:
        parts *= 2
    dealt = B.dealt(docs, parts)

    def trains(table: pa.Table) -> np.ndarray:
        return np.array([not held_out(i) for i in table["doc_id"].to_pylist()], bool)

    def ask(table: pa.Table) -> pa.Table:
        words, keys, at, inverse = _block_words(table)
        train, block = trains(table), table["block"][0].as_py()
        counts = np.bincount(inverse, np.repeat(train, words.counts), len(keys)).astype(np.uint32)
        rows, (text, edges) = [], words.spaced(at)
        for part, some in B.by_key_range(keys, parts):
            rows.append((0, block, part, text[edges[some.start] : edges[some.stop] - 1].tobytes(), counts[some].tobytes(), None))
        _, pairs, learned = _contexts(words, train)
        pairs, _, place = _distinct(pairs)
        times = np.bincount(place, learned, len(pairs)).astype(np.int64)
        shift = np.uint64(parts.bit_length() - 1)
        for part, some in B.by_key_range(pairs, parts):
            short = ((pairs[some] << shift) >> np.uint64(32)).astype(np.uint32)
            rows.append((1, block, part, short.tobytes(), _packed_counts(times[some]), (pairs[some] & LOW16).astype(np.uint16).tobytes()))
        return B.arrow_rows(rows, _ASK)

    def add_up(whole: pa.Table) -> pa.Table:
        part, rows = whole["part"][0].as_py(), []
        of_contexts = whole.filter(pa.compute.equal(whole["kind"], 1))
        if len(of_contexts):
            found = _expected(list(zip(*(of_contexts[c].to_pylist() for c in ("words", "counts", "followers")))))
            rows += [(3, block, part, data, None, 0, 0) for block, data in zip(of_contexts["block"].to_pylist(), found)]
        table = whole.filter(pa.compute.equal(whole["kind"], 0))
        if not len(table):
            return B.arrow_rows(rows, _TOLD)
        texts = table["words"].to_pylist()
        blobs = words_of(pa.array(texts, pa.binary()), lower=False)
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()])
        _, one_each, inverse = _distinct(blobs.hash)
        sums = np.bincount(inverse, counts, len(one_each)).astype(np.int64)
        capped = np.minimum(sums, 2**32 - 1).astype(np.uint32)
        every = capped[inverse]
        for block, lo, hi in zip(table["block"].to_pylist(), blobs.first[:-1], blobs.first[1:]):
            rows.append((0, block, part, every[lo:hi].tobytes(), None, 0, 0))
        rows.append((1, -1, part, None, None, int(sums.sum()), int((sums > 0).sum())))
        one_each, capped = one_each[sums > 0], capped[sums > 0]
        for lo in range(0, len(one_each), PACKET_WORDS):
            text, edges = blobs.spaced(one_each[lo : lo + PACKET_WORDS])
            rows.append((2, -1, part, text[: edges[-1] - 1].tobytes(), capped[lo : lo + PACKET_WORDS].tobytes(), 0, 0))
        return B.arrow_rows(rows, _TOLD)

    told = stored(B.per_block(dealt, ask, ASK).groupBy("part").applyInArrow(add_up, TOLD), "word-counts")
    rows_trained = docs.select(F.col("doc_id").cast("long")).mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_pydict({"n": pa.array([sum(not held_out(i) for i in b.column(0).to_pylist())], pa.int64())}) for b in batches
        ),
        "n long",
    )
    ends = rows_trained.agg(F.sum("n")).first()[0] or 0
    n_words, v_words = told.where("kind = 1").agg(F.sum("n"), F.sum("v")).first()
    n_train, v_train = (n_words or 0) + ends, (v_words or 0) + (ends > 0)
    shared, weights = _learned(told, code)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        words, keys, at, inverse = _block_words(table)
        told = {k: answers.filter(pa.compute.equal(answers["kind"], k)) for k in (0, 3)}
        known = B.answer_of(told[0], np.uint32).astype(np.float64) if len(keys) else np.zeros(0)
        match = _match_inputs(words, trains(table), B.answer_of(told[3], np.uint32))
        known = np.append(known, ends)  # the end is the last distinct token
        tokens = np.insert(inverse, words.first[1:], len(keys))
        first = words.first + np.arange(len(words.first))
        text, edges = words.spaced(at)
        order = _alphabetic(text, edges)
        rank = np.empty(len(order) + 1, np.int64)
        rank[np.append(order, len(order))] = np.arange(len(rank))
        text, edges = words.spaced(at[order])
        text, edges = np.append(text, np.uint8(END)), np.append(edges, edges[-1] + 1)
        bit_first, logits, gate = _token_inputs(text, edges, code, shared.value)
        cost = _coded_online(rank[tokens], first, bit_first, logits, gate, weights, match)
        log_known, some = np.log10(known + 0.1)[tokens], (known > 0)[tokens]
        spelled_bytes = np.diff(edges)[rank[tokens]]
        rows = zip(
            table["doc_id"].to_pylist(), (not t for t in trains(table)), np.diff(first).tolist(), np.add.reduceat(some.astype(np.int64), first[:-1]).tolist(),
            np.add.reduceat(log_known, first[:-1]).tolist(), (-cost / np.log(10)).tolist(), np.add.reduceat(spelled_bytes, first[:-1]).tolist(),
        )
        return B.arrow_rows([*rows], _RESULT)

    answers = told.where("kind in (0, 3)").select("kind", "block", "part", F.col("data").alias("counts"))
    found = B.with_answers(dealt, answers, score, RESULT)
    smooth = float(np.log10(n_train + 0.1 * (v_train + 1)))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("known_log10") - F.col("n_tokens") * F.lit(smooth)).alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
