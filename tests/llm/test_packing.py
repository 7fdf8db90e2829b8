import json
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from frames import SF, no_documents, odd_documents, rows_of
from plumbline.llm import packing
from plumbline.llm.tables import table


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def held(rows, docs, tokenizer, size=2048):
    """Checks pieces against whole documents and sequences; returns the number of sequences and its lower bound."""
    got = Counter((d, p, s, n, c) for d, p, s, n, c, _, _ in rows)
    expected = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)]
        expected.update((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    assert got == expected
    sequences = {}
    for _, _, _, n, _, q, o in rows:
        sequences.setdefault(q, []).append((o, n))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(sequences), -(-sum(r[3] for r in rows) // size)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_documents(spark, tokenizer):
    docs = table(spark, SF, "documents")
    used, least = held(rows_of(packing.packed(docs), *COLUMNS), rows_of(docs, "doc_id", "text"), tokenizer)
    assert used <= 1.03 * least + 1


def test_odd_rows(spark, tokenizer):
    docs = odd_documents(spark)
    held(rows_of(packing.packed(docs), *COLUMNS), rows_of(docs, "doc_id", "text"), tokenizer)


def test_fast_and_plain_encoder_agree(tokenizer):
    encoder, rng = packing.encoder_of(packing.default_tokenizer()), random.Random(4)
    pieces = ["don't we'll", "  ", "\n", " \n x", "\t", "ÄÖ ß", "1234", "a1b2", "!?", "'s", " ", "\u0085", "日本", "x", " end ", "<|endoftext|>", "\r\n", "\x1c", "é", "²"]
    assert encoder.fast is not None
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "Lowercase"}},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
    {"truncation": {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}},
])
def test_other_files_go_to_the_tokenizer(change, tmp_path):
    from tokenizers import Tokenizer

    spec = json.loads(Path(packing.default_tokenizer()).read_text()) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    plain, encoder = Tokenizer.from_file(str(path)), packing.Encoder(str(path))
    plain.no_truncation()
    assert (encoder.fast is None) == ("truncation" not in change)
    for text in ("Hello World", " Two  words\n", "don't", "日本 End"):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_recipe_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 20_000), rng.geometric(0.004, 20_000).clip(1, 2048), np.full(999, 700), rng.integers(1, 30, 5000), np.append(rng.integers(600, 1500, 3000), 2048), np.array([5])][seed]
    plan, used = packing.recipe(Counter(lengths.tolist())), Counter()
    for kind, times in plan:
        assert sum(kind) <= 2048 and times > 0
        for x in kind:
            used[x] += times
    assert used == Counter(lengths.tolist())
    sequences, least = sum(n for _, n in plan), -(-int(lengths.sum()) // 2048)
    assert sequences <= {2: 500, 4: 1.3 * least}.get(seed, 1.01 * least + 2)


def test_a_million_times_as_many_pieces_have_a_bounded_recipe():
    lengths = Counter(np.random.default_rng(1).integers(1, 2049, 50_000).tolist())
    plan = packing.recipe({k: 1_000_000 * v for k, v in lengths.items()})
    assert len(plan) < 20_000


def test_empty_table(spark):
    assert packing.packed(no_documents(spark)).count() == 0
