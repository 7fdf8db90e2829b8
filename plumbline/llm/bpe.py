"""BPE encoding by a table of distinct words, and decoding by a join from ids to pieces.

Spark deals the documents into blocks and splits each into words as the tokenizer would. A block sends
each of its distinct words once, to the range of the word's hash; the task of a range holds the words
of all blocks, encodes each distinct one once, and answers every block with the ids in the order of its
words. The block joins them back by position: word numbers stand where the words stood, and one gather
per document reads the ids. A word that makes a third of the corpus is one entry a block. There is at most one
row for a block and range that has words, so never more rows than distinct words of blocks.

Merges never cross words, so a word's ids do not depend on where it stands. Special tokens found in a
text are entries of the word table too. Decoding is a join from ids to vocabulary pieces; an id is the
row number of its piece, so the join is a gather from a table as large as the vocabulary.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ship import ship

BLOCK_BYTES = 16 << 20
LEAST_BLOCKS = 24
BLOCKS_A_RANGE = 3  # a range gets about as many bytes of words as so many blocks send
_SPECIAL = "\udcff"  # before a special token in the word table; no text holds it
_END = b"\xfe"  # between words; no byte of UTF-8
_WORDS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("words", pa.binary())])
_IDS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_TEXT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

# How the tokenizer file of the default normalises and splits; texts below U+0250 can then be
# split by a regular expression here. Any other file is split by the library alone.
KNOWN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SAME_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
_BYTE = {letter: b for b, letter in _LETTER.items()}
_coders: dict[str, Coder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coder:
    """Words of a text, ids of a word, and pieces of ids, as a ``tokenizers`` file defines them.

    The file must be a BPE model without dropout over byte-level words, its added tokens special and plain
    (no stripping, not normalised), and have no decoder and no post-processor; else ``ValueError``.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = spec.get("added_tokens") or []
        steps = spec["pre_tokenizer"] or {}
        steps = steps["pretokenizers"] if steps.get("type") == "Sequence" else [steps]
        if (
            spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec.get("decoder") or spec.get("post_processor")
            or steps[-1].get("type") != "ByteLevel" or any(s.get("add_prefix_space") for s in steps)
            or any(not t["special"] or t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        ):
            raise ValueError(f"{path}: not a tokenizer whose words can be encoded one by one")
        self.special = {t["content"]: t["id"] for t in added}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(names) + ")") if names else None
        known = (
            spec["normalizer"] == KNOWN_NORMALIZER
            and len(steps) == 2
            and steps[0] == {"type": "Split", "pattern": {"Regex": KNOWN_SPLIT}, "behavior": "Removed", "invert": True}
            and not steps[1].get("use_regex")
        )
        self.split = regex.compile(SAME_SPLIT).findall if known else None
        self.unknown = re.compile("|".join(["[^\x00-ɏ]", *names]))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pieces = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.pieces = pa.array([f"{p} " if p is not None else "" for p in pieces] + [""], pa.large_string())

    def words(self, text: str) -> list[str]:
        """The text's words after normalising, in order; special tokens with a mark before them."""
        if self.split and not self.unknown.search(text):
            return self.split(text.lower())
        out = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(_SPECIAL + part)
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                    out.append(bytes(map(_BYTE.__getitem__, word)).decode())
        return out

    def ids(self, word: bytes) -> list[int]:
        if word[:1] == b"\xff":
            return [self.special[word[1:].decode()]]
        return [token.id for token in self.model.tokenize("".join(map(_LETTER.__getitem__, word)))]

    def text(self, ids: np.ndarray) -> str:
        """The pieces of the ids, one space between them: a gather of the piece table's rows."""
        found = self.pieces.take(pa.array(np.minimum(ids, len(self.pieces) - 1))).buffers()[2]
        return found.to_pybytes().decode()[:-1] if found is not None else ""


def coder_of(path: str) -> Coder:
    """One coder a worker process and file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


class Block:
    """A block's documents as numbers of its distinct words, which are dealt to ranges by their hash."""

    def __init__(self, texts: Iterable[str | None], coder: Coder, ranges: int):
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        self.numbers = []
        for text in texts:
            words = coder.words(text) if text else []
            self.numbers.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.words = [w.encode("utf-8", "surrogateescape") for w in number]
        self.part = np.fromiter((zlib.crc32(w) % ranges for w in self.words), np.int32, len(self.words))
        self.order = np.array(sorted(range(len(self.words)), key=self.words.__getitem__), np.int64)
        self.order = self.order[np.argsort(self.part[self.order], kind="stable")]  # words by range, then by bytes

    def requests(self) -> Iterator[tuple[int, bytes]]:
        edges = np.flatnonzero(np.diff(self.part[self.order], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield int(self.part[self.order[lo]]), _END.join([self.words[i] for i in self.order[lo:hi]])

    def ids(self, answers: list[tuple[int, bytes, bytes]]) -> Iterator[np.ndarray]:
        """Each document's ids, from (range, sizes, ids) of all ranges that the block asked."""
        size, flat = np.zeros(len(self.words), np.int64), []
        edges = np.flatnonzero(np.diff(self.part[self.order], prepend=-1, append=-1))
        for lo, hi, (_, sizes, ids) in zip(edges[:-1], edges[1:], sorted(answers)):
            size[self.order[lo:hi]] = narrow(sizes, hi - lo)
            flat.append(narrow(ids, int(size[self.order[lo:hi]].sum())))
        flat = np.concatenate([np.zeros(0, "<u4"), *flat]).astype("<u4")
        first = np.zeros(len(self.words), np.int64)
        first[self.order] = np.cumsum(size[self.order]) - size[self.order]
        for words in self.numbers:
            n = size[words]
            at = np.repeat(first[words] - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            yield flat[at]


def narrowed(values: np.ndarray) -> bytes:
    """Values in as few bytes each as the largest needs, 1, 2 or 4; ``narrow`` reads them back, told their number."""
    most = int(values.max()) if len(values) else 0
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def narrow(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}") if count else np.zeros(0, "<u4")


def some_at_a_time(column: pa.ChunkedArray, rows: int = 256) -> Iterator[str | None]:
    for lo in range(0, len(column), rows):
        yield from column.slice(lo, rows).to_pylist()


def encoded(docs: DataFrame, tokenizer: str | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of each row of ``docs`` (doc_id, text), as little-endian unsigned 32-bit values.

    ``with_text`` adds what they decode to, as ``decoded`` does, in the same pass.
    Special tokens are not added; those that stand in a text are recognised. A null or empty text has no
    ids. Repeated rows and ids, null ids and very long texts or words each give their row; other columns
    are ignored; an empty table gives none. Rows are dealt by id and text: a group of more than a block's
    bytes is only met where one text is repeated under one id.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    Coder(path)  # refuses other kinds of files before any job runs
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    ranges = -(-blocks // BLOCKS_A_RANGE)
    block = F.pmod(F.xxhash64(F.lit(12), "doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    dealt = docs.select(block, F.col("doc_id").cast("long").alias("doc_id"), "text")

    schema = _TEXT if with_text else _OUT

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        return _rows([(block, *r) for r in Block(some_at_a_time(table["text"]), coder_of(path), ranges).requests()], _WORDS)

    def encode(table: pa.Table) -> pa.Table:
        coder, seen, rows = coder_of(path), {}, []
        for block, part, words in zip(*(table[c].to_pylist() for c in _WORDS.names)):
            found = []
            for word in words.split(_END):
                ids = seen.get(word)
                if ids is None:
                    ids = seen[word] = np.array(coder.ids(word), "<u4").tobytes()
                found.append(ids)
            sizes = np.fromiter(map(len, found), "<u4", len(found)) // 4
            rows.append((block, part, narrowed(sizes), narrowed(np.frombuffer(b"".join(found), "<u4"))))
        return _rows(rows, _IDS)

    def place(table: pa.Table, answers: pa.Table) -> pa.Table:
        coder = coder_of(path)
        block = Block(some_at_a_time(table["text"]), coder, ranges)
        at, doc_ids = 0, table["doc_id"]
        del table
        found, ids, texts, out = list(zip(*(answers[c].to_pylist() for c in ("part", "sizes", "ids")))), [], [], []

        def flush() -> None:
            nonlocal at
            columns = [doc_ids.slice(at, len(ids)).combine_chunks(), pa.array(ids, pa.binary())] + [pa.array(texts, pa.string())] * with_text
            out.append(pa.Table.from_arrays(columns, schema=schema))
            at += len(ids)
            ids.clear()
            texts.clear()

        for values in block.ids(found):
            ids.append(values.tobytes())
            if with_text:
                texts.append(coder.text(values))
            if len(ids) == 256:
                flush()
        flush()
        return pa.concat_tables(out)

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, part int, words binary")
    table = asked.groupBy("part").applyInArrow(encode, "block int, part int, sizes binary, ids binary")
    out = "doc_id long, ids binary" + ", text string" * with_text
    return dealt.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(place, out)


def decoded(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``rows`` (doc_id, ids) with ``text``: the pieces of the ids joined by one space, special ones as well.

    Ids outside the vocabulary have no piece and leave nothing; no or null ids give an empty text.
    """
    ship(rows.sparkSession)
    path = tokenizer or default_tokenizer()

    def join(batches):
        coder = coder_of(path)
        for batch in batches:
            texts = [coder.text(np.frombuffer(ids or b"", "<u4")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=_TEXT)

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(join, "doc_id long, ids binary, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``decoded`` rows."""
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)
