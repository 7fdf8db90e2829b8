"""Self-join of documents on the Jaccard similarity of their word n-gram sets: a prefix-tree join.

1. Sets that cannot have a partner leave first. A partner at similarity t shares at least t * n of a
   set's n shingles, so a set with fewer shingles that occur in a second set is alone. Occurrences
   are counted over the whole corpus, by block (see ``blocks``).
2. Equal sets become one class; only one set of a class goes on, and step 1 is repeated on classes,
   which leaves the near copies.
3. Shingles get one global order, rarest first. Two sets over the threshold share one of their first
   n - ceil(t * n) + 1 shingles, so sets joined through such shingles form clusters, and links stay
   within clusters. The order puts shingles that many documents share last, out of these prefixes.
4. A cluster's sets meet in a prefix tree, most frequent shingles first, so that near copies share
   long paths. A set walks the tree once: the overlap with a path is shared by all sets below it, and
   a subtree is left when even the shingles that remain on both sides cannot reach the threshold, or
   when all its sets are already in the walker's component. In a cluster over a size limit each set
   is compared with one leader first; the families so linked and the rest are dealt into chunks, and
   pairs of chunks, but those of one family, meet in a task each: no group has to fit into one task,
   and a very large family of near copies costs linear time.
5. Links found become components. All counting is exact integer arithmetic on 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm.components import components
from plumbline.llm.store import stored
from plumbline.llm.words import mix, shingle_sets, words_of

N = 5
PERCENT = 80
CHUNK_SHINGLES = 2_000_000
SETS = "doc_id long, n_shingles long, set_id long, shingles binary"
ORDERED = "set_id long, n_shingles long, shingles binary, prefix array<long>"
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("shingles", pa.binary())])
_ORDERED = pa.schema([("set_id", pa.int64()), ("n_shingles", pa.int64()), ("shingles", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def needed(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` must share with a partner: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set; equal sets have equal names."""
    if not len(shingles):
        return 0
    spread = np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = mix(np.array([np.bitwise_xor.reduce(mix(shingles)) ^ np.add.reduce(mix(shingles ^ spread))], np.uint64))
    return int(total.view(np.int64)[0])


def _alone(answer: np.ndarray, percent: int) -> bool:
    return int((answer >= 2).sum()) < needed(len(answer), percent)


def document_sets(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """One row per row of ``docs``: size and name of its set, and the set itself if it may have a partner."""
    parts = B.number_of_blocks(docs)
    dealt = B.dealt(docs, parts)

    def ask(table: pa.Table) -> pa.Table:
        sets = shingle_sets(words_of(table["text"], lower=True), n)
        return B.short_request(table["block"][0].as_py(), *np.unique(sets.hash, return_counts=True), parts)

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = shingle_sets(words_of(table["text"], lower=True), n)
        seen = B.answer_of(answers, np.uint8)[np.unique(sets.hash, return_inverse=True)[1]]
        rows = []
        for doc_id, lo, hi in zip(table["doc_id"].to_pylist(), sets.first[:-1], sets.first[1:]):
            own = sets.hash[lo:hi]
            carried = None if hi == lo or _alone(seen[lo:hi], percent) else own.tobytes()
            rows.append((doc_id, int(hi - lo), set_id(own), carried))
        return B.arrow_rows(rows, _SETS)

    answers = B.answered(B.per_block(dealt, ask, B.REQUEST), 255, short=True)
    return B.with_answers(dealt, answers, judge, SETS)


def ordered_sets(classes: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """Classes (set_id, n_shingles, shingles) that may have a partner among the others, rarest shingle first.

    ``prefix`` holds those of the first n - ceil(t * n) + 1 shingles that another class has too.
    """
    dealt = classes.select(F.pmod(F.xxhash64("set_id"), F.lit(parts)).cast("int").alias("block"), "set_id", "n_shingles", "shingles")

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]

    def ask(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate(sets_of(table)), return_counts=True)
        return B.short_request(table["block"][0].as_py(), keys, counts, parts)

    def arrange(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets, rows = sets_of(table), []
        seen = B.answer_of(answers, np.uint8)[np.unique(np.concatenate(sets), return_inverse=True)[1]]
        at = 0
        for name, own in zip(table["set_id"].to_pylist(), sets):
            count = seen[at : at + len(own)]
            at += len(own)
            if _alone(count, percent):
                continue
            order = np.lexsort((own, count))
            prefix = order[: len(own) - needed(len(own), percent) + 1]
            shared = own[prefix[count[prefix] >= 2]]
            if len(shared):
                rows.append((name, len(own), own[order].tobytes(), shared.view(np.int64).tolist()))
        return B.arrow_rows(rows, _ORDERED)

    answers = B.answered(B.per_block(dealt, ask, B.REQUEST), 255, short=True)
    return B.with_answers(dealt, answers, arrange, ORDERED)


class PrefixTree:
    """Sorted integer sets with common beginnings stored once; a node is a run of elements.

    Built from the sets in lexicographic order, so that a set branches off the path of the one before.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.root = self._grown(0, len(sets), 0)

    def _common(self, lo: int, hi: int, depth: int) -> int:
        a, b = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        size = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:size] != b[depth:size])
        return depth + int(differ[0]) if len(differ) else size

    def _grown(self, lo: int, hi: int, depth: int) -> dict:
        """The node of sets order[lo:hi], which agree up to ``depth``; built without recursion."""
        top: dict = {"children": []}
        todo = [(lo, hi, depth, top)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = self._common(lo, hi, depth)
            sizes = [len(self.sets[self.order[i]]) for i in range(lo, hi)]
            node = {
                "run": self.sets[self.order[lo]][depth:end], "depth": end, "least": min(sizes), "most": max(sizes),
                "leaves": [], "children": [], "joined": False, "any": self.order[lo],
            }
            parent["children"].append(node)
            at = lo
            while at < hi and len(self.sets[self.order[at]]) == end:
                node["leaves"].append(self.order[at])
                at += 1
            while at < hi:
                first, to = self.sets[self.order[at]][end], at + 1
                while to < hi and self.sets[self.order[to]][end] == first:
                    to += 1
                todo.append((at, to, end, node))
                at = to
        return top["children"][0]


class Joined:
    """Components within a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def tree_join(sets: list[np.ndarray], stored_ones: list[int], probes: list[int], percent: int, families: list | None = None) -> Joined:
    """Components that links between ``probes`` and ``stored_ones`` (indexes into ``sets``) make.

    Sets of one of the ``families`` (None: of none) are known to be connected."""
    found = Joined(len(sets))
    first_of: dict = {}
    for i, family in enumerate(families or ()):
        if family is not None:
            found.join(i, first_of.setdefault(family, i))
    # Local global order: most frequent first, then by hash.
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -count))] = np.arange(len(every))
    ranked, at = [], 0
    for s in sets:
        ranked.append(np.sort(rank[inverse[at : at + len(s)]]))
        at += len(s)
    tree = PrefixTree([ranked[i] for i in stored_ones])
    has = np.zeros(len(every), bool)
    for probe in probes:
        own = ranked[probe]
        has[own] = True
        # Entries: node, overlap up to it; a node is met a second time, closed, when its subtree is done.
        todo = [(tree.root, 0, False)]
        while todo:
            node, overlap, closed = todo.pop()
            if closed:
                mine = found.find(stored_ones[node["any"]])
                node["joined"] = all(found.find(stored_ones[i]) == mine for i in node["leaves"]) and all(
                    c["joined"] and found.find(stored_ones[c["any"]]) == mine for c in node["children"]
                )
                continue
            if node["joined"] and found.find(stored_ones[node["any"]]) == found.find(probe):
                continue
            run = node["run"]
            overlap += int(np.count_nonzero(has[run]))
            left = len(own) - int(np.searchsorted(own, run[-1], "right")) if len(run) else len(own)
            # Some size s in the subtree must allow an overlap with 100 * o >= percent * (n + s - o).
            best = overlap + min(left, node["most"] - node["depth"])
            if (100 + percent) * best < percent * (len(own) + node["least"]):
                continue
            for i in node["leaves"]:
                size = len(tree.sets[i])
                if (100 + percent) * overlap >= percent * (len(own) + size):
                    found.join(probe, stored_ones[i])
            todo.append((node, overlap, True))
            todo += [(child, overlap, False) for child in node["children"]]
        has[own] = False
    return found


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def led_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets with one leader each: of the sets that are first on one of its prefix shingles, the
    one that is so most often. One comparison a set, so a family of near copies is joined in linear time."""
    tokens = sets.select("set_id", F.explode("prefix").alias("token"))
    first = tokens.groupBy("token").agg(F.min("set_id").alias("leader"))
    votes = tokens.join(first, "token").groupBy("set_id", "leader").agg(F.count("*").alias("n"))
    best = votes.where("set_id <> leader").groupBy("set_id").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"))
    leaders = sets.select(F.col("set_id").alias("leader"), F.col("shingles").alias("led_by"))
    pairs = best.join(sets.select("set_id", "shingles"), "set_id").join(leaders, "leader")

    def compare(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("leader", "set_id", "led_by", "shingles")))
            found = [(a, b) for a, b, x, y in rows if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], []))], schema=_LINKS)

    return pairs.select("leader", "set_id", "led_by", "shingles").mapInArrow(compare, "a long, b long")


def dealt_in_chunks(rest: DataFrame, chunk: int) -> DataFrame:
    """``rest`` (component, family or null, set_id, n_shingles, shingles) with the ``name`` of each set's chunk.

    A family of more than a chunk is ``divided``; smaller ones, whole, and the sets of no family are dealt
    together, so that chunks number as shingles do, not as families.
    """
    per_family = rest.where("family is not null").groupBy("family").agg(F.ceil(F.sum("n_shingles") / F.lit(chunk)).cast("int").alias("chunks"))
    rest = rest.join(per_family.where("chunks > 1"), "family", "left")
    mixed = rest.where("chunks is null").groupBy("component").agg(F.ceil(F.sum("n_shingles") / F.lit(chunk)).cast("int").alias("bins"))
    rest = rest.join(mixed, "component", "left")
    own = F.concat_ws("/", F.col("family").cast("string"), F.pmod(F.xxhash64("set_id"), "chunks").cast("string"))
    shared = F.concat_ws("/", F.lit("mixed"), F.pmod(F.xxhash64(F.coalesce("family", "set_id")), "bins").cast("string"))
    is_divided = F.col("chunks").isNotNull()
    return rest.select(
        "component", "family", "set_id", "shingles", F.when(is_divided, F.col("family")).alias("divided"), F.when(is_divided, own).otherwise(shared).alias("name")
    )


def chunk_pairs(dealt: DataFrame) -> DataFrame:
    """(component, pair, name, side): the chunks of each pair that meets in a task, itself included (side 0), but
    for pairs within one divided family."""
    chunks = dealt.select("component", "divided", "name").distinct()
    left, right = chunks.alias("l"), chunks.alias("r")
    wanted = (F.col("l.component") == F.col("r.component")) & (F.col("l.name") <= F.col("r.name"))
    other = ~(F.col("l.divided").isNotNull() & F.col("l.divided").eqNullSafe(F.col("r.divided")))
    met = left.join(right, wanted & other).select(F.col("l.component").alias("component"), F.col("l.name").alias("low"), F.col("r.name").alias("high"))
    sides = F.expr("case when low = high then array(named_struct('name', low, 'side', 0)) else array(named_struct('name', low, 'side', 1), named_struct('name', high, 'side', 2)) end")
    return met.select("component", F.concat_ws("|", "low", "high").alias("pair"), F.inline(sides))


def links_in_clusters(ordered: DataFrame, clusters: DataFrame, percent: int = PERCENT, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """Links (a, b) between set ids that connect each component within a cluster.

    ``clusters``: (node, component) of sets. A cluster of up to ``chunk`` shingles is joined in one
    task. In a larger one each set is first compared with a leader; sets so linked form families, the
    others a rest. A family of more than a chunk is divided; smaller ones, whole, and the rest are dealt
    together, so chunks number as shingles do, not as families. Each pair of chunks is joined in its own
    task, but for chunks of one divided family, which need no more links. A family of very many near
    copies thus meets the rest of its cluster, never itself.
    """
    sets = ordered.join(clusters.withColumnRenamed("node", "set_id"), "set_id")
    sizes = sets.groupBy("component").agg(F.sum("n_shingles").alias("all_shingles"))
    sets = stored(sets.join(sizes, "component"), "clustered")
    small = sets.where(F.col("all_shingles") <= chunk).select("component", F.lit("").alias("pair"), F.lit(0).alias("side"), "set_id", F.lit(None).cast("long").alias("family"), "shingles")
    large = sets.where(F.col("all_shingles") > chunk)
    led = stored(led_links(large, percent), "led")
    families = components(led).withColumnRenamed("node", "set_id").withColumnRenamed("component", "family")
    rest = large.join(families, "set_id", "left")
    dealt = stored(dealt_in_chunks(rest, chunk), "dealt")
    pairs = chunk_pairs(dealt)
    in_pairs = dealt.join(pairs, ["component", "name"]).select("component", "pair", "side", "set_id", "family", "shingles")

    def join(table: pa.Table) -> pa.Table:
        names = table["set_id"].to_pylist()
        sets = [np.sort(np.frombuffer(x, np.uint64)) for x in table["shingles"].to_pylist()]
        sides = table["side"].to_pylist()
        stored_ones = [i for i, s in enumerate(sides) if s < 2]
        probes = [i for i, s in enumerate(sides) if s != 1]
        if not stored_ones or not probes:
            return B.arrow_rows([], _LINKS)
        found = tree_join(sets, stored_ones, probes, percent, table["family"].to_pylist())
        rows = [(names[found.find(i)], names[i]) for i in range(len(names)) if found.find(i) != i]
        return B.arrow_rows(rows, _LINKS)

    return small.unionByName(in_pairs).groupBy("component", "pair").applyInArrow(join, "a long, b long").unionByName(led)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, n: int = N, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of distinct n-word
    shingles (A-Z lower-cased; with fewer words the whole sequence is one shingle). ``component_id``
    is the smallest doc_id reachable by links. Null, empty and wordless texts have an empty set and
    link with nothing. Repeated rows are equal sets, each row is returned; other columns are ignored.
    """
    sets = stored(document_sets(docs, percent, n), "sets")
    filled = sets.where("n_shingles > 0")
    classes = filled.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.any_value("shingles", True).alias("shingles"), F.any_value("n_shingles").alias("n_shingles"))
    open_ones = classes.where("shingles is not null")
    total = sets.where("shingles is not null").agg(F.sum("n_shingles")).first()[0] or 0
    parts = B.LEAST_BLOCKS
    while parts * (B.BLOCK_BYTES // 8) < total:
        parts *= 2
    ordered = stored(ordered_sets(open_ones.select("set_id", "n_shingles", "shingles"), parts, percent), "ordered")
    tokens = ordered.select("set_id", F.explode("prefix").alias("token"))
    first = tokens.groupBy("token").agg(F.min("set_id").alias("a"))
    clusters = stored(components(tokens.join(first, "token").select("a", F.col("set_id").alias("b"))), "clusters")
    linked = components(links_in_clusters(ordered, clusters, percent, chunk))
    least = classes.select("set_id", "least").join(linked.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = least.withColumn("component", F.coalesce("component", "set_id"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = named.join(smallest, "component").select("set_id", "component_id")
    out = filled.join(of_set, "set_id").select("doc_id", "n_shingles", "component_id")
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays. Ids must be distinct."""
    stay = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(docs.columns)
